"""Token counts of sections: encode whole documents once, then attribute tokens by their spans."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "most")


class SpanTokenizer:
    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.width = np.zeros(max(table.values()) + 1, "int64")
        for piece, rank in table.items():
            self.width[rank] = len(piece)

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in UTF-8 bytes."""
        return np.cumsum(self.width[np.asarray(self.encoding.encode_ordinary(text), dtype="int64")])


@lru_cache(maxsize=2)
def _tokenizer(ranks: bytes, pattern: str) -> SpanTokenizer:
    return SpanTokenizer(ranks, pattern)


def section_ends(text: str) -> np.ndarray:
    """Where each line ends in UTF-8 bytes, its line feed included; an empty text is one empty line."""
    raw = np.frombuffer(text.encode("utf-8"), "uint8")
    breaks = np.flatnonzero(raw == 10) + 1
    return breaks if len(breaks) and breaks[-1] == len(raw) else np.append(breaks, len(raw))


def attribute(tokens: np.ndarray, sections: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section, from the sorted ends of both.

    A token that crosses boundaries belongs to the section of its first byte (``start``), of its
    last byte (``end``), or to the one with most of its bytes, the first of equals (``most``).
    """
    starts = np.append(0, tokens[:-1]) if len(tokens) else tokens
    first, last = np.searchsorted(sections, starts, "right"), np.searchsorted(sections, tokens, "left")
    owner = last if rule == "end" else first.copy()
    if rule == "most":
        edges = np.append(0, sections)
        for t in np.flatnonzero(first != last):
            span = range(first[t], last[t] + 1)
            owner[t] = max(span, key=lambda j: (min(tokens[t], edges[j + 1]) - max(starts[t], edges[j]), -j))
    n = len(sections)
    return np.bincount(owner, minlength=n), np.bincount(owner[first != last], minlength=n)


def section_tokens(documents: DataFrame, path: str, pattern: str, rule: str = "start") -> DataFrame:
    """``doc_id``, ``section``, ``start``, ``length``, ``n_tokens``, ``n_crossing`` of every line.

    ``start`` and ``length`` are code points of the line with its line feed. The whole text is
    encoded once, so the counts of a document add up to those of its text. A null or empty text
    has one section without tokens. Repeated rows and null ids give rows of their own; other
    columns are not read. The tokenizer file is a fixed asset that goes to the tasks as it is.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(path, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<struct<start:long,length:long,n_tokens:long,n_crossing:long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = _tokenizer(ranks.value, pattern)
        for texts in batches:
            out = []
            for text in texts:
                text = text or ""
                counts, crossing = attribute(tok.ends(text), section_ends(text), rule)
                lines = text.split("\n")
                sizes = [len(x) + 1 for x in lines[:-1]] + ([len(lines[-1])] if lines[-1] or len(lines) == 1 else [])
                at, rows = 0, []
                for size, n, c in zip(sizes, counts.tolist(), crossing.tolist(), strict=True):
                    rows.append({"start": at, "length": size, "n_tokens": n, "n_crossing": c})
                    at += size
                out.append(rows)
            yield pd.Series(out, dtype=object)

    spans = documents.select("doc_id", run(F.col("text")).alias("_s"))
    return spans.select("doc_id", F.posexplode("_s").alias("section", "_r")).select("doc_id", "section", "_r.*")
