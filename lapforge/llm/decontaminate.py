"""Benchmark decontamination: one automaton over normalised item windows, texts scanned once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.llm.common import ascii_lower
from lapforge.session import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
#: Pattern characters of one automaton, about 100 bytes each in a worker's memory.
LIMIT = 1_000_000
ITEM_COST = 16

_BYTE = np.arange(256, dtype="uint8")
_IS_WORD = np.isin(_BYTE, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "uint8")) | (_BYTE >= 128)
_NORMAL = np.where(_IS_WORD, _BYTE, 32).astype("uint8").tobytes().lower()


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (``window``, ``item``): each run of ``width`` words of an item, or all of a shorter one.

    ``item`` is the id as a string; a null id is the empty string. Items without words have none.
    """
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")).where(F.size("w") > 0)
    rows = rows.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))).alias("i"))
    return rows.select(F.array_join(F.slice("w", F.col("i"), F.lit(width)), " ").alias("window"), "item").distinct()


class Scanner:
    """The automaton of some (window, items) entries.

    A pattern is a window with a blank on both sides, and a text is its words joined and enclosed
    by blanks, so patterns match whole words only; overlapping matches share a blank.
    """

    def __init__(self, entries: list[tuple[str, list[str]]]):
        self.items = [items for _, items in entries]
        self.sizes = np.array([w.count(" ") + 1 for w, _ in entries], "int64")
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, (window, _) in enumerate(entries):
            self.automaton.add_word(f" {window} ", k)
        if entries:
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, set[str], np.ndarray]:
        """Number of words, items with a window in the text, and merged hits as rows of
        (first word, last word, start, end), the last two code point offsets in the text."""
        raw = text.encode("utf-8")
        words = raw.translate(_NORMAL).split()
        none = np.zeros((0, 4), "int64")
        if not self.items or not words:
            return len(words), set(), none
        line = f" {b' '.join(words).decode('utf-8')} "
        found = list(self.automaton.iter(line))
        if not found:
            return len(words), set(), none
        at, which = np.array(found, "int64").T
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32)
        last = np.searchsorted(blanks, at) - 1
        first = last - self.sizes[which] + 1
        spans = merged(np.stack([first, last, *_offsets(raw, first, last)], axis=1))
        return len(words), {i for k in np.unique(which).tolist() for i in self.items[k]}, spans


def _offsets(raw: bytes, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where word ``first`` starts and word ``last`` ends, in code points of the original text."""
    codes = np.frombuffer(raw, "uint8")
    inside = np.concatenate([[False], _IS_WORD[codes], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    point = np.append(0, np.cumsum((codes & 0xC0) != 0x80))
    return point[edges[2 * first]], point[edges[2 * last + 1]]


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans that overlap or touch in words become one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(0, np.flatnonzero(spans[1:, 0] > reach[:-1] + 1) + 1)
    stop = np.append(new[1:], len(spans)) - 1
    return np.stack([spans[new, 0], reach[stop], spans[new, 2], np.maximum.accumulate(spans[:, 3])[stop]], axis=1)


@lru_cache(maxsize=1)
def _scanner(number: int, entries: Broadcast) -> Scanner:
    return Scanner(entries.value)


def _scan(number: int, entries: Broadcast, text: str, before: list[Column]) -> Column:
    """Scan with one automaton; ``before`` are the items and spans that earlier ones found."""

    @F.pandas_udf("n_words long, n_hit long, items array<string>, spans array<long>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(number, entries)
        for texts, items, spans in batches:
            rows = []
            for value, had, old in zip(texts, items, spans):
                n, now, new = scanner.scan(value or "")
                if len(old):
                    new = merged(np.concatenate([np.asarray(old, "int64").reshape(-1, 4), new]))
                rows.append((n, int((new[:, 1] - new[:, 0] + 1).sum()), sorted(now.union(had)), new.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    return run(text, *before)


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """What of every document stands in the benchmark: ``doc_id``, ``n_words``, ``n_hit``, ``items``, ``spans``.

    Texts are normalised to words (``WORD`` after lower-casing A-Z). A word inside any occurrence
    of an item window is hit. ``items`` are the ids of the items with occurring windows, sorted as
    strings; ``spans`` the merged hits as (``first``, ``last``) words and (``start``, ``end``) code
    points of the original text.

    The automaton's patterns are measured first. Up to ``limit`` characters there is one, sent to
    the tasks; a larger benchmark is dealt by hash to several of at most about that size, and the
    texts are scanned once by each, with the hits so far written in between. Documents are never
    shuffled, so a hot source or a common passage is like any other row.

    Null and empty texts have no words. Null ids and repeated rows stay rows of their own; rows of
    one item id are one item. Empty tables give no rows, or no hits. Other columns are not read.
    """
    windows = written(item_windows(benchmark, width), "windows")
    size = windows.agg(F.sum(F.length("window") + F.length("item") + ITEM_COST).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // limit))
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text", F.array().cast("array<string>").alias("items"), F.array().cast("array<long>").alias("spans"))
    for k in range(shards):
        mine = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(shards)) == k) if shards > 1 else windows
        entries = [(r["window"], sorted(r["items"])) for r in mine.groupBy("window").agg(F.collect_list("item").alias("items")).collect()]
        found = _scan(k, spark.sparkContext.broadcast(entries), "text", [F.col("items"), F.col("spans")])
        rows = rows.select("doc_id", "text", found.alias("_f")).select("doc_id", "text", "_f.*")
        if k + 1 < shards:
            rows = written(rows, "scanned")
    cell = lambda i, j: F.get("spans", 4 * i + j)
    spans = F.transform(F.sequence(F.lit(0), F.expr("size(spans) div 4 - 1").cast("int")),
                        lambda i: F.struct(cell(i, 0).alias("first"), cell(i, 1).alias("last"), cell(i, 2).alias("start"), cell(i, 3).alias("end")))
    kind = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
    return rows.select("doc_id", "n_words", "n_hit", "items", F.when(F.size("spans") > 0, spans).otherwise(F.array().cast(kind)).alias("spans"))
