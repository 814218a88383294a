"""SentencePiece BPE encoding by a prefix table, and decoding.

The table of a text holds, for every prefix, the one token its encoding ends in. A token that an
automaton finds at the end of a prefix is that token when it forms a compatible pair with the last
token of what is left: a pair is compatible when merging its joined string gives the two back.
Following last tokens backwards from the end gives the ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
SEGMENTS_KEPT = 400_000
PAIRS_KEPT = 1_000_000
LONG = 64


class _Segments(dict):
    """Packed ids by segment; two generations, so that frequent ones stay when memory is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part) or self.make(part)
        if len(part) <= LONG:
            if len(self) >= SEGMENTS_KEPT:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


class PieceEncoder:
    """Ids of a text, equal to those of the library for a BPE model with the identity normaliser."""

    def __init__(self, model: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in usual}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(sp.is_byte(i) for i in self.bytes)
        self.unknown = sp.unk_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("pieces with an inner space are not supported")
        self.cut = self._cutter().findall
        self.pairs: dict[tuple[str, str], bool] = {}
        self.code = "<H" if sp.get_piece_size() <= 1 << 16 else "<i"
        self.known = _Segments(self.segment)
        # Pieces that merging never yields cannot end a prefix.
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            if len(p) > 1 and self.merged(p) == [p]:
                self.automaton.add_word(p, (p, len(p)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored pair, the leftmost of equals, until none is left.

        Only for the short strings of single pieces and of pairs.
        """
        parts, score, none = list(text), self.score.get, float("-inf")
        offers = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while offers and (best := max(offers)) > none:
            i = offers.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del offers[i]
            if i:
                offers[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(offers):
                offers[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            got = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return got

    def tokens(self, text: str) -> list[str]:
        """Tokens of one segment, from the prefix table. A character without a piece is a token too."""
        last: list[str | None] = [None] * len(text)
        done, pairs = 0, self.pairs
        if len(text) > 1 and len(self.automaton):
            for at, (piece, size) in self.automaton.iter(text):
                if last[at] is not None:
                    continue
                while done < at:  # no longer token fits there, so the character itself does
                    last[done] = last[done] or text[done]
                    done += 1
                if at < size:
                    last[at] = piece
                    continue
                fits = pairs.get((last[at - size], piece))
                if self.compatible(last[at - size], piece) if fits is None else fits:
                    last[at] = piece
        out, at = [], len(text) - 1
        while at >= 0:
            token = last[at] or text[at]
            out.append(token)
            at -= len(token)
        out.reverse()
        return out

    def segment(self, text: str) -> bytes:
        """Ids of one segment, packed; spaces are still spaces here."""
        ids: list[int] = []
        for token in self.tokens(text.replace(" ", SPACE)):
            if token in self.id_of:
                ids.append(self.id_of[token])
            elif self.fallback:
                ids.extend(self.bytes[b] for b in token.encode("utf-8", "surrogatepass"))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return np.array(ids, self.code).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text. Texts are cut where no piece reaches across, so segments recur."""
        if not text:
            return np.empty(0, self.code)
        # A lone mark in the text is a space to the library too.
        parts = self.cut(" " + text.replace(SPACE, " "))
        return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), self.code)

    def _cutter(self) -> re.Pattern:
        """Cuts before a space, around line breaks without a piece, and before a sign that no piece
        has after a letter."""
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("pieces with an inner space are not supported")
        inner = {c for p in self.id_of if len(p) > 1 for c in p}
        breaks = {c for c in "\n\r\t" if c not in inner}
        signs = {c for c in inner if not c.isalpha() and not c.isdecimal()} - {SPACE}
        follows = {(b, a) for p in self.id_of for a, b in zip(p, p[1:])}
        while bad := {b for b, a in follows if b in signs and a not in signs and a != SPACE}:
            signs -= bad
        brk, sign = (re.escape("".join(sorted(x))) for x in (breaks, signs))
        rest = f"[^ {brk}{sign}]+"
        return re.compile("|".join([f" *[{sign}]*{rest}" if sign else f" *{rest}", f" *[{sign}]+" if sign else " +", " +", f"[{brk}]" if brk else " +"]))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> PieceEncoder:
    return PieceEncoder(model)


def _model(spark: SparkSession, path: str):
    """The model file, a fixed asset of the driver of a few hundred KB, for the tasks."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(spark: SparkSession, path: str, text: Column) -> Column:
    """Struct of ``ids`` (array of int) and ``decoded`` (string) for every whole text.

    No begin or end ids. A null or empty text gives no ids and an empty string. Rows are
    independent, so repeats, ties and any other columns do not matter.
    """
    model = _model(spark, path)

    @F.pandas_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = _encoder(model.value)
        for texts in batches:
            ids = [e.encode(t or "") for t in texts]
            yield pd.DataFrame({"ids": [x.astype("int32") for x in ids], "decoded": [e.decode(x.tolist()) for x in ids]})

    return run(text)


def decode(spark: SparkSession, path: str, ids: Column) -> Column:
    """The text of an array of ids; null or no ids: empty."""
    model = _model(spark, path)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder(model.value)
        for rows in batches:
            yield pd.Series([e.decode([int(i) for i in x]) if x is not None else "" for x in rows], dtype=object)

    return run(ids)
