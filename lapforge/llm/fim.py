"""Fill-in-middle: cut texts at two line ends found by select on a compressed boundary set."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 1 << 16
WORDS = CHUNK // 64


class ArrayContainer:
    """The values themselves, two bytes each."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype("uint16")

    def select(self, k: int) -> int:
        return int(self.values[k])

    def rank(self, x: int) -> int:
        return int(np.searchsorted(self.values, x, "left"))


class BitmapContainer:
    """1 024 words of 64 bits, with the number of set bits up to each."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(CHUNK, "uint8")
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype="int64")

    def _bits(self, word: int) -> np.ndarray:
        return np.unpackbits(self.words[word : word + 1].view("uint8"), bitorder="little")

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.upto, k, "right"))
        before = int(self.upto[word - 1]) if word else 0
        return word * 64 + int(np.flatnonzero(self._bits(word))[k - before])

    def rank(self, x: int) -> int:
        word, bit = divmod(x, 64)
        before = int(self.upto[word - 1]) if word else 0
        return before + int(self._bits(word)[:bit].sum())


class RunContainer:
    """First value of every run of neighbours, with the number of values up to its end."""

    def __init__(self, values: np.ndarray):
        first = np.append(True, np.diff(values) != 1)
        self.starts = values[first].astype("uint16")
        self.upto = np.append(np.flatnonzero(first)[1:], len(values)).astype("int32")

    def _before(self, run: int) -> int:
        return int(self.upto[run - 1]) if run else 0

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.upto, k, "right"))
        return int(self.starts[run]) + k - self._before(run)

    def rank(self, x: int) -> int:
        run = int(np.searchsorted(self.starts, x, "left")) - 1
        if run < 0:
            return 0
        return min(self._before(run) + x - int(self.starts[run]), int(self.upto[run]))


def container(values: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three for sorted distinct values below 65 536."""
    runs = 1 + int(np.count_nonzero(np.diff(values) != 1))
    sizes = {RunContainer: 6 * runs, ArrayContainer: 2 * len(values), BitmapContainer: 12 * WORDS}
    return min(sizes, key=lambda kind: sizes[kind])(values)


class BoundarySet:
    """Sorted distinct offsets, cut by their high bits into containers of 65 536 places each.

    ``upto`` has the cumulative cardinality of the containers: a select searches it for the
    container and selects inside that one only.
    """

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        edges = np.flatnonzero(np.diff(high)) + 1
        self.high = high[np.append(0, edges)] if len(offsets) else high
        parts = np.split(offsets & (CHUNK - 1), edges) if len(offsets) else []
        self.containers = [container(p) for p in parts]
        self.upto = np.cumsum([len(p) for p in parts], dtype="int64")

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The offset with ``k`` smaller ones in the set."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.upto, k, "right"))
        return (int(self.high[at]) << 16) + self.containers[at].select(k - (int(self.upto[at - 1]) if at else 0))

    def rank(self, x: int) -> int:
        """How many offsets of the set are smaller than ``x``."""
        at = int(np.searchsorted(self.high, x >> 16, "left"))
        before = int(self.upto[at - 1]) if at else 0
        if at < len(self.high) and int(self.high[at]) == x >> 16:
            return before + self.containers[at].rank(x & (CHUNK - 1))
        return before


def line_ends(text: str) -> np.ndarray:
    """Code point offsets after every line (``[^\\n]*\\n|[^\\n]+``) of a text."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(codes == 10) + 1
    return np.append(ends, len(codes)) if len(codes) and codes[-1] != 10 else ends


def cut(text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """Lines of a text and the code point offsets of both cuts, the smaller first."""
    ends = BoundarySet(line_ends(text))
    n = len(ends)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    offset = lambda units: ends.select(units - 1) if units else 0
    return n, offset(first), offset(second)


def _cuts(text: Column, h1: Column, h2: Column) -> Column:
    @F.pandas_udf("n long, first long, second long")
    def run(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(*row) for row in zip(texts, a, b)], columns=["n", "first", "second"])

    return run(text, h1, h2)


def fill_in_middle(documents: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Transform every text: ``doc_id``, ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    The draws of a document are the first four 32-bit words of sha256(``seed:doc_id``), so reruns
    agree: two line ends (any of them, or the start), whether to transform (``rate`` in 100) and
    the order of the parts (``spm`` in 100 suffix first). A text that is empty or null, holds a
    sentinel, or is not chosen stays ``plain``: output is the text, a null one's is empty, and
    the parts' sizes are null. Sizes are code points.

    Rows are independent: a null id draws as an empty one, repeated rows give equal rows, an
    empty table gives none, other columns are not read. A text is one value, however long it is.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("_h"))
    draw = lambda k: F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long")
    rows = rows.select("doc_id", "text", "_h", _cuts(F.col("text"), draw(0), draw(1)).alias("_c")).select("doc_id", "text", "_h", "_c.*")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (draw(2) % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(draw(3) % 100 < spm, "spm").otherwise("psm"))
    a, b = F.col("first").cast("int"), F.col("second").cast("int")
    head, body, tail = F.left("text", a), F.substr("text", a + 1, b - a), F.substr("text", b + 1)
    output = (F.when(F.col("form") == "plain", F.col("text"))
              .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), body))
              .otherwise(F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), body)))
    sized = lambda size: F.when(F.col("form") != "plain", size)
    return rows.select("doc_id", "n", "form", sized(F.col("first")).alias("prefix_chars"), sized(F.col("second") - F.col("first")).alias("middle_chars"),
                       output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed. Its own text holds no sentinel, so the three found are the marks."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    at = lambda k: F.get(part, F.lit(k))
    return (F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1))))
