"""Quality classifier: learned hashed word and n-gram vectors, averaged per document, softmax.

A document is the mean of the vectors of its features; a linear layer and softmax follow. As the
layer is linear, a trained model shrinks to one pair of class scores for each feature bucket.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.llm.common import WORD
from lapforge.session import written

HELD_OUT = 2
THRESHOLD = 0.7
WORDS_KEPT = 500_000
GRAMS_KEPT = 200_000
CHARS = 1 << 20
_words = re.compile(WORD).findall


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents to fit on, at most, whatever their length."""

    buckets: int = 1 << 16
    dims: int = 16
    grams: tuple[int, ...] = (2, 3)
    epochs: int = 8
    rate: float = 0.5
    sample: int = 4_000
    seed: int = 7


class _Buckets(dict):
    """Bucket of every character n-gram asked for; at most ``GRAMS_KEPT`` are remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def of(self, name: str) -> int:
        return crc32(name.encode("utf-8", "surrogatepass")) % self.buckets

    def __missing__(self, name: str) -> int:
        if len(self) >= GRAMS_KEPT:
            self.clear()
        self[name] = bucket = self.of(name)
        return bucket


def word_features(word: str, before: str, s: Settings, grams: _Buckets) -> list[int]:
    """Buckets of one word in its place: the word, its character n-grams, and the word pair.

    A pair is hashed as the word's shape beside its neighbour's, with a sign for a repeated word,
    since most pairs of words are never seen again.
    """
    b = f"<{word}>"
    return [grams.of(b), *[grams[b[i : i + n]] for n in s.grams for i in range(len(b) - n + 1)], grams["same" if word == before else "new"]]


def _spread(words: list[str], s: Settings, known: dict, grams: _Buckets) -> Iterator[list[int]]:
    before = ""
    for word in words:
        key = (word, word == before)
        found = known.get(key)
        if found is None:
            if len(known) >= WORDS_KEPT:
                known.clear()
            found = known[key] = word_features(word, before, s, grams)
        yield found
        before = word


def features(text: str, s: Settings, known: dict, grams: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs. A text without words has none."""
    all_ = [b for f in _spread(_words(text), s, known, grams) for b in f]
    return np.unique(np.array(all_, dtype="int32"), return_counts=True)


#: One byte's step of a CRC-32, for arrays.
_STEP = np.array([crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], dtype="uint32")


def ascii_features(words: list[bytes], s: Settings) -> np.ndarray:
    """``word_features`` of ASCII words of one length, a row each, but for the pair's sign, which comes last there."""
    padded = [b"<" + w + b">" for w in words]
    text = np.frombuffer(b"".join(padded), dtype="uint8").reshape(len(words), -1)
    parts = [np.array([crc32(b) for b in padded], dtype="uint32")[:, None]]
    for n in s.grams:
        c = np.uint32(0xFFFFFFFF)
        for j in range(n if n <= text.shape[1] else 0):
            c = _STEP[(c ^ text[:, j : text.shape[1] - n + 1 + j]) & 0xFF] ^ (c >> np.uint32(8))
        if n <= text.shape[1]:
            parts.append(c ^ np.uint32(0xFFFFFFFF))
    return (np.hstack(parts) % np.uint32(s.buckets)).astype("int64")


class _Scores:
    """Scores of texts from their words, whose sums are remembered: ``WORDS_KEPT`` words and those of one call at most."""

    def __init__(self, weight: np.ndarray, s: Settings):
        self.weight, self.s, self.grams = weight, s, _Buckets(s.buckets)
        self.clear()

    def clear(self) -> None:
        """``sums`` has a word's sum where it is new and where it follows itself, ``sizes`` the number of its features."""
        self.places: dict[bytes, int] = {}
        self.sums, self.sizes = np.zeros((0, 2)), np.zeros(0, dtype="int64")

    def learn(self, words: set[bytes]) -> None:
        fresh = words.difference(self.places)
        if len(self.places) + len(fresh) > WORDS_KEPT:
            self.clear()
            fresh = words
        alike: dict[int, list[bytes]] = {}
        for word in fresh:
            alike.setdefault(len(word) if word.isascii() else -1, []).append(word)
        sums, sizes = [self.sums], [self.sizes]
        for size, group in alike.items():
            few = max(1, CHARS // (size + 1)) if size >= 0 else len(group)
            for part in (group[i : i + few] for i in range(0, len(group), few)):
                two, n = self._ascii(part) if size >= 0 else self._others(part)
                sums.append(two)
                sizes.append(n)
            self.places.update(zip(group, range(len(self.places), len(self.places) + len(group))))
        self.sums, self.sizes = np.vstack(sums), np.concatenate(sizes)

    def _ascii(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        f = ascii_features(words, self.s)
        ends = [np.full((len(f), 1), self.grams[sign]) for sign in ("new", "same")]
        sums = np.stack([self.weight.take(np.hstack([f, end])).sum(axis=1) for end in ends], axis=1)
        return sums.astype("float64"), np.full(len(f), f.shape[1] + 1)

    def _others(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sums, sizes = np.zeros((len(words), 2)), np.zeros(len(words), dtype="int64")
        for i, word in enumerate(words):
            name = word.decode("utf-8", "surrogatepass")
            for j, before in enumerate(("", name)):
                f = word_features(name, before, self.s, self.grams)
                sums[i, j], sizes[i] = self.weight.take(f).sum(), len(f)
        return sums, sizes

    def means(self, texts: list[str]) -> Iterator[float]:
        """Mean score of every text's features, repeats included; 0 without words.

        Bytes split at ASCII white space, which gives the words of ``WORD``; sums run in their order.
        """
        words = [text.encode("utf-8", "surrogatepass").split() for text in texts]
        self.learn(set(chain.from_iterable(words)))
        for of in words:
            at = np.fromiter(map(self.places.__getitem__, of), "int64", len(of))
            again = np.zeros(len(of), dtype="int64")
            again[1:] = at[1:] == at[:-1]
            yield float(self.sums[at, again].cumsum()[-1] / self.sizes[at].sum()) if of else 0.0


def _groups(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts in groups of about ``CHARS`` characters; null counts as empty."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= CHARS:
            yield group
            group, size = [], 0
    yield group


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings, classes: int = 2) -> np.ndarray:
    """Class scores per bucket (buckets + 1 rows; the last is the bias), by stochastic gradient descent.

    Without rows, or with one class only, every score follows from the bias.
    """
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1, 1, (s.buckets, s.dims)).astype("float32") / s.dims
    layer, bias = np.zeros((s.dims, classes), "float32"), np.zeros(classes, "float32")
    steps, step = max(1, s.epochs * len(rows)), 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            ids, counts, label = rows[k]
            rate = s.rate * (1 - step / steps)
            step += 1
            share = (counts / max(1, counts.sum())).astype("float32")
            mean = share @ vectors[ids] if len(ids) else np.zeros(s.dims, "float32")
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p
            # A common rate would hardly move single features of a long text: their share is small.
            vectors[ids] -= rate * share[:, None] * back * min(len(ids), 100)
    return np.vstack([vectors @ layer, bias]).astype("float32")


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, s: Settings) -> DataFrame:
    """Labelled documents outside the held-out fold: ``doc_id``, ``text`` and ``label``.

    Several labels of one id count as their rounded mean; null labels and ids do not count. The
    first ``s.sample`` ids by hash are taken, so their list has a fixed bound.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("label"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id")


def fit(documents: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "quality") -> np.ndarray:
    """Scores per bucket learned from a bounded sample; the texts are turned into counts on the executors.

    A document has at most ``s.buckets`` counts however long it is. They come one by one and lie in
    a temporary file while the driver trains on them, so no document is left out for its length.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, grams = {}, _Buckets(s.buckets)
        for batch in batches:
            for doc_id, y, t, k in zip(batch["doc_id"], batch["label"], batch["text"], batch["k"]):
                ids, counts = features(t, s, known, grams)
                yield pd.DataFrame({"doc_id": [doc_id], "label": [y], "size": [len(t)], "k": [k], "ids": [ids], "counts": [counts.astype("int32")]})

    chosen = training_rows(documents, labels, label, s).withColumn("k", F.xxhash64("text"))
    counted = written(chosen.mapInPandas(count, "doc_id long, label int, size long, k long, ids array<int>, counts array<int>"), "counted")
    with tempfile.TemporaryFile() as kept:
        got, end = [], 0
        for r in counted.toLocalIterator():
            both = np.array([r["ids"], r["counts"]], dtype="int32")
            kept.write(both.tobytes())
            got.append((r["doc_id"], r["size"], r["k"], r["label"], end, end + both.size))
            end += both.size
        kept.flush()
        all_ = np.memmap(kept, dtype="int32", mode="r", shape=(end,)) if end else np.zeros(0, "int32")
        got = pd.DataFrame(got, columns=["doc_id", "size", "k", "label", "at", "end"]).sort_values(["doc_id", "size", "k"])
        rows = []
        for r in got.sample(frac=1, random_state=s.seed).itertuples():
            ids, counts = all_[r.at : r.end].reshape(2, -1)
            rows.append((ids, counts, int(r.label)))
        return train(rows, s)


def score(documents: DataFrame, model: np.ndarray, s: Settings = Settings()) -> Column:
    """Probability of label 1 for every whole text; a null or empty text gets that of the bias."""
    shared = documents.sparkSession.sparkContext.broadcast(model[:, 1] - model[:, 0])

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight = shared.value
        scores = _Scores(weight, s)
        for texts in batches:
            out = [1 / (1 + np.exp(-(mean + float(weight[-1])))) for group in _groups(texts) for mean in scores.means(group)]
            yield pd.Series(out, dtype="float64")

    return run(F.col("text"))


def judged(documents: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with ``held_out``, ``score`` and ``predicted`` (1 if the score is at least ``threshold``).

    Every row gets a score, repeated rows the same; only ``text`` is read for it. ``held_out`` is
    false for a null id. Without labels all scores are 0.5.
    """
    model = fit(documents, labels, s)
    out = documents.withColumn("held_out", is_held_out(F.col("doc_id"))).withColumn("score", score(documents, model, s))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
