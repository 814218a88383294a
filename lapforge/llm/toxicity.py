"""Toxicity: cumulative-link ordinal regression over sparse word and prefix features.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for all ordered thresholds;
the output is the expected grade. Labels say toxic or not, so toxic training documents are graded
1 to 3 by how much they use the words that mark toxic documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.llm.quality import is_held_out
from lapforge.session import written

WORDS_KEPT = 300_000
_letters = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class Settings:
    """``sample``: training documents of each label at most, whatever their length."""

    sample: int = 2_500
    prefixes: tuple[int, ...] = (4, 5, 6)
    markers: int = 200
    lift: float = 4.0
    surprise: float = 9.2
    grades: int = 3
    steps: int = 1500
    rate: float = 0.1
    shrink: float = 3e-5


@dataclass(frozen=True)
class Model:
    markers: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray


def word_features(word: str, s: Settings) -> list[str]:
    w = word.lower()
    return [w, *(f"{w[:n]}*" for n in s.prefixes if len(w) > n)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, s: Settings, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by Adam on the weighted log-likelihood.

    Thresholds are a first value and positive steps, so they keep their order.
    """
    n, d = x.shape
    p = np.concatenate([np.zeros(d), [1.0], np.full(grades - 1, 0.0)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, s.steps + 1):
        w, steps = p[:d], np.exp(p[d + 1 :])
        theta = p[d] + np.concatenate([[0.0], np.cumsum(steps)])
        z = x @ w
        cdf = _sigmoid(theta[None, :] - z[:, None])
        up = np.where(y < grades, cdf[np.arange(n), np.minimum(y, grades - 1)], 1.0)
        down = np.where(y > 0, cdf[np.arange(n), np.maximum(y - 1, 0)], 0.0)
        mass = np.maximum(up - down, 1e-9)
        du, dd = np.where(y < grades, up * (1 - up), 0.0) / mass, np.where(y > 0, down * (1 - down), 0.0) / mass
        g_theta = np.zeros(grades)
        np.add.at(g_theta, np.minimum(y, grades - 1), -weight * du)
        np.add.at(g_theta, np.maximum(y - 1, 0), weight * dd)
        g = np.concatenate([x.T @ (weight * (du - dd)) + s.shrink * weight.sum() * w, [g_theta.sum()], [g_theta[k:].sum() * steps[k - 1] for k in range(1, grades)]]) / weight.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])


def marker_words(counted: DataFrame, toxic: int, clean: int, s: Settings) -> list[str]:
    """Features that mark toxic rows: those of the highest log-likelihood ratio, with the lift and surprise asked for.

    ``counted`` has ``label`` and distinct ``names`` of each row; only the chosen ones reach the driver.
    """
    part = toxic / (toxic + clean)
    df = counted.select("label", F.explode("names").alias("f")).groupBy("f").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).where("t > 0")
    t, c = F.col("t"), F.col("c")
    lift = ((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))
    # The feature's split against that of all rows.
    gain = t * F.log(t / ((t + c) * part)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - part)))).otherwise(0.0)
    df = df.where(lift >= s.lift).select("f", gain.alias("gain")).where(F.col("gain") >= s.surprise)
    return [r["f"] for r in df.orderBy(F.desc("gain"), "f").limit(s.markers).collect()]


def learn(rows: list[tuple[dict[str, int], int]], chosen: list[str], s: Settings, share: float) -> Model:
    """Weights and thresholds from (counts of chosen features, toxic) rows; ``share``: toxic labels in all.

    Without toxic or without clean rows there are no markers and nothing is called toxic.
    """
    flag = np.array([y for _, y in rows])
    if not len(rows) or flag.min() == flag.max():
        return Model({}, np.zeros(0), np.array([20.0 + k for k in range(s.grades)]))
    at = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((len(rows), len(at)))
    for i, (counts, _) in enumerate(rows):
        for f, n in counts.items():
            x[i, at[f]] = np.log1p(n)
    marks = np.array([sum(np.log1p(n) for f, n in c.items() if not f.endswith("*")) for c, _ in rows])
    cuts = np.quantile(marks[flag == 1], [k / s.grades for k in range(1, s.grades)])
    y = np.where(flag == 1, 1 + np.searchsorted(cuts, marks, side="left"), 0)
    # Rows count by how common their label is, as the sample holds more of the rare one.
    weight = np.where(flag == 1, share / max(flag.mean(), 1e-9), (1 - share) / max(1 - flag.mean(), 1e-9))
    w, theta = fit_ordinal(x, y, s.grades, s, weight)
    return Model(at, w, theta)


def fit(documents: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "toxic") -> Model:
    """A model from at most ``s.sample`` training documents of either label, the first by hash.

    Features are counted and chosen on the executors, so a chosen document counts as a whole
    however long it is; the driver gets the counts of at most ``s.markers`` features of each.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    share = marked.agg(F.avg("label").alias("share")).first()["share"] or 0.0
    one = lambda k: marked.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    chosen = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(one(0).union(one(1))), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, y, t in zip(batch["doc_id"], batch["label"], batch["text"]):
                c = Counter(f for w in _letters(t) for f in word_features(w, s))
                yield pd.DataFrame({"doc_id": [doc_id], "label": [y], "names": [list(c)], "counts": [list(c.values())]})

    counted = written(chosen.mapInPandas(count, "doc_id long, label int, names array<string>, counts array<int>"), "counted")
    n = {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    markers = marker_words(counted, n[1], n[0], s) if len(n) == 2 else []
    hits = F.filter(F.arrays_zip("names", "counts"), lambda x: x["names"].isin(markers))
    rows = counted.select("doc_id", "label", hits.alias("hits")).orderBy("doc_id", "hits").toLocalIterator()
    return learn([({h["names"]: h["counts"] for h in r["hits"]}, int(r["label"])) for r in rows], markers, s, share)


def severity(documents: DataFrame, model: Model, s: Settings = Settings()) -> Column:
    """Struct of ``severity`` (expected grade) and ``p_toxic`` for every whole text; null is empty."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, p_toxic double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, known = shared.value, {}
        for texts in batches:
            out = []
            for text in texts:
                hits: Counter = Counter()
                for word in _letters(text or ""):
                    found = known.get(word)
                    if found is None:
                        if len(known) >= WORDS_KEPT:
                            known.clear()
                        found = known[word] = tuple(m.markers[f] for f in word_features(word, s) if f in m.markers)
                    if found:
                        hits.update(found)
                z = sum(m.weights[i] * np.log1p(n) for i, n in hits.items())
                over = _sigmoid(z - m.thresholds)
                out.append((float(over.sum()), float(over[0])))
            yield pd.DataFrame(out, columns=["severity", "p_toxic"], dtype="float64")

    return run(F.col("text"))


def graded(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``documents`` with ``held_out``, ``severity`` (0 to ``grades``), ``p_toxic``, ``grade`` and ``toxic``.

    ``grade`` is the rounded severity, ``toxic`` 1 if a grade above 0 is likelier than not. Every
    row is graded by its whole text alone; repeated rows agree; an empty text has no features.
    """
    model = fit(documents, labels, s)
    out = documents.withColumn("_s", severity(documents, model, s)).withColumns({"severity": F.col("_s.severity"), "p_toxic": F.col("_s.p_toxic")}).drop("_s")
    return out.withColumns({"held_out": is_held_out(F.col("doc_id")), "grade": F.round("severity").cast("int"), "toxic": (F.col("p_toxic") >= 0.5).cast("int")})
