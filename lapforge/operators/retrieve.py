"""Lexical, vector and hybrid ranking of documents for many queries at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.operators.clean import salted_lookup
from lapforge.operators.documents import assemble
from lapforge.operators.ordered import G, ordered
from lapforge.session import small_arrow_batches, written

K1, B = 1.2, 0.75
QUERY_BATCH = 256
#: Texts that Python counts at once, their bytes, and documents of a scored block.
TEXT_ROWS, TEXT_BYTES, BLOCK_DOCS = 256, 8 << 20, 2048


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _postings(docs: DataFrame, doc: str, fields: Sequence[str], terms: list[str]) -> DataFrame:
    """``doc`` and for field i its length ``dl<i>`` and the ids ``t<i>`` and counts ``f<i>`` of its
    ``terms``, a sorted list. Texts are split on the JVM; counting is done for a batch at once."""
    known = docs.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))
    rows = docs.select(F.col(doc).cast("long").alias("doc"), *[tokens(F.col(f)).alias(f"ts{i}") for i, f in enumerate(fields)])

    def count(batches):
        for b in batches:
            cols = {"doc": b.column("doc")}
            for i in range(len(fields)):
                lists = b.column(f"ts{i}")
                at = pc.index_in(lists.flatten(), value_set=known.value)
                row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                fine = at.is_valid().to_numpy(zero_copy_only=False)
                pair, n = np.unique(row[fine] * max(len(terms), 1) + at.drop_null().to_numpy(), return_counts=True)
                starts = np.searchsorted(pair // max(len(terms), 1), np.arange(b.num_rows + 1)).astype("int32")
                cols[f"dl{i}"] = pc.list_value_length(lists)
                cols[f"t{i}"] = pa.ListArray.from_arrays(pa.array(starts), pa.array((pair % max(len(terms), 1)).astype("int32")))
                cols[f"f{i}"] = pa.ListArray.from_arrays(pa.array(starts), pa.array(n.astype("int32")))
            yield pa.RecordBatch.from_pydict(cols)

    schema = ", ".join(["doc long", *[f"dl{i} int, t{i} array<int>, f{i} array<int>" for i in range(len(fields))]])
    return rows.mapInArrow(count, schema)


class _Best:
    """The k best documents of one query so far, ties to the lower document."""

    def __init__(self, k: int):
        self.k, self.docs, self.scores = k, np.zeros(0, "int64"), np.zeros(0)

    @property
    def least(self) -> float:
        """What a document must reach to enter."""
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        fine = scores >= self.least
        docs, scores = np.append(self.docs, docs[fine]), np.append(self.scores, scores[fine])
        order = np.lexsort((docs, -scores))[: self.k]
        self.docs, self.scores = docs[order], scores[order]


def _score_blocks(queries: list[tuple], boosts: Sequence[float], avgdl: Sequence[float], k: int):
    """Best documents of every query over the batches of a task.

    A block is ``BLOCK_DOCS`` documents of a batch at most: its postings are grouped by term, with
    the term's highest impact. A query whose highest impacts do not add up to its k-th score so far
    passes the block over; the bound carries the same rounding as the scores.
    """
    def apply(batches):
        best = [_Best(k) for _ in queries]
        for b in (b.slice(at, BLOCK_DOCS) for b in batches for at in range(0, b.num_rows, BLOCK_DOCS)):
            docs, blocks = b.column("doc").to_numpy(), []
            for i, mean in enumerate(avgdl):
                lists = b.column(f"t{i}")
                term, tf = lists.flatten().to_numpy(), b.column(f"f{i}").flatten().to_numpy()
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())
                dl = pc.fill_null(b.column(f"dl{i}"), 0).to_numpy()
                impact = tf / (tf + K1 * (1 - B + B * dl[row] / mean))
                order = np.argsort(term, kind="stable")
                term, row, impact = term[order], row[order], impact[order]
                first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, int)
                top = np.maximum.reduceat(impact, first) if len(first) else impact
                blocks.append((term[first], np.append(first, len(term)), row, impact, top))
            for (_, per_field), own in zip(queries, best):
                score = np.zeros(len(docs))
                for (terms, weights), (have, starts, row, impact, top), boost in zip(per_field, blocks, boosts):
                    at = np.searchsorted(have, terms)
                    fine = at < len(have)
                    fine[fine] = have[at[fine]] == terms[fine]
                    at, w = at[fine], weights[fine]
                    if not len(at) or boost * np.round((w * top[at]).sum() + 1e-9, 9) < own.least:
                        continue
                    part = np.zeros(len(docs))
                    for a, weight in zip(at, w):
                        hit = slice(starts[a], starts[a + 1])
                        part[row[hit]] += weight * impact[hit]
                    score = np.maximum(score, boost * np.round(part, 9))
                hits = np.flatnonzero(score > 0)
                own.add(docs[hits], score[hits])
        ids = [q for (q, _), own in zip(queries, best) for _ in own.docs]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([o.docs for o in best]), pa.int64()),
                                          pa.array(np.concatenate([o.scores for o in best]), pa.float64())], names=["query", "doc", "score"])

    return apply


def lexical_top(docs: DataFrame, queries: DataFrame, doc: str, fields: dict[str, float], query: str, text: str, k: int, batch: int = QUERY_BATCH) -> DataFrame:
    """Exact best k documents of every query by BM25: ``query``, ``doc``, ``score``, ``rank``.

    A document's score is that of its best boosted field; documents that share no term with a
    query are no hits. ``batch`` queries at a time travel with the tasks, and more run as further
    passes. A pass tokenises every text once and writes the counts of the asked terms; scoring
    reads these, and a task returns k rows a query at most, however many documents match.
    """
    qs = queries.select(F.col(query).cast("long").alias("query"), tokens(F.col(text)).alias("ts")).where("query is not null")
    qs = ordered(qs, [], ["query"]).df
    names, boosts, out = list(fields), [float(v) for v in fields.values()], None
    for i in range((qs.count() + batch - 1) // batch):
        some = [(r["query"], r["ts"] or []) for r in qs.where(F.expr(f"{G} div {batch} = {i}")).select("query", "ts").collect()]  # ``batch`` rows
        terms = sorted({t for _, ts in some for t in ts})
        number = {t: j for j, t in enumerate(terms)}
        with small_arrow_batches(docs.sparkSession, TEXT_ROWS, TEXT_BYTES):
            posts = written(_postings(docs, doc, names, terms), "postings")
        stats = posts.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"dl{j}").alias(f"a{j}") for j in range(len(names))]).first()
        idf = []
        for j in range(len(names)):  # one row for each asked term
            df = np.zeros(len(terms))
            for r in posts.select(F.explode(f"t{j}").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
                df[r["t"]] = r["df"]
            idf.append(np.log(1 + (stats["n"] - df + 0.5) / (df + 0.5)))
        asked = []
        for q, ts in some:
            ids, n = np.unique(np.array([number[t] for t in ts], "int64"), return_counts=True)
            asked.append((q, [(ids, f[ids] * n) for f in idf]))
        mean = [stats[f"a{j}"] or 1.0 for j in range(len(names))]
        hits = top_k(posts.mapInArrow(_score_blocks(asked, boosts, mean, k), "query long, doc long, score double"), k)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return docs.sparkSession.createDataFrame([], "query long, doc long, score double, rank int")
    return out


def top_k(scores: DataFrame, k: int, by: str = "query") -> DataFrame:
    """Best k per query, ties to the lower document; tasks keep k rows before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(vectors: DataFrame, queries: DataFrame, doc: str, vec: str, query: str, qvec: str, k: int, batch: int = QUERY_BATCH) -> DataFrame:
    """Exact k nearest by cosine.

    At most ``batch`` query vectors travel with the tasks; more queries run as further passes.
    Each Arrow batch of vectors is one matrix product and keeps its k best rows per query.
    """
    qs = ordered(queries.select(F.col(query).cast("long").alias("query"), F.col(qvec).alias("qv")), [], ["query"]).df
    passes = (qs.count() + batch - 1) // batch
    base = vectors.select(F.col(doc).cast("long").alias("doc"), F.col(vec).alias("v")).where("v is not null")
    out = None
    for i in range(passes):
        some = qs.where(F.expr(f"{G} div {batch} = {i}")).select("query", "qv").collect()  # at most ``batch`` rows
        ids = np.array([r["query"] for r in some], dtype=np.int64)
        unit = _unit(np.array([r["qv"] for r in some], dtype=np.float64))
        hits = top_k(base.mapInArrow(_nearest(ids, unit, k), "query long, doc long, score double"), k)
        out = hits if out is None else out.unionByName(hits)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)


def _nearest(ids: np.ndarray, unit: np.ndarray, k: int):
    def apply(batches):
        for b in batches:
            if not b.num_rows:
                continue
            docs = b.column(0).to_numpy(zero_copy_only=False)
            vecs = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            score = np.round(_unit(vecs) @ unit.T, 9)
            rows, cols = [], []
            for j in range(len(ids)):
                good = np.flatnonzero(~np.isnan(score[:, j]))
                best = good[np.lexsort((docs[good], -score[good, j]))[:k]]
                rows.append(best)
                cols.append(np.full(len(best), j))
            at, q = np.concatenate(rows), np.concatenate(cols)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[q]), pa.array(docs[at].astype(np.int64)), pa.array(score[at, q])], names=["query", "doc", "score"])

    return apply


def min_max(scores: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 inside each query; a single value becomes 1."""
    span = scores.groupBy("query").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    d = salted_lookup(scores, span, ["query"], F.col("doc"))
    unit = F.coalesce((F.col("score") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(1.0))
    return d.withColumn("score", unit).drop("_lo", "_hi")


def hybrid(lex: DataFrame, vec: DataFrame, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Weighted mean of normalised lexical and vector scores; a missing side counts 0."""
    a = min_max(lex.select("query", "doc", "score")).withColumnRenamed("score", "_a")
    b = min_max(vec.select("query", "doc", "score")).withColumnRenamed("score", "_b")
    d = a.join(b, ["query", "doc"], "full")
    total = F.coalesce("_a", F.lit(0.0)) * weights[0] + F.coalesce("_b", F.lit(0.0)) * weights[1]
    return d.select("query", "doc", (total / sum(weights)).alias("score"))


def entity_filter(col: str, phrases: Sequence[str]) -> Column:
    """All phrases must occur in the entity text."""
    cond = F.lit(True)
    for p in phrases:
        cond = cond & F.col(col).contains(p)
    return cond


def context(hits: DataFrame, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Hit texts of each query under numbered headings, best first."""
    d = hits.join(docs.select(F.col(doc).alias("doc"), F.col(text).alias("_t")), "doc")
    d = assemble(d, ["query"], ["rank"], F.col("_t"))
    block = F.transform("items", lambda t, i: F.concat(F.lit("Document "), (F.col("first") + i + 1).cast("string"), F.lit(":\n"), t))
    return d.select("query", "part", F.array_join(block, "\n\n").alias("context"))
