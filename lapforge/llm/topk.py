"""Exact top-k inner products: a ball tree per shard, searched by branch and bound."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.session import written

K = 10
SHARD_ROWS = 8192
LEAF_ROWS = 64
QUERY_ROWS = 512


class BallTree:
    """Balls around the rows of ``x`` (int64); node 0 is the root, leaves own a slice of ``order``."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.x, self.order = x, np.arange(len(x))
        self.centre, self.radius, self.slice, self.kids = [], [], [], []
        self._build(0, len(x), x.astype("float64"), leaf_rows)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.reach = np.linalg.norm(self.centre, axis=1) + self.radius

    def _build(self, lo: int, hi: int, f: np.ndarray, leaf_rows: int) -> None:
        todo = [(lo, hi, -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            rows = f[self.order[lo:hi]]
            centre = rows.mean(axis=0)
            away = np.linalg.norm(rows - centre, axis=1)
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(away.max())
            self.slice.append((lo, hi))
            self.kids.append([-1, -1])
            if parent >= 0:
                self.kids[parent][side] = node
            if hi - lo <= leaf_rows or away.max() == 0:
                continue
            one = rows[away.argmax()]
            two = rows[np.linalg.norm(rows - one, axis=1).argmax()]
            sort = np.argsort(rows @ (one - two), kind="stable")
            self.order[lo:hi] = self.order[lo:hi][sort]
            mid = (lo + hi) // 2
            todo += [(lo, mid, node, 0), (mid, hi, node, 1)]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No row below a node has a larger inner product with ``q``; the slack covers rounding."""
        f = q.astype("float64")
        size = np.linalg.norm(f)
        return self.centre @ f + size * self.radius + 1e-9 * size * self.reach + 1e-6

    def search(self, q: np.ndarray, own: int, ids: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """Best ``k`` (score, id) but for ``own``, ties to the smaller id. Rows that score under
        ``floor``, a kth score known from elsewhere, need not be found."""
        bound = self.bounds(q)
        best: list[tuple[int, int]] = []
        open_ = [(-bound[0], 0)]
        while open_:
            b, node = heappop(open_)
            if -b < floor:
                break
            left, right = self.kids[node]
            if left >= 0:
                for kid in (left, right):
                    if bound[kid] >= floor:
                        heappush(open_, (-bound[kid], kid))
                continue
            rows = self.order[slice(*self.slice[node])]
            scores = self.x[rows] @ q
            good = scores >= floor
            best += [(-int(s), int(i)) for s, i in zip(scores[good], ids[rows[good]]) if i != own]
            best.sort()
            del best[k:]
            if len(best) == k:
                floor = max(floor, -best[-1][0])
        return [(-s, i) for s, i in best]


def _searcher(k: int):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        rows, queries, out = cell[~cell["asks"]], cell[cell["asks"]], []
        if len(rows) and len(queries):
            tree, ids = BallTree(np.stack(rows["v"].to_numpy()).astype("int64")), rows["id"].to_numpy()
            for query, q, floor in zip(queries["id"], queries["v"], queries["floor"]):
                out += [(query, i, s) for s, i in tree.search(np.asarray(q, dtype="int64"), query, ids, k, floor)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def integer_vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id`` and ``v`` = floor(scale * x) of the usable vectors, one for each id.

    A vector that is null or holds a null or non-finite component takes no part, nor does a null
    id. Of different vectors with one id the smallest counts.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return good.select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` largest integer inner products.

    Both sides have ``vec_id`` and ``v``. A row is never its own query's result, ties go to the
    smaller id, and vectors of another length than the query's are not compared. Rows and queries
    are dealt by hash into shards and blocks of bounded size, and a cell (shard, block) is one
    task's group. Every block first searches one shard; the kth score it finds there is handed to
    the searches of all other shards as their starting bound.
    """
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    v = vectors.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"))
    q = queries.select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).alias("block"))
    home = F.pmod(F.col("block"), F.lit(shards))
    cells = ["dim", "shard", "block"]
    low = F.lit(float("-inf"))

    def search(rows: DataFrame, asked: DataFrame) -> DataFrame:
        rows = rows.select(*cells, F.col("vec_id").alias("id"), "v", low.alias("floor"), F.lit(False).alias("asks"))
        asked = asked.select(*cells, F.col("query_id").alias("id"), "v", "floor", F.lit(True).alias("asks"))
        return rows.unionByName(asked).groupBy(*cells).applyInPandas(_searcher(k), "query_id long, vec_id long, score long")

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    spread = v.withColumn("block", every(blocks))
    first = written(search(spread.where(F.col("shard") == home), q.withColumns({"shard": home, "floor": low})), "first")
    kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
    q = q.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", low))
    q = q.withColumn("shard", every(shards))
    rest = search(spread.where(F.col("shard") != home), q.where(F.col("shard") != home))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
