"""Density clustering of points, exact and without listing the pairs of a crowded place.

Points fall into cells so small that all points of one cell are neighbours. A cell with enough
points is core as a whole, so only thin cells count neighbours, and a thin cell holds fewer than
``min_pts`` points. Two core cells are joined when some pair of their points is near enough;
that is decided on bounding boxes, split further only while a box pair is undecided.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.operators.clean import HOT_ROWS, salted_lookup
from lapforge.session import by_key, written


def _around(half: bool = False, own: bool = False):
    near = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if own or (i, j) != (0, 0)]
    near = [p for p in near if p > (0, 0)] if half else near
    return F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in near]))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node id of each connected component.

    Every round joins label groups to their smallest neighbour and shortens the pointers, so the
    number of rounds grows with the logarithm of a chain's length. Tables of too few rows for a hot
    key are joined without looking for one.
    """
    limit = int(nodes.sparkSession.conf.get("spark.lapforge.hotRows", str(HOT_ROWS)))
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(nodes.select("node", F.col("node").alias("label")), "labels")
    plain = lambda df, side, on, by, how="left": df.join(by_key(side), on, how)
    salted = lambda df, side, on, by, how="left": salted_lookup(df, side, on, by, how, selective=True)
    edge_lookup, node_lookup = [salted if rows.count() > limit else plain for rows in (both, labels)]
    while True:
        seen = edge_lookup(both, labels.select(F.col("node").alias("b"), F.col("label").alias("_lb")), ["b"], F.col("a"), "inner")
        best = seen.groupBy(F.col("a").alias("node")).agg(F.min("_lb").alias("_m"))
        d = labels.join(by_key(best), "node", "left").withColumn("_m", F.least("label", "_m"))
        hook = written(d.groupBy("label").agg(F.min("_m").alias("to")), "hook")
        for _ in range(2):
            nxt = hook.select(F.col("label").alias("to"), F.col("to").alias("_t2"))
            hook = written(node_lookup(hook, nxt, ["to"], F.col("label")).select("label", F.coalesce("_t2", "to").alias("to")), "hook")
        if not hook.where("label <> to").limit(1).count():
            return labels
        labels = written(node_lookup(labels, hook, ["label"], F.col("node")).select("node", F.col("to").alias("label")), "labels")


def _near_cells(core: DataFrame, keys: Sequence[str], eps: float, side: float) -> DataFrame:
    """Pairs of core cells that hold two points at most ``eps`` apart."""
    cells = core.groupBy(*keys, "cx", "cy").agg(F.first("node").alias("node"))
    left = cells.select(*keys, F.col("node").alias("a"), "cx", "cy", _around(half=True).alias("o"))
    left = left.select(*keys, "a", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    todo = left.join(by_key(cells.withColumnRenamed("node", "b")), [*keys, "cx", "cy"]).select(
        "a", "b", F.lit(0).cast("long").alias("ax"), F.lit(0).cast("long").alias("ay"), F.lit(0).cast("long").alias("bx"), F.lit(0).cast("long").alias("by"))
    todo, found, level = written(todo, "pairs"), None, 0
    while todo.limit(1).count():
        size = side / 2**level
        sub = lambda v, c: F.floor((F.col(v) - F.col(c) * side) / size)
        busy = todo.select(F.col("a").alias("node")).unionByName(todo.select(F.col("b").alias("node"))).distinct()
        boxes = salted_lookup(core, busy, ["node"], F.hash("x", "y"), "inner", selective=True).groupBy("node", sub("x", "cx").alias("sx"), sub("y", "cy").alias("sy")).agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        boxes = written(boxes, "boxes")
        if level:
            boxes = boxes.withColumns({"ux": F.shiftright("sx", 1), "uy": F.shiftright("sy", 1)})
        else:
            boxes = boxes.withColumns({"ux": F.lit(0).cast("long"), "uy": F.lit(0).cast("long")})
        side_of = lambda s: boxes.select(
            F.col("node").alias(s), F.col("ux").alias(f"{s}x"), F.col("uy").alias(f"{s}y"), F.struct("sx", "sy", "x0", "x1", "y0", "y1").alias(f"{s}_"))
        j = todo.join(by_key(side_of("a")), ["a", "ax", "ay"]).join(by_key(side_of("b")), ["b", "bx", "by"])
        A, B = F.col("a_"), F.col("b_")
        gap = lambda lo, hi: F.greatest(F.lit(0.0), A[lo] - B[hi], B[lo] - A[hi])
        span = lambda lo, hi: F.greatest(A[hi] - B[lo], B[hi] - A[lo])
        near = F.sqrt(F.pow(gap("x0", "x1"), 2) + F.pow(gap("y0", "y1"), 2))
        far = F.sqrt(F.pow(span("x0", "x1"), 2) + F.pow(span("y0", "y1"), 2))
        j = written(j.where(near <= eps).select("a", "b", A["sx"].alias("ax"), A["sy"].alias("ay"), B["sx"].alias("bx"), B["sy"].alias("by"), (far <= eps).alias("sure")), "pairs")
        hit = j.where("sure").select("a", "b").distinct()
        found = hit if found is None else found.unionByName(hit)
        todo = written(j.where("not sure").join(by_key(hit), ["a", "b"], "left_anti").drop("sure"), "pairs")
        level += 1
    return found if found is not None else todo.select("a", "b")


def density_clusters(points: DataFrame, keys: Sequence[str], pid: str, x: str, y: str, eps: float, min_pts: int) -> DataFrame:
    """Add ``cluster``: the smallest core point id of the cluster, or -1 for noise.

    A border point near several clusters joins the one with the smallest label. ``pid`` is unique.
    """
    keys = list(keys)
    side = eps / 2**0.5 * (1 - 1e-9)
    pts = points.groupBy(*keys, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("m"), F.min(pid).alias("pid"))
    pts = pts.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    on = [*keys, "cx", "cy"]
    weight = pts.groupBy(*on).agg(F.sum("m").alias("w"))
    pts = written(salted_lookup(pts, weight, on, F.hash("pid"), selective=True), "points")

    def neighbours(thin: DataFrame, other: DataFrame, own: bool) -> DataFrame:
        """(pid of a thin-cell point, row of ``other``) at most eps apart, own cell included or not."""
        t = thin.select(*keys, F.col("pid").alias("tp"), F.col("x").alias("tx"), F.col("y").alias("ty"), "cx", "cy", _around(own=own).alias("o"))
        t = t.select(*keys, "tp", "tx", "ty", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
        j = salted_lookup(other, t, on, F.hash("pid"), "inner", selective=True)
        return j.where(F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2)) <= eps)

    thin = pts.where(F.col("w") < min_pts)
    seen = neighbours(thin, pts.select(*on, "x", "y", "m", "pid"), False).groupBy(F.col("tp").alias("pid")).agg(F.sum("m").alias("more"))
    thin = thin.join(by_key(seen), "pid", "left").withColumn("core", F.col("w") + F.coalesce("more", F.lit(0)) >= min_pts).drop("more")
    flagged = written(pts.where(F.col("w") >= min_pts).withColumn("core", F.lit(True)).unionByName(thin.select(*pts.columns, "core")), "core")
    ids = flagged.where("core").groupBy(*on).agg(F.min("pid").alias("node"))
    core = written(salted_lookup(flagged.where("core"), ids, on, F.hash("pid"), "inner", selective=True), "core")
    labels = components(ids.select("node"), _near_cells(core, keys, eps, side))
    core = salted_lookup(core, labels, ["node"], F.hash("pid"), selective=True).select(*on, "x", "y", "pid", "label")
    border = neighbours(flagged.where("not core"), core, True).groupBy(F.col("tp").alias("pid")).agg(F.min("label").alias("label"))
    rest = flagged.where("not core").join(by_key(border), "pid", "left").select(*keys, "x", "y", "label")
    named = written(core.select(*keys, "x", "y", "label").unionByName(rest), "clusters").withColumnsRenamed({"x": x, "y": y})
    return salted_lookup(points, named, [*keys, x, y], F.hash(pid), selective=True).withColumn("cluster", F.coalesce("label", F.lit(-1))).drop("label")
