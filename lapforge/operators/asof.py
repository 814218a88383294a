"""Joins of streams with different clocks: nearest, backward, interpolated, by interval."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.operators.clean import salted_lookup
from lapforge.operators.ordered import Ordered, ordered
from lapforge.session import by_key, written


def _interleave(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, rt: str, tie: str,
                cols: Sequence[str]) -> Ordered:
    """Both streams in one order; a right row sorts before a left row of the same time."""
    payload = F.struct(F.col(rt).alias("_at"), *[F.col(c) for c in cols])
    lhs = left.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"),
                      F.struct(*left.columns).alias("_l"))
    rhs = right.select(*keys, F.col(rt).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"),
                       payload.alias("_r"))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    return ordered(both, keys, ["_t", "_side", "_tie"])


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, tie: str, cols: Sequence[str],
         direction: str = "backward", tolerance: float | None = None, prefix: str = "r_",
         right_t: str | None = None) -> DataFrame:
    """Left rows with the right row at or before (backward) or nearest in time (nearest).

    Equal times match; on equal distance the earlier right row wins.
    """
    o = _interleave(left, right, keys, t, right_t or t, tie, cols)
    if direction == "backward":
        o = o.running(_p=("last", "_r"))
        hit = F.col("_p")
    else:
        o = o.running(_p=("last", "_r"), _n=("next", "_r"))
        dp, dn = F.col("_t") - F.col("_p._at"), F.col("_n._at") - F.col("_t")
        hit = F.when(F.col("_p").isNotNull() & (F.col("_n").isNull() | (dp <= dn)), F.col("_p")).otherwise(F.col("_n"))
    if tolerance is not None:
        hit = F.when(F.abs(hit["_at"] - F.col("_t")) <= tolerance, hit)
    d = o.df.where("_side = 1").withColumn("_h", hit)
    return d.select("_l.*", F.col("_h._at").alias(f"{prefix}t"), *[F.col(f"_h.{c}").alias(f"{prefix}{c}") for c in cols])


def bracket(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, tie: str, cols: Sequence[str],
            right_t: str | None = None) -> DataFrame:
    """Left columns plus the knots around each row: structs ``p`` (at or before) and ``q`` (after)."""
    o = _interleave(left, right, keys, t, right_t or t, tie, cols)
    o = o.running(p=("last", "_r"), q=("next", "_r"))
    return o.df.where("_side = 1").select("_l.*", "p", "q")


def lerp(t: Column, col: str, edge: str = "clamp") -> Column:
    """Value at ``t`` between the knots ``p`` and ``q``; outside them clamp or NULL."""
    p, q = F.col("p"), F.col("q")
    w = (t - p["_at"]) / F.nullif(q["_at"] - p["_at"], F.lit(0).cast("double"))
    mid = F.when(p["_at"] == t, p[col]).when(
        p.isNotNull() & q.isNotNull(), p[col] + (q[col] - p[col]) * F.coalesce(w, F.lit(0.0)))
    if edge == "null":
        return mid
    return F.coalesce(mid, F.when(q.isNull(), p[col]), F.when(p.isNull(), q[col]))


def interpolate(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, tie: str,
                cols: Sequence[str], edge: str = "clamp", right_t: str | None = None) -> DataFrame:
    """Linear value of right columns at the left times. ``edge``: clamp, null or extend."""
    if edge != "extend":
        d = bracket(left, right, keys, t, tie, cols, right_t)
        return d.withColumns({c: lerp(F.col(t), c, edge) for c in cols}).drop("p", "q")
    rt = right_t or t
    knots = ordered(right.select(*keys, rt, tie, *cols), keys, [rt, tie]).over(
        {f"_s_{c}": (lambda c: lambda w: F.coalesce(
            (F.lead(c).over(w) - F.col(c)) / F.nullif(F.lead(rt).over(w) - F.col(rt), F.lit(0.0)),
            (F.col(c) - F.lag(c).over(w)) / F.nullif(F.col(rt) - F.lag(rt).over(w), F.lit(0.0))))(c) for c in cols},
        before=1, after=1)
    d = bracket(left, knots.df, keys, t, tie, [*cols, *[f"_s_{c}" for c in cols]], rt)
    k = F.coalesce("p", "q")
    return d.withColumns({c: k[c] + (F.col(t) - k["_at"]) * F.coalesce(k[f"_s_{c}"], F.lit(0.0)) for c in cols}).drop("p", "q")


def interpolate_angle(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, tie: str, angle: str) -> DataFrame:
    """Angle (degrees) interpolated through the unit vector, safe at the wrap."""
    unit = right.withColumns({"_cos": F.cos(F.radians(angle)), "_sin": F.sin(F.radians(angle))})
    d = interpolate(left, unit, keys, t, tie, ["_cos", "_sin"])
    return d.withColumn(angle, F.degrees(F.atan2("_sin", "_cos"))).drop("_cos", "_sin")


def interpolate_quaternion(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, tie: str,
                           parts: Sequence[str]) -> DataFrame:
    """Component-wise lerp divided by the norm."""
    d = interpolate(left, right, keys, t, tie, parts)
    norm = F.sqrt(sum(F.col(p) * F.col(p) for p in parts))
    return d.withColumns({p: F.col(p) / F.nullif(norm, F.lit(0.0)) for p in parts})


def in_interval(samples: DataFrame, spans: DataFrame, keys: Sequence[str], t: str, tie: str, start: str,
                end: str, cols: Sequence[str]) -> DataFrame:
    """Label samples with the interval holding them, closed at both ends, later one at a shared bound."""
    d = asof(samples, spans, keys, t, tie, [end, *cols], right_t=start, prefix="_i_")
    held = F.col(t) <= F.col(f"_i_{end}")
    return d.withColumns({c: F.when(held, F.col(f"_i_{c}")) for c in cols}).drop(
        "_i_t", f"_i_{end}", *[f"_i_{c}" for c in cols])


def nearest_points(points: DataFrame, targets: DataFrame, pid: str, tid: str, x: str, y: str, cell: float) -> DataFrame:
    """Closest target of every point with its distance, exact at any spacing.

    Points meet only targets in the 3x3 cells around them. A hit no farther than one cell is
    final; the others repeat with cells four times as wide, until none is left.
    """
    todo, parts = points.select(pid, x, y), []
    while True:
        near = targets.select(tid, F.col(x).alias("_tx"), F.col(y).alias("_ty"))
        near = near.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_tx") / cell) - 1, F.floor(F.col("_tx") / cell) + 1)))
        near = near.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_ty") / cell) - 1, F.floor(F.col("_ty") / cell) + 1)))
        here = todo.withColumns({"_cx": F.floor(F.col(x) / cell), "_cy": F.floor(F.col(y) / cell)})
        pairs = salted_lookup(here, near, ["_cx", "_cy"], F.col(pid), "left")
        d2 = F.pow(F.col("_tx") - F.col(x), 2) + F.pow(F.col("_ty") - F.col(y), 2)
        best = pairs.groupBy(pid).agg(
            F.min(F.struct(d2.alias("d2"), F.col(tid).alias("target"))).alias("b"), F.first(x).alias(x), F.first(y).alias(y))
        best = written(best.withColumn("_ok", F.coalesce(F.col("b.d2") <= cell * cell, F.lit(False))), "nearest")
        parts.append(best.where("_ok").select(pid, F.col("b.target").alias(tid), F.sqrt("b.d2").alias("distance")))
        todo = best.where("not _ok").select(pid, x, y)
        if not todo.limit(1).count() or not targets.limit(1).count():
            break
        cell *= 4
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forward_nearest(rows: DataFrame, reference: DataFrame, keys: Sequence[str], walk: str, rid: str, order: str, ref: str, x: str, y: str,
                    back: int, ahead: int) -> DataFrame:
    """Match each row of a walk (a lap) to a reference point near the last match.

    Walks start at the key's first reference point; a row takes the closest of the points from
    ``back`` before the last match to below ``ahead`` after it, the first of equals. A group is
    one walk with the key's reference lap. Returns keys, ``walk``, ``rid``, ``ref`` and ``distance``;
    keys without reference points give no rows.
    """
    keys = list(keys)
    slim = rows.select(*keys, walk, F.col(order).alias("_o"), F.col(rid).alias("_id"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.lit(False).alias("_ref"))
    points = reference.select(*keys, F.col(ref).alias("_o"), F.col(ref).alias("_id"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    walks = rows.select(*keys, walk).distinct()
    copies = points.join(walks, keys).withColumn("_ref", F.lit(True))
    kinds = [f"`{c}` {rows.schema[n].dataType.simpleString()}" for c, n in (*((k, k) for k in keys), (walk, walk), (rid, rid))]

    def follow(table: pa.Table) -> pa.Table:
        table = table.sort_by("_o")
        is_ref = table.column("_ref").to_numpy(zero_copy_only=False).astype(bool)
        px, py = (np.asarray(table.column(c).to_numpy(), "float64") for c in ("_x", "_y"))
        rx, ry, gx, gy = px[is_ref], py[is_ref], px[~is_ref], py[~is_ref]
        if not len(rx):
            gx = gx[:0]
        at, hit, dist = 0, np.zeros(len(gx), "int64"), np.zeros(len(gx))
        for i in range(len(gx)):
            lo = max(0, at - back)
            d2 = (rx[lo : at + ahead] - gx[i]) ** 2 + (ry[lo : at + ahead] - gy[i]) ** 2
            at = lo + int(np.argmin(d2))
            hit[i], dist[i] = at, d2[at - lo]
        mine = table.filter(pa.array(~is_ref)).slice(0, len(gx))
        found = table.filter(pa.array(is_ref)).column("_id").take(pa.array(hit))
        return pa.table({**{c: mine.column(c) for c in (*keys, walk)}, rid: mine.column("_id"), ref: found, "distance": pa.array(np.sqrt(dist))})

    both = slim.unionByName(copies)
    return both.groupBy(*keys, walk).applyInArrow(follow, ", ".join([*kinds, f"`{ref}` {both.schema['_id'].dataType.simpleString()}", "distance double"]))


def landmark_snap(df: DataFrame, keys: Sequence[str], marks: dict[str, tuple[float, float]], x: str, y: str,
                  order: str, keep: Sequence[str]) -> DataFrame:
    """Closest sample to each fixed landmark, per key, first in order on ties."""
    spots = F.array(*[F.struct(F.lit(m).alias("landmark"), F.lit(float(a)).alias("mx"), F.lit(float(b)).alias("my"))
                      for m, (a, b) in marks.items()])
    d = df.select(*keys, x, y, order, *keep, F.explode(spots).alias("m"))
    d2 = F.pow(F.col(x) - F.col("m.mx"), 2) + F.pow(F.col(y) - F.col("m.my"), 2)
    best = d.groupBy(*keys, "m.landmark").agg(
        F.min(F.struct(d2.alias("d2"), F.col(order).alias("o"), *[F.col(c) for c in keep])).alias("b"))
    return best.select(*keys, "landmark", *[F.col(f"b.{c}") for c in keep], F.sqrt("b.d2").alias("distance"))


def zone_label(x: Column, y: Column, zones: Sequence[tuple[str, float, float, float]], slack: float = 25.0) -> Column:
    """Name of the nearest zone centre when within its radius plus ``slack``."""
    options = F.array(*[
        F.struct((F.pow(x - float(zx), 2) + F.pow(y - float(zy), 2)).alias("d2"), F.lit(float(zr)).alias("zr"), F.lit(name).alias("name"))
        for name, zx, zy, zr in zones])
    best = F.array_min(options)
    return F.when(F.sqrt(best["d2"]) <= best["zr"] + slack, best["name"])


def outline_distance(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Distance to the closest segment of a closed outline (fixed vertices)."""
    dists = []
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        dx, dy = float(bx - ax), float(by - ay)
        len2 = dx * dx + dy * dy or 1.0
        w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - float(ax)) * dx + (y - float(ay)) * dy) / len2))
        dists.append(F.sqrt(F.pow(x - (w * dx + float(ax)), 2) + F.pow(y - (w * dy + float(ay)), 2)))
    return F.least(*dists)


def fix_provenance(rows: DataFrame, fixes: DataFrame, keys: Sequence[str], t: str, tie: str, cols: Sequence[str]) -> DataFrame:
    """Positions with source and confidence: interpolated between fixes, held and decaying after
    the last one (0.05 a row down to 0.1), dropped before the first."""
    o = _interleave(rows, fixes, keys, t, t, tie, cols).running(p=("last", "_r"), q=("next", "_r"))
    o = o.where("_side = 1 and p is not null")
    past = F.when(F.col("q").isNull() & (F.col("p._at") < F.col("_t")), 1)
    o = Ordered(written(o.df.withColumn("_past", past)), keys, o.rows).renumber().running(n=("count", "_past"))
    w = (F.col("_t") - F.col("p._at")) / F.nullif(F.col("q._at") - F.col("p._at"), F.lit(0.0))
    inside = F.when(F.col("p._at") == F.col("_t"), 1.0).otherwise(1.0 - F.least(w, 1.0 - w))
    conf = F.when(F.col("_past") == 1, F.greatest(F.lit(0.1), 1.0 - 0.05 * F.col("n"))).otherwise(inside)
    source = F.when(F.col("_past") == 1, "Extrapolated").otherwise("Interpolated")
    return o.df.select("_l.*", *[lerp(F.col("_t"), c).alias(f"fix_{c}") for c in cols],
                       conf.alias("confidence"), source.alias("source"))


def first_return(df: DataFrame, keys: Sequence[str], pid: str, x: str, y: str, t: str, radius: float, min_gap: float,
                 horizon: float) -> DataFrame:
    """For each row the earliest later row nearer than ``radius`` and more than ``min_gap`` later.

    Rows meet only the 3x3 cells around them and one stretch of time: first ``horizon`` seconds
    after the gap, then twice as long for the rows still open, until their stretch passes the end
    of the key. A vehicle standing still finds its return at once, so no crowded cell is compared
    with itself beyond the stretch.
    """
    keys = list(keys)
    d = df.select(*keys, F.col(pid).alias("pid"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(t).alias("t"))
    d = written(d.withColumns({"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)}), "points")
    ends = d.groupBy(*keys).agg(F.max("t").alias("_end"))
    todo = written(salted_lookup(d, ends, keys, F.col("pid")).withColumn("lo", F.col("t") + min_gap), "open")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    found = None
    while True:
        todo = todo.where(F.col("lo") < F.col("_end"))
        slot = lambda c: F.floor(F.col(c) / horizon)
        ask = todo.select(*keys, "pid", F.col("x").alias("px"), F.col("y").alias("py"), "lo", "cx", "cy", around.alias("o"))
        ask = ask.withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j"), "hi": F.col("lo") + horizon})
        ask = ask.withColumn("slot", F.explode(F.array_distinct(F.array(slot("lo"), slot("hi"))))).drop("o")
        have = d.select(*keys, "cx", "cy", slot("t").alias("slot"), F.col("pid").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("t").alias("ot"))
        j = salted_lookup(ask, have, [*keys, "cx", "cy", "slot"], F.col("pid"), "inner", selective=True)
        j = j.where((F.col("ot") > F.col("lo")) & (F.col("ot") <= F.col("hi")))
        j = j.where(F.sqrt(F.pow(F.col("px") - F.col("ox"), 2) + F.pow(F.col("py") - F.col("oy"), 2)) < radius)
        hit = written(j.groupBy("pid").agg(F.min(F.struct("ot", "other")).alias("b")).select("pid", "b.other", "b.ot"), "returns")
        found = hit if found is None else found.unionByName(hit)
        todo = written(todo.join(by_key(hit.select("pid")), "pid", "left_anti").withColumn("lo", F.col("lo") + horizon), "open")
        if not todo.where(F.col("lo") < F.col("_end")).limit(1).count():
            return found.withColumnsRenamed({"pid": pid, "other": "return_id", "ot": "return_t"})
        horizon *= 2
