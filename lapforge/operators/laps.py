"""Lap-level operators: splits, reference laps, deltas, opportunity, ideal lap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.operators.asof import interpolate
from lapforge.operators.clean import salted_lookup
from lapforge.operators.resample import fraction_grid
from lapforge.operators.stats import pace_pack


def fraction_splits(trace: DataFrame, keys: Sequence[str], frac: str, t: str, tie: str, at: Sequence[float]) -> DataFrame:
    """Sector times of each lap from the interpolated clock at fixed lap fractions."""
    spans = trace.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_z"))
    marks = F.array(*[F.struct(F.lit(i).cast("long").alias("m"), F.lit(float(f)).alias("f")) for i, f in enumerate(at)])
    grid = spans.select(*keys, F.explode(marks).alias("x")).select(*keys, F.col("x.f").alias(frac), F.col("x.m").alias(tie))
    d = interpolate(grid, trace, keys, frac, tie, [t])
    wide = d.groupBy(*keys).agg(*[F.max(F.when(F.col(tie) == i, F.col(t))).alias(f"_s{i}") for i in range(len(at))])
    d = spans.join(wide, list(keys))
    marks_ = [F.col("_a"), *[F.col(f"_s{i}") for i in range(len(at))], F.col("_z")]
    valid = F.lit(True)
    for a, b in zip(marks_, marks_[1:]):
        valid = valid & (a < b)
    out = {f"sector_{i + 1}": b - a for i, (a, b) in enumerate(zip(marks_, marks_[1:]))}
    return d.withColumns({"lap_time": F.col("_z") - F.col("_a"), "sectors_valid": F.coalesce(valid, F.lit(False)), **out}).drop(
        "_a", "_z", *[f"_s{i}" for i in range(len(at))])


def incident_laps(laps: DataFrame, keys: Sequence[str], factor: float = 1.05) -> DataFrame:
    """Laps slower than ``factor`` times the key's best, with the time lost."""
    best = laps.groupBy(*keys).agg(F.min("lap_time").alias("best"))
    d = salted_lookup(laps, best, keys, F.col("lap"))
    return d.where(F.col("lap_time") > factor * F.col("best")).withColumn("lost", F.col("lap_time") - F.col("best"))


def reference_lap(laps: DataFrame, keys: Sequence[str], valid: str = "sectors_valid") -> DataFrame:
    """Fastest lap with valid sectors, else the fastest lap."""
    order = F.struct(~F.col(valid), F.col("lap_time"), F.col("lap"))
    return laps.groupBy(*keys).agg(F.min_by(F.struct("lap", "lap_time"), order).alias("b")).select(
        *keys, F.col("b.lap").alias("ref_lap"), F.col("b.lap_time").alias("ref_time"))


def delta_to_reference(trace: DataFrame, refs: DataFrame, keys: Sequence[str], frac: str, clock: str, tie: str, points: int) -> DataFrame:
    """Time difference to the reference lap at equal lap fractions."""
    g = fraction_grid(trace, [*keys, "lap"], frac, tie, [clock], points)
    tagged = salted_lookup(g, refs, keys, F.col("grid"), "inner")
    ref = tagged.where("lap = ref_lap").select(*keys, "grid", F.col(clock).alias("_ref"))
    return salted_lookup(g, ref, [*keys, "grid"], F.col("lap"), "inner").withColumn("delta", F.col(clock) - F.col("_ref")).drop("_ref")


def opportunity(sectors: DataFrame, keys: Sequence[str], clean: str) -> DataFrame:
    """Per sector (mean - best) + (p90 - p50) on clean laps, all laps where none is clean."""
    has = sectors.groupBy(*keys, "sector").agg(F.max(F.col(clean).cast("int")).alias("_any"))
    d = salted_lookup(sectors, has, [*keys, "sector"], F.col("lap")).where(F.col(clean) | (F.col("_any") == 0)).drop("_any")
    p = pace_pack(d, [*keys, "sector"], "duration")
    return p.withColumns({"mean_loss": F.col("mean") - F.col("best"), "spread": F.col("p90") - F.col("p50")}).withColumn(
        "opportunity", F.col("mean_loss") + F.col("spread"))


def ideal_lap(sectors: DataFrame, keys: Sequence[str], splits: Sequence[float], points: int) -> DataFrame:
    """Ideal clock on equal fractions: piecewise linear through the best clean sector times."""
    n = len(splits) + 1
    best = sectors.groupBy(*keys).agg(*[F.min(F.when(F.col("sector") == i + 1, F.col("duration"))).alias(f"_b{i}") for i in range(n)])
    fs, total = [0.0, *splits, 1.0], F.lit(0.0)
    marks = [F.lit(0.0)]
    for i in range(n):
        total = total + F.col(f"_b{i}")
        marks.append(total)
    d = best.select(*best.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("grid"))
    f = F.col("grid") / F.lit(float(points - 1))
    t = marks[-1]
    for i in reversed(range(n)):
        t = F.when(f <= fs[i + 1], marks[i] + (marks[i + 1] - marks[i]) * (f - fs[i]) / (fs[i + 1] - fs[i])).otherwise(t)
    return d.select(*keys, "grid", t.alias("ideal_t"), marks[-1].alias("ideal_time"))


def boundary_slices(trace: DataFrame, keys: Sequence[str], clock: str, order: str, slices: int) -> DataFrame:
    """Per lap and time slice, the samples nearest to and farthest from the slice's mean longitude."""
    span = trace.groupBy(*keys).agg(F.max(clock).alias("_span"))
    d = salted_lookup(trace, span, keys, F.col(order), "inner").where(F.col("_span") > 0)
    d = d.withColumn("slice", F.floor(F.col(clock) / (F.col("_span") / slices))).where(F.col("slice") < slices)
    mean = d.groupBy(*keys, "slice").agg(F.avg("lon").alias("_mid"))
    d = salted_lookup(d, mean, [*keys, "slice"], F.col(order)).withColumn("_off", F.abs(F.col("lon") - F.col("_mid")))
    return d.groupBy(*keys, "slice").agg(
        F.min_by(order, F.struct("_off", order)).alias("left"), F.max_by(order, F.struct("_off", order)).alias("right"))


def centre_line(points: DataFrame, keys: Sequence[str], side: str, x: str, y: str, tie: str) -> DataFrame:
    """Midpoints of inner and outer traces paired by rank of the angle about the common centroid.

    The longer trace is thinned to the shorter one's length by scaled rank.
    """
    from lapforge.operators.ordered import ordered

    mid = points.groupBy(*keys).agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy")) if keys else None
    d = salted_lookup(points, mid, keys, F.col(tie))
    d = d.withColumn("_ang", F.atan2(F.col(x) - F.col("_cx"), F.col(y) - F.col("_cy")))
    o = ordered(d, [*keys, side], ["_ang", tie]).position("_r").totals(_n=F.count(F.lit(1)))
    sizes = o.df.groupBy(*keys, side).agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(F.min("_c").alias("_m"))
    d = salted_lookup(o.df, sizes, keys, F.col(tie))
    # Rank r of the shorter trace meets rank floor(r * (n - 1) / (m - 1)) of the longer one.
    n1, m1 = F.col("_n") - 1, F.greatest(F.col("_m") - 1, F.lit(1))
    slot = F.ceil(F.col("_r") * m1 / F.greatest(n1, F.lit(1)))
    hit = F.floor(slot * n1 / m1) == F.col("_r")
    d = d.where(hit).withColumn("slot", slot)
    one = d.where(F.col(side) == 0).select(*keys, "slot", F.col(x).alias("_ax"), F.col(y).alias("_ay"))
    two = d.where(F.col(side) == 1).select(*keys, "slot", F.col(x).alias("_bx"), F.col(y).alias("_by"))
    j = one.join(two, [*keys, "slot"])
    return j.select(*keys, "slot", ((F.col("_ax") + F.col("_bx")) / 2).alias(x), ((F.col("_ay") + F.col("_by")) / 2).alias(y))
