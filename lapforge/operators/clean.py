"""Filters and cleaning of position and sensor rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.functions.geo import haversine, hypot
from lapforge.operators.chains import run_rule, spaced
from lapforge.operators.ordered import G, Ordered
from lapforge.session import by_key, fits_broadcast, written

SALTS = 16
HOT_ROWS = 1_000_000


def salted_lookup(df: DataFrame, side: DataFrame, on: Sequence[str], by: Column, how: str = "left",
                  salts: int = SALTS, selective: bool = False) -> DataFrame:
    """Join ``side`` onto rows of which one key may hold a large share.

    A side within the broadcast threshold in memory is left to the optimiser, which broadcasts it,
    so skew does not matter. Otherwise it is never broadcast, rows of a key spread over ``salts``
    join partitions and the side is repeated that often. ``selective`` suits a side about as
    large as ``df``: keys are counted first and only those above ``HOT_ROWS`` are salted.
    """
    if fits_broadcast(side):
        return df.join(side, list(on), how)
    salt, every = F.pmod(F.hash(by), F.lit(salts)), F.sequence(F.lit(0), F.lit(salts - 1))
    if selective:
        limit = int(df.sparkSession.conf.get("spark.lapforge.hotRows", str(HOT_ROWS)))
        hot = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*on, F.lit(True).alias("_hot"))
        hot = written(hot, "hot")  # at most rows / limit keys
        if not hot.limit(1).count():
            return df.join(by_key(side), list(on), how)
        df = df.join(hot, list(on), "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
        side = side.join(hot, list(on), "left").withColumn(
            "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    else:
        df, side = df.withColumn("_salt", salt), side.withColumn("_salt", F.explode(every))
    return df.join(by_key(side), [*on, "_salt"], how).drop("_salt")


def time_slice(df: DataFrame, windows: DataFrame, keys: Sequence[str], t: str, lo: str, hi: str,
               by: Column) -> DataFrame:
    """Rows inside their session's [lo, hi], clock rebased to the window start."""
    cut = salted_lookup(df, windows, keys, by, "inner")
    return cut.where(F.col(t).between(F.col(lo), F.col(hi))).withColumn(t, F.col(t) - F.col(lo)).drop(lo, hi)


def drop_sentinels(df: DataFrame, minus_one: Sequence[str], required: Sequence[str],
                   accuracy: str, max_accuracy: float) -> DataFrame:
    """-1 means unknown; rows without a position or with a poor fix go."""
    d = df.withColumns({c: F.nullif(F.col(c), F.lit(-1).cast(df.schema[c].dataType)) for c in minus_one})
    return d.dropna(subset=list(required)).where(F.col(accuracy) <= max_accuracy)


def _implied(lat: str, lon: str, t: str, other: str) -> Column:
    dist = haversine(f"{other}_lat", f"{other}_lon", lat, lon)
    dt = F.greatest(F.abs(F.col(t) - F.col(f"{other}_t")), F.lit(0.01))
    return dist / dt


def drop_jumps(o: Ordered, vmax: float, lat="lat", lon="lon", t="t") -> Ordered:
    """Drop rows whose speed implied from the raw previous row exceeds ``vmax``."""
    o = o.lag(a_lat=lat, a_lon=lon, a_t=t).where(
        F.col("a_t").isNull() | (_implied(lat, lon, t, "a") <= vmax)
    )
    return o.map(lambda d: d.drop("a_lat", "a_lon", "a_t"))


def drop_two_sided_jumps(o: Ordered, vmax: float, accuracy: str, reject_at: float,
                         lat="lat", lon="lon", t="t") -> Ordered:
    """Reject poor fixes, and rows too fast both from the previous and to the next row."""
    o = o.over(
        {
            "a_lat": lambda w: F.lag(lat).over(w), "a_lon": lambda w: F.lag(lon).over(w),
            "a_t": lambda w: F.lag(t).over(w), "z_lat": lambda w: F.lead(lat).over(w),
            "z_lon": lambda w: F.lead(lon).over(w), "z_t": lambda w: F.lead(t).over(w),
        },
        before=1, after=1,
    )
    bad = F.coalesce(_implied(lat, lon, t, "a") > vmax, F.lit(False)) & F.coalesce(
        _implied(lat, lon, t, "z") > vmax, F.lit(False))
    o = o.where(~bad & (F.col(accuracy) < reject_at))
    return o.map(lambda d: d.drop("a_lat", "a_lon", "a_t", "z_lat", "z_lon", "z_t"))


def drop_outlier_segments(o: Ordered, worst: int, max_gap: float, vmin: float, vmax: float,
                          amax: float, x="e", y="n", t="t") -> Ordered:
    """Remove each session's ``worst`` longest steps, then rows breaking gap, speed or
    acceleration limits on the re-linked rows. The first two rows always stay."""
    o = o.lag(px=x, py=y).cols(seg=hypot(F.col(x) - F.col("px"), F.col(y) - F.col("py"))).cut()
    far = _worst(o, worst)
    kept = Ordered(o.df.join(far, [*o.keys, G], "left_anti"), o.keys, o.rows).map(
        lambda d: d.drop("px", "py", "seg")).renumber().position("_i")
    dt, seg = F.col("dt"), F.col("seg")
    kept = kept.over(
        {"dt": lambda w: F.col(t) - F.lag(t).over(w),
         "seg": lambda w: hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))},
        {"v": lambda w: seg / F.nullif(dt, F.lit(0.0))},
        {"acc": lambda w: (F.col("v") - F.lag("v").over(w)) / F.nullif(F.lag("dt").over(w), F.lit(0.0))},
        before=2,
    )
    fine = (dt <= max_gap) & (F.col("v") < vmax) & (F.col("v") > vmin) & (
        F.col("acc").isNull() | (F.abs("acc") < amax))
    return kept.where(F.coalesce(fine, F.lit(False)) | (F.col("_i") < 2)).map(
        lambda d: d.drop("dt", "seg", "v", "acc", "_i"))


def _worst(o: Ordered, k: int) -> DataFrame:
    """Keys and positions of the k longest steps (per-task limits apply before the shuffle)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*o.keys).orderBy(F.desc_nulls_last("seg"), G)
    d = o.df.where("seg is not null").select(*o.keys, G, "seg")
    return d.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select(*o.keys, G)


def drop_backward_times(o: Ordered, t: str) -> Ordered:
    """Keep a row only if its clock is ahead of the raw previous row (first row stays)."""
    return o.lag(_pt=t).where(F.col("_pt").isNull() | (F.col(t) > F.col("_pt"))).map(
        lambda d: d.drop("_pt"))


def repair_times(o: Ordered, t: str, step: float, name: str) -> Ordered:
    """Smallest strictly increasing clock at or above ``t``: max(t, previous + step)."""
    o = o.position("_i").cols(_s=F.col(t) - F.col("_i") * step).running(_m=("max", "_s"))
    return o.cols(**{name: F.col("_m") + F.col("_i") * step}).map(lambda d: d.drop("_i", "_s", "_m"))


def distinct_points(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per coordinate key, the earliest by ``order`` (combined map-side)."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(*keys, "_r.*")


def decimate(o: Ordered, hz: float, t: str = "t") -> Ordered:
    """Keep a row once at least 1/hz has passed since the last kept row."""
    return run_rule(o, spaced(t, 1.0 / hz, strict=False)).where("_keep").map(lambda d: d.drop("_keep"))


def every_nth(o: Ordered, n: int) -> Ordered:
    return o.position("_i").where(F.col("_i") % n == 0).map(lambda d: d.drop("_i"))


def density_gate(df: DataFrame, keys: Sequence[str], x: str, y: str, cell: float, share: float,
                 laps: DataFrame, by: Column) -> DataFrame:
    """Points whose cell is visited at least max(2, share * laps) times."""
    d = df.withColumns({"_cx": F.floor(F.col(x) / cell), "_cy": F.floor(F.col(y) / cell)})
    cells = d.groupBy(*keys, "_cx", "_cy").agg(F.count(F.lit(1)).alias("visits"))
    cells = cells.join(laps, list(keys)).where(
        F.col("visits") >= F.greatest(F.lit(2.0), share * F.col("laps")))
    return salted_lookup(d, cells, [*keys, "_cx", "_cy"], by, "inner").drop("_cx", "_cy", "laps")


def sharp_angles(o: Ordered, x: str = "e", y: str = "n") -> Ordered:
    """Distance to the previous point and turn angle (degrees) at each point."""
    o = o.over(
        {"_ax": lambda w: F.col(x) - F.lag(x).over(w), "_ay": lambda w: F.col(y) - F.lag(y).over(w),
         "_bx": lambda w: F.lead(x).over(w) - F.col(x), "_by": lambda w: F.lead(y).over(w) - F.col(y)},
        before=1, after=1,
    )
    la, lb = hypot("_ax", "_ay"), hypot("_bx", "_by")
    dot = F.col("_ax") * F.col("_bx") + F.col("_ay") * F.col("_by")
    cos = F.when((la > 0) & (lb > 0), dot / (la * lb))
    return o.cols(gap=la, angle=F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))).map(
        lambda d: d.drop("_ax", "_ay", "_bx", "_by"))
