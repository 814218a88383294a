"""Pace, consistency, rate and agreement statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.operators.ordered import G, Ordered, ordered, quantiles


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation of complete pairs; NULL when either side is constant."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def pace_pack(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """n, best, mean, std (sample, 0 for one value), cv, median, p50 and p90 per key."""
    std = F.coalesce(F.stddev_samp(col), F.lit(0.0))
    base = df.where(F.col(col).isNotNull()).groupBy(*keys).agg(
        F.count(col).alias("n"), F.min(col).alias("best"), F.avg(col).alias("mean"), std.alias("std"))
    q = quantiles(df, keys, [col], {"p50": 0.5, "p90": 0.9})
    d = base.join(q, list(keys)).withColumnsRenamed({f"{col}_p50": "p50", f"{col}_p90": "p90"})
    return d.withColumns({"median": F.col("p50"), "cv": F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))})


def consistency(sheets: DataFrame, keys: Sequence[str], laps: str) -> DataFrame:
    """n, mean, std, cv of a lap-time array per sheet; NULL laps are ignored."""
    d = sheets.select(*keys, F.explode_outer(laps).alias("x"))
    std = F.coalesce(F.stddev_samp("x"), F.lit(0.0))
    return d.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), std.alias("std"),
                                (std / F.nullif(F.avg("x"), F.lit(0.0))).alias("cv"))


def sector_times(df: DataFrame, keys: Sequence[str], lap: str, sector: str, t: str) -> DataFrame:
    return df.groupBy(*keys, lap, sector).agg(
        F.min(t).alias("t_in"), F.max(t).alias("t_out"), (F.max(t) - F.min(t)).alias("duration"))


def sector_bests(sectors: DataFrame, keys: Sequence[str], lap: str = "lap", sector: str = "sector") -> DataFrame:
    """Best time per sector and the first lap that set it."""
    return sectors.groupBy(*keys, sector).agg(
        F.min("duration").alias("best"), F.min_by(lap, F.struct("duration", lap)).alias("best_lap"))


def theoretical_best(sectors: DataFrame, laps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of best sectors, best actual lap and the gap between them."""
    ideal = sector_bests(sectors, keys).groupBy(*keys).agg(F.sum("best").alias("theoretical"))
    actual = laps.groupBy(*keys).agg(F.min("lap_time").alias("actual"))
    d = ideal.join(actual, list(keys), "left") if keys else ideal.join(actual)
    return d.withColumn("gap", F.col("actual") - F.col("theoretical"))


def complete_laps(sectors: DataFrame, keys: Sequence[str], n_sectors: int) -> DataFrame:
    """Laps that have every sector, with their time."""
    return sectors.groupBy(*keys, "lap").agg(
        F.countDistinct("sector").alias("k"), F.sum("duration").alias("lap_time")
    ).where(F.col("k") == n_sectors).drop("k")


def rate_profile(o: Ordered, t: str) -> DataFrame:
    """Sampling interval and frequency statistics per key, with duplicate ratio."""
    o = o.lag(_pt=t).cols(dt=F.col(t) - F.col("_pt"))
    o = o.cols(hz=F.when(F.col("dt") > 0, 1 / F.col("dt")))
    d = o.df.groupBy(*o.keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(t).alias("n_distinct"), F.avg("dt").alias("mean_interval"),
        F.avg("hz").alias("mean_hz"), F.min("hz").alias("min_hz"), F.max("hz").alias("max_hz"), F.stddev_samp("hz").alias("std_hz"))
    q = quantiles(o.df, o.keys, ["dt", "hz"], {"median": 0.5})
    return d.join(q, o.keys).withColumn("duplicate_ratio", 1 - F.col("n_distinct") / F.col("n"))


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """min, max, mean, population std and median of each numeric column, one row per column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")).select("x.*")
    base = long.groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
                                      F.stddev_pop("value").alias("std"))
    return base.join(quantiles(long, ["column"], ["value"], {"median": 0.5}), "column").withColumnRenamed("value_median", "median")


def weighted_line(df: DataFrame, keys: Sequence[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted least squares y = a x + b with the weighted correlation, from five sums.

    Sums are taken around the weighted means so that large clocks keep their digits.
    """
    X, Y, Wt = F.col(x), F.col(y), F.col(w)
    means = df.groupBy(*keys).agg((F.sum(Wt * X) / F.sum(Wt)).alias("_mx"), (F.sum(Wt * Y) / F.sum(Wt)).alias("_my"))
    d = df.join(means, list(keys))
    dx, dy = X - F.col("_mx"), Y - F.col("_my")
    s = d.groupBy(*keys).agg(F.first("_mx").alias("mx"), F.first("_my").alias("my"), F.sum(Wt * dx * dx).alias("sxx"),
                             F.sum(Wt * dx * dy).alias("sxy"), F.sum(Wt * dy * dy).alias("syy"), F.count(F.lit(1)).alias("n"))
    slope = F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0))
    return s.select(*keys, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
                    (F.col("sxy") / F.nullif(F.sqrt(F.col("sxx") * F.col("syy")), F.lit(0.0))).alias("r"), "n")


def ranked(df: DataFrame, keys: Sequence[str], col: str, tie: str, name: str) -> DataFrame:
    """Competition rank of ``col`` in each key (equal values share the lowest rank)."""
    o = ordered(df, keys, [col, tie]).position("_i").lag(_pv=col)
    first = F.when(F.col("_pv").isNull() | (F.col("_pv") != F.col(col)), F.col("_i") + 1)
    return o.cols(_f=first).running(**{name: ("max", "_f")}).df.drop("_i", "_pv", "_f", G)


def sliding_rate(df: DataFrame, keys: Sequence[str], ts: str, width: str, step: str, seconds: float) -> DataFrame:
    """Rows per second in sliding windows."""
    d = df.groupBy(*keys, F.window(ts, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return d.select(*keys, F.unix_micros("w.start").alias("start_us"), "n", (F.col("n") / seconds).alias("rate"))


def signal_gaps(o: Ordered, t: str, factor: float) -> DataFrame:
    """Intervals longer than ``factor`` times the key's median interval."""
    o = o.lag(_pt=t).cols(dt=F.col(t) - F.col("_pt")).where("dt is not null")
    o = o.attach(quantiles(o.df, o.keys, ["dt"], {"median": 0.5}))
    return o.where(F.col("dt") > factor * F.col("dt_median")).df


def density(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(x) / cell).alias("cx"), F.floor(F.col(y) / cell).alias("cy")).agg(F.count(F.lit(1)).alias("n"))


def right_closed_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """1-based equal-width bin of (a, b]; the lowest value joins the first bin."""
    return F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((x - lo) / F.nullif((hi - lo) / bins, F.lit(0.0))))).cast("int")
