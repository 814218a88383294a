"""Corner statistics, scores, cues and session reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.operators.asof import landmark_snap
from lapforge.operators.clean import salted_lookup
from lapforge.operators.ordered import G, Ordered, ordered
from lapforge.operators.smooth import gradient


def corner_fractions(trace: DataFrame, refs: DataFrame, keys: Sequence[str], marks: dict[str, tuple[float, float]],
                     splits: Sequence[float]) -> DataFrame:
    """Share of the reference lap at each corner, and the sector that share lies in."""
    lap = salted_lookup(trace, refs, keys, F.col(G), "inner").where("lap = ref_lap")
    d = landmark_snap(lap, keys, marks, "e", "n", G, ["frac"]).withColumnRenamed("landmark", "corner")
    sector = F.lit(1)
    for s in splits:
        sector = sector + (F.col("frac") >= float(s)).cast("int")
    return d.withColumn("sector", sector)


def half_windows(corners: DataFrame, keys: Sequence[str], share: float = 0.45, lo: float = 0.004, hi: float = 0.02) -> DataFrame:
    """Half-width of each corner window: a share of the nearest gap, clipped."""
    o = ordered(corners, keys, ["frac", "corner"]).over(
        {"_p": lambda w: F.lag("frac").over(w), "_n": lambda w: F.lead("frac").over(w)}, before=1, after=1)
    gap = F.least(F.col("frac") - F.col("_p"), F.col("_n") - F.col("frac"))
    half = F.when(gap.isNull(), F.lit(hi)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), gap * share)))
    return o.df.withColumn("half", half).drop("_p", "_n", G)


def corner_laps(o: Ordered, corners: DataFrame, keys: Sequence[str], reach: float, approach: float, decel: float) -> DataFrame:
    """Per lap and corner: apex speed and place, entry and exit speed, braking distance."""
    d = o.rekey([*keys, "lap"]).over({"_dv": gradient("speed", "t")}, before=1, after=1).df
    side = corners.select(*keys, "corner", F.col("frac").alias("cf"), "half")
    j = salted_lookup(d, side, keys, F.col(G), "inner").withColumn("gap", F.col("frac") - F.col("cf"))
    inside = F.abs("gap") <= F.col("half")
    apex = F.min(F.when(inside, F.struct("speed", F.col(G).alias("g"), "e", "n")))
    near = lambda at: F.min_by("speed", F.struct(F.abs(F.col("gap") - at), G))
    pre = (F.col("gap") > -approach) & (F.col("gap") <= 0)
    brake = F.max(F.when(pre, F.col("dist"))) - F.min(F.when(pre & (F.col("_dv") < -decel), F.col("dist")))
    a = j.groupBy(*keys, "lap", "corner").agg(
        F.count(F.when(inside, 1)).alias("_in"), apex.alias("a"), near(-reach).alias("entry"), near(reach).alias("exit"), brake.alias("brake"))
    return a.where("_in >= 2").select(*keys, "lap", "corner", F.col("a.speed").alias("apex"), F.col("a.e").alias("ax"), F.col("a.n").alias("ay"),
                                      "entry", "exit", "brake")


def corner_stats(per_lap: DataFrame, keys: Sequence[str], min_laps: int = 3) -> DataFrame:
    """Apex speed level and spread, scatter of the apex place, entry, exit and braking spread."""
    by = [*keys, "corner"]
    mid = per_lap.groupBy(*by).agg(F.avg("ax").alias("_mx"), F.avg("ay").alias("_my"))
    d = salted_lookup(per_lap, mid, by, F.col("lap"))
    off = F.pow(F.col("ax") - F.col("_mx"), 2) + F.pow(F.col("ay") - F.col("_my"), 2)
    s = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("laps"), F.avg("apex").alias("apex_mean"), F.stddev_pop("apex").alias("apex_std"), F.sqrt(F.avg(off)).alias("line_spread"),
        F.avg("entry").alias("entry_mean"), F.avg("exit").alias("exit_mean"), F.when(F.count("brake") > 2, F.stddev_pop("brake")).alias("brake_std"))
    s = s.where(F.col("laps") >= min_laps)
    return s.withColumn("apex_cv", F.col("apex_std") / (F.col("apex_mean") + 1e-6))


def clip01(c):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def corner_scores(stats: DataFrame) -> DataFrame:
    """0..100: three quarters from apex-speed repeatability, one quarter from apex-place scatter."""
    v = clip01(F.col("apex_cv") / 0.12)
    line = clip01((F.col("line_spread") - 4.0) / 8.0)
    return stats.withColumn("score", F.bround(100 * (1 - 0.75 * v - 0.25 * line), 0))


def sector_scores(packs: DataFrame) -> DataFrame:
    return packs.withColumn("score", F.bround(100 * (1 - clip01(F.col("cv") / 0.12)), 0))


# Limits of the driving rules (metres, ratio, speed units).
CUES = {
    "line": ("line_spread", 2.5), "apex": ("apex_cv", 0.10), "overslow": (None, 12.0), "exit": (None, 1.0), "brake": ("brake_std", 4.0),
    "look": ("head_yaw", 0.08),
}
CUE_TEXT = {
    "line": "Use one reference point and drive the same line every lap.",
    "apex": "Hold one minimum speed at the apex.",
    "overslow": "Brake later and lighter; too much speed is lost before the apex.",
    "exit": "Open the throttle earlier on the way out.",
    "brake": "Fix the braking point with a marker.",
    "look": "Look through the corner sooner.",
}


def corner_cues(scored: DataFrame, head: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Driving cues that apply to each corner, in rule order; corners without any are left out."""
    d = scored
    if head is not None:
        d = d.join(head, [*keys, "corner"], "left")
    else:
        d = d.withColumn("head_yaw", F.lit(None).cast("double"))
    tests = {
        "line": F.col("line_spread") > CUES["line"][1],
        "apex": F.col("apex_cv") > CUES["apex"][1],
        "overslow": F.col("entry_mean") - F.col("apex_mean") > CUES["overslow"][1],
        "exit": F.col("exit_mean") < F.col("apex_mean") + CUES["exit"][1],
        "brake": F.col("brake_std") > CUES["brake"][1],
        "look": F.abs("head_yaw") < CUES["look"][1],
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return d.withColumn("cues", found).where(F.size("cues") > 0)


def head_approach(trace: DataFrame, corners: DataFrame, keys: Sequence[str], yaw: str, reach: float) -> DataFrame | None:
    """Mean head yaw just before each corner; None when the sensor column is absent."""
    if yaw not in trace.columns:
        return None
    j = salted_lookup(trace, corners.select(*keys, "corner", F.col("frac").alias("cf")), keys, F.col(G), "inner")
    j = j.where((F.col("frac") >= F.col("cf") - reach) & (F.col("frac") < F.col("cf")))
    return j.groupBy(*keys, "corner").agg(F.avg(yaw).alias("head_yaw"))


def strategy(scored: DataFrame, cues: DataFrame, opportunities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Next-session plan: the three weakest corners with their first cue, then the top sector."""
    w = Window.partitionBy(*keys).orderBy("score", "corner")
    weak = scored.withColumn("priority", F.row_number().over(w)).where("priority <= 3")
    first = cues.select(*keys, "corner", F.get("cues", 0).alias("focus"))
    weak = weak.join(first, [*keys, "corner"], "left").select(
        *keys, "priority", F.col("corner").alias("where"), F.coalesce("focus", F.lit("repeat")).alias("focus"),
        F.format_string("consistency %d/100", F.col("score").cast("int")).alias("why"))
    w2 = Window.partitionBy(*keys).orderBy(F.desc("opportunity"), "sector")
    top = opportunities.withColumn("_r", F.row_number().over(w2)).where("_r = 1")
    used = weak.groupBy(*keys).agg(F.max("priority").alias("_p"))
    top = top.join(used, list(keys), "left").select(
        *keys, (F.coalesce("_p", F.lit(0)) + 1).alias("priority"), F.concat(F.lit("sector "), F.col("sector").cast("string")).alias("where"),
        F.lit("prioritise").alias("focus"), F.lit("most lap time available").alias("why"))
    return weak.unionByName(top)
