"""Views over the given tables that play the roles of a telemetry store.

``events`` is the sensor stream: a user is a session, ``value`` the speed, ``ts`` the clock.
Rows walk a closed 16-point square (100 m sides), so laps, sectors and gates exist and both
engines compute the same coordinates without trigonometry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.functions.geo import to_geographic
from lapforge.operators.ordered import Ordered, ordered

# Where the derived circuit sits, its lap length in points, its gate.
LAT0, LON0 = 38.65, -90.13
LAP_POINTS = 16
GATE = (37.5, -12.0, 37.5, 12.0)
RING = [(20.0, -20.0), (130.0, -20.0), (130.0, 60.0), (20.0, 60.0)]

TRACE = """WITH ev AS (
  SELECT user_id AS session, epoch_us(ts) AS t_us, event_id, value AS speed, event_type AS kind,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i
  FROM events
), walk AS (
  SELECT *, (t_us - min(t_us) OVER (PARTITION BY session)) / 1e6 AS t, i % 16 AS p FROM ev
), local AS (
  SELECT *, (CASE WHEN p < 4 THEN p * 25 WHEN p < 8 THEN 100 WHEN p < 12 THEN (12 - p) * 25 ELSE 0 END)
            + (event_id % 7 - 3) * 0.5 AS e,
         (CASE WHEN p < 4 THEN 0 WHEN p < 8 THEN (p - 4) * 25 WHEN p < 12 THEN 100 ELSE (16 - p) * 25 END)
            + (event_id % 5 - 2) * 0.5 AS n
  FROM walk
), trace AS (
  SELECT session, t_us, event_id, i, t, speed, kind, k, CAST(e AS DOUBLE) AS e, CAST(n AS DOUBLE) AS n,
         38.65 + degrees(n / 6371000.0) AS lat,
         -90.13 + degrees(e / (cos(radians(38.65)) * 6371000.0)) AS lon,
         i // 16 AS lap, 1 + p // 6 AS sector
  FROM local
) """


def T(body: str) -> str:
    """SQL over the derived trace; ``body`` may open with more CTEs after a comma."""
    return TRACE + body


def recursive(base: str, first: str, step: str, final: str) -> str:
    """SQL twin of a sequential fold: ``first`` seeds row 0 of each session, ``step`` adds a row."""
    return (TRACE.replace("WITH ev", "WITH RECURSIVE ev", 1)
            + f", src AS MATERIALIZED ({base}), f AS ({first} UNION ALL {step}) {final}")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Sensor rows straight from the stream table, microsecond clock as a long."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        "event_id",
        F.col("value").alias("speed"),
        F.col("event_type").alias("kind"),
        F.from_json("props", "k bigint")["k"].alias("k"),
    )


_written: dict[tuple[str, str], Ordered] = {}


def trace(spark: SparkSession, sf: str) -> Ordered:
    """The aligned trace of all sessions, written once per Spark application and reused."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _written:
        base = ordered(events(spark, sf), ["session"], ["t_us", "event_id"])
        _written[key] = build_trace(base).cut()
    return Ordered(_written[key].df, ["session"])


def build_trace(base: Ordered) -> Ordered:
    o = base.totals(_start=F.min("_g"), _t0=F.min("t_us"))
    p = F.col("p")
    e = F.when(p < 4, p * 25).when(p < 8, 100).when(p < 12, (12 - p) * 25).otherwise(0)
    n = F.when(p < 4, 0).when(p < 8, (p - 4) * 25).when(p < 12, 100).otherwise((16 - p) * 25)
    o = o.cols(i=F.col("_g") - F.col("_start"), t=(F.col("t_us") - F.col("_t0")) / 1e6)
    o = o.cols(p=F.col("i") % LAP_POINTS)
    o = o.cols(
        e=(e + (F.col("event_id") % 7 - 3) * 0.5).cast("double"),
        n=(n + (F.col("event_id") % 5 - 2) * 0.5).cast("double"),
    )
    lat, lon = to_geographic("e", "n", LAT0, LON0)
    return o.cols(
        lat=lat, lon=lon, lap=F.expr(f"i div {LAP_POINTS}"), sector=F.expr("1 + p div 6")
    ).map(lambda d: d.drop("_start", "_t0", "p"))
