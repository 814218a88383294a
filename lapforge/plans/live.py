"""Streaming queries: the trace replayed as time-ordered files in several micro-batches."""

from pyspark.sql import functions as F

from lapforge.plans.registry import query
from lapforge.plans.segments import CROSS, INC, _AB, _LOW, _REC, debounce_sql
from lapforge.plans.views import GATE, T, r, recursive, trace
from lapforge.session import new_path
from lapforge.streaming import live

SLICES = 3


def replay(spark, sf, closing: bool = False):
    """The trace written in ``SLICES`` files sets by time and read back as a stream, and the
    disorder in it: files of one slice may come in any order.

    With ``closing`` a last file has one row of session -1, which does not exist, late enough to
    let the watermark pass all others.
    """
    d = trace(spark, sf).df.select("session", "t_us", "t", "event_id", "e", "n", "speed", F.col("k").alias("turn"))
    path = new_path(spark, "stream")
    lo, hi = (d.agg(f("t_us")).first()[0] for f in (F.min, F.max))
    delay = (hi - lo) // SLICES + 2_000_000
    for i in range(SLICES):
        a, b = lo + (hi - lo) * i // SLICES, lo + (hi - lo) * (i + 1) // SLICES + (i == SLICES - 1)
        d.where((F.col("t_us") >= a) & (F.col("t_us") < b)).write.parquet(f"{path}/slice={i}")
    if closing:
        end = d.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema]).withColumns({"session": F.lit(-1).cast("long"), "t_us": F.lit(hi + delay + 2_000_000)})
        end.write.parquet(f"{path}/slice={SLICES}")
    files = spark.readStream.schema(d.schema).option("recursiveFileLookup", True).option("maxBytesPerTrigger", str(256 << 20)).parquet(path)
    return files, f"{delay} microseconds"


def finished(spark, stream):
    path = new_path(spark, "live")
    live.drain(stream, path)
    return spark.read.schema(stream.schema).parquet(path)


@query("STR-01", T(""", s AS (SELECT session, t_us, t_us - lag(t_us) OVER (PARTITION BY session ORDER BY t_us) AS dt FROM trace), g AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t_us) AS w FROM s)
SELECT session, min(t_us) AS t_in, max(t_us) AS t_out, count(*) AS n FROM g GROUP BY session, w HAVING max(t_us) + 43200000000 <= (SELECT max(t_us) // 1000 * 1000 - 7200000000 FROM trace)"""))
def str_01(spark, sf):
    stream = replay(spark, sf)[0].withColumn("ts", F.timestamp_micros("t_us"))
    d = finished(spark, live.live_sessions(stream, "session", "ts", "12 hours", "2 hours"))
    return d.select("session", F.unix_micros("t_in").alias("t_in"), F.unix_micros("t_out").alias("t_out"), "n")


@query("STR-02", debounce_sql(CROSS, "tc", "> 100000", "SELECT f.session, f.event_id, round(c.tc, 3) AS t_cross, c.side, row_number() OVER (PARTITION BY f.session ORDER BY f.j) AS lap_no FROM f JOIN cr c ON c.event_id = f.event_id WHERE keep"))
def str_02(spark, sf):
    stream, delay = replay(spark, sf, closing=True)
    return finished(spark, live.live_laps(stream, "session", "t_us", delay, GATE, 100000.0)).withColumn("t_cross", r("t_cross", 3))


@query("STR-03", recursive("SELECT * FROM cr", "SELECT session, event_id, i, j, false AS inc, CAST(0 AS DOUBLE) AS low, CAST(0 AS DOUBLE) AS rec, false AS shown FROM src WHERE j = 0",
       f"""SELECT s.session, s.event_id, s.i, s.j, CASE WHEN f.inc OR {_AB} THEN NOT ({_REC} > 30000) ELSE {_LOW} > 60000 END,
       CASE WHEN f.inc THEN f.low WHEN {_AB} THEN 0.0 WHEN {_LOW} > 60000 THEN 0.0 ELSE {_LOW} END, CASE WHEN f.inc OR {_AB} THEN CASE WHEN {_REC} > 30000 THEN 0.0 ELSE {_REC} END ELSE f.rec END,
       CASE WHEN f.inc OR {_AB} THEN true ELSE {_LOW} > 60000 END FROM f JOIN src s ON s.session = f.session AND s.j = f.j + 1""",
       "SELECT session, event_id, shown AS incident FROM f").replace(", src AS MATERIALIZED", INC + ", src AS MATERIALIZED", 1))
def str_03(spark, sf):
    stream, delay = replay(spark, sf, closing=True)
    return finished(spark, live.live_incidents(stream, "session", "t_us", delay, 15, -40, 95, 12, 60000, 40, 30000))
