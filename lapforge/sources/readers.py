"""Scans of sensor CSVs, JSON logs, timing sheets, venue geometry and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.operators.stats import consistency

# Files a recording must have, and the smallest sane row counts.
REQUIRED = ("Location", "Accelerometer", "Gyroscope", "Gravity", "Orientation")
MIN_GPS_ROWS, MIN_IMU_ROWS = 500, 50000

SHEET_SCHEMA = """date string, time string, event string, track string, driver string, bestLap double, totalLaps int, position int,
lapTimes array<struct<lap:int,time:double>>, session struct<date:string,time:string,type:string,track:string,driver:string,position:int>,
laps array<struct<time_seconds:double>>, results struct<best_lap_seconds:double,average_lap_seconds:double,laps_completed:int,position:int>"""

FEATURES_SCHEMA = """features array<struct<properties:struct<id:string,role:string,name:string>,geometry:struct<type:string,coordinates:array<double>>>>"""


def sensor_csv(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All sensor files below ``root`` as text columns plus recording and sensor names from the path."""
    cols = ", ".join(f"{c.split()[0]} string" for c in schema.split(","))
    d = spark.read.schema(cols).option("header", True).option("recursiveFileLookup", True).csv(root)
    path = F.col("_metadata.file_path")
    named = d.select("*", F.regexp_extract(path, r"recording=([^/]+)", 1).alias("recording"), F.regexp_extract(path, r"sensor=([^/]+)", 1).alias("sensor"))
    casts = [F.col(c.split()[0]).try_cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(",")]
    return named.select("recording", "sensor", *casts)


def inventory(rows: DataFrame, required: Sequence[str] = REQUIRED, gps: str = "Location", min_gps: int = MIN_GPS_ROWS,
              imu: str = "Accelerometer", min_imu: int = MIN_IMU_ROWS) -> DataFrame:
    """Per recording: rows of each required sensor, missing sensors, and whether it can be used."""
    counts = rows.groupBy("recording").pivot("sensor", list(required)).agg(F.count(F.lit(1)))
    missing = F.array_compact(F.array(*[F.when(F.col(s).isNull(), F.lit(s)) for s in required]))
    ok = (F.size(missing) == 0) & (F.coalesce(gps, F.lit(0)) > min_gps) & (F.coalesce(imu, F.lit(0)) > min_imu)
    return counts.withColumns({"missing": missing, "ok": ok})


def sensor_rates(sensors: Column, rates: Column) -> Column:
    """Map of sensor name to sample period; a period that is not a number becomes NULL.

    Of a sensor listed twice the last period counts.
    """
    names = F.filter(F.transform(F.split(sensors, r"\|"), lambda s: F.trim(s)), lambda s: s != "")
    periods = F.transform(F.split(rates, r"\|"), lambda s: F.trim(s))
    pair = F.transform(names, lambda n, i: F.struct(n.alias("k"), F.get(periods, i).try_cast("int").alias("v")))
    later = lambda i: F.slice(names, i + 2, F.size(names))
    return F.map_from_entries(F.filter(pair, lambda p, i: ~F.array_contains(later(i), p["k"])))


def time_span(rows: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """First and last valid clock and the span in seconds; text that is no number is ignored."""
    t = F.col(time).try_cast("long")
    return rows.groupBy(*keys).agg(F.min(t).alias("t0_ns"), F.max(t).alias("t1_ns"), ((F.max(t) - F.min(t)) / 1e9).alias("duration_s"))


def clock24(text: Column) -> Column:
    """``HH:mm`` or ``h:mm AM`` as ``HH-mm``."""
    at = F.coalesce(F.try_to_timestamp(text, F.lit("HH:mm")), F.try_to_timestamp(F.upper(text), F.lit("h:mm a")))
    return F.date_format(at, "HH-mm")


def timing_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Flat and nested sheets as one row each; best and average default to the laps."""
    d = spark.read.schema(SHEET_SCHEMA).json(path)
    nested = F.col("session").isNotNull() | F.col("laps").isNotNull()
    flat_laps = F.transform("lapTimes", lambda x: x["time"])
    laps = F.coalesce(F.array_compact(F.when(nested, F.transform("laps", lambda x: x["time_seconds"])).otherwise(flat_laps)), F.array().cast("array<double>"))
    kind = F.when(nested, F.col("session.type")).otherwise(F.col("event"))
    mean = F.aggregate(laps, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(laps), F.lit(0))
    best = F.coalesce(F.when(nested, F.col("results.best_lap_seconds")).otherwise(F.col("bestLap")), F.array_min(laps))
    avg = F.coalesce(F.when(nested, F.col("results.average_lap_seconds")), mean)
    day = F.when(nested, F.col("session.date")).otherwise(F.col("date"))
    clock = clock24(F.when(nested, F.col("session.time")).otherwise(F.col("time")))
    return d.select(
        F.when(nested, "nested").otherwise("flat").alias("schema"), F.concat_ws("_", day, clock).alias("session_key"), kind.alias("session_type"),
        F.coalesce("session.track", "track").alias("venue"), F.coalesce("session.driver", "driver").alias("driver"),
        F.coalesce("session.position", "results.position", "position").alias("position"), laps.alias("lap_times"), best.alias("best_lap"), F.round(avg, 3).alias("avg_lap"),
        F.coalesce("results.laps_completed", "totalLaps", F.size(laps)).alias("total_laps"),
        F.when(nested & F.lower(F.coalesce(kind, F.lit(""))).contains("race"), "average").otherwise("best").alias("ranking_metric"))


def sheet_consistency(sheets: DataFrame) -> DataFrame:
    return consistency(sheets, ["session_key"], "lap_times")


def venue_features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features as rows."""
    d = spark.read.schema(FEATURES_SCHEMA).json(path).select(F.explode("features").alias("f"))
    return d.select(F.col("f.properties.id").alias("id"), F.col("f.properties.role").alias("role"), F.col("f.properties.name").alias("name"),
                    F.col("f.geometry.type").alias("type"), F.get("f.geometry.coordinates", 0).alias("lon"), F.get("f.geometry.coordinates", 1).alias("lat"))


def phone_log(spark: SparkSession, path: str, fields: dict[str, str], lat: str, lon: str) -> DataFrame:
    """Wide string log: numbers cast, broken lines skipped, fixes at (0, 0) or off the globe dropped."""
    schema = ", ".join(f"`{c}` string" for c in fields) + ", _corrupt string"
    d = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    d = d.select("_corrupt", *[F.trim(c).try_cast(t).alias(c) for c, t in fields.items()]).where("_corrupt is null").drop("_corrupt")
    on_earth = F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & ~((F.col(lat) == 0) & (F.col(lon) == 0))
    return d.where(on_earth)


def by_extension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read CSV, Parquet or JSON as the path says."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "parquet", "json"):
        raise ValueError(f"unknown file kind {kind}")
    reader = spark.read.schema(schema)
    return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(path)


def union_recordings(tables: dict[str, DataFrame], stamps: dict[str, dict[str, int]], skip: Sequence[str] = ()) -> DataFrame:
    """Tables of several recordings stacked, stamped with their keys, absent columns NULL."""
    out = None
    for name, df in tables.items():
        if name in skip:
            continue
        d = df.withColumns({k: F.lit(v) for k, v in stamps[name].items()})
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def result_files(spark: SparkSession, path: str, schema: str, usage: Sequence[str], embedded: str, embedded_schema: str) -> DataFrame:
    """Result documents flattened: nested usage fields lifted, embedded JSON parsed when it is valid."""
    d = spark.read.schema(schema).json(path)
    parsed = F.from_json(embedded, f"{embedded_schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    d = d.withColumn("_p", parsed).withColumn("valid_json", F.col("_p").isNotNull() & F.col("_p._bad").isNull())
    keep = [c for c in d.columns if c not in ("usage", "_p", "valid_json", embedded)]
    lifted = [F.col(f"usage.{u}").alias(f"usage_{u}") for u in usage]
    inner = [F.when(F.col("valid_json"), F.col(f"_p.{c.split()[0]}")).alias(c.split()[0]) for c in embedded_schema.split(",")]
    return d.select(*keep, *lifted, *inner, "valid_json")
