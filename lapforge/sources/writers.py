"""Datasets, exports and text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.functions.geo import MPH
from lapforge.operators.documents import PART_ROWS, assemble


def session_dataset(df: DataFrame, path: str, by: Sequence[str], order: Sequence[str], csv_path: str | None = None) -> None:
    """One dataset for all sessions, partitioned by folder, optionally also as CSV.

    Rows are spread by range of (keys, order), so one long session becomes several files.
    """
    cols = [*by, *order]
    d = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    d.write.partitionBy(*by).parquet(path)
    if csv_path:
        d.write.partitionBy(*by).option("header", True).csv(csv_path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def text_files(df: DataFrame, path: str, doc: str, number: str, text: str, size: int = PART_ROWS) -> None:
    """Text files below ``doc=<id>/part=<n>``, one line of text after the other by ``number`` from 0.

    A part holds ``size`` numbers and is one file, so a long document spreads over tasks.
    """
    d = df.select(F.col(doc).alias("doc"), F.expr(f"`{number}` div {size}").alias("part"), F.col(number).alias("_n"), F.col(text).alias("text"))
    d.repartition("doc", "part").sortWithinPartitions("doc", "part", "_n").select("doc", "part", "text").write.partitionBy("doc", "part").text(path)


def titled_texts(spark: SparkSession, path: str, title_pattern: str, part_pattern: str, trim: bool = True) -> DataFrame:
    """Text files as (title, part, text): title and part from the path, text trimmed unless told not to."""
    d = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    return d.select(F.regexp_extract(where, title_pattern, 1).alias("title"), F.regexp_extract(where, part_pattern, 1).try_cast("long").alias("part"),
                    (_trimmed("value") if trim else F.col("value")).alias("text"))


def _trimmed(text: str) -> Column:
    return F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))


def whole_texts(parts: DataFrame) -> DataFrame:
    """One row (title, text) for each title: its untrimmed parts in order, then trimmed as a whole."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("part").isNull().alias("last"), "part", "text")))
    d = parts.groupBy("title").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("text"))
    return d.select("title", _trimmed("text").alias("text"))


def trip_export(trace: DataFrame, points: DataFrame, t_us: str, trip: Column) -> DataFrame:
    """Map rows: epoch milliseconds, position, mph and trip, with points of interest appended."""
    rows = trace.select(F.floor(F.col(t_us) / 1000).alias("time_ms"), "lat", "lon", F.round(F.col("speed") * MPH, 3).alias("speed_mph"),
                        trip.alias("trip_id"), F.lit("sample").alias("kind"))
    return rows.unionByName(points.withColumn("kind", F.lit("poi")), allowMissingColumns=True)


def race_markdown(results: DataFrame, race: str, place: str, tie: Sequence[str], finished: Column, line: Column, standing: DataFrame) -> DataFrame:
    """Markdown of every race: finishers by place, then retirements, then the top of the standings."""
    rows = results.select(race, F.when(finished, 0).otherwise(1).alias("_s"), F.col(place).alias("_p"), *tie, F.concat(F.lit("- "), line).alias("_l"))
    top = standing.select(race, F.lit(2).alias("_s"), F.col("rank").alias("_p"), *[F.lit(None).cast(results.schema[c].dataType).alias(c) for c in tie],
                          F.concat(F.lit("- Standing "), F.col("rank").cast("string"), F.lit(": "), F.col("name")).alias("_l"))
    d = assemble(rows.unionByName(top), [race], ["_s", "_p", *tie], F.col("_l"))
    return d.select(race, "part", F.array_join("items", "\n").alias("markdown"))
