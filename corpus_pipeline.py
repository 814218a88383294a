"""Documents to training tokens: quality, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.llm import lines, mixing, neardup, pieces, quality
from lapforge.llm.common import small_batches
from lapforge.llm.queries import PIECES
from lapforge.session import written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay as they are, whatever their columns' names.

    A null text is judged as an empty one, repeated rows alike; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[docs[c] for c in names]).alias("_row"))
    kept = quality.judged(small_batches(packed), labels).where("predicted = 1")
    return kept.select(*[F.col(f"_row.{c}").alias(c) for c in names])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and fuzzy lines go, all rows stay; see ``lines.dedup_lines``."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays; see ``neardup.keep_first``."""
    return neardup.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated to the target weights, in training order; see ``mixing.mixed_documents``."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``n_tokens`` and ``ids`` of every row; a null text has none."""
    out = small_batches(docs).select("doc_id", "lang", "source", pieces.encode(spark, PIECES, F.col("text")).alias("e"))
    return out.select("doc_id", "lang", "source", F.size("e.ids").cast("long").alias("n_tokens"), F.col("e.ids").alias("ids"))


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
