"""Registered queries of the training-data operators: thin readers and digests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.llm import decontaminate, fim, fingerprints, lines, merkle, mixing, neardup, pieces, quality, tokens, topk, toxicity, twins, urls
from lapforge.llm.common import small_batches
from lapforge.session import written

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = small_batches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality.judged(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(topk.integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = small_batches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return toxicity.graded(docs, table(spark, sf_dir, "labels")).drop("text")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"))


def op8_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = small_batches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokens.section_tokens(docs, RANKS, public_tokenizers.PATTERN)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = small_batches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = docs.select("doc_id", pieces.encode(spark, PIECES, F.col("text")).alias("e")).select("doc_id", "e.*")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    text = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    changed = merkle.leaf(*[F.replace(c, F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.FIELDS])
    rows = docs.select("doc_id", "source", merkle.leaf(*map(F.col, merkle.FIELDS)).alias("leaf"), F.when(tampered, changed).alias("changed"))
    out = merkle.manifest(rows, "source", ["doc_id"], "leaf")
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
                     merkle.folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (
    op1_fingerprints, op2_quality, op3_line_dedup, op4_top_k, op5_toxicity, op6_url_filters, op7_simhash_near_dedup, op8_section_tokens, op9_mixing, op10_sentencepiece,
    op11_fill_in_middle, op12_decontamination, op13_merkle_manifest)}

#: The first is integer scores of every query vector against all others, ranked.
SQL: dict[str, str] = {
    "op4_top_k": """
        with v as (select vec_id, min(list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint))) as v from embeddings
            where vec_id is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 group by vec_id),
        s as (select q.vec_id as query_id, c.vec_id as vec_id,
                cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
        r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
        select * from r where rank <= 10""",
    "op11_fill_in_middle": twins.FILL_IN_MIDDLE,
    "op12_decontamination": twins.CONTAMINATION,
    "op13_merkle_manifest": twins.manifest(),
}
