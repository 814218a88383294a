"""Positions and ranks of the mix by a brute-force inversion, and rows with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lapforge.llm import mixing

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), "en", f"s{i % 4}", 9) for i in range(120)]
    rows += [(None, "a b c", "en", "s1", 5), (7, "a b c", "en", "s1", 5), (7, "a b c", "en", "s1", 5), (300, "", "en", "s2", 0), (301, None, "en", None, None)]
    return spark.createDataFrame(rows, DOC).repartition(4)


def invert(demand, tilt):
    """Time at which t + tilt * (t * t - t) reaches ``demand``, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid + tilt * (mid * mid - mid) < demand else (lo, mid)
    return lo


@pytest.mark.parametrize("most", [2.0, 3.0])
def test_positions_invert_the_demand(spark, most):
    docs = corpus(spark)
    plan = mixing.training_plan(docs, most=most).collect()
    names = sorted({r["source"] for r in plan if r["source"]}) + [None]
    for n, name in enumerate(names):
        own = sorted((r for r in plan if r["source"] == name), key=lambda r: r["place"])
        demand, done, total = int(own[0]["target"] + 0.5), 0, sum(r["size"] for r in own)
        copies = {(r["place"], c["copy"]): c for r in own for c in r["copies"]}
        for copy in range(int(most)):
            for r in own:
                words = max(0, min(r["size"], demand - done))
                if words:
                    c = copies.pop((r["place"], copy))
                    assert c["words"] == words
                    assert c["position"] == pytest.approx(invert(min(1.0, (done + words / 2) / r["target"]), mixing.TILTS[n % 3]), abs=1e-9)
                done += r["size"]
        assert not copies and done == int(most) * total


def test_rank_follows_the_positions(spark):
    rows = mixing.mix(corpus(spark)).collect()
    taken = sorted((r for r in rows if r["positions"]), key=lambda r: r["train_rank"])
    assert [r["train_rank"] for r in taken] == list(range(len(taken)))
    assert [r["positions"][0] for r in taken] == sorted(r["positions"][0] for r in taken)
    assert all(r["train_rank"] is None and r["taken"] == 0 for r in rows if not r["positions"])


def test_every_row_and_column_stays(spark):
    docs = corpus(spark).withColumns({"_k": F.lit("k"), "words": F.col("doc_id") * 2, "position": F.lit(-1.0), "_d": F.lit(3)})
    tagged = docs.withColumn("size", F.lit("x")).unionByName(docs.withColumn("size", F.lit("y")))
    plan = sum(len(r["copies"]) for r in mixing.training_plan(tagged).collect())
    got = mixing.mixed_documents(tagged)
    assert got.columns == tagged.columns
    rows = got.collect()
    assert len(rows) == plan and {r["size"] for r in rows} == {"x", "y"}
    assert all(r["_k"] == "k" and r["position"] == -1.0 and r["_d"] == 3 and r["words"] == (None if r["doc_id"] is None else 2 * r["doc_id"]) for r in rows)


def test_quality_stage_keeps_columns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    odd = docs.withColumns({"score": F.lit(-7.0), "predicted": F.lit(99), "held_out": F.lit("h")}).unionByName(docs.limit(1).withColumns(
        {"text": F.lit(None).cast("string"), "score": F.lit(-7.0), "predicted": F.lit(99), "held_out": F.lit("h")}))
    got = corpus_pipeline.quality_filter(spark, odd, str(tmp_path))
    assert got.columns == odd.columns
    rows = got.collect()
    assert 0 < len(rows) <= 121 and all((r["score"], r["predicted"], r["held_out"]) == (-7.0, 99, "h") for r in rows)
    assert corpus_pipeline.quality_filter(spark, odd.limit(0), str(tmp_path)).count() == 0
