"""Mix sources to target weights along a curriculum that changes over training time.

Source s draws words at the rate w_s(t) = target_s * (1 + tilt_s * (2t - 1)), 0 <= t <= 1. The
integral up to t is its cumulative demand, target_s * (t + tilt_s * (t^2 - t)), which ends at
target_s. The source's documents queue up in a hashed order, pass after pass, and a document
trains at the time when the demand reaches its middle word. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.llm.common import SPACE, n_words
from lapforge.operators.clean import salted_lookup
from lapforge.operators.ordered import ordered
from lapforge.session import written

WEIGHTS = (3, 1, 2)
TILTS = (-0.5, 0.0, 0.5)
SHARE = 1.5
MOST = 2.0


def _key(source: str) -> Column:
    """A source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``_s`` (source key), ``source_size``, ``target`` and ``tilt`` of each source.

    Sources by code point, null last, take ``weights`` in turn. ``share`` times all sizes is dealt
    by weight; a target stops at ``most`` times its source's size and what is over is dealt again
    among the rest until none is above. A round is one aggregation that returns three numbers.
    """
    sums = written(sizes.groupBy("_s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), "sums")
    turn = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.expr(f"int(_g % {len(values)}) + 1"))
    place = ordered(sums, [], [F.col("source").isNull(), "source"]).df
    table = written(place.select("_s", "source_size", turn(weights).alias("w"), turn(tilts).alias("tilt")), "sources")
    total = share * (table.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    level, full = 0.0, -1
    cap = F.col("source_size") * most
    while True:
        stopped = (cap <= F.col("w") * level) if full >= 0 else F.lit(False)
        row = table.agg(F.count(F.when(stopped, 1)).alias("full"), F.sum(F.when(stopped, cap).otherwise(0.0)).alias("given"),
                        F.sum(F.when(stopped, 0.0).otherwise(F.col("w"))).alias("open")).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], max(0.0, total - row["given"]) / row["open"]
    return table.withColumn("target", F.least(cap, F.col("w") * level))


def training_plan(documents: DataFrame, keep: Sequence[str] = (), most: float = MOST, **options) -> DataFrame:
    """Each document's ``size``, ``source_size``, ``target`` and the ``copies`` the mix takes.

    ``copies`` is an array of (copy, words, position): a queue pass, the words it takes, and the
    training time in [0, 1] of their middle. The document in which a source's demand ends gives
    its first words only, so a source's words add up to its rounded target. Words are
    ``[^\\x20\\x09-\\x0D]+``; a null or empty text has size 0 and no copies. Rows are queued by a
    hash of id and text, so reruns agree; repeated rows queue as rows of their own, null ids too.
    The queue passes ``ceil(most)`` times. ``place`` numbers the rows; columns ``keep`` come along.
    """
    sizes = documents.select("doc_id", "source", F.xxhash64("text").alias("k"), n_words(F.col("text")).alias("size"), _key("source").alias("_s"), *keep)
    sizes = written(sizes, "sizes")
    targets = written(source_targets(sizes, most=most, **options), "targets")
    queue = ordered(sizes, ["_s"], [F.xxhash64("doc_id", "k", F.lit("queue")), "doc_id", "k", *keep]).running(exclusive=True, start=("sum", "size"))
    rows = salted_lookup(queue.df.withColumnRenamed("_g", "place"), targets, ["_s"], F.xxhash64("doc_id", "k"), "inner")
    demand, start = F.round("target").cast("long"), F.coalesce("start", F.lit(0))
    q = lambda offset, words: F.least(F.lit(1.0), (offset + words / 2) / F.greatest("target", F.lit(1e-9)))
    # The root of tilt * t^2 + (1 - tilt) * t = q, in the form that also holds for tilt 0.
    when = lambda x: F.least(F.lit(1.0), 2 * x / (1 - F.col("tilt") + F.sqrt((1 - F.col("tilt")) * (1 - F.col("tilt")) + 4 * F.col("tilt") * x)))
    copies = []
    for copy in range(math.ceil(most)):
        offset = start + copy * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), demand - offset))
        copies.append(F.struct(F.lit(copy).alias("copy"), words.cast("long").alias("words"), when(q(offset, words)).alias("position")))
    taken = F.filter(F.array(*copies), lambda c: c["words"] > 0)
    return rows.select("doc_id", "source", "k", "size", "source_size", "target", "place", *keep, taken.alias("copies"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words with repeats), ``positions``
    (training time of every copy) and ``train_rank``.

    The rank numbers the documents from 0 by the position at which they train first, over a range
    sort; documents that the mix does not take have none.
    """
    plan = training_plan(documents, **options)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    rows = plan.select("doc_id", "k", "size", "source_size", "target", taken.alias("taken"), F.col("copies.position").alias("positions"), "place")
    first = F.get("positions", F.lit(0))
    rows = ordered(rows, [], [first.asc_nulls_last(), F.col("place")]).df
    return rows.select("doc_id", "size", "source_size", "target", "taken", "positions", F.when(F.size("positions") > 0, F.col("_g")).alias("train_rank"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents in training order, in the columns they came with; a repeat is a row again.

    A part of a document is its text up to the last word taken, with ``n_chars`` to match. Rows
    that differ in any column are rows of their own; rows equal in all are interchangeable, so one
    text of them travels. Names of the given columns never clash with the plan's.
    """
    cols = documents.columns
    row = [F.xxhash64(*cols).alias("_r1"), F.xxhash64(F.lit(1), *cols).alias("_r2")]
    plan = training_plan(documents.select("doc_id", "source", "text", *row), ["_r1", "_r2"], **options)
    copies = plan.select("_r1", "_r2", "place", "size", F.explode("copies").alias("_c")).select("_r1", "_r2", "place", "size", "_c.words", "_c.position")
    texts = documents.select(F.struct(*[documents[c] for c in cols]).alias("_d"), *row).groupBy("_r1", "_r2").agg(F.first("_d").alias("_d"))
    out = salted_lookup(copies, texts, ["_r1", "_r2"], F.col("place"), "inner", selective=True)
    pieces = F.split(F.col("_d.text"), f"(?<=[^{SPACE}])(?=[{SPACE}])")
    text = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(pieces, 1, F.col("words").cast("int")), "")).otherwise(F.col("_d.text"))
    out = out.select("_d", text.alias("_text"), "position", "place").repartitionByRange("position", "place").sortWithinPartitions("position", "place")
    put = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[put[c].alias(c) if c in put else F.col(f"_d.{c}").alias(c) for c in cols])
