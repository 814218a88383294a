"""Document fingerprints: weighted SimHash and exact search within a Hamming radius.

Every term of a text (two neighbouring words) is hashed to 64 bits; each bit is a signed vote
with the term's weight, its number of code points, since long terms are rarer and tell texts
apart better than pairs of stop words. Only DataFrame functions are used.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.llm.common import hamming, hex64, majority, vote_sums, word_rows
from lapforge.operators.ordered import ordered
from lapforge.session import written

WIDTH = 2


def fingerprint(rows: DataFrame, text: str, keep: list[str], width: int = WIDTH) -> DataFrame:
    """``keep`` and ``fp`` (long) for each distinct value of ``keep``, which must tell rows apart.

    Null and empty texts, and texts without words, have the fingerprint 0. Equal texts have
    equal fingerprints. Words repeat their votes as often as they occur.
    """
    terms = word_rows(rows, text, keep, width)
    terms = terms.select(*keep, F.xxhash64("term").alias("_h"), F.coalesce(F.length("term"), F.lit(0)).cast("long").alias("_n"))
    votes = terms.groupBy(*keep).agg(F.sum("_n").alias("_t"), *vote_sums(F.col("_h"), F.col("_n")))
    return votes.select(*keep, majority(F.col("_t")).alias("fp"))


def block_masks(radius: int, blocks: int) -> list[int]:
    """One mask a table: the bits of the ``blocks - radius`` blocks that must agree."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("0 <= radius < blocks <= 64")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(block[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]


def _tables(df: DataFrame, fp: str, masks: list[int]) -> DataFrame:
    entries = [F.struct(F.lit(t).alias("_t"), F.col(fp).bitwiseAND(F.lit(m)).alias("_k")) for t, m in enumerate(masks)]
    return df.select(fp, F.explode(F.array(*entries)).alias("_e")).select(fp, "_e._t", "_e._k")


def within_radius(queries: DataFrame, corpus: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs (``query_fp``, ``fp``, ``distance``) at most ``radius`` bits apart, each once.

    ``queries`` and ``corpus`` have a long column ``fp``; nulls and repeats count once. Two
    fingerprints that differ in ``radius`` bits differ in so many blocks at most, so they agree in
    all blocks of some table: the result is exact. A pair is taken from its first such table only
    and tested inside the join, so candidates are never written. More blocks mean longer keys and
    more tables.
    """
    masks = block_masks(radius, blocks)
    q = _tables(queries.where("fp is not null").select(F.col("fp").alias("query_fp")).distinct(), "query_fp", masks)
    c = _tables(corpus.where("fp is not null").select("fp").distinct(), "fp", masks)
    q, c = q.alias("q"), c.alias("c")
    x = F.col("query_fp").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)])
    on = (F.col("q._t") == F.col("c._t")) & (F.col("q._k") == F.col("c._k")) & (F.bit_count(x) <= radius) & (first == F.col("q._t"))
    return q.join(c, on).select("query_fp", "fp", F.bit_count(x).alias("distance"))


def _same(a: DataFrame, b: DataFrame, left: str = "", right: str = "") -> Column:
    return a[f"{left}doc_id"].eqNullSafe(b[f"{right}doc_id"]) & (a[f"{left}k"] == b[f"{right}k"])


def edited_fingerprints(documents: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Fingerprint every document, its edited text, and compare both and the next document.

    The edited text has its last floor(n / 4) code points replaced by the first as many of the
    next document by ascending ``doc_id`` (after the last comes the first; a null id comes first;
    rows of one id follow each other by a hash of their text). A null text counts as empty. Rows
    equal in id and text are one document in that order, and are returned as often as they occur.
    An empty table gives an empty result; other columns are ignored.

    ``n_within``: for documents whose id is divisible by 100, the number of other documents with a
    fingerprint within ``radius`` bits, found by the block tables; null for the rest.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("k"), "text")
    place = written(ordered(docs.select("doc_id", "k", F.length("text").cast("long").alias("n")).distinct(), [], ["doc_id", "k"]).df, "order")
    count = place.count()
    after = place.select(F.expr(f"(_g + 1) % {max(count, 1)}").alias("_g"), F.col("doc_id").alias("p_doc_id"), F.col("k").alias("p_k"),
                         F.floor(F.col("n") / 4).cast("int").alias("need"))
    chain = written(place.select("_g", "doc_id", "k").join(after, "_g").drop("_g"), "chain")

    # Both uses of ``home`` read the same columns, so the texts are shuffled once for the two.
    home = docs.join(chain.withColumnsRenamed({"doc_id": "c_doc_id", "k": "c_k"}), docs["doc_id"].eqNullSafe(F.col("c_doc_id")) & (docs["k"] == F.col("c_k")))
    home = home.drop("c_doc_id", "c_k")
    tails = home.select(F.col("p_doc_id").alias("t_doc_id"), F.col("p_k").alias("t_k"), F.left("text", "need").alias("tail"))
    tails = tails.groupBy("t_doc_id", "t_k").agg(F.first("tail").alias("tail"))
    cut = F.floor(F.col("n") / 4).cast("int")
    both = home.drop("p_doc_id", "p_k", "need").withColumn("n", F.length("text").cast("long")).join(tails, F.col("doc_id").eqNullSafe(F.col("t_doc_id")) & (F.col("k") == F.col("t_k")))
    both = both.select("doc_id", "k", "n", "text", F.concat(F.left("text", F.col("n").cast("int") - cut), "tail").alias("edited"))
    both = both.withColumns({"_row": F.monotonically_increasing_id(), "edited_sha256": F.sha2("edited", 256)})
    texts = both.select("_row", "doc_id", "k", "n", "edited_sha256", F.posexplode_outer(F.array("text", "edited")).alias("_v", "_text"))
    own = ["_row", "doc_id", "k", "n", "edited_sha256"]
    prints = fingerprint(texts, "_text", [*own, "_v"]).groupBy(*own).agg(
        F.max(F.when(F.col("_v") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("_v") == 1, F.col("fp"))).alias("efp"))
    prints = written(prints.drop("_row"), "prints")

    sizes = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("m"))
    asked = prints.where("doc_id % 100 = 0").select("fp").distinct()
    found = within_radius(asked, sizes, radius, blocks).join(sizes, "fp").groupBy("query_fp").agg((F.sum("m") - 1).alias("n_within"))
    ahead = prints.groupBy(F.col("doc_id").alias("a_doc_id"), F.col("k").alias("a_k")).agg(F.min("fp").alias("next_fp"))
    ahead = chain.join(ahead, F.col("doc_id").eqNullSafe(F.col("a_doc_id")) & (F.col("k") == F.col("a_k"))).select(
        F.col("p_doc_id").alias("b_doc_id"), F.col("p_k").alias("b_k"), "next_fp")
    near = lambda other: 1 - hamming(F.col("fp"), F.col(other)) / 64.0
    out = prints.join(ahead, F.col("doc_id").eqNullSafe(F.col("b_doc_id")) & (F.col("k") == F.col("b_k")))
    out = out.join(found, (F.col("fp") == F.col("query_fp")) & (F.col("doc_id") % 100 == 0), "left")
    return out.select("doc_id", F.col("n").alias("n_chars"), "edited_sha256", hex64(F.col("fp")).alias("fingerprint"), hex64(F.col("efp")).alias("edited_fingerprint"),
                      near("efp").alias("near_edited"), near("next_fp").alias("near_next"), "n_within")
