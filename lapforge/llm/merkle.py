"""Merkle manifest of a table: a tree per group, a tree over the groups, a proof for every row.

A level is a table of nodes (group key, index, digest). Each node finds its siblings by equijoins
on their computed indices: the run's slots are 0 to fanout - 1, and a node's k-th sibling sits at
slot (own + k) mod fanout, which for two is the index XOR 1. The slot-zero rows then have all
digests of their run and emit the parents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.operators.ordered import ordered
from lapforge.session import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field is ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    return digest(*[F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields])


def _level(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes of one level with their siblings' digests to the left and right, joined as text.

    A sibling past the end of the level does not exist and adds nothing.
    """
    slot, base = F.col("i") % fanout, F.col("i") - F.col("i") % fanout
    out = nodes
    for k in range(1, fanout):
        sib = F.col("i").bitwiseXOR(F.lit(1)) if fanout == 2 else base + (slot + k) % fanout
        other = nodes.select(F.col("g").alias(f"_g{k}"), F.col("i").alias(f"_i{k}"), F.col("d").alias(f"_d{k}"))
        out = out.withColumn("_at", sib).join(other, (F.col("g") == F.col(f"_g{k}")) & (F.col("_at") == F.col(f"_i{k}")), "left").drop("_at", f"_g{k}")
    found = [(F.col(f"_i{k}"), F.coalesce(f"_d{k}", F.lit(""))) for k in range(1, fanout)]
    side = lambda before: F.concat(*[  # noqa: E731  siblings by offset: those past the last slot come first
        F.when((i < F.col("i")) if before else (i > F.col("i")), d).otherwise(F.lit(""))
        for i, d in found])
    return out.select("g", "i", "n", "d", side(True).alias("left"), side(False).alias("right"))


def tree(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """All levels of every group's tree, leaves first.

    ``nodes``: ``g`` (group key, not null), ``i`` (index from 0), ``n`` (nodes of the group), ``d``
    (digest). A level is written as it is read both by the next level and by the proofs; their
    number is the logarithm of the largest group.
    """
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    levels = []
    while True:
        levels.append(written(_level(nodes, fanout), "level"))
        if most <= 1:
            return levels
        up = levels[-1].where((F.col("n") > 1) & (F.col("i") % fanout == 0))
        nodes = up.select("g", F.expr(f"i div {fanout}").alias("i"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), digest(F.col("d"), F.col("right")).alias("d"))
        most = -(-most // fanout)


def proofs(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``g``, ``i``, the columns of ``tops`` and ``proof`` of every leaf, from the roots down.

    ``tops`` has one row per group: ``g``, ``proof`` (what follows above the group's root) and
    further columns to hand down; further columns of a level stay on its nodes. A node's proof is
    its siblings followed by its parent's proof, so each level joins its parents on (group,
    index): a group of any size is spread over tasks, and proofs move once a level.
    """
    more = [c for c in tops.columns if c not in ("g", "proof")]
    own = F.array(F.struct("left", "right"))
    parents = None
    for level in reversed(levels):
        kept = ["g", "i", *[c for c in level.columns if c not in ("g", "i", "n", "d", "left", "right")]]
        here = level.where("n = 1").join(tops, "g").select(*kept, "proof", *more)
        if parents is not None:
            up = parents.select("g", F.col("i").alias("_p"), "proof", *more)
            below = level.where("n > 1").withColumn("_p", F.expr(f"i div {fanout}")).join(up, ["g", "_p"])
            here = below.select(*kept, F.concat(own, "proof").alias("proof"), *more).unionByName(here)
        parents = here
    return parents


def _roots(levels: list[DataFrame]) -> DataFrame:
    """One row per group: its key and the digest of its root."""
    out = levels[0].where("n = 1").select("g", "d")
    for level in levels[1:]:
        out = out.unionByName(level.where("n = 1").select("g", "d"))
    return out


def manifest(rows: DataFrame, group: str, order: Sequence[str], leaf: str, fanout: int = FANOUT) -> DataFrame:
    """Add ``subroot``, ``root`` and ``proof`` to rows that carry a digest column ``leaf``.

    Leaves ascend by ``order`` in their group, nulls first, rows equal there by digest. While a
    group has several nodes, every ``fanout`` neighbours become the digest of theirs. The groups'
    roots, ordered by group (null first, then by UTF-8 bytes), likewise give the root. ``proof``
    is one (left, right) a level from the leaf to the root: the digests of the node's siblings on
    both sides, joined.

    Repeated rows are leaves of their own, a null group is a group, an empty table gives no rows.
    Columns of ``rows`` named like a new one are replaced; all others pass through.
    """
    names = [c for c in rows.columns if c not in ("subroot", "root", "proof")]
    packed = rows.select(F.struct(*[rows[c] for c in names]).alias("r"))
    packed = written(packed.select("r", F.coalesce(F.concat(F.lit("="), F.col(f"r.{group}").cast("string")), F.lit("")).alias("g")), "rows")
    placed = ordered(packed, ["g"], [*[f"r.{c}" for c in order], f"r.{leaf}"]).position("i").totals(n=F.count(F.lit(1)))
    leaves = written(placed.df.select("r", "g", "i", "n"), "leaves")
    levels = tree(leaves.select("g", "i", "n", F.col(f"r.{leaf}").alias("d")), fanout)

    subroots = ordered(_roots(levels).withColumn("_all", F.lit("")), ["_all"], ["g"]).position("i").totals(n=F.count(F.lit(1))).df
    subroots = written(subroots.select("g", "i", "n", "d"), "subroots")
    upper = tree(subroots.select(F.lit("").alias("g"), "i", "n", "d"), fanout)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    top = _roots(upper).select("g", F.col("d").alias("root"), nothing.alias("proof"))
    above = proofs(upper, top, fanout).select("i", "root", "proof")
    tops = written(subroots.join(above, "i").select("g", F.col("d").alias("subroot"), "root", "proof"), "tops")
    levels[0] = levels[0].drop("d").join(leaves.select("g", "i", "r"), ["g", "i"])
    return proofs(levels, tops, fanout).select(*[F.col(f"r.{c}") for c in names], "subroot", "root", "proof")


def siblings(proof: Column) -> Column:
    """The sibling digests of a proof from the leaf up, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda acc, p: digest(p["left"], acc, p["right"]))
