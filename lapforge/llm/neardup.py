"""SimHash near-duplicates: BK-trees over shards of fingerprints, then connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.llm.common import hex64, majority, vote_sums, word_rows
from lapforge.operators.clean import salted_lookup
from lapforge.operators.cluster import components
from lapforge.session import written

RADIUS = 2
SHINGLE = 3
SHARD_ROWS = 20_000


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        node, at = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while node:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = node
                break
            at = self.children[at][d]
        return node

    def near(self, value: int, radius: int) -> list[int]:
        """Nodes within ``radius``; by the triangle inequality no other edge can lead to one."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    open_.append(child)
        return found


def shard_links(fps: list[int], sides: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect all fingerprints of a cell as its pairs within ``radius`` do.

    Side 0 is put into the tree. In a cell of one shard (no side 1) every fingerprint asks the
    tree before it joins; in a cell of two shards side 1 asks the tree of side 0. A link that
    closes a circle inside the cell is left out, so a cell of n rows gives less than n links.
    """
    tree, root = BKTree(), {f: f for f in fps}

    def top(f: int) -> int:
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    links, one = [], 1 not in sides
    for fp, side in sorted(zip(fps, sides), key=lambda x: x[1]):
        if one or side:
            for node in tree.near(fp, radius):
                a, b = top(tree.values[node]), top(fp)
                if a != b:
                    root[b] = a
                    links.append((tree.values[node], fp))
        if not side:
            tree.add(fp)
    return links


def _linker(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for fps, sides in zip(batch["fps"], batch["sides"]):
                out += shard_links([int(x) for x in fps], [int(x) for x in sides], radius)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (``a``, ``b``) among distinct fingerprints (column ``fp``, no nulls or repeats).

    Their connected components are those of all pairs within ``radius`` bits. Fingerprints that
    near agree in one of ``radius + 1`` blocks, so a shard holds those that share a block's value
    and only its own tree can match. A shard above ``shard_rows`` is dealt into parts by hash, and
    the tree of each part is sent to every part after it, so a cell has 2 x ``shard_rows`` rows or
    so however many share the value. A broadcast of all trees would have no bound.
    """
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    keys = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft(F.col("fp"), 64 - hi), 64 - hi + lo).alias("value"))
            for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("_k")).select("fp", "_k.block", "_k.value")
    crowded = rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = written(crowded.select("block", "value", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts")), "shards")
    rows = salted_lookup(rows, crowded, ["block", "value"], F.col("fp"), "inner", selective=True)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    cells = F.concat(
        F.transform(F.sequence(F.col("part"), F.col("parts") - 1), lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.lit(0).alias("side"))),
        F.transform(F.sequence(F.lit(0), F.col("part")), lambda i: F.struct(i.alias("i"), F.col("part").alias("j"), F.when(i == F.col("part"), 0).otherwise(1).alias("side"))),
    )
    rows = rows.select("block", "value", "fp", F.explode(F.array_distinct(cells)).alias("_c")).select("block", "value", "_c.i", "_c.j", "fp", "_c.side")
    shards = rows.groupBy("block", "value", "i", "j").agg(F.collect_list(F.struct("fp", "side")).alias("_m"))
    shards = shards.select(F.col("_m.fp").alias("fps"), F.col("_m.side").alias("sides"))
    return shards.mapInPandas(_linker(radius), "a long, b long")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp`` for every row; see ``near_duplicates``."""
    rows = documents.select(*keep, "text").withColumn("_row", F.monotonically_increasing_id())
    terms = word_rows(rows, "text", ["_row", *keep], shingle)
    terms = terms.select("_row", *keep, F.xxhash64("term").alias("_h"), F.col("term").isNotNull().cast("long").alias("_n"))
    votes = terms.groupBy("_row", *keep).agg(F.sum("_n").alias("_t"), *vote_sums(F.col("_h"), F.col("_n")))
    return votes.select(*keep, majority(F.col("_t")).alias("fp"))


def _classes(prints: DataFrame, first: Column, radius: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """Each ``fp`` with its component's ``label``, and each label with the least ``first`` of its rows."""
    classes = written(prints.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    links = written(near_links(classes.select("fp"), radius, shard_rows), "links")
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    groups = components(ends, links)
    named = classes.join(groups, classes["fp"] == groups["node"], "left").withColumn("label", F.coalesce("label", "fp"))
    return named.select("fp", "label"), named.groupBy("label").agg(F.min("first").alias("first"))


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text after lower-casing A-Z; terms are runs
    of ``shingle`` words with repeats (fewer words: all of them), hashed by XXH64 with seed 42. A
    bit is set when over half the terms have it. Null texts and texts without words have the
    fingerprint zero and link like any other. ``component_id`` is the smallest ``doc_id`` that can
    be reached over links of ``radius`` bits; null ids never win, so it is null only when all ids
    of the component are null. Repeated rows are kept. An empty table gives an empty result.
    """
    prints = written(fingerprints(documents, shingle), "prints")
    named, roots = _classes(prints, F.col("doc_id"), radius, shard_rows)
    roots = roots.withColumnRenamed("first", "component_id")
    of = salted_lookup(named, roots, ["label"], F.col("fp"), "inner", selective=True).select("fp", "component_id")
    out = salted_lookup(prints, of, ["fp"], F.xxhash64("doc_id"), "inner", selective=True)
    return out.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One document of each component, in the columns it came with.

    It is the one with the smallest id (null last), then the smallest hash of the text. Ids need
    not be unique or known: a row is known by id and text, so texts without a link stay. Rows equal
    in both are one document, of which the one with the smallest hash of all columns stays.
    """
    cols = documents.columns
    key = F.xxhash64("text").alias("_k")
    prints = written(fingerprints(documents.select("doc_id", "text", key), shingle, ["doc_id", "_k"]), "prints")
    _, roots = _classes(prints, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_k"), radius, shard_rows)
    first = roots.select(F.col("first.doc_id").alias("_id"), F.col("first._k").alias("_k2"))
    rows = documents.select(F.struct(*cols).alias("_d"), "doc_id", key)
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_k2")), "left_semi")
    hashed = [F.col("_d")[c] for c in cols if "map<" not in documents.schema[c].dataType.simpleString()]
    return kept.groupBy("doc_id", "_k").agg(F.min_by("_d", F.xxhash64(*hashed)).alias("_d")).select("_d.*")
