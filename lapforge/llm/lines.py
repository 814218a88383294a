"""Line dedup: fuzzy lines by MinHash over character shingles, one line kept for each component.

Only DataFrame functions are used. Distinct lines are found first; the table of them is bucketed
by line, so that later joins by line move no text. A line's signature is taken from all its
shingles: each of ``BANDS * ROWS`` values is the least shingle hash under another XOR mask.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.llm.common import held
from lapforge.operators.clean import HOT_ROWS, salted_lookup
from lapforge.operators.cluster import components
from lapforge.session import by_key, new_path, shuffles_freed, tables_dropped, written

SHINGLE = 10
BANDS = 6
ROWS = 3
SIMILAR = 0.8
STEP = 8
CELL = 1024
HEAD = 16
_GOLDEN = 0x9E3779B97F4A7C15


def _line_key() -> list[Column]:
    """Two hashes of a trimmed line; null for a blank line, which is never a duplicate."""
    line = F.when(F.col("_l") != "", F.col("_l"))
    return [F.when(line.isNotNull(), F.xxhash64(line)).alias("h1"), F.when(line.isNotNull(), F.xxhash64(F.lit(1), line)).alias("h2")]


def line_rows(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``k`` (hash of the text), ``pos`` and ``_l`` (line without outer white space) of every line."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    rows = docs.select("doc_id", F.xxhash64("_t").alias("k"), F.posexplode_outer(F.split("_t", "\n")).alias("pos", "_raw"))
    # A trim walks through the whole line, and few lines have white space at an end.
    ends = reduce(or_, [at(c) for c in " \t\r" for at in (F.col("_raw").startswith, F.col("_raw").endswith)])
    line = F.when(ends, F.expr(r"trim(BOTH ' \t\r' FROM _raw)")).otherwise(F.col("_raw"))
    return rows.select("doc_id", "k", "pos", line.alias("_l"))


def _table_of(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def distinct_lines(documents: DataFrame) -> DataFrame:
    """``h1``, ``h2``, ``l``, the first occurrence (by id, then text hash, then place) and the count ``n``."""
    spark = documents.sparkSession
    rows = line_rows(documents).select("doc_id", "k", "pos", "_l", *_line_key()).where("h1 is not null")
    lines = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "k", "pos")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("_l").alias("l"))
    path, buckets = new_path(spark, "lines"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _table_of(path)
    with shuffles_freed(spark):
        lines.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "h1", "h2").saveAsTable(name)
    return spark.table(name)


def band_keys(lines: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``h1``, ``h2`` and ``keys``, one for each band.

    A shingle is a run of ``shingle`` code points; a shorter line is one shingle. A row of the
    working table holds ``STEP`` neighbouring shingles, the last ones again at a line's end.
    """
    d = lines.select("h1", "h2", held(F.struct(F.encode("l", "UTF-32").alias("b"), F.greatest(F.length("l") - shingle, F.lit(0)).alias("last"))).alias("_x"))
    d = d.select("h1", "h2", "_x.b", "_x.last")
    d = d.select("h1", "h2", "b", "last", F.explode_outer(F.sequence(F.lit(0), F.expr(f"last div {STEP}").cast("int"))).alias("i"))
    at = lambda j: F.least(F.col("i") * STEP + j, F.col("last")) * 4 + 1
    d = d.select("h1", "h2", *[F.xxhash64(F.substring("b", at(j), F.lit(4 * shingle))).alias(f"s{j}") for j in range(STEP)])
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    masks = [signed(_GOLDEN * (c + 1)) for c in range(bands * rows)]
    least = lambda m: F.min(F.least(*[F.col(f"s{j}").bitwiseXOR(F.lit(m)) for j in range(STEP)]))
    sig = d.groupBy("h1", "h2").agg(*[least(m).alias(f"m{c}") for c, m in enumerate(masks)])
    keys = [F.xxhash64(F.lit(b), *[F.col(f"m{b * rows + r}") for r in range(rows)]) for b in range(bands)]
    return sig.select("h1", "h2", F.array(*keys).alias("keys"))


def _shingle_sets(rows: DataFrame, ids: list[str], lines: dict[str, str], shingle: int) -> DataFrame:
    """``ids`` and, for each of the columns ``lines``, the array of its distinct shingle hashes under the name it maps to.

    A line's code points are a lambda's variable, as a column's bytes would be copied for every shingle.
    """
    def hashes(line: str) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(line) - shingle, F.lit(0)) * 4 + 1, F.lit(4))
        return F.transform(F.array(F.encode(line, "UTF-32")), lambda b: F.transform(starts, lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * shingle)))))[0]

    sets = [F.array_distinct(hashes(line)).alias(name) for line, name in lines.items()]
    return rows.select(*ids, held(F.struct(*sets)).alias("_x")).select(*ids, "_x.*")


def _verified(pairs: DataFrame, lines: DataFrame, similar: float, shingle: int) -> DataFrame:
    """Those of ``pairs`` (h1, h2, a1, a2) whose shingle sets reach ``similar``, as links ``a``, ``b``.

    All shingles of both lines are compared, each pair's in the partition that the join left it in.
    """
    text = lines.select("h1", "h2", "l")
    pairs = pairs.join(text, ["h1", "h2"]).withColumnRenamed("l", "_la")
    pairs = pairs.join(text.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("l").alias("_lb")), ["a1", "a2"])
    ids = ["a1", "a2", "h1", "h2"]
    sets = _shingle_sets(pairs, ids, {"_la": "sa", "_lb": "sb"}, shingle)
    sizes = sets.select(*ids, held(F.struct(F.size(F.array_intersect("sa", "sb")).alias("n"), (F.size("sa") + F.size("sb")).alias("all"))).alias("_x"))
    good = sizes.where(F.col("_x.n") >= similar * (F.col("_x.all") - F.col("_x.n")))
    return good.select(_node("a1", "a2").alias("a"), _node("h1", "h2").alias("b"))


def _node(p: str, q: str) -> Column:
    return F.struct(F.col(p).alias("h1"), F.col(q).alias("h2"))


def _linked(links: DataFrame) -> DataFrame:
    """``h1``, ``h2`` and the component's ``label`` of every line that has a link."""
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    return components(nodes, links).select("node.h1", "node.h2", "label")


def _regrouped(groups: DataFrame, found: DataFrame) -> DataFrame:
    """``groups`` (h1, h2, label), as of ``_linked``, with the links ``found`` added.

    Only the groups that a new link joins are gone through again.
    """
    limit = int(found.sparkSession.conf.get("spark.lapforge.hotRows", str(HOT_ROWS)))
    hot = found.count() > limit
    seen = found
    for end, other in (("a", "b"), ("b", "a")):
        side = groups.select(_node("h1", "h2").alias(end), F.col("label").alias(f"_l{end}"))
        seen = salted_lookup(seen, side, [end], F.col(other), "left", selective=True) if hot else seen.join(by_key(side), end, "left")
    seen = written(seen.select("a", "b", "_la", "_lb"), "found")
    edges = written(seen.select(F.coalesce("_la", "a").alias("a"), F.coalesce("_lb", "b").alias("b")).where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    moved = components(nodes, edges).select(F.col("node").alias("label"), F.col("label").alias("_to"))
    fresh = seen.where("_la is null").select(F.col("a").alias("label")).union(seen.where("_lb is null").select(F.col("b").alias("label"))).distinct()
    groups = groups.union(fresh.select("label.h1", "label.h2", "label"))
    groups = salted_lookup(groups, moved, ["label"], F.col("h1"), "left", selective=True)
    return written(groups.select("h1", "h2", F.coalesce("_to", "label").alias("label")), "groups")


def _labelled(rows: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``label``; a line without a link is a component of its own. ``by`` differs among a line's rows."""
    rows = salted_lookup(rows, groups, ["h1", "h2"], F.col(by), "left", selective=True)
    return rows.withColumn("label", F.coalesce("label", F.struct("h1", "h2")))


def _postings(crowd: DataFrame, lines: DataFrame, similar: float, shingle: int) -> DataFrame:
    """Each line of ``crowd`` (h1, h2, keys) at the rarest of its shingles: ``s``, its place ``at`` and their number ``size``.

    Two lines with ``similar`` share one of the first size - similar * size + 1 shingles of each, in
    any order common to all; rare ones come first, so lines of one template seldom meet.
    """
    sets = _shingle_sets(crowd.join(lines.select("h1", "h2", "l"), ["h1", "h2"]), ["h1", "h2"], {"l": "has"}, shingle)
    has = written(sets.select("h1", "h2", F.size("has").alias("size"), F.explode("has").alias("s")), "shingles")
    # A shingle of one line alone only moves the others' places back.
    shared = written(has.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    d = salted_lookup(has, shared, ["s"], F.col("h1"), "inner", selective=True)
    own = Window.partitionBy("h1", "h2")
    d = d.select("h1", "h2", "s", "size", (F.row_number().over(own.orderBy("df", "s")) + F.col("size") - F.count(F.lit(1)).over(own)).alias("at"))
    d = d.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * similar - 1e-9) + 1)
    return written(d.join(crowd.select("h1", "h2", "keys"), ["h1", "h2"]), "postings")


def _posting_hits(posts: DataFrame, similar: float, cell: int, star: bool) -> DataFrame:
    """Pairs (h1, h2, a1, a2) of lines that share a band and a posting's shingle and have two labels.

    Lines of a posting's commonest label need no pairs among themselves, so only its other lines
    meet all lines: in cells of parts dealt by hash, each of ``cell`` lines or so a side. With
    ``star`` they meet one line of the posting only, in every posting another by hash: pairs no
    more than the postings, which link most of a family as random pairs of it do.

    Otherwise a pair is made in one posting, not in all it shares: that of its first shingle in
    common, if both lines have it among their first ``HEAD`` postings here. A posting that holds two
    labels is never left out, so these are all that a pair with two labels can share.
    """
    counts = posts.groupBy("s", "label").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.groupBy("s").agg(F.max_by("label", F.struct("n", "label")).alias("big"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("few")).where("few > 0")
    rows = written(salted_lookup(posts, written(stats, "stats"), ["s"], F.col("h1"), "inner", selective=True), "posts")
    side = F.struct("h1", "h2", "label", "keys", "at", "size")
    if not star:
        head = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("at", "s"))), 1, HEAD), lambda x: x["s"])
        rows = written(rows.join(rows.groupBy("h1", "h2").agg(head.alias("head")), ["h1", "h2"]), "posts")
        side = F.struct("h1", "h2", "label", "keys", "at", "size", "head")
    few = rows.where("label <> big")
    if star:
        hub = rows.groupBy("s").agg(F.min_by(side, F.xxhash64("s", "h1", "h2")).alias("q"))
        met = salted_lookup(few.select("s", "big", side.alias("p")), hub, ["s"], F.col("p.h1"), "inner", selective=True)
    else:
        pa, pb = F.ceil(F.col("few") / cell).cast("int"), F.ceil(F.col("all") / cell).cast("int")
        deal = lambda n: F.pmod(F.xxhash64("h1", "h2"), n).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = few.select("s", "big", deal(pa).alias("i"), upto(pb).alias("j"), side.alias("p"))
        right = rows.select("s", upto(pa).alias("i"), deal(pb).alias("j"), side.alias("q"))
        met = left.join(right, ["s", "i", "j"])
    p, q = F.col("p"), F.col("q")
    own, other = F.struct("p.h1", "p.h2"), F.struct("q.h1", "q.h2")
    # The first shingle in common bounds the number in common, which 1 + similar of the sum of sizes asks for.
    most = F.least(p["size"] - p["at"], q["size"] - q["at"]) + 1
    # Two of the other lines meet in both orders, but for a star.
    met = met.where((p["label"] != q["label"]) & ((q["label"] == F.col("big")) | (own != other if star else own < other))
                    & (most * (1 + similar) >= (p["size"] + q["size"]) * similar - 1e-9) & F.arrays_overlap("p.keys", "q.keys"))
    if not star:
        first = F.get(F.filter(p["head"], lambda x: F.array_contains(q["head"], x)), F.lit(0))
        met = met.where(F.coalesce(first == F.col("s"), F.lit(True)))
    met = met.select(F.least(own, other).alias("_p"), F.greatest(own, other).alias("_q"))
    return met.select(F.col("_p.h1").alias("h1"), F.col("_p.h2").alias("h2"), F.col("_q.h1").alias("a1"), F.col("_q.h2").alias("a2"))


def _posting_pairs(posts: DataFrame, similar: float, cell: int, star: bool) -> DataFrame:
    """The pairs of ``_posting_hits``, each once."""
    return _posting_hits(posts, similar, cell, star).distinct()


def line_groups(lines: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, cell: int = CELL) -> DataFrame:
    """``h1``, ``h2`` and the component's ``label`` of every line linked to one whose shingle set reaches ``similar``.

    Lines that share a band's key are candidates, and the components are those of the links of all
    such pairs. Each member of a bucket first meets its least and greatest line, in every band; up
    to three members that is every pair. Members of larger buckets that are then still in more than
    one component meet where they share one of their rarest shingles, as any two with ``similar``
    do; pairs already in one component are left out. Every link is verified on the whole lines. A
    pair of similarity 0.8 shares a band with probability 0.986 (0.9: 0.9996).
    """
    keyed = written(band_keys(lines, shingle, bands, rows), "bands")
    members = keyed.select("h1", "h2", F.explode("keys").alias("key"))
    full = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("h1").alias("lo1"), F.min_by("h2", "h1").alias("lo2"), F.max("h1").alias("hi1"), F.max_by("h2", "h1").alias("hi2")).where("m > 1")
    met = written(members.join(full, "key"), "met")
    ends = F.explode(F.array(F.struct(F.col("lo1").alias("a1"), F.col("lo2").alias("a2")), F.struct(F.col("hi1").alias("a1"), F.col("hi2").alias("a2"))))
    pairs = met.select("h1", "h2", ends.alias("_e")).where("h1 <> _e.a1 or h2 <> _e.a2")
    own, other = F.struct("h1", "h2"), F.struct(F.col("_e.a1").alias("h1"), F.col("_e.a2").alias("h2"))
    pairs = pairs.select(F.least(own, other).alias("_p"), F.greatest(own, other).alias("_q"))
    pairs = pairs.select(F.col("_p.h1").alias("h1"), F.col("_p.h2").alias("h2"), F.col("_q.h1").alias("a1"), F.col("_q.h2").alias("a2")).distinct()
    links = written(_verified(pairs, lines, similar, shingle), "links")
    crowded = written(met.where("m > 3").select("h1", "h2", "key"), "crowded")
    if not crowded.limit(1).count():
        return _linked(links)
    groups = written(_linked(links), "groups")
    crowded = written(_labelled(crowded, groups, "key"), "crowded")
    mixed = crowded.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    crowd = salted_lookup(crowded, written(mixed, "mixed"), ["key"], F.col("h1"), "inner", selective=True)
    crowd = written(crowd.groupBy("h1", "h2").agg(F.collect_list("key").alias("keys")), "crowd")
    texts = written(lines.select("h1", "h2", "l").join(by_key(crowd.select("h1", "h2")), ["h1", "h2"]), "texts")
    posts = _postings(crowd, texts, similar, shingle)
    for star in (True, False):
        found = written(_verified(_posting_pairs(_labelled(posts, groups, "s"), similar, cell, star), texts, similar, shingle), "links")
        groups = _regrouped(groups, found)
    return groups


def removed_lines(documents: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``k`` and ``removed``: (line, keeper_doc, keeper_line) of every line that goes."""
    lines = distinct_lines(documents)
    groups = line_groups(lines, **options)
    slim = lines.select("h1", "h2", "first", "n").join(groups, ["h1", "h2"], "left").where("n > 1 or label is not null")
    slim = slim.withColumn("label", F.coalesce("label", F.struct("h1", "h2")))
    keeper = slim.groupBy("label").agg(F.min("first").alias("keeper"))
    fate = written(slim.select("h1", "h2", "label").join(keeper, "label").drop("label"), "fate")
    seen = line_rows(documents).select("doc_id", "k", "pos", *_line_key()).where("h1 is not null")
    seen = salted_lookup(seen, fate, ["h1", "h2"], F.xxhash64("doc_id", "k", "pos"), "inner", selective=True)
    gone = seen.where(~F.struct("doc_id", "k", "pos").eqNullSafe(F.col("keeper"))).distinct()
    item = F.struct(F.col("pos").alias("line"), F.col("keeper.doc_id").alias("keeper_doc"), F.col("keeper.pos").alias("keeper_line"))
    return gone.groupBy("doc_id", "k").agg(F.sort_array(F.collect_list(item)).alias("removed"))


def _written_removed(documents: DataFrame, **options) -> DataFrame:
    """``removed_lines`` as a table; those written on the way, with the lines' texts, are dropped."""
    spark = documents.sparkSession
    with tables_dropped(spark) as made:
        removed = written(removed_lines(documents, **options), "removed")
        made.pop()
        for path in made:
            if "/lapforge-lines-" in path:
                spark.sql(f"DROP TABLE {_table_of(path)}")
    return removed


def _with_removed(docs: DataFrame, removed: DataFrame) -> DataFrame:
    r = removed.withColumnsRenamed({"doc_id": "_r_id", "k": "_r_k"})
    return docs.join(r, docs["doc_id"].eqNullSafe(r["_r_id"]) & (docs["_k"] == r["_r_k"]), "left").drop("_r_id", "_r_k")


def line_report(documents: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_kept`` and ``removed`` (line, keeper_doc, keeper_line) of every row.

    Equal lines (but for white space at both ends) and fuzzy lines form components over the whole
    table; the first line of each stays: smallest doc_id (null first), then text hash, then place.
    Blank lines stay. A null text counts as empty, which is one blank line. Rows equal in id and
    text are one document and are returned as often as they occur.
    """
    removed = _written_removed(documents, **options)
    text = F.coalesce("text", F.lit(""))
    docs = documents.select("doc_id", F.xxhash64(text).alias("_k"), F.size(F.split(text, "\n")).alias("n_lines"))
    out = _with_removed(docs, removed)
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.coalesce(F.size("removed"), F.lit(0))).alias("n_kept"), F.coalesce("removed", F.array().cast("array<struct<line:int,keeper_doc:bigint,keeper_line:int>>")).alias("removed"))


def dedup_lines(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with the text of the lines that stay and ``n_chars`` to match.

    Every row stays, also when all its lines are gone. A row that loses no line is unchanged. The
    other columns, whatever their names, are as they were.
    """
    removed = _written_removed(documents, **options)
    cols = documents.columns
    docs = documents.select(F.struct(*cols).alias("_d"), F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_k"))
    out = _with_removed(docs, removed)
    lines = F.split(F.col("_d.text"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed.line"))
    out = out.select("_d", "removed", F.explode_outer(F.array(F.struct(lines.alias("l"), F.when(F.col("removed").isNotNull(), stay).alias("s")))).alias("_x"))
    text = F.when(F.col("removed").isNull(), F.col("_d.text")).otherwise(F.array_join(F.transform("_x.s", lambda i: F.get(F.col("_x.l"), i)), "\n"))
    out = out.select("_d", text.alias("_text"), F.col("removed").isNotNull().alias("_cut"))
    put = {"text": F.col("_text"), "n_chars": F.when(F.col("_cut"), F.length("_text").cast("long")).otherwise(F.col("_d.n_chars")) if "n_chars" in cols else None}
    return out.select(*[put[c].alias(c) if c in put else F.col(f"_d.{c}").alias(c) for c in cols])
