"""Ordered rows cut into equal blocks: the base of every time-ordered operator.

A plain ``Window.partitionBy(session).orderBy(t)`` puts a whole session into one task. One
recording can hold a third of a fleet's rows, so ordered work here runs on blocks instead:

* the table is range-partitioned on (keys, order) once, sorted and written, which gives
  every row a dense global position ``_g`` and splits a hot key like any other rows;
* a block is ``_g div block_rows``; windows partition by (keys, block);
* bounded frames (lag, lead, rolling) copy a few edge rows into the neighbour block;
* unbounded frames (running sums, fills) join a carry computed from one row per block;
* whole-key aggregates are combined map-side and joined back per (key, block).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.session import block_rows, written

G = "_g"
B = "_b"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in its low 33 bits

WindowExpr = Callable[[Window], Column]


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> "Ordered":
    """Sort ``df`` by (keys, order) and number its rows. ``order`` should be unique in a key."""
    spark = df.sparkSession
    cols = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    placed = written(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_m", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("_m", _ROW_BITS)
    # One row per range partition: bounded by the partition count, not by the data.
    counts = placed.groupBy(part.alias("p")).count().orderBy("p").collect()
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["p"], total))
        total += row["count"]
    table = spark.createDataFrame(offsets, "_p long, _off long")
    rows = (
        placed.withColumn("_p", part)
        .join(table, "_p")
        .withColumn(G, F.col("_off") + F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_p", "_off", "_m")
    )
    return Ordered(rows, keys, block_rows(spark))


class Ordered:
    """A DataFrame with the dense position column ``_g`` inside keys; rows stay lazy.

    Between steps the rows may keep their block column, so that a running step after a framed
    one works in the partitions it finds instead of shuffling again.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], rows: int | None = None):
        self._d = df
        self.keys = list(keys)
        self.rows = rows or block_rows(df.sparkSession)

    @property
    def df(self) -> DataFrame:
        return self._d.drop(B)

    def _blocked(self) -> DataFrame:
        return self._d if B in self._d.columns else self._d.withColumn(B, self._block())

    # -- plain row work --------------------------------------------------------------
    def map(self, fn: Callable[[DataFrame], DataFrame]) -> "Ordered":
        """Apply a row-wise step (projection or filter) that keeps keys and ``_g``."""
        return Ordered(fn(self._d), self.keys, self.rows)

    def cols(self, **exprs: Column) -> "Ordered":
        return self.map(lambda d: d.withColumns(exprs))

    def where(self, cond: Column | str) -> "Ordered":
        return self.map(lambda d: d.where(cond))

    def cut(self) -> "Ordered":
        """Write the rows so that later carry joins do not recompute what came before."""
        return Ordered(written(self.df), self.keys, self.rows)

    def renumber(self) -> "Ordered":
        """Dense positions again after a filter."""
        return ordered(self.df.withColumnRenamed(G, "_old"), self.keys, ["_old"]).map(
            lambda d: d.drop("_old")
        )

    def rekey(self, keys: Sequence[str]) -> "Ordered":
        """Group the same order by other keys (a key that follows the order, such as lap)."""
        return Ordered(self._d, keys, self.rows)

    def out(self, *cols: str | Column) -> DataFrame:
        return self._d.select(*cols) if cols else self.df.drop(G)

    def _block(self, rows: int | None = None) -> Column:
        return F.expr(f"{G} div {rows or self.rows}")

    # -- bounded frames --------------------------------------------------------------
    def over(self, *stages: dict[str, WindowExpr], before: int = 1, after: int = 0) -> "Ordered":
        """Add window columns whose frames reach at most ``before``/``after`` rows away.

        Later stages see the columns of earlier ones; the halo must cover their sum.
        """
        size = max(self.rows, before + after, 1)
        own = self._block(size)
        homes = [own]
        if before:
            homes.append(F.when(F.expr(f"{G} % {size} >= {size - before}"), own + 1))
        if after:
            homes.append(F.when(F.expr(f"{G} % {size} < {after}"), own - 1))
        if len(homes) > 1:
            d = self.df.withColumn(B, F.explode(F.array_compact(F.array(*homes))))
        else:
            d = self._blocked() if size == self.rows else self.df.withColumn(B, own)
        w = Window.partitionBy(*self.keys, B).orderBy(G)
        for stage in stages:
            d = d.withColumns({name: fn(w) for name, fn in stage.items()})
        d = d.where(F.col(B) == own)
        return Ordered(d if size == self.rows else d.drop(B), self.keys, self.rows)

    def lag(self, before: int = 1, **exprs: Column | str) -> "Ordered":
        return self.over(
            {n: (lambda e: lambda w: F.lag(e, before).over(w))(e) for n, e in exprs.items()},
            before=before,
        )

    def lead(self, after: int = 1, **exprs: Column | str) -> "Ordered":
        return self.over(
            {n: (lambda e: lambda w: F.lead(e, after).over(w))(e) for n, e in exprs.items()},
            before=0,
            after=after,
        )

    # -- unbounded frames ------------------------------------------------------------
    def running(self, exclusive: bool = False, **specs: tuple[str, Column | str]) -> "Ordered":
        """Running aggregates from the start of the key up to each row.

        ``specs`` maps a new column to (kind, expression); kinds are sum, count, max, min,
        last (latest non-null so far), next (earliest non-null from here on) and total (the
        sum over the whole key, from the same carries).
        """
        exprs = {n: (k, F.col(e) if isinstance(e, str) else e) for n, (k, e) in specs.items()}
        d = self._blocked()
        part = Window.partitionBy(*self.keys, B).orderBy(G)
        edge = -1 if exclusive else 0
        past = part.rowsBetween(Window.unboundedPreceding, edge)
        # Looking ahead is looking back in the reverse order: frames that end at the last row are
        # computed anew for every row.
        future = Window.partitionBy(*self.keys, B).orderBy(F.desc(G)).rowsBetween(Window.unboundedPreceding, edge)
        ws = Window.partitionBy(*self.keys).orderBy(B)
        before = ws.rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*self.keys).orderBy(F.desc(B)).rowsBetween(Window.unboundedPreceding, -1)
        whole = ws.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        local, partial, carry, merged = {}, [], [], {}
        for name, (kind, e) in exprs.items():
            p, c = F.col(f"_p_{name}"), F.col(f"_c_{name}")
            if kind in ("sum", "count", "max", "min"):
                agg = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind]
                again = F.sum if kind in ("sum", "count") else agg
                local[name] = agg(e).over(past)
                partial.append(agg(e).alias(f"_p_{name}"))
                carry.append(again(p).over(before).alias(f"_c_{name}"))
                here = F.col(name)
                if kind in ("sum", "count"):
                    merged[name] = F.coalesce(here + c, here, c)
                else:
                    merged[name] = (F.greatest if kind == "max" else F.least)(here, c)
            elif kind == "total":
                partial.append(F.sum(e).alias(f"_p_{name}"))
                carry.append(F.sum(p).over(whole).alias(f"_c_{name}"))
                merged[name] = c
            elif kind == "last":
                local[name] = F.last(e, True).over(past)
                partial.append(F.max_by(e, F.when(e.isNotNull(), F.col(G))).alias(f"_p_{name}"))
                carry.append(F.last(p, True).over(before).alias(f"_c_{name}"))
                merged[name] = F.coalesce(F.col(name), c)
            elif kind == "next":
                local[name] = F.last(e, True).over(future)
                partial.append(F.min_by(e, F.when(e.isNotNull(), F.col(G))).alias(f"_p_{name}"))
                carry.append(F.last(p, True).over(after).alias(f"_c_{name}"))
                merged[name] = F.coalesce(F.col(name), c)
            else:
                raise ValueError(f"unknown running kind {kind}")
        on = [*self.keys, B]
        carries = d.groupBy(*on).agg(*partial).select(*on, *carry)
        d = d.withColumns(local) if local else d
        joined = d.join(carries, on, "left").withColumns(merged)
        return Ordered(joined.drop(*[f"_c_{n}" for n in exprs]), self.keys, self.rows)

    # -- whole keys ------------------------------------------------------------------
    def attach(self, per_key: DataFrame) -> "Ordered":
        """Join one row per key onto all rows of the key, spread over the key's blocks."""
        on = [*self.keys, B]
        d = self._blocked()
        spread = d.select(*on).distinct().join(per_key, self.keys)
        return Ordered(d.join(spread, on, "left"), self.keys, self.rows)

    def totals(self, **aggs: Column) -> "Ordered":
        """Per-key aggregates on every row of the key."""
        return self.attach(self.df.groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggs.items()]))

    def position(self, name: str = "i") -> "Ordered":
        """Zero-based row number inside the key."""
        return self.totals(_start=F.min(G)).map(
            lambda d: d.withColumn(name, F.col(G) - F.col("_start")).drop("_start")
        )

    # -- runs ------------------------------------------------------------------------
    def islands(self, value: Column, name: str = "island") -> "Ordered":
        """Number the runs of equal ``value`` inside each key (first run is 1)."""
        return (
            self.cols(_val=value)
            .over({"_was": lambda w: F.lag("_val").over(w), "_rn": lambda w: F.lag(F.lit(1)).over(w)})
            .cols(_new=(F.col("_rn").isNull() | ~F.col("_val").eqNullSafe(F.col("_was"))).cast("int"))
            .running(**{name: ("sum", "_new")})
            .map(lambda d: d.drop("_val", "_was", "_rn", "_new"))
        )

    # -- sequential state ------------------------------------------------------------
    def fold(
        self,
        inputs: Sequence[str],
        init: Sequence[float | None],
        step: Callable[[list, tuple], tuple],
        outputs: str,
    ) -> "Ordered":
        """Run a small state machine over each key and add its output columns.

        ``step(state, row)`` returns ``(state, output)`` where state is a list of numbers or
        None. Blocks run in parallel, row by row over Arrow batches; other columns pass through
        untouched. A block's entry state is the exit state of the block before it; blocks whose
        guessed entry was wrong are run again until none changes, so the result equals one pass
        over the whole key and no task ever holds a whole key.
        """
        init = [None if v is None else float(v) for v in init]
        kin = [f.name for f in self.df.schema if f.name in self.keys]
        on = [*kin, B]
        src = self._blocked()
        key_types = ", ".join(f"`{k}` {self.df.schema[k].dataType.simpleString()}" for k in kin)
        empty = F.array(*[F.lit(v).cast("double") for v in init])

        def spread(d: DataFrame) -> DataFrame:
            n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            return d.repartition(n, *on).sortWithinPartitions(*on, G)

        ends = src.groupBy(*kin).agg(F.min(B).alias("lo"), F.max(B).alias("hi"))
        if ends.where("hi > lo").limit(1).count():
            slim = src.select(*on, G, *[c for c in inputs if c not in kin])
            exit_schema = f"{key_types}, {B} long, _entry array<double>, _exit array<double>"
            todo, done = src.select(*on).distinct().withColumn("_entry", empty), None
            while True:
                ran = spread(slim.join(todo, on)).mapInArrow(_exits(on, inputs, init, step), exit_schema)
                if done is not None:
                    ran = ran.unionByName(done.join(todo.select(*on), on, "left_anti"))
                done = written(ran, "fold")
                was = Window.partitionBy(*kin).orderBy(B)
                wanted = done.select(
                    *on, "_entry", F.coalesce(F.lag("_exit").over(was), empty).alias("_want")
                )
                todo = wanted.where(~F.col("_want").eqNullSafe(F.col("_entry"))).select(
                    *on, F.col("_want").alias("_entry")
                )
                if not todo.limit(1).count():
                    break
            src = src.join(done.select(*on, "_entry"), on)
        else:
            src = src.withColumn("_entry", F.lit(None).cast("array<double>"))
        base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
        names = [c.split()[0] for c in outputs.split(",")]
        types = [_ARROW[c.split()[1]] for c in outputs.split(",")]
        rows = spread(src).mapInArrow(_emit(on, inputs, init, step, names, types), f"{base}, {outputs}")
        return Ordered(rows.drop(B, "_entry"), self.keys, self.rows)


_ARROW = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def _walk(on, inputs, init, step, state_box):
    """Outputs of one Arrow batch; ``state_box`` carries (block, entry, state) between batches."""

    def run(batch):
        ids = list(zip(*[batch.column(c).to_pylist() for c in on]))
        rows = zip(*[batch.column(c).to_pylist() for c in inputs])
        entries = batch.column("_entry")
        at, entry, state = state_box
        got, closed = [], []
        for n, (block, row) in enumerate(zip(ids, rows)):
            if block != at:
                if at is not None:
                    closed.append((at, entry, state))
                at = block
                given = entries[n].as_py()
                entry = init if given is None else given
                state = list(entry)
            state, out = step(state, row)
            got.append(out)
        state_box[:] = [at, entry, state]
        return got, closed

    return run


def _emit(on, inputs, init, step, names, types):
    def apply(batches):
        run = _walk(on, inputs, init, step, [None, None, None])
        for batch in batches:
            got, _ = run(batch)
            made = [pa.array([r[i] for r in got], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return apply


def _exits(on, inputs, init, step):
    def apply(batches):
        box, kinds = [None, None, None], None
        run = _walk(on, inputs, init, step, box)

        def table(closed):
            floats = lambda s: [None if v is None else float(v) for v in s]
            keys = [pa.array([c[0][i] for c in closed], t) for i, t in enumerate(kinds)]
            states = [pa.array([floats(c[j]) for c in closed], pa.list_(pa.float64())) for j in (1, 2)]
            return pa.RecordBatch.from_arrays([*keys, *states], names=[*on, "_entry", "_exit"])

        for batch in batches:
            kinds = kinds or [batch.schema.field(c).type for c in on]
            _, closed = run(batch)
            if closed:
                yield table(closed)
        if box[0] is not None:
            yield table([tuple(box)])

    return apply


def quantiles(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], qs: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one wide row: ``<col>_<name>``.

    A key with at most a block of rows sorts its values in one aggregate. For larger keys a
    mergeable sketch brackets every wanted rank, one more scan counts what lies below each bracket
    and the distinct values inside, and only those are ranked: no buffer holds all values of a
    key. NULLs are ignored; a key with only NULLs keeps its row.
    """
    keys, limit = list(keys), block_rows(df.sparkSession)
    slim = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(cols)])
    sizes = written(slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    hot, cold = sizes.agg(F.count(F.when(F.col("_n") > limit, 1)), F.count(F.when(F.col("_n") <= limit, 1))).first()
    if not hot:
        return _sorted_quantiles(slim, keys, cols, qs)
    if not cold:
        return _ranked_quantiles(slim, sizes.select(*keys), keys, cols, qs)
    large = sizes.where(F.col("_n") > limit).select(*keys)  # at most rows / limit keys
    return _sorted_quantiles(slim.join(large, keys, "left_anti"), keys, cols, qs).unionByName(
        _ranked_quantiles(slim.join(large, keys, "left_semi"), large, keys, cols, qs))


def _sorted_quantiles(slim: DataFrame, keys: list[str], cols: Sequence[str], qs: dict[str, float]) -> DataFrame:
    lists = slim.groupBy(*keys).agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in dict.fromkeys(cols)])
    picks = []
    for c in cols:
        for name, q in qs.items():
            at = F.lit(float(q)) * (F.size(c) - 1)
            lo, hi = F.get(c, F.floor(at).cast("int")), F.get(c, F.ceil(at).cast("int"))
            picks.append((lo + (hi - lo) * (at - F.floor(at))).alias(f"{c}_{name}"))
    return lists.select(*keys, *picks)


_SKETCH = 1_000


def _ranked_quantiles(slim: DataFrame, every: DataFrame, keys: list[str], cols: Sequence[str], qs: dict[str, float]) -> DataFrame:
    """The quantiles of keys of more than a block of rows. The sketch is off by at most one in
    ``_SKETCH`` ranks; brackets reach twice as far on both sides, and three rows at least."""
    reach = max(2.0 / _SKETCH, 3.0 / block_rows(slim.sparkSession))
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols])
    long = slim.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*").where("v is not null")
    ends = [min(1.0, max(0.0, q + d * reach)) for q in qs.values() for d in (-1, 1)]
    sketch = long.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("total"), F.min("v").alias("least"), F.max("v").alias("most"),
                                          F.percentile_approx("v", ends, _SKETCH).alias("e"))
    marks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q"), F.get("e", F.lit(2 * i)).alias("from"),
                                         F.get("e", F.lit(2 * i + 1)).alias("to")) for i, (name, q) in enumerate(qs.items())]))
    wide = F.struct(F.col("m.name").alias("name"), F.col("m.q").alias("q"), F.when(F.col("m.q") <= reach, F.col("least")).otherwise(F.col("m.from")).alias("from"),
                    F.when(F.col("m.q") >= 1 - reach, F.col("most")).otherwise(F.col("m.to")).alias("to"))
    marks = written(sketch.select(*keys, "c", "total", "least", "most", marks.alias("m")).select(*keys, "c", "total", wide.alias("m")).select(*keys, "c", "total", "m.*"), "marks")
    # Marks are a few rows for each of the few hot keys; the optimiser broadcasts them while they are small.
    near = long.join(marks, [*keys, "c"]).where(F.col("v") <= F.col("to"))
    value = F.when(F.col("v") >= F.col("from"), F.col("v"))
    freq = written(near.groupBy(*keys, "c", "name", value.alias("v")).agg(F.count(F.lit(1)).alias("m")), "freq")
    below = freq.where("v is null").select(*keys, "c", "name", F.col("m").alias("below"))
    stats = marks.join(below, [*keys, "c", "name"], "left").select(*keys, "c", "name", "total", "q", F.coalesce("below", F.lit(0)).alias("below"))
    ranked = ordered(freq.where("v is not null"), [*keys, "c", "name"], ["v"]).attach(stats).running(upto=("sum", "m")).df
    at, upto = F.col("q") * (F.col("total") - 1), F.col("below") + F.col("upto")
    hit = lambda pos: F.max(F.when((upto - F.col("m") <= pos) & (pos < upto), F.col("v")))
    got = ranked.groupBy(*keys, "c", "name").agg(hit(F.floor(at)).alias("lo"), hit(F.ceil(at)).alias("hi"), F.max(at - F.floor(at)).alias("f"))
    got = got.withColumn("v", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f"))
    wide = [F.max(F.when((F.col("c") == c) & (F.col("name") == name), F.col("v"))).alias(f"{c}_{name}") for c in cols for name in qs]
    if not keys:
        return got.agg(*wide)
    return every.join(got.groupBy(*keys).agg(*wide), keys, "left")
