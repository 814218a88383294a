"""Uniform grids in time, lap fraction and arc length."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.operators.asof import bracket, lerp
from lapforge.operators.ordered import G, Ordered, ordered
from lapforge.session import written

GRID_CHUNK = 4096


def time_grid(spans: DataFrame, keys: Sequence[str], lo: str, hi: str, step: float, name: str = "t") -> DataFrame:
    """Grid points lo, lo+step, ... below hi for every span row.

    Points come from two expansions: chunks first, spread over tasks, then at most
    ``GRID_CHUNK`` points each, so a long span neither sits in one array nor in one task.
    """
    n = F.ceil((F.col(hi) - F.col(lo)) / step)
    chunks = spans.where(n > 0).select(
        *keys, lo, n.alias("_n"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / GRID_CHUNK))).alias("_c"))
    chunks = chunks.repartition(*[F.col(k) for k in keys], "_c")
    first = F.col("_c") * GRID_CHUNK
    last = F.least(first + GRID_CHUNK, F.col("_n")) - 1
    d = chunks.withColumn("tick", F.explode(F.sequence(first, last)))
    return d.select(*keys, "tick", (F.col(lo) + F.col("tick") * step).alias(name))


class Grid:
    """A uniform clock, end excluded, kept as the rows that make its ticks.

    A row makes the ticks ``_first`` to ``_last``, from itself to before the next one, with linear
    values; it carries the next row's values. ``ticks`` lists them as rows, a ``filler`` inside a task.
    """

    def __init__(self, o: Ordered, t: str, cols: Sequence[str], step: float):
        """``o`` holds rows in time order, without NULL times, that carry their key's ``_lo`` and ``_hi``."""
        self.keys, self.rows, self.t, self.cols, self.step = o.keys, o.rows, t, list(cols), step
        o = o.lead(_nt=t, **{f"_n_{c}": c for c in cols})
        at = lambda k: F.col("_lo") + k * step

        def tick(time: Column) -> Column:
            """The first tick at or after ``time``, as floats add."""
            k = F.ceil((time - F.col("_lo")) / step)
            return F.least(F.when(at(k - 1) >= time, k - 1).when(at(k) < time, k + 1).otherwise(k), F.col("_k"))

        d = o.df.withColumn("_k", F.ceil((F.col("_hi") - F.col("_lo")) / step))
        self.df = d.withColumns({"_first": tick(F.col(t)), "_last": F.coalesce(tick(F.col("_nt")), F.col("_k")) - 1}).where("_first <= _last")

    def ticks(self) -> DataFrame:
        t, cols = self.t, self.cols
        d = self.df.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_last") - F.col("_first")) / GRID_CHUNK))))
        first = F.col("_first") + F.col("_c") * GRID_CHUNK
        d = d.withColumn("tick", F.explode(F.sequence(first, F.least(first + GRID_CHUNK - 1, F.col("_last")))))
        d = d.withColumn("_at", F.col("_lo") + F.col("tick") * self.step)
        w = F.coalesce((F.col("_at") - F.col(t)) / F.nullif(F.col("_nt") - F.col(t), F.lit(0).cast("double")), F.lit(0.0))
        value = lambda c: F.when(F.col(t) == F.col("_at"), F.col(c)).when(F.col("_nt").isNull(), F.col(c)).otherwise(F.col(c) + (F.col(f"_n_{c}") - F.col(c)) * w)
        more = [c for c in (G, "_off") if c in d.columns]
        return d.select(*self.keys, "tick", F.col("_at").alias(t), *[value(c).alias(c) for c in cols], *more)

    def spans(self, cols: Sequence[str]) -> DataFrame:
        """The rows with what a ``filler`` needs for ``cols``."""
        doubles = ["_lo", self.t, "_nt", *[x for c in dict.fromkeys(cols) for x in (c, f"_n_{c}")]]
        return self.df.select(*self.keys, G, "_first", "_last", *[F.col(c).cast("double").alias(c) for c in doubles])

    def filler(self, cols: Sequence[str]) -> Callable[[pa.Table, int, int], tuple[np.ndarray, list[np.ndarray]]]:
        """Of one key's ``spans``, the ticks from ``lo`` to below ``hi`` and their values, as ``ticks`` makes them; NULL is NaN."""
        t_name, step = self.t, self.step

        def fill(table: pa.Table, lo: int, hi: int) -> tuple[np.ndarray, list[np.ndarray]]:
            read = lambda c: np.asarray(table.column(c).to_numpy(zero_copy_only=False), dtype="float64")
            first, last = table.column("_first").to_numpy(), table.column("_last").to_numpy()
            order = np.argsort(first)
            first, last = np.maximum(first[order], lo), np.minimum(last[order], hi - 1)
            n = np.maximum(last - first + 1, 0)
            tick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
            own = lambda c: np.repeat(read(c)[order], n)
            t, nt, at = own(t_name), own("_nt"), own("_lo") + tick * step
            with np.errstate(divide="ignore", invalid="ignore"):
                w = np.where(nt == t, 0.0, (at - t) / (nt - t))
            keep, out = (t == at) | np.isnan(nt), []
            for c in cols:
                v = own(c)
                out.append(np.where(keep, v, v + (own(f"_n_{c}") - v) * w))
            return tick, out

        return fill


def uniform_grid(df: DataFrame, keys: Sequence[str], t: str, tie: str, cols: Sequence[str], hz: float) -> Grid:
    """Every key on a uniform clock with linear values, end excluded; only the rows are ordered."""
    o = ordered(df.where(F.col(t).isNotNull()).select(*keys, t, tie, *cols), keys, [t, tie])
    return Grid(o.totals(_lo=F.min(t), _hi=F.max(t)), t, cols, 1.0 / hz)


def uniform(df: DataFrame, keys: Sequence[str], t: str, tie: str, cols: Sequence[str], hz: float) -> DataFrame:
    """The ticks of ``uniform_grid`` as rows: no tick is shuffled or joined."""
    return uniform_grid(df, keys, t, tie, cols, hz).ticks().drop(G)


def uniform_ordered(df: DataFrame, keys: Sequence[str], t: str, tie: str, cols: Sequence[str], hz: float) -> Ordered:
    """``uniform`` with positions: a key's ticks follow those of the keys before it."""
    keys, step = list(keys), 1.0 / hz
    rows = df.where(F.col(t).isNotNull()).select(*keys, t, tie, *cols)
    spans = rows.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi")).withColumn("_n", F.ceil((F.col("_hi") - F.col("_lo")) / step))
    spans = ordered(spans, [], keys).running(exclusive=True, _off=("sum", "_n")).df.select(*keys, "_lo", "_hi", F.coalesce("_off", F.lit(0)).alias("_off"))
    o = ordered(rows, keys, [t, tie]).attach(written(spans, "spans"))
    return Ordered(Grid(o, t, cols, step).ticks().withColumn(G, F.col("_off") + F.col("tick")).drop("_off"), keys, o.rows)


def mixed(df: DataFrame, keys: Sequence[str], t: str, tie: str, linear: Sequence[str], hold: Sequence[str], hz: float) -> DataFrame:
    """Uniform clock; ``linear`` columns interpolated, ``hold`` columns carried from the last row."""
    spans = df.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    grid = time_grid(spans, keys, "_lo", "_hi", 1.0 / hz, t).withColumn(tie, F.col("tick"))
    d = bracket(grid, df, keys, t, tie, [*linear, *hold])
    d = d.withColumns({c: lerp(F.col(t), c) for c in linear} | {c: F.col("p")[c] for c in hold})
    return d.drop("p", "q", tie)


def fraction_grid(laps: DataFrame, keys: Sequence[str], frac: str, tie: str, cols: Sequence[str], points: int) -> DataFrame:
    """Lap columns at ``points`` equal fractions 0..1 (a fixed number per lap), clamped beyond a lap's ends.

    A row makes the points from itself to before the next one, a lap's first row also those before
    it: only the rows are ordered. Rows without a fraction sort first, as everywhere.
    """
    o = ordered(laps.select(*keys, frac, tie, *cols), keys, [frac, tie])
    nxt = F.struct(F.col(frac).alias("at"), *[F.col(c) for c in cols])
    o = o.over({"_after": lambda w: F.lag(F.lit(1)).over(w), "_n": lambda w: F.lead(nxt).over(w)}, before=1, after=1)
    top = float(points - 1)
    at = lambda k: k / F.lit(top)

    def point(x: Column) -> Column:
        """The first point at or after ``x``, as floats divide; ``points`` if there is none."""
        k = F.ceil(F.when((x > 0) & (x <= 1), x).otherwise(F.lit(0.0)) * top)
        k = F.when(at(k - 1) >= x, k - 1).when(at(k) < x, k + 1).otherwise(k)
        return F.when(x > 1, F.lit(points)).when(x > 0, k).otherwise(F.lit(0)).cast("long")

    first = F.when(F.col("_after").isNull(), F.lit(0).cast("long")).otherwise(point(F.col(frac)))
    last = F.when(F.col("_n").isNull(), F.lit(points).cast("long")).otherwise(point(F.col("_n.at"))) - 1
    d = o.df.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    d = d.withColumn("grid", F.explode(F.sequence("_first", "_last"))).withColumn("_at", at(F.col("grid")))
    w = F.coalesce((F.col("_at") - F.col(frac)) / F.nullif(F.col("_n.at") - F.col(frac), F.lit(0).cast("double")), F.lit(0.0))
    own = (F.col("_at") <= F.col(frac)) | F.col("_n").isNull()
    value = lambda c: F.when(own, F.col(c)).otherwise(F.col(c) + (F.col("_n")[c] - F.col(c)) * w)
    return d.select(*keys, "grid", F.col("_at").alias(frac), *[value(c).alias(c) for c in cols])


def densify(o: Ordered, x: str, y: str, spacing: float) -> DataFrame:
    """Points every ``spacing`` metres on each segment; originals are flagged."""
    o = o.lead(_nx=x, _ny=y)
    seg = F.sqrt(F.pow(F.col("_nx") - F.col(x), 2) + F.pow(F.col("_ny") - F.col(y), 2))
    parts = F.greatest(F.lit(1), F.ceil(seg / spacing)).cast("int")
    d = o.df.withColumn("_parts", F.coalesce(parts, F.lit(1)))
    d = d.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    w = F.col("_j") / F.col("_parts")
    return d.withColumns({
        "dense_x": F.when(F.col("_j") == 0, F.col(x)).otherwise(F.col(x) + (F.col("_nx") - F.col(x)) * w),
        "dense_y": F.when(F.col("_j") == 0, F.col(y)).otherwise(F.col(y) + (F.col("_ny") - F.col(y)) * w),
        "original": F.col("_j") == 0, "part": F.col("_j"),
    }).drop("_nx", "_ny", "_parts", "_j", "_g")


def upsample(o: Ordered, t: str, cols: Sequence[str], between: int) -> DataFrame:
    """``between`` interpolated rows after each row but the last, flagged."""
    o = o.lead(_nt=t, **{f"_n_{c}": c for c in cols})
    top = F.when(F.col("_nt").isNull(), 0).otherwise(between)
    d = o.df.withColumn("part", F.explode(F.sequence(F.lit(0), top)))
    w = F.col("part") / F.lit(float(between + 1))
    at = {c: F.when(F.col("part") == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"_n_{c}") - F.col(c)) * w) for c in cols}
    at[t] = F.when(F.col("part") == 0, F.col(t)).otherwise(F.col(t) + (F.col("_nt") - F.col(t)) * w)
    return d.withColumns(at | {"interpolated": F.col("part") > 0}).drop("_nt", "_g", *[f"_n_{c}" for c in cols])
