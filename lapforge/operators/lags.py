"""Periods, lags and clock offsets over their full search range.

No operator here joins a stream to itself or copies it once per lag. A block of ordered rows, with
the rows its largest lag reaches into, goes to one Arrow call that returns one partial sum for
every lag; the sums of a key are added up by a plain aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.operators.ordered import B, G, Ordered, ordered, quantiles
from lapforge.operators.resample import Grid
from lapforge.operators.stats import weighted_line
from lapforge.session import written


def schema_of(df: DataFrame, keys: Sequence[str], more: str) -> str:
    return ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], more])


def floats(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).to_numpy(zero_copy_only=False), dtype="float64")


def with_keys(table: pa.Table, keys: Sequence[str], **cols) -> pa.Table:
    """``cols`` of equal length beside the group's keys."""
    n = len(next(iter(cols.values())))
    same = {k: pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in keys}
    return pa.table(same | {k: pa.array(v) for k, v in cols.items()})


def correlate(a: np.ndarray, b: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """sum of a[i] * b[i + lag] for lags ``lo``..``hi`` (not negative) by one transform."""
    size = 1 << int(len(a) + max(hi, len(b) - len(a))).bit_length()
    return np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)[lo : hi + 1]


def _lag_sums(o: Ordered, cols: Sequence[str], lo: int, hi: int, kind: str) -> DataFrame:
    """``total`` and pairs ``n`` of each lag: distances of rows, or products of one column.

    Positions must be dense in a key. A row also goes to the block before its own if a row there
    can reach it, so a block holds its own rows and at most ``hi`` more.
    """
    keys, size = o.keys, max(o.rows, hi)
    own = F.expr(f"{G} div {size}")
    homes = F.array_compact(F.array(own, F.when(F.expr(f"{G} % {size} < {hi}"), own - 1)))
    rows = o.df.select(*keys, G, *[F.col(c).cast("double").alias(c) for c in cols]).withColumn(B, F.explode(homes))

    def partial(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(G).to_numpy())
        mine = int(np.count_nonzero(table.column(G).to_numpy() // size == table.column(B)[0].as_py()))
        vals = [floats(table, c)[order] for c in cols]
        lags = np.arange(lo, hi + 1)
        if kind == "product":
            v = np.nan_to_num(vals[0])
            total = correlate(v[:mine], v, lo, hi) if mine else np.zeros(len(lags))
            n = np.clip(len(v) - lags, 0, mine)
        else:
            total, n = np.zeros(len(lags)), np.zeros(len(lags), "int64")
            for k, lag in enumerate(lags):
                m = min(mine, len(order) - lag)
                if m > 0:
                    d = np.sqrt(sum((v[lag : lag + m] - v[:m]) ** 2 for v in vals))
                    total[k], n[k] = np.nansum(d), np.count_nonzero(~np.isnan(d))
        return with_keys(table, keys, lag=lags.astype("int32"), total=total, n=n.astype("int64"))

    parts = rows.groupBy(*keys, B).applyInArrow(partial, schema_of(o.df, keys, "lag int, total double, n long"))
    return parts.groupBy(*keys, "lag").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def self_distance(o: Ordered, x: str, y: str, lo: int, hi: int) -> DataFrame:
    """Mean distance between rows ``lag`` apart, for every lag from ``lo`` to ``hi``."""
    d = _lag_sums(o, [x, y], lo, hi, "distance").where("n > 0")
    return d.select(*o.keys, "lag", (F.col("total") / F.col("n")).alias("distance"))


def lap_period(o: Ordered, x: str, y: str, lo: int, hi: int, within: float = 0.10, rest: int = 5) -> DataFrame:
    """Lap period in rows of a uniform grid: the first dip of the self-distance.

    Lags run from ``lo`` to below ``hi`` and leave at least ``rest`` pairs. The first lag with
    neighbours on both sides, not above either and within 10 % of the lowest, wins; without one
    the lowest does. Keys with fewer than three lags above ``lo`` have no period.
    """
    rows = o.df.groupBy(*o.keys).agg(F.count(F.lit(1)).alias("_rows"))
    s = self_distance(o, x, y, lo, hi - 1).join(rows, o.keys).where(F.col("lag") < F.col("_rows") - rest)
    # At most hi - lo rows a key.
    w = Window.partitionBy(*o.keys)
    near = w.orderBy("lag")
    d = F.col("distance")
    s = s.withColumns({"_p": F.lag("distance").over(near), "_n": F.lead("distance").over(near), "_low": F.min("distance").over(w), "_k": F.count(F.lit(1)).over(w)})
    dip = (d <= F.col("_p")) & (d <= F.col("_n")) & (d <= F.col("_low") * (1 + within))
    pick = F.coalesce(F.min_by(F.struct("lag", "distance"), F.when(dip, F.col("lag"))), F.min_by(F.struct("lag", "distance"), F.struct("distance", "lag")))
    return s.where("_k > 2").groupBy(*o.keys).agg(pick.alias("b")).select(*o.keys, "b.*")


def autocorrelation(o: Ordered | Grid, col: str, lo: int, hi: int) -> DataFrame:
    """Score of every lag: sum of products of centred values over the sum of their squares."""
    if isinstance(o, Grid):
        return _grid_autocorrelation(o, col, lo, hi)
    o = o.totals(_m=F.avg(col)).cols(_c=F.col(col) - F.col("_m"))
    zero = o.df.groupBy(*o.keys).agg(F.nullif(F.sum(F.col("_c") * F.col("_c")), F.lit(0.0)).alias("_z"))
    s = _lag_sums(o, ["_c"], lo, hi, "product").where("n > 0").join(zero, o.keys)
    return s.select(*o.keys, "lag", (F.col("total") / F.col("_z")).alias("score")).where("score is not null")


def _grid_autocorrelation(g: Grid, col: str, lo: int, hi: int) -> DataFrame:
    """``autocorrelation`` of a grid whose ticks are made in the tasks.

    A key's ticks are cut into blocks, which carry the rows of the ``hi`` ticks after them; an Arrow
    call takes the blocks of many keys, about a block of ticks in all. Means are sums over each
    row's stretch of the line.
    """
    keys, size, fill = g.keys, max(g.rows, hi), g.filler([col])
    spans = written(g.spans([col]), "spans")
    n, t, nt, v, nv = F.col("_last") - F.col("_first") + 1, F.col(g.t), F.col("_nt"), F.col(col), F.col(f"_n_{col}")
    weight = F.coalesce((n * (F.col("_lo") - t) + g.step * ((F.col("_first") + F.col("_last")) * n / 2)) / F.nullif(nt - t, F.lit(0.0)), F.lit(0.0))
    exact = F.col("_lo") + F.col("_first") * g.step == t
    part = F.when(nt.isNull(), F.struct((v * n).alias("v"), n.alias("n"))).when(nv.isNotNull(), F.struct((v * n + (nv - v) * weight).alias("v"), n.alias("n")))
    part = F.when(v.isNotNull(), part.otherwise(F.struct(F.when(exact, v).alias("v"), F.when(exact, 1).alias("n"))))
    means = spans.select(*keys, part.alias("p")).groupBy(*keys).agg((F.sum("p.v") / F.sum("p.n")).alias("_m"))
    rows = Ordered(spans, keys, g.rows).attach(means).df
    rows = rows.withColumn("_c", F.explode(F.sequence(F.expr(f"greatest(_first - {hi}, 0) div {size}"), F.expr(f"_last div {size}"))))
    deals = (spans.agg(F.sum(n).alias("n")).first()["n"] or 0) // size + int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(*spans.columns, "_m", "_c", F.pmod(F.xxhash64(*keys, "_c"), F.lit(deals)).alias("_deal")).drop(G)

    def partial(table: pa.Table) -> pa.Table:
        ids = [table.column("_c").to_numpy(), *[table.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy() for k in keys]]
        order = np.lexsort(ids)
        starts = np.flatnonzero(np.append(True, np.any([np.diff(i[order]) != 0 for i in ids], axis=0)))
        table, lags = table.take(pa.array(order)).combine_chunks(), np.arange(lo, hi + 1)
        total, n, z = np.zeros((len(starts), len(lags))), np.zeros((len(starts), len(lags)), "int64"), np.zeros(len(starts))
        for k, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(order)))):
            own = table.slice(a, b - a)
            c = own.column("_c")[0].as_py()
            tick, (v,) = fill(own, c * size, (c + 1) * size + hi)
            mine = int(np.searchsorted(tick, (c + 1) * size))
            if mine:
                v = np.nan_to_num(v - floats(own.slice(0, 1), "_m")[0])
                total[k], n[k], z[k] = correlate(v[:mine], v, lo, hi), np.clip(len(v) - lags, 0, mine), (v[:mine] ** 2).sum()
        named = {k: table.column(k).take(pa.array(np.repeat(starts, len(lags)))) for k in keys}
        return pa.table(named | {"lag": pa.array(np.tile(lags, len(starts)).astype("int32")), "total": pa.array(total.ravel()),
                                 "n": pa.array(n.ravel()), "z": pa.array(np.repeat(z, len(lags)))})

    parts = rows.groupBy("_deal").applyInArrow(partial, schema_of(g.df, keys, "lag int, total double, n long, z double"))
    s = parts.repartition(*keys).groupBy(*keys, "lag").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("z").alias("z"))
    return s.where("n > 0").select(*keys, "lag", (F.col("total") / F.nullif("z", F.lit(0.0))).alias("score")).where("score is not null")


def best_lag(scores: DataFrame, keys: Sequence[str], digits: int = 9) -> DataFrame:
    """The lag with the highest score, the shortest of those equal to ``digits``."""
    s = scores.withColumn("score", F.round("score", digits))
    return s.groupBy(*keys).agg(F.max_by(F.struct("lag", "score"), F.struct("score", -F.col("lag"))).alias("b")).select(*keys, "b.*")


def _z(v: np.ndarray) -> np.ndarray:
    v, spread = v - v.mean(), v.std()
    return v / spread if spread > 0 else v


def window_lag(a: np.ndarray, b: np.ndarray, digits: int = 9) -> tuple[int, float]:
    """Start in ``b`` at which its values match ``a`` best, both z-scored, and the mean product."""
    score = np.round(correlate(_z(a), _z(b), 0, len(b) - len(a)) / len(a), digits)
    k = int(np.argmax(score))
    return k, float(score[k])


def local_lags(o: Ordered | Grid, tick: str, a: str, b: str, width: int, step: int, search: int, least: int = 50) -> DataFrame:
    """Lag of ``b`` against ``a`` in sliding windows of a uniform grid: ``win``, ``lag``, ``score``.

    Window w holds ticks from w * step, ``width`` of them; ``b`` is searched from ``search`` ticks
    before it to ``search`` after it, as far as the key has rows. All lags come from one transform
    of the two z-scored slices. Windows run while they end before the key's last tick; those with
    fewer than ``least`` rows, or without two more rows of ``b``, give none. A group is the windows
    that start in a block of ticks, with their margins, so few ticks are copied and none holds a
    key beyond a block. Positions of ``o`` are not used. Of a ``Grid`` the rows go to the groups
    and make their ticks there, so what is moved does not grow with the clock's rate.
    """
    keys, per, grid = o.keys, max(1, o.rows // step), isinstance(o, Grid)
    if grid:
        rows, first, last, fill = o.spans([a, b]).drop(G), "_first", "_last", o.filler([a, b])
    else:
        rows, first, last = o.df.select(*keys, tick, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")), tick, tick
    group = lambda win: F.floor(win / per)
    early, late = F.expr(f"({first} - {width + search}) div {step}") - 1, F.expr(f"({last} + {search}) div {step}")
    begin = lambda c: c * (per * step) - search
    end = lambda c: c * (per * step) + (per - 1) * step + width + search
    rows = rows.withColumn("_c", F.explode(F.sequence(group(F.greatest(early, F.lit(0))), group(late))))
    rows = rows.where((F.col(last) >= begin(F.col("_c"))) & (F.col(first) < end(F.col("_c"))))

    def match(table: pa.Table) -> pa.Table:
        c = table.column("_c")[0].as_py()
        if grid:
            t, (va, vb) = fill(table, begin(c), end(c))
        else:
            t = table.column(tick).to_numpy()
            order = np.argsort(t)
            t, va, vb = t[order], floats(table, "_a")[order], floats(table, "_b")[order]
        win, lag, score = [], [], []
        for w in range(c * per, min((c + 1) * per, int(t[-1]) // step + 1)):
            start = w * step
            lo, i, j, hi = np.searchsorted(t, [start - search, start, start + width, start + width + search])
            if j - i >= max(least, 1) and hi - lo >= j - i + 2:
                k, top = window_lag(va[i:j], vb[lo:hi])
                win.append(w)
                lag.append(int(t[lo]) + k - start)
                score.append(top)
        out = with_keys(table, keys, win=np.array(win, "int64"), lag=np.array(lag, "int32"), score=np.array(score, "float64"))
        return out

    found = rows.groupBy(*keys, "_c").applyInArrow(match, schema_of(o.df, keys, "win long, lag int, score double"))
    sizes = o.df.groupBy(*keys).agg((F.sum(F.col("_last") - F.col("_first") + 1) if grid else F.count(F.lit(1))).alias("_n"))
    return found.join(sizes, keys).where(F.col("win") * step < F.col("_n") - width).drop("_n")


def clock_fit(lags: DataFrame, keys: Sequence[str], at: str, lag: str, score: str, least: float = 0.30) -> DataFrame:
    """Clock model of each key from its window lags: other = ``a`` * own + ``b``.

    A line through the lags of windows scoring at least ``least``, weighted by score. With fewer
    than three of them ``a`` is 1 and ``b`` the median of all lags. ``r`` is the fit's correlation;
    ``low_confidence`` if it is below 0.5 or the weights average below 0.4.
    """
    keys = list(keys)
    good = lags.where(F.col(score) >= least)
    line = weighted_line(good, keys, at, lag, score).join(good.groupBy(*keys).agg(F.avg(score).alias("_w")), keys)
    line = line.where("n >= 3").select(*keys, "slope", "intercept", F.abs("r").alias("r"), "_w")
    d = quantiles(lags, keys, [lag], {"mid": 0.5}).join(lags.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.count(F.when(F.col(score) >= least, 1)).alias("used")), keys)
    d = d.join(line, keys, "left")
    r = F.coalesce("r", F.lit(0.0))
    return d.select(*keys, (1 + F.coalesce("slope", F.lit(0.0))).alias("a"), F.coalesce("intercept", F.col(f"{lag}_mid")).alias("b"), r.alias("r"), "windows", "used",
                    (F.col("slope").isNull() | (r < 0.5) | (F.col("_w") < 0.4)).alias("low_confidence"))


def in_cells(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, tie: str, v: str, cell: float) -> DataFrame:
    """Both streams dealt once into time cells, so that a cell can search ``cell`` to both sides.

    Rows are keys, ``_cell``, ``_t``, ``_tie``, ``_v`` and ``_right``. A cell holds its left rows, the
    right rows of itself and both neighbours, and the nearest right row beyond them on each side.
    """
    cell_of, shape = F.floor(F.col(t) / cell), [*keys, "_cell", "_t", "_tie", "_v", "_right"]
    own = left.select(*keys, cell_of.alias("_cell"), F.col(t).alias("_t"), F.col(tie).alias("_tie"), F.col(v).alias("_v"), F.lit(False).alias("_right"))
    other = right.select(*keys, cell_of.alias("_c"), F.col(t).alias("_t"), F.col(tie).alias("_tie"), F.col(v).alias("_v"))
    near = other.withColumn("_cell", F.explode(F.sequence(F.col("_c") - 1, F.col("_c") + 1))).withColumn("_right", F.lit(True)).select(*shape)
    row = F.struct("_t", "_tie", "_v")
    ends = other.groupBy(*keys, "_c").agg(F.max(row).alias("last"), F.min(row).alias("first"))
    cells = own.select(*keys, "_cell").distinct().withColumn("_own", F.lit(True))
    ticks = ends.select(*keys, (F.col("_c") + 2).alias("_cell"), "last").join(cells, [*keys, "_cell"], "full").join(
        ends.select(*keys, (F.col("_c") - 2).alias("_cell"), "first"), [*keys, "_cell"], "full")
    line = ordered(ticks, keys, ["_cell"]).running(before=("last", "last"), after=("next", "first")).df.where("_own")
    beyond = line.select(*keys, "_cell", F.explode(F.array_compact(F.array("before", "after"))).alias("_e")).select(*keys, "_cell", "_e.*", F.lit(True).alias("_right"))
    return own.unionByName(near).unionByName(beyond.select(*shape))


def _sweep_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return schema_of(df, keys, "offset double, n long, sa double, sb double, saa double, sbb double, sab double")


def offset_scores(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, tie: str, a: str, b: str, offsets: Sequence[float], cell: float) -> DataFrame:
    """Correlation of ``a`` with ``b`` read by interpolation at t + offset, for every offset.

    Both streams are dealt once into time cells of ``cell``, at least the largest offset. A cell
    keeps one accumulator (n, sums, squares, product) for each offset; cells are then added up. Values are taken from a common centre so that the sums keep their digits.
    Places outside the right rows do not count; equal times read the row that is last by ``tie``.
    """
    keys, shifts = list(keys), np.asarray([float(v) for v in offsets])
    if cell < np.abs(shifts).max():
        raise ValueError("cell is at least the largest offset")
    ca = left.agg(F.avg(a).alias("m")).first()["m"] or 0.0
    cb = right.agg(F.avg(b).alias("m")).first()["m"] or 0.0
    rows = in_cells(left.where(F.col(a).isNotNull()).withColumn("_v", F.col(a) - ca), right.where(F.col(b).isNotNull()).withColumn("_v", F.col(b) - cb),
                    keys, t, tie, "_v", cell)

    def sweep(table: pa.Table) -> pa.Table:
        is_right = table.column("_right").to_numpy(zero_copy_only=False).astype(bool)
        time, tie_, v = floats(table, "_t"), table.column("_tie").to_numpy(zero_copy_only=False), floats(table, "_v")
        order = np.lexsort((tie_[is_right], time[is_right]))
        rt, rv = time[is_right][order], v[is_right][order]
        lt, lv = time[~is_right], v[~is_right]
        out = np.zeros((len(shifts), 6))
        some = max(1, (1 << 20) // max(1, len(lt)))  # shifts tried in one array operation
        for k in range(0, len(shifts) if len(rt) and len(lt) else 0, some):
            at = lt + shifts[k : k + some, None]
            p = np.searchsorted(rt, at, "right") - 1
            q, hit = np.minimum(p + 1, len(rt) - 1), p >= 0
            p = np.maximum(p, 0)
            exact = hit & (rt[p] == at)
            fine = hit & ((p + 1 < len(rt)) | exact)
            w = np.where(exact, 0.0, (at - rt[p]) / np.where(rt[q] > rt[p], rt[q] - rt[p], 1.0))
            y, z = np.where(fine, lv, 0.0), np.where(fine, rv[p] + (rv[q] - rv[p]) * w, 0.0)
            out[k : k + some] = np.stack([v.sum(axis=1) for v in (fine, y, z, y * y, z * z, y * z)], axis=1)
        n, *sums = out.T
        return with_keys(table, keys, offset=shifts, n=n.astype("int64"), **dict(zip(("sa", "sb", "saa", "sbb", "sab"), sums)))

    parts = rows.groupBy(*keys, "_cell").applyInArrow(sweep, _sweep_schema(left, keys))
    s = parts.groupBy(*keys, "offset").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    n = F.col("n")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    flat = (va <= 1e-12 * F.col("saa")) | (vb <= 1e-12 * F.col("sbb"))
    score = F.when((n >= 2) & ~flat, (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(va * vb))
    return s.select(*keys, "offset", "n", score.alias("score")).where("score is not null")


def best_offset(scores: DataFrame, keys: Sequence[str], digits: int = 9) -> DataFrame:
    """The offset with the highest score; of those equal to ``digits`` the smallest, then the earlier."""
    s = scores.withColumn("score", F.round("score", digits))
    best = F.max_by(F.struct("offset", "score", "n"), F.struct("score", -F.abs("offset"), -F.col("offset")))
    return s.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
