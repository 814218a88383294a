"""Matching detected crossings and windows to official timing sheets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.operators.asof import interpolate
from lapforge.operators.clean import salted_lookup
from lapforge.operators.lags import correlate, floats, in_cells, schema_of, with_keys
from lapforge.operators.ordered import B, G, ordered
from lapforge.session import written


def boundaries(sheets: DataFrame, keys: Sequence[str], lap: str, lap_time: str) -> DataFrame:
    """Cumulative lap ends of every sheet; the sheet start is boundary 0."""
    d = ordered(sheets.select(*keys, lap, lap_time), keys, [lap]).running(cum=("sum", lap_time)).df.drop(G)
    start = sheets.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("cum"))
    return d.select(*keys, F.col(lap).cast("long").alias("b"), "cum").unionByName(start)


def anchor_scores(crossings: DataFrame, bounds: DataFrame, rec: Sequence[str], sheet: str, t: str, tie: str) -> DataFrame:
    """Median boundary error ``err_med`` for every crossing tried as the ``start`` of lap 1.

    Crossings are dealt into time cells as long as the longest sheet, so a cell sees every crossing
    that its starts can reach, and one sheet is one array a cell. Errors of all starts of a cell
    are looked up at once; no pair of crossings or boundaries becomes a row.
    """
    rec = list(rec)
    longest = bounds.agg(F.max("cum").alias("n")).first()["n"] or 1.0
    x = crossings.withColumn("_v", F.lit(0.0))
    rows = written(in_cells(x, x, rec, t, tie, "_v", float(longest)), "crossings")
    laps = bounds.groupBy(*rec, sheet).agg(F.sort_array(F.collect_list("cum")).alias("_cum"))
    cells = rows.where("not _right").select(*rec, "_cell").distinct()
    both = rows.unionByName(salted_lookup(cells, laps, rec, F.col("_cell"), "inner"), allowMissingColumns=True)

    def score(table: pa.Table) -> pa.Table:
        right = table.column("_right").to_pylist()
        time = floats(table, "_t")
        other = np.sort(time[[v is True for v in right]])
        start = np.sort(time[[v is False for v in right]])
        sheets, starts, med = [], [], []
        for name, cum in zip(table.column(sheet).to_pylist(), table.column("_cum").to_pylist()):
            if cum is None or not len(start):
                continue
            at = start[:, None] + np.asarray(cum)
            after = np.searchsorted(other, at)
            left, last = np.maximum(after - 1, 0), np.minimum(after, len(other) - 1)
            err = np.sort(np.minimum(np.abs(other[left] - at), np.abs(other[last] - at)), axis=1)
            lo, hi = err[:, (len(cum) - 1) // 2], err[:, len(cum) // 2]
            sheets.extend([name] * len(start))
            starts.extend(start)
            med.extend(lo + (hi - lo) * 0.5)
        return with_keys(table, rec, **{sheet: pa.array(sheets, table.schema.field(sheet).type), "start": np.array(starts, "float64"), "err_med": np.array(med, "float64")})

    kind = bounds.schema[sheet].dataType.simpleString()
    return both.groupBy(*rec, "_cell").applyInArrow(score, schema_of(crossings, rec, f"`{sheet}` {kind}, start double, err_med double"))


def anchor(scores: DataFrame, rec: Sequence[str], sheet: str) -> DataFrame:
    """Earliest start with the lowest median error."""
    best = F.min(F.struct(F.col("err_med").alias("med_err"), "start"))
    return scores.groupBy(*rec, sheet).agg(best.alias("b")).select(*rec, sheet, "b.start", "b.med_err")


def lay_laps(anchors: DataFrame, sheets: DataFrame, trace: DataFrame, rec: Sequence[str], sheet: str, lap: str, lap_time: str,
             t: str, clock: str, tie: str) -> DataFrame:
    """Lap start and end clocks laid from cumulative sheet times at the anchor."""
    o = ordered(sheets, [*rec, sheet], [lap]).running(_end=("sum", lap_time))
    d = o.df.drop(G).join(anchors, [*rec, sheet])
    d = d.withColumns({"t_start": F.col("start") + F.col("_end") - F.col(lap_time), "t_end": F.col("start") + F.col("_end")})
    knots = trace.select(*rec, F.col(t).alias("_k"), F.col(clock).cast("double").alias("_c"), F.col(tie).alias("_tie"))
    for side in ("start", "end"):
        left = d.withColumn("_tie", F.col(lap).cast("long"))
        d = interpolate(left, knots, rec, f"t_{side}", "_tie", ["_c"], right_t="_k").withColumn(
            f"c_{side}", F.floor("_c")).drop("_c", "_tie")
    return d.drop("_end", "start", "med_err")


def window_scores(windows: DataFrame, sheets: DataFrame, anchors: DataFrame, rec: Sequence[str], sheet: str, lap_time: str,
                  short: float = 0.65, slack: float = 120.0, per: float = 90.0) -> DataFrame:
    """Score of each window for each sheet; windows too short for the sheet are left out."""
    total = sheets.groupBy(*rec, sheet).agg(F.sum(lap_time).alias("total"))
    d = windows.join(total, list(rec)).join(anchors, [*rec, sheet]).where(F.col("duration") >= F.col("total") * short)
    over = F.greatest(F.lit(0.0), F.col("duration") - (F.col("total") + slack)) / per
    return d.withColumn("score", F.col("med_err") + over)


def greedy_assign(scores: DataFrame, a: str, b: str, score: str, error: str | None = None, limit: float | None = None) -> DataFrame:
    """One-to-one assignment by ascending score, ties by the keys.

    Pairs whose ``error`` is above ``limit`` take no part. Every round takes all pairs that are
    best for both sides at once, which is what a greedy pass over the sorted pairs would take;
    rounds repeat on what is left until it is empty.
    """
    if error is not None:
        scores = scores.where(F.col(error) <= limit)
    rest, taken = written(scores.select(a, b, score), "assign"), None
    while True:
        key = F.struct(score, a, b)
        best_a = rest.groupBy(a).agg(F.min(key).alias("p")).select("p.*")
        best_b = rest.groupBy(b).agg(F.min(key).alias("p")).select("p.*")
        picked = written(best_a.join(best_b, [a, b, score]).select(a, b, score), "assign")
        taken = picked if taken is None else taken.unionByName(picked)
        rest = written(rest.join(picked.select(a), a, "left_anti").join(picked.select(b), b, "left_anti"), "assign")
        if not rest.limit(1).count():
            return taken


def with_unmatched(assigned: DataFrame, sheets: DataFrame, b: str) -> DataFrame:
    """The assignment and a row for every sheet that got none; its other columns are null."""
    left = sheets.select(b).distinct().join(assigned.select(b), b, "left_anti")
    return assigned.unionByName(left, allowMissingColumns=True)


def best_run(laps: np.ndarray, sheet: np.ndarray) -> tuple[float, int]:
    """Lowest RMSE of ``sheet`` against its length of neighbouring laps, and the first place with it.

    Squares are prefix sums and products one transform; places that may be the best are then
    measured lap by lap.
    """
    n = len(sheet)
    centre = sheet.mean()
    v, o = laps - centre, sheet - centre
    square = np.append(0.0, np.cumsum(v * v))
    rough = square[n:] - square[:-n] - 2 * correlate(o, v, 0, len(v) - n) + (o * o).sum()
    near = np.flatnonzero(rough <= rough.min() + 1e-9 * (1.0 + square[-1]))
    exact = [np.sqrt(np.mean((laps[k : k + n] - sheet) ** 2)) for k in near]
    k = int(np.argmin(exact))
    return float(exact[k]), int(near[k])


def align_laps(detected: DataFrame, official: DataFrame, keys: Sequence[str], idx: str, value: str, band: tuple[float, float]) -> DataFrame:
    """Offset of the official laps in the detected ones with the lowest RMSE over all official laps.

    Only laps inside ``band`` count. A key with fewer of them than official laps is compared from
    its first on, over those it has. Blocks of detected laps get the first laps of the next block,
    as many as the longest sheet has, and the key's sheet as one array.
    """
    keys = list(keys)
    sheet = official.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(idx, F.col(value).cast("double").alias("v")))).alias("_s")).select(*keys, F.col("_s.v").alias("_sheet"))
    longest = sheet.agg(F.max(F.size("_sheet")).alias("n")).first()["n"] or 1
    o = ordered(detected.where(F.col(value).between(*band)), keys, [idx]).position("_i").totals(_n=F.count(F.lit(1)))
    size = max(o.rows, longest)
    own = F.expr(f"{G} div {size}")
    homes = F.array_compact(F.array(own, F.when(F.expr(f"{G} % {size} < {longest}"), own - 1)))
    rows = o.df.select(*keys, G, "_i", "_n", F.col(value).cast("double").alias("_v"), F.explode(homes).alias(B))
    blocks = o.df.select(*keys, own.alias(B)).distinct()
    rows = rows.unionByName(salted_lookup(blocks, sheet, keys, F.col(B), "inner"), allowMissingColumns=True)

    def slide(table: pa.Table) -> pa.Table:
        sheets = [v for v in table.column("_sheet").to_pylist() if v is not None]
        place = floats(table, "_i")
        laps = ~np.isnan(place)
        rmse, offset = [], []
        if sheets and laps.any():
            order = np.argsort(place[laps])
            at, v = place[laps][order].astype("int64"), floats(table, "_v")[laps][order]
            want, n = np.asarray(sheets[0]), int(np.nanmax(floats(table, "_n")))
            if n < len(want):
                want = want[:n]
            if len(v) >= len(want):
                best, k = best_run(v, want)
                rmse, offset = [best], [int(at[k])]
        return with_keys(table, keys, rmse=np.array(rmse, "float64"), offset=np.array(offset, "int64"))

    s = rows.groupBy(*keys, B).applyInArrow(slide, schema_of(detected, keys, "rmse double, offset long"))
    return s.groupBy(*keys).agg(F.min(F.struct("rmse", "offset")).alias("b")).select(*keys, "b.offset", "b.rmse")
