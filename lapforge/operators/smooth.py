"""Rolling, smoothing, integrating and differencing columns of an ordered trace."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.functions.geo import wrap180
from lapforge.operators.chains import Decay, run_rule
from lapforge.operators.ordered import Ordered, ordered


def half_window(k: int) -> tuple[int, int]:
    """(rows before, rows after) of a centred window; an even one leans back."""
    return k // 2, (k - 1) // 2


def rolling(o: Ordered, k: int, full: bool = False, **aggs: Column) -> Ordered:
    """Centred rolling aggregates over ``k`` rows; ``full`` gives NULL until the frame is full."""
    b, a = half_window(k)

    def make(agg):
        def fn(w):
            frame = w.rowsBetween(-b, a)
            got = agg.over(frame)
            return F.when(F.count(F.lit(1)).over(frame) == k, got) if full else got
        return fn

    return o.over({n: make(x) for n, x in aggs.items()}, before=b, after=a)


def gradient(y: str, x: str):
    """dy/dx at each row: second order inside, one-sided at the ends of the key."""

    def fn(w):
        yp, yn, xp, xn = F.lag(y).over(w), F.lead(y).over(w), F.lag(x).over(w), F.lead(x).over(w)
        hs, hd = F.col(x) - xp, xn - F.col(x)
        mid = (hs * hs * yn + (hd * hd - hs * hs) * F.col(y) - hd * hd * yp) / F.nullif(hs * hd * (hs + hd), F.lit(0.0))
        return (F.when(xp.isNotNull() & xn.isNotNull(), mid)
                .when(xn.isNotNull(), (yn - F.col(y)) / F.nullif(hd, F.lit(0.0)))
                .when(xp.isNotNull(), (F.col(y) - yp) / F.nullif(hs, F.lit(0.0))))

    return fn


def fir(o: Ordered, col: str, weights: Sequence[float], name: str, edge: str = "normalise") -> Ordered:
    """Symmetric weighted sum. ``normalise`` divides by the weights of present values;
    ``raw`` keeps the input where the frame is not full."""
    h = len(weights) // 2

    def fn(w):
        num, den = F.lit(0.0), F.lit(0.0)
        for j, wt in zip(range(-h, h + 1), weights):
            v = F.lag(col, -j).over(w) if j else F.col(col)
            num = num + F.coalesce(v * float(wt), F.lit(0.0))
            den = den + F.when(v.isNotNull(), float(wt)).otherwise(0.0)
        if edge == "raw":
            return F.when((F.lag(F.lit(1), h).over(w) == 1) & (F.lead(F.lit(1), h).over(w) == 1), num).otherwise(F.col(col))
        return num / F.nullif(den, F.lit(0.0))

    return o.over({name: fn}, before=h, after=h)


def gaussian_weights(sigma: float) -> list[float]:
    h = math.ceil(3 * sigma)
    return [math.exp(-0.5 * (j / sigma) ** 2) for j in range(-h, h + 1)]


def hann_weights(k: int) -> list[float]:
    return [0.5 + 0.5 * math.cos(2 * math.pi * j / (k + 1)) for j in range(-(k // 2), k // 2 + 1)]


def polynomial_weights(k: int, order: int) -> list[float]:
    """Least-squares polynomial smoothing weights for the centre of ``k`` points."""
    x = np.arange(k) - k // 2
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0].tolist()


def local_line(o: Ordered, y: str, t: str, k: int, name: str) -> Ordered:
    """Value at each row of a straight line fitted to the ``k`` rows around it."""
    b, a = half_window(k)

    def fn(w):
        f = w.rowsBetween(-b, a)
        n, sx, sy = F.count(y).over(f), F.avg(t).over(f), F.avg(y).over(f)
        return F.when(n >= 2, F.coalesce(F.regr_slope(y, t).over(f), F.lit(0.0)) * (F.col(t) - sx) + sy).otherwise(sy)

    return o.over({name: fn}, before=b, after=a)


def ema(o: Ordered, col: str, alpha: float, name: str) -> Ordered:
    """Exponential mean with the first value as seed; blocks pass their last mean on."""
    return run_rule(o, Decay(col, alpha, name))


def circular_mean(lines: DataFrame, keys: Sequence[str], idx: str, size: str, col: str, k: int, name: str) -> DataFrame:
    """Rolling mean on closed lines: rows near an end are repeated beyond the other end."""
    b, a = half_window(k)
    i, n = F.col(idx), F.col(size)
    spots = F.array_compact(F.array(i, F.when(i >= n - b, i - n), F.when(i < a, i + n)))
    wide = lines.withColumn("_at", F.explode(spots))
    o = ordered(wide, keys, ["_at", idx])
    o = rolling(o, k, **{name: F.avg(col)})
    return o.df.where(F.col("_at") == i).drop("_at", "_g")


def unwrap(o: Ordered, angle: str, name: str) -> Ordered:
    """Angle (degrees) without jumps: running sum of steps folded to +/-180."""
    o = o.lag(_pa=angle).cols(_d=F.coalesce(wrap180(F.col(angle) - F.col("_pa")), F.col(angle)))
    return o.running(**{name: ("sum", "_d")}).map(lambda d: d.drop("_pa", "_d"))


def distance_along(o: Ordered, x: str, y: str, name: str = "dist", fraction: str | None = "frac") -> Ordered:
    """Cumulative path length in each key and its share of the key's total."""
    o = o.lag(_px=x, _py=y)
    step = F.sqrt(F.pow(F.col(x) - F.col("_px"), 2) + F.pow(F.col(y) - F.col("_py"), 2))
    o = o.cols(_d=F.coalesce(step, F.lit(0.0))).running(**{name: ("sum", "_d"), "_len": ("total", "_d")})
    if fraction:
        o = o.cols(**{fraction: F.col(name) / F.nullif(F.col("_len"), F.lit(0.0))})
    return o.map(lambda d: d.drop("_px", "_py", "_d", "_len"))


def integral(o: Ordered, col: str, t: str, name: str) -> Ordered:
    """Running sum of value times the step since the previous row."""
    o = o.lag(_pt=t).cols(_a=F.col(col) * F.coalesce(F.col(t) - F.col("_pt"), F.lit(0.0)))
    return o.running(**{name: ("sum", "_a")}).map(lambda d: d.drop("_pt", "_a"))


def fill(o: Ordered, cols: Sequence[str], both: bool = False) -> Ordered:
    """Forward fill, and with ``both`` backward fill of what is left."""
    specs = {f"_f_{c}": ("last", c) for c in cols}
    if both:
        specs |= {f"_n_{c}": ("next", c) for c in cols}
    o = o.running(**specs)
    o = o.cols(**{c: F.coalesce(f"_f_{c}", f"_n_{c}") if both else F.col(f"_f_{c}") for c in cols})
    return o.map(lambda d: d.drop(*specs))


def majority_label(o: Ordered, label: str, reach: int, name: str) -> Ordered:
    """Zero labels take the most common nonzero label within ``reach`` rows, earliest on ties."""

    def fn(w):
        near = F.collect_list(F.when(F.col(label) != 0, F.col(label))).over(w.rowsBetween(-reach, reach))
        best = F.array_max(F.transform(near, lambda v, i: F.struct(
            F.size(F.filter(near, lambda z: z == v)).alias("n"), (-i).alias("i"), v.alias("v"))))
        return F.when(F.col(label) != 0, F.col(label)).otherwise(F.coalesce(best["v"], F.lit(0)))

    return o.over({name: fn}, before=reach, after=reach)


def curvature(x: str, y: str):
    """Signed turn angle (rad) over mean step length at each point."""

    def fn(w):
        ax, ay = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
        bx, by = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
        turn = F.atan2(ax * by - ay * bx, ax * bx + ay * by)
        mean = (F.sqrt(ax * ax + ay * ay) + F.sqrt(bx * bx + by * by)) / 2
        return turn / F.nullif(mean, F.lit(0.0))

    return fn
