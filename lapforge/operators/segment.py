"""Sessions, laps, sectors and events cut out of an ordered trace."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.functions.geo import gate_hit, inside
from lapforge.operators.chains import Automaton, Resume, Turned, earliest, run_rule, spaced
from lapforge.operators.clean import salted_lookup
from lapforge.operators.ordered import G, Ordered, ordered, quantiles
from lapforge.operators.smooth import rolling
from lapforge.session import written


# -- windows and sessions ------------------------------------------------------------
def runs(o: Ordered, flag: Column, t: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Spans of consecutive rows where ``flag`` holds, with their row count."""
    o = o.cols(_flag=F.coalesce(flag, F.lit(False))).islands(F.col("_flag"))
    more = [e.alias(n) for n, e in (extra or {}).items()]
    return o.df.where("_flag").groupBy(*o.keys, "island").agg(
        F.min(t).alias("t_in"), F.max(t).alias("t_out"), F.count(F.lit(1)).alias("rows"), F.min(G).alias("_g"), *more)


def driving_windows(o: Ordered, speed: str, t: str, moving: float, width: int, share: float, min_s: float, pad: float) -> DataFrame:
    """Spans where the centred share of moving rows exceeds ``share``, long enough, padded."""
    o = rolling(o.cols(_mv=(F.col(speed) > moving).cast("double")), width, _occ=F.avg("_mv"))
    d = runs(o, F.col("_occ") > share, t).where(F.col("t_out") - F.col("t_in") > min_s)
    return d.withColumns({"duration": F.col("t_out") - F.col("t_in"), "t_in": F.col("t_in") - pad, "t_out": F.col("t_out") + pad})


def gap_sessions(o: Ordered, t: str, gap: float, name: str = "stint") -> Ordered:
    """Number the groups of rows separated by more than ``gap``."""
    o = o.lag(_pt=t).cols(_new=F.coalesce((F.col(t) - F.col("_pt") > gap).cast("int"), F.lit(1)))
    return o.running(**{name: ("sum", "_new")}).map(lambda d: d.drop("_pt", "_new"))


def loud_sessions(o: Ordered, level: str, t: str, width: int, merge: float, min_s: float, pad: float) -> DataFrame:
    """Loud spans: rolling median above the quartile midpoint, near spans merged, short ones dropped."""
    o = rolling(o, width, _md=F.percentile(level, F.lit(0.5))).cut()
    o = o.attach(quantiles(o.df, o.keys, ["_md"], {"p25": 0.25, "p75": 0.75}))
    spans = runs(o, F.col("_md") > (F.col("_md_p25") + F.col("_md_p75")) / 2, t)
    s = ordered(spans.drop("_g"), o.keys, ["t_in"]).lag(_end="t_out")
    s = s.cols(_new=F.coalesce((F.col("t_in") - F.col("_end") >= merge).cast("int"), F.lit(1))).running(span=("sum", "_new"))
    d = s.df.groupBy(*o.keys, "span").agg(F.min("t_in").alias("t_in"), F.max("t_out").alias("t_out"))
    d = d.where(F.col("t_out") - F.col("t_in") >= min_s)
    return d.withColumns({"t_in": F.col("t_in") - pad, "t_out": F.col("t_out") + pad})


def longest_active(o: Ordered, speed: str, t: str, width: int, split_rows: int) -> DataFrame:
    """The segment with most active rows: moving average above its 25th percentile, idle gaps of
    more than ``split_rows`` rows split segments."""
    o = rolling(o, width, _ma=F.avg(speed)).position("_i").cut()
    o = o.attach(quantiles(o.df, o.keys, ["_ma"], {"p25": 0.25})).where(F.col("_ma") > F.col("_ma_p25")).renumber()
    o = gap_sessions(o, "_i", split_rows, "seg")
    d = o.df.groupBy(*o.keys, "seg").agg(F.count(F.lit(1)).alias("rows"), F.min(t).alias("t_in"), F.max(t).alias("t_out"))
    best = F.max_by(F.struct("seg", "rows", "t_in", "t_out"), F.struct("rows", -F.col("seg")))
    return d.groupBy(*o.keys).agg(best.alias("b")).select(*o.keys, "b.*")


# -- gates and laps ------------------------------------------------------------------
def gate_crossings(o: Ordered, gate: Sequence[float], t: str, speed: str | None = None, min_speed: float = 0.6,
                   x: str = "e", y: str = "n", side: int | None = None) -> Ordered:
    """Rows whose step to the next row cuts the gate, with interpolated time and side."""
    o = o.lead(_nx=x, _ny=y, _nt=t)
    hit, frac, s = gate_hit(x, y, "_nx", "_ny", gate)
    if speed:
        hit = hit & (F.col(speed) >= min_speed)
    if side is not None:
        hit = hit & (s == side)
    o = o.where(hit).cols(t_cross=F.col(t) + frac * (F.col("_nt") - F.col(t)), side=s)
    return o.map(lambda d: d.drop("_nx", "_ny", "_nt"))


def half_plane_crossings(o: Ordered, centre: tuple[float, float], normal: tuple[float, float], half: float, cos_min: float,
                         t: str, x: str = "e", y: str = "n") -> Ordered:
    """Sign change of the projection on the gate normal, close to the centre and well aligned."""
    (cx, cy), (ux, uy) = centre, normal
    o = o.lead(_nx=x, _ny=y, _nt=t)
    p0 = (F.col(x) - cx) * ux + (F.col(y) - cy) * uy
    p1 = (F.col("_nx") - cx) * ux + (F.col("_ny") - cy) * uy
    frac = p0 / F.nullif(p0 - p1, F.lit(0.0))
    dx, dy = F.col("_nx") - F.col(x), F.col("_ny") - F.col(y)
    lateral = F.abs(-(F.col(x) + frac * dx - cx) * uy + (F.col(y) + frac * dy - cy) * ux)
    align = (dx * ux + dy * uy) / F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    o = o.where((p0 < 0) & (p1 >= 0) & (lateral <= half) & (align >= cos_min))
    return o.cols(t_cross=F.col(t) + frac * (F.col("_nt") - F.col(t))).map(lambda d: d.drop("_nx", "_ny", "_nt"))


def debounce(o: Ordered, clock: str, gap: float, inclusive: bool = False) -> Ordered:
    """Keep a row only if it lies more than ``gap`` after the last kept row."""
    return run_rule(o, spaced(clock, gap, strict=not inclusive)).where("_keep").map(lambda d: d.drop("_keep"))


def best_gate(o: Ordered, gates: dict[str, Sequence[float]], t: str, band: tuple[float, float], min_crossings: int = 4) -> DataFrame:
    """Score candidate gates and directions per key: most intervals inside the band, then least spread."""
    o = o.lead(_nx="e", _ny="n", _nt=t)
    options = []
    for name, gate in gates.items():
        hit, frac, side = gate_hit("e", "n", "_nx", "_ny", gate)
        options.append(F.when(hit, F.struct(F.lit(name).alias("gate"), side.alias("side"), (F.col(t) + frac * (F.col("_nt") - F.col(t))).alias("tc"))))
    d = o.df.select(*o.keys, G, F.explode(F.array_compact(F.array(*options))).alias("c")).select(*o.keys, G, "c.*")
    c = ordered(d.withColumnRenamed(G, "_i"), [*o.keys, "gate", "side"], ["tc", "_i"]).lag(_pt="tc")
    gap = F.col("tc") - F.col("_pt")
    clean = F.when((gap > band[0]) & (gap < band[1]), gap)
    s = c.df.groupBy(*o.keys, "gate", "side").agg(F.count(F.lit(1)).alias("crossings"), F.count(clean).alias("clean"), F.stddev_pop(clean).alias("std"))
    s = s.where(F.col("crossings") >= min_crossings)
    rank = F.struct(F.col("clean"), -F.coalesce("std", F.lit(1e9)))
    best = F.max_by(F.struct("gate", "side", "crossings", "clean", "std"), F.struct(rank, "gate", "side"))
    return s.groupBy(*o.keys).agg(best.alias("b")).select(*o.keys, "b.*")


def lap_counter(o: Ordered, crossed: Column, name: str = "lap_no") -> Ordered:
    """Laps counted at crossings, with names: out lap, warm-up, timed, exit; timed laps count from 1."""
    o = o.running(**{name: ("count", F.when(crossed, 1))})
    o = o.attach(o.df.groupBy(*o.keys).agg(F.max(name).alias("_last")))
    n = F.col(name)
    label = F.when(n == 0, "out").when(n == 1, "warm-up").when(n == F.col("_last"), "exit").otherwise("timed")
    return o.cols(lap_name=label, timed_no=F.when(label == "timed", n - 1)).map(lambda d: d.drop("_last"))


def yaw_laps(o: Ordered, angle: str, turn: float) -> Ordered:
    """A lap ends once the continuous heading has turned ``turn`` degrees since the lap start."""
    return run_rule(o, Turned(angle, turn))


def radius_laps(o: Ordered, dist: Column, t: str, r_in: float, r_out: float, min_s: float) -> DataFrame:
    """Laps armed beyond ``r_out`` from a point and closed inside ``r_in``."""
    far, near = F.col("_d") > r_out, F.col("_d") < r_in
    o = o.cols(_d=dist).totals(_t0=F.min(t), _f0=F.min(F.when(far, F.col(t)))).where(far | near)
    o = o.running(_far=("next", F.when(far, F.col(t))))
    o = o.cols(_near=F.coalesce(near & (F.col(t) >= F.col("_f0")) & (F.col(t) - F.col("_t0") > min_s), F.lit(False)))

    def armed(cols):
        """A lap may close once it was far again, and long enough after the last close."""
        return np.maximum(np.nan_to_num(cols["_far"], nan=np.inf), earliest(cols[t], min_s, True))

    o = run_rule(o, Resume(t, armed, ["_far"], "_near")).where("_keep").renumber().lag(_last=t)
    start = F.coalesce("_last", "_t0")
    return o.df.select(*o.keys, start.alias("lap_start"), F.col(t).alias("lap_end"), (F.col(t) - start).alias("lap_time"))


def minima_laps(o: Ordered, dist: Column, t: str, near: Column | float, spacing: float) -> Ordered:
    """Local minima of the distance to an anchor, near enough and well spaced."""
    o = o.cols(_d=dist).over({"_p": lambda w: F.lag("_d").over(w), "_n": lambda w: F.lead("_d").over(w)}, before=1, after=1)
    o = o.where((F.col("_d") <= F.col("_p")) & (F.col("_d") < F.col("_n")) & (F.col("_d") < near))
    return debounce(o.map(lambda d: d.drop("_p", "_n")), t, spacing, inclusive=True)


def peak_laps(o: Ordered, col: str, t: str, threshold: Column | float, spacing: float) -> Ordered:
    """Local maxima above a threshold with minimum spacing."""
    o = o.over({"_p": lambda w: F.lag(col).over(w), "_n": lambda w: F.lead(col).over(w)}, before=1, after=1)
    o = o.where((F.col(col) > F.col("_p")) & (F.col(col) >= F.col("_n")) & (F.col(col) > threshold))
    return debounce(o.map(lambda d: d.drop("_p", "_n")), t, spacing, inclusive=True)


def up_crossings(o: Ordered, col: str, t: str, threshold: float, spacing: float) -> Ordered:
    o = o.lag(_p=col).where((F.col("_p") <= threshold) & (F.col(col) > threshold))
    return debounce(o.map(lambda d: d.drop("_p")), t, spacing, inclusive=True)


def trim_to_laps(o: Ordered, crossed: str, t: str) -> Ordered:
    """Rows from the first to the last crossing with lap number, lap time and lap clock."""
    o = o.cut().totals(_a=F.min(F.when(F.col(crossed), F.col(G))), _z=F.max(F.when(F.col(crossed), F.col(G))))
    o = o.where((F.col(G) >= F.col("_a")) & (F.col(G) < F.col("_z"))).map(lambda d: d.drop("_a", "_z"))
    o = o.running(lap_no=("count", F.when(F.col(crossed), 1))).cut()
    by_lap = o.rekey([*o.keys, "lap_no"]).totals(_s=F.min(t), lap_time=F.max(t) - F.min(t))
    return by_lap.cols(lap_clock=F.col(t) - F.col("_s")).map(lambda d: d.drop("_s")).rekey(o.keys)


def ordered_gates(o: Ordered, gate_no: str, gates: int) -> Ordered:
    """Accept a crossing only of the expected next gate; gate 1 restarts, others are skipped."""

    table = np.tile(np.arange(gates + 1)[:, None], (1, gates + 1))
    marks = np.zeros((gates + 1, gates + 1), bool)
    for now in range(gates + 1):
        for g in {now % gates + 1, 1 if now else now + 1}:
            table[now, g], marks[now, g] = g, True
    o = o.cols(_gate=F.when(F.col(gate_no).between(1, gates), F.col(gate_no)).otherwise(0).cast("int"))
    return run_rule(o, Automaton("_gate", table, marks, "accepted")).map(lambda d: d.drop("_gate"))


def sector_crossings(crossings: DataFrame, laps: DataFrame, keys: Sequence[str], lap: str, start: str, end: str) -> DataFrame:
    """First line-1 crossing after the lap start, first line-2 crossing after that, and sector times."""
    by = [*keys, lap]
    one = crossings.where("line = 1").groupBy(*by).agg(F.min("tc").alias("t1"))
    two = crossings.where("line = 2").join(one, by).where(F.col("tc") > F.col("t1")).groupBy(*by).agg(F.min("tc").alias("t2"))
    d = laps.join(one, by, "left").join(two, by, "left")
    return d.withColumns({"sector_1": F.col("t1") - F.col(start), "sector_2": F.col("t2") - F.col("t1"), "sector_3": F.col(end) - F.col("t2")})


def sticky_polygons(o: Ordered, polygons: dict[int, Sequence[tuple[float, float]]], x: str, y: str, look: int, name: str) -> Ordered:
    """Sector by polygon carried forward; a short hole takes the sector found within ``look`` rows ahead."""
    raw = F.coalesce(*[F.when(inside(x, y, ring), F.lit(k)) for k, ring in polygons.items()])
    o = o.cols(_raw=raw).over({"_ahead": lambda w: F.first("_raw", True).over(w.rowsBetween(1, look))}, before=0, after=look)
    o = o.running(_held=("last", "_raw"))
    return o.cols(**{name: F.coalesce("_raw", "_held", "_ahead", F.lit(0))}).map(lambda d: d.drop("_raw", "_ahead", "_held"))


def inside_spans(o: Ordered, flag: Column, t: str) -> DataFrame:
    """Visits to a box: entry, exit and duration of every stay."""
    return runs(o, flag, t).withColumn("duration", F.col("t_out") - F.col("t_in"))


def braking_zones(o: Ordered, speed: str, t: str, decel: float, tail: int, min_drop: float, width: int = 7) -> DataFrame:
    """Runs of hard deceleration with the lowest speed from brake start to ``tail`` rows after the run."""
    o = rolling(o, width, _v=F.avg(speed))
    o = o.over({"_dv": lambda w: F.coalesce(
        (F.lead("_v").over(w) - F.lag("_v").over(w)) / F.nullif(F.lead(t).over(w) - F.lag(t).over(w), F.lit(0.0)),
        (F.lead("_v").over(w) - F.col("_v")) / F.nullif(F.lead(t).over(w) - F.col(t), F.lit(0.0)),
        (F.col("_v") - F.lag("_v").over(w)) / F.nullif(F.col(t) - F.lag(t).over(w), F.lit(0.0))),
        "_app": lambda w: F.coalesce(F.lag("_v", 2).over(w), F.lag("_v", 1).over(w), F.col("_v"))}, before=2, after=1)
    o = o.cols(_brk=F.coalesce(F.col("_dv") < -decel, F.lit(False))).islands(F.col("_brk")).cut()
    # A braking run owns its rows and the next ``tail`` rows; minima there come from bounded frames.
    o = o.over({"_low": lambda w: F.min(F.struct(F.col("_v").alias("v"), F.col(G).alias("at"), F.col(t).alias("t"))).over(w.rowsBetween(0, tail))},
               before=0, after=tail)
    z = o.df.where("_brk").groupBy(*o.keys, "island").agg(
        F.min(t).alias("t_brake"), F.min_by("_app", G).alias("approach"), F.min("_low").alias("low"))
    z = z.select(*o.keys, "t_brake", "approach", F.col("low.v").alias("apex"), F.col("low.t").alias("t_apex"))
    return z.withColumn("drop", F.col("approach") - F.col("apex")).where(F.col("drop") > min_drop)


def impacts(o: Ordered, acc: str, speed: str, thr: float, release: float, skip: int, min_speed: float, top: int) -> DataFrame:
    """Peaks above ``thr`` held until below ``release * thr``, spaced by ``skip`` rows; hardest flagged."""
    from pyspark.sql import Window

    o = o.position("_i").where(F.col(acc) > thr * release).renumber()
    o = o.over({"_new": lambda w: F.coalesce(F.lag("_i").over(w) < F.col("_i") - 1, F.lit(True)),
                "_last": lambda w: F.coalesce(F.lead("_i").over(w) > F.col("_i") + 1, F.lit(True))}, before=1, after=1)
    o = o.running(_end=("next", F.when(F.col("_last"), F.col("_i")))).cols(_hot=F.col(acc) > thr)
    o = run_rule(o, Resume("_i", lambda cols: cols["_end"] + 1 + skip, ["_end"], "_hot")).cut()
    # Rows belong to the start in their own run of neighbours, if it has one before them.
    o = o.running(event=("count", F.when(F.col("_keep"), 1)), _st=("last", F.when(F.col("_keep"), F.col("_i"))), _a=("last", F.when(F.col("_new"), F.col("_i"))))
    o = o.where("_st >= _a")
    peak = F.max_by(F.struct("_i", acc, speed), F.struct(acc, -F.col("_i")))
    d = o.df.groupBy(*o.keys, "event").agg(peak.alias("p")).select(*o.keys, "p.*").where(F.col(speed) >= min_speed)
    w = Window.partitionBy(*o.keys).orderBy(F.desc(acc), "_i")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumn("notable", F.col("rank") == 1)


def hysteresis(o: Ordered, on: Column, off: Column, name: str) -> Ordered:
    """State that turns true at ``on`` rows and false at ``off`` rows; the last trigger wins."""
    o = o.running(_s=("last", F.when(on, True).when(off, False)))
    return o.cols(**{name: F.coalesce("_s", F.lit(False))}).map(lambda d: d.drop("_s"))


def incident_status(o: Ordered, speed: str, accel: str, turn: str, t: str, crash_speed: float, decel: float, spin: float,
                    slow: float, slow_s: float, go: float, go_s: float, dt0: float) -> Ordered:
    """Incident flag: an abrupt stop or spin, or too long below ``slow``; ends after ``go_s`` above ``go``.

    The row before an abrupt start and the row after an end belong to the incident.
    """
    o = o.lag(_pt=t).cols(_dt=F.col(t) - F.col("_pt"))

    def step(state, row):
        inc, low, rec = state
        v, a, w, dt = row
        if dt is None or dt != dt:
            return [0.0, 0.0, 0.0], (False, False, False)
        dt = dt if dt > 0 else dt0
        abrupt = ended = False
        if not inc and v < crash_speed and ((a is not None and a < decel) or (w is not None and abs(w) > spin)):
            inc, low, rec, abrupt = 1.0, 0.0, 0.0, True
        if not inc:
            low = low + dt if v < slow else 0.0
            if low > slow_s:
                inc, low = 1.0, 0.0
            return [inc, low, rec], (bool(inc), False, False)
        rec = rec + dt if v > go else 0.0
        if rec > go_s:
            inc, rec, ended = 0.0, 0.0, True
        return [inc, low, rec], (True, abrupt, ended)

    o = o.fold([speed, accel, turn, "_dt"], [0.0, 0.0, 0.0], step, "_in boolean, _abrupt boolean, _ended boolean").cut()
    o = o.over({"_next": lambda w: F.coalesce(F.lead("_abrupt").over(w), F.lit(False)),
                "_prev": lambda w: F.coalesce(F.lag("_ended").over(w), F.lit(False))}, before=1, after=1)
    return o.cols(incident=F.col("_in") | F.col("_next") | F.col("_prev")).map(
        lambda d: d.drop("_pt", "_dt", "_in", "_abrupt", "_ended", "_next", "_prev"))


def latch(o: Ordered, trigger: Column, t: str, hold: float, name: str) -> Ordered:
    """True from each trigger until ``hold`` after the latest one."""
    o = o.running(_l=("max", F.when(trigger, F.col(t))))
    return o.cols(**{name: F.coalesce(F.col(t) - F.col("_l") <= hold, F.lit(False))}).map(lambda d: d.drop("_l"))


def barrier_laps(o: Ordered, barriers: Sequence[Sequence[float]], lap: str) -> DataFrame:
    """Laps whose path cuts, touches or runs along any fixed barrier segment (steps inside the lap only)."""
    o = o.rekey([*o.keys, lap]).lead(_nx="e", _ny="n")
    any_hit = F.lit(False)
    for ax, ay, bx, by in barriers:
        (x, nx), (y, ny) = ("e", "_nx"), ("n", "_ny")
        if abs(by - ay) > abs(bx - ax):  # the axis on which the barrier is long comes first
            (x, nx), (y, ny), ax, ay, bx, by = (y, ny), (x, nx), ay, ax, by, bx
        slope = (by - ay) / (bx - ax) if bx != ax else 0.0
        lo, hi = min(ax, bx), max(ax, bx)
        rx, off = F.col(nx) - F.col(x), (ax - F.col(x)) * slope - (ay - F.col(y))
        det = rx * slope - (F.col(ny) - F.col(y))
        flat = F.abs(det) <= 1e-12
        frac = F.when(~flat, off / det)
        cut = frac.between(0, 1) & (F.col(x) + frac * rx).between(lo, hi)
        on = (F.abs(off) <= 1e-12) & (F.greatest(x, nx) >= lo) & (F.least(x, nx) <= hi)
        any_hit = any_hit | F.coalesce(F.when(flat, on).otherwise(cut), F.lit(False))
    return o.df.where(any_hit).select(*o.keys).distinct()


def anomalous_laps(o: Ordered, lap: str, barriers: Sequence[Sequence[float]], min_rows: int, cell: float, reach: int = 64) -> DataFrame:
    """Laps of at least ``min_rows`` rows whose path crosses itself or meets a fixed barrier."""
    o = o.rekey([*o.keys, lap]).totals(_rows=F.count(F.lit(1))).where(F.col("_rows") >= min_rows).map(lambda d: d.drop("_rows")).cut()
    o = o.rekey([k for k in o.keys if k != lap])
    return self_crossing(o, lap, cell, reach).unionByName(barrier_laps(o, barriers, lap)).distinct()


# -- periods, lags and shifts --------------------------------------------------------
def circular_shift(points: DataFrame, reference: DataFrame, keys: Sequence[str], idx: str, x: str, y: str, size: int, by: Column) -> DataFrame:
    """Index shift that brings closed polylines closest to a reference polyline of ``size`` points.

    A reference is one row, the list of its points, and a polyline's points meet it before they
    are repeated for every shift. ``by`` spreads the points of a very frequent reference.
    """
    on = [k for k in keys if k in reference.columns]
    ref = reference.groupBy(*on).agg(F.collect_list(F.struct(F.col(idx).alias("_ri"), F.col(x).alias("_rx"), F.col(y).alias("_ry"))).alias("_ref"))
    slim = points.select(*keys, F.col(idx).alias("_i"), x, y, by.alias("_by"))
    j = salted_lookup(slim, ref, on, F.col("_by"), "inner", selective=True).withColumn("_r", F.explode("_ref")).select(*keys, x, y, "_i", "_r.*")
    j = j.withColumn("shift", F.pmod(F.col("_ri") - F.col("_i"), F.lit(size)).cast("int")).where((F.col("_i") + F.col("shift")) % size == F.col("_ri"))
    err = j.groupBy(*keys, "shift").agg(F.avg(F.pow(F.col(x) - F.col("_rx"), 2) + F.pow(F.col(y) - F.col("_ry"), 2)).alias("err"))
    return err.groupBy(*keys).agg(F.min(F.struct("err", "shift")).alias("b")).select(*keys, "b.shift", "b.err")


def thirds(o: Ordered, parts: int, name: str = "part") -> Ordered:
    """Equal-count sectors by row position; the last takes the remainder."""
    o = o.position("_i").totals(_n=F.count(F.lit(1)))
    size = F.greatest(F.floor(F.col("_n") / parts), F.lit(1))
    return o.cols(**{name: F.least(F.lit(parts - 1), F.floor(F.col("_i") / size)).cast("int") + 1}).map(lambda d: d.drop("_i", "_n"))


def line_laps(o: Ordered, p: tuple[float, float], q: tuple[float, float], near: float, pit: Column, min_rows: int) -> Ordered:
    """Rows close to the line through two points outside the pit, at least ``min_rows`` apart."""
    (x1, y1), (x2, y2) = p, q
    a, b, c = y2 - y1, x1 - x2, x2 * y1 - x1 * y2
    dist = F.abs(F.col("e") * a + F.col("n") * b + c) / (a * a + b * b) ** 0.5
    return debounce(o.position("_i").where((dist < near) & ~pit), "_i", min_rows)


def return_laps(o: Ordered, dist: Column, near: float, back: int, min_rows: int) -> Ordered:
    """Rows near a point that were far from it ``back`` rows ago, spaced by ``min_rows``."""
    o = o.cols(_d=dist).lag(back, _was="_d").position("_i")
    o = o.where((F.col("_d") < near) & (F.col("_was") >= near))
    return debounce(o.map(lambda d: d.drop("_was")), "_i", min_rows, inclusive=True)


# -- zones ---------------------------------------------------------------------------
def corner_zones(d: DataFrame, keys: Sequence[str], pid: str, x: str, y: str, turn: str, lat_g: str, g: str, speed: str, eps: float,
                 min_pts: int, top: float = 0.85) -> DataFrame:
    """Corners: rows with the highest cornering score, clustered, with weighted centre, side,
    severity and class."""
    from lapforge.operators.cluster import density_clusters

    d = d.withColumn("_sc", F.abs(turn) / 10 + F.abs(lat_g) * 3).withColumn("_at", F.abs(turn))
    d = written(d, "score")
    cut = quantiles(d, keys, ["_sc"], {"cut": top})
    d = salted_lookup(d, cut, keys, F.col(pid), "inner").where(F.col("_sc") > F.col("_sc_cut"))
    c = density_clusters(d, keys, pid, x, y, eps, min_pts).where("cluster >= 0")
    by = [*keys, "cluster"]
    q = quantiles(c, by, [turn, "_at", g, speed], {"50": 0.5, "85": 0.85, "15": 0.15, "20": 0.2})
    w = F.sum("_sc")
    a = c.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), (F.sum(F.col(x) * F.col("_sc")) / w).alias("x"), (F.sum(F.col(y) * F.col("_sc")) / w).alias("y"))
    a = a.where(F.col("points") >= min_pts).join(q, by)
    sev = F.col("_at_85") / 10 + F.col(f"{g}_85") * 5 + (F.col(f"{speed}_85") - F.col(f"{speed}_15")) / 5
    kind = F.when(sev > 8, "hairpin").when(sev > 5, "sharp").when(sev > 3, "medium").otherwise("gentle")
    return a.select(*by, "points", "x", "y", F.when(F.col(f"{turn}_50") > 0, "left").otherwise("right").alias("direction"), sev.alias("severity"),
                    kind.alias("kind"), F.col(f"{speed}_20").alias("min_speed"))


def merge_corners(corners: DataFrame, keys: Sequence[str], pid: str, near: float) -> DataFrame:
    """Corners closer than ``near`` to each other become one, the most severe."""
    from lapforge.operators.cluster import density_clusters

    c = density_clusters(corners.withColumnRenamed(pid, "_id"), keys, "_id", "x", "y", near, 1)
    best = F.max_by(F.struct(F.col("_id").alias(pid), "x", "y", "severity"), F.struct("severity", -F.col("_id")))
    return c.groupBy(*keys, F.col("cluster").alias("_c")).agg(best.alias("b")).select(*keys, "b.*")


def self_crossing(o: Ordered, lap: str, cell: float, reach: int = 64, x: str = "e", y: str = "n") -> DataFrame:
    """Laps whose path crosses, touches or retraces itself.

    Standing samples are dropped first. The joint of neighbouring steps, and of the first and last
    step of a closed lap, does not count, but a step straight back on the one before it does.
    Steps meet in the cells they pass and at most ``reach`` steps apart; the reach doubles for laps
    without a crossing so far, until it covers the lap. A crossing lap leaves at once.
    """
    o = o.rekey([*o.keys, lap]).lead(_nx=x, _ny=y).where("_nx is not null and (_nx <> {0} or _ny <> {1})".format(x, y)).renumber()
    keys = o.keys
    lo, hi = lambda a, b: F.floor(F.least(a, b) / cell), lambda a, b: F.floor(F.greatest(a, b) / cell)
    s = o.df.select(*keys, F.col(G).alias("i"), F.col(x).alias("x0"), F.col(y).alias("y0"), F.col("_nx").alias("x1"), F.col("_ny").alias("y1"))
    s = s.withColumn("cx", F.explode(F.sequence(lo("x0", "x1"), hi("x0", "x1")))).withColumn("cy", F.explode(F.sequence(lo("y0", "y1"), hi("y0", "y1"))))
    s = written(s, "steps")
    sizes = s.groupBy(*keys).agg((F.max("i") - F.min("i")).alias("_span"))
    open_, seen, found = written(sizes, "laps"), 0, None
    while True:
        a = salted_lookup(s, open_, keys, F.col("i"), "inner")
        slot = lambda c: F.floor(c / reach)
        left = a.withColumn("slot", F.explode(F.array_distinct(F.array(slot(F.col("i") + seen + 1), slot(F.col("i") + reach)))))
        other = a.select(*keys, "cx", "cy", slot(F.col("i")).alias("slot"), *[F.col(c).alias(f"{c}_b") for c in ("i", "x0", "y0", "x1", "y1")])
        j = salted_lookup(left, other, [*keys, "cx", "cy", "slot"], F.col("i"), "inner", selective=True)
        j = j.where((F.col("i_b") > F.col("i") + seen) & (F.col("i_b") <= F.col("i") + reach))
        rx, ry, sx, sy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("x1_b") - F.col("x0_b"), F.col("y1_b") - F.col("y0_b")
        det = rx * sy - ry * sx
        qx, qy = F.col("x0_b") - F.col("x0"), F.col("y0_b") - F.col("y0")
        flat, size = F.abs(det) <= 1e-12, rx * rx + ry * ry
        meet = F.when(~flat, (qx * sy - qy * sx) / det).between(0, 1) & F.when(~flat, (qx * ry - qy * rx) / det).between(0, 1)
        start, along = (qx * rx + qy * ry) / size, rx * sx + ry * sy
        end = start + along / size
        overlap = (F.abs(qx * ry - qy * rx) <= 1e-12) & (F.greatest(start, end) >= 0) & (F.least(start, end) <= 1)
        closing = (F.col("i_b") - F.col("i") == F.col("_span")) & (F.col("x1_b") == F.col("x0")) & (F.col("y1_b") == F.col("y0"))
        joined = (F.col("i_b") == F.col("i") + 1) | closing
        cut = F.when(joined, flat & (along < 0)).when(flat, overlap).otherwise(meet)
        hit = written(j.where(cut).select(*keys).distinct(), "crossing")
        found = hit if found is None else found.unionByName(hit)
        open_ = written(open_.where(F.col("_span") > reach).join(hit, keys, "left_anti"), "laps")
        if not open_.limit(1).count():
            return found
        seen, reach = reach, reach * 2


def gate_grid(centre: tuple[float, float], heading: tuple[float, float], along: Sequence[float], across: Sequence[float],
              halves: Sequence[float]) -> dict[str, tuple[float, float, float, float]]:
    """Candidate gates around a guess: shifted along and across the travel direction, several widths.

    The grid is configuration, so every row tests a fixed number of gates in one pass.
    """
    (cx, cy), (hx, hy) = centre, heading
    size = (hx * hx + hy * hy) ** 0.5
    ux, uy = hx / size, hy / size
    out = {}
    for i, a in enumerate(along):
        for j, b in enumerate(across):
            for k, h in enumerate(halves):
                x, y = cx + a * ux - b * uy, cy + a * uy + b * ux
                out[f"g{i}_{j}_{k}"] = (x + h * uy, y - h * ux, x - h * uy, y + h * ux)
    return out
