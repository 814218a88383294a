"""Start gates found from the trace itself: candidates across the driven line, scored by laps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.operators.clean import salted_lookup
from lapforge.operators.ordered import Ordered, ordered
from lapforge.operators.segment import debounce
from lapforge.session import written


def trace_gates(o: Ordered, every: int, dx: Column, dy: Column, x: str = "e", y: str = "n") -> DataFrame:
    """A gate across the direction (dx, dy) at every n-th row: ``gate`` (the row's position in
    its key), centre ``gx``, ``gy`` and unit normal to the driven line ``ux``, ``uy``."""
    size = F.sqrt(dx * dx + dy * dy)
    d = o.position("gate").df.where(F.col("gate") % every == 0)
    d = d.select(*o.keys, "gate", F.col(x).alias("gx"), F.col(y).alias("gy"), (-dy / size).alias("ux"), (dx / size).alias("uy"), size.alias("_s"))
    return d.where("_s > 0").drop("_s")


def gate_hits(o: Ordered, gates: DataFrame, half: float, t: str, speed: str | None = None, min_speed: float = 0.6,
              x: str = "e", y: str = "n") -> DataFrame:
    """Steps that cut a gate of their key within ``half`` of its centre.

    ``i`` (position of the step's first row), ``tc``, ``side`` (+1 or -1) and ``off`` (signed
    distance from the gate's centre). Gates and steps meet in the grid cells they lie in; a pair
    that shares several cells is taken in one of them. Long steps use coarser grids, so that a step
    covers at most four cells, and gates enter each grid in use. Pairs are tested inside the join;
    cells with very many steps are salted.
    """
    keys, cell = o.keys, 2.0 * half
    s = o.position("i").lead(_nx=x, _ny=y, _nt=t).df.where("_nx is not null and _ny is not null")
    if speed:
        s = s.where(F.col(speed) >= min_speed)
    reach = F.greatest(F.abs(F.col("_nx") - F.col(x)), F.abs(F.col("_ny") - F.col(y)))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(reach, F.lit(cell)) / cell))).cast("int")
    s = s.select(*keys, "i", F.col(x).alias("x0"), F.col(y).alias("y0"), F.col("_nx").alias("x1"), F.col("_ny").alias("y1"), F.col(t).alias("t0"), F.col("_nt").alias("t1"),
                 level.alias("level"))
    s = written(s, "steps")
    levels = [r["level"] for r in s.select("level").distinct().collect()]  # one per power of two in length

    def boxed(d: DataFrame, lo_x: Column, hi_x: Column, lo_y: Column, hi_y: Column, tag: str) -> DataFrame:
        size = F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))
        box = lambda v: F.floor(v / size)
        d = d.withColumns({f"{tag}x": box(lo_x), f"{tag}y": box(lo_y), "_hx": box(hi_x), "_hy": box(hi_y)})
        d = d.withColumn("cx", F.explode(F.sequence(f"{tag}x", "_hx"))).withColumn("cy", F.explode(F.sequence(f"{tag}y", "_hy")))
        return d.drop("_hx", "_hy")

    steps = boxed(s, F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1"), "_s")
    w, h = F.abs("ux") * half, F.abs("uy") * half
    g = gates.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    g = boxed(g, F.col("gx") - w, F.col("gx") + w, F.col("gy") - h, F.col("gy") + h, "_g")
    j = salted_lookup(steps, g, [*keys, "level", "cx", "cy"], F.col("i"), "inner", selective=True)
    rx, ry, qx, qy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("gx") - F.col("x0"), F.col("gy") - F.col("y0")
    ux, uy = F.col("ux"), F.col("uy")
    det = rx * uy - ry * ux
    frac, off = (qx * uy - qy * ux) / det, (qx * ry - qy * rx) / det
    once = (F.col("cx") == F.greatest("_sx", "_gx")) & (F.col("cy") == F.greatest("_sy", "_gy"))
    j = j.where(once & (F.abs(det) > 1e-12)).where(frac.between(0, 1) & (F.abs(off) <= half))
    side = F.when(ry * ux - rx * uy >= 0, 1).otherwise(-1)
    return j.select(*keys, "gate", "i", (F.col("t0") + frac * (F.col("t1") - F.col("t0"))).alias("tc"), side.alias("side"), off.alias("off"))


def gate_scores(hits: DataFrame, keys: Sequence[str], halves: Sequence[float], band: tuple[float, float], gap: int, min_crossings: int) -> DataFrame:
    """Crossings, clean intervals and their spread of every gate, half-width and direction.

    A crossing within ``gap`` rows of the last one kept is dropped. An interval inside ``band``
    is clean. Counts and spreads are merged from partial sums.
    """
    width = F.explode(F.array_compact(F.array(*[F.when(F.abs("off") <= h, F.lit(float(h))) for h in halves]))).alias("half")
    by = [*keys, "gate", "half", "side"]
    o = debounce(ordered(hits.select(*keys, "gate", "side", "i", "tc", width), by, ["i"]), "i", gap)
    o = o.renumber().lag(_pt="tc")
    d = F.col("tc") - F.col("_pt")
    clean = F.when((d > band[0]) & (d < band[1]), d)
    s = o.df.groupBy(*by).agg(F.count(F.lit(1)).alias("crossings"), F.count(clean).alias("clean"), F.stddev_pop(clean).alias("std"))
    return s.where(F.col("crossings") >= min_crossings)


def auto_gate(o: Ordered, every: int, halves: Sequence[float], dx: Column, dy: Column, t: str, band: tuple[float, float], gap: int = 50,
              min_crossings: int = 4, speed: str | None = None, min_speed: float = 0.6, x: str = "e", y: str = "n", digits: int = 6) -> DataFrame:
    """The gate of each key with most clean laps, then the least spread (equal to ``digits``),
    then the earliest row, the narrowest and side +1: ``gate``, ``half``, ``side``, ``crossings``,
    ``clean``, ``std`` and its end points ``ax``, ``ay``, ``bx``, ``by``."""
    gates = written(trace_gates(o, every, dx, dy, x, y), "gates")
    hits = gate_hits(o, gates, max(halves), t, speed, min_speed, x, y)
    s = written(gate_scores(hits, o.keys, sorted(halves), band, gap, min_crossings), "scores")
    spread = F.coalesce(F.round("std", digits), F.lit(1e9))
    rank = F.struct(F.col("clean"), -spread, -F.col("gate"), -F.col("half"), F.col("side"))
    best = s.groupBy(*o.keys).agg(F.max_by(F.struct("gate", "half", "side", "crossings", "clean", "std"), rank).alias("b")).select(*o.keys, "b.*")
    d = best.join(gates, [*o.keys, "gate"])
    ends = {c: F.col(g) + sign * F.col(u) * F.col("half") for c, g, u, sign in (("ax", "gx", "ux", -1), ("ay", "gy", "uy", -1), ("bx", "gx", "ux", 1), ("by", "gy", "uy", 1))}
    return d.withColumns(ends).drop("gx", "gy", "ux", "uy")
