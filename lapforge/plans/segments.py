"""Segmentation, events and periods over the derived trace."""

from pyspark.sql import functions as F

from lapforge.functions.geo import hypot
from lapforge.operators import gates, lags, resample, smooth
from lapforge.operators import segment as sg
from lapforge.operators.ordered import G, Ordered, ordered
from lapforge.plans.registry import query
from lapforge.plans.streams import DIST_SQL, FR, LERP, UNWRAP, W
from lapforge.plans.views import GATE, T, r, recursive, trace
from lapforge.session import written

RUNS = """, fl AS (SELECT *, sum(CASE WHEN flag IS DISTINCT FROM pf OR pf IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY i) AS isl
FROM (SELECT *, lag(flag) OVER (PARTITION BY session ORDER BY i) AS pf FROM flagged)),
runs AS (SELECT session, isl, min(t) AS t_in, max(t) AS t_out, count(*) AS n_rows FROM fl WHERE flag GROUP BY session, isl) """


@query("SEG-01", T(f""", flagged AS (SELECT session, i, t, avg(CASE WHEN speed > 40 THEN 1.0 ELSE 0.0 END){FR(3,3)} > 0.3 AS flag FROM trace)""" + RUNS +
       "SELECT session, round(t_in - 5, 6) AS t_in, round(t_out + 5, 6) AS t_out, round(t_out - t_in, 6) AS duration FROM runs WHERE t_out - t_in > 50000"))
def seg_01(spark, sf):
    d = sg.driving_windows(trace(spark, sf), "speed", "t", 40, 7, 0.3, 50000, 5)
    return d.select("session", *[r(c).alias(c) for c in ("t_in", "t_out", "duration")])


@query("SEG-02", T(f""", s AS (SELECT session, event_id, i, t, t - lag(t){W} AS dt FROM trace WHERE speed > 20), g AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt > 60000 THEN 1 ELSE 0 END){W} AS stint FROM s)
SELECT session, CAST(stint AS BIGINT) AS stint, round(min(t), 6) AS t_in, round(max(t), 6) AS t_out, count(*) AS n FROM g GROUP BY session, stint"""))
def seg_02(spark, sf):
    # A filtered trace leaves gaps in the row numbers, so neighbours are found after renumbering.
    o = sg.gap_sessions(trace(spark, sf).where("speed > 20").renumber(), "t", 60000)
    return o.df.groupBy("session", "stint").agg(r(F.min("t")).alias("t_in"), r(F.max("t")).alias("t_out"), F.count(F.lit(1)).alias("n"))


@query("SEG-03", T(f""", m AS (SELECT session, i, t, median(speed){FR(2,2)} AS md FROM trace), q AS (SELECT session, (quantile_cont(md, 0.25) + quantile_cont(md, 0.75))/2 AS thr FROM m GROUP BY session),
flagged AS (SELECT m.session, i, t, md > thr AS flag FROM m JOIN q ON q.session = m.session)""" + RUNS + """, x AS (SELECT *, lag(t_out) OVER (PARTITION BY session ORDER BY t_in) AS pe FROM runs),
y AS (SELECT *, sum(CASE WHEN pe IS NULL OR t_in - pe >= 80000 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t_in) AS span FROM x)
SELECT session, CAST(span AS BIGINT) AS span, round(min(t_in) - 10, 6) AS t_in, round(max(t_out) + 10, 6) AS t_out FROM y GROUP BY session, span HAVING max(t_out) - min(t_in) >= 40000"""))
def seg_03(spark, sf):
    d = sg.loud_sessions(trace(spark, sf), "speed", "t", 5, 80000, 40000, 10)
    return d.select("session", "span", r("t_in").alias("t_in"), r("t_out").alias("t_out"))


@query("SEG-04", T(f""", m AS (SELECT session, i, t, avg(speed){FR(2,2)} AS ma FROM trace), q AS (SELECT session, quantile_cont(ma, 0.25) AS thr FROM m GROUP BY session),
a AS (SELECT m.session, i, t FROM m JOIN q ON q.session = m.session WHERE ma > thr), g AS (SELECT *, i - lag(i){W} AS di FROM a),
s AS (SELECT *, sum(CASE WHEN di IS NULL OR di > 2 THEN 1 ELSE 0 END){W} AS seg FROM g), c AS (SELECT session, seg, count(*) AS n, min(t) AS t_in, max(t) AS t_out FROM s GROUP BY ALL)
SELECT session, CAST(seg AS BIGINT) AS seg, n AS n_rows, round(t_in, 6) AS t_in, round(t_out, 6) AS t_out FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, seg) AS rn FROM c) WHERE rn = 1"""))
def seg_04(spark, sf):
    d = sg.longest_active(trace(spark, sf), "speed", "t", 5, 2)
    return d.select("session", "seg", F.col("rows").alias("n_rows"), r("t_in").alias("t_in"), r("t_out").alias("t_out"))


# The gate is the vertical segment x = 37.5, y in [-12, 12].
CROSS = f""", st AS (SELECT *, lead(e){W} AS ne, lead(n){W} AS nn, lead(t){W} AS nt FROM trace),
cr AS (SELECT session, event_id, i, t + (37.5 - e)/(ne - e)*(nt - t) AS tc, CASE WHEN ne < e THEN 1 ELSE -1 END AS side, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS j FROM st
WHERE ne <> e AND (37.5 - e)/(ne - e) BETWEEN 0 AND 1 AND n + (37.5 - e)/(ne - e)*(nn - n) BETWEEN -12 AND 12 AND speed >= 0.6) """


@query("SEG-05", T(CROSS + "SELECT session, event_id, round(tc, 3) AS t_cross, side FROM cr"))
def seg_05(spark, sf):
    o = sg.gate_crossings(trace(spark, sf), GATE, "t", "speed")
    return o.out("session", "event_id", r("t_cross", 3).alias("t_cross"), "side")


def debounce_sql(pre: str, clock: str, gap: str, final: str) -> str:
    """Greedy spacing over rows ``cr(session, j, ...)``."""
    base = f"SELECT *, {clock} AS clk FROM cr"
    sql = recursive(base, "SELECT session, event_id, j, clk AS last, true AS keep FROM src WHERE j = 0",
                    f"""SELECT s.session, s.event_id, s.j, CASE WHEN s.clk - f.last {gap} THEN s.clk ELSE f.last END, s.clk - f.last {gap}
                    FROM f JOIN src s ON s.session = f.session AND s.j = f.j + 1""", final)
    return sql.replace(", src AS MATERIALIZED", pre + ", src AS MATERIALIZED", 1)


KEPT = "SELECT session, event_id FROM f WHERE keep"


@query("SEG-06", debounce_sql(CROSS, "i", "> 20", KEPT))
def seg_06(spark, sf):
    o = sg.gate_crossings(trace(spark, sf), GATE, "t", "speed")
    return sg.debounce(o, "i", 20).out("session", "event_id")


@query("SEG-07", T(f""", st AS (SELECT *, lead(e){W} AS ne, lead(n){W} AS nn, lead(t){W} AS nt FROM trace)
SELECT session, event_id, round(t + (37.5 - e)/(ne - e)*(nt - t), 3) AS t_cross FROM st WHERE e < 37.5 AND ne >= 37.5
AND abs(n + (37.5 - e)/(ne - e)*(nn - n)) <= 12 AND (ne - e)/sqrt(pow(ne-e,2)+pow(nn-n,2)) >= 0.85"""))
def seg_07(spark, sf):
    o = sg.half_plane_crossings(trace(spark, sf), (37.5, 0.0), (1.0, 0.0), 12.0, 0.85, "t")
    return o.out("session", "event_id", r("t_cross", 3).alias("t_cross"))


@query("SEG-08", T(f""", st AS (SELECT *, lead(e){W} AS ne, lead(n){W} AS nn, lead(t){W} AS nt FROM trace), g AS (SELECT * FROM (VALUES ('a', 37.5, 0.6), ('b', 62.5, 12.0), ('c', 12.5, 0.2)) v(gate, gx, half)),
cr AS (SELECT session, gate, i, CASE WHEN ne < e THEN 1 ELSE -1 END AS side, t + (gx - e)/(ne - e)*(nt - t) AS tc FROM st, g WHERE ne <> e AND (gx - e)/(ne - e) BETWEEN 0 AND 1 AND abs(n + (gx - e)/(ne - e)*(nn - n)) <= half),
d AS (SELECT *, tc - lag(tc) OVER (PARTITION BY session, gate, side ORDER BY tc, i) AS gap FROM cr),
s AS (SELECT session, gate, side, count(*) AS crossings, count(CASE WHEN gap > 200000 AND gap < 700000 THEN 1 END) AS clean, stddev_pop(CASE WHEN gap > 200000 AND gap < 700000 THEN gap END) AS std FROM d GROUP BY ALL HAVING count(*) >= 3)
SELECT session, gate, side, crossings, clean, round(std, 3) AS std FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY clean DESC, coalesce(std, 1e9), gate DESC, side DESC) AS rn FROM s) WHERE rn = 1"""))
def seg_08(spark, sf):
    gates = {"a": (37.5, -0.6, 37.5, 0.6), "b": (62.5, -12.0, 62.5, 12.0), "c": (12.5, -0.2, 12.5, 0.2)}
    d = sg.best_gate(trace(spark, sf), gates, "t", (200000, 700000), 3)
    return d.select("session", "gate", "side", "crossings", "clean", r("std", 3).alias("std"))


CNT = CROSS + f""", lc AS (SELECT t.*, c.event_id IS NOT NULL AS crossed FROM trace t LEFT JOIN cr c ON c.event_id = t.event_id),
ln AS (SELECT *, count(CASE WHEN crossed THEN 1 END){W} AS lap_no FROM lc), lm AS (SELECT *, max(lap_no) OVER (PARTITION BY session) AS top FROM ln) """


def crossed_rows(spark, sf) -> Ordered:
    """Trace with a flag on rows whose next step cuts the gate."""
    from lapforge.functions.geo import gate_hit

    o = trace(spark, sf).lead(_ne="e", _nn="n")
    hit = gate_hit("e", "n", "_ne", "_nn", GATE)[0] & (F.col("speed") >= 0.6)
    return o.cols(crossed=hit).map(lambda d: d.drop("_ne", "_nn"))


@query("SEG-10", T(CNT + """SELECT session, event_id, lap_no, CASE WHEN lap_no = 0 THEN 'out' WHEN lap_no = 1 THEN 'warm-up' WHEN lap_no = top THEN 'exit' ELSE 'timed' END AS lap_name,
CASE WHEN lap_no > 1 AND lap_no <> top THEN lap_no - 1 END AS timed_no FROM lm"""))
def seg_10(spark, sf):
    return sg.lap_counter(crossed_rows(spark, sf), F.col("crossed")).out("session", "event_id", "lap_no", "lap_name", "timed_no")


@query("SEG-11", recursive("SELECT session, event_id, i, un FROM u", "SELECT session, event_id, i, un AS last, false AS lap_end FROM src WHERE i = 0",
       """SELECT s.session, s.event_id, s.i, CASE WHEN abs(s.un - f.last) >= 350 THEN s.un ELSE f.last END, abs(s.un - f.last) >= 350 FROM f JOIN src s ON s.session = f.session AND s.i = f.i + 1""",
       "SELECT session, event_id FROM f WHERE lap_end").replace(", src AS MATERIALIZED", UNWRAP + ", src AS MATERIALIZED", 1))
def seg_11(spark, sf):
    o = smooth.unwrap(trace(spark, sf).cols(ang=F.col("k") * 7.5), "ang", "un")
    return sg.yaw_laps(o, "un", 350.0).where("lap_end").out("session", "event_id")


RAD = """, cr AS (SELECT session, t, sqrt(e*e + n*n) AS d, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS j, min(t) OVER (PARTITION BY session) AS t0 FROM
(SELECT *, min(t) OVER (PARTITION BY session) AS m FROM trace) WHERE sqrt(e*e + n*n) > 55 OR sqrt(e*e + n*n) < 18)"""


@query("SEG-12", recursive("SELECT session, j, t, d, 0.0 AS t0 FROM cr",
       "SELECT session, j, t, d > 55 AS armed, CAST(0.0 AS DOUBLE) AS start, CAST(0.0 AS DOUBLE) AS was, false AS closed FROM src WHERE j = 0",
       """SELECT s.session, s.j, s.t, CASE WHEN f.armed AND s.d < 18 AND s.t - f.start > 8 THEN false ELSE f.armed OR s.d > 55 END,
       CASE WHEN f.armed AND s.d < 18 AND s.t - f.start > 8 THEN s.t ELSE f.start END, f.start, f.armed AND s.d < 18 AND s.t - f.start > 8 FROM f JOIN src s ON s.session = f.session AND s.j = f.j + 1""",
       "SELECT session, round(was, 6) AS lap_start, round(t, 6) AS lap_end, round(t - was, 6) AS lap_time FROM f WHERE closed").replace(", src AS MATERIALIZED", RAD + ", src AS MATERIALIZED", 1))
def seg_12(spark, sf):
    d = sg.radius_laps(trace(spark, sf), hypot("e", "n"), "t", 18.0, 55.0, 8.0)
    return d.select("session", *[r(c).alias(c) for c in ("lap_start", "lap_end", "lap_time")])


MINIMA = f""", dd AS (SELECT session, event_id, i, t, sqrt(e*e + n*n) AS d FROM trace), mm AS (SELECT *, lag(d){W} AS p, lead(d){W} AS q FROM dd),
cr AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS j FROM mm WHERE d <= p AND d < q AND d < 30)"""


@query("SEG-13", debounce_sql(MINIMA, "t", ">= 150000", KEPT))
def seg_13(spark, sf):
    return sg.minima_laps(trace(spark, sf), hypot("e", "n"), "t", 30.0, 150000.0).out("session", "event_id")


PEAKS = f""", mm AS (SELECT *, lag(speed){W} AS p, lead(speed){W} AS q FROM trace), cr AS (SELECT session, event_id, i, t, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS j FROM mm WHERE speed > p AND speed >= q AND speed > 60)"""
UPS = f""", mm AS (SELECT *, lag(speed){W} AS p FROM trace), cr AS (SELECT session, event_id, i, t, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS j FROM mm WHERE p <= 50 AND speed > 50)"""


@query("SEG-14", debounce_sql(PEAKS, "t", ">= 100000", KEPT))
def seg_14(spark, sf):
    return sg.peak_laps(trace(spark, sf), "speed", "t", 60.0, 100000.0).out("session", "event_id")


@query("SEG-14b", debounce_sql(UPS, "t", ">= 100000", KEPT))
def seg_14b(spark, sf):
    return sg.up_crossings(trace(spark, sf), "speed", "t", 50.0, 100000.0).out("session", "event_id")


@query("SEG-15", T(CNT + """, tr2 AS (SELECT *, min(CASE WHEN crossed THEN i END) OVER (PARTITION BY session) AS a, max(CASE WHEN crossed THEN i END) OVER (PARTITION BY session) AS z FROM lm)
SELECT session, event_id, lap_no, round(max(t) OVER (PARTITION BY session, lap_no) - min(t) OVER (PARTITION BY session, lap_no), 6) AS lap_time,
round(t - min(t) OVER (PARTITION BY session, lap_no), 6) AS lap_clock FROM tr2 WHERE i >= a AND i < z"""))
def seg_15(spark, sf):
    o = sg.trim_to_laps(crossed_rows(spark, sf), "crossed", "t")
    return o.out("session", "event_id", "lap_no", r("lap_time").alias("lap_time"), r("lap_clock").alias("lap_clock"))


GATES = """, cr AS (SELECT session, event_id, i, k % 3 + 1 AS gate, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS j FROM trace WHERE i % 5 = 0)"""


@query("SEG-16", recursive("SELECT * FROM cr", "SELECT session, event_id, i, j, CASE WHEN gate = 1 THEN 1 ELSE 0 END AS now, CASE WHEN gate = 1 THEN 2 ELSE 1 END AS want, gate = 1 AS ok FROM src WHERE j = 0",
       """SELECT s.session, s.event_id, s.i, s.j, CASE WHEN s.gate = f.want THEN s.gate WHEN s.gate = 1 AND f.now > 0 THEN 1 ELSE f.now END,
       CASE WHEN s.gate = f.want THEN CASE WHEN s.gate = 3 THEN 1 ELSE s.gate + 1 END WHEN s.gate = 1 AND f.now > 0 THEN 2 ELSE f.want END,
       s.gate = f.want OR (s.gate = 1 AND f.now > 0) FROM f JOIN src s ON s.session = f.session AND s.j = f.j + 1""",
       """SELECT t.session, t.event_id, CAST(coalesce(last_value(a.now IGNORE NULLS) OVER (PARTITION BY t.session ORDER BY t.i), 0) AS BIGINT) AS segment
       FROM trace t LEFT JOIN (SELECT event_id, now FROM f WHERE ok) a ON a.event_id = t.event_id""").replace(", src AS MATERIALIZED", GATES + ", src AS MATERIALIZED", 1))
def seg_16(spark, sf):
    o = trace(spark, sf)
    hits = sg.ordered_gates(o.where("i % 5 = 0").cols(gate=F.col("k") % 3 + 1), "gate", 3)
    ok = hits.df.where("accepted").select(G, "gate")
    marked = Ordered(o.df.join(ok, G, "left"), ["session"]).running(seg=("last", "gate"))
    return marked.out("session", "event_id", F.coalesce("seg", F.lit(0)).cast("long").alias("segment"))


@query("SEG-17", T(f""", st AS (SELECT *, lead(e) OVER w AS ne, lead(n) OVER w AS nn, lead(t) OVER w AS nt FROM trace WINDOW w AS (PARTITION BY session, lap ORDER BY i)),
c1 AS (SELECT session, lap, min(t + (37.5-n)/(nn-n)*(nt-t)) AS t1 FROM st WHERE nn <> n AND (37.5-n)/(nn-n) BETWEEN 0 AND 1 AND e + (37.5-n)/(nn-n)*(ne-e) BETWEEN 90 AND 110 GROUP BY ALL),
c2 AS (SELECT st.session, st.lap, min(t + (62.5-e)/(ne-e)*(nt-t)) AS t2 FROM st JOIN c1 ON c1.session = st.session AND c1.lap = st.lap WHERE ne <> e AND (62.5-e)/(ne-e) BETWEEN 0 AND 1 AND n + (62.5-e)/(ne-e)*(nn-n) BETWEEN 90 AND 110
 AND t + (62.5-e)/(ne-e)*(nt-t) > t1 GROUP BY ALL),
l AS (SELECT session, lap, min(t) AS a, max(t) AS z FROM trace GROUP BY ALL)
SELECT l.session, l.lap, round(t1 - a, 2) AS sector_1, round(t2 - t1, 2) AS sector_2, round(z - t2, 2) AS sector_3 FROM l LEFT JOIN c1 ON c1.session = l.session AND c1.lap = l.lap LEFT JOIN c2 ON c2.session = l.session AND c2.lap = l.lap"""))
def seg_17(spark, sf):
    o = trace(spark, sf).rekey(["session", "lap"])
    one = sg.gate_crossings(o, (90.0, 37.5, 110.0, 37.5), "t").df.select("session", "lap", F.lit(1).alias("line"), F.col("t_cross").alias("tc"))
    two = sg.gate_crossings(o, (62.5, 90.0, 62.5, 110.0), "t").df.select("session", "lap", F.lit(2).alias("line"), F.col("t_cross").alias("tc"))
    laps = o.df.groupBy("session", "lap").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    d = sg.sector_crossings(one.unionByName(two), laps, ["session"], "lap", "a", "z")
    return d.select("session", "lap", *[r(c, 2).alias(c) for c in ("sector_1", "sector_2", "sector_3")])


POLY = {1: [(20.0, -20.0), (80.0, -20.0), (80.0, 20.0), (20.0, 20.0)], 2: [(90.0, 20.0), (120.0, 20.0), (120.0, 120.0), (90.0, 120.0)]}


@query("SEG-18", T(f""", s AS (SELECT *, CASE WHEN e > 20 AND e < 80 AND n > -20 AND n < 20 THEN 1 WHEN e > 90 AND e < 120 AND n > 20 AND n < 120 THEN 2 END AS raw FROM trace)
SELECT session, event_id, coalesce(raw, last_value(raw IGNORE NULLS){W}, first_value(raw IGNORE NULLS) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS zone FROM s"""))
def seg_18(spark, sf):
    return sg.sticky_polygons(trace(spark, sf), POLY, "e", "n", 5, "zone").out("session", "event_id", "zone")


@query("SEG-19", T(DIST_SQL + """, fr AS (SELECT session, lap, t, run/nullif(tot, 0) AS f FROM dist), g AS (SELECT session, lap, min(t) AS a, max(t) AS z FROM fr GROUP BY ALL HAVING count(*) = 16),
gp AS (SELECT session, lap, a, z, unnest([0.45, 0.83]) AS gf FROM g),
j AS (SELECT g.session, g.lap, a, z, gf, gf AS t, p.f AS pt, p.t AS pv, q.f AS qt, q.t AS qv FROM gp g ASOF JOIN fr p ON g.session = p.session AND g.lap = p.lap AND g.gf >= p.f ASOF LEFT JOIN fr q ON g.session = q.session AND g.lap = q.lap AND g.gf < q.f),
k AS (SELECT session, lap, any_value(z - a) AS lap_time, max(CASE WHEN gf < 0.5 THEN """ + LERP.format(p="pv", q="qv") + """ - a END) AS t1, max(CASE WHEN gf > 0.5 THEN """ + LERP.format(p="pv", q="qv") + """ - a END) AS t2 FROM j GROUP BY session, lap)
SELECT session, lap, round(lap_time, 6) AS lap_time, round(t1, 4) AS sector_1, round(t2 - t1, 4) AS sector_2, round(lap_time - t2, 4) AS sector_3, coalesce(0 < t1 AND t1 < t2 AND t2 < lap_time, false) AS sectors_valid FROM k"""))
def seg_19(spark, sf):
    from lapforge.operators.laps import fraction_splits
    from lapforge.plans.streams import lap_fractions

    d = fraction_splits(lap_fractions(spark, sf).df, ["session", "lap"], "frac", "t", "event_id", [0.45, 0.83])
    return d.select("session", "lap", r("lap_time").alias("lap_time"), *[r(f"sector_{i}", 4).alias(f"sector_{i}") for i in (1, 2, 3)], "sectors_valid")


@query("SEG-20", T(", flagged AS (SELECT *, e < 20 AND n > 20 AS flag FROM trace)" + RUNS + "SELECT session, round(t_in, 6) AS t_in, round(t_out, 6) AS t_out, round(t_out - t_in, 6) AS duration, n_rows FROM runs"))
def seg_20(spark, sf):
    d = sg.inside_spans(trace(spark, sf), (F.col("e") < 20) & (F.col("n") > 20), "t")
    return d.select("session", *[r(c).alias(c) for c in ("t_in", "t_out", "duration")], F.col("rows").alias("n_rows"))


@query("SEG-21", T(f""", v AS (SELECT session, i, t, avg(speed){FR(3,3)} AS v FROM trace), dv AS (SELECT *, coalesce((lead(v){W}-lag(v){W})/(lead(t){W}-lag(t){W}), (lead(v){W}-v)/(lead(t){W}-t), (v-lag(v){W})/(t-lag(t){W})) AS dv,
coalesce(lag(v,2){W}, lag(v,1){W}, v) AS app FROM v), flagged AS (SELECT *, coalesce(dv < -0.0003, false) AS flag FROM dv),
fl AS (SELECT *, sum(CASE WHEN flag IS DISTINCT FROM pf OR pf IS NULL THEN 1 ELSE 0 END){W} AS isl FROM (SELECT *, lag(flag){W} AS pf FROM flagged)),
z AS (SELECT session, isl, min(i) AS a, max(i) AS b, min(t) AS t_brake, arg_min(app, i) AS approach FROM fl WHERE flag GROUP BY session, isl),
m AS (SELECT z.session, z.a, any_value(t_brake) AS t_brake, any_value(approach) AS approach, min(v.v) AS apex FROM z JOIN v ON v.session = z.session AND v.i BETWEEN z.a AND z.b + 2 GROUP BY z.session, z.a)
SELECT session, round(t_brake, 6) AS t_brake, round(approach, 6) AS approach, round(apex, 6) AS apex FROM m WHERE approach - apex > 4"""))
def seg_21(spark, sf):
    d = sg.braking_zones(trace(spark, sf), "speed", "t", 0.0003, 2, 4.0)
    return d.select("session", *[r(c).alias(c) for c in ("t_brake", "approach", "apex")])


HIT = """, cr AS (SELECT session, i, speed, k, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS j FROM trace WHERE speed > 48)"""


@query("SEG-22", recursive("SELECT * FROM cr",
       "SELECT session, i, speed, k, j, CASE WHEN speed > 80 THEN 1 ELSE 0 END AS ev, CASE WHEN speed > 80 THEN i END AS last, CASE WHEN speed > 80 THEN i + 4 ELSE 0 END AS free, speed > 80 AS hit FROM src WHERE j = 0",
       """SELECT s.session, s.i, s.speed, s.k, s.j, CASE WHEN s.i = f.last + 1 THEN f.ev WHEN s.i >= f.free AND s.speed > 80 THEN f.ev + 1 ELSE f.ev END,
       CASE WHEN s.i = f.last + 1 OR (s.i >= f.free AND s.speed > 80) THEN s.i END, CASE WHEN s.i = f.last + 1 OR (s.i >= f.free AND s.speed > 80) THEN s.i + 4 ELSE f.free END,
       coalesce(s.i = f.last + 1, false) OR (s.i >= f.free AND s.speed > 80) FROM f JOIN src s ON s.session = f.session AND s.j = f.j + 1""",
       """SELECT session, i, acc, CAST(rk AS INTEGER) AS "rank", rk = 1 AS notable FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY acc DESC, i) AS rk FROM (
       SELECT session, ev, arg_max(i, (speed, -i)) AS i, max(speed) AS acc, arg_max(k, (speed, -i)) AS kk FROM f WHERE hit GROUP BY session, ev) WHERE kk >= 30) WHERE rk <= 5""").replace(", src AS MATERIALIZED", HIT + ", src AS MATERIALIZED", 1))
def seg_22(spark, sf):
    d = sg.impacts(trace(spark, sf), "speed", "k", 80.0, 0.6, 3, 30, 5)
    return d.select("session", F.col("_i").alias("i"), F.col("speed").alias("acc"), "rank", "notable")


@query("SEG-23", T(f""", s AS (SELECT *, coalesce(last_value(CASE WHEN speed <= 12 THEN true WHEN speed >= 30 THEN false END IGNORE NULLS){W}, false) AS flag FROM trace), flagged AS (SELECT * FROM s)""" + RUNS +
       "SELECT session, round(t_in, 6) AS t_in, round(t_out - t_in, 6) AS duration FROM runs WHERE t_out - t_in BETWEEN 10000 AND 250000"))
def seg_23(spark, sf):
    o = sg.hysteresis(trace(spark, sf), F.col("speed") <= 12, F.col("speed") >= 30, "stopped")
    d = sg.inside_spans(o.cut(), F.col("stopped"), "t").where("duration between 10000 and 250000")
    return d.select("session", r("t_in").alias("t_in"), r("duration").alias("duration"))


INC = f""", cr AS (SELECT session, event_id, i, i AS j, speed AS v, speed - lag(speed){W} AS a, k AS w, t - lag(t){W} AS dt FROM trace)"""
_AB = "(NOT f.inc AND s.v < 15 AND (s.a < -40 OR s.w > 95))"
_LOW = "CASE WHEN s.v < 12 THEN f.low + s.dt ELSE 0.0 END"
_REC = "CASE WHEN s.v > 40 THEN (CASE WHEN " + _AB + " THEN 0.0 ELSE f.rec END) + s.dt ELSE 0.0 END"


@query("SEG-24", recursive("SELECT * FROM cr", "SELECT session, event_id, i, j, false AS inc, CAST(0 AS DOUBLE) AS low, CAST(0 AS DOUBLE) AS rec, false AS shown, false AS abrupt, false AS ended FROM src WHERE j = 0",
       f"""SELECT s.session, s.event_id, s.i, s.j,
       CASE WHEN f.inc OR {_AB} THEN NOT ({_REC} > 30000) ELSE {_LOW} > 60000 END,
       CASE WHEN f.inc THEN f.low WHEN {_AB} THEN 0.0 WHEN {_LOW} > 60000 THEN 0.0 ELSE {_LOW} END,
       CASE WHEN f.inc OR {_AB} THEN CASE WHEN {_REC} > 30000 THEN 0.0 ELSE {_REC} END ELSE f.rec END,
       CASE WHEN f.inc OR {_AB} THEN true ELSE {_LOW} > 60000 END, coalesce({_AB}, false), (f.inc OR {_AB}) AND {_REC} > 30000
       FROM f JOIN src s ON s.session = f.session AND s.j = f.j + 1""",
       """SELECT session, event_id, shown OR coalesce(lead(abrupt) OVER (PARTITION BY session ORDER BY i), false) OR coalesce(lag(ended) OVER (PARTITION BY session ORDER BY i), false) AS incident FROM f""").replace(", src AS MATERIALIZED", INC + ", src AS MATERIALIZED", 1))
def seg_24(spark, sf):
    o = trace(spark, sf).lag(ps="speed").cols(acc=F.col("speed") - F.col("ps"))
    o = sg.incident_status(o, "speed", "acc", "k", "t", 15, -40, 95, 12, 60000, 40, 30000, 0.01)
    return o.out("session", "event_id", "incident")


@query("SEG-25", T(f""", s AS (SELECT *, coalesce(t - max(CASE WHEN k > 80 THEN t END){W} <= 30000, false) AS yellow, coalesce(t - max(CASE WHEN speed > 150 THEN t END){W} <= 75000, false) AS red FROM trace)
SELECT session, event_id, CASE WHEN red THEN 'red' WHEN yellow THEN 'yellow' ELSE 'green' END AS flag FROM s"""))
def seg_25(spark, sf):
    o = sg.latch(trace(spark, sf), F.col("k") > 80, "t", 30000, "yellow")
    o = sg.latch(o, F.col("speed") > 150, "t", 75000, "red")
    return o.out("session", "event_id", F.when(F.col("red"), "red").when(F.col("yellow"), "yellow").otherwise("green").alias("flag"))


@query("SEG-26", T(", flagged AS (SELECT *, speed < 10 AS flag FROM trace)" + RUNS + "SELECT session, round(t_in, 6) AS t_in, round(t_out, 6) AS t_out, n_rows FROM runs WHERE n_rows >= 2"))
def seg_26(spark, sf):
    o = trace(spark, sf).cols(v=F.when(F.col("speed") < 10, 0.0).otherwise(F.col("speed")))
    d = sg.runs(o, F.col("v") == 0, "t").where("rows >= 2")
    return d.select("session", r("t_in").alias("t_in"), r("t_out").alias("t_out"), F.col("rows").alias("n_rows"))


# Steps ``z(session, lap2, k, m, ...)`` of a lap against each other: joints do not count, a step straight back does.
SELF = """y AS (SELECT a.session, a.lap2, b.e-a.e AS qx, b.n-a.n AS qy, a.ne-a.e AS rx, a.nn-a.n AS ry, b.ne-b.e AS sx, b.nn-b.n AS sy,
    b.k = a.k + 1 OR (b.k - a.k = a.m - 1 AND b.ne = a.e AND b.nn = a.n) AS joined FROM z a JOIN z b ON a.session = b.session AND a.lap2 = b.lap2 AND b.k > a.k),
x AS (SELECT *, rx*sy - ry*sx AS det, (qx*rx + qy*ry)/(rx*rx + ry*ry) AS t0, (qx*rx + qy*ry + sx*rx + sy*ry)/(rx*rx + ry*ry) AS t1 FROM y)"""
MEET = """CASE WHEN joined THEN abs(det) <= 1e-12 AND rx*sx + ry*sy < 0
    WHEN abs(det) <= 1e-12 THEN abs(qx*ry - qy*rx) <= 1e-12 AND greatest(t0, t1) >= 0 AND least(t0, t1) <= 1
    ELSE (qx*sy-qy*sx)/det BETWEEN 0 AND 1 AND (qx*ry-qy*rx)/det BETWEEN 0 AND 1 END"""
BARRIER = (100.2, 60.3, 120.0, 60.3)


@query("SEG-27", T(CNT + """, tl AS (SELECT session, lap_no - 1 AS lap2, i, e, n, count(*) OVER (PARTITION BY session, lap_no) AS n_rows FROM lm WHERE lap_no > 1 AND lap_no <> top),
sq AS (SELECT *, lead(e) OVER w AS ne, lead(n) OVER w AS nn FROM tl WHERE n_rows >= 10 WINDOW w AS (PARTITION BY session, lap2 ORDER BY i)),
z AS (SELECT *, row_number() OVER (PARTITION BY session, lap2 ORDER BY i) AS k, count(*) OVER (PARTITION BY session, lap2) AS m FROM sq WHERE ne <> e OR nn <> n),
""" + SELF + """,
ba AS (SELECT session, lap2 FROM sq WHERE CASE WHEN nn <> n THEN (60.3 - n)/(nn - n) BETWEEN 0 AND 1 AND e + (60.3 - n)/(nn - n)*(ne - e) BETWEEN 100.2 AND 120
    ELSE n = 60.3 AND greatest(e, ne) >= 100.2 AND least(e, ne) <= 120 END)
SELECT session, lap2 AS lap FROM x WHERE """ + MEET + " UNION SELECT session, lap2 FROM ba"))
def seg_27(spark, sf):
    """Timed laps of at least ten rows, numbered from 1, whose path crosses itself or meets a barrier."""
    o = sg.lap_counter(crossed_rows(spark, sf), F.col("crossed")).where("lap_name = 'timed'").cols(lap=F.col("timed_no"))
    return sg.anomalous_laps(o.map(lambda d: d.select("session", "lap", "e", "n", G)), "lap", [BARRIER], 10, 25.0, reach=16)


@query("SEG-28", T(""", l AS (SELECT session, lap, max(t) - min(t) AS lap_time, max(k) AS peak FROM trace GROUP BY ALL HAVING count(*) = 16)
SELECT session, lap, round(lap_time, 6) AS lap_time, round(lap_time - best, 6) AS lost, peak FROM (SELECT *, min(lap_time) OVER (PARTITION BY session) AS best FROM l) WHERE lap_time > 1.05*best"""))
def seg_28(spark, sf):
    from lapforge.operators.laps import incident_laps

    laps = trace(spark, sf).df.groupBy("session", "lap").agg((F.max("t") - F.min("t")).alias("lap_time"), F.max("k").alias("peak"), F.count(F.lit(1)).alias("c")).where("c = 16")
    return incident_laps(laps, ["session"], 1.05).select("session", "lap", r("lap_time").alias("lap_time"), r("lost").alias("lost"), "peak")


def uniform_sql(step: int) -> str:
    """CTE ``gr(session, k, e, n)``: the trace on a uniform clock, end excluded, linear in between."""
    return f""", tr AS (SELECT session, t, e, n, lead(t){W} AS nt, lead(e){W} AS ne, lead(n){W} AS nn FROM trace),
g AS (SELECT session, k, CAST(k*{step} AS DOUBLE) AS t FROM (SELECT session, unnest(range(0, CAST(ceil(max(t)/{step}) AS BIGINT))) AS k FROM trace GROUP BY session)),
gr AS MATERIALIZED (SELECT g.session, k, tr.e + CASE WHEN g.t = tr.t THEN 0 ELSE (ne - tr.e)*((g.t - tr.t)/(nt - tr.t)) END AS e, tr.n + CASE WHEN g.t = tr.t THEN 0 ELSE (nn - tr.n)*((g.t - tr.t)/(nt - tr.t)) END AS n
FROM g ASOF JOIN tr ON g.session = tr.session AND g.t >= tr.t)"""


def trace_grid(spark, sf, step: int) -> resample.Grid:
    return resample.uniform_grid(trace(spark, sf).df.select("session", "t", "event_id", "e", "n"), ["session"], "t", "event_id", ["e", "n"], 1.0 / step)


def uniform_trace(spark, sf, step: int) -> Ordered:
    return resample.uniform_ordered(trace(spark, sf).df.select("session", "t", "event_id", "e", "n"), ["session"], "t", "event_id", ["e", "n"], 1.0 / step)


@query("SEG-32", T(uniform_sql(10000) + """, sz AS (SELECT session, count(*) AS rows FROM gr GROUP BY session),
s AS (SELECT a.session, b.k - a.k AS lag, avg(sqrt(pow(a.e-b.e,2)+pow(a.n-b.n,2))) AS d FROM gr a JOIN gr b ON b.session = a.session AND b.k BETWEEN a.k + 40 AND a.k + 159 GROUP BY ALL),
m AS (SELECT s.*, lag(d) OVER w AS p, lead(d) OVER w AS q, min(d) OVER (PARTITION BY session) AS low, count(*) OVER (PARTITION BY session) AS c FROM s JOIN sz USING (session) WHERE s.lag < rows - 5 WINDOW w AS (PARTITION BY session ORDER BY s.lag)),
b AS (SELECT session, coalesce(min(CASE WHEN d <= p AND d <= q AND d <= low*1.1 THEN m.lag END), arg_min(m.lag, (d, m.lag))) AS period FROM m WHERE c > 2 GROUP BY session)
SELECT b.session, CAST(period AS INTEGER) AS period, round(d, 6) AS distance FROM b JOIN s ON s.session = b.session AND s.lag = period"""))
def seg_32(spark, sf):
    """Lags of 40 to 159 ticks of 10 000 s (the form of 20 to 80 s at half a second)."""
    return lags.lap_period(uniform_trace(spark, sf, 10000).cut(), "e", "n", 40, 160).select("session", F.col("lag").alias("period"), r("distance").alias("distance"))


@query("SEG-33", T(uniform_sql(10000) + """, c AS MATERIALIZED (SELECT session, k, e - avg(e) OVER (PARTITION BY session) AS c FROM gr), z AS (SELECT session, sum(c*c) AS z FROM c GROUP BY session),
s AS (SELECT a.session, b.k - a.k AS lag, round(sum(a.c*b.c)/any_value(z.z), 9) AS sc FROM c a JOIN c b ON b.session = a.session AND b.k BETWEEN a.k + 40 AND a.k + 180 JOIN z ON z.session = a.session GROUP BY ALL)
SELECT session, CAST(arg_max(s.lag, (sc, -s.lag)) AS INTEGER) AS period, round(max(sc), 6) AS score FROM s GROUP BY session"""))
def seg_33(spark, sf):
    s = lags.autocorrelation(trace_grid(spark, sf, 10000), "e", 40, 180)
    return lags.best_lag(s, ["session"]).select("session", F.col("lag").alias("period"), r("score").alias("score"))


LOCAL = uniform_sql(1000) + """, li AS (SELECT session, list(e ORDER BY k) AS a, list(n ORDER BY k) AS b, count(*) AS rows FROM gr GROUP BY session),
wi AS (SELECT session, win, a[win*600 + 1:win*600 + 1200] AS a, greatest(0, win*600 - 600) AS lo, b[greatest(0, win*600 - 600) + 1:win*600 + 1800] AS b
    FROM (SELECT *, unnest(range(0, greatest(0, CAST(ceil((rows - 1200)/600.0) AS BIGINT)))) AS win FROM li)),
zm AS (SELECT *, list_avg(a) AS ma, list_stddev_pop(a) AS da, list_avg(b) AS mb, list_stddev_pop(b) AS db FROM wi WHERE len(b) >= len(a) + 2),
zs AS MATERIALIZED (SELECT session, win, lo, list_transform(a, lambda x: (x - ma)/CASE WHEN da > 0 THEN da ELSE 1 END) AS a, list_transform(b, lambda x: (x - mb)/CASE WHEN db > 0 THEN db ELSE 1 END) AS b FROM zm),
sc AS (SELECT session, win, lo + k - win*600 AS lag, round(list_dot_product(a, b[k + 1:k + len(a)])/len(a), 9) AS score FROM (SELECT *, unnest(range(0, len(b) - len(a) + 1)) AS k FROM zs)),
ll AS (SELECT session, win, CAST(arg_max(sc.lag, (score, -sc.lag)) AS INTEGER) AS lag, max(score) AS score FROM sc GROUP BY session, win) """


def window_lags(spark, sf):
    """Windows of 1 200 ticks of 1 000 s every 600, searched 600 ticks to both sides: 1 201 lags."""
    return lags.local_lags(trace_grid(spark, sf, 1000), "tick", "e", "n", 1200, 600, 600)


@query("SEG-34", T(LOCAL + "SELECT session, win, lag, round(score, 6) AS score FROM ll"))
def seg_34(spark, sf):
    return window_lags(spark, sf).select("session", "win", "lag", r("score").alias("score"))


@query("AGG-21b", T(LOCAL + """, p AS (SELECT session, (win*600 + 600)*1000.0::DOUBLE AS x, ll.lag*1000.0::DOUBLE AS y, score AS w FROM ll),
m AS (SELECT session, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, count(*) AS n, avg(w) AS aw FROM p WHERE w >= 0.3 GROUP BY session),
q AS (SELECT session, any_value(mx) AS mx, any_value(my) AS my, any_value(n) AS n, any_value(aw) AS aw, sum(w*(x-mx)*(x-mx)) AS sxx, sum(w*(x-mx)*(y-my)) AS sxy, sum(w*(y-my)*(y-my)) AS syy FROM p JOIN m USING (session) WHERE w >= 0.3 GROUP BY session HAVING any_value(n) >= 3),
f AS (SELECT session, sxy/sxx AS slope, my - sxy/sxx*mx AS icpt, coalesce(abs(sxy/nullif(sqrt(sxx*syy), 0)), 0) AS r, aw FROM q),
t AS (SELECT session, median(y) AS mid, count(*) AS windows, count(CASE WHEN w >= 0.3 THEN 1 END) AS used FROM p GROUP BY session)
SELECT session, round(1 + coalesce(slope, 0), 7) AS a, round(coalesce(icpt, mid), 2) AS b, round(coalesce(r, 0), 6) AS r, windows, used, slope IS NULL OR r < 0.5 OR aw < 0.4 AS low_confidence FROM t LEFT JOIN f USING (session)"""))
def agg_21b(spark, sf):
    """The clock model fitted on the window lags of SEG-34."""
    d = window_lags(spark, sf).select("session", ((F.col("win") * 600 + 600) * 1000.0).alias("at"), (F.col("lag") * 1000.0).alias("lag"), "score")
    return lags.clock_fit(written(d, "lags"), ["session"], "at", "lag", "score").select("session", r("a", 7).alias("a"), r("b", 2).alias("b"), r("r").alias("r"), "windows", "used", "low_confidence")


@query("SEG-35", T(""", f AS (SELECT session, lap FROM trace GROUP BY ALL HAVING count(*) = 16), p AS (SELECT session, lap, (i + lap) % 16 AS p, e, n FROM trace JOIN f USING (session, lap)),
ref AS (SELECT session, p, e AS re, n AS rn FROM p WHERE lap = 0),
x AS (SELECT p.session, p.lap, s.shift, avg(pow(e-re,2)+pow(n-rn,2)) AS err FROM p, (SELECT unnest(generate_series(0, 15)) AS shift) s JOIN ref ON ref.session = p.session AND ref.p = (p.p + s.shift) % 16 GROUP BY ALL)
SELECT session, lap, CAST(arg_min(x.shift, (err, x.shift)) AS INTEGER) AS shift, round(min(err), 6) AS err FROM x GROUP BY session, lap"""))
def seg_35(spark, sf):
    o = trace(spark, sf).rekey(["session", "lap"]).totals(c=F.count(F.lit(1))).where("c = 16")
    d = o.df.select("session", "lap", ((F.col("i") + F.col("lap")) % 16).alias("p"), "e", "n", G)
    ref = d.where("lap = 0").select("session", "p", "e", "n")
    return sg.circular_shift(d, ref, ["session", "lap"], "p", "e", "n", 16, F.col("lap")).select("session", "lap", "shift", r("err").alias("err"))


@query("SEG-37", T(""", s AS (SELECT *, CAST(least(2, i // greatest(1, count(*) OVER (PARTITION BY session) // 3)) + 1 AS INTEGER) AS part FROM trace)
SELECT session, part, count(*) AS n, round(avg(speed), 6) AS mean, min(speed) AS lo, max(speed) AS hi, round(max(t) - min(t), 6) AS duration FROM s GROUP BY ALL"""))
def seg_37(spark, sf):
    return sg.thirds(trace(spark, sf), 3).df.groupBy("session", "part").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("speed")).alias("mean"), F.min("speed").alias("lo"), F.max("speed").alias("hi"), r(F.max("t") - F.min("t")).alias("duration"))


LINE38 = """, cr AS (SELECT session, event_id, i, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS j FROM trace WHERE abs(e - 50) < 3 AND NOT (n > 90))"""


@query("SEG-38", debounce_sql(LINE38, "i", "> 20", KEPT))
def seg_38(spark, sf):
    return sg.line_laps(trace(spark, sf), (50.0, 0.0), (50.0, 10.0), 3.0, F.col("n") > 90, 20).out("session", "event_id")


LINE39 = f""", dd AS (SELECT session, event_id, i, sqrt(e*e+n*n) AS d FROM trace), pp AS (SELECT *, lag(d, 5){W} AS was FROM dd), cr AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS j FROM pp WHERE d < 20 AND was >= 20)"""


@query("SEG-39", debounce_sql(LINE39, "i", ">= 4", KEPT))
def seg_39(spark, sf):
    return sg.return_laps(trace(spark, sf), hypot("e", "n"), 20.0, 5, 4).out("session", "event_id")


def clusters_sql(src: str, eps: float, min_pts: int) -> str:
    """Clusters of ``src(session, id, x, y)`` by neighbour pairs and reachability."""
    return f""", nb AS MATERIALIZED (SELECT a.session, a.id AS a, b.id AS b FROM {src} a JOIN {src} b ON a.session = b.session AND sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) <= {eps}),
core AS MATERIALIZED (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {min_pts}), ce AS MATERIALIZED (SELECT a, b FROM nb JOIN core c ON c.id = a JOIN core d ON d.id = b),
rc(root, node) AS (SELECT id, id FROM core UNION SELECT rc.root, ce.b FROM rc JOIN ce ON ce.a = rc.node), lb AS (SELECT node AS id, min(root) AS label FROM rc GROUP BY node),
cl AS (SELECT s.session, s.id, coalesce(lb.label, (SELECT min(l2.label) FROM nb JOIN lb l2 ON l2.id = nb.b WHERE nb.a = s.id), -1) AS cluster FROM {src} s LEFT JOIN lb ON lb.id = s.id) """


TREC = T("").replace("WITH ev", "WITH RECURSIVE ev", 1)


@query("SEG-29", TREC + ", pt AS MATERIALIZED (SELECT session, event_id AS id, e AS x, n AS y FROM trace)" + clusters_sql("pt", 1.2, 4) + "SELECT session, id AS event_id, cluster FROM cl")
def seg_29(spark, sf):
    from lapforge.operators.cluster import density_clusters

    d = trace(spark, sf).df.select("session", "event_id", "e", "n")
    return density_clusters(d, ["session"], "event_id", "e", "n", 1.2, 4).select("session", "event_id", "cluster")


CZ = TREC + """, sc AS (SELECT session, event_id, e, n, CAST((k - 50)*0.8 AS DOUBLE) AS turn, CAST(abs((k-50)*0.8)/10 AS DOUBLE) + abs(speed/100)*3 AS sc, speed, speed/100 AS g FROM trace), ct AS (SELECT session, quantile_cont(sc, 0.5) AS cut FROM sc GROUP BY session),
hi AS MATERIALIZED (SELECT sc.* FROM sc JOIN ct ON ct.session = sc.session WHERE sc.sc > cut), pt AS MATERIALIZED (SELECT session, event_id AS id, e AS x, n AS y FROM hi)""" + clusters_sql("pt", 2.0, 3) + """,
zz AS (SELECT hi.session, cluster, count(*) AS points, sum(e*sc)/sum(sc) AS x, sum(n*sc)/sum(sc) AS y, median(turn) AS mt, quantile_cont(abs(turn), 0.85)/10 + quantile_cont(g, 0.85)*5 + (quantile_cont(speed, 0.85) - quantile_cont(speed, 0.15))/5 AS sev, quantile_cont(speed, 0.2) AS ms
FROM hi JOIN cl ON cl.id = hi.event_id WHERE cluster >= 0 GROUP BY hi.session, cluster HAVING count(*) >= 3) """


def zones(spark, sf):
    d = trace(spark, sf).df.select("session", "event_id", "e", "n", "speed", ((F.col("k") - 50) * 0.8).alias("turn"), (F.col("speed") / 100).alias("lat"), (F.col("speed") / 100).alias("g"))
    return sg.corner_zones(d, ["session"], "event_id", "e", "n", "turn", "lat", "g", "speed", 2.0, 3, top=0.5)


@query("SEG-30", CZ + """SELECT session, cluster, points, round(x, 5) AS x, round(y, 5) AS y, CASE WHEN mt > 0 THEN 'left' ELSE 'right' END AS direction, round(sev, 7) AS severity,
CASE WHEN sev > 8 THEN 'hairpin' WHEN sev > 5 THEN 'sharp' WHEN sev > 3 THEN 'medium' ELSE 'gentle' END AS kind, round(ms, 7) AS min_speed FROM zz""")
def seg_30(spark, sf):
    return zones(spark, sf).select("session", "cluster", "points", *[r(c, 5).alias(c) for c in ("x", "y")], *[r(c, 7).alias(c) for c in ("severity", "min_speed")], "direction", "kind")


@query("SEG-31", CZ + """, me AS MATERIALIZED (SELECT a.session, a.cluster AS a, b.cluster AS b FROM zz a JOIN zz b ON a.session = b.session AND sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) <= 30),
rm(root, node) AS (SELECT cluster, cluster FROM zz UNION SELECT rm.root, me.b FROM rm JOIN me ON me.a = rm.node), gm AS (SELECT node, min(root) AS grp FROM rm GROUP BY node)
SELECT session, cluster, round(sev, 7) AS severity FROM (SELECT zz.*, row_number() OVER (PARTITION BY grp ORDER BY sev DESC, cluster) AS rn FROM zz JOIN gm ON gm.node = zz.cluster) WHERE rn = 1""")
def seg_31(spark, sf):
    from lapforge.session import written

    return sg.merge_corners(written(zones(spark, sf)), ["session"], "cluster", 30.0).select("session", "cluster", r("severity", 7).alias("severity"))


OFFS = [float(v) for v in range(-500000, 500001, 10000)]


@query("SEG-36", T(f""", f AS (SELECT session, event_id, e, t, o.off, t + o.off AS ta FROM trace, (SELECT unnest({OFFS}::DOUBLE[]) AS off) o WHERE kind <> 'error'), s AS (SELECT session, t AS st, n AS sn FROM trace WHERE kind = 'error'),
j AS (SELECT f.*, p.st AS pt, p.sn AS pn, q.st AS qt, q.sn AS qn FROM f ASOF LEFT JOIN s p ON f.session = p.session AND f.ta >= p.st ASOF LEFT JOIN s q ON f.session = q.session AND f.ta < q.st),
v AS (SELECT session, off, e, CASE WHEN pt = ta THEN pn WHEN pt IS NOT NULL AND qt IS NOT NULL THEN pn + (qn-pn)*((ta-pt)/(qt-pt)) END AS n FROM j), c AS (SELECT session, off, round(corr(e, n), 9) AS score, count(*) AS n FROM v WHERE n IS NOT NULL GROUP BY ALL),
b AS (SELECT session, CAST(arg_max(off, (score, -abs(off), -off)) AS DOUBLE) AS "offset" FROM c WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY session)
SELECT b.session, "offset", round(score, 6) AS score, n FROM b JOIN c ON c.session = b.session AND c.off = "offset" """))
def seg_36(spark, sf):
    """101 offsets (the form of half a second to both sides by 10 ms) in one pass over both streams."""
    d = trace(spark, sf).df
    s = lags.offset_scores(d.where("kind <> 'error'").select("session", "t", "event_id", "e"), d.where("kind = 'error'").select("session", "t", "event_id", "n"),
                           ["session"], "t", "event_id", "e", "n", OFFS, 500000.0)
    return lags.best_offset(s, ["session"]).select("session", "offset", r("score").alias("score"), "n")


@query("SEG-27b", T(CNT + """, sq AS (SELECT session, lap_no AS lap2, i, e, n, lead(e) OVER w AS ne, lead(n) OVER w AS nn FROM lm WHERE lap_no BETWEEN 1 AND top - 1 WINDOW w AS (PARTITION BY session, lap_no ORDER BY i)),
z AS (SELECT *, row_number() OVER (PARTITION BY session, lap2 ORDER BY i) AS k, count(*) OVER (PARTITION BY session, lap2) AS m FROM sq WHERE ne <> e OR nn <> n),
""" + SELF + """
SELECT DISTINCT session, lap2 AS lap_no FROM x WHERE """ + MEET))
def seg_27b(spark, sf):
    """Timed laps, from gate to gate, whose path crosses itself."""
    o = crossed_rows(spark, sf).running(lap_no=("count", F.when(F.col("crossed"), 1)))
    o = o.totals(top=F.max("lap_no")).where("lap_no between 1 and top - 1")
    return sg.self_crossing(o.map(lambda d: d.drop("top")), "lap_no", 10.0, reach=8)


@query("SEG-09", T(f""", st AS (SELECT *, lead(e){W} AS ne, lead(n){W} AS nn, lead(t){W} AS nt, coalesce(lead(e){W}, e) - coalesce(lag(e){W}, e) AS dx, coalesce(lead(n){W}, n) - coalesce(lag(n){W}, n) AS dy FROM trace),
ga AS (SELECT session, i AS gate, e AS gx, n AS gy, -dy/sqrt(dx*dx + dy*dy) AS ux, dx/sqrt(dx*dx + dy*dy) AS uy FROM st WHERE i % 3 = 0 AND (dx <> 0 OR dy <> 0)),
p AS (SELECT st.session, gate, i, e, n, t, nt, ne - e AS rx, nn - n AS ry, gx - e AS qx, gy - n AS qy, ux, uy FROM st JOIN ga ON ga.session = st.session WHERE nt IS NOT NULL AND speed >= 0.6),
d AS (SELECT *, rx*uy - ry*ux AS det FROM p), x AS (SELECT *, (qx*uy - qy*ux)/det AS frac, (qx*ry - qy*rx)/det AS off FROM d WHERE abs(det) > 1e-12),
hi AS (SELECT session, gate, half, CASE WHEN ry*ux - rx*uy >= 0 THEN 1 ELSE -1 END AS side, i, t + frac*(nt - t) AS tc FROM x, (SELECT unnest([4.0, 8.0, 12.0])::DOUBLE AS half) h WHERE frac BETWEEN 0 AND 1 AND abs(off) <= half),
li AS (SELECT session, gate, half, side, list_reduce(list([i] ORDER BY i), lambda a, b: CASE WHEN b[1] - a[len(a)] > 4 THEN list_concat(a, b) ELSE a END) AS keep FROM hi GROUP BY ALL),
kp AS (SELECT hi.*, tc - lag(tc) OVER (PARTITION BY hi.session, gate, half, side ORDER BY i) AS gap FROM hi JOIN li USING (session, gate, half, side) WHERE list_contains(keep, i)),
sc AS (SELECT session, gate, half, side, count(*) AS crossings, count(CASE WHEN gap > 200000 AND gap < 900000 THEN 1 END) AS clean, stddev_pop(CASE WHEN gap > 200000 AND gap < 900000 THEN gap END) AS std FROM kp GROUP BY ALL HAVING count(*) >= 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY clean DESC, coalesce(round(std, 3), 1e9), gate, half, side DESC) AS rn FROM sc)
SELECT rk.session, gate, half, side, crossings, clean, round(std, 2) AS std, round(gx - ux*half, 5) AS ax, round(gy - uy*half, 5) AS ay FROM rk JOIN ga USING (session, gate) WHERE rn = 1"""))
def seg_09(spark, sf):
    """Gate across the driven line at every third row, three widths and both directions."""
    o = trace(spark, sf).over({"dx": lambda w: F.coalesce(F.lead("e").over(w), F.col("e")) - F.coalesce(F.lag("e").over(w), F.col("e")),
                               "dy": lambda w: F.coalesce(F.lead("n").over(w), F.col("n")) - F.coalesce(F.lag("n").over(w), F.col("n"))}, before=1, after=1)
    d = gates.auto_gate(o, 3, [4.0, 8.0, 12.0], F.col("dx"), F.col("dy"), "t", (200000, 900000), gap=4, min_crossings=3, speed="speed", digits=3)
    return d.select("session", "gate", "half", "side", "crossings", "clean", r("std", 2).alias("std"), r("ax", 5).alias("ax"), r("ay", 5).alias("ay"))


GRID_ALONG, GRID_ACROSS, GRID_HALVES = [-25.0, -12.5, 0.0, 12.5, 25.0], [-1.0, 0.0, 1.0], [0.4, 1.2, 12.0]
_GRID_ROWS = ", ".join(f"('g{i}_{j}_{k}', {37.5 + a}, {b}, {h})" for i, a in enumerate(GRID_ALONG) for j, b in enumerate(GRID_ACROSS) for k, h in enumerate(GRID_HALVES))


@query("SEG-09b", T(f""", st AS (SELECT *, lead(e){W} AS ne, lead(n){W} AS nn, lead(t){W} AS nt FROM trace), g AS (SELECT * FROM (VALUES {_GRID_ROWS}) v(gate, gx, gy, half)),
cr AS (SELECT session, gate, i, CASE WHEN ne < e THEN 1 ELSE -1 END AS side, t + (gx - e)/(ne - e)*(nt - t) AS tc FROM st, g WHERE ne <> e AND (gx - e)/(ne - e) BETWEEN 0 AND 1 AND n + (gx - e)/(ne - e)*(nn - n) BETWEEN gy - half AND gy + half),
d AS (SELECT *, tc - lag(tc) OVER (PARTITION BY session, gate, side ORDER BY tc, i) AS gap FROM cr),
s AS (SELECT session, gate, side, count(*) AS crossings, count(CASE WHEN gap > 200000 AND gap < 700000 THEN 1 END) AS clean, stddev_pop(CASE WHEN gap > 200000 AND gap < 700000 THEN gap END) AS std FROM d GROUP BY ALL HAVING count(*) >= 2)
SELECT session, max(clean) AS clean, round(min(CASE WHEN clean = top THEN std END), 3) AS std FROM (SELECT *, max(clean) OVER (PARTITION BY session) AS top FROM s) GROUP BY session"""))
def seg_09b(spark, sf):
    """Grid search for the gate: most clean laps, then the least spread."""
    grid = sg.gate_grid((37.5, 0.0), (1.0, 0.0), GRID_ALONG, GRID_ACROSS, GRID_HALVES)
    d = sg.best_gate(trace(spark, sf), grid, "t", (200000, 700000), 2)
    return d.select("session", "clean", r("std", 3).alias("std"))
