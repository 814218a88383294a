"""Matching to sheets, lap, corner and coaching reports over the derived trace."""

from pyspark.sql import functions as F

from lapforge.operators import asof as aj
from lapforge.operators import coach, match, resample
from lapforge.operators import laps as lp
from lapforge.operators.clean import salted_lookup
from lapforge.operators.ordered import G, Ordered, ordered, quantiles
from lapforge.plans.aggregates import COMPLETE, sectors
from lapforge.plans.registry import query
from lapforge.plans.streams import DIST_SQL, FGRID, LAPS_SQL, LERP, lap_fractions, laps
from lapforge.plans.views import T, r, table, trace
from lapforge.session import written

# Crossings are the rows with p = 2; the sheet holds all laps of a session after the first, with small errors.
SHEET = """, x AS (SELECT session, t, event_id, lap, k FROM trace WHERE i % 16 = 2), xl AS (SELECT *, lead(t) OVER (PARTITION BY session ORDER BY t) - t AS lt, lead(k) OVER (PARTITION BY session ORDER BY t) AS nk FROM x),
sheet AS (SELECT session, lap, lt + (nk % 5)*10.5 AS lap_time FROM xl WHERE lap >= 1 AND lt IS NOT NULL),
bounds AS (SELECT session, 0 AS b, 0.0::DOUBLE AS cum FROM (SELECT DISTINCT session FROM sheet) UNION ALL SELECT session, lap, sum(lap_time) OVER (PARTITION BY session ORDER BY lap) FROM sheet),
want AS (SELECT x.session, x.t AS start, b, x.t + cum AS bt FROM x JOIN bounds USING (session)),
err AS (SELECT w.session, w.start, b, min(abs(x.t - w.bt)) AS err FROM want w JOIN x ON x.session = w.session GROUP BY ALL),
sc AS (SELECT session, start, median(err) AS med FROM err GROUP BY session, start),
anc AS (SELECT session, arg_min(start, (med, start)) AS start, min(med) AS med FROM sc GROUP BY session) """


def crossings(spark, sf):
    return trace(spark, sf).df.where("i % 16 = 2").select("session", "t", "event_id", "lap", "k")


def sheets(spark, sf):
    o = ordered(crossings(spark, sf), ["session"], ["t", "event_id"]).lead(_nt="t", nk="k")
    d = o.df.where("lap >= 1 and _nt is not null")
    return d.select("session", F.lit("sheet").alias("sheet"), "lap", (F.col("_nt") - F.col("t") + (F.col("nk") % 5) * 10.5).alias("lap_time"))


def anchors(spark, sf):
    s = sheets(spark, sf)
    b = match.boundaries(s, ["session", "sheet"], "lap", "lap_time")
    scores = match.anchor_scores(crossings(spark, sf), b, ["session"], "sheet", "t", "event_id")
    return s, match.anchor(scores, ["session"], "sheet")


@query("MAT-01", T(SHEET + "SELECT session, round(start, 6) AS start, round(med, 6) AS med_err FROM anc"))
def mat_01(spark, sf):
    return anchors(spark, sf)[1].select("session", r("start").alias("start"), r("med_err").alias("med_err"))


@query("MAT-02", T(SHEET + """, l AS (SELECT s.session, s.lap, a.start + sum(lap_time) OVER (PARTITION BY s.session ORDER BY s.lap) AS te, lap_time FROM sheet s JOIN anc a ON a.session = s.session)
SELECT session, lap, round(te - lap_time, 3) AS t_start, round(te, 3) AS t_end FROM l"""))
def mat_02(spark, sf):
    s, a = anchors(spark, sf)
    d = match.lay_laps(a, s, trace(spark, sf).df, ["session"], "sheet", "lap", "lap_time", "t", "t_us", "event_id")
    return d.select("session", "lap", r("t_start", 3).alias("t_start"), r("t_end", 3).alias("t_end"))


@query("MAT-03", T(SHEET + """, w AS (SELECT session, max(t) - min(t) AS dur FROM trace GROUP BY session), st AS (SELECT session, sum(lap_time) AS total FROM sheet GROUP BY session)
SELECT w.session, round(med + greatest(0.0, dur - (total + 120))/90, 5) AS score FROM w JOIN st ON st.session = w.session JOIN anc ON anc.session = w.session WHERE dur >= total*0.65"""))
def mat_03(spark, sf):
    s, a = anchors(spark, sf)
    win = trace(spark, sf).df.groupBy("session").agg((F.max("t") - F.min("t")).alias("duration"))
    return match.window_scores(win, s, a, ["session"], "sheet", "lap_time").select("session", r("score", 5).alias("score"))


@query("MAT-04", """WITH RECURSIVE pr AS MATERIALIZED (SELECT l_suppkey AS a, CAST(o_custkey % 40 AS BIGINT) AS b, min(l_extendedprice) AS score, min(l_quantity) AS med FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
sc AS MATERIALIZED (SELECT row_number() OVER (ORDER BY score, a, b) AS rn, * FROM pr WHERE med <= 12),
f AS (SELECT rn, a, b, score, [a] AS ua, [b] AS ub, true AS ok FROM sc WHERE rn = 1 UNION ALL
SELECT s.rn, s.a, s.b, s.score, CASE WHEN list_contains(ua, s.a) OR list_contains(ub, s.b) THEN ua ELSE list_append(ua, s.a) END, CASE WHEN list_contains(ua, s.a) OR list_contains(ub, s.b) THEN ub ELSE list_append(ub, s.b) END,
NOT (list_contains(ua, s.a) OR list_contains(ub, s.b)) FROM f JOIN sc s ON s.rn = f.rn + 1) SELECT a, b, score FROM f WHERE ok
UNION ALL SELECT NULL, b, NULL FROM (SELECT DISTINCT b FROM pr) WHERE b NOT IN (SELECT b FROM f WHERE ok)""")
def mat_04(spark, sf):
    """Windows and sheets paired greedily below an error limit; sheets without a window follow."""
    d = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = d.groupBy(F.col("l_suppkey").alias("a"), (F.col("o_custkey") % 40).alias("b")).agg(F.min("l_extendedprice").alias("score"), F.min("l_quantity").alias("med"))
    s = written(s, "pairs")
    return match.with_unmatched(match.greedy_assign(s, "a", "b", "score", "med", 12), s, "b").select("a", "b", "score")


@query("MAT-05", T(SHEET + """, det AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY t) - 1 AS j, lt, count(*) OVER (PARTITION BY session) AS have FROM xl WHERE lt BETWEEN 100000 AND 2000000),
off AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY lap) - 1 AS j, lap_time, count(*) OVER (PARTITION BY session) AS need FROM sheet),
o AS (SELECT d.session, d.j - o.j AS shift, sqrt(avg(pow(d.lt - o.lap_time, 2))) AS rmse FROM det d JOIN off o ON o.session = d.session WHERE d.j >= o.j GROUP BY ALL HAVING count(*) = least(any_value(need), any_value(have)))
SELECT session, arg_min(shift, (rmse, shift)) AS "offset", round(min(rmse), 5) AS rmse FROM o GROUP BY session"""))
def mat_05(spark, sf):
    o = ordered(crossings(spark, sf), ["session"], ["t", "event_id"]).lead(_nt="t").cols(v=F.col("_nt") - F.col("t"))
    off = ordered(sheets(spark, sf), ["session"], ["lap"]).position("j").df.select("session", "j", F.col("lap_time").alias("v"))
    d = match.align_laps(o.df.select("session", F.col("t").alias("j"), "v"), off, ["session"], "j", "v", (100000, 2000000))
    return d.select("session", "offset", r("rmse", 5).alias("rmse"))


# ---------------------------------------------------------------- laps
REF = LAPS_SQL + """, lv AS (SELECT session, lap, t_start, t_end - t_start AS lap_time, n_pts = 16 AS ok FROM laps), ref AS (SELECT session, arg_min(lap, (NOT ok, lap_time, lap)) AS ref_lap, arg_min(lap_time, (NOT ok, lap_time, lap)) AS ref_time FROM lv GROUP BY session) """


def lap_table(spark, sf):
    return laps(spark, sf).select("session", "lap", "t_start", "t_end", (F.col("t_end") - F.col("t_start")).alias("lap_time"), (F.col("n_pts") == 16).alias("sectors_valid"))


def refs(spark, sf):
    return lp.reference_lap(lap_table(spark, sf), ["session"])


@query("LAP-01", T(REF + "SELECT session, ref_lap, round(ref_time, 6) AS ref_time FROM ref"))
def lap_01(spark, sf):
    return refs(spark, sf).select("session", "ref_lap", r("ref_time").alias("ref_time"))


def clocked(spark, sf) -> Ordered:
    """Complete laps with distance, fraction and lap clock."""
    return lap_fractions(spark, sf, _s=F.min("t")).cols(clock=F.col("t") - F.col("_s")).map(lambda d: d.drop("_s"))


GT = f"coalesce({LERP.format(p='pc', q='qc')}, pc, qc)"


@query("LAP-02", T(FGRID.format(m=19) + f""", c AS (SELECT session, lap, grid, {GT} - min({GT}) OVER (PARTITION BY session, lap) AS clock FROM j),
l AS (SELECT session, lap, max(t) - min(t) AS lt FROM fr JOIN ok USING (session, lap) GROUP BY session, lap), ref AS (SELECT session, arg_min(lap, (lt, lap)) AS rl FROM l GROUP BY session)
SELECT c.session, c.lap, c.grid, round(c.clock - d.clock, 3) AS delta FROM c JOIN ref ON ref.session = c.session JOIN c d ON d.session = c.session AND d.lap = rl AND d.grid = c.grid"""))
def lap_02(spark, sf):
    o = clocked(spark, sf)
    d = lp.delta_to_reference(o.df, refs(spark, sf), ["session"], "frac", "clock", "event_id", 20)
    return d.select("session", "lap", "grid", r("delta", 3).alias("delta"))


OPP = COMPLETE + """, cl AS (SELECT s.session, s.lap, s.sector, s.duration, s.lap IN (SELECT lap FROM trace x WHERE x.session = s.session GROUP BY lap HAVING count(*) = 16) AS clean FROM sect s),
cu AS (SELECT * FROM (SELECT *, max(clean::INT) OVER (PARTITION BY session, sector) AS anyc FROM cl) WHERE clean OR anyc = 0),
opp AS (SELECT session, sector, avg(duration) - min(duration) AS loss, quantile_cont(duration, 0.9) - quantile_cont(duration, 0.5) AS spread, coalesce(stddev_samp(duration), 0)/nullif(avg(duration), 0) AS cv FROM cu GROUP BY ALL) """


def clean_sectors(spark, sf):
    full = laps(spark, sf).select("session", "lap", (F.col("n_pts") == 16).alias("clean"))
    return sectors(spark, sf).join(full, ["session", "lap"])


@query("LAP-03", T(OPP + "SELECT session, sector, round(loss, 3) AS mean_loss, round(spread, 3) AS spread, round(loss + spread, 3) AS opportunity FROM opp"))
def lap_03(spark, sf):
    d = lp.opportunity(clean_sectors(spark, sf), ["session"], "clean")
    return d.select("session", "sector", *[r(c, 3).alias(c) for c in ("mean_loss", "spread", "opportunity")])


MARKS = {"T1": (100, 0), "T2": (100, 100), "T3": (0, 100)}
CORN = DIST_SQL + """, fr AS (SELECT session, lap, i, t, speed, e, n, k, event_id, run, run/nullif(tot, 0) AS f FROM dist WHERE (session, lap) IN (SELECT (session, lap) FROM trace GROUP BY session, lap HAVING count(*) = 16)),
lt AS (SELECT session, lap, max(t) - min(t) AS lt FROM fr GROUP BY ALL), rf AS (SELECT session, arg_min(lap, (lt, lap)) AS rl FROM lt GROUP BY session),
mk AS (SELECT * FROM (VALUES ('T1', 100.0, 0.0), ('T2', 100.0, 100.0), ('T3', 0.0, 100.0)) v(corner, mx, my)),
cf AS (SELECT fr.session, corner, arg_min(f, (pow(e-mx,2)+pow(n-my,2), i)) AS cf FROM fr JOIN rf ON rf.session = fr.session AND fr.lap = rl, mk GROUP BY ALL),
hw AS (SELECT *, greatest(0.004, least(0.09, 0.45*least(coalesce(cf - lag(cf) OVER w, 9), coalesce(lead(cf) OVER w - cf, 9)))) AS half FROM cf WINDOW w AS (PARTITION BY session ORDER BY cf, corner)) """


def corners(spark, sf):
    o = clocked(spark, sf)
    c = coach.corner_fractions(o.df, refs(spark, sf), ["session"], MARKS, [0.45, 0.83])
    return o, coach.half_windows(c, ["session"], hi=0.09)


@query("LAP-04", T(CORN + "SELECT session, corner, round(cf, 6) AS frac, 1 + CASE WHEN cf >= 0.45 THEN 1 ELSE 0 END + CASE WHEN cf >= 0.83 THEN 1 ELSE 0 END AS sector FROM cf"))
def lap_04(spark, sf):
    return corners(spark, sf)[1].select("session", "corner", r("frac").alias("frac"), "sector")


@query("LAP-05", T(CORN + "SELECT session, corner, round(half, 6) AS half FROM hw"))
def lap_05(spark, sf):
    return corners(spark, sf)[1].select("session", "corner", r("half").alias("half"))


CSTAT = CORN + """, g AS (SELECT *, CASE WHEN lag(t) OVER w IS NOT NULL AND lead(t) OVER w IS NOT NULL THEN (pow(t-lag(t) OVER w,2)*lead(speed) OVER w + (pow(lead(t) OVER w-t,2)-pow(t-lag(t) OVER w,2))*speed - pow(lead(t) OVER w-t,2)*lag(speed) OVER w)/((t-lag(t) OVER w)*(lead(t) OVER w-t)*(lead(t) OVER w-lag(t) OVER w))
WHEN lead(t) OVER w IS NOT NULL THEN (lead(speed) OVER w-speed)/(lead(t) OVER w-t) ELSE (speed-lag(speed) OVER w)/(t-lag(t) OVER w) END AS dv FROM fr WINDOW w AS (PARTITION BY session, lap ORDER BY i)),
pl AS (SELECT g.session, g.lap, corner, count(CASE WHEN abs(f-cf) <= half THEN 1 END) AS c, min(CASE WHEN abs(f-cf) <= half THEN speed END) AS apex,
arg_min(e, CASE WHEN abs(f-cf) <= half THEN (speed, i) END) AS ax, arg_min(n, CASE WHEN abs(f-cf) <= half THEN (speed, i) END) AS ay,
arg_min(speed, (abs(f-cf+0.07), i)) AS entry_, arg_min(speed, (abs(f-cf-0.07), i)) AS exit_,
max(CASE WHEN f-cf > -0.3 AND f <= cf THEN run END) - min(CASE WHEN f-cf > -0.3 AND f <= cf AND dv < -0.0003 THEN run END) AS brake FROM g JOIN hw ON hw.session = g.session GROUP BY ALL HAVING count(CASE WHEN abs(f-cf) <= half THEN 1 END) >= 2),
cs AS (SELECT session, corner, count(*) AS laps, avg(apex) AS apex_mean, stddev_pop(apex) AS apex_std, sqrt(avg(pow(ax-mx,2)+pow(ay-my,2))) AS line_spread, avg(entry_) AS entry_mean, avg(exit_) AS exit_mean,
CASE WHEN count(brake) > 2 THEN stddev_pop(brake) END AS brake_std FROM (SELECT *, avg(ax) OVER (PARTITION BY session, corner) AS mx, avg(ay) OVER (PARTITION BY session, corner) AS my FROM pl) GROUP BY session, corner HAVING count(*) >= 3),
sc AS (SELECT *, apex_std/(apex_mean + 1e-6) AS apex_cv, round_even(100*(1 - 0.75*greatest(0, least(1, apex_std/(apex_mean + 1e-6)/0.12)) - 0.25*greatest(0, least(1, (line_spread-4)/8))), 0) AS score FROM cs) """


def corner_table(spark, sf):
    o, c = corners(spark, sf)
    per = coach.corner_laps(o, c, ["session"], 0.07, 0.3, 0.0003)
    return o, c, coach.corner_scores(coach.corner_stats(per, ["session"]))


@query("LAP-06", T(CSTAT + """SELECT session, corner, laps, round(apex_mean, 5) AS apex_mean, round(apex_std, 5) AS apex_std, round(line_spread, 5) AS line_spread, round(entry_mean, 5) AS entry_mean, round(exit_mean, 5) AS exit_mean, round(brake_std, 5) AS brake_std FROM sc"""))
def lap_06(spark, sf):
    s = corner_table(spark, sf)[2]
    return s.select("session", "corner", "laps", *[r(c, 5).alias(c) for c in ("apex_mean", "apex_std", "line_spread", "entry_mean", "exit_mean", "brake_std")])


@query("LAP-07", T(CSTAT + "SELECT session, corner, score FROM sc"))
def lap_07(spark, sf):
    return corner_table(spark, sf)[2].select("session", "corner", "score")


@query("LAP-07b", T(OPP + "SELECT session, sector, round_even(100*(1 - greatest(0.0, least(1.0, cv/3.0))), 0) AS score FROM opp"))
def lap_07b(spark, sf):
    d = lp.opportunity(clean_sectors(spark, sf), ["session"], "clean")
    return coach.sector_scores(d.withColumn("cv", F.col("cv") / 3.0 * 0.12)).select("session", "sector", "score")


CUE = CSTAT + """, hd AS (SELECT fr.session, corner, avg(k/97.0 - 0.5) AS yaw FROM fr JOIN hw ON hw.session = fr.session WHERE f >= cf - 0.1 AND f < cf GROUP BY ALL),
cu AS (SELECT sc.session, sc.corner, array_to_string(list_filter([CASE WHEN line_spread > 2.5 THEN 'line' END, CASE WHEN apex_cv > 0.1 THEN 'apex' END, CASE WHEN entry_mean - apex_mean > 12 THEN 'overslow' END, CASE WHEN exit_mean < apex_mean + 1 THEN 'exit' END,
CASE WHEN brake_std > 4 THEN 'brake' END, CASE WHEN abs(yaw) < 0.08 THEN 'look' END], lambda x: x IS NOT NULL), ',') AS cues FROM sc LEFT JOIN hd ON hd.session = sc.session AND hd.corner = sc.corner) """


def cue_table(spark, sf):
    o, c, s = corner_table(spark, sf)
    head = coach.head_approach(o.df.withColumn("head", F.col("k") / 97.0 - 0.5), c, ["session"], "head", 0.1)
    return s, coach.corner_cues(s, head, ["session"])


@query("LAP-08", T(CUE + "SELECT session, corner, cues FROM cu WHERE cues <> ''"))
def lap_08(spark, sf):
    return cue_table(spark, sf)[1].select("session", "corner", F.concat_ws(",", "cues").alias("cues"))


@query("LAP-09", T(CUE + """, sd AS (SELECT session, sector, duration FROM (SELECT session, lap, 1 + (i % 16)//6 AS sector, max(t) - min(t) AS duration FROM fr GROUP BY ALL)),
op AS (SELECT session, sector, avg(duration) - min(duration) + quantile_cont(duration, 0.9) - quantile_cont(duration, 0.5) AS o FROM sd GROUP BY ALL),
wk AS (SELECT session, corner, score, row_number() OVER (PARTITION BY session ORDER BY score, corner) AS p FROM sc), tp AS (SELECT session, sector, row_number() OVER (PARTITION BY session ORDER BY o DESC, sector) AS q FROM op)
SELECT wk.session, CAST(p AS INTEGER) AS priority, wk.corner AS "where", coalesce(nullif(split_part(cues, ',', 1), ''), 'repeat') AS focus FROM wk LEFT JOIN cu ON cu.session = wk.session AND cu.corner = wk.corner WHERE p <= 3
UNION ALL SELECT tp.session, CAST(coalesce(m, 0) + 1 AS INTEGER), 'sector ' || sector, 'prioritise' FROM tp LEFT JOIN (SELECT session, max(least(p, 3)) AS m FROM wk GROUP BY session) w ON w.session = tp.session WHERE q = 1"""))
def lap_09(spark, sf):
    s, cues = cue_table(spark, sf)
    full = clean_sectors(spark, sf).where("clean")
    opp = lp.opportunity(full, ["session"], "clean")
    return coach.strategy(s, cues, opp, ["session"]).select("session", "priority", "where", "focus")


@query("LAP-10", T(""", l AS (SELECT session, lap, max(t) - min(t) AS lt FROM trace GROUP BY ALL HAVING count(*) = 16), s AS (SELECT session, lap, lt - best AS lost FROM (SELECT *, min(lt) OVER (PARTITION BY session) AS best FROM l) WHERE lt > 1.05*best),
m AS (SELECT s.session, s.lap, s.lost, arg_max(event_id, (tr.k, -tr.i)) AS hit, arg_max(e, (tr.k, -tr.i)) AS e, arg_max(n, (tr.k, -tr.i)) AS n FROM s JOIN trace tr ON tr.session = s.session AND tr.lap = s.lap GROUP BY ALL)
SELECT session, lap, round(lost, 6) AS lost, hit, CASE WHEN d1 <= d2 AND d1 <= d3 THEN 'T1' WHEN d2 <= d3 THEN 'T2' ELSE 'T3' END AS near_turn FROM (SELECT *, pow(e-100,2)+pow(n,2) AS d1, pow(e-100,2)+pow(n-100,2) AS d2, pow(e,2)+pow(n-100,2) AS d3 FROM m)"""))
def lap_10(spark, sf):
    """Slow laps with the time lost and the turn nearest to the hardest sample of the lap."""
    d = trace(spark, sf).df
    peak = F.max_by(F.struct(F.col("event_id").alias("hit"), "e", "n"), F.struct("k", -F.col("i")))
    per = d.groupBy("session", "lap").agg((F.max("t") - F.min("t")).alias("lap_time"), F.count(F.lit(1)).alias("c"), peak.alias("p")).where("c = 16")
    slow = lp.incident_laps(per, ["session"], 1.05)
    turn = aj.zone_label(F.col("p.e"), F.col("p.n"), [(m, x, y, 1e6) for m, (x, y) in MARKS.items()])
    return slow.select("session", "lap", r("lost").alias("lost"), "p.hit", turn.alias("near_turn"))


@query("LAP-11", T(OPP + """, b AS (SELECT session, max(CASE WHEN sector = 1 THEN m END) b1, max(CASE WHEN sector = 2 THEN m END) b2, max(CASE WHEN sector = 3 THEN m END) b3 FROM (SELECT session, sector, min(duration) AS m FROM cl WHERE clean GROUP BY ALL) GROUP BY session)
SELECT session, grid, round(CASE WHEN f <= 0.45 THEN b1*f/0.45 WHEN f <= 0.83 THEN b1 + b2*(f-0.45)/0.38 ELSE b1 + b2 + b3*(f-0.83)/0.17 END, 3) AS ideal_t, round(b1+b2+b3, 3) AS ideal_time
FROM (SELECT *, grid/39.0 AS f FROM b, generate_series(0, 39) g(grid))"""))
def lap_11(spark, sf):
    d = lp.ideal_lap(clean_sectors(spark, sf).where("clean"), ["session"], [0.45, 0.83], 40)
    return d.select("session", "grid", r("ideal_t", 3).alias("ideal_t"), r("ideal_time", 3).alias("ideal_time"))


@query("LAP-12", T(FGRID.format(m=19) + f""", c AS (SELECT session, lap, grid, {GT} AS tt, coalesce({LERP.format(p='pv', q='qv')}, pv, qv) AS v FROM j), s9 AS (SELECT session, lap, max(CASE WHEN grid = 9 THEN tt END) - min(tt) AS s1, min(CASE WHEN grid <= 9 THEN v END) AS apex FROM c GROUP BY ALL)
SELECT session, lap, row_number() OVER (PARTITION BY session ORDER BY s1, lap) AS place, round(s1 - min(s1) OVER (PARTITION BY session), 3) AS delta, round(apex, 6) AS apex, round(max(apex) OVER (PARTITION BY session) - min(apex) OVER (PARTITION BY session), 6) AS apex_spread FROM s9"""))
def lap_12(spark, sf):
    """First part of every lap on a common grid: ranked, delta to the best, spread of the lowest speed."""
    g = resample.fraction_grid(clocked(spark, sf).df, ["session", "lap"], "frac", "event_id", ["clock", "speed"], 20)
    s = g.groupBy("session", "lap").agg(F.max(F.when(F.col("grid") == 9, F.col("clock"))).alias("s1"), F.min(F.when(F.col("grid") <= 9, F.col("speed"))).alias("apex"))
    o = ordered(s, ["session"], ["s1", "lap"]).totals(_start=F.min(G), best=F.min("s1"), hi=F.max("apex"), lo=F.min("apex"))
    return o.out("session", "lap", (F.col(G) - F.col("_start") + 1).alias("place"), r(F.col("s1") - F.col("best"), 3).alias("delta"), r("apex").alias("apex"), r(F.col("hi") - F.col("lo")).alias("apex_spread"))


@query("LAP-13", T(CORN + "SELECT fr.session, corner, round(avg(k/97.0 - 0.5), 6) AS head_yaw FROM fr JOIN hw ON hw.session = fr.session WHERE f >= cf - 0.1 AND f < cf GROUP BY ALL"))
def lap_13(spark, sf):
    o, c = corners(spark, sf)
    d = coach.head_approach(o.df.withColumn("head", F.col("k") / 97.0 - 0.5), c, ["session"], "head", 0.1)
    return d.select("session", "corner", r("head_yaw").alias("head_yaw"))


@query("LAP-14", T(""", sp AS (SELECT session, max(t) AS hi, min(e) AS x0, max(e) AS x1, min(n) AS y0, max(n) AS y1 FROM trace GROUP BY session), g AS (SELECT session, x0, x1, y0, y1, unnest(generate_series(0, CAST(ceil(hi/30000.0) AS BIGINT) - 1)) AS tick FROM sp),
j AS (SELECT g.*, tick*30000.0 AS t, p.t AS pt, p.e AS pe, p.n AS pn, q.t AS qt, q.e AS qe, q.n AS qn, p.lap FROM g ASOF LEFT JOIN trace p ON g.session = p.session AND tick*30000.0 >= p.t ASOF LEFT JOIN trace q ON g.session = q.session AND tick*30000.0 < q.t)
SELECT session, tick, round((CASE WHEN pt = t THEN pe ELSE pe + (qe-pe)*((t-pt)/(qt-pt)) END - x0)/(x1-x0), 6) AS x, round((CASE WHEN pt = t THEN pn ELSE pn + (qn-pn)*((t-pt)/(qt-pt)) END - y0)/(y1-y0), 6) AS y, lap FROM j"""))
def lap_14(spark, sf):
    o = trace(spark, sf)
    d = resample.mixed(o.df, ["session"], "t", "event_id", ["e", "n"], ["lap"], 1 / 30000.0)
    box = o.df.groupBy("session").agg(F.min("e").alias("x0"), F.max("e").alias("x1"), F.min("n").alias("y0"), F.max("n").alias("y1"))
    d = salted_lookup(d, box, ["session"], F.col("tick"))
    unit = lambda c, a, b: r((F.col(c) - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0.0)))
    return d.select("session", "tick", unit("e", "x0", "x1").alias("x"), unit("n", "y0", "y1").alias("y"), "lap")


@query("LAP-15", """WITH s AS (SELECT c_custkey AS driver, c_name AS name, c_acctbal/1000 AS sheet_cv FROM customer), t AS (SELECT o_custkey AS driver, count(*) AS laps, stddev_samp(o_totalprice)/avg(o_totalprice) AS cv FROM orders GROUP BY 1)
SELECT s.driver, name, laps, round(coalesce(cv, sheet_cv), 6) AS cv, CASE WHEN cv IS NULL THEN 'sheet' ELSE 'telemetry' END AS source FROM s LEFT JOIN t ON t.driver = s.driver""")
def lap_15(spark, sf):
    """One row per sheet; spread measured from telemetry wins over the sheet's own."""
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("driver"), F.col("c_name").alias("name"), (F.col("c_acctbal") / 1000).alias("sheet_cv"))
    t = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("driver")).agg(
        F.count(F.lit(1)).alias("laps"), (F.stddev_samp("o_totalprice") / F.avg("o_totalprice")).alias("cv"))
    return s.join(t, "driver", "left").select("driver", "name", "laps", r(F.coalesce("cv", "sheet_cv")).alias("cv"), F.when(F.col("cv").isNull(), "sheet").otherwise("telemetry").alias("source"))


@query("LAP-16", T(CSTAT + """, ap AS (SELECT fr.session, corner, arg_min(t, (pow(e-mx,2)+pow(n-my,2), i)) - min(t) AS ta FROM fr JOIN rf ON rf.session = fr.session AND fr.lap = rl, mk GROUP BY ALL),
wk AS (SELECT session, corner, row_number() OVER (PARTITION BY session ORDER BY score, corner) AS p FROM sc), z AS (SELECT ap.*, row_number() OVER (PARTITION BY ap.session ORDER BY ta, ap.corner) AS beat FROM ap JOIN wk ON wk.session = ap.session AND wk.corner = ap.corner WHERE p <= 4)
SELECT session, CAST(beat AS INTEGER) AS beat, corner, round(ta, 6) AS apex_t FROM z WHERE beat <= 3"""))
def lap_16(spark, sf):
    """The four weakest corners in order of their apex time on the reference lap, first three."""
    from pyspark.sql import Window

    o, _, s = corner_table(spark, sf)
    lap = salted_lookup(o.df, refs(spark, sf), ["session"], F.col(G), "inner").where("lap = ref_lap")
    at = aj.landmark_snap(lap, ["session"], MARKS, "e", "n", G, ["clock"]).select("session", F.col("landmark").alias("corner"), F.col("clock").alias("at"))
    weak = s.withColumn("_p", F.row_number().over(Window.partitionBy("session").orderBy("score", "corner"))).where("_p <= 4")
    d = at.join(weak.select("session", "corner"), ["session", "corner"])
    d = d.withColumn("beat", F.row_number().over(Window.partitionBy("session").orderBy("at", "corner"))).where("beat <= 3")
    return d.select("session", "beat", "corner", r("at").alias("apex_t"))


@query("LAP-17", T("""SELECT session, round(max(speed), 6) AS max_speed, round(quantile_cont(speed*k/1000, 0.99), 6) AS p99_g, round(max(e) - min(e), 6) AS width, count(*) AS n,
CASE WHEN max(speed) <= 400 AND quantile_cont(speed*k/1000, 0.99) <= 30 AND max(e) - min(e) BETWEEN 50 AND 500 AND count(lat) = count(*) THEN 'PASS' ELSE 'CHECK' END AS status FROM trace GROUP BY session"""))
def lap_17(spark, sf):
    d = trace(spark, sf).df.withColumn("g", F.col("speed") * F.col("k") / 1000)
    a = d.groupBy("session").agg(F.max("speed").alias("mx"), (F.max("e") - F.min("e")).alias("w"), F.count(F.lit(1)).alias("n"), F.count("lat").alias("have"))
    a = a.join(quantiles(d, ["session"], ["g"], {"p99": 0.99}), "session")
    ok = (F.col("mx") <= 400) & (F.col("g_p99") <= 30) & F.col("w").between(50, 500) & (F.col("have") == F.col("n"))
    return a.select("session", r("mx").alias("max_speed"), r("g_p99").alias("p99_g"), r("w").alias("width"), "n", F.when(ok, "PASS").otherwise("CHECK").alias("status"))


@query("LAP-18", T(LAPS_SQL + """SELECT l.session, l.lap, count(*) AS n, round(avg(speed), 6) AS mean_level, max(speed) AS peak, round(avg(CASE WHEN k > 50 THEN 1.0 ELSE 0.0 END), 6) AS active
FROM trace tr JOIN laps l ON l.session = tr.session AND tr.t BETWEEN l.t_start AND l.t_end GROUP BY l.session, l.lap"""))
def lap_18(spark, sf):
    """Feature rows summed over the lap interval that holds them."""
    spans = laps(spark, sf).withColumn("event_id", F.col("lap"))
    d = aj.in_interval(trace(spark, sf).df.drop("lap"), spans, ["session"], "t", "event_id", "t_start", "t_end", ["lap"]).where("lap is not null")
    return d.groupBy("session", "lap").agg(F.count(F.lit(1)).alias("n"), r(F.avg("speed")).alias("mean_level"), F.max("speed").alias("peak"), r(F.avg((F.col("k") > 50).cast("double"))).alias("active"))


@query("LAP-19", T(""", c AS (SELECT session, lap, event_id, lon, t - min(t) OVER (PARTITION BY session, lap) AS clock FROM trace), s AS (SELECT *, CAST(floor(clock/(max(clock) OVER (PARTITION BY session, lap)/4)) AS BIGINT) AS slice FROM
(SELECT * FROM c WHERE (session, lap) IN (SELECT (session, lap) FROM c GROUP BY session, lap HAVING max(clock) > 0))), m AS (SELECT *, abs(lon - avg(lon) OVER (PARTITION BY session, lap, slice)) AS off FROM s WHERE slice < 4)
SELECT session, lap, slice, count(*) AS n, round(min(off)*1e6, 3) AS nearest, round(max(off)*1e6, 3) AS farthest FROM m GROUP BY ALL"""))
def lap_19(spark, sf):
    o = trace(spark, sf).rekey(["session", "lap"]).totals(_s=F.min("t")).cols(clock=F.col("t") - F.col("_s"))
    d = o.df
    b = lp.boundary_slices(d, ["session", "lap"], "clock", G, 4)
    side = d.select(F.col(G).alias("_id"), "lon")
    x = b.join(side.select(F.col("_id").alias("left"), F.col("lon").alias("near_lon")), "left").join(side.select(F.col("_id").alias("right"), F.col("lon").alias("far_lon")), "right")
    span = d.groupBy("session", "lap").agg(F.max("clock").alias("_sp")).where("_sp > 0")
    m = salted_lookup(d, span, ["session", "lap"], F.col(G), "inner").withColumn("slice", F.floor(F.col("clock") / (F.col("_sp") / 4))).where("slice < 4")
    mean = m.groupBy("session", "lap", "slice").agg(F.count(F.lit(1)).alias("n"), F.avg("lon").alias("mid"))
    x = x.join(mean, ["session", "lap", "slice"])
    far = lambda c: r(F.abs(F.col(c) - F.col("mid")) * 1e6, 3)
    return x.select("session", "lap", "slice", "n", far("near_lon").alias("nearest"), far("far_lon").alias("farthest"))


@query("LAP-20", T(""", p AS (SELECT session, event_id, e, n, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS side FROM trace), a AS (SELECT *, atan2(e - avg(e) OVER (PARTITION BY session), n - avg(n) OVER (PARTITION BY session)) AS ang FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY session, side ORDER BY ang, event_id) - 1 AS rk, count(*) OVER (PARTITION BY session, side) AS c FROM a), m AS (SELECT session, min(c) AS m FROM (SELECT session, side, count(*) AS c FROM p GROUP BY ALL) GROUP BY session),
s AS (SELECT session, m, unnest(generate_series(0, m - 1)) AS slot FROM m)
SELECT s.session, s.slot, round((x.e + y.e)/2, 6) AS e, round((x.n + y.n)/2, 6) AS n FROM s JOIN k x ON x.session = s.session AND x.side = 0 AND x.rk = CAST(floor(s.slot*(x.c-1)/greatest(m-1, 1)) AS BIGINT) JOIN k y ON y.session = s.session AND y.side = 1 AND y.rk = CAST(floor(s.slot*(y.c-1)/greatest(m-1, 1)) AS BIGINT)"""))
def lap_20(spark, sf):
    d = trace(spark, sf).df.withColumn("side", F.when(F.col("k") % 3 == 0, 1).otherwise(0))
    c = lp.centre_line(d.select("session", "event_id", "e", "n", "side"), ["session"], "side", "e", "n", "event_id")
    return c.select("session", "slot", r("e").alias("e"), r("n").alias("n"))


@query("LAP-21", T(FGRID.format(m=39) + f""", c AS (SELECT session, lap, grid, coalesce({LERP.format(p='pv', q='qv')}, pv, qv) AS v FROM j), l AS (SELECT session, lap, max(t) - min(t) AS lt FROM fr JOIN ok USING (session, lap) GROUP BY session, lap),
bw AS (SELECT session, arg_min(lap, (lt, lap)) AS bl, arg_max(lap, (lt, lap)) AS wl FROM l GROUP BY session HAVING count(*) > 1), d AS (SELECT b.session, b.grid, b.v - w.v AS dv FROM c b JOIN bw ON bw.session = b.session AND b.lap = bl JOIN c w ON w.session = b.session AND w.lap = wl AND w.grid = b.grid),
m AS (SELECT *, avg(dv) OVER (PARTITION BY session ORDER BY grid ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m FROM d), g9 AS (SELECT *, CASE WHEN m > 2 THEN 1 WHEN m < -2 THEN -1 ELSE 0 END AS sg FROM m),
h AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> sg THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY grid) AS isl FROM (SELECT *, lag(sg) OVER (PARTITION BY session ORDER BY grid) AS ps FROM g9))
SELECT session, min(grid) AS g_from, max(grid) AS g_to, sg AS sign, round(avg(m), 5) AS mean_diff FROM h WHERE sg <> 0 GROUP BY session, isl, sg"""))
def lap_21(spark, sf):
    """Best minus worst lap speed on a common grid; forward means beyond 2 merged into sections."""
    o = clocked(spark, sf)
    g = resample.fraction_grid(o.df, ["session", "lap"], "frac", "event_id", ["speed"], 40)
    lt = o.df.groupBy("session", "lap").agg(F.max("clock").alias("lt"))
    ends = lt.groupBy("session").agg(F.min_by("lap", F.struct("lt", "lap")).alias("bl"), F.max_by("lap", F.struct("lt", "lap")).alias("wl"), F.count(F.lit(1)).alias("c")).where("c > 1")
    t = salted_lookup(g, ends, ["session"], F.col("grid"), "inner")
    d = t.where("lap = bl or lap = wl").groupBy("session", "grid").agg(
        (F.max(F.when(F.col("lap") == F.col("bl"), F.col("speed"))) - F.max(F.when(F.col("lap") == F.col("wl"), F.col("speed")))).alias("dv"))
    s = ordered(d, ["session"], ["grid"]).over({"m": lambda w: F.avg("dv").over(w.rowsBetween(0, 3))}, before=0, after=3)
    s = s.cols(sg=F.when(F.col("m") > 2, 1).when(F.col("m") < -2, -1).otherwise(0)).cut().islands(F.col("sg"))
    return s.df.where("sg <> 0").groupBy("session", "island", "sg").agg(F.min("grid").alias("g_from"), F.max("grid").alias("g_to"), r(F.avg("m"), 5).alias("mean_diff")).select(
        "session", "g_from", "g_to", F.col("sg").alias("sign"), "mean_diff")
