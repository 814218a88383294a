"""Joins of streams, windows and resampling over the derived trace."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapforge.functions.geo import G0, hypot, wrap180
from lapforge.operators import asof as aj
from lapforge.operators import clean, resample, smooth
from lapforge.operators.ordered import G, Ordered, ordered, quantiles
from lapforge.plans.registry import query
from lapforge.plans.views import T, events, r, recursive, table, trace
from lapforge.session import by_key

HAV_FREE = ("2*6371000.0*asin(least(1.0, sqrt(pow(sin((radians(lat)-radians(pa))/2),2)"
            "+cos(radians(pa))*cos(radians(lat))*pow(sin((radians(lon)-radians(po))/2),2))))")
SLOW, FAST = "kind = 'error'", "kind <> 'error'"


def streams(spark, sf):
    d = trace(spark, sf).df
    return d.where(FAST), d.where(SLOW)


@query("JON-01", """WITH a AS (SELECT user_id session, ts, value FROM events WHERE value > 10), g AS (SELECT user_id session, ts, event_id FROM events WHERE event_type <> 'error'),
o AS (SELECT user_id session, ts, event_type FROM events WHERE value < 200)
SELECT session, epoch_us(ts) AS t_us, value AS acc_value, event_id AS gyro_id, event_type AS ori_kind FROM a JOIN g USING (session, ts) JOIN o USING (session, ts)""")
def jon_01(spark, sf):
    ev = events(spark, sf)
    acc = ev.where("speed > 10").select("session", "t_us", F.col("speed").alias("acc_value"))
    gyro = ev.where(FAST).select("session", "t_us", F.col("event_id").alias("gyro_id"))
    ori = ev.where("speed < 200").select("session", "t_us", F.col("kind").alias("ori_kind"))
    return acc.join(gyro, ["session", "t_us"]).join(ori, ["session", "t_us"])


@query("JON-02", """SELECT a.l_orderkey, a.l_linenumber, round(a.l_quantity + b.l_tax, 6) AS fused FROM lineitem a
JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber ORDER BY 1, 2""")
def jon_02(spark, sf):
    li = table(spark, sf, "lineitem")
    acc = li.select("l_orderkey", "l_linenumber", "l_quantity")
    gyro = li.select("l_orderkey", "l_linenumber", "l_tax")
    return acc.join(gyro, ["l_orderkey", "l_linenumber"]).orderBy("l_orderkey", "l_linenumber").select(
        "l_orderkey", "l_linenumber", r(F.col("l_quantity") + F.col("l_tax")).alias("fused"))


NEAR = """, f AS (SELECT * FROM trace WHERE kind <> 'error'), s AS (SELECT session, t AS st, speed AS sv, e AS se, n AS sn, k AS sk FROM trace WHERE kind = 'error'),
j AS (SELECT f.*, p.st AS pt, p.sv AS pv, p.se AS pe, p.sn AS pn, p.sk AS pk, q.st AS qt, q.sv AS qv, q.se AS qe, q.sn AS qn, q.sk AS qk FROM f
ASOF LEFT JOIN s p ON f.session = p.session AND f.t >= p.st
ASOF LEFT JOIN s q ON f.session = q.session AND f.t < q.st) """


@query("JON-03", T(NEAR + """SELECT session, event_id, round(CASE WHEN near <= 20000 THEN v END, 6) AS r_speed FROM (
SELECT session, event_id, CASE WHEN pt IS NOT NULL AND (qt IS NULL OR t - pt <= qt - t) THEN pv ELSE qv END AS v,
CASE WHEN pt IS NOT NULL AND (qt IS NULL OR t - pt <= qt - t) THEN t - pt ELSE qt - t END AS near FROM j)"""))
def jon_03(spark, sf):
    fast, slow = streams(spark, sf)
    d = aj.asof(fast, slow, ["session"], "t", "event_id", ["speed"], "nearest", 20000.0)
    return d.select("session", "event_id", r("r_speed").alias("r_speed"))


@query("JON-04", T(NEAR + """SELECT session, event_id, round(pv, 6) AS r_speed, round(t - pt, 6) AS age FROM j"""))
def jon_04(spark, sf):
    fast, slow = streams(spark, sf)
    d = aj.asof(fast, slow, ["session"], "t", "event_id", ["speed"])
    return d.select("session", "event_id", r("r_speed").alias("r_speed"), r(F.col("t") - F.col("r_t")).alias("age"))


LERP = "CASE WHEN pt = t THEN {p} WHEN pt IS NOT NULL AND qt IS NOT NULL THEN {p} + ({q}-{p})*((t-pt)/(qt-pt)) END"


@query("JON-05", T(NEAR + f"""SELECT session, event_id, round(coalesce({LERP.format(p='pv', q='qv')}, pv, qv), 6) AS clamped,
round({LERP.format(p='pe', q='qe')}, 6) AS strict FROM j"""))
def jon_05(spark, sf):
    fast, slow = streams(spark, sf)
    d = aj.bracket(fast, slow, ["session"], "t", "event_id", ["speed", "e"])
    return d.select("session", "event_id", r(aj.lerp(F.col("t"), "speed")).alias("clamped"),
                    r(aj.lerp(F.col("t"), "e", "null")).alias("strict"))


@query("JON-05b", T(""", f AS (SELECT * FROM trace WHERE kind <> 'error'), s0 AS (SELECT session, t AS st, speed AS sv FROM trace WHERE kind = 'error'),
s AS (SELECT *, coalesce((lead(sv) OVER w - sv)/(lead(st) OVER w - st), (sv - lag(sv) OVER w)/(st - lag(st) OVER w)) AS slope FROM s0 WINDOW w AS (PARTITION BY session ORDER BY st)),
j AS (SELECT f.*, coalesce(p.st, q.st) kt, coalesce(p.sv, q.sv) kv, CASE WHEN p.st IS NULL THEN q.slope ELSE p.slope END AS sl FROM f
ASOF LEFT JOIN s p ON f.session = p.session AND f.t >= p.st ASOF LEFT JOIN s q ON f.session = q.session AND f.t < q.st)
SELECT session, event_id, round(kv + (t - kt)*coalesce(sl, 0.0), 5) AS speed FROM j"""))
def jon_05b(spark, sf):
    fast, slow = streams(spark, sf)
    d = aj.interpolate(fast.drop("speed"), slow, ["session"], "t", "event_id", ["speed"], "extend")
    return d.select("session", "event_id", r("speed", 5).alias("speed"))


@query("JON-06", T(NEAR + """SELECT session, event_id, round(degrees(atan2(coalesce(CASE WHEN pt = t THEN sin(pa) WHEN pt IS NOT NULL AND qt IS NOT NULL THEN sin(pa)+(sin(qa)-sin(pa))*((t-pt)/(qt-pt)) END, sin(pa), sin(qa)),
coalesce(CASE WHEN pt = t THEN cos(pa) WHEN pt IS NOT NULL AND qt IS NOT NULL THEN cos(pa)+(cos(qa)-cos(pa))*((t-pt)/(qt-pt)) END, cos(pa), cos(qa)))), 4) AS heading
FROM (SELECT *, radians(pk*3.5) AS pa, radians(qk*3.5) AS qa FROM j)"""))
def jon_06(spark, sf):
    fast, slow = streams(spark, sf)
    d = aj.interpolate_angle(fast, slow.withColumn("heading", F.col("k") * 3.5), ["session"], "t", "event_id", "heading")
    return d.select("session", "event_id", r("heading", 4).alias("heading"))


QLERP = {c: f"coalesce({LERP.format(p='p' + c, q='q' + c)}, p{c}, q{c})" for c in ("e", "n", "v")}


@query("JON-06b", T(NEAR + f"""SELECT session, event_id, round(qe_/norm, 6) AS e, round(qn_/norm, 6) AS n, round(qv_/norm, 6) AS speed FROM (
SELECT *, sqrt(qe_*qe_ + qn_*qn_ + qv_*qv_) AS norm FROM (SELECT session, event_id, {QLERP['e']} AS qe_, {QLERP['n']} AS qn_, {QLERP['v']} AS qv_ FROM j))"""))
def jon_06b(spark, sf):
    fast, slow = streams(spark, sf)
    d = aj.interpolate_quaternion(fast.drop("e", "n", "speed"), slow, ["session"], "t", "event_id", ["e", "n", "speed"])
    return d.select("session", "event_id", r("e").alias("e"), r("n").alias("n"), r("speed").alias("speed"))


LAPS_SQL = """, laps AS (SELECT session, lap, min(t) AS t_start, max(t) AS t_end, min(i) AS i0, count(*) AS n_pts FROM trace GROUP BY session, lap) """


def laps(spark, sf):
    return trace(spark, sf).df.groupBy("session", "lap").agg(
        F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.min("i").alias("i0"), F.count(F.lit(1)).alias("n_pts"))


@query("JON-07", T(LAPS_SQL + """SELECT tr.session, tr.event_id, max(l.lap) AS lap FROM (SELECT session, event_id, t + 1000 AS t FROM trace) tr
LEFT JOIN laps l ON l.session = tr.session AND tr.t BETWEEN l.t_start AND l.t_end GROUP BY ALL"""))
def jon_07(spark, sf):
    samples = trace(spark, sf).df.select("session", "event_id", (F.col("t") + 1000).alias("t"))
    spans = laps(spark, sf).withColumn("event_id", F.col("lap"))
    return aj.in_interval(samples, spans, ["session"], "t", "event_id", "t_start", "t_end", ["lap"]).select(
        "session", "event_id", "lap")


LINE_SQL = ", line AS (SELECT i % 16 AS lid, avg(e) AS e, avg(n) AS n FROM trace GROUP BY ALL) "


@query("JON-08", T(LINE_SQL + """SELECT event_id, lid, round(d, 6) AS distance FROM (SELECT tr.event_id, l.lid, sqrt(pow(l.e - tr.e, 2) + pow(l.n - tr.n, 2)) AS d,
row_number() OVER (PARTITION BY tr.event_id ORDER BY pow(l.e - tr.e, 2) + pow(l.n - tr.n, 2), l.lid) AS rn FROM trace tr, line l) WHERE rn = 1"""))
def jon_08(spark, sf):
    d = trace(spark, sf).df
    line = d.groupBy((F.col("i") % 16).alias("lid")).agg(F.avg("e").alias("e"), F.avg("n").alias("n"))
    return aj.nearest_points(d, line, "event_id", "lid", "e", "n", 10.0).select(
        "event_id", "lid", r("distance").alias("distance"))


_NEAR = "least(len(s.dl), {h} + 5)"
_WIN = "s.dl[greatest(0, {h} - 2) + 1:" + _NEAR + "]"


def _walk_sql(h: str) -> str:
    part = _WIN.format(h=h)
    return f"greatest(0, {h} - 2) + list_position({part}, list_min({part})) - 1"


@query("JON-09", recursive("""SELECT b.session, b.lap, b.event_id, b.i % 16 AS j, list(pow(p.e-b.e,2)+pow(p.n-b.n,2) ORDER BY p.i) AS dl
FROM trace b JOIN trace p ON p.session = b.session AND p.lap = 0 WHERE b.lap > 0 GROUP BY ALL""",
       f"SELECT session, lap, event_id, j, {_walk_sql('0')} AS hint, s.dl AS dl FROM src s WHERE j = 0",
       f"SELECT s.session, s.lap, s.event_id, s.j, {_walk_sql('f.hint')}, s.dl FROM f JOIN src s ON s.session = f.session AND s.lap = f.lap AND s.j = f.j + 1",
       "SELECT session, event_id, CAST(hint AS BIGINT) AS ref_i, round(sqrt(dl[hint + 1]), 6) AS dist FROM f"))
def jon_09(spark, sf):
    """Reference-lap point of every row, searched only near the last match (2 back, 4 ahead)."""
    d = trace(spark, sf).df
    ref = d.where("lap = 0").select("session", F.col("i").alias("ref_i"), "e", "n")
    m = aj.forward_nearest(d.where("lap > 0"), ref, ["session"], "lap", "event_id", "i", "ref_i", "e", "n", 2, 5)
    return m.select("session", "event_id", "ref_i", r("distance").alias("dist"))


@query("JON-10", T(""", m AS (SELECT * FROM (VALUES ('t1', 100.0, 0.0), ('t2', 100.0, 100.0), ('t3', 0.0, 100.0)) v(landmark, mx, my))
SELECT session, landmark, arg_min(event_id, (pow(e-mx,2)+pow(n-my,2), i)) AS event_id, round(sqrt(min(pow(e-mx,2)+pow(n-my,2))), 6) AS distance
FROM trace, m GROUP BY session, landmark"""))
def jon_10(spark, sf):
    marks = {"t1": (100, 0), "t2": (100, 100), "t3": (0, 100)}
    return aj.landmark_snap(trace(spark, sf).df, ["session"], marks, "e", "n", "i", ["event_id"]).withColumn(
        "distance", r("distance"))


@query("JON-11", T(LAPS_SQL + """, s AS (SELECT session, t AS st, event_id AS sid FROM trace WHERE kind = 'error'),
j AS (SELECT l.session, l.lap, l.t_start AS t, p.st AS pt, p.sid AS pid, q.st AS qt, q.sid AS qid FROM laps l ASOF LEFT JOIN s p ON l.session = p.session AND l.t_start >= p.st
ASOF LEFT JOIN s q ON l.session = q.session AND l.t_start < q.st)
SELECT session, lap, CASE WHEN pt IS NOT NULL AND (qt IS NULL OR t - pt <= qt - t) THEN pid ELSE qid END AS r_event_id FROM j"""))
def jon_11(spark, sf):
    starts = laps(spark, sf).withColumn("tie", F.col("lap"))
    _, slow = streams(spark, sf)
    d = aj.asof(starts, slow.withColumn("tie", F.col("event_id")), ["session"], "t_start", "tie", ["event_id"], "nearest", right_t="t")
    return d.select("session", "lap", "r_event_id")


STAR_SQL = """SELECT l_orderkey, l_linenumber, o_orderpriority, c_name, s_name, n.n_name AS circuit, r_name AS region, p_brand, o2.n_orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation n ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN (SELECT o_custkey AS ck, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o2 ON o2.ck = o_custkey"""


@query("JON-12", STAR_SQL)
def jon_12(spark, sf):
    """Results with races, drivers, teams and circuits (inner) and car and standings (left)."""
    t = lambda n: table(spark, sf, n)
    races, drivers = t("orders"), t("customer")
    standings = races.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("circuit"), F.col("r_name").alias("region"))
    d = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    d = d.join(races.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = d.join(drivers.select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    d = d.join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    d = d.join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    d = d.join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
    d = d.join(standings, "o_custkey", "left")
    return d.select("l_orderkey", "l_linenumber", "o_orderpriority", "c_name", "s_name", "circuit", "region", "p_brand", "n_orders")


@query("JON-13", T(LAPS_SQL + """, best AS (SELECT session, arg_min(lap, (t_end - t_start, lap)) AS bl FROM laps WHERE n_pts = 16 GROUP BY session),
bp AS (SELECT tr.session, tr.i % 16 AS p, tr.t - l.t_start AS bt FROM trace tr JOIN best b ON tr.session = b.session AND tr.lap = b.bl JOIN laps l ON l.session = tr.session AND l.lap = tr.lap)
SELECT tr.session, tr.event_id, round(tr.t - l.t_start - bp.bt, 6) AS delta FROM trace tr JOIN laps l ON l.session = tr.session AND l.lap = tr.lap
LEFT JOIN bp ON bp.session = tr.session AND bp.p = tr.i % 16"""))
def jon_13(spark, sf):
    o = trace(spark, sf).rekey(["session", "lap"]).totals(t_start=F.min("t"), t_end=F.max("t"), n_pts=F.count(F.lit(1)))
    d = o.df.withColumns({"p": F.col("i") % 16, "el": F.col("t") - F.col("t_start")})
    full = d.where("n_pts = 16")
    best = full.groupBy("session").agg(F.min(F.struct((F.col("t_end") - F.col("t_start")).alias("x"), "lap"))["lap"].alias("bl"))
    ref = clean.salted_lookup(full, best, ["session"], F.col(G), "inner").where("lap = bl").select("session", "p", F.col("el").alias("bt"))
    return clean.salted_lookup(d, ref, ["session", "p"], F.col(G)).select(
        "session", "event_id", r(F.col("el") - F.col("bt")).alias("delta"))


ZONES = [("hairpin", 100.0, 100.0, 10.0), ("esses", 0.0, 50.0, 5.0)]


@query("JON-15", T("""SELECT session, event_id, CASE WHEN d1 <= d2 THEN CASE WHEN d1 <= 35 THEN 'hairpin' END ELSE CASE WHEN d2 <= 30 THEN 'esses' END END AS zone
FROM (SELECT *, sqrt(pow(e-100,2)+pow(n-100,2)) d1, sqrt(pow(e,2)+pow(n-50,2)) d2 FROM trace)"""))
def jon_15(spark, sf):
    return trace(spark, sf).df.select("session", "event_id", aj.zone_label(F.col("e"), F.col("n"), ZONES).alias("zone"))


@query("JON-16", """WITH a AS (SELECT l_suppkey k, l_partkey t FROM lineitem WHERE l_linenumber <= 2), b AS (SELECT l_suppkey k, l_partkey t FROM lineitem WHERE l_linenumber >= 2),
ab AS (SELECT * FROM a EXCEPT SELECT * FROM b), ba AS (SELECT * FROM b EXCEPT SELECT * FROM a)
SELECT 'a_not_b' AS side, count(*) AS n, min(t) AS first_mismatch FROM ab UNION ALL SELECT 'b_not_a', count(*), min(t) FROM ba""")
def jon_16(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("t"), "l_linenumber")
    a, b = li.where("l_linenumber <= 2").drop("l_linenumber"), li.where("l_linenumber >= 2").drop("l_linenumber")

    def one(x, y, side):
        return x.subtract(y).agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"), F.min("t").alias("first_mismatch"))

    return one(a, b, "a_not_b").unionByName(one(b, a, "b_not_a"))


OUTLINE = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
_SEG = "sqrt(pow({a} - greatest(0, least(100, {a})), 2) + pow({b} - {c}, 2))"
OUT_SQL = "least(" + ", ".join([_SEG.format(a="e", b="n", c=0), _SEG.format(a="n", b="e", c=100), _SEG.format(a="e", b="n", c=100), _SEG.format(a="n", b="e", c=0)]) + ")"


@query("JON-17", T(f""", s AS (SELECT session, event_id, i, {OUT_SQL} AS d, CASE WHEN {OUT_SQL} <= 1.2 AND speed > 4 THEN 1.0 ELSE 0.0 END AS raw FROM trace),
m AS (SELECT *, avg(raw) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM s)
SELECT session, event_id, round(d, 6) AS distance, sm > 0.4 AS on_track FROM m"""))
def jon_17(spark, sf):
    o = trace(spark, sf).cols(d=aj.outline_distance(F.col("e"), F.col("n"), OUTLINE))
    o = o.cols(raw=((F.col("d") <= 1.2) & (F.col("speed") > 4)).cast("double"))
    o = smooth.rolling(o, 5, sm=F.avg("raw"))
    return o.out("session", "event_id", r("d").alias("distance"), (F.col("sm") > 0.4).alias("on_track"))


@query("JON-18", T(""", f AS (SELECT * FROM trace), s AS (SELECT session, t AS st, e AS se FROM trace WHERE kind = 'error'),
j AS (SELECT f.session, f.event_id, f.i, f.t, p.st pt, p.se pe, q.st qt, q.se qe FROM f ASOF JOIN s p ON f.session = p.session AND f.t >= p.st
ASOF LEFT JOIN s q ON f.session = q.session AND f.t < q.st),
x AS (SELECT *, qt IS NULL AND pt < t AS past FROM j), y AS (SELECT *, sum(CASE WHEN past THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY i) AS m FROM x)
SELECT session, event_id, round(CASE WHEN pt = t OR qt IS NULL THEN pe ELSE pe + (qe-pe)*((t-pt)/(qt-pt)) END, 6) AS fix_e,
round(CASE WHEN past THEN greatest(0.1, 1.0 - 0.05*m) WHEN pt = t THEN 1.0 ELSE 1.0 - least((t-pt)/(qt-pt), 1.0-(t-pt)/(qt-pt)) END, 6) AS confidence,
CASE WHEN past THEN 'Extrapolated' ELSE 'Interpolated' END AS source FROM y"""))
def jon_18(spark, sf):
    d = trace(spark, sf).df
    out = aj.fix_provenance(d, d.where(SLOW), ["session"], "t", "event_id", ["e"])
    return out.select("session", "event_id", r("fix_e").alias("fix_e"), r("confidence").alias("confidence"), "source")


# ---------------------------------------------------------------- windows
W = " OVER (PARTITION BY session ORDER BY i)"


def FR(b, a):
    return f" OVER (PARTITION BY session ORDER BY i ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING)"


@query("WIN-01", T(f"SELECT session, event_id, round(speed - lag(speed){W}, 6) AS diff, round((speed - lag(speed){W})/(t - lag(t){W}), 9) AS rate FROM trace"))
def win_01(spark, sf):
    o = trace(spark, sf).lag(ps="speed", pt="t")
    dv = F.col("speed") - F.col("ps")
    return o.out("session", "event_id", r(dv).alias("diff"), r(dv / (F.col("t") - F.col("pt")), 9).alias("rate"))


GRAD = (f"CASE WHEN lag(t){W} IS NOT NULL AND lead(t){W} IS NOT NULL THEN (pow(t-lag(t){W},2)*lead(speed){W} + (pow(lead(t){W}-t,2)-pow(t-lag(t){W},2))*speed - pow(lead(t){W}-t,2)*lag(speed){W})"
        f"/((t-lag(t){W})*(lead(t){W}-t)*(lead(t){W}-lag(t){W})) WHEN lead(t){W} IS NOT NULL THEN (lead(speed){W}-speed)/(lead(t){W}-t) ELSE (speed-lag(speed){W})/(t-lag(t){W}) END")


@query("WIN-02", T(f"SELECT session, event_id, round({GRAD}, 8) AS accel FROM trace"))
def win_02(spark, sf):
    o = trace(spark, sf).over({"a": smooth.gradient("speed", "t")}, before=1, after=1)
    return o.out("session", "event_id", r("a", 8).alias("accel"))


@query("WIN-03", T(f"""SELECT session, event_id, round(avg(speed){FR(3,3)}, 6) AS mean7, round(avg(speed){FR(2,1)}, 6) AS mean4,
round(CASE WHEN count(*){FR(3,3)} = 7 THEN avg(speed){FR(3,3)} END, 6) AS full7 FROM trace"""))
def win_03(spark, sf):
    o = smooth.rolling(trace(spark, sf), 7, m7=F.avg("speed"))
    o = smooth.rolling(o, 4, m4=F.avg("speed"))
    o = smooth.rolling(o, 7, full=True, f7=F.avg("speed"))
    return o.out("session", "event_id", r("m7").alias("mean7"), r("m4").alias("mean4"), r("f7").alias("full7"))


@query("WIN-04", T(f"SELECT session, event_id, round(median(e){FR(2,2)}, 6) AS e, round(median(n){FR(2,2)}, 6) AS n FROM trace"))
def win_04(spark, sf):
    o = smooth.rolling(trace(spark, sf), 5, me=F.percentile("e", F.lit(0.5)), mn=F.percentile("n", F.lit(0.5)))
    return o.out("session", "event_id", r("me").alias("e"), r("mn").alias("n"))


@query("WIN-05", T(f"SELECT session, event_id, round(stddev_pop(speed){FR(4,4)}, 5) AS activity FROM trace"))
def win_05(spark, sf):
    o = smooth.rolling(trace(spark, sf), 9, s=F.stddev_pop("speed"))
    return o.out("session", "event_id", r("s", 5).alias("activity"))


@query("WIN-06", T(""", full_ AS (SELECT session, lap FROM trace GROUP BY ALL HAVING count(*) = 16), c AS (SELECT session, lap, i % 16 AS p, speed FROM trace JOIN full_ USING (session, lap))
SELECT a.session, a.lap, a.p, round(avg(b.speed), 6) AS speed FROM c a JOIN c b ON a.session = b.session AND a.lap = b.lap
AND (b.p - a.p + 16 + 2) % 16 <= 4 GROUP BY ALL"""))
def win_06(spark, sf):
    o = trace(spark, sf).rekey(["session", "lap"]).totals(size=F.count(F.lit(1))).where("size = 16")
    lines = o.df.select("session", "lap", (F.col("i") % 16).alias("p"), "speed", "size")
    return smooth.circular_mean(lines, ["session", "lap"], "p", "size", "speed", 5, "sm").select(
        "session", "lap", "p", r("sm").alias("speed"))


@query("WIN-07", recursive("SELECT session, event_id, i, speed FROM trace", "SELECT session, event_id, i, speed AS y FROM src WHERE i = 0",
       "SELECT s.session, s.event_id, s.i, 0.3*s.speed + 0.7*f.y FROM f JOIN src s ON s.session = f.session AND s.i = f.i + 1",
       "SELECT session, event_id, round(y, 6) AS ema FROM f"))
def win_07(spark, sf):
    return smooth.ema(trace(spark, sf), "speed", 0.3, "y").out("session", "event_id", r("y").alias("ema"))


@query("WIN-08", T(f"""SELECT session, event_id, round(CASE WHEN lag(i, 3){W} IS NOT NULL AND lead(i, 3){W} IS NOT NULL THEN
(-2*lag(speed,3){W} + 3*lag(speed,2){W} + 6*lag(speed,1){W} + 7*speed + 6*lead(speed,1){W} + 3*lead(speed,2){W} - 2*lead(speed,3){W})/21 ELSE speed END, 6) AS speed FROM trace"""))
def win_08(spark, sf):
    o = smooth.fir(trace(spark, sf), "speed", smooth.polynomial_weights(7, 2), "sg", edge="raw")
    return o.out("session", "event_id", r("sg").alias("speed"))


def _fir_sql(col, weights):
    h = len(weights) // 2
    def at(j):
        return col if j == 0 else (f"lag({col},{-j}){W}" if j < 0 else f"lead({col},{j}){W}")
    num = " + ".join(f"coalesce({at(j)}*{w!r}, 0)" for j, w in zip(range(-h, h + 1), weights))
    den = " + ".join(f"CASE WHEN {at(j)} IS NOT NULL THEN {w!r} ELSE 0 END" for j, w in zip(range(-h, h + 1), weights))
    return f"(({num}) / nullif(({den})::DOUBLE, 0))"


@query("WIN-09", T(f", s AS (SELECT *, CASE WHEN k % 7 <> 0 THEN speed END AS v FROM trace) SELECT session, event_id, round({_fir_sql('v', smooth.gaussian_weights(1.0))}, 6) AS speed FROM s"))
def win_09(spark, sf):
    o = trace(spark, sf).cols(v=F.when(F.col("k") % 7 != 0, F.col("speed")))
    return smooth.fir(o, "v", smooth.gaussian_weights(1.0), "g").out("session", "event_id", r("g").alias("speed"))


@query("WIN-10", T(f"""SELECT session, event_id, round(CASE WHEN count(*){FR(3,3)} >= 2 THEN coalesce(regr_slope(e, t){FR(3,3)}, 0)*(t - avg(t){FR(3,3)}) + avg(e){FR(3,3)} ELSE avg(e){FR(3,3)} END, 4) AS e FROM trace"""))
def win_10(spark, sf):
    return smooth.local_line(trace(spark, sf), "e", "t", 7, "fit").out("session", "event_id", r("fit", 4).alias("e"))


@query("WIN-11", T(f"SELECT session, event_id, round({_fir_sql('speed', smooth.hann_weights(9))}, 6) AS low FROM trace"))
def win_11(spark, sf):
    return smooth.fir(trace(spark, sf), "speed", smooth.hann_weights(9), "low").out("session", "event_id", r("low").alias("low"))


@query("WIN-12", T(f""", q AS (SELECT session, event_id, avg(e){FR(2,2)} qw, avg(n){FR(2,2)} qx, avg(speed){FR(2,2)} qy, avg(k){FR(2,2)} qz FROM trace)
SELECT session, event_id, round(qw/m, 6) AS qw, round(qx/m, 6) AS qx, round(qy/m, 6) AS qy, round(qz/m, 6) AS qz FROM (SELECT *, sqrt(qw*qw+qx*qx+qy*qy+qz*qz) m FROM q)"""))
def win_12(spark, sf):
    o = smooth.rolling(trace(spark, sf), 5, qw=F.avg("e"), qx=F.avg("n"), qy=F.avg("speed"), qz=F.avg("k"))
    m = F.sqrt(sum(F.col(c) * F.col(c) for c in ("qw", "qx", "qy", "qz")))
    return o.out("session", "event_id", *[r(F.col(c) / m).alias(c) for c in ("qw", "qx", "qy", "qz")])


UNWRAP = f""", a AS (SELECT *, k*7.5 AS ang, k*7.5 - lag(k*7.5){W} AS d FROM trace),
u AS (SELECT *, sum(coalesce((d + 180) - 360*floor((d + 180)/360) - 180, ang)){W} AS un FROM a) """


@query("WIN-13", T(UNWRAP + "SELECT session, event_id, round(un, 6) AS angle FROM u"))
def win_13(spark, sf):
    o = smooth.unwrap(trace(spark, sf).cols(ang=F.col("k") * 7.5), "ang", "un")
    return o.out("session", "event_id", r("un").alias("angle"))


DIST_SQL = """, st AS (SELECT *, coalesce(sqrt(pow(e - lag(e) OVER w, 2) + pow(n - lag(n) OVER w, 2)), 0) AS d FROM trace WINDOW w AS (PARTITION BY session, lap ORDER BY i)),
dist AS (SELECT *, sum(d) OVER (PARTITION BY session, lap ORDER BY i) AS run, sum(d) OVER (PARTITION BY session, lap) AS tot FROM st) """


@query("WIN-14", T(DIST_SQL + "SELECT session, event_id, round(run, 5) AS dist, round(run/nullif(tot,0), 6) AS frac FROM dist"))
def win_14(spark, sf):
    o = smooth.distance_along(trace(spark, sf).rekey(["session", "lap"]), "e", "n")
    return o.out("session", "event_id", r("dist", 5).alias("dist"), r("frac").alias("frac"))


@query("WIN-15", T(f", s AS (SELECT *, speed*coalesce(t - lag(t){W}, 0) AS a FROM trace) SELECT session, event_id, round(sum(a){W}, 3) AS angle FROM s"))
def win_15(spark, sf):
    return smooth.integral(trace(spark, sf), "speed", "t", "s").out("session", "event_id", r("s", 3).alias("angle"))


@query("WIN-16", T(f""", s AS (SELECT *, CASE WHEN k % 5 = 0 THEN k END AS gear FROM trace)
SELECT session, event_id, last_value(gear IGNORE NULLS) OVER (PARTITION BY session ORDER BY i) AS held,
coalesce(last_value(gear IGNORE NULLS) OVER (PARTITION BY session ORDER BY i), first_value(gear IGNORE NULLS) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM s"""))
def win_16(spark, sf):
    o = trace(spark, sf).cols(gear=F.when(F.col("k") % 5 == 0, F.col("k")))
    o = o.cols(held=F.col("gear"), filled=F.col("gear"))
    o = smooth.fill(o, ["held"])
    return smooth.fill(o, ["filled"], both=True).out("session", "event_id", "held", "filled")


@query("WIN-17", T(""", s AS (SELECT *, CASE WHEN speed >= 20 THEN k*3.6::DOUBLE END AS h FROM trace)
SELECT session, event_id, round(coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY session ORDER BY i), arg_min(h, CASE WHEN h IS NOT NULL THEN i END) OVER (PARTITION BY session)), 6) AS heading FROM s"""))
def win_17(spark, sf):
    o = trace(spark, sf).cols(heading=F.when(F.col("speed") >= 20, F.col("k") * 3.6))
    return smooth.fill(o, ["heading"], both=True).out("session", "event_id", r("heading").alias("heading"))


@query("WIN-18", T(""", s AS (SELECT *, sum(speed) OVER (PARTITION BY session ORDER BY i) AS dist FROM trace)
SELECT session, event_id, round(CASE WHEN speed > 0 THEN (max(dist) OVER (PARTITION BY i) - dist)/speed ELSE 0 END, 8) AS gap FROM s"""))
def win_18(spark, sf):
    d = trace(spark, sf).running(dist=("sum", "speed")).df
    lead = d.groupBy("i").agg(F.max("dist").alias("top"))
    d = clean.salted_lookup(d, lead, ["i"], F.col(G))
    gap = F.when(F.col("speed") > 0, (F.col("top") - F.col("dist")) / F.col("speed")).otherwise(0.0)
    return d.select("session", "event_id", r(gap, 8).alias("gap"))


@query("WIN-19", T(LAPS_SQL + """, b AS (SELECT session, min(t_end - t_start) AS best FROM laps WHERE n_pts = 16 GROUP BY session)
SELECT tr.session, tr.event_id, round(tr.t - l.t_start, 6) AS lap_elapsed, round(tr.t, 6) AS race_elapsed,
format('{:+.2f}', round(l.t_end - l.t_start - best, 2)) AS delta FROM trace tr JOIN laps l ON l.session = tr.session AND l.lap = tr.lap LEFT JOIN b ON b.session = tr.session"""))
def win_19(spark, sf):
    o = trace(spark, sf).rekey(["session", "lap"]).totals(t_start=F.min("t"), t_end=F.max("t"), n=F.count(F.lit(1)))
    best = laps(spark, sf).where("n_pts = 16").groupBy("session").agg(F.min(F.col("t_end") - F.col("t_start")).alias("best"))
    o = o.rekey(["session"]).attach(best)
    delta = F.format_string("%+.2f", F.round(F.col("t_end") - F.col("t_start") - F.col("best"), 2))
    return o.out("session", "event_id", r(F.col("t") - F.col("t_start")).alias("lap_elapsed"), r("t").alias("race_elapsed"),
                 F.when(F.col("best").isNotNull(), delta).alias("delta"))


@query("WIN-20", T(LAPS_SQL + """, r AS (SELECT session, lap, row_number() OVER (PARTITION BY lap ORDER BY t_end, session) AS pos FROM laps)
SELECT session, lap, pos, lag(pos) OVER (PARTITION BY session ORDER BY lap) - pos AS gained FROM r"""))
def win_20(spark, sf):
    o = ordered(laps(spark, sf), ["lap"], ["t_end", "session"]).position("_i")
    d = o.df.select("session", "lap", (F.col("_i") + 1).alias("pos"))
    return ordered(d, ["session"], ["lap"]).lag(was="pos").out(
        "session", "lap", "pos", (F.col("was") - F.col("pos")).alias("gained"))


@query("WIN-21", T(f""", s AS (SELECT session, k // 10 AS gear, lag(k // 10){W} AS pg, (k % 3 = 0) AS brake, lag(k % 3 = 0){W} AS pb, speed - lag(speed){W} AS drop_ FROM trace)
SELECT session, CAST(sum(CASE WHEN pg IS NULL OR gear <> pg THEN 1 ELSE 0 END) AS BIGINT) AS shifts, CAST(sum(CASE WHEN brake AND NOT pb THEN 1 ELSE 0 END) AS BIGINT) AS onsets,
CAST(sum(CASE WHEN drop_ < -100 THEN 1 ELSE 0 END) AS BIGINT) AS drops FROM s GROUP BY session"""))
def win_21(spark, sf):
    o = trace(spark, sf).cols(gear=F.expr("k div 10"), brake=F.col("k") % 3 == 0).lag(pg="gear", pb="brake", ps="speed")
    count = lambda c: F.count(F.when(c, 1))
    return o.df.groupBy("session").agg(
        count(F.col("pg").isNull() | (F.col("gear") != F.col("pg"))).alias("shifts"),
        count(F.col("brake") & ~F.col("pb")).alias("onsets"), count(F.col("speed") - F.col("ps") < -100).alias("drops"))


@query("WIN-22", T(f""", g AS (SELECT session, event_id, {GRAD} AS a FROM trace), s AS (SELECT *, stddev_pop(a) OVER (PARTITION BY session) AS sd FROM g)
SELECT session, event_id, CASE WHEN a > sd THEN 'on' ELSE 'off' END AS throttle FROM s WHERE abs(a) > sd"""))
def win_22(spark, sf):
    o = trace(spark, sf).over({"a": smooth.gradient("speed", "t")}, before=1, after=1).totals(sd=F.stddev_pop("a"))
    o = o.where(F.abs("a") > F.col("sd"))
    return o.out("session", "event_id", F.when(F.col("a") > F.col("sd"), "on").otherwise("off").alias("throttle"))


@query("WIN-23", T(f""", g AS (SELECT session, event_id, speed*(k-50)/1000.0/9.80665 AS lat_g, greatest(-3.0, least(3.0, {GRAD}*1000/9.80665)) AS long_g, (k-50)/1000.0/greatest(speed, 1.0) AS curv FROM trace),
c AS (SELECT session, quantile_cont(abs(curv), 0.95) AS cap FROM g GROUP BY session)
SELECT session, event_id, round(greatest(-3.0, least(3.0, lat_g)), 6) AS lat_g, round(long_g, 5) AS long_g, round(greatest(-1.0, least(1.0, curv/cap)), 6) AS steer FROM g JOIN c USING (session)"""))
def win_23(spark, sf):
    o = trace(spark, sf).over({"a": smooth.gradient("speed", "t")}, before=1, after=1)
    yaw = (F.col("k") - 50) / 1000.0
    o = o.cols(lat_g=F.col("speed") * yaw / G0, long_g=F.col("a") * 1000 / G0, curv=yaw / F.greatest("speed", F.lit(1.0)))
    o = o.attach(quantiles(o.df.withColumn("ac", F.abs("curv")), ["session"], ["ac"], {"cap": 0.95}))
    clip = lambda c, b: F.greatest(F.lit(-b), F.least(F.lit(b), c))
    return o.out("session", "event_id", r(clip(F.col("lat_g"), 3.0)).alias("lat_g"), r(clip(F.col("long_g"), 3.0), 5).alias("long_g"),
                 r(clip(F.col("curv") / F.col("ac_cap"), 1.0)).alias("steer"))


@query("WIN-24", T(f""", s AS (SELECT session, event_id, e-lag(e){W} ax, n-lag(n){W} ay, lead(e){W}-e bx, lead(n){W}-n AS by_ FROM trace),
c AS (SELECT session, event_id, atan2(ax*by_-ay*bx, ax*bx+ay*by_)/((sqrt(ax*ax+ay*ay)+sqrt(bx*bx+by_*by_))/2) AS k FROM s)
SELECT session, event_id, round(k, 6) AS curvature, round(CASE WHEN abs(k) > 1e-3 THEN sqrt(15.0/abs(k)) END, 4) AS vmax FROM c WHERE k IS NOT NULL"""))
def win_24(spark, sf):
    o = trace(spark, sf).over({"kap": smooth.curvature("e", "n")}, before=1, after=1).where("kap is not null")
    vmax = F.when(F.abs("kap") > 1e-3, F.sqrt(15.0 / F.abs("kap")))
    return o.out("session", "event_id", r("kap").alias("curvature"), r(vmax, 4).alias("vmax"))


@query("WIN-25", T(f", s AS (SELECT *, {_fir_sql('e', smooth.gaussian_weights(2.0))} AS be, {_fir_sql('n', smooth.gaussian_weights(2.0))} AS bn FROM trace) SELECT session, event_id, round(sqrt(pow(e-be,2)+pow(n-bn,2)), 6) AS dyn FROM s"))
def win_25(spark, sf):
    o = smooth.fir(trace(spark, sf), "e", smooth.gaussian_weights(2.0), "be")
    o = smooth.fir(o, "n", smooth.gaussian_weights(2.0), "bn")
    return o.out("session", "event_id", r(hypot(F.col("e") - F.col("be"), F.col("n") - F.col("bn"))).alias("dyn"))


@query("WIN-26", T(UNWRAP + """, s AS (SELECT *, un - k*2.0 AS off FROM u), g AS (SELECT session, regr_slope(off, t) AS sl, regr_intercept(off, t) AS ic FROM s WHERE speed > 30 GROUP BY session)
SELECT session, event_id, round(cos(radians(off - sl*t - ic)), 5) AS cos_slip FROM s JOIN g USING (session)"""))
def win_26(spark, sf):
    """Facing minus course with the linear drift of moving samples removed; slip is wrapped."""
    o = smooth.unwrap(trace(spark, sf).cols(ang=F.col("k") * 7.5), "ang", "un").cols(off=F.col("un") - F.col("k") * 2.0).cut()
    drift = o.df.where("speed > 30").groupBy("session").agg(F.regr_slope("off", "t").alias("sl"), F.regr_intercept("off", "t").alias("ic"))
    o = o.attach(drift).cols(slip=wrap180(F.col("off") - F.col("sl") * F.col("t") - F.col("ic")))
    return o.where("sl is not null").out("session", "event_id", r(F.cos(F.radians("slip")), 5).alias("cos_slip"))


@query("WIN-27", T(""", s AS (SELECT session, event_id, i, CASE WHEN k % 3 = 0 THEN k % 4 ELSE 0 END AS lab FROM trace),
c AS (SELECT a.session, a.event_id, b.lab AS v, count(*) AS m, min(b.i) AS first_i FROM s a JOIN s b ON a.session = b.session AND b.i BETWEEN a.i - 5 AND a.i + 5 AND b.lab <> 0 GROUP BY ALL),
b AS (SELECT session, event_id, v, row_number() OVER (PARTITION BY session, event_id ORDER BY m DESC, first_i) AS rn FROM c)
SELECT s.session, s.event_id, CASE WHEN s.lab <> 0 THEN s.lab ELSE coalesce(b.v, 0) END AS label FROM s LEFT JOIN b ON b.session = s.session AND b.event_id = s.event_id AND rn = 1"""))
def win_27(spark, sf):
    o = trace(spark, sf).cols(lab=F.when(F.col("k") % 3 == 0, F.col("k") % 4).otherwise(F.lit(0).cast("long")))
    return smooth.majority_label(o, "lab", 5, "label").out("session", "event_id", "label")


@query("WIN-28", T(f""", g AS (SELECT *, sqrt(e*e+n*n)/50 AS g FROM trace), c AS (SELECT session, quantile_cont(g, 0.98) AS cap FROM g GROUP BY session)
SELECT session, event_id, round(least(g, cap), 6) AS g_force, round(least(avg(g){FR(3,3)}, cap), 6) AS g_smooth FROM g JOIN c USING (session)"""))
def win_28(spark, sf):
    o = trace(spark, sf).cols(g=hypot("e", "n") / 50)
    o = smooth.rolling(o, 7, gm=F.avg("g")).attach(quantiles(o.df, ["session"], ["g"], {"cap": 0.98}))
    return o.out("session", "event_id", r(F.least("g", "g_cap")).alias("g_force"), r(F.least("gm", "g_cap")).alias("g_smooth"))


@query("WIN-29", T(""", s AS (SELECT *, CASE WHEN max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY session) = 1 THEN e ELSE n END AS alt FROM trace)
SELECT session, event_id, round(alt - min(alt) OVER (PARTITION BY session), 6) AS elevation, round(greatest(-45.0, least(45.0, degrees(atan2(k-50, speed)))), 5) AS bank FROM s"""))
def win_29(spark, sf):
    """Barometer height where the session has one, otherwise the fix height; rebased to the minimum."""
    o = trace(spark, sf).totals(baro=F.max((F.col("kind") == "purchase").cast("int")))
    o = o.cols(alt=F.when(F.col("baro") == 1, F.col("e")).otherwise(F.col("n"))).totals(low=F.min("alt"))
    bank = F.degrees(F.atan2((F.col("k") - 50).cast("double"), F.col("speed")))
    return o.out("session", "event_id", r(F.col("alt") - F.col("low")).alias("elevation"),
                 r(F.greatest(F.lit(-45.0), F.least(F.lit(45.0), bank)), 5).alias("bank"))


# ---------------------------------------------------------------- resampling
GRID = """, sp AS (SELECT session, min(t) AS lo, max(t) AS hi FROM trace GROUP BY session),
grid AS (SELECT session, tick, lo + tick * {step} AS t FROM (SELECT session, lo, unnest(generate_series(0, CAST(ceil((hi - lo)/{step}) AS BIGINT) - 1)) AS tick FROM sp)),
s AS (SELECT session, t AS st, speed AS sv, k AS sk FROM trace),
j AS (SELECT g.session, g.tick, g.t, p.st AS pt, p.sv AS pv, p.sk AS pk, q.st AS qt, q.sv AS qv FROM grid g ASOF LEFT JOIN s p ON g.session = p.session AND g.t >= p.st
ASOF LEFT JOIN s q ON g.session = q.session AND g.t < q.st) """


@query("RES-01", T(GRID.format(step="20000.0") + f"SELECT session, tick, round(t, 6) AS t, round(coalesce({LERP.format(p='pv', q='qv')}, pv, qv), 6) AS speed FROM j"))
def res_01(spark, sf):
    d = resample.uniform(trace(spark, sf).df, ["session"], "t", "event_id", ["speed"], 1 / 20000.0)
    return d.select("session", "tick", r("t").alias("t"), r("speed").alias("speed"))


@query("RES-02", T(GRID.format(step="25000.0") + f"SELECT session, tick, round(coalesce({LERP.format(p='pv', q='qv')}, pv, qv), 6) AS speed, pk AS k FROM j"))
def res_02(spark, sf):
    d = resample.mixed(trace(spark, sf).df, ["session"], "t", "event_id", ["speed"], ["k"], 1 / 25000.0)
    return d.select("session", "tick", r("speed").alias("speed"), "k")


@query("RES-03", T(GRID.format(step="50000.0") + f"SELECT session, tick, round(coalesce({LERP.format(p='pv', q='qv')}, pv, qv), 6) AS speed FROM j"))
def res_03(spark, sf):
    d = resample.uniform(trace(spark, sf).df, ["session"], "t", "event_id", ["speed"], 1 / 50000.0)
    return d.select("session", "tick", r("speed").alias("speed"))


FGRID = DIST_SQL + """, fr AS (SELECT session, lap, t, speed, e, n, event_id, i, run/nullif(tot, 0) AS f FROM dist), ok AS (SELECT session, lap FROM fr GROUP BY ALL HAVING count(*) = 16),
g AS (SELECT session, lap, grid, grid/{m}.0 AS gf FROM ok, generate_series(0, {m}) x(grid)),
s AS (SELECT session, lap, f, t, speed, e, n FROM fr),
j AS (SELECT g.session, g.lap, g.grid, g.gf AS t, p.f AS pt, p.t AS pc, p.speed AS pv, p.e AS pe, p.n AS pn, q.f AS qt, q.t AS qc, q.speed AS qv, q.e AS qe, q.n AS qn FROM g
ASOF LEFT JOIN s p ON g.session = p.session AND g.lap = p.lap AND g.gf >= p.f ASOF LEFT JOIN s q ON g.session = q.session AND g.lap = q.lap AND g.gf < q.f) """


def lap_fractions(spark, sf, **totals: Column) -> Ordered:
    """Complete laps with distance and fraction, and with ``totals`` of a lap."""
    o = trace(spark, sf).rekey(["session", "lap"]).totals(size=F.count(F.lit(1)), **totals).where("size = 16")
    return smooth.distance_along(o, "e", "n")


@query("RES-04", T(FGRID.format(m=19) + f"SELECT session, lap, grid, round(coalesce({LERP.format(p='pc', q='qc')}, pc, qc), 2) AS t, round(coalesce({LERP.format(p='pv', q='qv')}, pv, qv), 6) AS speed FROM j"))
def res_04(spark, sf):
    d = resample.fraction_grid(lap_fractions(spark, sf).df, ["session", "lap"], "frac", "event_id", ["t", "speed"], 20)
    return d.select("session", "lap", "grid", r("t", 2).alias("t"), r("speed").alias("speed"))


@query("RES-05", T(FGRID.format(m=9) + f"SELECT session, lap, grid, round(coalesce({LERP.format(p='pe', q='qe')}, pe, qe), 6) AS e, round(coalesce({LERP.format(p='pn', q='qn')}, pn, qn), 6) AS n FROM j"))
def res_05(spark, sf):
    d = resample.fraction_grid(lap_fractions(spark, sf).df, ["session", "lap"], "frac", "event_id", ["e", "n"], 10)
    return d.select("session", "lap", "grid", r("e").alias("e"), r("n").alias("n"))


@query("RES-06", T(f""", s AS (SELECT session, event_id, e, n, lead(e){W} AS ne, lead(n){W} AS nn FROM trace),
p AS (SELECT *, coalesce(greatest(1, CAST(ceil(sqrt(pow(ne-e,2)+pow(nn-n,2))/5.0) AS INTEGER)), 1) AS parts FROM s),
x AS (SELECT *, unnest(generate_series(0, parts - 1)) AS j FROM p)
SELECT session, event_id, CAST(j AS INTEGER) AS part, round(CASE WHEN j = 0 THEN e ELSE e + (ne-e)*j/parts END, 6) AS x, round(CASE WHEN j = 0 THEN n ELSE n + (nn-n)*j/parts END, 6) AS y, j = 0 AS original FROM x"""))
def res_06(spark, sf):
    return resample.densify(trace(spark, sf), "e", "n", 5.0).select(
        "session", "event_id", "part", r("dense_x").alias("x"), r("dense_y").alias("y"), "original")


@query("RES-07", T(f""", s AS (SELECT session, event_id, t, lat, lead(t){W} AS nt, lead(lat){W} AS nl FROM trace), x AS (SELECT *, unnest(generate_series(0, CASE WHEN nt IS NULL THEN 0 ELSE 3 END)) AS j FROM s)
SELECT session, event_id, CAST(j AS INTEGER) AS part, round(CASE WHEN j = 0 THEN t ELSE t + (nt-t)*(j/4.0) END, 2) AS t, round(CASE WHEN j = 0 THEN lat ELSE lat + (nl-lat)*(j/4.0) END, 8) AS lat, j > 0 AS interpolated FROM x"""))
def res_07(spark, sf):
    return resample.upsample(trace(spark, sf), "t", ["lat"], 3).select(
        "session", "event_id", "part", r("t", 2).alias("t"), r("lat", 8).alias("lat"), "interpolated")


@query("JON-14", T("""SELECT a.event_id, arg_min(b.event_id, (b.t, b.event_id)) AS return_id, round(min(b.t) - any_value(a.t), 6) AS after FROM trace a JOIN trace b
ON a.session = b.session AND b.t - a.t > 100000 AND sqrt(pow(a.e-b.e,2)+pow(a.n-b.n,2)) < 2.2 GROUP BY a.event_id"""))
def jon_14(spark, sf):
    d = trace(spark, sf).df
    got = aj.first_return(d, ["session"], "event_id", "e", "n", "t", 2.2, 100000.0, 300000.0)
    return got.join(by_key(d.select("event_id", "t")), "event_id").select("event_id", "return_id", r(F.col("return_t") - F.col("t")).alias("after"))
