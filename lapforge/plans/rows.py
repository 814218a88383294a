"""Filters, projections, sorts, set operations and scalar functions over the given tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lapforge.functions import geo, text
from lapforge.operators import clean
from lapforge.operators.ordered import G, quantiles
from lapforge.plans.registry import query
from lapforge.plans.views import RING, T, events, r, recursive, table, trace


@query("FLT-01", T(""", win AS (SELECT session, floor(max(t)*0.25) lo, floor(max(t)*0.75) hi FROM trace GROUP BY session)
SELECT tr.session, tr.event_id, round(tr.t - w.lo, 6) AS t, tr.speed FROM trace tr JOIN win w USING (session)
WHERE tr.t BETWEEN w.lo AND w.hi"""))
def flt_01(spark, sf):
    d = trace(spark, sf).df
    win = d.groupBy("session").agg(F.floor(F.max("t") * 0.25).alias("lo"), F.floor(F.max("t") * 0.75).alias("hi"))
    cut = clean.time_slice(d, win, ["session"], "t", "lo", "hi", F.col(G))
    return cut.select("session", "event_id", r("t").alias("t"), "speed")


@query("FLT-02", T("""SELECT event_id, CASE WHEN k % 10 = 0 THEN NULL ELSE speed END AS speed, lat, lon, k AS accuracy
FROM (SELECT event_id, speed, k, round(lat, 8) AS lat, round(lon, 8) AS lon, kind FROM trace)
WHERE kind <> 'error' AND k <= 80"""))
def flt_02(spark, sf):
    d = trace(spark, sf).df
    raw = d.select(
        "event_id",
        F.when(F.col("k") % 10 == 0, -1.0).otherwise(F.col("speed")).alias("speed"),
        F.when(F.col("kind") != "error", r("lat", 8)).alias("lat"),
        F.when(F.col("kind") != "error", r("lon", 8)).alias("lon"),
        F.col("k").alias("accuracy"),
    )
    return clean.drop_sentinels(raw, ["speed"], ["lat", "lon"], "accuracy", 80)


@query("FLT-03", "SELECT event_id, user_id AS session, value AS speed FROM events WHERE value <= 100")
def flt_03(spark, sf):
    return events(spark, sf).where("speed <= 100").select("event_id", "session", "speed")


HAV = ("2*6371000.0*asin(least(1.0, sqrt(pow(sin((radians({a2})-radians({a1}))/2),2)"
       "+cos(radians({a1}))*cos(radians({a2}))*pow(sin((radians({o2})-radians({o1}))/2),2))))")
HAV_PREV = HAV.format(a1="pa", o1="po", a2="lat", o2="lon")
HAV_NEXT = HAV.format(a1="na", o1="no", a2="lat", o2="lon")


@query("FLT-04", T(f""", s AS (SELECT *, lag(lat) OVER w pa, lag(lon) OVER w po, lag(t) OVER w pt FROM trace
WINDOW w AS (PARTITION BY session ORDER BY i))
SELECT session, event_id FROM s WHERE pt IS NULL OR {HAV_PREV} / greatest(t - pt, 0.01) <= 0.002"""))
def flt_04(spark, sf):
    return clean.drop_jumps(trace(spark, sf), 0.002).out("session", "event_id")


@query("FLT-05", T(""", s AS (SELECT *, sqrt(pow(e - lag(e) OVER w, 2) + pow(n - lag(n) OVER w, 2)) AS seg FROM trace
WINDOW w AS (PARTITION BY session ORDER BY i)),
top AS (SELECT session, i FROM (SELECT session, i, row_number() OVER (PARTITION BY session ORDER BY seg DESC, i) rk
  FROM s WHERE seg IS NOT NULL) WHERE rk <= 5),
k AS (SELECT session, event_id, t, e, n, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS j
  FROM s WHERE (session, i) NOT IN (SELECT session, i FROM top)),
a AS (SELECT *, t - lag(t) OVER w AS dt, sqrt(pow(e - lag(e) OVER w, 2) + pow(n - lag(n) OVER w, 2)) AS seg FROM k
WINDOW w AS (PARTITION BY session ORDER BY j)),
b AS (SELECT *, seg / nullif(dt, 0) AS v FROM a),
c AS (SELECT *, (v - lag(v) OVER w) / nullif(lag(dt) OVER w, 0) AS acc FROM b WINDOW w AS (PARTITION BY session ORDER BY j))
SELECT session, event_id FROM c WHERE j < 2 OR (dt <= 200000 AND v < 0.02 AND v > 0.0001 AND (acc IS NULL OR abs(acc) < 1e-6))"""))
def flt_05(spark, sf):
    o = clean.drop_outlier_segments(trace(spark, sf), 5, 200000, 0.0001, 0.02, 1e-6)
    return o.out("session", "event_id")


@query("FLT-06", T(f""", s AS (SELECT *, lag(lat) OVER w pa, lag(lon) OVER w po, lag(t) OVER w pt,
lead(lat) OVER w na, lead(lon) OVER w "no", lead(t) OVER w nt FROM trace WINDOW w AS (PARTITION BY session ORDER BY i))
SELECT session, event_id FROM s WHERE k < 90 AND NOT (coalesce({HAV_PREV} / greatest(abs(t - pt), 0.01) > 0.001, false)
AND coalesce({HAV_NEXT.replace('no)', '"no")')} / greatest(abs(t - nt), 0.01) > 0.001, false))"""))
def flt_06(spark, sf):
    return clean.drop_two_sided_jumps(trace(spark, sf), 0.001, "k", 90).out("session", "event_id")


@query("FLT-07", T(""", s AS (SELECT session, event_id, t_us - k * 1800000000 AS c,
lag(t_us - k * 1800000000) OVER (PARTITION BY session ORDER BY i) AS pc FROM trace)
SELECT session, event_id, c FROM s WHERE pc IS NULL OR c > pc"""))
def flt_07(spark, sf):
    o = trace(spark, sf).cols(c=F.col("t_us") - F.col("k") * 1800000000)
    return clean.drop_backward_times(o, "c").out("session", "event_id", "c")


@query("FLT-08", T(""", s AS (SELECT session, event_id, i, t - k * 1800.0 AS c FROM trace)
SELECT session, event_id, round(0.001*i + max(c - 0.001*i) OVER (PARTITION BY session ORDER BY i), 6) AS fixed FROM s"""))
def flt_08(spark, sf):
    o = trace(spark, sf).cols(c=F.col("t") - F.col("k") * 1800.0)
    return clean.repair_times(o, "c", 0.001, "fixed").out("session", "event_id", r("fixed", 6).alias("fixed"))


@query("FLT-09", T("SELECT session, event_id FROM trace WHERE e > 20 AND e < 130 AND n > -20 AND n < 60"))
def flt_09(spark, sf):
    return trace(spark, sf).df.where(geo.inside("e", "n", RING)).select("session", "event_id")


@query("FLT-10", T("""SELECT event_id, round(lat, 5) AS lat, round(lon, 5) AS lon, round(t, 3) AS t,
CAST(125.0 AS DOUBLE) AS altitude FROM trace"""))
def flt_10(spark, sf):
    return trace(spark, sf).df.select(
        "event_id", r("lat", 5).alias("lat"), r("lon", 5).alias("lon"), r("t", 3).alias("t"),
        F.lit(125.0).alias("altitude"))


@query("FLT-11", T("""SELECT e, n, session, i FROM (SELECT e, n, session, i,
row_number() OVER (PARTITION BY e, n ORDER BY session, i) rn FROM trace) WHERE rn = 1"""))
def flt_11(spark, sf):
    return clean.distinct_points(trace(spark, sf).df.select("e", "n", "session", "i"), ["e", "n"], ["session", "i"])


@query("FLT-12", recursive(
    "SELECT session, event_id, i, t FROM trace",
    "SELECT session, event_id, i, t AS last, true AS keep FROM src WHERE i = 0",
    """SELECT s.session, s.event_id, s.i, CASE WHEN s.t - f.last >= 1.0/0.00002 THEN s.t ELSE f.last END,
    s.t - f.last >= 1.0/0.00002 FROM f JOIN src s ON s.session = f.session AND s.i = f.i + 1""",
    "SELECT session, event_id FROM f WHERE keep"))
def flt_12(spark, sf):
    return clean.decimate(trace(spark, sf), 0.00002).out("session", "event_id")


@query("FLT-13", T("SELECT session, event_id FROM trace WHERE i % 10 = 0"))
def flt_13(spark, sf):
    return clean.every_nth(trace(spark, sf), 10).out("session", "event_id")


@query("FLT-14", T(""", c AS (SELECT session, floor(e/6.0) cx, floor(n/6.0) cy, count(*) visits FROM trace GROUP BY ALL),
l AS (SELECT session, count(DISTINCT lap) laps FROM trace GROUP BY session)
SELECT t.session, t.event_id, c.visits FROM trace t JOIN c ON t.session = c.session AND floor(t.e/6.0) = cx AND floor(t.n/6.0) = cy
JOIN l ON l.session = t.session WHERE visits >= greatest(2.0, 0.35*laps)"""))
def flt_14(spark, sf):
    d = trace(spark, sf).df
    laps = d.groupBy("session").agg(F.countDistinct("lap").alias("laps"))
    return clean.density_gate(d, ["session"], "e", "n", 6.0, 0.35, laps, F.col(G)).select(
        "session", "event_id", "visits")


@query("FLT-15", T(""", s AS (SELECT session, event_id, e - lag(e) OVER w ax, n - lag(n) OVER w ay,
lead(e) OVER w - e bx, lead(n) OVER w - n AS by_ FROM trace WINDOW w AS (PARTITION BY session ORDER BY i)),
g AS (SELECT *, sqrt(ax*ax+ay*ay) la, sqrt(bx*bx+by_*by_) lb FROM s)
SELECT session, event_id, round(la, 6) AS gap, round(degrees(acos(greatest(-1.0, least(1.0, (ax*bx+ay*by_)/(la*lb))))), 5) AS angle
FROM g WHERE la > 0 AND lb > 0 AND degrees(acos(greatest(-1.0, least(1.0, (ax*bx+ay*by_)/(la*lb))))) > 45"""))
def flt_15(spark, sf):
    o = clean.sharp_angles(trace(spark, sf)).where("angle > 45")
    return o.out("session", "event_id", r("gap").alias("gap"), r("angle", 5).alias("angle"))


# ---------------------------------------------------------------- projections
@query("PRJ-01", T(""", a AS (SELECT session, arg_min(lat, i) lat0, arg_min(lon, i) lon0 FROM trace GROUP BY session),
p AS (SELECT t.session, event_id, radians(lon - lon0) * cos(radians(lat0)) * 6371000.0 AS east, radians(lat - lat0) * 6371000.0 AS north, lat0, lon0
FROM trace t JOIN a USING (session))
SELECT session, event_id, round(east, 5) AS east, round(north, 5) AS north,
round(lat0 + degrees(north / 6371000.0), 7) AS lat_back, round(lon0 + degrees(east / (cos(radians(lat0)) * 6371000.0)), 7) AS lon_back FROM p"""))
def prj_01(spark, sf):
    o = trace(spark, sf).totals(lat0=F.min_by("lat", G), lon0=F.min_by("lon", G))
    east, north = geo.to_local("lat", "lon", "lat0", "lon0")
    back = geo.to_geographic("east", "north", "lat0", "lon0")
    return o.cols(east=east, north=north).out(
        "session", "event_id", r("east", 5).alias("east"), r("north", 5).alias("north"),
        r(back[0], 7).alias("lat_back"), r(back[1], 7).alias("lon_back"))


@query("PRJ-02", T(f""", s AS (SELECT session, event_id, lat, lon, lag(lat) OVER w pa, lag(lon) OVER w po FROM trace
WINDOW w AS (PARTITION BY session ORDER BY i)),
b AS (SELECT *, {HAV_PREV} AS d, degrees(atan2(sin(radians(lon)-radians(po))*cos(radians(lat)),
cos(radians(pa))*sin(radians(lat))-sin(radians(pa))*cos(radians(lat))*cos(radians(lon)-radians(po)))) AS raw FROM s WHERE pa IS NOT NULL),
c AS (SELECT *, raw - 360*floor(raw/360) AS course FROM b)
SELECT session, event_id, round(d, 4) AS metres, round(course, 3) AS course,
round(degrees(asin(sin(radians(pa))*cos(d/6371000.0)+cos(radians(pa))*sin(d/6371000.0)*cos(radians(course)))), 7) AS lat_reached FROM c"""))
def prj_02(spark, sf):
    o = trace(spark, sf).lag(pa="lat", po="lon").where("pa is not null")
    o = o.cols(metres=geo.haversine("pa", "po", "lat", "lon"), course=geo.bearing("pa", "po", "lat", "lon"))
    reached, _ = geo.destination("pa", "po", "course", "metres")
    return o.out("session", "event_id", r("metres", 4).alias("metres"), r("course", 3).alias("course"),
                 r(reached, 7).alias("lat_reached"))


# Transverse Mercator series with e2 = f(2 - f), ep2 = e2/(1 - e2), central meridian -93.
UTM_SQL = """, c AS (SELECT 6378137.0::DOUBLE AS a, (1/298.257223563::DOUBLE)*(2 - 1/298.257223563::DOUBLE) AS e2), u0 AS (SELECT session, event_id, radians(lat) AS la, radians(lon + 93.0) AS dl, a, e2, e2/(1 - e2) AS ep2 FROM trace, c),
u1 AS (SELECT *, a/sqrt(1 - e2*sin(la)*sin(la)) AS nu, tan(la)*tan(la) AS tt, ep2*cos(la)*cos(la) AS cc, cos(la)*dl AS aa,
a*((1 - e2/4 - 3*e2*e2/64 - 5*e2*e2*e2/256)*la - (3*e2/8 + 3*e2*e2/32 + 45*e2*e2*e2/1024)*sin(2*la) + (15*e2*e2/256 + 45*e2*e2*e2/1024)*sin(4*la) - (35*e2*e2*e2/3072)*sin(6*la)) AS m FROM u0),
u2 AS (SELECT session, event_id, 500000.0 + 0.9996*nu*(aa + (1 - tt + cc)*pow(aa,3)/6 + (5 - 18*tt + tt*tt + 72*cc - 58*ep2)*pow(aa,5)/120) AS x,
0.9996*(m + nu*tan(la)*(aa*aa/2 + (5 - tt + 9*cc + 4*cc*cc)*pow(aa,4)/24 + (61 - 58*tt + tt*tt + 600*cc - 330*ep2)*pow(aa,6)/720)) AS y FROM u1) """


@query("PRJ-03", T(UTM_SQL + """SELECT session, event_id, round(x, 3) AS easting, round(y, 3) AS northing, round(x - min(x) OVER (PARTITION BY session), 3) AS grid_x,
round(y - min(y) OVER (PARTITION BY session), 3) AS grid_y FROM u2"""))
def prj_03(spark, sf):
    east, north = geo.utm("lat", "lon", -93.0)
    o = trace(spark, sf).cols(easting=east, northing=north)
    o = o.totals(e0=F.min("easting"), n0=F.min("northing"))
    return o.out("session", "event_id", r("easting", 3).alias("easting"), r("northing", 3).alias("northing"),
                 r(F.col("easting") - F.col("e0"), 3).alias("grid_x"),
                 r(F.col("northing") - F.col("n0"), 3).alias("grid_y"))


@query("PRJ-04", T("""SELECT session, event_id, round(mps*2.2369362920544, 6) AS mph, round(mps*3.6, 6) AS kmh, round(mps/9.80665, 6) AS g
FROM (SELECT session, event_id, CASE WHEN avg(speed) OVER (PARTITION BY session) < 50 THEN speed ELSE speed / 2.2369362920544 END AS mps FROM trace)"""))
def prj_04(spark, sf):
    o = trace(spark, sf).totals(m=F.avg("speed"))
    mps = F.when(F.col("m") < 50, F.col("speed")).otherwise(F.col("speed") / geo.MPH)
    return o.out("session", "event_id", r(mps * geo.MPH).alias("mph"), r(mps * 3.6).alias("kmh"),
                 r(mps / geo.G0).alias("g"))


@query("PRJ-05", T(""", b AS (SELECT session, min(e) x0, max(e) x1, min(n) y0, max(n) y1 FROM trace GROUP BY session)
SELECT session, event_id,
round(38.0 + 0.01*(((e-(x0+x1)/2)*sin(radians(30)) + (n-(y0+y1)/2)*cos(radians(30)))/greatest(x1-x0, y1-y0)), 8) AS lat,
round(-90.0 + 0.01*(((e-(x0+x1)/2)*cos(radians(30)) - (n-(y0+y1)/2)*sin(radians(30)))/greatest(x1-x0, y1-y0)), 8) AS lon
FROM trace JOIN b USING (session)"""))
def prj_05(spark, sf):
    o = trace(spark, sf).totals(x0=F.min("e"), x1=F.max("e"), y0=F.min("n"), y1=F.max("n"))
    cx, cy = F.col("e") - (F.col("x0") + F.col("x1")) / 2, F.col("n") - (F.col("y0") + F.col("y1")) / 2
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    cos, sin = F.cos(F.radians(F.lit(30.0))), F.sin(F.radians(F.lit(30.0)))
    return o.out("session", "event_id", r(38.0 + 0.01 * ((cx * sin + cy * cos) / size), 8).alias("lat"),
                 r(-90.0 + 0.01 * ((cx * cos - cy * sin) / size), 8).alias("lon"))


@query("PRJ-06", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity*l_quantity + l_discount*l_discount + l_tax*l_tax), 6) AS mag, "
       "round(sqrt(l_quantity*l_quantity + l_discount*l_discount + l_tax*l_tax)/9.80665, 6) AS total_g FROM lineitem")
def prj_06(spark, sf):
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    mag = F.sqrt(q * q + d * d + x * x)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r(mag).alias("mag"), r(mag / geo.G0).alias("total_g"))


@query("PRJ-07", """SELECT l_orderkey, l_linenumber, round((l_quantity*o_totalprice/1e5 + l_discount*o_custkey/1e3 + l_tax*0.5)
/ (sqrt(pow(o_totalprice/1e5,2)+pow(o_custkey/1e3,2)+0.25)+1e-9), 6) AS yaw_rate FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def prj_07(spark, sf):
    """Gyro rows (lineitem) projected on the gravity row (orders) of the same key."""
    gyro, grav = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    gx, gy = F.col("o_totalprice") / 1e5, F.col("o_custkey") / 1e3
    norm = F.sqrt(F.pow(gx, 2) + F.pow(gy, 2) + 0.25) + 1e-9
    dot = F.col("l_quantity") * gx + F.col("l_discount") * gy + F.col("l_tax") * 0.5
    side = grav.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", "o_custkey")
    return clean.salted_lookup(gyro, side, ["l_orderkey"], F.col("l_linenumber"), "inner", selective=True).select(
        "l_orderkey", "l_linenumber", r(dot / norm).alias("yaw_rate"))


@query("PRJ-08", """WITH s AS (SELECT user_id AS session, min(value) lo, max(value) hi, quantile_cont(value, 0.05) p5,
quantile_cont(value, 0.95) p95, min(log10(value)) l0, max(log10(value)) l1 FROM events GROUP BY user_id)
SELECT event_id, round(30 + (value-lo)/nullif(hi-lo,0)*50, 6) AS minmax,
round(30 + least(1.0, greatest(0.0, (value-p5)/nullif(p95-p5,0)))*50, 6) AS robust,
round(30 + (log10(value)-l0)/nullif(l1-l0,0)*50, 6) AS logged FROM events JOIN s ON user_id = session""")
def prj_08(spark, sf):
    o = trace(spark, sf)
    o = o.cols(lg=F.log10("speed"))
    stats = o.df.groupBy("session").agg(F.min("speed").alias("lo"), F.max("speed").alias("hi"),
                                        F.min("lg").alias("l0"), F.max("lg").alias("l1"))
    stats = stats.join(quantiles(o.df, ["session"], ["speed"], {"p5": 0.05, "p95": 0.95}), "session")
    o = o.attach(stats)

    def scaled(x, lo, hi):
        return (F.col(x) - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0))

    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled("speed", "speed_p5", "speed_p95")))
    clipped = F.when(F.col("speed_p95") > F.col("speed_p5"), clipped)
    return o.out("event_id", r(30 + scaled("speed", "lo", "hi") * 50).alias("minmax"),
                 r(30 + clipped * 50).alias("robust"), r(30 + scaled("lg", "l0", "l1") * 50).alias("logged"))


@query("PRJ-09", """SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'slow' WHEN p_size > 10 AND p_size <= 25 THEN 'mid'
WHEN p_size > 25 AND p_size <= 50 THEN 'fast' END AS speed_class,
CAST(least(5, greatest(1, ceil((p_retailprice - lo)/((hi - lo)/5)))) AS INTEGER) AS price_bin
FROM part, (SELECT min(p_retailprice) lo, max(p_retailprice) hi FROM part)""")
def prj_09(spark, sf):
    part = table(spark, sf, "part")
    lo, hi = (part.agg(f("p_retailprice")).scalar() for f in (F.min, F.max))
    size = F.col("p_size")
    label = (F.when((size > 0) & (size <= 10), "slow").when((size > 10) & (size <= 25), "mid")
             .when((size > 25) & (size <= 50), "fast"))
    bin_ = F.ceil((F.col("p_retailprice") - lo) / ((hi - lo) / 5))
    return part.select("p_partkey", label.alias("speed_class"),
                       F.least(F.lit(5), F.greatest(F.lit(1), bin_)).cast("int").alias("price_bin"))


@query("PRJ-10", """SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M') AS session_key, epoch_us(date_trunc('minute', ts)) AS t_us FROM events""")
def prj_10(spark, sf):
    """Clock text in three layouts parsed back by trying each."""
    ev = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    layouts = ["yyyy-MM-dd HH:mm", "yyyy-MM-dd h:mm a", "yyyy-MM-dd'T'HH:mmXXX"]
    pick = F.pmod("event_id", F.lit(3))
    raw = F.when(pick == 0, F.date_format("at", layouts[0])).when(
        pick == 1, F.date_format("at", layouts[1])).otherwise(F.date_format("at", layouts[2]))
    parsed = F.coalesce(*[F.try_to_timestamp(F.col("raw"), F.lit(f)) for f in layouts])
    return ev.withColumn("raw", raw).withColumn("at2", parsed).select(
        "event_id", F.date_format("at2", "yyyy-MM-dd_HH-mm").alias("session_key"),
        F.unix_micros("at2").alias("t_us"))


@query("PRJ-11", T(f""", s AS (SELECT session, event_id, lat, lon, t, CASE WHEN k % 4 = 0 THEN -1 ELSE speed END AS sp,
lag(lat) OVER w pa, lag(lon) OVER w po, lag(t) OVER w pt FROM trace WINDOW w AS (PARTITION BY session ORDER BY i))
SELECT session, event_id, round(CASE WHEN sp >= 0 THEN sp ELSE {HAV_PREV} / nullif(t - pt, 0) END, 8) AS speed FROM s"""))
def prj_11(spark, sf):
    o = trace(spark, sf).cols(sp=F.when(F.col("k") % 4 == 0, -1.0).otherwise(F.col("speed")))
    o = o.lag(pa="lat", po="lon", pt="t")
    derived = geo.haversine("pa", "po", "lat", "lon") / F.nullif(F.col("t") - F.col("pt"), F.lit(0.0))
    return o.out("session", "event_id", r(F.when(F.col("sp") >= 0, F.col("sp")).otherwise(derived), 8).alias("speed"))


# ---------------------------------------------------------------- sorts and sets
@query("SRT-01", "SELECT l_orderkey, l_linenumber, l_shipdate::VARCHAR AS shipped FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber")
def srt_01(spark, sf):
    return table(spark, sf, "lineitem").orderBy("l_shipdate", "l_orderkey", "l_linenumber").select(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"))


@query("SRT-02", """SELECT session, event_id, speed, rk FROM (SELECT user_id AS session, event_id, value AS speed,
CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rk FROM events) WHERE rk <= 3""")
def srt_02(spark, sf):
    w = Window.partitionBy("session").orderBy(F.desc("speed"), "event_id")
    return events(spark, sf).withColumn("rk", F.row_number().over(w)).where("rk <= 3").select(
        "session", "event_id", "speed", "rk")


@query("SRT-03", """SELECT user_id AS session, arg_min(event_id, (value, event_id)) AS slowest, arg_min(event_id, (-value, event_id)) AS fastest
FROM events GROUP BY user_id""")
def srt_03(spark, sf):
    return events(spark, sf).groupBy("session").agg(
        F.min_by("event_id", F.struct("speed", "event_id")).alias("slowest"),
        F.min_by("event_id", F.struct(-F.col("speed"), "event_id")).alias("fastest"))


@query("SRT-04", """SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey
ORDER BY o_custkey LIMIT 20""")
def srt_04(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order")
    ).orderBy("o_custkey").limit(20)


@query("SET-01", """SELECT c_custkey AS id, c_name AS name, 'driver' AS role FROM customer UNION ALL
SELECT s_suppkey, s_name, 'team' FROM supplier""")
def set_01(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("driver").alias("role"))
    s = table(spark, sf, "supplier").select(F.lit("team").alias("role"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s)


@query("SET-02", "SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 20")
def set_02(spark, sf):
    home = table(spark, sf, "customer").where("c_nationkey < 20")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).subtract(
        home.select(F.col("c_custkey").alias("id")))


@query("SET-03", """SELECT event_type AS kind, count(DISTINCT user_id) AS sessions, count(*) AS n FROM events GROUP BY event_type""")
def set_03(spark, sf):
    return events(spark, sf).groupBy("kind").agg(F.countDistinct("session").alias("sessions"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- scalar functions
@query("SCA-01", r"""SELECT s_suppkey, lower(trim(s_name)) AS name, split_part(s_name, '#', 1) AS head,
regexp_extract(s_name, '([1-9][0-9]*)$', 1) AS digits, replace(s_name, 'Supplier', 'Team') AS team, s_name LIKE 'Supp%' AS pre,
contains(s_name, '#0') AS has, format('{} ({})', s_name, s_nationkey) AS label FROM supplier""")
def sca_01(spark, sf):
    c = F.col("s_name")
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.lower(F.trim(c)).alias("name"), F.split_part(c, F.lit("#"), F.lit(1)).alias("head"),
        F.regexp_extract(c, "([1-9][0-9]*)$", 1).alias("digits"), F.replace(c, F.lit("Supplier"), F.lit("Team")).alias("team"),
        c.startswith("Supp").alias("pre"), c.contains("#0").alias("has"), F.format_string("%s (%d)", c, F.col("s_nationkey")).alias("label"))


@query("SCA-02", """WITH s AS (SELECT event_id, value, CAST(round(value*1000) AS BIGINT) AS ms FROM events),
x AS (SELECT *, format('{}:{:02d}.{:03d}', ms // 60000, (ms // 1000) % 60, ms % 1000) AS lap FROM s)
SELECT event_id, lap, round(ms / 1000.0, 3) AS seconds, replace(lap, ':', ' minute ') || ' seconds' AS words,
format('{}h {}m {}s', ms*37 // 3600000, (ms*37 // 60000) % 60, (ms*37 // 1000) % 60) AS total FROM x""")
def sca_02(spark, sf):
    d = events(spark, sf).withColumn("lap", text.lap_text(F.col("speed")))
    ms = F.round(F.col("speed") * 1000).cast("long")
    return d.select("event_id", "lap", r(text.lap_seconds(F.col("lap")), 3).alias("seconds"),
                    text.lap_words(F.col("lap")).alias("words"), text.duration_text(ms * 37).alias("total"))


@query("SCA-03", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%-d %B %Y') END AS day FROM orders""")
def sca_03(spark, sf):
    raw = F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", text.long_date(raw).alias("day"))


@query("SCA-04", T("""SELECT event_id, round(sqrt(e*e+n*n), 6) AS dist, round(atan2(n, e), 6) AS ang, round(radians(e), 6) AS rad,
round(log10(speed), 6) AS lg, greatest(-5.0, least(5.0, e)) AS clipped, abs(e) AS mag, round((e - 90) - 360*floor((e - 90)/360), 6) AS course FROM trace"""))
def sca_04(spark, sf):
    return trace(spark, sf).df.select(
        "event_id", r(geo.hypot("e", "n")).alias("dist"), r(F.atan2("n", "e")).alias("ang"), r(F.radians("e")).alias("rad"),
        r(F.log10("speed")).alias("lg"), F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col("e"))).alias("clipped"),
        F.abs("e").alias("mag"), r(F.pmod(F.col("e") - 90, F.lit(360.0))).alias("course"))


@query("SCA-05", """SELECT vec_id, round(list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE))), 6) AS cum8,
CAST(list_position(embedding, list_min(embedding)) - 1 AS INTEGER) AS argmin, round(CAST(embedding[2] AS DOUBLE) - CAST(embedding[1] AS DOUBLE), 6) AS diff1,
round(CAST(list_sort(embedding)[1] AS DOUBLE), 6) AS lowest FROM embeddings""")
def sca_05(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    d = table(spark, sf, "embeddings").withColumn("v", v)
    cums = F.aggregate(F.slice("v", 1, 8), F.lit(0.0), lambda a, x: a + x)
    diff = F.zip_with(F.slice("v", 2, 63), F.slice("v", 1, 63), lambda b, a: b - a)
    return d.select("vec_id", r(cums).alias("cum8"), (F.array_position("v", F.array_min("v")) - 1).cast("int").alias("argmin"),
                    r(F.get(diff, 0)).alias("diff1"), r(F.get(F.sort_array("v"), 0)).alias("lowest"))


@query("SCA-06", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.gear.ratio'), 'none') AS ratio,
CAST(json_extract(props, '$.k') AS DOUBLE) AS num FROM events""")
def sca_06(spark, sf):
    doc = F.from_json("props", "k string, gear struct<ratio:string>")
    return table(spark, sf, "events").withColumn("j", doc).select(
        "event_id", F.col("j.k").try_cast("long").alias("k"), F.coalesce("j.gear.ratio", F.lit("none")).alias("ratio"),
        text.number(F.col("j.k")).alias("num"))


@query("SCA-08", """SELECT p_partkey, p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st'
WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS place FROM part""")
def sca_08(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.ordinal(F.col("p_size")).alias("place"))
