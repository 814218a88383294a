"""Aggregations: laps, sectors, rates, envelopes, agreement, race history."""

from pyspark.sql import functions as F

from lapforge.functions.geo import hypot
from lapforge.operators import asof as aj
from lapforge.operators import clean, resample, smooth, stats
from lapforge.operators.ordered import G, quantiles
from lapforge.plans.registry import query
from lapforge.plans.streams import DIST_SQL, FGRID, HAV_FREE, LAPS_SQL, LERP, NEAR, lap_fractions, laps, streams
from lapforge.plans.views import T, events, r, table, trace

LT = LAPS_SQL + ", lt AS (SELECT session, lap, t_end - t_start AS lap_time FROM laps WHERE n_pts = 16) "


def lap_times(spark, sf):
    return laps(spark, sf).where("n_pts = 16").select("session", "lap", (F.col("t_end") - F.col("t_start")).alias("lap_time"))


@query("AGG-01", T(LT + """SELECT session, count(*) AS n, round(min(lap_time), 6) AS best, round(avg(lap_time), 2) AS mean, round(median(lap_time), 7) AS median,
round(coalesce(stddev_samp(lap_time), 0), 5) AS std, round(coalesce(stddev_samp(lap_time), 0)/avg(lap_time), 6) AS cv, round(quantile_cont(lap_time, 0.9), 7) AS p90,
round(median(lap_time), 7) AS p50 FROM lt GROUP BY session"""))
def agg_01(spark, sf):
    d = stats.pace_pack(lap_times(spark, sf), ["session"], "lap_time")
    return d.select("session", "n", r("best").alias("best"), r("mean", 2).alias("mean"), r("std", 5).alias("std"), *[r(c, 7).alias(c) for c in ("median", "p90", "p50")], r("cv").alias("cv"))


@query("AGG-02", """SELECT vec_id AS sheet, count(x) AS n, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std, round(coalesce(stddev_samp(x), 0)/nullif(avg(x), 0), 6) AS cv
FROM (SELECT vec_id, CASE WHEN v > 0 THEN v END AS x FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)) GROUP BY vec_id""")
def agg_02(spark, sf):
    sheets = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sheet"), F.transform("embedding", lambda v: F.when(v > 0, v.cast("double"))).alias("laps"))
    d = stats.consistency(sheets, ["sheet"], "laps")
    return d.select("sheet", "n", *[r(c).alias(c) for c in ("mean", "std", "cv")])


SECT = """, sect AS (SELECT session, lap, sector, min(t) AS t_in, max(t) AS t_out, max(t) - min(t) AS duration FROM trace GROUP BY ALL) """


def sectors(spark, sf):
    return stats.sector_times(trace(spark, sf).df, ["session"], "lap", "sector", "t")


@query("AGG-03", T(SECT + "SELECT session, lap, sector, round(t_in, 6) AS t_in, round(t_out, 6) AS t_out, round(duration, 6) AS duration FROM sect"))
def agg_03(spark, sf):
    return sectors(spark, sf).select("session", "lap", "sector", *[r(c).alias(c) for c in ("t_in", "t_out", "duration")])


COMPLETE = SECT + """, comp AS (SELECT session, lap, sum(duration) AS lap_time FROM sect GROUP BY ALL HAVING count(DISTINCT sector) = 3),
bs AS (SELECT session, sector, min(duration) AS best, arg_min(lap, (duration, lap)) AS best_lap FROM sect GROUP BY ALL) """


@query("AGG-04", T(COMPLETE + """SELECT b.session, round(theoretical, 5) AS theoretical, round(actual, 5) AS actual, round(actual - theoretical, 5) AS gap
FROM (SELECT session, sum(best) AS theoretical FROM bs GROUP BY session) b LEFT JOIN (SELECT session, min(lap_time) AS actual FROM comp GROUP BY session) c ON b.session = c.session"""))
def agg_04(spark, sf):
    s = sectors(spark, sf)
    d = stats.theoretical_best(s, stats.complete_laps(s, ["session"], 3), ["session"])
    return d.select("session", *[r(c, 5).alias(c) for c in ("theoretical", "actual", "gap")])


@query("AGG-05", T(COMPLETE + "SELECT session, sector, round(best, 6) AS best, best_lap FROM bs"))
def agg_05(spark, sf):
    return stats.sector_bests(sectors(spark, sf), ["session"]).select("session", "sector", r("best").alias("best"), "best_lap")


@query("AGG-06", T(COMPLETE + "SELECT session, count(*) AS n_complete, round(min(lap_time), 5) AS best, arg_min(lap, (lap_time, lap)) AS best_lap FROM comp GROUP BY session"))
def agg_06(spark, sf):
    c = stats.complete_laps(sectors(spark, sf), ["session"], 3)
    return c.groupBy("session").agg(F.count(F.lit(1)).alias("n_complete"), r(F.min("lap_time"), 5).alias("best"),
                                    F.min_by("lap", F.struct("lap_time", "lap")).alias("best_lap"))


@query("AGG-07", T(COMPLETE + """, u AS (SELECT sector, min(duration) AS best, arg_min(session, (duration, session, lap)) AS best_race, arg_min(lap, (duration, session, lap)) AS best_lap FROM sect WHERE duration > 0 GROUP BY sector)
SELECT 'sector ' || sector AS item, round(best, 6) AS best, best_race, best_lap FROM u UNION ALL
SELECT 'lap', round(min(lap_time), 5), arg_min(session, (lap_time, session, lap)), arg_min(lap, (lap_time, session, lap)) FROM comp UNION ALL SELECT 'ultimate', round(sum(best), 5), NULL, NULL FROM u"""))
def agg_07(spark, sf):
    s = sectors(spark, sf)
    key = F.struct("duration", "session", "lap")
    u = s.where("duration > 0").groupBy("sector").agg(F.min("duration").alias("best"), F.min_by("session", key).alias("best_race"), F.min_by("lap", key).alias("best_lap"))
    per = u.select(F.concat(F.lit("sector "), F.col("sector")).alias("item"), r("best").alias("best"), "best_race", "best_lap")
    k2 = F.struct("lap_time", "session", "lap")
    lap = stats.complete_laps(s, ["session"], 3).agg(
        F.lit("lap").alias("item"), r(F.min("lap_time"), 5).alias("best"), F.min_by("session", k2).alias("best_race"), F.min_by("lap", k2).alias("best_lap"))
    return per.unionByName(lap).unionByName(
        u.agg(F.lit("ultimate").alias("item"), r(F.sum("best"), 5).alias("best")), allowMissingColumns=True)


@query("AGG-08", T("""SELECT session, lap, round(max(t) - min(t), 6) AS lap_time, round(avg(speed), 6) AS avg_speed, max(speed) AS max_speed, min(speed) AS min_speed,
round(max(speed) - min(speed), 6) AS speed_range, max(abs(e)) AS max_lat, max(abs(n)) AS max_long, round(max(sqrt(e*e + n*n)), 6) AS max_combined FROM trace GROUP BY session, lap"""))
def agg_08(spark, sf):
    return trace(spark, sf).df.groupBy("session", "lap").agg(
        r(F.max("t") - F.min("t")).alias("lap_time"), r(F.avg("speed")).alias("avg_speed"), F.max("speed").alias("max_speed"), F.min("speed").alias("min_speed"),
        r(F.max("speed") - F.min("speed")).alias("speed_range"), F.max(F.abs("e")).alias("max_lat"), F.max(F.abs("n")).alias("max_long"), r(F.max(hypot("e", "n"))).alias("max_combined"))


WS = " OVER (PARTITION BY session ORDER BY i)"


@query("AGG-09", T(f""", d AS (SELECT session, t, t - lag(t){WS} AS dt FROM trace)
SELECT session, count(*) AS n, count(DISTINCT t) AS n_distinct, round(avg(dt), 5) AS mean_interval, round(median(dt), 5) AS median_interval, round(avg(1/dt), 9) AS mean_hz, round(median(1/dt), 9) AS median_hz,
round(min(1/dt), 9) AS min_hz, round(max(1/dt), 9) AS max_hz, round(stddev_samp(1/dt), 7) AS std_hz, round(1 - count(DISTINCT t)/count(*), 6) AS duplicate_ratio FROM d GROUP BY session"""))
def agg_09(spark, sf):
    d = stats.rate_profile(trace(spark, sf), "t")
    return d.select("session", "n", "n_distinct", r("mean_interval", 5).alias("mean_interval"), r("dt_median", 5).alias("median_interval"), r("hz_median", 9).alias("median_hz"),
                    *[r(c, 9).alias(c) for c in ("mean_hz", "min_hz", "max_hz")], r("std_hz", 7).alias("std_hz"), r("duplicate_ratio").alias("duplicate_ratio"))


@query("AGG-10", T(NEAR + """, c AS (SELECT session, pt, count(*) AS m, min(t) AS lo, max(t) AS hi FROM j WHERE pt IS NOT NULL GROUP BY ALL)
SELECT session, count(*) AS fixes, round(avg(m), 6) AS avg_n, round(median(m), 6) AS median_n, max(m) AS max_n, round(max(hi - lo), 6) AS longest FROM c GROUP BY session"""))
def agg_10(spark, sf):
    fast, slow = streams(spark, sf)
    d = aj.asof(fast, slow, ["session"], "t", "event_id", ["k"]).where("r_t is not null")
    c = d.groupBy("session", "r_t").agg(F.count(F.lit(1)).alias("m"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    a = c.groupBy("session").agg(F.count(F.lit(1)).alias("fixes"), r(F.avg("m")).alias("avg_n"), F.max("m").alias("max_n"), r(F.max(F.col("hi") - F.col("lo"))).alias("longest"))
    return a.join(quantiles(c, ["session"], ["m"], {"median_n": 0.5}), "session").select(
        "session", "fixes", "avg_n", r("m_median_n").alias("median_n"), "max_n", "longest")


@query("AGG-11", """WITH u AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME "column" VALUE value)
SELECT "column", min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(median(value), 4) AS median FROM u GROUP BY 1""")
def agg_11(spark, sf):
    d = stats.column_profile(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return d.select("column", "min", "max", *[r(c, 4).alias(c) for c in ("mean", "std", "median")])


@query("AGG-12", T(f""", s AS (SELECT *, lag(lat){WS} pa, lag(lon){WS} po, t - lag(t){WS} AS dt FROM trace), g AS (SELECT *, {HAV_FREE} AS step FROM s)
SELECT session, round(min(lat), 8) AS lat_min, round(max(lat), 8) AS lat_max, round(min(lon), 8) AS lon_min, round(max(lon), 8) AS lon_max, round(quantile_cont(speed, 0.5), 6) AS speed_p50,
round(quantile_cont(speed, 0.95), 6) AS speed_p95, round(quantile_cont(k, 0.9), 6) AS accuracy_p90, count(CASE WHEN step > 60 THEN 1 END) AS glitches, count(CASE WHEN dt > 86400 THEN 1 END) AS gaps,
max(lap) AS revolutions FROM g GROUP BY session"""))
def agg_12(spark, sf):
    from lapforge.functions.geo import haversine

    o = trace(spark, sf).lag(pa="lat", po="lon", pt="t").cols(step=haversine("pa", "po", "lat", "lon"))
    q = quantiles(o.df, ["session"], ["speed", "k"], {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    a = o.df.groupBy("session").agg(
        r(F.min("lat"), 8).alias("lat_min"), r(F.max("lat"), 8).alias("lat_max"), r(F.min("lon"), 8).alias("lon_min"), r(F.max("lon"), 8).alias("lon_max"),
        F.count(F.when(F.col("step") > 60, 1)).alias("glitches"), F.count(F.when(F.col("t") - F.col("pt") > 86400, 1)).alias("gaps"), F.max("lap").alias("revolutions"))
    return a.join(q, "session").select(*a.columns, r("speed_p50").alias("speed_p50"), r("speed_p95").alias("speed_p95"), r("k_p90").alias("accuracy_p90"))


@query("AGG-13", "SELECT user_id AS session, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS driving, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS engine_on FROM events GROUP BY user_id")
def agg_13(spark, sf):
    frac = lambda c: r(F.avg(c.cast("double")))
    return events(spark, sf).groupBy("session").agg(frac(F.col("speed") > 20).alias("driving"), frac(F.col("kind") != "error").alias("engine_on"))


@query("AGG-14", """SELECT p_brand, round(quantile_cont(p_retailprice, 0.995), 5) AS top, round(quantile_cont(p_retailprice, 0.005), 5) AS bottom, round(quantile_cont(p_size, 0.995), 5) AS size_top FROM part GROUP BY p_brand""")
def agg_14(spark, sf):
    q = quantiles(table(spark, sf, "part"), ["p_brand"], ["p_retailprice", "p_size"], {"hi": 0.995, "lo": 0.005})
    return q.select("p_brand", r("p_retailprice_hi", 5).alias("top"), r("p_retailprice_lo", 5).alias("bottom"), r("p_size_hi", 5).alias("size_top"))


@query("AGG-15", T(f""", d AS (SELECT speed, k, (speed - lag(speed){WS})/(t - lag(t){WS}) AS a FROM trace), b AS (SELECT *, CAST(least(19, floor(speed/25.0)) AS BIGINT) AS bin FROM d WHERE a IS NOT NULL)
SELECT bin, count(*) AS n, round(quantile_cont(a, 0.95), 8) AS a95, round(quantile_cont(a, 0.05), 8) AS a05, round(quantile_cont(k, 0.95), 5) AS k95 FROM b GROUP BY bin"""))
def agg_15(spark, sf):
    o = trace(spark, sf).lag(ps="speed", pt="t").cols(a=(F.col("speed") - F.col("ps")) / (F.col("t") - F.col("pt"))).where("a is not null")
    d = o.df.withColumn("bin", F.least(F.lit(19).cast("long"), F.floor(F.col("speed") / 25.0)))
    q = quantiles(d, ["bin"], ["a", "k"], {"95": 0.95, "05": 0.05})
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).join(q, "bin").select(
        "bin", "n", r("a_95", 8).alias("a95"), r("a_05", 8).alias("a05"), r("k_95", 5).alias("k95"))


@query("AGG-16", T(DIST_SQL + """, b AS (SELECT CAST(least(19, floor(run/nullif(tot,0)/0.05)) AS BIGINT) AS bin, speed FROM dist WHERE tot > 0),
s AS (SELECT bin, count(*) AS n, avg(speed) AS mean, stddev_samp(speed) AS std, min(speed) AS lo, max(speed) AS hi FROM b GROUP BY bin)
SELECT bin, n, round(mean, 6) AS mean, round(std, 5) AS std, lo, hi, std > (SELECT avg(std) FROM s) AS inconsistent FROM s"""))
def agg_16(spark, sf):
    o = smooth.distance_along(trace(spark, sf).rekey(["session", "lap"]), "e", "n").where("frac is not null")
    d = o.df.withColumn("bin", F.least(F.lit(19).cast("long"), F.floor(F.col("frac") / 0.05)))
    s = d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("mean"), F.stddev_samp("speed").alias("std"), F.min("speed").alias("lo"), F.max("speed").alias("hi"))
    return s.select("bin", "n", r("mean").alias("mean"), r("std", 5).alias("std"), "lo", "hi", (F.col("std") > s.agg(F.avg("std")).scalar()).alias("inconsistent"))


@query("AGG-17", T(""", ideal AS (SELECT session, i % 16 AS p, max(speed) AS ideal FROM trace GROUP BY ALL)
SELECT tr.session, tr.lap, (i % 16) // 4 AS section, round(avg(speed - ideal), 6) AS deficit FROM trace tr JOIN ideal ON ideal.session = tr.session AND ideal.p = tr.i % 16 GROUP BY ALL HAVING avg(speed - ideal) < -5"""))
def agg_17(spark, sf):
    d = trace(spark, sf).df.withColumn("p", F.col("i") % 16)
    ideal = d.groupBy("session", "p").agg(F.max("speed").alias("ideal"))
    d = clean.salted_lookup(d, ideal, ["session", "p"], F.col(G)).withColumn("section", F.expr("p div 4"))
    return d.groupBy("session", "lap", "section").agg(F.avg(F.col("speed") - F.col("ideal")).alias("x")).where("x < -5").select(
        "session", "lap", "section", r("x").alias("deficit"))


@query("AGG-18", "SELECT l_orderkey AS race, l_suppkey AS driver, max(l_linenumber) AS stops, round(sum(l_quantity), 2) AS total_ms FROM lineitem GROUP BY 1, 2")
def agg_18(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("race"), F.col("l_suppkey").alias("driver")).agg(
        F.max("l_linenumber").alias("stops"), r(F.sum("l_quantity"), 2).alias("total_ms"))


@query("AGG-19", """WITH d AS (SELECT l_suppkey AS driver, l_linenumber AS place, l_returnflag AS flag, o_custkey AS team, year(o_orderdate) AS yr FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT driver, arg_max(team, (c, -team)) AS top_team FROM (SELECT driver, team, count(*) AS c FROM d WHERE place = 1 GROUP BY ALL) GROUP BY driver)
SELECT d.driver, count(CASE WHEN place = 1 THEN 1 END) AS wins, count(CASE WHEN flag = 'A' THEN 1 END) AS poles, min(CASE WHEN place = 1 THEN yr END) AS first_win, count(DISTINCT team) AS teams, any_value(top_team) AS top_team
FROM d LEFT JOIN m ON m.driver = d.driver GROUP BY d.driver""")
def agg_19(spark, sf):
    li, od = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    d = li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("driver"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("flag"), F.col("o_custkey").alias("team"), F.year("o_orderdate").cast("long").alias("yr"))
    win = F.col("place") == 1
    mode = d.where(win).groupBy("driver", "team").agg(F.count(F.lit(1)).alias("c")).groupBy("driver").agg(
        F.max_by("team", F.struct("c", -F.col("team"))).alias("top_team"))
    return d.groupBy("driver").agg(F.count(F.when(win, 1)).alias("wins"), F.count(F.when(F.col("flag") == "A", 1)).alias("poles"), F.min(F.when(win, F.col("yr"))).alias("first_win"),
                                   F.countDistinct("team").alias("teams")).join(mode, "driver", "left")


@query("AGG-20", T("""SELECT session, count(*) AS n, round(CASE WHEN count(*) < 20 THEN 0 ELSE regr_slope(speed, k) END, 6) AS slope, round(CASE WHEN count(*) < 20 THEN 0 ELSE regr_intercept(speed, k) END, 5) AS intercept,
round(CASE WHEN count(*) < 20 THEN 0 ELSE regr_r2(speed, k) END, 6) AS r2, round(corr(e, n), 6) AS corr_en FROM trace WHERE speed > 20 GROUP BY session"""))
def agg_20(spark, sf):
    ok = lambda c: F.when(F.count(F.lit(1)) < 20, 0.0).otherwise(c)
    return trace(spark, sf).df.where("speed > 20").groupBy("session").agg(
        F.count(F.lit(1)).alias("n"), r(ok(F.regr_slope("speed", "k"))).alias("slope"), r(ok(F.regr_intercept("speed", "k")), 5).alias("intercept"),
        r(ok(F.regr_r2("speed", "k"))).alias("r2"), r(stats.correlation("e", "n")).alias("corr_en"))


@query("AGG-21", """SELECT l_suppkey, round((sw*swxy - swx*swy)/(sw*swxx - swx*swx), 7) AS slope, round((swy - (sw*swxy - swx*swy)/(sw*swxx - swx*swx)*swx)/sw, 4) AS intercept,
round((sw*swxy - swx*swy)/sqrt((sw*swxx - swx*swx)*(sw*swyy - swy*swy)), 6) AS r, n FROM (SELECT l_suppkey, count(*) AS n, sum(w) sw, sum(w*x) swx, sum(w*y) swy, sum(w*x*x) swxx, sum(w*x*y) swxy, sum(w*y*y) swyy FROM
(SELECT l_suppkey, l_discount + 0.1 AS w, l_quantity AS x, l_extendedprice/1000 AS y FROM lineitem) GROUP BY 1)""")
def agg_21(spark, sf):
    d = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_discount") + 0.1).alias("w"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return stats.weighted_line(d, ["l_suppkey"], "x", "y", "w").select("l_suppkey", r("slope", 7).alias("slope"), r("intercept", 4).alias("intercept"), r("r").alias("r"), "n")


@query("AGG-22", T(""", c AS (SELECT session, lap, (i % 16) // 4 AS corner, min(speed) AS vmin, avg(e) AS line FROM trace GROUP BY ALL)
SELECT session, corner, count(*) AS laps, round(corr(vmin, lap), 6) AS trend, round(stddev_samp(vmin)/avg(vmin), 6) AS cv, round(stddev_samp(line), 6) AS line_std FROM c GROUP BY ALL"""))
def agg_22(spark, sf):
    c = trace(spark, sf).df.groupBy("session", "lap", F.expr("(i % 16) div 4").alias("corner")).agg(F.min("speed").alias("vmin"), F.avg("e").alias("line"))
    return c.groupBy("session", "corner").agg(F.count(F.lit(1)).alias("laps"), r(stats.correlation("vmin", "lap")).alias("trend"), r(F.stddev_samp("vmin") / F.nullif(F.avg("vmin"), F.lit(0.0))).alias("cv"), r(F.stddev_samp("line")).alias("line_std"))


@query("AGG-23", "SELECT o_orderpriority AS prompt, count(*) AS n, round(avg(o_totalprice), 4) AS mean_time, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1")
def agg_23(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("prompt")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("o_totalprice"), 4).alias("mean_time"), r(F.sum("o_totalprice"), 2).alias("cost"))


@query("AGG-24", """SELECT count(*) AS wins FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_suppkey = 7 AND year(o_orderdate) = 1997""")
def agg_24(spark, sf):
    docs = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.struct(F.col("l_linenumber").alias("place"), F.col("l_suppkey").alias("driver"), F.year("o_orderdate").alias("year")).alias("metadata"))
    return docs.where("metadata.place = 1 and metadata.driver = 7 and metadata.year = 1997").agg(F.count(F.lit(1)).alias("wins"))


@query("AGG-25", T(FGRID.format(m=9) + f""", x AS (SELECT session, grid, coalesce({LERP.format(p='pe', q='qe')}, pe, qe) AS e, coalesce({LERP.format(p='pn', q='qn')}, pn, qn) AS n FROM j)
SELECT session, grid, round(median(e), 5) AS e, round(median(n), 5) AS n FROM x GROUP BY ALL"""))
def agg_25(spark, sf):
    d = resample.fraction_grid(lap_fractions(spark, sf).df, ["session", "lap"], "frac", "event_id", ["e", "n"], 10)
    q = quantiles(d, ["session", "grid"], ["e", "n"], {"m": 0.5})
    return q.select("session", "grid", r("e_m", 5).alias("e"), r("n_m", 5).alias("n"))


@query("AGG-26", T(f""", d AS (SELECT session, k, t - lag(t){WS} AS dt FROM trace), b AS (SELECT *, CASE WHEN k > 0 AND k <= 20 THEN 'good' WHEN k > 20 AND k <= 60 THEN 'fair' WHEN k > 60 THEN 'poor' END AS band FROM d WHERE dt IS NOT NULL)
SELECT band, count(*) AS n, round(avg(dt), 5) AS mean_dt, round(median(dt), 5) AS median_dt FROM b WHERE band IS NOT NULL GROUP BY band"""))
def agg_26(spark, sf):
    o = trace(spark, sf).lag(pt="t").cols(dt=F.col("t") - F.col("pt")).where("dt is not null and k > 0")
    d = o.df.withColumn("band", F.when(F.col("k") <= 20, "good").when(F.col("k") <= 60, "fair").otherwise("poor"))
    return d.groupBy("band").agg(F.count(F.lit(1)).alias("n"), r(F.avg("dt"), 5).alias("mean_dt")).join(
        quantiles(d, ["band"], ["dt"], {"m": 0.5}), "band").select("band", "n", "mean_dt", r("dt_m", 5).alias("median_dt"))


@query("AGG-27", T(FGRID.format(m=9) + f""", x AS (SELECT session, grid, coalesce({LERP.format(p='pv', q='qv')}, pv, qv) AS v FROM j)
SELECT session, grid, round(avg(v), 6) AS mean, round(stddev_pop(v), 5) AS std, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM x GROUP BY ALL"""))
def agg_27(spark, sf):
    d = resample.fraction_grid(lap_fractions(spark, sf).df, ["session", "lap"], "frac", "event_id", ["speed"], 10)
    return d.groupBy("session", "grid").agg(r(F.avg("speed")).alias("mean"), r(F.stddev_pop("speed"), 5).alias("std"), r(F.min("speed")).alias("lo"), r(F.max("speed")).alias("hi"))


@query("AGG-28", T(""", rk AS (SELECT session, rank() OVER (PARTITION BY session ORDER BY speed) AS a, rank() OVER (PARTITION BY session ORDER BY k) AS b FROM trace)
SELECT session, round(corr(a, b), 6) AS spearman FROM rk GROUP BY session"""))
def agg_28(spark, sf):
    d = trace(spark, sf).df.select("session", "event_id", "speed", "k")
    d = stats.ranked(stats.ranked(d, ["session"], "speed", "event_id", "a"), ["session"], "k", "event_id", "b")
    return d.groupBy("session").agg(r(stats.correlation("a", "b")).alias("spearman"))


@query("AGG-28b", T(NEAR + """, x AS (SELECT session, CASE WHEN pt IS NOT NULL AND (qt IS NULL OR t - pt <= qt - t) THEN pt - t ELSE qt - t END AS err FROM j)
SELECT session, round(avg(CASE WHEN abs(err) <= 10000 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(median(CASE WHEN abs(err) <= 10000 THEN abs(err) END), 7) AS median_error FROM x GROUP BY session"""))
def agg_28b(spark, sf):
    """Share of events with a reference event within the tolerance, and their median timing error."""
    fast, slow = streams(spark, sf)
    d = aj.asof(fast, slow, ["session"], "t", "event_id", ["k"], "nearest").withColumn("err", F.abs(F.col("r_t") - F.col("t")))
    hit = d.withColumn("ok", F.when(F.col("err") <= 10000, F.col("err")))
    a = hit.groupBy("session").agg(r(F.count("ok") / F.count(F.lit(1))).alias("hit_rate"))
    return a.join(quantiles(hit, ["session"], ["ok"], {"m": 0.5}), "session").select("session", "hit_rate", r("ok_m", 7).alias("median_error"))


@query("AGG-29", """WITH w AS (SELECT user_id AS session, unnest([epoch_us(ts) // 43200000000 * 43200000000, epoch_us(ts) // 43200000000 * 43200000000 - 43200000000]) AS start_us FROM events)
SELECT session, start_us, count(*) AS n, round(count(*)/86400.0, 9) AS rate FROM w GROUP BY ALL""")
def agg_29(spark, sf):
    d = events(spark, sf).withColumn("ts", F.timestamp_micros("t_us"))
    return stats.sliding_rate(d, ["session"], "ts", "24 hours", "12 hours", 86400.0).select("session", "start_us", "n", r("rate", 9).alias("rate"))


@query("AGG-29b", T(f""", d AS (SELECT session, event_id, t - lag(t){WS} AS dt FROM trace), m AS (SELECT session, median(dt) AS md FROM d GROUP BY session)
SELECT session, event_id, round(dt, 6) AS gap FROM d JOIN m USING (session) WHERE dt > 3*md"""))
def agg_29b(spark, sf):
    return stats.signal_gaps(trace(spark, sf), "t", 3.0).select("session", "event_id", r("dt").alias("gap"))


@query("AGG-30", T(NEAR + f""", x AS (SELECT session, e, n, coalesce({LERP.format(p='pe', q='qe')}, pe, qe) AS e2, coalesce({LERP.format(p='pn', q='qn')}, pn, qn) AS n2 FROM j)
SELECT session, round(corr(e, e2), 6) AS corr_e, round(sqrt(avg(pow(e-e2, 2))), 5) AS rmse_e, round(corr(n, n2), 6) AS corr_n, round(sqrt(avg(pow(n-n2, 2))), 5) AS rmse_n FROM x GROUP BY session"""))
def agg_30(spark, sf):
    fast, slow = streams(spark, sf)
    d = aj.interpolate(fast.withColumnsRenamed({"e": "e1", "n": "n1"}), slow, ["session"], "t", "event_id", ["e", "n"])
    rmse = lambda a, b: r(F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2))), 5)
    return d.groupBy("session").agg(r(stats.correlation("e1", "e")).alias("corr_e"), rmse("e1", "e").alias("rmse_e"), r(stats.correlation("n1", "n")).alias("corr_n"), rmse("n1", "n").alias("rmse_n"))


@query("AGG-31", T("SELECT CAST(floor(e/10) AS BIGINT) AS cx, CAST(floor(n/10) AS BIGINT) AS cy, count(*) AS n FROM trace GROUP BY ALL"))
def agg_31(spark, sf):
    return stats.density(trace(spark, sf).df, "e", "n", 10.0)


@query("AGG-32", T(f""", s AS (SELECT *, e - lag(e){WS} AS de, n - lag(n){WS} AS dn FROM trace), u AS (SELECT session, speed, e, n, de/sqrt(de*de+dn*dn) AS ux, dn/sqrt(de*de+dn*dn) AS uy FROM s WHERE de*de+dn*dn > 0),
c AS (SELECT session, sqrt(pow(arg_max(e, i) - arg_min(e, i), 2) + pow(arg_max(n, i) - arg_min(n, i), 2)) AS closure FROM trace GROUP BY session)
SELECT u.session, count(*) AS n, round(avg(ux), 6) AS ux, round(avg(uy), 6) AS uy, round(avg(speed), 6) AS speed, round(any_value(closure), 6) AS closure FROM u JOIN c ON c.session = u.session
WHERE sqrt(pow(e-100,2)+pow(n-50,2)) <= 40 GROUP BY u.session"""))
def agg_32(spark, sf):
    o = trace(spark, sf).lag(pe="e", pn="n").cols(de=F.col("e") - F.col("pe"), dn=F.col("n") - F.col("pn"))
    ends = o.df.groupBy("session").agg(hypot(F.max_by("e", G) - F.min_by("e", G), F.max_by("n", G) - F.min_by("n", G)).alias("closure"))
    step = hypot("de", "dn")
    d = o.df.where(step > 0).where(hypot(F.col("e") - 100, F.col("n") - 50) <= 40)
    a = d.groupBy("session").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("de") / step)).alias("ux"), r(F.avg(F.col("dn") / step)).alias("uy"), r(F.avg("speed")).alias("speed"))
    return a.join(ends, "session").select("session", "n", "ux", "uy", "speed", r("closure").alias("closure"))
