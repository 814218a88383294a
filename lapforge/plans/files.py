"""Sources and sinks. Inputs are files that Spark first writes from the given tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lapforge.plans.history import VERB_SQL, entries, with_outcome
from lapforge.plans.registry import query
from lapforge.plans.views import T, events, r, table, trace
from lapforge.session import new_path, shuffles_freed, written
from lapforge.sources import readers as rd
from lapforge.sources import writers as wr

SENSORS = {"click": "Location", "error": "Accelerometer", "purchase": "Gyroscope", "view": "Gravity"}


def sensor_files(spark, sf):
    """Write every recording's rows as sensor CSVs (a few clocks are not numbers) and scan them."""
    ev = events(spark, sf)
    sensor = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in SENSORS.items()], F.lit("Orientation"))
    clock = F.when(F.col("k") == 0, "n/a").otherwise((F.col("t_us") * 1000).cast("string"))
    out = ev.select(clock.alias("time"), F.col("speed").cast("string").alias("x"), (F.col("session") % 20).alias("recording"), sensor.alias("sensor"))
    path = new_path(spark, "csv")
    out.write.partitionBy("recording", "sensor").option("header", True).csv(path)
    return rd.sensor_csv(spark, path, "time long,x double")


CSV_SQL = """WITH s AS (SELECT CAST(user_id % 20 AS VARCHAR) AS recording, CASE event_type WHEN 'click' THEN 'Location' WHEN 'error' THEN 'Accelerometer' WHEN 'purchase' THEN 'Gyroscope' WHEN 'view' THEN 'Gravity' ELSE 'Orientation' END AS sensor,
CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) = 0 THEN NULL ELSE epoch_us(ts)*1000 END AS t FROM events) """


@query("SRC-01", CSV_SQL + """, c AS (SELECT recording, count(CASE WHEN sensor = 'Location' THEN 1 END) AS gps, count(CASE WHEN sensor = 'Accelerometer' THEN 1 END) AS imu, count(DISTINCT sensor) AS kinds, count(*) AS n FROM s GROUP BY recording)
SELECT recording, gps AS gps_rows, imu AS imu_rows, CAST(5 - kinds AS INTEGER) AS n_missing, kinds = 5 AND gps > 90 AND imu > 90 AS ok FROM c""")
def src_01(spark, sf):
    d = rd.inventory(sensor_files(spark, sf), min_gps=90, min_imu=90)
    return d.select("recording", F.col("Location").alias("gps_rows"), F.col("Accelerometer").alias("imu_rows"), F.size("missing").alias("n_missing"), "ok")


@query("SRC-02", """SELECT o_orderkey AS rec, s AS sensor, TRY_CAST(rate AS INTEGER) AS period FROM (SELECT o_orderkey, unnest(['Location', 'Gyroscope', 'Barometer']) AS s, unnest([CAST(o_custkey AS VARCHAR), 'x' || o_orderkey, CAST(o_orderkey % 100 AS VARCHAR)]) AS rate FROM orders)""")
def src_02(spark, sf):
    meta = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("rec"), F.lit("Location| Gyroscope|Barometer|").alias("sensors"),
        F.concat_ws("|", F.col("o_custkey").cast("string"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string")), (F.col("o_orderkey") % 100).cast("string")).alias("rates"))
    return meta.select("rec", F.explode(rd.sensor_rates(F.col("sensors"), F.col("rates")))).select("rec", F.col("key").alias("sensor"), F.col("value").alias("period"))


@query("SRC-03", CSV_SQL + "SELECT recording, min(t) AS t0_ns, max(t) AS t1_ns, round((max(t) - min(t))/1e9, 6) AS duration_s FROM s GROUP BY recording")
def src_03(spark, sf):
    return rd.time_span(sensor_files(spark, sf), ["recording"], "time").withColumn("duration_s", r("duration_s"))


def sheet_files(spark, sf):
    """One sheet per order: flat for odd keys, nested for even ones."""
    o = table(spark, sf, "orders")
    day, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    laps = F.array(F.col("o_totalprice") / 1000, F.col("o_totalprice") / 990, F.col("o_totalprice") / 1010)
    name = F.concat(F.lit("D"), F.col("o_custkey").cast("string"))
    flat = F.to_json(F.struct(day.alias("date"), F.lit("2:40 PM").alias("time"), F.col("o_orderpriority").alias("event"), F.lit("ring").alias("track"), name.alias("driver"),
                              F.transform(laps, lambda x, i: F.struct((i + 1).alias("lap"), x.alias("time"))).alias("lapTimes")))
    nested = F.to_json(F.struct(
        F.struct(day.alias("date"), F.lit("15:00").alias("time"), F.when(key % 4 == 0, "Race").otherwise("Practice").alias("type"), F.lit("ring").alias("track"), name.alias("driver")).alias("session"),
        F.transform(laps, lambda x: F.struct(x.alias("time_seconds"))).alias("laps"), F.struct(F.when(key % 6 == 0, 1.5).alias("best_lap_seconds")).alias("results")))
    path = new_path(spark, "sheets")
    o.select(F.when(key % 2 == 1, flat).otherwise(nested).alias("value")).write.text(path)
    return rd.timing_sheets(spark, path)


@query("SRC-04", """SELECT CASE WHEN o_orderkey % 2 = 1 THEN 'flat' ELSE 'nested' END AS schema, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 1 THEN '_14-40' ELSE '_15-00' END AS session_key, 'D' || o_custkey AS driver,
round(CASE WHEN o_orderkey % 6 = 0 THEN 1.5 ELSE o_totalprice/1010 END, 6) AS best_lap, round((o_totalprice/1000 + o_totalprice/990 + o_totalprice/1010)/3, 3) AS avg_lap, 3 AS total_laps, CASE WHEN o_orderkey % 4 = 0 THEN 'average' ELSE 'best' END AS ranking_metric FROM orders""")
def src_04(spark, sf):
    return sheet_files(spark, sf).select("schema", "session_key", "driver", r("best_lap").alias("best_lap"), r("avg_lap", 3).alias("avg_lap"), "total_laps", "ranking_metric")


@query("SRC-05", "SELECT 's' || s_suppkey AS id, s_name AS name, s_acctbal/100 AS lon, s_suppkey*0.25 AS lat FROM supplier WHERE s_suppkey % 3 = 0".replace("s_suppkey*0.25", "CAST(s_suppkey*0.25 AS DOUBLE)"))
def src_05(spark, sf):
    """Feature collections written one per row, exploded, then looked up by role."""
    s = table(spark, sf, "supplier")
    f = F.struct(F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "gate").otherwise("corner").alias("role"), F.col("s_name").alias("name")).alias("properties"),
                 F.struct(F.lit("Point").alias("type"), F.array(F.col("s_acctbal") / 100, F.col("s_suppkey") * 0.25).alias("coordinates")).alias("geometry"))
    path = new_path(spark, "geo")
    s.select(F.array(f).alias("features")).write.json(path)
    return rd.venue_features(spark, path).where("role = 'gate'").select("id", "name", "lon", "lat")


@query("SRC-06", T("""SELECT event_id, round(lat, 8) AS lat, round(lon, 8) AS lon, CASE WHEN k % 7 = 0 THEN NULL ELSE speed END AS speed FROM trace WHERE k % 11 <> 0 AND k % 13 <> 0"""))
def src_06(spark, sf):
    """String log with broken lines (k % 13) and fixes at (0, 0) (k % 11)."""
    d = trace(spark, sf).df
    zero = F.col("k") % 11 == 0
    pos = lambda c: F.when(zero, "0").otherwise(r(c, 8).cast("string"))
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), pos("lat").alias("lat"), pos("lon").alias("lon"),
                              F.when(F.col("k") % 7 == 0, "-").otherwise(F.col("speed").cast("string")).alias("speed")))
    path = new_path(spark, "log")
    d.select(F.when(F.col("k") % 13 == 0, F.concat(F.substring(line, 1, 10), F.lit("{"))).otherwise(line).alias("value")).write.text(path)
    out = rd.phone_log(spark, path, {"event_id": "bigint", "lat": "double", "lon": "double", "speed": "double"}, "lat", "lon")
    return out.select("event_id", r("lat", 8).alias("lat"), r("lon", 8).alias("lon"), "speed")


@query("SRC-07", "SELECT kind, p_partkey, p_brand, p_retailprice FROM part, (SELECT unnest(['csv', 'json', 'parquet']) AS kind)")
def src_07(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    out = None
    for kind in ("csv", "json", "parquet"):
        path = f"{new_path(spark, 'any')}.{kind}"
        d.write.format(kind).option("header", True).save(path)
        one = rd.by_extension(spark, path, "p_partkey long, p_brand string, p_retailprice double").withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.select("kind", "p_partkey", "p_brand", "p_retailprice")


@query("SRC-08", """SELECT user_id AS session, event_id, value AS speed, NULL::BIGINT AS k, 1 AS race, 1 AS visit FROM events WHERE event_type = 'click' UNION ALL
SELECT user_id, event_id, NULL, CAST(json_extract(props, '$.k') AS BIGINT), 2, 1 FROM events WHERE event_type = 'error'""")
def src_08(spark, sf):
    ev = events(spark, sf)
    tables = {"a": ev.where("kind = 'click'").select("session", "event_id", "speed"), "b": ev.where("kind = 'error'").select("session", "event_id", "k"), "debug": ev.select("session")}
    return rd.union_recordings(tables, {"a": {"race": 1, "visit": 1}, "b": {"race": 2, "visit": 1}, "debug": {}}, skip=["debug"])


@query("SRC-09", """SELECT o_orderkey AS run, o_custkey AS usage_prompt, o_totalprice AS usage_cost, CASE WHEN o_orderkey % 5 <> 0 THEN 'r' || o_orderkey END AS answer, o_orderkey % 5 <> 0 AS valid_json FROM orders""")
def src_09(spark, sf):
    o = table(spark, sf, "orders")
    good = F.to_json(F.struct(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("answer")))
    path = new_path(spark, "results")
    o.select(F.col("o_orderkey").alias("run"), F.struct(F.col("o_custkey").alias("prompt"), F.col("o_totalprice").alias("cost")).alias("usage"),
             F.when(F.col("o_orderkey") % 5 == 0, "not json").otherwise(good).alias("body")).write.json(path)
    return rd.result_files(spark, path, "run long, usage struct<prompt:long,cost:double>, body string", ["prompt", "cost"], "body", "answer string")


# ---------------------------------------------------------------- sinks
@query("SNK-01", T("SELECT session, count(*) AS n, round(sum(speed), 4) AS total, round(sum(e), 4) AS e_sum FROM trace GROUP BY session"))
def snk_01(spark, sf):
    """Partitioned Parquet and CSV of the aligned trace, read back and compared per session."""
    d = trace(spark, sf).df.select((F.col("session") % 5).alias("venue"), "session", "i", "t_us", "speed", "e", "n")
    pq, csv = new_path(spark, "dataset"), new_path(spark, "dataset-csv")
    wr.session_dataset(d, pq, ["venue"], ["session", "i"], csv)
    a = spark.read.parquet(pq).groupBy("session").agg(F.count(F.lit(1)).alias("n"), r(F.sum("speed"), 4).alias("total"))
    b = spark.read.schema("session long, i long, t_us long, speed double, e double, n double, venue long").option("header", True).csv(csv)
    return a.join(b.groupBy("session").agg(r(F.sum("e"), 4).alias("e_sum")), "session")


@query("SNK-02", "SELECT doc_id, lang, length(text) AS chars FROM documents")
def snk_02(spark, sf):
    path = new_path(spark, "jsonl")
    wr.json_lines(table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    return spark.read.schema("doc_id long, lang string, text string").json(path).select("doc_id", "lang", F.length("text").cast("long").alias("chars"))


@query("SNK-03", T("""SELECT t_us // 1000 AS time_ms, round(lat, 7) AS lat, round(lon, 7) AS lon, round(speed*2.2369362920544, 3) AS speed_mph, lap AS trip_id, 'sample' AS kind FROM trace
UNION ALL SELECT NULL, s_acctbal/100, s_suppkey/10.0, NULL, NULL, 'poi' FROM supplier"""))
def snk_03(spark, sf):
    poi = table(spark, sf, "supplier").select((F.col("s_acctbal") / 100).alias("lat"), (F.col("s_suppkey") / 10.0).alias("lon"))
    d = trace(spark, sf).df.withColumns({"lat": r("lat", 7), "lon": r("lon", 7)})
    path = new_path(spark, "trips")
    out = wr.trip_export(d, poi, "t_us", F.col("lap"))
    out.write.option("header", True).csv(path)
    return spark.read.schema(out.schema).option("header", True).csv(path)


@query("SNK-04", "SELECT o_orderpriority AS race, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def snk_04(spark, sf):
    """All races written by one job, one folder each, then read as one table."""
    d = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("race"), "o_orderkey", "o_totalprice")
    path = new_path(spark, "races")
    wr.session_dataset(d, path, ["race"], ["o_orderkey"])
    return spark.read.parquet(path).groupBy("race").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("SNK-05", VERB_SQL + """, dr AS (SELECT race, driver, any_value(name) AS name, min(place) AS best FROM vt GROUP BY ALL), sd AS (SELECT race, name, row_number() OVER (PARTITION BY race ORDER BY best, driver) AS rk FROM dr QUALIFY rk <= 3),
l AS (SELECT race, CASE WHEN grp IN ('finished', 'lapped') THEN 0 ELSE 1 END AS s, place AS p, car, driver, price, '- ' || outcome AS line FROM vt UNION ALL SELECT race, 2, rk, NULL, NULL, NULL, '- Standing ' || rk || ': ' || name FROM sd)
SELECT race, 0::BIGINT AS part, string_agg(line, chr(10) ORDER BY s, p, car, driver, price) AS markdown FROM l GROUP BY race""")
def snk_05(spark, sf):
    d = written(entries(spark, sf).select("race", "driver", "name", "place", "car", "price"), "results")
    d = with_outcome(d)  # sentences are made where they are read
    w = Window.partitionBy("race").orderBy("best", "driver")
    top = d.groupBy("race", "driver", "name").agg(F.min("place").alias("best")).withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    md = wr.race_markdown(d, "race", "place", ["car", "driver", "price"], F.col("finished_flag"), F.col("outcome"), top)
    path = new_path(spark, "md")
    with shuffles_freed(spark):
        md.write.option("compression", "gzip").json(path)
    return spark.read.schema(md.schema).json(path)


@query("TXT-02", """SELECT conv_id::VARCHAR AS title, trim(string_agg(text, chr(10) ORDER BY turn), chr(10) || ' ') AS text FROM conversations GROUP BY conv_id""")
def txt_02(spark, sf):
    """Conversations written as text files and read whole; title and place in the text come from the folder names."""
    path = new_path(spark, "texts")
    wr.text_files(table(spark, sf, "conversations"), path, "conv_id", "turn", "text")
    return wr.whole_texts(wr.titled_texts(spark, path, r"doc=([^/]+)", r"part=(-?[0-9]+)", trim=False))
