"""Race history documents, text and retrieval over the star tables and the corpus."""

from pyspark.sql import functions as F

from lapforge.functions import status as st
from lapforge.functions import text as tx
from lapforge.operators import documents as dc
from lapforge.operators import retrieve as rt
from lapforge.operators.ordered import G, ordered
from lapforge.plans.registry import query
from lapforge.plans.views import r, table
from lapforge.session import written

NAMES = [x[0] for x in st.rows()] + ["+1 Lap", "+2 Laps", "Unknown cause"]


def _list(names):
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def _case(i, default="other"):
    by = {}
    for row in st.rows():
        by.setdefault(row[i], []).append(row[0])
    return "CASE " + " ".join(f"WHEN status IN ({_list(v)}) THEN '{k}'" for k, v in by.items()) + f" WHEN status LIKE '+%' THEN 'lapped' ELSE '{default}' END"


# A result row: race = order, driver = supplier, place = line number; status drawn from the part key.
RES_SQL = f"""WITH res0 AS (SELECT l_orderkey AS race, l_suppkey AS driver, l_linenumber AS place, l_partkey AS car, l_extendedprice AS price, l_quantity AS qty, l_linestatus AS ls,
([{_list(NAMES)}])[1 + l_partkey % {len(NAMES)}] AS status FROM lineitem), res AS (SELECT *, {_case(1)} AS grp, {_case(2)} AS fam, {_case(3)} AS sub FROM res0) """


def lineups(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("race"), F.col("l_suppkey").alias("driver"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("car"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), F.col("l_linestatus").alias("ls"))


def classified(d):
    names = F.array(*[F.lit(n) for n in NAMES])
    return st.classify(d.withColumn("status", F.get(names, (F.col("car") % len(NAMES)).cast("int"))), "status")


def results(spark, sf):
    return classified(lineups(spark, sf))


@query("SCA-07", RES_SQL + "SELECT race, driver, place, car, price, status, grp AS status_group, fam AS status_family, sub AS status_subfamily, grp IN ('finished', 'lapped') AS finished_flag, grp NOT IN ('finished', 'lapped') AS dnf_flag FROM res")
def sca_07(spark, sf):
    return results(spark, sf).drop("qty", "ls")


# ---------------------------------------------------------------- text
@query("TXT-01", r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS inner_ FROM pages),
p AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(split_part(cell, '</p>', 1), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS para
FROM (SELECT page_id, unnest(regexp_split_to_array(inner_, '<p[^>]*>')[2:]) AS cell, generate_subscripts(regexp_split_to_array(inner_, '<p[^>]*>')[2:], 1) AS i FROM a))
SELECT a.page_id, coalesce(string_agg(para, chr(10) || chr(10) ORDER BY i) FILTER (WHERE para <> '' AND NOT starts_with(para, 'Advert |')), '') AS content FROM a LEFT JOIN p ON p.page_id = a.page_id GROUP BY a.page_id""")
def txt_01(spark, sf):
    return table(spark, sf, "pages").select("page_id", dc.main_text(F.col("html")).alias("content"))


@query("TXT-03", """WITH u AS (SELECT url AS line, page_id FROM pages)
SELECT page_id, trim(substr(line, 1, instr(line, ':') - 1)) AS term, trim(substr(line, instr(line, ':') + 1)) AS definition FROM u WHERE instr(line, ':') > 0""")
def txt_03(spark, sf):
    term, definition = dc.glossary(F.col("url"))
    return table(spark, sf, "pages").select("page_id", term.alias("term"), definition.alias("definition")).where("term is not null")


@query("TXT-04", """WITH s AS (SELECT conv_id, turn, turn*37.5 AS start, text, row_number() OVER w - 1 AS pos, sum(strlen(text) + 1) OVER w - strlen(text) - 1 AS place FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, pos // 4096 AS part, CAST(min(place) AS BIGINT) AS "offset", string_agg(text, ' ' ORDER BY start, turn) AS full_text, string_agg(format('[{:02d}:{:02d}] ', CAST(floor(start) AS BIGINT)//60, CAST(floor(start) AS BIGINT) % 60) || text, chr(10) ORDER BY start, turn) AS clock_text FROM s GROUP BY conv_id, pos // 4096""")
def txt_04(spark, sf):
    s = table(spark, sf, "conversations").withColumn("start", F.col("turn") * 37.5)
    return dc.stitched(s, ["conv_id"], "start", "turn", "text")


@query("TXT-04b", r"""SELECT page_id, nullif(regexp_extract(u, '(?:v=|/)([0-9A-Za-z_-]{11})', 1), '') AS video FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://y.example/watch?v=' || lpad(page_id::VARCHAR, 11, 'x') ELSE 'https://y/ab' END AS u FROM pages)""")
def txt_04b(spark, sf):
    pid = F.col("page_id")
    u = F.when(pid % 2 == 0, F.concat(F.lit("https://y.example/watch?v="), F.lpad(pid.cast("string"), 11, "x"))).otherwise("https://y/ab")
    return table(spark, sf, "pages").select("page_id", dc.video_id(u).alias("video"))


OUTCOME_SQL = """CASE WHEN fin THEN name || CASE WHEN grp = 'finished' THEN ' finished P' || place || pod || ' ' WHEN grp = 'lapped' THEN ' was classified P' || place || pod || ', laps down, ' ELSE ' was classified P' || place || pod || ' with status ' || status || ' ' END
ELSE name || ' ' || CASE grp WHEN 'crash' THEN 'retired after an incident (' || status || ')' WHEN 'mechanical' THEN 'retired with a ' || lower(status) || ' issue' WHEN 'fuel' THEN 'retired with a fuel problem (' || status || ')'
WHEN 'health' THEN 'did not complete the race: ' || lower(status) WHEN 'admin' THEN 'was not classified (' || status || ')' ELSE 'did not finish (' || status || ')' END || ' ' END || 'for ' || pts || ' points.'"""
VERB_SQL = RES_SQL + f""", v AS (SELECT race, car, price, driver, place, year(o_orderdate) AS yr, s_name AS name, c_name AS team, CAST(qty AS BIGINT) AS q, ls, grp, status, price % 2 < 1.2 AS fin, CASE WHEN place <= 3 THEN ' on the podium' ELSE '' END AS pod,
greatest(0, 8 - place) AS pts, CAST(round(price*100) AS BIGINT) AS ms FROM res JOIN orders ON o_orderkey = race JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = driver),
vt AS (SELECT *, {OUTCOME_SQL} AS outcome FROM v) """


def entries(spark, sf):
    """Line-ups with year, team and driver name; the smaller tables meet first, and texts are left for later."""
    d = lineups(spark, sf)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("race"), "o_custkey", F.year("o_orderdate").alias("yr"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("team"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("driver"), F.col("s_name").alias("name"))
    return d.join(s, "driver").join(o.join(c, "o_custkey"), "race")


def with_outcome(d):
    d = classified(d)
    place = F.when(F.col("price") % 2 < 1.2, F.col("place").cast("string")).otherwise("R")
    pts = F.greatest(F.lit(0), 8 - F.col("place"))
    return d.withColumns({"pts": pts, "outcome": dc.outcome_text(F.col("name"), place, pts, F.col("status"), F.col("status_group"))})


def verbose(spark, sf):
    ms = F.round(F.col("price") * 100).cast("long")
    return with_outcome(entries(spark, sf)).withColumns({"q": F.col("qty").cast("long"), "ms": ms})


@query("TXT-05", VERB_SQL + """SELECT race, driver, place, car, price, 'In the ' || yr || ' race ' || race || ', ' || name || ' drove for ' || team || ', started ' || CASE WHEN q % 7 = 0 THEN 'from an unclassified position' ELSE 'from P' || (q % 7) END || ', and ' ||
CASE WHEN q > 1 THEN 'completed ' || q || ' laps' ELSE 'completed no full lap' END || CASE WHEN ls = 'F' THEN ' in ' || format('{}h {}m {}s', ms//3600000, (ms//60000) % 60, (ms//1000) % 60) ELSE '' END || '. ' || outcome || ' ' ||
CASE WHEN car % 3 = 0 THEN 'Fastest lap ' || format('{}:{:02d}.{:03d}', (60000 + car)//60000, ((60000 + car)//1000) % 60, (60000 + car) % 1000) || '.' ELSE 'No fastest lap recorded.' END AS text FROM vt""")
def txt_05(spark, sf):
    d = verbose(spark, sf)
    total = F.when(F.col("ls") == "F", tx.duration_text(F.col("ms")))
    fastest = F.when(F.col("car") % 3 == 0, tx.lap_text((60000 + F.col("car")) / 1000.0))
    laps = F.when(F.col("q") > 1, F.col("q")).otherwise(F.lit(0))
    t = dc.result_text(F.col("yr"), F.concat(F.lit("race "), F.col("race").cast("string")), F.col("name"), F.col("team"), F.col("q") % 7, laps, total, fastest, F.col("outcome"))
    return d.select("race", "driver", "place", "car", "price", t.alias("text"))


ORD = "ORDER BY place, car, driver, price"


@query("TXT-06", VERB_SQL + f""", n AS (SELECT *, row_number() OVER (PARTITION BY race {ORD}) AS pos FROM vt)
SELECT race, 0::BIGINT AS part, string_agg(name, ', ' ORDER BY pos) FILTER (WHERE pos <= 3) AS podium, string_agg(outcome, ' ' ORDER BY pos) AS classification, count(CASE WHEN grp = 'crash' THEN 1 END) AS crashes,
count(CASE WHEN grp = 'mechanical' THEN 1 END) AS mechanical, count(CASE WHEN grp NOT IN ('finished', 'lapped') THEN 1 END) AS retirements FROM n GROUP BY race""")
def txt_06(spark, sf):
    d = verbose(spark, sf)
    facts = {"crashes": F.count(F.when(F.col("status_group") == "crash", 1)), "mechanical": F.count(F.when(F.col("status_group") == "mechanical", 1)),
             "retirements": F.count(F.when(F.col("dnf_flag"), 1))}
    a = dc.assemble(d, ["race"], ["place", "car", "driver", "price"], F.struct("name", "outcome"), facts, head=3)
    podium = F.array_join(F.transform("head", lambda x: x["name"]), ", ")
    return a.select("race", "part", podium.alias("podium"), F.array_join(F.transform("items", lambda x: x["outcome"]), " ").alias("classification"), *facts)


@query("TXT-07", VERB_SQL + f""", n AS (SELECT *, row_number() OVER (PARTITION BY race {ORD}) AS pos FROM vt)
SELECT race, 0::BIGINT AS part, yr AS season, max(CASE WHEN pos = 1 THEN name END) AS winner, string_agg(name, ', ' ORDER BY pos) FILTER (WHERE pos <= 3) AS podium, count(*) AS entries, string_agg(pos || '|' || name || '|' || team || '|' || status || '|' || pts, ';' ORDER BY pos) AS results FROM n GROUP BY race, yr""")
def txt_07(spark, sf):
    """Race bundle: winner, podium array and the ordered results (structs joined as text here)."""
    d = verbose(spark, sf)
    item = F.struct("name", "team", "status", "pts")
    b = dc.assemble(d, ["race", "yr"], ["place", "car", "driver", "price"], item, {"entries": F.count(F.lit(1))}, head=3)
    line = F.transform("items", lambda x, i: F.concat_ws("|", (F.col("first") + i + 1).cast("string"), x["name"], x["team"], x["status"], x["pts"].cast("string")))
    return b.select("race", "part", F.col("yr").cast("long").alias("season"), F.get("head", F.lit(0))["name"].alias("winner"),
                    F.array_join(F.transform("head", lambda x: x["name"]), ", ").alias("podium"), "entries", F.array_join(line, ";").alias("results"))


STAND = """, pr AS (SELECT driver, any_value(name) AS name, yr, mo, CAST(sum(pts) AS BIGINT) AS pts, count(CASE WHEN place = 1 THEN 1 END) AS wins FROM (SELECT vt.*, month(o_orderdate) AS mo FROM vt JOIN orders ON o_orderkey = race) GROUP BY driver, yr, mo),
cu AS (SELECT *, CAST(sum(pts) OVER (PARTITION BY driver, yr ORDER BY mo) AS BIGINT) AS total, CAST(sum(wins) OVER (PARTITION BY driver, yr ORDER BY mo) AS BIGINT) AS won FROM pr), rk AS (SELECT *, row_number() OVER (PARTITION BY yr, mo ORDER BY total DESC, driver) AS pos FROM cu) """


@query("TXT-08", VERB_SQL + STAND + """SELECT driver, yr AS season, mo AS round, pos, 'After the ' || yr || ' round ' || mo || ', ' || name || ' is ' || pos || CASE WHEN pos % 100 BETWEEN 11 AND 13 THEN 'th' WHEN pos % 10 = 1 THEN 'st' WHEN pos % 10 = 2 THEN 'nd' WHEN pos % 10 = 3 THEN 'rd' ELSE 'th' END
|| ' with ' || total || ' points and ' || won || ' wins.' AS text FROM rk""")
def txt_08(spark, sf):
    """Season standings after each month, as text."""
    when = table(spark, sf, "orders").select(F.col("o_orderkey").alias("race"), F.month("o_orderdate").alias("mo"))
    d = verbose(spark, sf).join(when, "race")
    p = d.groupBy("driver", "name", "yr", "mo").agg(F.sum("pts").alias("p"), F.count(F.when(F.col("place") == 1, 1)).alias("w"))
    c = ordered(p, ["driver", "yr"], ["mo"]).running(total=("sum", "p"), won=("sum", "w"))
    k = ordered(c.df.drop(G), ["yr", "mo"], [F.desc("total"), F.col("driver")]).position("_i")
    d = k.df.withColumn("pos", F.col("_i") + 1)
    t = dc.standing_text(F.col("yr"), F.concat(F.lit("round "), F.col("mo").cast("string")), F.col("name"), F.col("pos"), F.col("total"), F.col("won"))
    return d.select("driver", F.col("yr").cast("long").alias("season"), F.col("mo").cast("long").alias("round"), "pos", t.alias("text"))


@query("TXT-09", r"""SELECT doc_id, 'text' AS doc_type, nullif(concat_ws('; ', 'lang: ' || lang, CASE WHEN doc_id % 4 <> 0 THEN 'source: ' || source END, CASE WHEN quality IS NOT NULL THEN 'quality: ' || quality END), '') AS entities,
CASE WHEN doc_id % 4 <> 0 THEN source END AS meta_source, n_chars AS meta_chars FROM (SELECT d.*, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))""")
def txt_09(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    src = F.when(F.col("doc_id") % 4 == 0, "\\N").otherwise(F.col("source"))
    meta = F.struct(F.nullif(src, F.lit("\\N")).alias("source"), F.col("n_chars").alias("chars"))
    shaped = d.select("doc_id", F.lit("text").alias("doc_type"), dc.entities(lang=F.col("lang"), source=src, quality=F.col("quality")).alias("entities"), meta.alias("metadata"))
    return shaped.select("doc_id", "doc_type", "entities", F.col("metadata.source").alias("meta_source"), F.col("metadata.chars").alias("meta_chars"))


# ---------------------------------------------------------------- retrieval
def _bm(field, boost, name):
    return f"""{name}_t AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(lower({field}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ts FROM docs),
{name}_s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {name}_t), {name}_f AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM {name}_t) GROUP BY ALL),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_f GROUP BY term),
{name} AS (SELECT q.query, f.doc, {boost}*round(sum(q.qtf*ln(1 + (s.n - d.df + 0.5)/(d.df + 0.5))*f.tf/(f.tf + 1.2*(0.25 + 0.75*f.dl/s.avgdl))), 9) AS score FROM qt q JOIN {name}_f f ON f.term = q.term JOIN {name}_d d ON d.term = q.term, {name}_s s GROUP BY ALL)"""


LEX_SQL = """WITH docs AS (SELECT *, split_part(text, '.', 1) AS entities FROM documents),
qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL), """ + _bm("text", "1.0", "bt") + ", " + _bm("entities", "5.0", "be") + """,
lex AS (SELECT query, doc, max(score) AS score FROM (SELECT * FROM bt UNION ALL SELECT * FROM be) GROUP BY ALL), lexk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rk FROM lex QUALIFY rk <= 10) """


def lex_hits(spark, sf, k=10):
    docs = table(spark, sf, "documents").withColumn("entities", F.split_part("text", F.lit("."), F.lit(1)))
    return written(rt.lexical_top(docs, table(spark, sf, "benchmark"), "doc_id", {"text": 1.0, "entities": 5.0}, "item_id", "text", k), "hits")


@query("RET-01", LEX_SQL + "SELECT query, doc, round(score, 6) AS score, CAST(rk AS INTEGER) AS \"rank\" FROM lexk")
def ret_01(spark, sf):
    return lex_hits(spark, sf).select("query", "doc", r("score").alias("score"), "rank")


VEC_SQL = """, qv AS (SELECT b.item_id AS query, CAST(embedding AS DOUBLE[]) AS v FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id), vec AS (SELECT query, vec_id AS doc, round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 9) AS score FROM qv, embeddings),
veck AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rk FROM vec QUALIFY rk <= 10) """


def vec_hits(spark, sf, k=10):
    """Each benchmark item is asked with the stored vector of the same number."""
    e = table(spark, sf, "embeddings")
    q = table(spark, sf, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query"), F.col("embedding").alias("qv"))
    return written(rt.knn(e, q, "vec_id", "embedding", "query", "qv", k), "hits")


@query("RET-02", "WITH one AS (SELECT 1)" + VEC_SQL + "SELECT query, doc, round(score, 6) AS score, CAST(rk AS INTEGER) AS \"rank\" FROM veck")
def ret_02(spark, sf):
    return vec_hits(spark, sf).select("query", "doc", r("score").alias("score"), "rank")


HYB_SQL = LEX_SQL + VEC_SQL + """, a AS (SELECT query, doc, coalesce((score - min(score) OVER w)/nullif(max(score) OVER w - min(score) OVER w, 0), 1.0) AS s FROM lexk WINDOW w AS (PARTITION BY query)),
b AS (SELECT query, doc, coalesce((score - min(score) OVER w)/nullif(max(score) OVER w - min(score) OVER w, 0), 1.0) AS s FROM veck WINDOW w AS (PARTITION BY query)),
h AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.doc, b.doc) AS doc, (0.5*coalesce(a.s, 0) + 0.5*coalesce(b.s, 0)) AS score FROM a FULL JOIN b ON a.query = b.query AND a.doc = b.doc),
hk AS (SELECT h.*, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rk FROM h JOIN labels l ON l.doc_id = h.doc AND quality = 1 QUALIFY rk <= 5) """


def hybrid_hits(spark, sf):
    s = rt.hybrid(lex_hits(spark, sf), vec_hits(spark, sf))
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("doc"))
    return rt.top_k(s.join(good, "doc", "left_semi"), 5)


@query("RET-03", HYB_SQL + "SELECT query, doc, round(score, 6) AS score, CAST(rk AS INTEGER) AS \"rank\" FROM hk")
def ret_03(spark, sf):
    return hybrid_hits(spark, sf).select("query", "doc", r("score").alias("score"), "rank")


@query("RET-04", "SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang = 'en' AND source = 'src1'")
def ret_04(spark, sf):
    d = table(spark, sf, "documents").withColumn("entities", F.concat(dc.entities(lang=F.col("lang"), source=F.col("source")), F.lit(";")))
    return d.where(rt.entity_filter("entities", ["lang: en;", "source: src1;"])).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("RET-05", HYB_SQL + """SELECT query, 0::BIGINT AS part, string_agg('Document ' || rk || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY rk) AS context FROM hk JOIN documents d ON d.doc_id = hk.doc GROUP BY query""")
def ret_05(spark, sf):
    return rt.context(hybrid_hits(spark, sf), table(spark, sf, "documents"), "doc_id", "text")
