"""Work that must stay whole and within bounds as tables grow."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lapforge.plans import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_conversations_are_whole_texts(spark, tmp_path):
    turns = 4100
    pq.write_table(pa.table({"conv_id": [7] * turns + [8], "turn": [*range(turns), 0], "role": ["a"] * (turns + 1),
                             "text": [f"line {i} " for i in range(turns)] + [" one "]}), tmp_path / "conversations.parquet")
    got = {row["title"]: row["text"] for row in QUERIES["TXT-02"](spark, str(tmp_path)).collect()}
    assert got == {"7": "\n".join(f"line {i} " for i in range(turns)).strip(), "8": "one"}


def test_packed_tables_are_not_broadcast(spark):
    """Sorted rows pack well: 600 000 rows below the threshold as files are far above it in memory."""
    from lapforge.operators.clean import salted_lookup
    from lapforge.session import by_key, fits_broadcast, written

    side = written(spark.range(600_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), (F.col("id") * 0.5).alias("x")), "side")
    small = written(side.limit(50), "side")
    assert not fits_broadcast(side) and fits_broadcast(small)
    rows = side.select("k", F.col("v").alias("w"))
    for joined in (rows.join(by_key(side), "k"), salted_lookup(rows, side, ["k"], F.col("w"), "inner", selective=True), salted_lookup(rows, side, ["k"], F.col("w"), "inner")):
        assert "BroadcastHashJoin" not in plan(joined) and joined.count() == 600_000
    assert "BroadcastHashJoin" in plan(rows.join(by_key(small), "k"))


def test_a_lookup_of_orders_is_not_repeated(spark, tmp_path, tiny_blocks):
    """No order has many rows, so none is salted and the orders are not copied."""
    n = 200
    pq.write_table(pa.table({"o_orderkey": range(n), "o_custkey": range(n), "o_totalprice": [1e5] * n}), tmp_path / "orders.parquet")
    pq.write_table(pa.table({"l_orderkey": [i // 2 for i in range(2 * n)], "l_linenumber": [i % 2 for i in range(2 * n)], "l_quantity": [1.0] * (2 * n),
                             "l_discount": [0.0] * (2 * n), "l_tax": [0.0] * (2 * n)}), tmp_path / "lineitem.parquet")
    got = QUERIES["PRJ-07"](spark, str(tmp_path))
    assert got.count() == 2 * n and "Generate" not in plan(got)


def test_shifts_are_taken_after_the_join(spark, tiny_blocks):
    from lapforge.operators import segment as sg

    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]
    rows = [(1, lap, (i + lap) % 4, *ring[i]) for lap in range(3) for i in range(4)] * 2
    d = spark.createDataFrame(rows, "key long, lap long, p long, x double, y double")
    got = sg.circular_shift(d, d.where("lap = 0").drop("lap"), ["key", "lap"], "p", "x", "y", 4, F.col("lap"))
    text = plan(got)
    assert text.index("Generate explode(_ref") < text.index("Join")
    assert {(r["lap"], r["shift"], r["err"]) for r in got.collect()} == {(0, 0, 0.0), (1, 3, 0.0), (2, 2, 0.0)}


def test_offsets_of_a_cell_are_one_array_operation(spark, monkeypatch):
    import numpy as np
    from lapforge.operators import lags

    t = [float(i) for i in range(40)]
    a = spark.createDataFrame([(1, i, x, x % 7) for i, x in enumerate(t)], "key long, i long, t double, a double")
    b = a.select("key", "i", "t", F.col("a").alias("b"))
    called = []
    monkeypatch.setattr(lags, "in_cells", lambda *args: a.limit(1))  # only the closure is wanted

    class Stop(Exception):
        pass

    def take(self, fn, schema):
        called.append(fn)
        raise Stop

    from pyspark.sql.group import GroupedData
    monkeypatch.setattr(GroupedData, "applyInArrow", take)
    monkeypatch.setattr(lags, "in_cells", lambda *args: a.withColumn("_cell", F.lit(0)))
    try:
        lags.offset_scores(a, b, ["key"], "t", "i", "a", "b", [k / 10 for k in range(-50, 51)], 5.0)
    except Stop:
        pass
    searches, plain = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *args: searches.append(1) or plain(*args))
    side = {"key": [1] * 40, "_t": t, "_tie": list(range(40)), "_v": [x % 7 for x in t]}
    table = pa.concat_tables([pa.table(side | {"_right": [flag] * 40}) for flag in (False, True)])
    got = called[0](table)
    assert got.num_rows == 101 and len(searches) == 1


def test_a_grid_moves_rows_not_ticks(spark):
    from lapforge.operators import lags, resample

    t = [0.0, 0.3, 0.3, 5.0, 5.05, 9.95]
    d = spark.createDataFrame([(1, i, x, x * 2 if i != 1 else 99.0) for i, x in enumerate(t)] + [(2, 9, 3.0, 1.0), (None, 8, None, 1.0)], "key long, i long, t double, v double")
    got = resample.uniform(d, ["key"], "t", "i", ["v"], 10.0)
    rows = sorted((r["key"], r["tick"], r["t"], r["v"]) for r in got.collect())
    assert [r[1] for r in rows] == list(range(100)) and all(abs(r[3] - 2 * r[2]) < 1e-9 for r in rows[3:])
    assert abs(rows[1][3] - 33) < 1e-9 and abs(rows[2][3] - 66) < 1e-9
    o = resample.uniform_ordered(d, ["key"], "t", "i", ["v"], 10.0)
    assert sorted(r["_g"] for r in o.df.collect()) == list(range(100))
    found = lags.local_lags(o, "tick", "v", "v", 40, 20, 20, least=10)
    assert sorted(r["win"] for r in found.collect()) == [0, 1, 2]
    text = plan(found)  # windows are dealt in groups, and ticks are neither ordered nor joined before
    assert "explode(sequence(FLOOR" in text or "_c#" in text


def test_a_fraction_grid_orders_rows_only(spark, tiny_blocks, monkeypatch):
    from lapforge.operators import resample

    seen, real = [], resample.ordered
    monkeypatch.setattr(resample, "ordered", lambda d, *a: (seen.append(d.count()), real(d, *a))[1])
    laps = {1: [(0.0, 5.0), (0.25, 7.0), (0.3, None), (0.6, 1.0), (1.0, 2.0)], 2: [(0.4, 3.0), (0.4, 9.0), (0.55, 4.0)], 3: [(None, 8.0), (0.5, 6.0)], 4: [(None, 2.0)]}
    rows = [(k, i, f, v) for k, lap in laps.items() for i, (f, v) in enumerate(lap)]
    d = resample.fraction_grid(spark.createDataFrame(rows, "lap long, i long, frac double, v double"), ["lap"], "frac", "i", ["v"], 5)
    assert d.columns == ["lap", "grid", "frac", "v"]
    got = sorted((r["lap"], r["grid"], r["frac"], r["v"]) for r in d.collect())
    assert [x[:3] for x in got] == [(k, g, g / 4) for k in laps for g in range(5)]
    want = [5, 7, None, 1 + 0.15 / 0.4, 2, 3, 3, 9 - 5 * (0.5 - 0.4) / (0.55 - 0.4), 4, 4, 8, 8, 6, 6, 6, 2, 2, 2, 2, 2]
    assert [None if x is None else round(x, 9) for *_, x in got] == [None if x is None else round(x, 9) for x in want]
    assert seen == [len(rows)]  # points were sorted in among the rows once


def test_windows_are_filled_from_rows(spark):
    """Rows, not their ticks, go to the windows; gaps of many blocks, equal times, nulls and lone rows included."""
    from lapforge.operators import lags, resample

    rng = random.Random(7)
    rows = [(k, i, t, rng.random(), None if i % 17 == 5 else rng.random()) for k in (1, 2) for i, t in enumerate(sorted(round(rng.uniform(0, 40), 1) for _ in range(120)))]
    rows += [(1, 500, 90.0, 0.3, 0.7), (3, 1, 5.0, 1.0, 1.0), (None, 2, 5.0, 1.0, 1.0), (None, 3, 25.0, 1.0, 1.0), (4, 4, None, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "key long, i long, t double, v double, u double")
    args = (["key"], "t", "i", ["v", "u"], 10.0)
    spark.conf.set("spark.lapforge.blockRows", "60")
    try:
        grid, o = resample.uniform_grid(d, *args), resample.uniform_ordered(d, *args)
        got = lags.local_lags(grid, "tick", "v", "u", 40, 20, 20, least=10)
        want = lags.local_lags(o, "tick", "v", "u", 40, 20, 20, least=10)
        key = lambda r: (r["key"], r["win"])
        a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    finally:
        spark.conf.unset("spark.lapforge.blockRows")
    assert repr(a) == repr(b) and len(a) > 40  # a window over a null is NaN in both
    assert "tick#" not in plan(got)  # rows go to the groups, no tick


def test_a_written_table_keeps_no_shuffle_files(spark):
    """Intermediate tables of one query add up on disk; the shuffles that made them must not."""
    import glob
    import time

    from lapforge.llm.lines import distinct_lines
    from lapforge.session import written

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(setting, "false"), files()
    d = written(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count(F.lit(1)).alias("n")), "counts")
    lines = distinct_lines(spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("one\n"), F.col("id").cast("string")).alias("text")))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(setting) == was
    assert d.count() == 700 and lines.count() == 51


def test_autocorrelation_is_taken_from_rows(spark):
    from lapforge.operators import lags, resample

    rng = random.Random(11)
    rows = [(k, i, t, None if i % 23 == 7 else rng.random()) for k in ("a", "b") for i, t in enumerate(sorted(round(rng.uniform(0, 30), 1) for _ in range(150)))]
    rows += [("c", 1, 5.0, 1.0), ("d", 2, 1.0, 3.0), ("d", 3, 9.0, 3.0), (None, 4, 2.0, 1.0), (None, 5, 9.0, 2.0)]
    args = (spark.createDataFrame(rows, "key string, i long, t double, v double"), ["key"], "t", "i", ["v"], 10.0)
    spark.conf.set("spark.lapforge.blockRows", "70")
    try:
        got = lags.autocorrelation(resample.uniform_grid(*args), "v", 5, 40)
        text = plan(got)
        got = {(r["key"], r["lag"]): r["score"] for r in got.collect()}
        want = {(r["key"], r["lag"]): r["score"] for r in lags.autocorrelation(resample.uniform_ordered(*args).cut(), "v", 5, 40).collect()}
    finally:
        spark.conf.unset("spark.lapforge.blockRows")
    assert got.keys() == want.keys() and len(got) >= 72 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert "tick#" not in text  # rows go to the calls, no tick


def test_race_markdown_writes_no_sentences(spark, tmp_path, monkeypatch):
    """Results meet the status list without a shuffle, and the table kept for both branches holds no text but names."""
    from lapforge.functions import status
    from lapforge.plans import files

    rows = spark.range(20).select(F.concat(F.lit("Engine"), F.col("id").cast("string")).alias("status"), "id")
    assert "Exchange hashpartitioning" not in plan(status.classify(rows, "status"))
    n = 30
    stamp = pa.array([1_500_000_000_000_000] * 3, pa.timestamp("us"))
    pq.write_table(pa.table({"o_orderkey": [1, 2, 3], "o_custkey": [1, 1, None], "o_orderdate": stamp}), tmp_path / "orders.parquet")
    pq.write_table(pa.table({"c_custkey": [1], "c_name": ["team"]}), tmp_path / "customer.parquet")
    pq.write_table(pa.table({"s_suppkey": [1, 2], "s_name": ["a", "b"]}), tmp_path / "supplier.parquet")
    pq.write_table(pa.table({"l_orderkey": [i % 3 + 1 for i in range(n)], "l_suppkey": [i % 2 + 1 for i in range(n)], "l_linenumber": [i % 7 + 1 for i in range(n)],
                             "l_partkey": list(range(n)), "l_extendedprice": [100.0 + i / 2 for i in range(n)], "l_quantity": [float(i) for i in range(n)],
                             "l_linestatus": ["F"] * n}), tmp_path / "lineitem.parquet")
    kept = []
    monkeypatch.setattr(files, "written", lambda d, *a: kept.append(d.columns) or d)
    got = {r["race"]: r["markdown"].split("\n") for r in QUERIES["SNK-05"](spark, str(tmp_path)).collect()}
    assert kept == [["race", "driver", "name", "place", "car", "price"]]
    assert set(got) == {1, 2} and all(len(v) == 12 for v in got.values())  # ten results, two standings
    assert all(v[-2].startswith("- Standing 1: ") for v in got.values())
