"""Ordered blocks: a hot key split over many blocks gives the same answers as one pass."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapforge.operators import clean, smooth
from lapforge.operators.asof import asof, interpolate
from lapforge.operators.cluster import components, density_clusters
from lapforge.operators.match import greedy_assign
from lapforge.operators.ordered import ordered, quantiles
from lapforge.operators.segment import debounce, impacts, ordered_gates, radius_laps


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for key, n in ((1, 40), (2, 1), (3, 5)):  # key 1 holds most rows
        t = 0.0
        for i in range(n):
            t += rng.choice([0.5, 1.0, 7.0])
            out.append((key, i, t, float(rng.randint(0, 9)), rng.choice([None, 1, 2])))
    rng.shuffle(out)
    return pd.DataFrame(out, columns=["key", "i", "t", "v", "mark"])


@pytest.fixture
def frame(spark, rows, tiny_blocks):
    recs = [(k, i, t, v, None if m != m else int(m)) for k, i, t, v, m in rows.itertuples(index=False)]
    return spark.createDataFrame(recs, "key long, i long, t double, v double, mark int")


def as_pandas(o, cols):
    return o.df.orderBy("key", "i").select("key", "i", *cols).toPandas()


def test_positions_and_frames(frame, rows):
    want = rows.sort_values(["key", "i"]).reset_index(drop=True)
    o = ordered(frame, ["key"], ["t", "i"]).position("pos")
    o = o.over({"m": lambda w: F.avg("v").over(w.rowsBetween(-2, 2)), "p": lambda w: F.lag("v").over(w)}, before=2, after=2)
    got = as_pandas(o, ["pos", "m", "p"])
    g = want.groupby("key").v
    assert (got.pos == want.i).all()
    np.testing.assert_allclose(got.m, g.transform(lambda s: s.rolling(5, center=True, min_periods=1).mean()))
    np.testing.assert_allclose(got.p.astype(float), g.shift())


def test_running(frame, rows):
    want = rows.sort_values(["key", "i"]).reset_index(drop=True)
    o = ordered(frame, ["key"], ["t", "i"]).running(s=("sum", "v"), mx=("max", "v"), held=("last", "mark"), nxt=("next", "mark"), c=("count", "mark"))
    got = as_pandas(o, ["s", "mx", "held", "nxt", "c"])
    g = want.groupby("key")
    np.testing.assert_allclose(got.s, g.v.cumsum())
    np.testing.assert_allclose(got.mx, g.v.cummax())
    np.testing.assert_allclose(got.held.astype(float), g.mark.ffill().astype(float))
    np.testing.assert_allclose(got.nxt.astype(float), g.mark.bfill().astype(float))
    np.testing.assert_allclose(got.c, g.mark.transform(lambda s: s.notna().cumsum()))


def test_running_exclusive(frame, rows):
    want = rows.sort_values(["key", "i"]).reset_index(drop=True)
    got = as_pandas(ordered(frame, ["key"], ["t", "i"]).running(exclusive=True, s=("sum", "v")), ["s"])
    np.testing.assert_allclose(got.s.astype(float).fillna(0), want.groupby("key").v.cumsum() - want.v)


def test_islands_and_totals(frame, rows):
    want = rows.sort_values(["key", "i"]).reset_index(drop=True)
    o = ordered(frame, ["key"], ["t", "i"]).islands(F.col("v") > 4).totals(top=F.max("v"))
    got = as_pandas(o, ["island", "top"])
    flag = want.v > 4
    change = (flag != flag.groupby(want.key).shift()).astype(int)
    assert (got.island == change.groupby(want.key).cumsum()).all()
    np.testing.assert_allclose(got.top, want.groupby("key").v.transform("max"))


def test_quantiles(frame, rows):
    got = quantiles(frame, ["key"], ["v", "t"], {"a": 0.5, "b": 0.93}).orderBy("key").toPandas().set_index("key")
    for col in ("v", "t"):
        want = rows.groupby("key")[col].quantile([0.5, 0.93]).unstack()
        np.testing.assert_allclose(got[[f"{col}_a", f"{col}_b"]], want)


def greedy(ts, gap):
    kept, last = [], None
    for t in ts:
        if last is None or t - last > gap:
            kept.append(t)
            last = t
    return kept


@pytest.mark.parametrize("gap", [0.6, 2.0, 9.0])
def test_debounce_over_blocks(frame, rows, gap):
    got = debounce(ordered(frame, ["key"], ["t", "i"]), "t", gap).df.toPandas()
    for key, g in rows.sort_values("t").groupby("key"):
        assert sorted(got[got.key == key].t) == greedy(list(g.t), gap)


def test_ema_over_blocks(frame, rows):
    want = rows.sort_values(["key", "i"]).reset_index(drop=True)
    got = as_pandas(smooth.ema(ordered(frame, ["key"], ["t", "i"]), "v", 0.3, "y"), ["y"])
    np.testing.assert_allclose(got.y.astype(float), want.groupby("key").v.transform(lambda s: s.ewm(alpha=0.3, adjust=False).mean()))


def test_impacts_over_blocks(spark, tiny_blocks):
    acc = [0, 9, 9.5, 7, 6, 0, 9, 0, 0, 0, 8, 5.9, 0]
    d = spark.createDataFrame([(1, i, float(a), 10.0) for i, a in enumerate(acc)], "key long, i long, acc double, v double")
    got = impacts(ordered(d, ["key"], ["i"]), "acc", "v", 7.5, 0.8, 3, 1.0, 12).orderBy("_i").toPandas()
    # rows 1-3 are one event (row 4 is released at 6.0), row 6 falls in the skipped rows after it
    assert list(got._i) == [2, 10] and list(got.notable) == [True, False]


def test_gate_order_over_blocks(spark, tiny_blocks):
    gates = [2, 1, 3, 2, 2, 3, 1, 1, 2, 1, 2, 3]
    d = spark.createDataFrame([(1, i, g) for i, g in enumerate(gates)], "key long, i long, gate int")
    got = ordered_gates(ordered(d, ["key"], ["i"]), "gate", 3).df.orderBy("i").toPandas()
    assert list(got.accepted) == [False, True, False, True, False, True, True, True, True, True, True, True]


def test_radius_laps(spark, tiny_blocks):
    dist = [0, 60, 10, 5, 70, 30, 12, 80, 3]
    d = spark.createDataFrame([(1, i, i * 10.0, float(x)) for i, x in enumerate(dist)], "key long, i long, t double, d double")
    got = radius_laps(ordered(d, ["key"], ["i"]), F.col("d"), "t", 18.0, 55.0, 8.0).orderBy("lap_end").toPandas()
    assert list(got.lap_end) == [20.0, 60.0, 80.0] and list(got.lap_time) == [20.0, 40.0, 20.0]


def test_asof_and_interpolation(spark, tiny_blocks):
    fast = spark.createDataFrame([(1, i, i * 0.01) for i in range(0, 100, 7)], "key long, id long, t double")
    slow = spark.createDataFrame([(1, i, 0.1 * i + 0.05, 10.0 * i) for i in range(1, 9)], "key long, id long, t double, v double")
    got = interpolate(fast, slow, ["key"], "t", "id", ["v"]).toPandas().set_index("id").v
    s = slow.toPandas()
    for i in range(0, 100, 7):
        assert got[i] == pytest.approx(np.interp(i * 0.01, s.t, s.v))
    near = asof(fast, slow, ["key"], "t", "id", ["v"], "nearest", 0.021).toPandas().set_index("id").r_v
    for i in range(0, 100, 7):
        k = int(np.argmin(np.abs(s.t - i * 0.01)))
        want = s.v[k] if abs(s.t[k] - i * 0.01) <= 0.021 else None
        assert (near[i] == want) or (want is None and near[i] != near[i])


def test_repair_times(spark, tiny_blocks):
    ts = [5.0, 5.0, 4.0, 6.0, 6.0, 6.0005, 9.0]
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(ts)], "key long, i long, t double")
    got = clean.repair_times(ordered(d, ["key"], ["i"]), "t", 0.001, "fixed").df.orderBy("i").toPandas().fixed
    want, prev = [], None
    for t in ts:
        prev = t if prev is None else max(t, prev + 0.001)
        want.append(prev)
    np.testing.assert_allclose(got, want)


def test_greedy_assignment_differs_from_row_minimum(spark, tiny_blocks):
    m = [[1.0, 2.0, 9.0], [1.5, 8.0, 7.0], [3.0, 4.0, 6.0]]
    d = spark.createDataFrame([(f"w{i}", f"s{j}", m[i][j]) for i in range(3) for j in range(3)], "a string, b string, score double")
    got = {(r.a, r.b) for r in greedy_assign(d, "a", "b", "score").collect()}
    assert got == {("w0", "s0"), ("w2", "s1"), ("w1", "s2")}


def brute_clusters(pts, eps, k):
    n = len(pts)
    near = [[j for j in range(n) if np.hypot(pts[i][0] - pts[j][0], pts[i][1] - pts[j][1]) <= eps] for i in range(n)]
    core = [len(x) >= k for x in near]
    label = {}
    for s in range(n):
        if core[s] and s not in label:
            todo = [s]
            label[s] = s
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and j not in label:
                        label[j] = s
                        todo.append(j)
    return [label[i] if core[i] else min((label[j] for j in near[i] if core[j]), default=-1) for i in range(n)]


@pytest.mark.parametrize("k", [1, 4])
def test_clusters_match_brute_force(spark, tiny_blocks, k):
    rng = random.Random(3)
    pts = [(rng.choice([0, 10, 22]) + rng.randint(0, 12) / 4, rng.randint(0, 20) / 4) for _ in range(60)] + [(0.5, 0.5)] * 25
    d = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "key long, id long, x double, y double")
    got = density_clusters(d, ["key"], "id", "x", "y", 1.0, k).orderBy("id").toPandas().cluster
    assert list(got) == brute_clusters(pts, 1.0, k)


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    edges = spark.range(59).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a <> 29")
    got = components(nodes, edges).groupBy("label").count().orderBy("label").collect()
    assert [(r.label, r["count"]) for r in got] == [(0, 30), (30, 30)]


def test_salted_lookup_matches_plain_join(spark, tiny_blocks):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(60)], "k long, id long")
    side = spark.createDataFrame([(i, i * 2) for i in range(0, 40)], "k long, v long")
    for selective in (False, True):
        got = clean.salted_lookup(left, side, ["k"], F.col("id"), selective=selective).orderBy("id").toPandas()
        assert list(got.id) == list(range(60))
        assert all((v == k * 2) if k < 40 else v != v for k, v in zip(got.k, got.v))


def test_a_long_document_is_one_row(spark):
    """600 rows of one document: no fact depends on how long the document is."""
    from lapforge.operators import documents as dc

    rows = [(1, i, float(i), f"w{i}") for i in range(600)] + [(2, 0, 0.0, "one")]
    d = spark.createDataFrame(rows, "doc long, turn int, start double, text string").repartition(7)
    got = {r["doc"]: r for r in dc.stitched(d, ["doc"], "start", "turn", "text").collect()}
    assert got[1]["full_text"] == " ".join(f"w{i}" for i in range(600)) and got[1]["part"] == 0
    assert got[1]["clock_text"].count("\n") == 599 and got[2]["full_text"] == "one"


def test_sensor_listed_twice(spark):
    from pyspark.sql import functions as F

    from lapforge.sources.readers import sensor_rates

    d = spark.createDataFrame([("a|b|a", "1|x|3")], "s string, r string")
    assert d.select(sensor_rates(F.col("s"), F.col("r")).alias("m")).first()["m"] == {"a": 3, "b": None}
