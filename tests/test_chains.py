"""Block rules: transfers, their composition and whole runs equal one pass row by row."""

import random

import numpy as np
import pytest

from lapforge.operators.chains import Automaton, Decay, Resume, Turned, counted, earliest, spaced
from lapforge.operators.ordered import ordered


def plain_spaced(t, gap, strict):
    out, last = [], None
    for x in t:
        keep = last is None or (x - last > gap if strict else x - last >= gap)
        last = x if keep else last
        out.append(keep)
    return out


def plain_turned(v, turn):
    out, last = [], None
    for x in v:
        done = last is not None and abs(x - last) >= turn
        last = x if last is None or done else last
        out.append(done)
    return out


def plain_decay(v, alpha):
    out = []
    for x in v:
        out.append(x if not out else alpha * x + (1 - alpha) * out[-1])
    return out


TABLE = np.array([[0, 1, 0], [1, 1, 2], [2, 0, 2]])
MARKS = np.array([[0, 1, 0], [0, 0, 1], [0, 1, 0]], bool)


def plain_machine(v):
    out, state = [], 0
    for x in v:
        out.append(bool(MARKS[state, x]))
        state = TABLE[state, x]
    return out


def cases():
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.choice([0.01, 0.02, 0.05, 3.0], 400))
    grid = np.arange(400) / 100.0
    walk = np.cumsum(rng.normal(3, 20, 400))
    yield "spaced", spaced("t", 0.1, True), {"t": t}, plain_spaced(t, 0.1, True), "_keep"
    yield "grid", spaced("t", 0.02, False), {"t": grid}, plain_spaced(grid, 0.02, False), "_keep"
    yield "residues", spaced("t", 7.0, False), {"t": np.arange(400.0)}, plain_spaced(range(400), 7, False), "_keep"
    yield "turned", Turned("v", 90.0), {"v": walk}, plain_turned(walk, 90.0), "lap_end"
    yield "steady", Turned("v", 350.0), {"v": np.arange(400) * 4.7}, plain_turned(np.arange(400) * 4.7, 350.0), "lap_end"
    yield "decay", Decay("v", 0.3, "y"), {"v": walk}, plain_decay(walk, 0.3), "y"
    symbols = rng.integers(0, 3, 400)
    yield "machine", Automaton("v", TABLE, MARKS, "ok"), {"v": symbols.astype(float)}, plain_machine(symbols), "ok"


@pytest.mark.parametrize("size", [1, 5, 6, 64, 400])
@pytest.mark.parametrize("name", [c[0] for c in cases()])
def test_blocks_equal_one_pass(name, size):
    _, rule, cols, want, out = next(c for c in cases() if c[0] == name)
    n = len(want)
    blocks, top, state, got, whole, states = [], -np.inf, np.nan, [], None, []
    for a in range(0, n, size):
        part = {c: v[a : a + size] for c, v in cols.items()}
        if isinstance(rule, Resume):
            part["_bound"] = np.full(len(part["t"]), top)
            top = max(top, rule.bound(part))
        if isinstance(rule, Turned):
            part["_was"] = np.append(np.nan if not a else cols["v"][a - 1], part["v"][:-1])
        blocks.append(rule.transfer(part))
        got.extend(rule.emit(part, state)[out])
        state = rule.apply(blocks[-1], state)
        states.append(state)
    if out == "y":
        np.testing.assert_allclose(got, want, rtol=1e-12)
    else:
        assert [bool(x) for x in got] == want
    # Any way to bracket the composition leads to the same states.
    for k, t in enumerate(blocks):
        whole = t if whole is None else rule.compose(whole, t)
        np.testing.assert_allclose(rule.apply(whole, np.nan), states[k], rtol=1e-12)
    while len(blocks) > 1:
        blocks = [rule.compose(*blocks[i : i + 2]) if i + 1 < len(blocks) else blocks[i] for i in range(0, len(blocks), 2)]
    np.testing.assert_allclose(rule.apply(blocks[0], np.nan), states[-1], rtol=1e-12)


def test_earliest_is_exact():
    rng = np.random.default_rng(3)
    last = np.concatenate([rng.uniform(0, 1e6, 500), np.arange(100) / 100])
    for gap in (0.02, 0.1, 7.0, 1e-3):
        for strict in (True, False):
            x = earliest(last, gap, strict)
            fine = (lambda y: y - last > gap) if strict else (lambda y: y - last >= gap)
            assert fine(x).all() and not fine(np.nextafter(x, -np.inf)).any()


def test_transfers_stay_small():
    """On an even clock chains never meet, and still only the rows a state can reach are listed."""
    rule = spaced("t", 7.0, False)
    part = {"t": np.arange(1000.0, 2000.0), "_bound": np.full(1000, 1006.0)}
    assert len(rule.transfer(part)) <= 7


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("name", ["residues", "steady", "decay", "machine"])
def test_rounds_grow_with_the_logarithm(spark, few_partitions, name):
    """64 blocks that depend on each other, in groups of four transfers: five rounds."""
    _, rule, cols, want, out = next(c for c in cases() if c[0] == name)
    (col, v), = cols.items()
    rows = [(k, i, float(x)) for k in (1, 2) for i, x in enumerate(v[: 384 if k == 1 else 3])]
    random.Random(2).shuffle(rows)
    o = ordered(spark.createDataFrame(rows, f"key long, i long, {col} double"), ["key"], ["i"])
    o.rows = 6
    done, rounds = counted(o, rule, fan=4)
    got = done.df.where("key = 1").orderBy("i").select(out).toPandas()[out]
    assert 0 < rounds <= 8
    if out == "y":
        np.testing.assert_allclose(got, want[:384], rtol=1e-12)
    else:
        assert got.tolist() == want[:384]
    np.testing.assert_allclose(done.df.where("key = 2").orderBy("i").toPandas()[out].astype(float), np.array(want[:3], float), rtol=1e-12)
