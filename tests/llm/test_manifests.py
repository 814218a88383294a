"""Fill-in-middle, decontamination and the Merkle manifest against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapforge.llm import decontaminate, fim, merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long"
BENCH = "item_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- fill in middle ----------------------------------------------------------------------------
def offsets(kind, rng):
    if kind == "array":
        return sorted(rng.sample(range(1 << 16), 300))
    if kind == "bitmap":
        return sorted(rng.sample(range(1 << 16), 30000))
    if kind == "runs":
        return [x for a in range(0, 60000, 6000) for x in range(a, a + 4000)]
    return sorted(rng.sample(range(1 << 20), 9000)) + [(1 << 20) + x for x in range(70000)]


@pytest.mark.parametrize(("kind", "made"), [("array", fim.ArrayContainer), ("bitmap", fim.BitmapContainer), ("runs", fim.RunContainer), ("mixed", None)])
def test_boundary_set(kind, made):
    rng = random.Random(3)
    values = offsets(kind, rng)
    got = fim.BoundarySet(np.array(values, "int64"))
    assert len(got) == len(values)
    assert made is None or type(got.containers[0]) is made
    for k in [0, 1, len(values) - 1, *rng.sample(range(len(values)), 100)]:
        assert got.select(k) == values[k]
        assert got.rank(values[k]) == k
    for x in rng.sample(range(values[-1] + 5), 100):
        assert got.rank(x) == sum(v < x for v in values)
    with pytest.raises(IndexError):
        got.select(len(values))


def test_empty_boundary_set():
    got = fim.BoundarySet(np.zeros(0, "int64"))
    assert len(got) == 0 and got.rank(7) == 0


def brute_fim(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0), (100, 100)])
def test_fill_in_middle(spark, rate, spm):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "é", "\U0001F600", "\n", "\r\n", " ", "<", "<P", ">"]) for _ in range(rng.choice([1, 5, 40, 300]))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n\n", "no end", "x<S>y\nz", "<P", "a\x00b\n", "ab\n" * 90000, "é" * 70000 + "\nlast"]
    rows = [(i if i % 9 else None, t, "en", None, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], rows[3]], DOC).withColumns({"form": F.lit(7), "n": F.lit("n"), "_c": F.lit(1)}).repartition(4)
    out = fim.fill_in_middle(docs, rate=rate, spm=spm)
    got = out.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    want = [(r[0], *brute_fim(r[0], r[1], rate=rate, spm=spm), r[1] or "") for r in [*rows, rows[3], rows[3]]]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_fill_in_middle_empty(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], DOC)).count() == 0


# -- decontamination ---------------------------------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_hits(text, items, width=10):
    """Word count, hit words and items, by testing every window at every place."""
    places = [m.span() for m in WORD.finditer(lower(text or ""))]
    words = [lower(text)[a:b] for a, b in places]
    hit, found = set(), set()
    for item, body in items:
        own = WORD.findall(lower(body or ""))
        size = min(width, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[k : k + size]:
                    hit.update(range(i, i + size))
                    found.add("" if item is None else str(item))
    spans = []
    for i in sorted(hit):
        if spans and spans[-1][1] == i - 1:
            spans[-1] = (spans[-1][0], i, spans[-1][2], places[i][1])
        else:
            spans.append((i, i, *places[i]))
    return len(words), len(hit), sorted(found), spans


def bench_and_docs():
    rng = random.Random(4)
    vocab = ["Ab", "b", "cé", "d1", "ñe", "f", "\U0001F600"]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "-", "\n", " \x00"]) for _ in range(n))
    items = [(i, say(rng.choice([1, 4, 9, 10, 11, 25]))) for i in range(20)]
    items += [(3, say(14)), (None, say(12)), (21, None), (22, ""), (23, " -- "), (24, items[5][1]), (24, items[5][1])]
    texts = [None, "", "...", say(3), "b b b b b b b b b b b b b"]
    for _ in range(60):
        body = say(rng.choice([2, 8, 30, 200]))
        if rng.random() < 0.7:
            planted = rng.choice([t for _, t in items if t])
            body += rng.choice([planted.upper(), planted.replace(" ", "\t"), planted + planted])
        texts.append(body + say(4))
    return items, texts


@pytest.mark.parametrize("limit", [decontaminate.LIMIT, 1500])
def test_contamination(spark, limit):
    items, texts = bench_and_docs()
    rows = [(i if i % 8 else None, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (500, " ".join(texts[9:20]) * 3, "en", None, None)]
    docs = spark.createDataFrame(rows, DOC).withColumns({"items": F.lit(1), "spans": F.lit("x"), "n_hit": F.lit(2.0)}).repartition(3)
    bench = spark.createDataFrame(items, BENCH).withColumn("window", F.lit(1))
    got = decontaminate.contamination(docs, bench, limit=limit).collect()
    seen = sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]])) for r in got)
    assert seen == sorted(repr((r[0], *brute_hits(r[1], items))) for r in rows)


def test_spans_point_into_the_text():
    items, texts = bench_and_docs()
    scanner = decontaminate.Scanner([(" ".join(WORD.findall(lower("One, two THREE"))), ["7"])])
    text = "é \U0001F600 -- oNe\ttwo...three! one two"
    n, found, spans = scanner.scan(text)
    assert (n, found) == (7, {"7"})
    (first, last, start, end), = spans.tolist()
    assert (first, last) == (2, 4) and text[start:end] == "oNe\ttwo...three"


def test_contamination_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b", None, None, 3)], DOC), spark.createDataFrame([(1, "a")], BENCH)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    row = decontaminate.contamination(docs, bench.limit(0)).first()
    assert (row["n_words"], row["n_hit"], row["items"], row["spans"]) == (2, 0, [], [])


# -- manifest ----------------------------------------------------------------------------------
def brute_tree(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def brute_proof(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        base = i - i % fanout
        out.append(("".join(level[base:i]), "".join(level[i + 1 : base + fanout])))
        i //= fanout
    return out


def brute_leaf(row):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(part(row[k]) for k in (0, 3, 2, 4, 1)))


def brute_manifest(rows, fanout):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r))):
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([brute_leaf(r) for r in groups[s]], fanout) for s in order}
    top = brute_tree([trees[s][-1][0] for s in order], fanout)
    return [(r[0], brute_leaf(r), trees[s][-1][0], top[-1][0], brute_proof(trees[s], i, fanout) + brute_proof(top, g, fanout))
            for g, s in enumerate(order) for i, r in enumerate(groups[s])]


def doc_rows():
    rng = random.Random(6)
    rows = []
    for i in range(70):
        s = "hot" if i < 40 else rng.choice(["", None, "a", "é", "Z", "\U0001F600", "b\n"])
        rows.append((i * 7 % 101, rng.choice([None, "", "x\ny\n", "é\n" * i, "plain"]), rng.choice([None, "en"]), s, rng.choice([None, i])))
    return rows + [(None, "t", None, "hot", 1), (None, None, None, None, None), rows[2], rows[2], (5, "z" * 300000 + "\n", "en", "long", 300001)]


def with_leaf(spark, rows):
    docs = spark.createDataFrame(rows, DOC).withColumns({"g": F.lit(1), "i": F.lit("i"), "proof": F.lit(0), "d": F.lit(3.5)}).repartition(3)
    return docs.withColumn("leaf", merkle.leaf(*map(F.col, merkle.FIELDS)))


@pytest.fixture
def small_blocks(spark):
    """Orders cross block edges."""
    spark.conf.set("spark.lapforge.blockRows", "16")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.lapforge.blockRows")


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest(spark, fanout, small_blocks):
    rows = doc_rows()
    got = merkle.manifest(with_leaf(spark, rows).drop("text"), "source", ["doc_id"], "leaf", fanout)
    assert {"g", "i", "d"} < set(got.columns)
    got = got.select("*", merkle.folded(F.col("leaf"), F.col("proof")).alias("fold"), merkle.siblings(F.col("proof")).alias("sib")).collect()
    want = brute_manifest(rows, fanout)
    see = lambda r: repr((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["proof"]]))
    assert sorted(map(see, got)) == sorted(map(repr, want))
    assert all(r["fold"] == r["root"] and r["g"] == 1 and r["i"] == "i" and r["d"] == 3.5 for r in got)
    assert all(r["sib"] == "".join(a + b for a, b in map(tuple, r["proof"])) for r in got)


def test_changed_leaf_does_not_verify(spark):
    rows = doc_rows()
    out = merkle.manifest(with_leaf(spark, rows), "source", ["doc_id"], "leaf")
    fold = merkle.folded(F.sha2(F.concat("leaf", F.lit("x")), 256), F.col("proof"))
    assert out.where(fold == F.col("root")).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, "a", None, "s", 1)], [(1, "a", None, None, 1)], [(1, "a", None, "s", 1), (2, "b", None, "r", 1)]])
def test_manifest_small(spark, rows):
    got = merkle.manifest(with_leaf(spark, rows), "source", ["doc_id"], "leaf").collect()
    want = brute_manifest(rows, 3)
    assert sorted((r["doc_id"], r["subroot"], r["root"], len(r["proof"])) for r in got) == sorted((w[0], w[2], w[3], len(w[4])) for w in want)


def test_tampered_rows_follow_crc(spark, tmp_path):
    from lapforge.llm import queries

    rows = doc_rows()
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add("\n" in (r[1] or ""))
    for r in got:
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 2:
            assert r["verified"]
        elif len(texts[r["doc_id"]]) == 1:
            assert r["verified"] is (not next(iter(texts[r["doc_id"]])))
