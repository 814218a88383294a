"""Documents in parts: whatever the part size, the whole text and its facts stay the same."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapforge.operators import documents as dc
from lapforge.operators import retrieve as rt
from lapforge.session import small_arrow_batches


def segments(spark):
    rows = [(k, float(i // 2), i, f"é{i} w{i * k}") for k, n in ((1, 23), (2, 4), (3, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "key long, start double, turn long, text string").repartition(4)


@pytest.mark.parametrize("size", [1, 4, 5, 100])
def test_parts_make_the_whole(spark, size):
    s = segments(spark)
    whole = {r["key"]: r for r in dc.stitched(s, ["key"], "start", "turn", "text").collect()}
    parts = {}
    for r in dc.stitched(s, ["key"], "start", "turn", "text", size).collect():
        parts.setdefault(r["key"], []).append(r)
    for key, own in parts.items():
        own.sort(key=lambda r: r["part"])
        text = " ".join(r["full_text"] for r in own)
        assert text == whole[key]["full_text"] and "\n".join(r["clock_text"] for r in own) == whole[key]["clock_text"]
        assert [r["part"] for r in own] == list(range(len(own)))
        for r in own:
            assert text.encode()[r["offset"] :].startswith(r["full_text"].encode())
    assert len(parts[1]) == -(-23 // size)


@pytest.mark.parametrize("size", [3, 100])
def test_facts_do_not_depend_on_size(spark, size):
    d = dc.assemble(segments(spark), ["key"], ["turn"], F.col("text"), {"n": F.count(F.lit(1)), "last": F.max("turn")}, head=2, size=size)
    for r in d.collect():
        n = {1: 23, 2: 4, 3: 1}[r["key"]]
        assert (r["n"], r["last"], len(r["head"])) == (n, n - 1, min(2, n)) and r["head"][0] == "é0 w0"


@pytest.mark.parametrize("batch", [2, 256])
def test_lexical_top_is_exact(spark, batch):
    """Blocks that cannot win are passed over, and the best k equal a scan of all scores."""
    import math
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(words[: rng.choice([5, 30])]) for _ in range(n))
    docs = [(i, say(rng.choice([0, 3, 20, 60])), say(2)) for i in range(200)] + [(500, None, "w1"), (501, "W1 w1", None)]
    queries = [(i, say(rng.choice([1, 4, 8]))) for i in range(5)] + [(9, "unseen"), (10, None)]

    def scores(field, boost):
        texts = {d[0]: None if d[field] is None else d[field].lower().split() for d in docs}
        mean = sum(len(t) for t in texts.values() if t is not None) / sum(t is not None for t in texts.values())
        df = {w: sum(w in (t or []) for t in texts.values()) for w in words}
        out = {}
        for q, text in queries:
            for d, t in texts.items():
                s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
                        for w in (text or "").split() if t and w in t)
                if s:
                    out[q, d] = boost * round(s, 9)
        return out

    a, b = scores(1, 1.0), scores(2, 3.0)
    want = {}
    for q, _ in queries:
        all_ = {d: max(a.get((q, d), 0), b.get((q, d), 0)) for d, *_ in docs if (q, d) in a or (q, d) in b}
        for rank, d in enumerate(sorted(all_, key=lambda d: (-round(all_[d], 6), d))[:4], 1):
            want[q, rank] = pytest.approx(all_[d])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    df = spark.createDataFrame(docs, "id long, text string, title string").repartition(3)
    got = rt.lexical_top(df, spark.createDataFrame(queries, "q long, text string"), "id", {"text": 1.0, "title": 3.0}, "q", "text", 4, batch)
    rows = got.collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["query"], r["rank"]): r["score"] for r in rows} == want


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """The texts are counted a bounded number of rows and bytes at a time; the session's settings come back."""
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before, seen, write = [spark.conf.get(k) for k in keys], [], rt.written

    def watched(df, label):
        seen.append((label, [int(spark.conf.get(k)) for k in keys]))
        return write(df, label)

    monkeypatch.setattr(rt, "written", watched)
    df = spark.createDataFrame([(i, f"word{i % 7} other") for i in range(30)], "id long, text string")
    got = rt.lexical_top(df, spark.createDataFrame([(1, "word3")], "q long, text string"), "id", {"text": 1.0}, "q", "text", 3)
    assert [r["doc"] for r in got.orderBy("rank").collect()] == [3, 10, 17]
    assert ("postings", [rt.TEXT_ROWS, rt.TEXT_BYTES]) in seen
    assert [spark.conf.get(k) for k in keys] == before
    with small_arrow_batches(spark, 4, 1 << 20):
        sizes = spark.range(50).mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in it), "n long")
        assert max(r["n"] for r in sizes.collect()) <= 4
