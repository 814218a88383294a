"""The ten operators against brute force on small tables, and their edge cases."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from lapforge.llm import fingerprints, lines, mixing, neardup, pieces, quality, tokens, topk, toxicity, urls
from lapforge.session import scratch_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [a + b for a in ("th", "er", "on", "ing", "ré", "an") for b in ("ly", "ed", "st", "ou", "", "ñ")]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([1, 2, 3, 9, 40, 120])) for _ in range(40)]
    near = [b.replace("thly", "thed", 1) for b in base[:10]]
    odd = [None, "", " \t\n", "A", "a b", "One two\x0bTHREE", "x " * 3000, "\U0001F600 é ñ", "\n\n", "a\x00b"]
    return base + near + base[:8] + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en", f"s{i % 4}" if i % 7 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(5)


def simhash(text, width, weight):
    words = WORD.findall(lower(text or ""))
    terms = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    votes, total = [0] * 64, 0
    for t in terms:
        h, w = xxhash.xxh64_intdigest(t.encode(), seed=42), weight(t)
        total += w
        for b in range(64):
            votes[b] += w * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def groups(items, linked):
    root = list(range(len(items)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(items))]


# -- 1 ---------------------------------------------------------------------------------------
def test_edited_fingerprints(docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert len(got) == len(texts)
    plain = [t or "" for t in texts]
    prints = [simhash(t, 2, len) for t in plain]
    for i, t in enumerate(plain):
        nxt = plain[(i + 1) % len(plain)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i * 3]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert int(r["fingerprint"], 16) == prints[i]
        assert int(r["edited_fingerprint"], 16) == simhash(edited, 2, len)
        assert r["near_edited"] == 1 - (prints[i] ^ simhash(edited, 2, len)).bit_count() / 64
        assert r["near_next"] == 1 - (prints[i] ^ prints[(i + 1) % len(plain)]).bit_count() / 64
        want = sum((p ^ prints[i]).bit_count() <= 3 for p in prints) - 1 if i * 3 % 100 == 0 else None
        assert r["n_within"] == want


def test_edited_fingerprints_small_tables(spark):
    assert fingerprints.edited_fingerprints(spark.createDataFrame([], DOC)).count() == 0
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(7, "abcdefgh", None, None, 8)], DOC)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0
    rows = [(None, "aaaa", "x", "s", 4), (1, "bbbb", "x", "s", 4), (1, "bbbb", "x", "s", 4)]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, DOC)).orderBy("doc_id").collect()
    sha = [r["edited_sha256"] for r in got]
    assert sha == [hashlib.sha256(x).hexdigest() for x in (b"aaab", b"bbba", b"bbba")]


def test_block_tables_find_all(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    for b in base[:10]:
        base.extend(b ^ sum(1 << rng.randrange(64) for _ in range(k)) & (1 << 64) - 1 for k in (1, 2, 3, 4))
    signed = [x - (1 << 64) if x >> 63 else x for x in base]
    df = spark.createDataFrame([(x,) for x in [*signed, signed[0], None]], "fp long")
    for radius, blocks in ((0, 1), (2, 3), (3, 6)):
        got = {(r[0], r[1]): r[2] for r in fingerprints.within_radius(df, df, radius, blocks).collect()}
        want = {(a, b): (a ^ b & (1 << 64) - 1).bit_count() for a in signed for b in signed if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
        assert set(got) == set(want)


# -- 2 and 5 -----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(240):
        bad, mean = i % 4 == 0, i % 5 == 0
        text = prose(rng, 60)
        text = " ".join(w.upper() + "!!" for w in text.split()) if bad else text
        text = text + (" scum" * (1 + i % 7) + " loserly" if mean else "")
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(not bad), int(mean)))
    labels += [(3, None, None), (None, 1, 1)]
    rows += [(1000, None, None, None, None), (1001, "", None, None, 0), (None, "abc", None, None, 3)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(labelled):
    docs, labels = labelled
    rows = quality.judged(docs, labels).collect()
    assert len(rows) == 243 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    seen = [r for r in rows if r["held_out"] and r["doc_id"] < 240]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in seen) >= 0.95 * len(seen)


def test_quality_scores_a_group_of_words_at_once(monkeypatch):
    s = quality.Settings()
    weight, plain = np.random.default_rng(0).normal(size=s.buckets + 1).astype("float32"), quality.word_features
    texts = ["", " \t\n", "a a a b a", "the the\x0bthe\x0c of\r\nof x\x1cx x\x1cx x\x85 \u00e9t\u00e9 \u00e9t\u00e9 \u65e5\u672c", "word\x00 <> >< " + "y" * 300, *[f"w{i} w{i // 2} w{i}" for i in range(60)]]
    want = []
    for text in texts:
        total, count, before = 0.0, 0, ""
        for word in quality._words(text):
            f = plain(word, before, s, quality._Buckets(s.buckets))
            total, count, before = total + float(weight[f].sum()), count + len(f), word
        want.append(total / max(1, count))
    called = []
    monkeypatch.setattr(quality, "word_features", lambda *a: (called.append(a[0]), plain(*a))[1])
    monkeypatch.setattr(quality, "GRAMS_KEPT", 5)
    for kept, chars in ((quality.WORDS_KEPT, quality.CHARS), (7, 20)):
        monkeypatch.setattr(quality, "WORDS_KEPT", kept)
        monkeypatch.setattr(quality, "CHARS", chars)
        scores = quality._Scores(weight, s)
        assert [m for group in quality._groups(texts) for m in scores.means(group)] == want
    assert not any(word.isascii() for word in called)


def test_quality_ignores_held_out_labels(spark, labelled):
    docs, labels = labelled
    turned = labels.withColumn("quality", (1 - labels["quality"]).cast("int"))
    held = quality.is_held_out(labels["doc_id"])
    mixed = labels.where(~held).unionByName(turned.where(quality.is_held_out(turned["doc_id"])))
    a = {r["doc_id"]: r["score"] for r in quality.judged(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.judged(docs, mixed).collect()}
    assert a == b
    empty = quality.judged(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in empty] == [0.5]
    assert quality.judged(docs.limit(0), labels).count() == 0


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    rows = toxicity.graded(docs, labels).collect()
    assert len(rows) == 243 and all(0 <= r["severity"] <= 3 for r in rows)
    seen = [r for r in rows if r["held_out"] and r["doc_id"] < 240]
    assert all(r["toxic"] == int(r["doc_id"] % 5 == 0) for r in seen)
    few = [r["severity"] for r in rows if r["toxic"] and r["doc_id"] % 7 == 0]
    many = [r["severity"] for r in rows if r["toxic"] and r["doc_id"] % 7 == 6]
    assert np.mean(many) > np.mean(few)
    assert all(r["toxic"] == 0 for r in toxicity.graded(docs, labels.limit(0)).collect())


def test_a_long_document_leaves_the_others_in_the_sample(spark, labelled):
    """One labelled text of over 16 M characters comes first; the others are still learned from."""
    docs, labels = labelled
    first = next(i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 4 != 2)
    long = spark.createDataFrame([(first, 1, 0)], "doc_id long, quality int, toxic int")
    text = spark.range(1).selectExpr(f"cast({first} as bigint) as doc_id", "repeat('plain words ', 1400000) as text", "'en' as lang", "'s' as source", "16800000L as n_chars")
    docs, labels = text.unionByName(docs), long.unionByName(labels).coalesce(1)
    seen = [r for r in toxicity.graded(docs, labels).drop("text").collect() if r["held_out"] and r["doc_id"] < 240]
    assert all(r["toxic"] == int(r["doc_id"] % 5 == 0) for r in seen)
    for seed in range(300):  # the long text is trained on first
        order = pd.DataFrame(range(1 + sum(1 for i in range(240) if zlib.crc32(str(i).encode()) % 4 != 2))).sample(frac=1, random_state=seed)
        if order.index[0] == len(order) - 1:
            break
    seen = [r for r in quality.judged(docs, labels, quality.Settings(seed=seed)).drop("text").collect() if r["held_out"] and r["doc_id"] < 240]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in seen) >= 0.95 * len(seen)


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = np.digitize(x @ [2.0, -1.0], [-1, 0.5, 2])
    w, theta = toxicity.fit_ordinal(x, y, 3, toxicity.Settings(), np.ones(400))
    assert np.all(np.diff(theta) > 0) and w[0] > 0 > w[1]
    assert np.mean(np.digitize(x @ w, theta) == y) > 0.9


# -- 3 ---------------------------------------------------------------------------------------
def shingle_set(line):
    return {line[i : i + lines.SHINGLE] for i in range(max(1, len(line) - lines.SHINGLE + 1))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_line_dedup(spark):
    rng = random.Random(11)
    base = [prose(rng, 30) for _ in range(12)]
    rows, at = [], {}
    for d in range(30):
        body = [rng.choice(base) for _ in range(3)]
        body[0] = body[0] + rng.choice(["", " x", "!", " end"])
        body += ["", f"own line {d} {prose(rng, 12)}", "  short "]
        rows.append((d, "\n".join(body), "en", "s", 0))
    rows += [(90, None, "en", "s", None), (91, "", "en", "s", 0), (92, "short", "en", "s", 5), (92, "short", "en", "s", 5), (None, "nobody has this", None, None, 3)]
    df = spark.createDataFrame(rows, DOC)
    occ = [(r[0] if r[0] is not None else -1, p, x.strip(" \t\r")) for r in rows for p, x in enumerate((r[1] or "").split("\n"))]
    occ = sorted({o for o in occ if o[2]})
    distinct = sorted({o[2] for o in occ})
    comp = dict(zip(distinct, groups(distinct, lambda a, b: jaccard(a, b) >= 0.8)))
    for o in occ:
        at.setdefault(comp[o[2]], o)
    gone = {(d, p): at[comp[x]][:2] for d, p, x in occ if at[comp[x]] != (d, p, x)}
    report = lines.line_report(df).collect()
    assert len(report) == len(rows)
    got = {(r["doc_id"] if r["doc_id"] is not None else -1, x["line"]): (x["keeper_doc"] if x["keeper_doc"] is not None else -1, x["keeper_line"]) for r in report for x in r["removed"]}
    assert got == gone
    kept = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    for d, text, *_ in rows:
        left = [x for p, x in enumerate((text or "").split("\n")) if (d if d is not None else -1, p) not in gone]
        assert (kept[d]["text"] or "") == "\n".join(left)
    assert lines.dedup_lines(df.limit(0)).count() == 0
    assert lines.dedup_lines(df.withColumn("removed", df["doc_id"])).columns == [*df.columns, "removed"]


@pytest.mark.parametrize("cell", [5, lines.CELL])
def test_line_dedup_in_a_crowd(spark, cell):
    """Lines of one template share bands below the similarity; the near copies among them still go."""
    rng = random.Random(21)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head = some(310)
    made = [head + kin + some(36) for kin in (some(32) for _ in range(60)) for _ in range(2)]
    rng.shuffle(made)
    df = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(made)], DOC)
    table = lines.distinct_lines(df)
    keys = {r["l"]: set(r["keys"]) for r in lines.band_keys(table).join(table, ["h1", "h2"]).collect()}
    root = groups(made, lambda a, b: keys[a] & keys[b] and jaccard(a, b) >= lines.SIMILAR)
    assert len(set(root)) < 64
    got = {r["doc_id"]: r["removed"][0]["keeper_doc"] for r in lines.line_report(df, cell=cell).collect() if r["removed"]}
    assert got == {i: k for i, k in enumerate(root) if i != k}


def test_line_groups_take_new_links_without_starting_anew(spark, monkeypatch):
    """Only groups that a new link joins are gone through again; labels are those of all links together."""
    rng = random.Random(41)
    line = lambda i: (i, -i)
    made = [tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)]
    shape = "a struct<h1:bigint,h2:bigint>, b struct<h1:bigint,h2:bigint>"
    table = lambda links: spark.createDataFrame([(line(a), line(b)) for a, b in links], shape)
    whole = {(r.h1, r.h2, tuple(r.label)) for r in lines._linked(table(made)).collect()}
    first = lines._linked(table(made[:30]))
    seen = []
    monkeypatch.setattr(lines, "components", lambda nodes, edges, own=lines.components: seen.append(nodes.count()) or own(nodes, edges))
    got = lines._regrouped(first, table(made[30:]))
    assert {(r.h1, r.h2, tuple(r.label)) for r in got.collect()} == whole
    assert got.count() == len(whole)
    assert seen[0] < len(whole) / 2
    assert {(r.h1, r.h2, tuple(r.label)) for r in lines._regrouped(got, table(made).limit(0)).collect()} == whole


def test_line_dedup_leaves_one_table(spark):
    """What is written on the way, with the lines' texts, is dropped; the removed lines stay to be read."""
    df = spark.createDataFrame([(i, f"the same line of this document\nown line number {i}", "en", "s", 0) for i in range(8)], DOC)
    folder = scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    tables = len(spark.catalog.listTables())
    report = lines.line_report(df)
    assert len(spark.catalog.listTables()) == tables
    made = [name for name in os.listdir(folder) if name not in before]
    assert [name.split("-")[1] for name in made if name.startswith("lapforge-")] == ["removed"]
    assert sum(r["n_kept"] for r in report.collect()) < 16


def test_line_dedup_family_in_linear_pairs(spark):
    """Most of a family of near copies is linked by one partner a posting, before any two of its lines meet."""
    rng = random.Random(31)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)]
    made = []
    for _ in range(120):
        line = list(base)
        for at in rng.sample(range(300), 2):
            line[at] = rng.choice("0123456789")
        made.append("".join(line))
    table = lines.distinct_lines(spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(made)], DOC))
    crowd = lines.band_keys(table)
    posts = lines._postings(crowd, table, lines.SIMILAR, lines.SHINGLE).withColumn("label", F.struct("h1", "h2"))
    links = lines._verified(lines._posting_pairs(posts, lines.SIMILAR, lines.CELL, True), table, lines.SIMILAR, lines.SHINGLE)
    shared = lines._posting_pairs(posts, lines.SIMILAR, lines.CELL, False).count()
    labels = lines._linked(links)
    assert links.count() < shared / 2
    assert labels.groupBy("label").count().agg(F.max("count")).first()[0] > 60


def test_line_dedup_makes_a_pair_once(spark, monkeypatch):
    """Lines that share many postings meet in that of their first common shingle; none is lost, however few are kept."""
    rng = random.Random(37)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(70)] for _ in range(3)]
    made = []
    for i in range(60):
        line = list(base[i % 3])
        line[rng.randrange(70)] = rng.choice("0123456789")
        made.append("".join(line))
    table = lines.distinct_lines(spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(made)], DOC))
    posts = lines._postings(lines.band_keys(table), table, lines.SIMILAR, lines.SHINGLE).withColumn("label", F.struct("h1", "h2"))
    seen = {}
    for head in (0, 2, lines.HEAD):
        monkeypatch.setattr(lines, "HEAD", head)
        seen[head] = [tuple(r) for r in lines._posting_hits(posts, lines.SIMILAR, 5, False).collect()]
    assert set(seen[0]) == set(seen[2]) == set(seen[lines.HEAD])
    assert len(seen[lines.HEAD]) == len(set(seen[0])) < len(seen[0])


# -- 4 ---------------------------------------------------------------------------------------
def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(260)]
    rows[120:140] = [(i, rows[5][1]) for i in range(120, 140)]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (None, rows[0][1]), (1100, [0.5, 0.5]), (1101, [1.0, 2.0]), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.integer_vectors(df)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(v, v.where("vec_id % 100 = 0"), shard_rows=40, query_rows=2).collect()}
    vec = {i: np.floor(1024 * np.array(x)).astype("int64") for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()}
    want = {}
    for q in vec:
        if q % 100 == 0:
            best = sorted((-int(vec[q] @ vec[c]), c) for c in vec if c != q and len(vec[c]) == len(vec[q]))[:10]
            want |= {(q, n + 1): (c, -s) for n, (s, c) in enumerate(best)}
    assert got == want
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


# -- 6 ---------------------------------------------------------------------------------------
def test_urls(spark):
    cases = [
        ("https://A.Example.COM/en/1?q#x", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://x.com/EN/", "x.com", "/EN/", "com/", "allow"),
        ("http://example.net/es/?a", "example.net", "/es/", "net/es/", "block"),
        ("http://notcom", "notcom", "", None, "allow"),
        ("x://com#f", "com", "", None, "allow"),
        ("http://a.org/p://q?z", "a.org", "/p://q", None, "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://free-casino.org/x", "free-casino.org", "/x", None, "block"),
        ("http://bestcasino.org/x", "bestcasino.org", "/x", None, "block"),
        ("http://ÀB.org/" + "x" * 500, "Àb.org", "/" + "x" * 500, None, "allow"),
    ]
    quiet = [(f"http://quiet{chr(97 + i % 20)}.org/p/{i}", None) for i in range(200)] + [("http://best.org/", None)] * 20
    rows = [(i, c[0], "h") for i, c in enumerate(cases)] + [(1000 + i, u, "h") for i, (u, _) in enumerate(quiet)]
    got = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), cases[i]
    assert all(r["verdict"] == "allow" for i, r in got.items() if i >= 1000) and len(got) == len(rows)
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_viterbi_is_the_likeliest_cut():
    counts, total = {"cheap": 5, "pills": 5, "che": 2, "ap": 1, "a": 3}, 100
    word = "xcheappills"
    spans = [(i, n, counts[word[i : i + n]]) for i in range(len(word)) for n in range(1, len(word) - i + 1) if word[i : i + n] in counts]
    assert [word[a:b] for a, b in urls.viterbi(len(word), spans, total)] == ["x", "cheap", "pills"]


# -- 7 ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("shard_rows", [3, 20_000])
def test_near_duplicates(docs, texts, shard_rows):
    prints = [simhash(t, 3, lambda _: 1) for t in texts]
    comp = groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in neardup.near_duplicates(docs, shard_rows=shard_rows).collect()}
    assert got == {i * 3: (f"{p:016x}", comp[i] * 3) for i, p in enumerate(prints)}
    assert sorted(r["doc_id"] for r in neardup.keep_first(docs).collect()) == sorted({c * 3 for c in comp})


def test_keep_first_without_unique_ids(spark):
    """Texts without a link all stay, whether their ids are null, repeated or both."""
    rng = random.Random(31)
    t = [prose(rng, 60) for _ in range(9)]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (None, t[2]), (7, t[3]), (7, t[4]), (7, t[4]), (5, t[5]), (5, t[6]), (9, t[6]), (None, t[6]), (4, t[7]), (None, t[8]), (8, t[8])]
    df = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], DOC)
    want = [(None, t[0]), (None, t[1]), (None, t[2]), (7, t[3]), (7, t[4]), (5, t[5]), (5, t[6]), (4, t[7]), (8, t[8])]
    for d in (df.repartition(1), df.repartition(6)):
        got = [(r["doc_id"], r["text"]) for r in neardup.keep_first(d).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert neardup.keep_first(df).columns == df.columns and neardup.keep_first(df.limit(0)).count() == 0


def test_near_links_in_a_crowd(spark):
    rng = random.Random(4)
    base = rng.getrandbits(62)
    crowd = sorted({base ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) ^ (rng.getrandbits(1) << rng.randrange(40)) for _ in range(120)} | {rng.getrandbits(62) for _ in range(20)})
    df = spark.createDataFrame([(x,) for x in crowd], "fp long")
    want = groups(crowd, lambda a, b: (a ^ b).bit_count() <= 2)
    for shard_rows in (7, 1000):
        links = {(r["a"], r["b"]) for r in neardup.near_links(df, shard_rows=shard_rows).collect()}
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        assert groups(crowd, lambda a, b: (a, b) in links or (b, a) in links) == want
    assert neardup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_bk_tree_search():
    rng = random.Random(1)
    values = list({rng.getrandbits(10) for _ in range(200)})
    tree = neardup.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 1024, 37):
        assert sorted(tree.values[i] for i in tree.near(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


# -- 8 ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("rule", tokens.RULES)
def test_section_tokens(docs, texts, rule):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tok = tokens.SpanTokenizer(open(path, "rb").read(), public_tokenizers.PATTERN)
    got = {(r["doc_id"], r["section"]): r for r in tokens.section_tokens(docs, path, public_tokenizers.PATTERN, rule).collect()}
    want = {}
    for d, t in enumerate(texts):
        raw, t = (t or "").encode(), t or ""
        parts = t.splitlines(keepends=True) if not re.search(r"[^\n -~é ñ\U0001F600]", t) else re.findall(r"[^\n]*\n|[^\n]+", t)
        spans, at = [], 0
        for p in parts or [""]:
            spans.append((at, at + len(p.encode())))
            at = spans[-1][1]
        counts, at = [0] * len(spans), 0
        for i in tok.encoding.encode_ordinary(t):
            n = len(tok.encoding.decode_single_token_bytes(i))
            share = [max(0, min(at + n, b) - max(at, a)) for a, b in spans]
            hit = [j for j, s in enumerate(share) if s]
            counts[{"start": hit[0], "end": hit[-1], "most": max(hit, key=lambda j: (share[j], -j))}[rule]] += 1
            at += n
        assert at == len(raw)
        want |= {(d * 3, j): c for j, c in enumerate(counts)}
    assert {k: r["n_tokens"] for k, r in got.items()} == want
    for d, t in enumerate(texts):
        own = sorted((r["section"], r["start"], r["length"]) for (i, _), r in got.items() if i == d * 3)
        assert "".join((t or "")[s : s + n] for _, s, n in own) == (t or "")


# -- 9 ---------------------------------------------------------------------------------------
def fill(sizes, weights, total):
    out, open_ = {}, set(sizes)
    while True:
        level = (total - sum(out.values())) / max(1e-12, sum(weights[s] for s in open_))
        full = {s for s in open_ if 2 * sizes[s] <= weights[s] * level}
        if not full:
            return out | {s: weights[s] * level for s in open_}
        out |= {s: 2 * sizes[s] for s in full}
        open_ -= full
        if not open_:
            return out


def test_mixing(docs, texts):
    rows = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    source = {i * 3: f"s{i % 4}" if i % 7 else None for i in range(len(texts))}
    size = {i * 3: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    sums = {n: sum(v for d, v in size.items() if source[d] == n) for n in names}
    want = fill(sums, {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}, 1.5 * sum(size.values()))
    for d, r in rows.items():
        assert r["size"] == size[d] and r["source_size"] == sums[source[d]] and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[source[d]])
    for n in names:
        assert abs(sum(r["taken"] for d, r in rows.items() if source[d] == n) - want[n]) <= 1
    assert {d: r["taken"] for d, r in rows.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(3)).collect()}


def test_mixed_documents(spark, docs):
    plan = mixing.training_plan(docs).collect()
    got = mixing.mixed_documents(docs).collect()
    assert len(got) == sum(len(r["copies"]) for r in plan)
    assert sum(len(WORD.findall(r["text"])) for r in got) == sum(c["words"] for r in plan for c in r["copies"])
    where = {}
    for r in plan:
        for c in r["copies"]:
            assert 0 <= c["position"] <= 1
            where.setdefault(r["doc_id"], []).append(c["position"])
    order = [min(where[r["doc_id"]]) if i == 0 else None for i, r in enumerate(got)]
    assert order[0] == min(p for ps in where.values() for p in ps)
    empty = spark.createDataFrame([], DOC)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, "en", None, None), (1, None, "en", None, None)], DOC)).collect()
    assert [r["taken"] for r in blank] == [0, 0] and blank[0]["target"] == 0.0


def test_curriculum_share(spark):
    """Early in training the first source, which starts low, has trained less than its share."""
    rows = [(i, "w " * 10, "en", f"s{i % 3}", 20) for i in range(600)]
    plan = mixing.training_plan(spark.createDataFrame(rows, DOC), share=1.0).collect()
    for s, tilt in zip(("s0", "s1", "s2"), mixing.TILTS):
        at = [(c["position"], c["words"]) for r in plan if r["source"] == s for c in r["copies"]]
        early = sum(w for p, w in at if p <= 0.5) / sum(w for _, w in at)
        assert early == pytest.approx(0.5 - tilt / 4, abs=0.02)


# -- 10 --------------------------------------------------------------------------------------
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(spark, docs, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", pieces.encode(spark, PIECES, F.col("text")).alias("e")).select("doc_id", "e.*")
    back = rows.withColumn("again", pieces.decode(spark, PIECES, F.col("ids")))
    for r in back.collect():
        t = texts[r["doc_id"] // 3] or ""
        assert r["ids"] == sp.encode(t) and r["decoded"] == r["again"] == (sp.decode(r["ids"]) if r["ids"] else "")
    assert rows.limit(0).count() == 0


def test_pieces_random_strings():
    e = pieces.PieceEncoder(open(PIECES, "rb").read())
    rng, names = random.Random(8), list(e.id_of)
    for _ in range(4000):
        kind = rng.randrange(4)
        if kind == 0:
            t = "".join(rng.choice("ab \n\tth▁.,!") for _ in range(rng.randrange(40)))
        elif kind == 1:
            t = "".join(rng.choice(names) for _ in range(rng.randrange(1, 8)))
        elif kind == 2:
            t = "".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(0x3000, 0x9FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(20)))
        else:
            t = rng.choice([" ", "a", "ab"]) * rng.randrange(200)
        assert e.encode(t).tolist() == e.library.encode(t), repr(t)
