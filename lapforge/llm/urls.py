"""URL filters: rules first, else host words by unigram Viterbi and multinomial naive Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.llm.common import ascii_lower
from lapforge.operators.clean import salted_lookup
from lapforge.session import written

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words that mark a host as unwanted; pages of such hosts are the model's block class.
SEEDS = ("ads", "adult", "bet", "bets", "casino", "cheap", "escort", "farm", "free", "gambling", "loan", "loans", "pills", "poker", "porn", "sex", "slots", "spam", "track", "tracker", "viagra", "win", "xxx")
STRONG = ("adult", "bets", "casino", "escort", "gambling", "pills", "poker", "porn", "spam", "viagra", "xxx", "ads")
SEED_COUNT = 100
LONGEST = 24
BUCKETS = 1 << 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(raw), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does.

    A rule fits its host and the hosts below it when the path starts with the rule's path. Of
    equally long rules that with the longer host wins, then the one that blocks.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _chunks(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; a run of digits becomes ``#``."""
    flat = F.regexp_replace(F.lower(text), r"[0-9]+", " # ")
    return F.filter(F.split(flat, r"[^\p{L}#]+"), lambda c: c != "")


def viterbi(length: int, spans: list[tuple[int, int, int]], total: int) -> list[tuple[int, int]]:
    """Likeliest cut of a chunk into words. ``spans``: (start, length, count) of the known words in it.

    An unknown run of n characters has the probability 10 / (total * 10**n); of equally likely
    cuts the one found first stays, which takes the shorter last word.
    """
    at: list[list[tuple[int, float]]] = [[] for _ in range(length + 1)]
    for start, size, count in sorted(spans, key=lambda s: s[1]):
        at[start + size].append((start, math.log(count / total)))
    best, back = [0.0] + [-math.inf] * length, [0] * (length + 1)
    known = [{s for s, _ in x} for x in at]
    for end in range(1, length + 1):
        options = list(at[end])
        for size in range(1, min(end, LONGEST) + 1):
            if end - size not in known[end]:
                options.append((end - size, math.log(10 / total) - size * math.log(10)))
        for start, p in options:
            if best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    words, end = [], length
    while end:
        words.append((back[end], end))
        end = back[end]
    return words[::-1]


def segment(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """``chunk`` and its ``words``. ``chunks`` has distinct values; ``counts`` has ``word``, ``n``.

    Substrings of up to ``LONGEST`` characters meet their unigram counts in a join, so the word
    list may be of any size; each chunk then has at most ``LONGEST`` spans for each character.
    A whole chunk's count leaves one out, its own host, so a name of one host is no word yet.
    """
    total = max(1, int(counts.agg(F.sum("n").alias("t")).first()["t"] or 1))
    spans = chunks.select("chunk", F.explode(F.sequence(F.lit(1), F.length("chunk"))).alias("i"))
    spans = spans.select("chunk", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("chunk") - F.col("i") + 1))).alias("size"))
    spans = spans.select("chunk", "i", "size", F.substring("chunk", F.col("i"), F.col("size")).alias("word"))
    found = salted_lookup(spans, counts, ["word"], F.xxhash64("chunk", "i"), "inner", selective=True)
    per = found.groupBy("chunk").agg(F.collect_list(F.struct((F.col("i") - 1).alias("i"), "size", "n")).alias("spans"))

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            out = []
            for text, s in zip(texts, spans):
                known = [(x["i"], x["size"], x["n"] - (x["size"] == len(text))) for x in s] if s is not None else []
                known = [x for x in known if x[2] > 0]
                out.append([text[a:b] for a, b in viterbi(len(text), known, total)])
            yield pd.Series(out, dtype=object)

    return chunks.join(per, "chunk", "left").select("chunk", cut("chunk", "spans").alias("words"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, buckets: int = BUCKETS) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row, and the method's ``block_odds``.

    Unigram counts come from all hosts and paths of the table, with the seed words added. A page belongs to
    the block class when a strong seed is among its host's words, else to the allow class; naive
    Bayes learns word counts of host and path in hashed buckets, so the model has a fixed size. A
    rule decides where one fits; else log odds above 0 block. Repeated rows are judged alike; null
    urls and ones without ``://`` have no words and the verdict of the class sizes.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    base = written(pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id()), "urls")
    hosts = base.select("host").distinct()
    hosts = written(hosts.select("host", _chunks(F.col("host")).alias("chunks")), "hosts")
    parts = hosts.select(F.explode("chunks").alias("word"), F.lit(1).cast("long").alias("n"))
    parts = parts.unionByName(base.select(F.explode(_chunks(F.col("path"))).alias("word"), F.lit(1).cast("long").alias("n")))
    seeds = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in SEEDS])).alias("word"), F.lit(SEED_COUNT).cast("long").alias("n"))
    counts = written(parts.unionByName(seeds).where("word <> '#'").groupBy("word").agg(F.sum("n").alias("n")), "counts")

    chunks = hosts.select(F.explode("chunks").alias("chunk")).distinct()
    words = segment(chunks, counts)
    cut = salted_lookup(hosts.select("host", F.explode("chunks").alias("chunk")), words, ["chunk"], F.xxhash64("host"), "inner", selective=True)
    cut = cut.groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words"))
    strong = F.arrays_overlap("words", F.array(*[F.lit(w) for w in STRONG]))
    cut = written(cut.select("host", "words", strong.alias("bad")), "words")

    slot = lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(buckets)).cast("int")
    rows = salted_lookup(base, cut, ["host"], F.col("_row"), "left", selective=True)
    slots = F.transform(F.concat(F.coalesce("words", F.array().cast("array<string>")), _chunks(F.col("path"))), slot)
    rows = written(rows.select("page_id", "host", "path", F.coalesce("bad", F.lit(False)).alias("bad"), slots.alias("slots")), "slots")
    tally = rows.select("bad", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(1)).alias("a"))
    block, allow = np.zeros(buckets), np.zeros(buckets)
    for r in tally.toLocalIterator():  # at most ``buckets`` rows
        block[r["slot"]] += r["b"]
        allow[r["slot"]] += r["a"]
    # Add one to every bucket in use; empty ones are never asked for.
    used = block + allow > 0
    block, allow = np.where(used, block + 1, 1), np.where(used, allow + 1, 1)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bad"), 1)).alias("b")).first()
    prior = math.log((size["b"] + 1) / (size["n"] - size["b"] + 1))
    model = spark.sparkContext.broadcast((np.log(block / block[used].sum()) - np.log(allow / allow[used].sum())).astype("float32"))

    @F.pandas_udf("double")
    def odds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight = model.value
        for s in batches:
            yield pd.Series([prior + float(weight[x].sum()) if len(x) else prior for x in s], dtype="float64")

    out = rows.select("page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("_r"), odds("slots").alias("block_odds"))
    own = F.when(F.col("block_odds") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", own).alias("verdict"), "block_odds")
