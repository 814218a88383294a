"""Race documents and text built from result tables and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.functions.text import ordinal
from lapforge.operators.ordered import ordered

#: Rows of a document that go into one text row.
PART_ROWS = 4096


def assemble(df: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column, facts: dict[str, Column] | None = None, head: int = 0,
             width: Column | None = None, size: int = PART_ROWS) -> DataFrame:
    """Documents as ordered arrays: keys, ``part``, ``first``, ``items``, ``head`` and the ``facts``.

    ``items`` are ``size`` items at most; a longer document has several parts, and ``first`` is the
    position of a part's first item. With ``width`` (bytes an item takes) ``offset`` is where the
    part starts. ``head`` (the document's first items) and ``facts`` (aggregates over all its rows)
    stand on every part and do not depend on ``size``. While no document is longer than that, one
    aggregate builds them all; longer ones are numbered in blocks and spread over tasks.
    """
    keys, facts = list(keys), facts or {}
    rows = df.withColumns({f"_o{i}": F.col(c) for i, c in enumerate(order)} | {"_item": item, "_w": F.lit(0).cast("long") if width is None else width.cast("long")})
    ranks = [f"_o{i}" for i in range(len(order))]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    whole = [e.alias(n) for n, e in facts.items()]
    if not sizes.where(F.col("_n") > size).limit(1).count():
        listed = F.transform(F.array_sort(F.collect_list(F.struct(*ranks, F.col("_item")))), lambda x: x["_item"])
        d = rows.groupBy(*keys).agg(listed.alias("items"), *whole)
        at = {"part": F.lit(0).cast("long"), "first": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}
        d = d.withColumns(at | {"head": F.slice("items", 1, max(head, 1))})
    else:
        o = ordered(rows, keys, ranks).position("_pos").running(exclusive=True, _at=("sum", "_w"))
        o = o.cols(part=F.floor(F.col("_pos") / size)).cut()
        listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_item"))), lambda x: x["_item"]).alias(c)
        d = o.df.groupBy(*keys, "part").agg(listed("items"), F.min("_pos").alias("first"), F.min(F.coalesce("_at", F.lit(0))).alias("offset"))
        top = o.df.where(F.col("_pos") < max(head, 1)).groupBy(*keys).agg(listed("head"))
        if whole:
            top = top.join(o.df.groupBy(*keys).agg(*whole), keys)
        d = d.join(top, keys)
    return d.select(*keys, "part", "first", "items", *(["head"] if head else []), *(["offset"] if width is not None else []), *facts)


def outcome_text(name: Column, place: Column, points: Column, status: Column, group: Column) -> Column:
    """One sentence on how the race ended for a driver."""
    rank = place.try_cast("int")
    podium = F.when(rank <= 3, " on the podium").otherwise("")
    tail = F.format_string("for %d points.", points)
    finished = F.concat_ws(" ", name, F.concat(F.lit("finished P"), rank.cast("string"), podium), tail)
    lapped = F.concat_ws(" ", name, F.concat(F.lit("was classified P"), rank.cast("string"), podium, F.lit(", laps down,")), tail)
    odd = F.concat_ws(" ", name, F.concat(F.lit("was classified P"), rank.cast("string"), podium, F.lit(" with status "), status), tail)
    why = (F.when(group == "crash", F.concat(F.lit("retired after an incident ("), status, F.lit(")")))
           .when(group == "mechanical", F.concat(F.lit("retired with a "), F.lower(status), F.lit(" issue")))
           .when(group == "fuel", F.concat(F.lit("retired with a fuel problem ("), status, F.lit(")")))
           .when(group == "health", F.concat(F.lit("did not complete the race: "), F.lower(status)))
           .when(group == "admin", F.concat(F.lit("was not classified ("), status, F.lit(")")))
           .otherwise(F.concat(F.lit("did not finish ("), status, F.lit(")"))))
    return F.when(rank.isNotNull() & (group == "finished"), finished).when(rank.isNotNull() & (group == "lapped"), lapped).when(
        rank.isNotNull(), odd).otherwise(F.concat_ws(" ", name, why, tail))


def result_text(year: Column, race: Column, name: Column, team: Column, grid: Column, laps: Column, total: Column, fastest: Column,
                outcome: Column) -> Column:
    """A result as a paragraph; missing pieces drop out."""
    start = F.when(grid.isNull() | (grid == 0), "from an unclassified position").otherwise(F.concat(F.lit("from P"), grid.cast("string")))
    done = F.when(laps > 0, F.format_string("completed %d laps", laps)).otherwise("completed no full lap")
    timed = F.when(total.isNotNull(), F.concat(F.lit("in "), total))
    best = F.when(fastest.isNotNull(), F.concat(F.lit("Fastest lap "), fastest, F.lit("."))).otherwise("No fastest lap recorded.")
    head = F.concat(F.format_string("In the %d ", year), race, F.lit(", "), name, F.lit(" drove for "), team, F.lit(", started "), start, F.lit(","))
    return F.concat_ws(" ", head, F.lit("and"), F.concat(F.concat_ws(" ", done, timed), F.lit(".")), outcome, best)


def standing_text(year: Column, race: Column, name: Column, rank: Column, points: Column, wins: Column) -> Column:
    return F.concat(F.lit("After the "), year.cast("string"), F.lit(" "), race, F.lit(", "), name, F.lit(" is "), ordinal(rank),
                    F.format_string(" with %d points and %d wins.", points, wins))


def entities(**fields: Column) -> Column:
    r"""``key: value`` pairs of the present fields; ``\N`` counts as absent."""
    return F.concat_ws("; ", *[
        F.when(F.nullif(v.cast("string"), F.lit("\\N")).isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items()])


def main_text(html: Column, block: str = "article", skip: str = "Advert |") -> Column:
    """Paragraph text of one content block, tags stripped, advert lines dropped."""
    inner = F.regexp_extract(html, f"(?s)<{block}[^>]*>(.*?)</{block}>", 1)
    cells = F.split(inner, "<p[^>]*>")
    def clean(c):
        s = F.regexp_replace(F.split_part(c, F.lit("</p>"), F.lit(1)), "(?s)<[^>]*>", " ")
        for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            s = F.replace(s, F.lit(name), F.lit(ch))
        return F.trim(F.regexp_replace(s, "[ \t\r\n]+", " "))
    kept = F.filter(F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), clean), lambda p: ~p.startswith(skip) & (p != ""))
    return F.array_join(kept, "\n\n")


def glossary(line: Column) -> tuple[Column, Column]:
    """Term and definition split at the first colon."""
    at = F.instr(line, ":")
    return F.when(at > 0, F.trim(F.substring(line, F.lit(1), at - 1))), F.when(at > 0, F.trim(F.substring(line, at + 1, F.length(line))))


def video_id(url: Column) -> Column:
    # Fixed pattern: eleven id characters after "v=" or "/".
    return F.nullif(F.regexp_extract(url, r"(?:v=|/)([0-9A-Za-z_-]{11})", 1), F.lit(""))


def clock_line(seconds: Column, text: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("[%02d:%02d] %s", F.floor(s / 60), s % 60, text)


def stitched(segments: DataFrame, keys: Sequence[str], start: str, order: str, text: str, size: int = PART_ROWS) -> DataFrame:
    """Segments in order as full text and as clock lines, per document part; ``offset`` is the
    part's first byte in the full text. Parts join with the same blank or line feed as segments."""
    item = F.struct(F.col(text).alias("t"), clock_line(F.col(start), F.col(text)).alias("c"))
    d = assemble(segments, keys, [start, order], item, width=F.octet_length(text) + 1, size=size)
    return d.select(*keys, "part", "offset", F.array_join(F.transform("items", lambda s: s["t"]), " ").alias("full_text"),
                    F.array_join(F.transform("items", lambda s: s["c"]), "\n").alias("clock_text"))
