"""Column helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def held(value: Column) -> Column:
    """``value`` as a one-row generator: the optimiser cannot copy it into later expressions,
    which would evaluate it once for every element of a lambda or a second generator."""
    return F.explode_outer(F.array(value))


def word_rows(rows: DataFrame, text: str, keep: list[str], width: int) -> DataFrame:
    """One row for each run of ``width`` words (column ``term``) of every text.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text of fewer words gives one
    term of all its words; a text without words gives one row whose term is null.
    """
    words = F.filter(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), f"[{SPACE}]+"), lambda w: w != "")
    d = rows.select(*keep, held(words).alias("_w"))
    d = d.select(*keep, "_w", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("_w") - width, F.lit(0)))).alias("_i"))
    parts = [F.get(F.col("_w"), F.col("_i") + j) for j in range(width)]
    return d.select(*keep, F.when(F.size("_w") > 0, F.concat_ws(" ", *parts)).alias("term"))


_PAIR = (1 << 32) | 1
_LOW = (1 << 32) - 1


def vote_sums(bits: Column, weight: Column) -> list[Column]:
    """32 sums that hold the weighted one-votes of all 64 bits, two to a long.

    A lane has 32 bits, so the weights of one text may add up to 2**31 at most; with weights
    of a term's code points that is a text of a thousand million characters.
    """
    return [F.sum(F.shiftrightunsigned(bits, k).bitwiseAND(F.lit(_PAIR)) * weight).alias(f"_s{k}") for k in range(32)]


def majority(total: Column) -> Column:
    """The 64-bit fingerprint from ``vote_sums``: a bit is set when over half the weight has it.

    A text without terms has no votes and the fingerprint zero.
    """
    out = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"_s{k}").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(F.col(f"_s{k}"), 32)
        for votes, at in ((low, k), (high, k + 32)):
            out = out.bitwiseOR(F.when(votes * 2 > total, F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long")))
    return out


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def small_batches(df: DataFrame, rows: int = 256) -> DataFrame:
    """Arrow batches of few rows, as one text can be very long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df
