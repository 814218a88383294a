"""Text and format helpers: lap times, dates, ordinals, JSON numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lap_text(seconds: Column) -> Column:
    """Seconds as ``M:SS.mmm``."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def lap_seconds(text: Column) -> Column:
    """``M:SS.mmm`` or ``SS.mmm`` as seconds; NULL when it does not parse."""
    parts = F.split(text, ":")
    two = F.size(parts) == 2
    minutes = F.when(two, F.get(parts, 0).try_cast("double")).otherwise(F.lit(0.0))
    rest = F.when(two, F.get(parts, 1)).otherwise(F.get(parts, 0)).try_cast("double")
    return minutes * 60 + rest


def lap_words(text: Column) -> Column:
    """``1:29.639`` as ``1 minute 29.639 seconds``."""
    parts = F.split(text, ":")
    return F.concat(F.get(parts, 0), F.lit(" minute "), F.get(parts, 1), F.lit(" seconds"))


def duration_text(ms: Column) -> Column:
    """Milliseconds as ``Hh Mm Ss``, truncated."""
    s = F.floor(ms / 1000)
    return F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def long_date(text: Column) -> Column:
    """``2009-03-29`` as ``29 March 2009``; other text passes through."""
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return F.coalesce(F.date_format(day, "d MMMM yyyy"), text)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th ... with the regular 11th-13th and 21st forms."""
    ten, unit = n % 100, n % 10
    suffix = (
        F.when(ten.between(11, 13), "th").when(unit == 1, "st").when(unit == 2, "nd")
        .when(unit == 3, "rd").otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def number(text: Column) -> Column:
    """Numeric strings as doubles, anything else NULL."""
    return F.trim(text).try_cast("double")
