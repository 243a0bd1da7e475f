"""Values as a dashboard shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_time(time: Column, now: Column) -> Column:
    """``just now``, minutes, hours or days ago."""
    seconds = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(time))
    unit = lambda n, name: F.concat(F.floor(seconds / n).cast("string"), F.lit(f" {name}"), F.when(F.floor(seconds / n) == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3_600, unit(60, "minute")).when(seconds < 86_400, unit(3_600, "hour")).otherwise(unit(86_400, "day"))


def compact_number(n: Column) -> Column:
    """One decimal of thousands or millions; smaller numbers as they are."""
    short = lambda by, mark: F.concat(F.regexp_replace(F.format_string("%.1f", F.round(n / by, 1)), r"\.0$", ""), F.lit(mark))
    return F.when(n < 1_000, n.cast("string")).when(n < 1_000_000, short(1_000, "K")).otherwise(short(1_000_000, "M"))


def sentence_case(text: Column) -> Column:
    words = F.replace(text, F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, F.lit(2), F.length(words)))


def duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    rest = F.concat((F.floor(seconds) % 60).cast("string"), F.lit(" s"))
    return F.when(minutes == 0, rest).otherwise(F.concat(minutes.cast("string"), F.lit(" min "), rest))


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence >= 80, "high").when(confidence >= 50, "medium").otherwise("low")


def stale(time: Column, now: Column, hours: int = 2) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(time) > hours * 3_600
