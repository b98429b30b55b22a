"""Dates and figures as printed text, and instants with their zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in Albanian and English.
ALBANIAN_MONTHS = "janar shkurt mars prill maj qershor korrik gusht shtator tetor nëntor dhjetor".split()
ENGLISH_MONTHS = "January February March April May June July August September October November December".split()


def spelled_date(day: Column) -> Column:
    """``2025-05-03 (3 maj 2025 / 3 May 2025)`` of a date."""
    part = lambda names: F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(F.array(*map(F.lit, names)), F.month(day)), F.year(day).cast("string"))
    return F.when(day.isNotNull(), F.concat(day.cast("string"), F.lit(" ("), part(ALBANIAN_MONTHS), F.lit(" / "), part(ENGLISH_MONTHS), F.lit(")")))


def printed_figure(value: Column) -> Column:
    """Two decimals without trailing zeros; ``not published`` for null."""
    printed = F.regexp_replace(F.format_string("%.2f", F.bround(value, 2)), r"\.?0+$", "")
    return F.when(value.isNotNull(), printed).otherwise("not published")


def instant(text: Column) -> Column:
    """The instant of an ISO timestamp that states its zone; null for others."""
    stated = F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(stated, F.try_to_timestamp(F.trim(text)))


def seconds_until_reset(epoch: Column, window: int) -> Column:
    """Seconds, at least 1, until the fixed window of an instant ends."""
    return F.greatest(F.lit(1), F.floor(F.lit(window) - (epoch - F.floor(epoch / window) * window)) + 1).cast("bigint")
