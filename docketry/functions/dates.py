"""Dates of exported messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, squeeze

#: Weekday names that may lead a date and the formats tried in order after them.
WEEKDAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
LONG_FORMATS = ("MMMM d, yyyy h:mm a", "MMMM d, yyyy h:mm:ss a")
PLAIN_FORMATS = ("MMMM d, yyyy h:mm a", "M/d/yyyy h:mm a", "M/d/yy h:mm a")
ZONE = "America/New_York"


def sent_utc(c: Column | str) -> Column:
    """Local wall time of an export header as a UTC timestamp, null if no format fits.

    The weekday need not match the date. Two-digit years from 69 on are of the last century.
    """
    v = squeeze(col(c))
    day = rf"^(?i:(?:{WEEKDAYS})), "
    rest = F.regexp_replace(v, day, "")
    long = [F.when(v.rlike(day), F.try_to_timestamp(rest, F.lit(f))) for f in LONG_FORMATS]
    plain = [F.try_to_timestamp(v, F.lit(f)) for f in PLAIN_FORMATS[:2]]
    short = F.when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{2} "), F.try_to_timestamp(v, F.lit(PLAIN_FORMATS[2])))
    short = F.when(F.year(short) >= 2069, short - F.expr("INTERVAL 100 YEARS")).otherwise(short)
    local = F.coalesce(*long, plain[0], F.when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{4} "), plain[1]), short)
    return F.to_utc_timestamp(local, ZONE)


def gap_over(later: Column, earlier: Column, days: int) -> Column:
    """More than so many days apart, to the microsecond; null if either is null."""
    return F.unix_micros(later) - F.unix_micros(earlier) > F.lit(days * 86_400_000_000)
