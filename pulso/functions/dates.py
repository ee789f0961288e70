"""Date and timestamp column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_created_at(c: ColumnOrName) -> Column:
    """Parse ISO or ``Wed Apr 16 13:05:00 +0000 2025`` strings; bad -> null.

    The result is a ``timestamp_ntz`` holding the wall clock of the session
    time zone (UTC under ``build_session``); zone-less ISO strings keep their
    wall clock in any zone. Spark 4 refuses the weekday pattern when parsing,
    so the leading ``EEE `` is dropped first.
    """
    s = F.trim(_c(c).cast("string"))
    iso = F.try_to_timestamp(s)
    api = F.try_to_timestamp(F.substring(s, 5, 1 << 16), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.coalesce(iso, api).cast("timestamp_ntz")


def post_date(c: ColumnOrName) -> Column:
    """The UTC calendar day of a timestamp (or of a ``timestamp_ntz``)."""
    return F.to_date(_c(c))


def target_sunday(c: ColumnOrName) -> Column:
    """The Sunday ending the Monday-based week of ``c`` (``d + 6 - weekday``)."""
    d = F.to_date(_c(c))
    return F.date_add(d, F.lit(6) - F.weekday(d))


def week_start(c: ColumnOrName) -> Column:
    """Monday of the week of ``c``."""
    return F.to_date(F.date_trunc("week", F.to_date(_c(c))))


def day_sequence(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Days from ``start`` to ``end`` inclusive; empty when start > end.

    Spark's ``sequence`` counts downwards when start > end, hence the guard.
    """
    s, e = F.to_date(_c(start)), F.to_date(_c(end))
    return F.when(s <= e, F.sequence(s, e)).otherwise(F.array().cast("array<date>"))


def lit_date(d) -> Column:
    """A date literal from a date or ISO string; a column stays as it is."""
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = dt.date.fromisoformat(d)
    return F.lit(d).cast("date")
