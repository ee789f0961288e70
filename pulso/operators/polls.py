"""Weekly poll alignment.

Polls are weekly and tiny next to posts; the calendar built from them has
one row per day of the poll history. Joins are equi-joins on the target
Sunday (semantically a range match ``poll-6 <= d <= poll``); the join
strategy is left to AQE, which broadcasts the side it measures as small at
run time and keeps a sort-merge join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import target_sunday, week_start

POLL_TARGETS = ("aprobacion", "desaprobacion")


def poll_calendar(polls: DataFrame, targets=POLL_TARGETS) -> DataFrame:
    """Every day from the first poll to the last poll + 6 days, with the
    poll of its week-ending Sunday (left join; polls not dated on a Sunday
    never match; two polls on one Sunday fan out)."""
    bounds = polls.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", F.date_add("hi", 6))).alias("date"))
    days = days.withColumn("_target", target_sunday("date"))
    p = polls.select(F.col("date").alias("_target"), *targets)
    return days.join(p, "_target", "left").select("date", *targets)


def with_polls(daily: DataFrame, calendar: DataFrame, targets=POLL_TARGETS) -> DataFrame:
    """Daily rows left-joined to the expanded poll calendar by day."""
    return daily.join(calendar.select("date", *targets), "date", "left")


def week_start_join(daily: DataFrame, polls: DataFrame, targets=POLL_TARGETS) -> DataFrame:
    """Monday-week alignment; both sides keyed by their week's Monday."""
    d = daily.withColumn("week_start", week_start("date"))
    p = polls.select(week_start("date").alias("week_start"), *targets)
    return d.join(p, "week_start", "left")
