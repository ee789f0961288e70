"""Incremental state: append with dedup, day upsert, pending/missing days,
month windows, processed flags (S3-S13, A16).

Dedup uses the least row in an aggregate rather than ``row_number`` over a window:
the partial aggregate (Spark plans it as a sort aggregate, its buffer being a
struct) keeps one row per key per map task before the shuffle, so a key holding
a third of all rows never lands whole in one task. Keep the rows narrow.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_sequence, lit_date


def dedup_first(df: DataFrame, key="id", order=()) -> DataFrame:
    """Keep the first row per key by ``order`` (ascending columns).

    ``order`` must make the choice deterministic; ties beyond it are broken by
    the full row so the result does not depend on partitioning.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    # the rank holds the row: taken by itself it is sent once, by ``min_by`` it would be twice
    rank = [*order, *[c for c in rest if c not in order]]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(rank)])).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[f"_{i}"].alias(c) for i, c in enumerate(rank) if c in rest]).select(*df.columns)


def append_dedup(existing: DataFrame | None, new: DataFrame, key="id", order=(),
                 existing_unique: bool = True) -> DataFrame:
    """S3: union by name (missing columns null), keep the first row per key with
    existing rows winning. The first batch is deduplicated as well (the
    reference stores it as it is and mends it on the next append), so the stored
    table is unique by key from the start. Null keys are equal to each other, as
    in pandas.

    The stored table is kept unique by key (this operator's own invariant),
    so only the new batch is deduplicated, in one aggregate with the stored
    keys, which win: the new rows are shuffled once, of the stored rows only the key
    column is. With
    ``existing_unique=False`` both sides go through one ``min_by`` aggregate.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if existing is None:
        return dedup_first(new, keys, order=order)
    if existing_unique:
        stored = existing.select(*keys, F.lit(0).alias("_prio"))
        known = new.withColumn("_prio", F.lit(1)).unionByName(stored, allowMissingColumns=True)
        fresh = dedup_first(known, keys, order=("_prio", *order)).where("_prio = 1").select(*new.columns)
        return existing.unionByName(fresh, allowMissingColumns=True)
    both = (existing.withColumn("_prio", F.lit(0))
            .unionByName(new.withColumn("_prio", F.lit(1)), allowMissingColumns=True))
    cols = [c for c in both.columns if c != "_prio"]
    return dedup_first(both, keys, order=("_prio", *order)).select(*cols)


def replace_days(existing: DataFrame | None, fresh: DataFrame, col: str = "date", keys=()) -> DataFrame:
    """Drop existing rows whose (keys, day) is in ``fresh``, then append ``fresh``.

    The distinct fresh days are one row per day; AQE broadcasts them when small.
    """
    if existing is None:
        return fresh
    touched = fresh.select(*keys, col).distinct()
    kept = existing.join(touched, [*keys, col], "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def pending_days(df: DataFrame, today, cold_start: int = 3, col: str = "date") -> DataFrame:
    """Days after the last stored day up to ``today``; an empty table gives
    the last ``cold_start`` days ending today. ``today`` may be a date or an
    aggregate Column over ``df`` (e.g. ``F.date_add(F.max("date"), 4)``)."""
    b = df.agg(F.max(col).alias("_last"), lit_date(today).alias("_today"))
    seq = F.when(F.col("_last").isNull(),
                 day_sequence(F.date_sub("_today", cold_start - 1), "_today")
                 ).otherwise(day_sequence(F.date_add("_last", 1), "_today"))
    return b.select(F.explode(seq).alias(col))


def missing_days(spark: SparkSession, start, today, done: DataFrame, col: str = "date") -> DataFrame:
    """Every day in [start, today] not present in ``done``."""
    days = spark.range(1).select(F.explode(day_sequence(lit_date(start), lit_date(today))).alias(col))
    return days.join(done.select(col).distinct(), col, "left_anti")


def month_windows_of(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Tile [start, end) of each bounds row in one-month steps, last clamped.

    Steps are taken from the origin (``add_months(start, i)``), so 31 Jan ->
    29 Feb -> 31 Mar. start >= end raises at run time.
    """
    s, e = F.col(start), F.col(end)
    checked = bounds.withColumn(
        "_n", F.when(s < e, F.ceil(F.months_between(e, s)).cast("int"))
        .otherwise(F.raise_error(F.lit("month windows: start must be before end"))))
    steps = checked.select(s.alias("_s"), e.alias("_e"),
                           F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("_i"))
    w = steps.select(F.add_months("_s", F.col("_i")).alias("window_start"),
                     F.least(F.add_months("_s", F.col("_i") + 1), F.col("_e")).alias("window_end"),
                     F.col("_e"))
    return w.where(F.col("window_start") < F.col("_e")).drop("_e")


def month_windows(spark: SparkSession, start, end) -> DataFrame:
    """S8 with literal bounds; start >= end is an error."""
    s = dt.date.fromisoformat(start) if isinstance(start, str) else start
    e = dt.date.fromisoformat(end) if isinstance(end, str) else end
    if s >= e:
        raise ValueError("month windows: start must be before end")
    return month_windows_of(spark.range(1).select(F.lit(s).alias("start"), F.lit(e).alias("end")))


def unprocessed(df: DataFrame, col: str = "processed") -> DataFrame:
    """Rows with ``processed == False``; absent column counts as False;
    null is excluded (as the pandas comparison does)."""
    if col not in df.columns:
        return df
    return df.where(~F.col(col))


def mark_processed(raw: DataFrame, done: DataFrame, key: str = "id", col: str = "processed",
                   mark_dropped: bool = False) -> DataFrame:
    """Set the flag True for ids present in ``done`` (the rows that
    survived cleaning); other rows keep their flag, so dropped rows are
    retried next run, as in the reference. ``mark_dropped=True`` flags every
    pending row, so that rows dropped by cleaning are not tried again."""
    if mark_dropped:
        base = raw if col in raw.columns else raw.withColumn(col, F.lit(False))
        return base.withColumn(col, F.when(F.col(col).isNotNull(), F.lit(True)))
    hits = done.select(key).distinct().withColumn("_hit", F.lit(True))
    base = raw if col in raw.columns else raw.withColumn(col, F.lit(False))
    out = base.join(hits, key, "left")
    return out.withColumn(col, F.when(F.col("_hit"), F.lit(True)).otherwise(F.col(col))) \
              .select(*base.columns)


def reset_processed(df: DataFrame, col: str = "processed") -> DataFrame:
    """Recreate the flag as False for every row."""
    return df.withColumn(col, F.lit(False))


def stage_quality(df: DataFrame, stage: str, date_col: str = "date") -> DataFrame:
    """Rows, distinct days and null days of one stage (one aggregate)."""
    d = F.col(date_col)
    return df.agg(F.lit(stage).alias("stage"),
                  F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(d).alias("n_days"),
                  F.count_if(d.isNull()).alias("n_null_days"))

