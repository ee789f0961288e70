"""Report indicators (W6, W7, J11, F9, A11, A12, X15; pipeline P6).

The report reads the newest rows of a daily table. Everything is per key
(``keys=()`` is the national series): ``row_number() <= n`` is planned with a
partial ``WindowGroupLimit`` before the shuffle, so each map task forwards at
most ``n`` rows per key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import lit_date


def indicator_columns(name: str, value: Column, prev: Column, scale: float = 100.0) -> list[Column]:
    """X15 numbers of one metric: value in percent, delta in points, direction
    (``up`` iff the delta is > 0, null without a previous value) and the bar
    length clamped at 100."""
    delta = (value - prev) * F.lit(scale)
    return [
        (value * F.lit(scale)).alias(f"{name}_value_pct"),
        delta.alias(f"{name}_delta_pp"),
        F.when(delta.isNull(), F.lit(None).cast("string"))
         .when(delta > 0, F.lit("up")).otherwise(F.lit("down")).alias(f"{name}_direction"),
        # least() skips nulls: guard so that a missing value has no bar
        F.when(value.isNotNull(), F.least(value * F.lit(scale), F.lit(100.0))).alias(f"{name}_bar_pct"),
    ]


def kpi_latest(df: DataFrame, cols, keys=(), default_missing: float = 0.0) -> DataFrame:
    """W6 + X15: per key, the newest row by date against the row before it.

    A metric column absent from ``df`` counts as ``default_missing`` (the
    report's default); a single row gives null deltas.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    present = {c: (F.col(c).cast("double") if c in df.columns else F.lit(default_missing))
               for c in cols}
    two = (df.where(F.col("date").isNotNull())
           .select(*keys, "date", *[v.alias(c) for c, v in present.items()])
           .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2))
    agg = two.groupBy(*keys).agg(
        F.max("date").alias("date"),
        *[F.max(F.when(F.col("_rn") == 1, F.col(c))).alias(f"_last_{c}") for c in cols],
        *[F.max(F.when(F.col("_rn") == 2, F.col(c))).alias(f"_prev_{c}") for c in cols],
        F.max(F.when(F.col("_rn") == 2, F.col("date"))).alias("previous_date"),
    )
    out = [F.col(k) for k in keys] + [F.col("date"), F.col("previous_date")]
    for c in cols:
        out += indicator_columns(c, F.col(f"_last_{c}"), F.col(f"_prev_{c}"))
    return agg.select(*out)


def kpi_prev_calendar_day(df: DataFrame, cols, keys=()) -> DataFrame:
    """Each day's value against the previous *calendar* day (a self-join
    on ``date - 1``); a missing previous day gives a null delta."""
    prev = df.select(*keys, F.date_add("date", 1).alias("date"),
                     *[F.col(c).alias(f"_prev_{c}") for c in cols])
    j = df.select(*keys, "date", *cols).join(prev, [*keys, "date"], "left")
    out = [F.col(k) for k in keys] + [F.col("date")]
    for c in cols:
        out += [F.col(c), (F.col(c) - F.col(f"_prev_{c}")).alias(f"{c}_delta")]
    return j.select(*out)


def last_valid(df: DataFrame, col: str, day, n: int = 7, keys=()) -> DataFrame:
    """The newest ``n`` rows up to ``day`` (inclusive) with a non-null ``col``."""
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    base = df.where((F.col("date") <= lit_date(day)) & F.col(col).isNotNull())
    return (base.select(*keys, "date", col).withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= n).drop("_rn"))


def date_range(df: DataFrame, start, end, floor=None, col: str = "date") -> DataFrame:
    """F2 + F3: ``start <= date <= end`` and, optionally, ``date >= floor``.
    A start after the end is rejected. Literal bounds push to the scan."""
    s, e = (dt.date.fromisoformat(x) if isinstance(x, str) else x for x in (start, end))
    if s > e:
        raise ValueError("date range: start is after end")
    cond = F.col(col).between(F.lit(s), F.lit(e))
    if floor is not None:
        f = dt.date.fromisoformat(floor) if isinstance(floor, str) else floor
        cond = cond & (F.col(col) >= F.lit(f))
    return df.where(cond)


def comparison_series(pred: DataFrame, polls: DataFrame, start, end, floor=None,
                      series=("prediccion_aprobacion", "prediccion_desaprobacion",
                              "aprobacion", "desaprobacion")) -> DataFrame:
    """the chosen prediction and poll series in the date range, melted to
    long form ``(date, serie, valor)`` for one chart axis."""
    parts = []
    for src in (pred, polls):
        chosen = [c for c in series if c in src.columns]
        if not chosen:
            continue
        ranged = date_range(src, start, end, floor).select(
            "date", *[F.col(c).cast("double").alias(c) for c in chosen])
        parts.append(ranged.unpivot("date", chosen, "serie", "valor"))
    if not parts:
        raise ValueError("comparison_series: no chosen series in the inputs")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def series_bounds(df: DataFrame, col: str = "date", keys=()) -> DataFrame:
    """First and last day (and days present) per key."""
    return df.groupBy(*keys).agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"),
                                 F.count_distinct(col).alias("n_days"))


def distinct_days(df: DataFrame, col: str = "date") -> DataFrame:
    """The distinct non-null days."""
    return df.where(F.col(col).isNotNull()).select(F.col(col).alias("date")).distinct()
