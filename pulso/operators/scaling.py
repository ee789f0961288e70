"""Robust and min-max scaling.

Fitting is one global aggregate (an action returning one small row per
column, like an ML estimator's ``fit``); applying is column arithmetic with
literals, so it stays inside whole-stage codegen and needs no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..session import reliable_checkpoint
from ..sources.tables import require_columns

QUARTILES = (0.25, 0.5, 0.75)


@dataclass(frozen=True)
class RobustStats:
    """Per column: median and inter-quartile range (0 replaced by 1)."""
    median: dict
    iqr: dict

    def center(self, c: str) -> float:
        return self.median[c]

    def scale(self, c: str) -> float:
        return self.iqr[c]


# Buckets that an interval is cut into in each pass of ``quantiles``.
BUCKETS = 1024


def values(df: DataFrame, cols, by=()) -> DataFrame:
    """``(by..., column, value, n)``: every non-null, non-NaN value of ``cols`` as a row
    of weight 1."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.nanvl(
        F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c in cols])
    return (df.select(*by, F.explode(each).alias("_p")).where("_p.value IS NOT NULL")
            .select(*by, "_p.column", "_p.value", F.lit(1).cast("long").alias("n")))


def value_counts(df: DataFrame, cols, by=()) -> DataFrame:
    """How often each value of each column occurs, ``(by..., column, value, n)``: one pass,
    combined map-side. The counts of two sets of rows add up to those of their union
    (``merge_value_counts``), so they are a state from which quantiles stay exact."""
    return values(df, cols, by).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_value_counts(*tables: DataFrame, by=()) -> DataFrame:
    """The counts of all rows that the tables stand for. ``by=()`` merges over days too."""
    key = [*by, "column", "value"]
    both = None
    for t in tables:
        t = t.select(*key, "n")
        both = t if both is None else both.unionByName(t)
    return both.groupBy(*key).agg(F.sum("n").alias("n"))


def quantiles(weighted: DataFrame, cols, probs) -> dict:
    """Exact linear-interpolated quantiles per column of ``(column, value, n)`` rows:
    ``{column: [value, ...]}``, null without values. A value may have several rows.

    Every wanted rank starts with the interval [min, max]; a pass sums the weights of its
    interval in ``BUCKETS`` buckets, with each bucket's own least and largest value, and the
    interval shrinks to the bucket that holds the rank, until it is one value. Integer counts
    take two or three passes. What reaches the driver is at most ``BUCKETS`` rows per open rank.
    """
    cols = list(cols)
    ends = {x.column: x for x in weighted.groupBy("column").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("n")).collect()}
    wanted, found, goal = {}, {}, {}
    for c in cols:
        if c not in ends:
            goal[c] = ()
            continue
        e = ends[c]
        goal[c] = [p * (e.n - 1) for p in probs]
        for rank in {r for g in goal[c] for r in (int(g), min(int(g) + 1, e.n - 1))}:
            wanted[c, rank] = (e.lo, e.hi, 0)            # interval, weight before it
    while True:
        found |= {k: v[0] for k, v in wanted.items() if v[0] == v[1]}
        wanted = {k: v for k, v in wanted.items() if v[0] != v[1]}
        if not wanted:
            break
        spans = sorted({(c, *v) for (c, _), v in wanted.items()})    # apart, within a column
        place = F.lit(None).cast("struct<i:int,b:bigint>")
        for i, (c, lo, hi, _) in enumerate(spans):
            bucket = F.least(F.floor((F.col("value") - F.lit(lo)) * F.lit(BUCKETS) / F.lit(hi - lo)),
                             F.lit(BUCKETS - 1))
            place = F.when((F.col("column") == c) & F.col("value").between(F.lit(lo), F.lit(hi)),
                           F.struct(F.lit(i).alias("i"), bucket.cast("long").alias("b"))).otherwise(place)
        got = (weighted.select(place.alias("p"), "value", "n").where("p IS NOT NULL")
               .groupBy("p.i", "p.b").agg(F.sum("n").alias("n"), F.min("value").alias("lo"),
                                          F.max("value").alias("hi")).collect())
        for (c, rank), v in list(wanted.items()):
            before = v[2]
            for g in sorted((g for g in got if g.i == spans.index((c, *v))), key=lambda g: g.b):
                if before + g.n > rank:
                    wanted[c, rank] = (g.lo, g.hi, before)
                    break
                before += g.n
    out = {}
    for c in cols:
        out[c] = [None] * len(probs)
        for k, g in enumerate(goal[c]):
            a, b = found[c, int(g)], found.get((c, int(g) + 1), found[c, int(g)])
            out[c][k] = a + (b - a) * (g - int(g))
    return out


def order_statistics(df: DataFrame, cols, probs) -> dict:
    """``quantiles`` of the columns of ``df``, whatever the number of rows or distinct
    values. Integer columns are counted by value in one pass over ``df`` and ranked on the
    counts, which are written; others take a pass over ``df`` for each step."""
    whole = [f.name for f in df.schema.fields if f.name in set(cols) and isinstance(f.dataType, IntegralType)]
    rest = [c for c in cols if c not in whole]
    out = quantiles(reliable_checkpoint(value_counts(df, whole)), whole, probs) if whole else {}
    return out | (quantiles(values(df, rest), rest, probs) if rest else {})


def robust_of_quartiles(quartiles: dict) -> RobustStats:
    """Median and inter-quartile range (0 as 1; a column without values: 0 and 1)."""
    med, iqr = {}, {}
    for c, q in quartiles.items():
        if q[1] is None:
            med[c], iqr[c] = 0.0, 1.0
            continue
        med[c] = float(q[1])
        spread = float(q[2]) - float(q[0])
        iqr[c] = spread if spread != 0 else 1.0
    return RobustStats(med, iqr)


def fit_robust_counts(counts: DataFrame, cols) -> RobustStats:
    """X13 fit from stored ``value_counts`` (of any number of days or batches): exact
    quartiles without a pass over the rows behind them."""
    return robust_of_quartiles(quantiles(counts, cols, QUARTILES))


def fit_robust(df: DataFrame, cols, approx: bool = False, accuracy: int = 100000) -> RobustStats:
    """X13 fit: linear-interpolated quartiles per column (nulls and NaN skipped).

    Exact at any size (``order_statistics``); ``approx=True`` asks for
    ``percentile_approx`` with the given accuracy in one pass instead.
    """
    cols = list(cols)
    require_columns(df, cols)
    if not cols:
        return RobustStats({}, {})
    if approx:
        row = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")),
                                           list(QUARTILES), accuracy).alias(c) for c in cols]).first()
        return robust_of_quartiles({c: row[c] or [None] * 3 for c in cols})
    return robust_of_quartiles(order_statistics(df, cols, QUARTILES))


def robust_scale(df: DataFrame, stats: RobustStats, cols=None) -> DataFrame:
    """X13 apply: ``(x - median) / IQR``; nulls stay null."""
    cols = list(cols or stats.median)
    return df.withColumns({
        c: (F.col(c).cast("double") - F.lit(stats.median[c])) / F.lit(stats.iqr[c])
        for c in cols})


@dataclass(frozen=True)
class MinMaxStats:
    lo: dict
    hi: dict


def fit_minmax(df: DataFrame, cols) -> MinMaxStats:
    """X14 fit: min and max per column over ``df`` (the training part)."""
    cols = list(cols)
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in cols],
                 *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in cols]).first()
    return MinMaxStats({c: row[f"lo_{c}"] for c in cols}, {c: row[f"hi_{c}"] for c in cols})


def minmax_scale(df: DataFrame, stats: MinMaxStats, cols=None) -> DataFrame:
    """X14 apply: ``(x - min) / (max - min)``; a constant column maps to 0."""
    cols = list(cols or stats.lo)
    out = {}
    for c in cols:
        lo, hi = stats.lo[c], stats.hi[c]
        span = (hi - lo) if (lo is not None and hi is not None and hi != lo) else 1.0
        out[c] = (F.col(c).cast("double") - F.lit(lo if lo is not None else 0.0)) / F.lit(span)
    return df.withColumns(out)


def minmax_inverse(df: DataFrame, stats: MinMaxStats, col: str, out: str | None = None,
                   source: str | None = None) -> DataFrame:
    """X14 inverse for one column: ``x * (max - min) + min``."""
    lo, hi = stats.lo[col], stats.hi[col]
    span = (hi - lo) if (lo is not None and hi is not None and hi != lo) else 1.0
    src = F.col(source or col)
    return df.withColumn(out or col, src * F.lit(span) + F.lit(lo if lo is not None else 0.0))

