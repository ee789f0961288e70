"""Query catalogue: Spark callables and their DuckDB oracle SQL.

Each entry is ``(spark, sf_dir) -> DataFrame``. Oracle SQL reads the
pre-registered tables and recomputes the fixture views as CTEs. Every
computed double is rounded to 6 digits on both sides; integer outputs are
BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str | Callable[[], str]] = {}
HEADLINE: list[str] = []

DIGITS = 6
# Values that sit exactly on a rounding half (common for ratios of small
# integers) would round differently when two engines sum in different
# orders; a relative nudge far below the kept digits makes both agree.
NUDGE = 1.000000000001


def register(name: str, sql: str | Callable[[], str] | None = None, headline: bool = False):
    """Register a query; ``sql`` may be a callable, built only when the oracle
    strings are asked for."""
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def r_col(c, digits: int = DIGITS):
    """``c`` rounded (nudged, see NUDGE); adding 0.0 makes a negative zero positive, which
    the engines' ``round`` don't agree on."""
    return F.round(c.cast("double") * F.lit(NUDGE), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round double/float columns (nudged, see NUDGE) and widen ints to bigint."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(r_col(F.col(f.name), digits).alias(f.name))
        elif isinstance(f.dataType, IntegerType):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def with_ctes(body: str, **ctes: str) -> str:
    """``WITH a AS (...), b AS (...) body`` in the given order."""
    if not ctes:
        return body
    parts = ",\n".join(f"{k} AS (\n{v.strip()}\n)" for k, v in ctes.items())
    return f"WITH {parts}\n{body}"


def r(expr: str, digits: int = DIGITS) -> str:
    return f"(round(CAST({expr} AS DOUBLE) * CAST({NUDGE!r} AS DOUBLE), {digits}) + CAST(0.0 AS DOUBLE))"
