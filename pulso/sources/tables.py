"""Table I/O and row filters.

Tables are Parquet directories by default (columnar, predicate and column
pruning at the scan); CSV is supported as a source and a sink because the
reference stores CSV objects. Spark cannot overwrite a path it is reading
in the same plan, so a job that updates a stored table writes a new folder
(``session.scratch_path``) and points readers at it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.dates import parse_created_at


# Microsecond timestamps survive a CSV round trip (Spark's default keeps ms).
CSV_TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def schema_of(df: DataFrame) -> StructType:
    return df.schema


def require_columns(df: DataFrame, cols) -> None:
    """raise if any of ``cols`` is absent (a schema check, no job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """An empty typed table (first run, nothing stored yet)."""
    return spark.createDataFrame([], schema)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float and double columns as null (pandas skips NaN; Spark's
    aggregates and null tests do not)."""
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in cols}) if cols else df


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def read_table(spark: SparkSession, path: str, schema: StructType | None = None,
               fmt: str = "parquet", date_cols=(), ts_cols=(),
               missing_ok: bool = False) -> DataFrame:
    """Read a stored table with an explicit schema.

    CSV is read with a header in PERMISSIVE mode; ``date_cols`` are coerced
    to ``date`` and ``ts_cols`` parsed (bad values become null). A missing
    path raises unless ``missing_ok``, then an empty typed table is returned.
    """
    if not path_exists(spark, path):
        if missing_ok and schema is not None:
            return empty(spark, schema)
        raise FileNotFoundError(path)
    if fmt == "csv":
        reader = spark.read.options(header="true", mode="PERMISSIVE", **CSV_TIME_FORMATS)
        if schema is not None:
            # read dates/timestamps as text, then coerce, so bad values become null
            raw = StructType([StructField(f.name, StringType(), True)
                              if f.name in (*date_cols, *ts_cols) else f
                              for f in schema.fields])
            reader = reader.schema(raw)
        df = reader.csv(path)
    else:
        df = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    conv = {}
    for c in date_cols:
        if c in df.columns:
            conv[c] = F.coalesce(F.try_to_date(F.col(c).cast("string")),
                                 F.to_date(parse_created_at(c)))
    for c in ts_cols:
        if c in df.columns:
            conv[c] = parse_created_at(c)
    if conv:
        df = df.withColumns(conv)
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return nan_to_null(df)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=(), compression: str | None = None) -> str:
    """Write a whole table (overwrite by default). With ``partition_by``
    (e.g. ``date``) and ``spark.sql.sources.partitionOverwriteMode=dynamic``
    only the touched partitions are replaced. ``compression``: the session's by default."""
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(header="true", **CSV_TIME_FORMATS).csv(path)
    else:
        w.parquet(path)
    return path


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def write_observed(df: DataFrame, path: str, stage: str, day="date", **kw) -> dict:
    """S2 and S15 in one pass: write ``df`` (``write_table`` options in ``kw``) and return
    ``{stage, n_rows, n_days, n_null_days}``, measured on the rows as they are written. ``day`` is
    a column or an expression; the days are gathered as a set, one entry per day."""
    d = F.col(day) if isinstance(day, str) else day
    seen = Observation(f"quality-{stage}")
    write_table(df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.size(F.collect_set(d)).alias("n_days"),
                           F.count_if(d.isNull()).alias("n_null_days")), path, **kw)
    return {"stage": stage, **seen.get}


def quality_table(spark: SparkSession, measured: list) -> DataFrame:
    """What ``write_observed`` measured, a row per stage."""
    return spark.createDataFrame(
        [(m["stage"], m["n_rows"], m["n_days"], m["n_null_days"]) for m in measured],
        "stage string, n_rows long, n_days long, n_null_days long")


def complete_rows(df: DataFrame, cols) -> DataFrame:
    """drop rows with a null in any of ``cols``."""
    return df.na.drop(how="any", subset=list(cols))


def posts_of_day(df: DataFrame, day, col: str = "date") -> DataFrame:
    """rows of one calendar day (an equality on the day / partition column)."""
    d = dt.date.fromisoformat(day) if isinstance(day, str) else day
    return df.where(F.col(col) == F.lit(d))


def lang_filter(df: DataFrame, lang: str, col: str = "lang") -> DataFrame:
    """rows of one language."""
    return df.where(F.col(col) == F.lit(lang))
