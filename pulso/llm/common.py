"""Small helpers shared by the operators: tables, batch size, written cuts."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

#: Rows per Arrow batch sent to Python, so that batches of long texts stay small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` (never raise it): plans
    read the setting when they run, after the operator has returned them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs run inside; the session's own
    setting holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder that the session names and
    read it back: the lineage is cut, a lost executor costs no recomputation,
    and both sides of a later join are plain scans that AQE can split."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made, when nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def platt(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of a logistic curve from scores to probabilities (Newton
    steps on Platt's smoothed targets). ``n``: how often each score counts."""
    n = np.ones(len(z)) if n is None else n
    pos, neg = (n * y).sum(), (n * (1 - y)).sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b).clip(-30, 30)))
        d, h = n * (p - goal), n * (p * (1 - p) + 1e-9)
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(d * z).sum(), d.sum()]))
        a, b = float(a - step[0].clip(-2, 2)), float(b - step[1].clip(-2, 2))
    return (a, b) if a > 0 else (1.0, 0.0)
