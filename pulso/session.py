"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, cpus: int | None = None,
                  app: str = "pulso") -> SparkSession:
    """A session configured the way the operators expect.

    * AQE on: shuffle partitions coalesce to ~128 MB, skewed join partitions
      split, small join sides measured at run time are broadcast.
    * Session time zone UTC, so ``to_date`` on instants is a UTC day.
    * UI off (no server is started).

    Locally the initial shuffle width is 2x the cores. On a cluster
    (non-local master) it is left to the deployment, or ``PULSO_SHUFFLE``;
    a wide start (e.g. 4000 for ~100 TB inputs) is safe because AQE
    coalesces small partitions.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    master = master or os.environ.get("PULSO_MASTER") or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    shuffle = os.environ.get("PULSO_SHUFFLE")
    if master.startswith("local"):
        builder = (builder.config("spark.sql.shuffle.partitions", shuffle or str(max(8, cpus * 2)))
                   .config("spark.driver.memory", os.environ.get("PULSO_DRIVER_MEMORY", "16g")))
    elif shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system).
    Only a local-mode session without the setting gets a folder of its own,
    which is what tests do.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder")
        path = tempfile.mkdtemp(prefix="pulso-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for job outputs."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/pulso/{name}-{uuid.uuid4().hex[:12]}"


def reliable_checkpoint(df):
    """``df.checkpoint(eager=True)`` into the shared checkpoint folder (never a
    local checkpoint): the data survive executor loss and the lineage is cut.
    The folder comes from the session (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
