"""Tables that are replaced as a whole without a moment in which they are gone.

A table is a folder with data folders and a commit log::

    path/data-<uuid>/...            one version's rows (Parquet)
    path/_commits/0000000007        version 7: the name of its data folder

A writer writes a new data folder and then creates the next commit file, which is one
exclusive create of a small file: readers that resolve the table before it see the old
version, whole, and readers after it the new one. A job that dies before the commit leaves a
folder that nobody reads; ``vacuum`` removes it. A table may be replaced by what is computed
from it, since the old files stay. Two writers that start from the same version cannot both
commit: the second raises ``CommitConflict`` and its folder is never seen.

All file operations go through Hadoop's file system API, so the folder may lie wherever
Spark reads and writes.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

COMMITS = "_commits"


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str) -> list:
    fs, p = _fs(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def commits(spark: SparkSession, path: str) -> dict[int, str]:
    """Committed numbers and what their markers hold. A marker without its closing line
    (its writer died while writing it) does not count."""
    out = {}
    for f in _children(spark, f"{path}/{COMMITS}"):
        name = f.getPath().getName()
        if name.isdigit():
            fs, p = _fs(spark, f.getPath().toString())
            stream = fs.open(p)
            try:
                body = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if body.endswith("\n"):
                out[int(name)] = body[:-1]
    return out


def commit(spark: SparkSession, path: str, number: int, body: str) -> None:
    """Create the marker of ``number``; ``CommitConflict`` if there is one."""
    fs, p = _fs(spark, f"{path}/{COMMITS}/{number:010d}")
    try:
        stream = fs.create(p, False)
    except Exception as exc:
        if fs.exists(p):
            raise CommitConflict(f"{path}: version {number} is committed already") from exc
        raise
    stream.write(bytearray((body + "\n").encode()))
    stream.close()


def current_version(spark: SparkSession, path: str) -> int:
    """The number of the newest version, 0 without one."""
    return max(commits(spark, path), default=0)


def write_data(df: DataFrame, path: str, partition_by=()) -> str:
    """Write ``df`` to a data folder of its own, not yet visible; returns its name."""
    name = f"data-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{name}")
    return name


def replace_table(df: DataFrame, path: str, partition_by=(), base: int | None = None) -> int:
    """Make ``df`` the table's next version and return its number. ``base`` is the version
    that ``df`` was computed from (default: the newest at the start of the write)."""
    spark = df.sparkSession
    base = current_version(spark, path) if base is None else base
    commit(spark, path, base + 1, write_data(df, path, partition_by))
    return base + 1


def read_current(spark: SparkSession, path: str, schema: StructType | None = None,
                 version: int | None = None) -> DataFrame:
    """The newest version (or ``version``). Its files stay as they are while newer ones are
    committed. Without a commit: an empty table of ``schema``, or ``FileNotFoundError``."""
    log = commits(spark, path)
    if not log and schema is not None:
        return spark.createDataFrame([], schema)
    number = max(log, default=0) if version is None else version
    if number not in log:
        raise FileNotFoundError(f"{path}: version {number}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path}/{log[number]}")


def vacuum(spark: SparkSession, path: str, keep: int = 2, orphan_seconds: float = 86_400) -> list[str]:
    """Delete the data folders of all but the newest ``keep`` versions, and folders without a
    commit older than ``orphan_seconds`` (younger ones may belong to a running job). Markers
    stay, so a number is never used twice. Returns the deleted names."""
    log = commits(spark, path)
    live = {log[n] for n in sorted(log)[-keep:]} if keep else set()
    old = set(log.values()) - live
    gone = []
    for f in _children(spark, path):
        name = f.getPath().getName()
        orphan = name.startswith("data-") and name not in live | old and (
            f.getModificationTime() < (time.time() - orphan_seconds) * 1000)
        if name in old or orphan:
            fs, p = _fs(spark, f.getPath().toString())
            fs.delete(p, True)
            gone.append(name)
    return gone
