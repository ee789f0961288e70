"""P2 incrementally: the daily feature table from stored state, without old posts.

What the feature table needs of the posts adds up: per (keys, day) the sums and counts of
scores, engagement and their products (``daily_sums``), and for the robust scaler how often
each engagement value occurs (``value_counts``). A run turns its batch of posts into these
two narrow tables and appends them as a *delta*; the feature table is made from the deltas,
one row per day and value. Late posts are one more delta for an old day: they move that day's
row, the rows within its windows, and (through the medians) the scaled columns of every day,
exactly as a rebuild over all posts does.

Layout below ``path``: ``sums/batch=N`` and ``counts/batch=N``, and a commit marker for each
batch that is complete. A batch that died is written again under its number; a batch that is
committed is not added twice. A batch may *replace* its days (it then holds all their posts):
rows of earlier batches for those days no longer count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.daily import ENGAGEMENT, add_sums, daily_of_sums, daily_sums
from ..operators.scaling import RobustStats, fit_robust_counts, merge_value_counts, value_counts
from ..sources.versioned import commit, commits
from .features import features_of_daily


class FeatureStore:
    def __init__(self, spark: SparkSession, path: str, keys=()):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), tuple(keys)

    def batches(self) -> list[int]:
        return sorted(commits(self.spark, self.path))

    def append(self, posts: DataFrame, batch: int, replace_days: bool = False) -> bool:
        """Add a batch of posts (scored, with ``date``); False if it is in the store already.
        Numbers must grow. ``replace_days``: the batch holds all posts of its days."""
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} is older than the stored batch {done[-1]}")
        whole = F.lit(replace_days).alias("whole")
        days = posts.where(F.col("date").isNotNull())
        for name, df in (("sums", daily_sums(days, self.keys)),
                         ("counts", value_counts(days, ENGAGEMENT, by=("date",)))):
            df.select("*", whole).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        commit(self.spark, self.path, batch, "replace" if replace_days else "add")
        return True

    def _read(self, name: str) -> DataFrame:
        """The rows of committed batches that still count."""
        log = commits(self.spark, self.path)
        if not log:
            raise FileNotFoundError(f"{self.path}: no batch is stored")
        root = f"{self.path}/{name}"
        df = (self.spark.read.option("basePath", root).parquet(*[f"{root}/batch={b}" for b in sorted(log)]))
        if "replace" not in log.values():
            return df.drop("whole", "batch")
        # a day counts from the last batch that replaced it
        since = df.where("whole").groupBy("date").agg(F.max("batch").alias("since"))
        return (df.join(since, "date", "left").where("since IS NULL OR batch >= since")
                .drop("whole", "batch", "since"))

    def sums(self) -> DataFrame:
        """One row per (keys, day) over all batches."""
        return add_sums(self._read("sums"), self.keys)

    def stats(self) -> RobustStats:
        """The robust scaler over all posts that count, from the stored value counts."""
        return fit_robust_counts(merge_value_counts(self._read("counts")), ENGAGEMENT)

    def features(self, polls: DataFrame, stats: RobustStats | None = None) -> DataFrame:
        """The feature table: equal to ``daily_features`` over all posts."""
        return features_of_daily(daily_of_sums(self.sums(), stats or self.stats()), polls, self.keys)

    def compact(self) -> int:
        """Merge all batches into one delta under the next number; returns it. Earlier folders
        are no longer read for any day (the merged batch replaces all its days)."""
        number = self.batches()[-1] + 1
        whole = F.lit(True).alias("whole")
        for name, df in (("sums", self.sums()),
                         ("counts", merge_value_counts(self._read("counts"), by=("date",)))):
            df.select("*", whole).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        commit(self.spark, self.path, number, "replace")
        return number
