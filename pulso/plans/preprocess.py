"""Preprocessing of newly collected posts.

unprocessed (S11) -> clean text, drop rows out of bounds (X6) -> sentiment
(M1, any scorer adding the five columns) -> embedding (M2) -> append to the
processed table with id dedup (S3) -> flag the ids in the raw table (S12). Posts
dropped by cleaning stay unflagged and are retried next run, as in the reference,
unless ``mark_dropped`` is set.

With ``out`` given, every stage is written (S14) below that path (``cleaned``,
``scored``, ``embedded``, ``processed``, ``raw``) and the next one reads what was
written, so no stage is computed twice and a lost executor costs one stage. A stage that is
not to be kept (``keep``) is deleted once it is measured and no later one reads it. Shuffle files of
a written stage go at once, not when the driver next collects garbage.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.sentiment import lexicon_sentiment
from ..operators.state import append_dedup, mark_processed, unprocessed
from ..operators.terms import clean_posts
from ..operators.vectors import embed_posts_hashed
from ..sources.tables import delete_table, write_observed, write_table

#: Stages that ``preprocess`` writes, in order.
STAGES = ("cleaned", "scored", "embedded", "processed", "raw")

Step = Callable[[DataFrame], DataFrame]


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Spark removes the shuffle files of the queries run inside as they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@dataclass
class Preprocessed:
    new_rows: DataFrame      # cleaned, scored, embedded new posts
    processed: DataFrame     # stored processed table with the new rows appended
    raw: DataFrame           # raw table with the processed flag updated
    quality: list = field(default_factory=list)     # S15 per written stage (``day`` given)


def lexicon_scorer(lexicon: DataFrame, text: str = "text") -> Step:
    """A scorer for ``preprocess``: summed word logits (M1)."""
    return lambda df: lexicon_sentiment(df, lexicon, text=text)


def hashed_embedder(vectors: DataFrame, dim: int, text: str = "text") -> Step:
    """An embedder for ``preprocess``: mean of hashed token vectors (M2)."""
    return lambda df: embed_posts_hashed(df, vectors, dim, text=text)


def preprocess(raw: DataFrame, scorer: Step, embedder: Step, stored: DataFrame | None = None,
               key: str = "id", text: str = "text", out: str | None = None,
               mark_dropped: bool = False, day=None, keep: Collection[str] = STAGES) -> Preprocessed:
    """``scorer`` adds the five sentiment columns (``lexicon_scorer``, ``ml_sentiment``,
    ``external_sentiment``, ...), ``embedder`` the vector column. With ``out`` and ``day`` (a
    column or expression) rows, days and null days of every stage are measured as it is
    written (S15), without a pass of their own. Tables of stages not in ``keep`` can't be read
    afterwards."""
    quality: list = []

    def stage(name: str, df: DataFrame) -> DataFrame:
        if out is None:
            return df
        with _shuffles_removed(df.sparkSession):
            if day is None:
                write_table(df, f"{out}/{name}", compression="zstd")
            else:
                quality.append(write_observed(df, f"{out}/{name}", name, day, compression="zstd"))
        return df.sparkSession.read.schema(df.schema).parquet(f"{out}/{name}")

    def done_with(*names: str) -> None:
        for name in names if out is not None else ():
            if name not in keep:
                delete_table(raw.sparkSession, f"{out}/{name}")

    cleaned = stage("cleaned", clean_posts(unprocessed(raw), col=text))
    scored = stage("scored", scorer(cleaned))
    embedded = stage("embedded", embedder(scored))
    done_with("scored")
    processed = stage("processed", append_dedup(stored, embedded, key=key))
    done_with("embedded", "processed")
    marked = stage("raw", mark_processed(raw, cleaned.select(key), key=key, mark_dropped=mark_dropped))
    done_with("cleaned", "raw")
    return Preprocessed(embedded, processed, marked, quality)
