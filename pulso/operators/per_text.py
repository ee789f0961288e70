"""Scores that depend on a post's text alone, one per distinct text.

Posts and scores meet on a digest of the text, so ids may repeat or be missing,
and a text that a third of all posts share is scored once. The score table is
narrow and written to the shared checkpoint folder: both sides of the join are
then plain scans, which AQE broadcasts or splits by measured size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

TEXT_KEY = "_text_key"


def units_of(df: DataFrame, text: str, units: Column, name: str) -> DataFrame:
    """``(TEXT_KEY, _pos, name)``: the exploded ``units`` (an array of the text's tokens,
    n-grams, ...) of every row's text; null texts have none, empty arrays a null unit
    (an outer explode: for a plain one the optimizer adds a filter on the array's size,
    which would compute the units twice). A text's units lie in one
    task, so an aggregate by ``TEXT_KEY`` combines them before the shuffle. Equal texts
    add up: scores take each ``_pos`` once or don't depend on their number."""
    key = F.md5(F.col(text))
    return (df.where(F.col(text).isNotNull()).select(key.alias(TEXT_KEY), units.alias("_units"))
            .select(TEXT_KEY, F.posexplode_outer("_units").alias("_pos", name)))


def attach(df: DataFrame, text: str, scores: DataFrame) -> DataFrame:
    """``df`` with the columns of ``scores`` (keyed by ``TEXT_KEY``), null where the
    text has none. Null texts take the digest of '' and find nothing."""
    keyed = df.withColumn(TEXT_KEY, F.md5(F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(reliable_checkpoint(scores), TEXT_KEY, "left").drop(TEXT_KEY)


def score_texts(df: DataFrame, text: str, units: Column, name: str,
                score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with what ``score`` makes of the exploded units of its texts. ``df`` is read
    twice: write it first if it is dear to compute."""
    return attach(df, text, score(units_of(df, text, units, name)))
