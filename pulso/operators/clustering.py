"""Topics beside anchors in one model, and their words (M7-M9).

``fit_anchored`` is spherical k-means with two kinds of centres: anchors, which stay what they
are and keep their ids, and free centres for what the anchors leave over. All of them compete
for the rows in every round. A round is one pass: each task adds up the unit vectors of the
rows nearest to each free centre and sends one row per centre; only these sums and the centres
(topics x dimensions, a property of the model) reach the driver, as in any k-means.

``topic_words`` finds what a topic is about with class-based TF-IDF: a topic is one long text,
and a word scores by its share of that text and its rarity over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topics import NO_TOPIC, centroid_topics


def _units(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors of the batch's usable vectors (column 1): those with
    ``width`` finite numbers and a length."""
    vectors = batch.column(1).to_pylist()
    at = [i for i, v in enumerate(vectors) if v is not None and len(v) == width and None not in v]
    x = np.array([vectors[i] for i in at], dtype=float).reshape(len(at), width)
    length = np.linalg.norm(x, axis=1)
    ok = np.isfinite(length) & (length > 0)
    return np.array(at, dtype=int)[ok], x[ok] / length[ok, None]


def _farthest(rows: DataFrame, centres: np.ndarray, width: int):
    """The vector of the row least similar to its nearest centre (ties: the smallest key)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            at, x = _units(b, width)
            if len(at):
                near = (x @ centres.T).max(axis=1) if len(centres) else np.full(len(at), -2.0)
                keys = b.column(0).to_pylist()
                k = min(range(len(at)), key=lambda i: (near[i], keys[at[i]] is None, keys[at[i]]))
                found = (near[k], keys[at[k]], x[k])
                if best is None or (found[0], found[1] is None, found[1]) < (best[0], best[1] is None, best[1]):
                    best = found
        if best is not None:
            yield pa.RecordBatch.from_pydict({"near": [best[0]], "key": pa.array([best[1]], kind), "v": [best[2].tolist()]})

    kind = pa.int64() if rows.schema["key"].dataType.typeName() == "long" else pa.string()
    key = rows.schema["key"].dataType.simpleString()
    first = rows.mapInArrow(task, f"near double, key {key}, v array<double>").orderBy(
        "near", F.col("key").asc_nulls_last()).first()
    return None if first is None else np.array(first.v)


def _sums(rows: DataFrame, ids: np.ndarray, centres: np.ndarray, free: int, width: int) -> dict:
    """Topic -> (sum of the unit vectors, rows) of the rows nearest to each of the last
    ``free`` centres (ties: the smallest topic id; centres are in id order)."""
    first_free = len(ids) - free

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((free, width)), np.zeros(free, np.int64)
        for b in batches:
            _, x = _units(b, width)
            if len(x):
                k = (x @ centres.T).argmax(axis=1) - first_free
                own = k >= 0
                np.add.at(total, k[own], x[own])
                n += np.bincount(k[own], minlength=free)
        yield pa.RecordBatch.from_pydict({
            "topic": np.repeat(ids[first_free:], width), "pos": np.tile(np.arange(width, dtype=np.int32), free),
            "s": total.ravel(), "n": np.repeat(n, width)})

    parts = rows.mapInArrow(task, "topic long, pos int, s double, n long")
    out: dict = {}
    for r in parts.groupBy("topic", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        out.setdefault(r.topic, (np.zeros(width), r.n))[0][r.pos] = r.s
    return out


def fit_anchored(df: DataFrame, anchors: DataFrame, free: int, rounds: int = 10,
                 col: str = "embedding", key: str = "id") -> DataFrame:
    """The model ``(topic_id, centroid, anchored)``: the ``anchors`` (topic_id, centroid) as
    they are, and ``free`` topics numbered after the largest anchor id.

    Free centres start at the rows that are farthest, one after the other, from all centres so
    far, and move to the mean direction of their rows; a free centre without rows stays. It
    ends after ``rounds`` rounds, or when no centre moves. Null, zero and non-finite vectors
    and those of another length take no part.
    """
    spark = df.sparkSession
    fixed = sorted(((int(r.topic_id), np.array(r.centroid, dtype=float)) for r in anchors.collect()),
                   key=lambda x: x[0])
    most = df.select(F.max(F.size(col))).first()[0]
    width = len(fixed[0][1]) if fixed else int(most or 0)
    centres = np.array([c / np.linalg.norm(c) for _, c in fixed]).reshape(len(fixed), width)
    kind = "long" if df.schema[key].dataType.typeName() in ("long", "integer", "short") else "string"
    rows = df.select(F.col(key).cast(kind).alias("key"), F.col(col).cast("array<double>").alias("v"))
    for _ in range(free):
        found = _farthest(rows, centres, width)
        if found is None:
            break
        centres = np.vstack([centres, found])
    n_free = len(centres) - len(fixed)
    start = max([t for t, _ in fixed], default=-1) + 1
    ids = np.array([t for t, _ in fixed] + list(range(start, start + n_free)), dtype=np.int64)
    for _ in range(rounds if n_free else 0):
        moved = centres.copy()
        for topic, (total, n) in _sums(rows, ids, centres, n_free, width).items():
            length = np.linalg.norm(total)
            if n and length > 0:
                moved[int(np.flatnonzero(ids == topic)[0])] = total / length
        if np.array_equal(moved, centres):
            break
        centres = moved
    return spark.createDataFrame(
        [(int(t), [float(x) for x in c], k < len(fixed)) for k, (t, c) in enumerate(zip(ids, centres))],
        "topic_id int, centroid array<double>, anchored boolean")


def anchored_topics(df: DataFrame, anchors: DataFrame, free: int, rounds: int = 10, threshold: float = -2.0,
                    min_size: int = 1, col: str = "embedding", key: str = "id") -> DataFrame:
    """M7 + M8 in one model: ``df`` with ``topic`` and ``similarity``. Rows below ``threshold``,
    and those of free topics with fewer than ``min_size`` rows, have topic -1."""
    model = fit_anchored(df, anchors, free, rounds, col, key)
    out = centroid_topics(df, model.select("topic_id", "centroid"), threshold, col)
    if min_size <= 1:
        return out
    free_ids = [r.topic_id for r in model.where("NOT anchored").select("topic_id").collect()]
    sizes = out.where(F.col("topic").isin(free_ids)).groupBy("topic").agg(F.count("*").alias("_n"))
    # at most one row per free topic
    small = F.broadcast(sizes.where(F.col("_n") < min_size).select("topic", F.lit(True).alias("_small")))
    return (out.join(small, "topic", "left")
            .withColumn("topic", F.when(F.col("_small"), F.lit(NO_TOPIC)).otherwise(F.col("topic")))
            .select(*out.columns))


def topic_words(docs: DataFrame, words, n: int = 10, topic: str = "topic") -> DataFrame:
    """``(topic, rank, word, count, score)``: the ``n`` best words of every topic by class-based
    TF-IDF, ties by word. ``words`` is an array column (an expression or a name) of a
    row's words; rows without a topic are left out.

    ``score = count / words of the topic * ln(1 + mean words of a topic / count over all topics)``
    """
    each = docs.where(F.col(topic).isNotNull()).select(F.col(topic).alias("topic"), F.explode(words).alias("word"))
    counts = each.groupBy("topic", "word").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("topic").agg(F.sum("count").alias("_words"))
    # one number for all topics; a row per topic is all that the totals hold
    mean = totals.agg(F.avg("_words")).first()[0] or 0.0
    overall = counts.groupBy("word").agg(F.sum("count").alias("_all"))
    scored = counts.join(overall, "word").join(totals, "topic").withColumn(
        "score", F.col("count") / F.col("_words") * F.log(F.lit(1.0) + F.lit(mean) / F.col("_all")))
    order = Window.partitionBy("topic").orderBy(F.round("score", 9).desc(), "word")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
            .select("topic", "rank", "word", "count", "score"))
