"""Seeded topics and topic shares by candidate (M7-M9, A7-A10; pipeline P7).

The reference fits an anchored topic model on sentence vectors. Here topics
come from Spark jobs: (a) seed-keyword matching -- the n-grams of each
distinct cleaned text join the seed keywords and the seed with most hits wins,
lowest id on ties; (b) cosine to per-topic centroids (matrix blocks of bounded
size, no join); (c) unsupervised k-means (Spark ML). Topic ids equal
seed positions, so the label table lines up by construction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import ngrams_upto, normalise_space
from ..session import reliable_checkpoint
from .per_text import TEXT_KEY, score_texts
from .vectors import mean_vector

OTHER = "Otros"
NO_TOPIC = -1
# Numbers in one block of the centroid matrix shipped to the tasks (32 MB).
BLOCK_NUMBERS = 1 << 22


def clean_seeds(seeds: DataFrame, keyword: str = "keyword", stop=()) -> DataFrame:
    """Pass seed phrases through the same normalisation as the post text:
    lower case, single spaces, stop words removed (``stop``)."""
    words = F.split(normalise_space(F.lower(F.col(keyword))), " ")
    if stop:
        stop = list(stop)
        words = F.filter(words, lambda x: ~x.isin(*stop))
    return (seeds.withColumn(keyword, F.array_join(words, " "))
            .where(F.col(keyword) != "").dropDuplicates(["seed_id", keyword]))


# best seed per post as one long: score * SCORE_BASE - (seed_id + 1)
SCORE_BASE = 1 << 31


def seed_topics(docs: DataFrame, seeds: DataFrame, text: str = "clean_text", key: str = "id",
                min_size: int = 10, keep=()) -> DataFrame:
    """M7 (a): ``topic`` = the seed with the most keyword hits among the
    post's 1..n-grams (n = longest seed), lowest seed id on ties, ``-1``
    without hits or text; topics with fewer than ``min_size`` posts become ``-1``.
    One row per input row, whether or not ids repeat.

    One plan for seed lists of every size: the n-grams of each text join
    the seeds (broadcast if AQE finds them small), hits are counted per text and
    seed, and the best seed of each text is joined back.
    """
    sd = seeds.select(F.col("seed_id").cast("int").alias("seed_id"), "keyword")
    max_n = sd.select(F.max(F.size(F.split("keyword", " ")))).first()[0] or 1
    grams = ngrams_upto(F.split(F.col(text), " "), max_n)

    def score(units):
        # equal texts have equal n-grams at equal places: each place counts once
        hits = (units.join(sd, "keyword").select(TEXT_KEY, "seed_id", "_pos").distinct()
                .groupBy(TEXT_KEY, "seed_id").agg(F.count(F.lit(1)).alias("score")))
        code = F.col("score") * F.lit(SCORE_BASE) - (F.col("seed_id").cast("long") + 1)
        top = hits.groupBy(TEXT_KEY).agg(F.max(code).alias("_c"))
        n = F.ceil(F.col("_c") / F.lit(SCORE_BASE))
        return top.select(TEXT_KEY, (n * F.lit(SCORE_BASE) - F.col("_c") - 1).cast("int").alias("topic"))

    best = score_texts(docs, text, grams, "keyword", score).select(
        key, *keep, F.coalesce("topic", F.lit(NO_TOPIC)).alias("topic"))
    if min_size <= 1:
        return best
    # the assignment feeds both the size count and the result: write it once
    # (narrow rows) to the shared checkpoint folder instead of recomputing the
    # text pipeline, which also cuts the lineage for executor-loss recovery
    best = reliable_checkpoint(best)
    # topic sizes: a partial aggregate with at most one row per seed (+1),
    # broadcast back, so a topic holding most posts is never one partition
    sizes = best.groupBy("topic").agg(F.count(F.lit(1)).alias("_n"))
    small = F.broadcast(sizes.where(F.col("_n") < min_size)
                        .select("topic", F.lit(True).alias("_small")))
    return (best.join(small, "topic", "left")
            .withColumn("topic", F.when(F.col("_small"), F.lit(NO_TOPIC)).otherwise(F.col("topic")))
            .drop("_small"))


def fit_centroids(df: DataFrame, label: str = "label", col: str = "embedding") -> DataFrame:
    """Per-topic mean vectors ``(topic_id, centroid)`` from labelled vectors."""
    return mean_vector(df, [label], col, out="centroid").withColumnRenamed(label, "topic_id")


def centroid_topics(df: DataFrame, centroids: DataFrame, threshold: float,
                    col: str = "embedding") -> DataFrame:
    """M7 (b): the most similar centroid by cosine when it reaches
    ``threshold`` (lowest topic id on ties), else ``-1``; adds ``topic`` and
    ``similarity`` (-2 for a null vector or one of length 0, and without centroids).

    Centroids are normalised once and handed to the tasks as blocks of a matrix, as
    many blocks as their number asks for; each block is one vectorised product per
    Arrow batch, and the best so far goes on to the next block.
    """
    width = centroids.select(F.max(F.size("centroid"))).first()[0] or 1
    per_block = max(1, BLOCK_NUMBERS // max(1, width))
    total = centroids.count()
    sc = df.sparkSession.sparkContext
    out = df.withColumns({"similarity": F.lit(-2.0), "topic": F.lit(NO_TOPIC)})
    blocks = -(-2 * total // per_block) if total > per_block else 1      # about half full each
    for n in range(blocks):
        rows = centroids.where(F.pmod(F.xxhash64("topic_id"), F.lit(blocks)) == n).orderBy("topic_id").collect()
        if not rows:
            continue
        matrix = np.array([r["centroid"] for r in rows], dtype=float)
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            matrix = matrix / norm
        shared = sc.broadcast((np.array([int(r["topic_id"]) for r in rows]), matrix))

        @pandas_udf("struct<similarity:double,topic:int>")
        def best(vectors: pd.Series, so_far: pd.Series, topic: pd.Series) -> pd.DataFrame:
            ids, m = shared.value
            sim, top = so_far.to_numpy(dtype=float).copy(), topic.to_numpy(dtype=int).copy()
            at = [i for i, v in enumerate(vectors) if v is not None]
            if at:
                x = np.stack([np.asarray(vectors.iloc[i], dtype=float) for i in at])
                length = np.linalg.norm(x, axis=1)
                s = np.nan_to_num(x @ m.T / np.where(length, length, np.nan)[:, None], nan=-2.0)
                k = s.argmax(axis=1)
                own = s[np.arange(len(at)), k]
                better = (own > sim[at]) | ((own == sim[at]) & (own > -2) & (ids[k] < top[at]))
                sim[np.array(at)[better]] = own[better]
                top[np.array(at)[better]] = ids[k][better]
            return pd.DataFrame({"similarity": sim, "topic": top})

        out = (out.withColumn("_b", best(F.col(col).cast("array<double>"), "similarity", "topic"))
               .withColumns({"similarity": F.col("_b.similarity"), "topic": F.col("_b.topic")}).drop("_b"))
    return out.withColumn("topic", F.when(F.col("similarity") >= threshold, F.col("topic"))
                          .otherwise(F.lit(NO_TOPIC)))


def cluster_topics(df: DataFrame, k: int, col: str = "embedding", seed: int = 42,
                   max_iter: int = 20) -> DataFrame:
    """M8: k-means with cosine distance on the vectors; adds ``cluster``."""
    vec = df.withColumn("_features", array_to_vector(F.col(col).cast("array<double>")))
    km = KMeans(k=k, seed=seed, maxIter=max_iter, distanceMeasure="cosine",
                featuresCol="_features", predictionCol="cluster")
    return km.fit(vec).transform(vec).drop("_features")


def label_topics(assigned: DataFrame, labels: DataFrame, topic: str = "topic") -> DataFrame:
    """M9 + J12: topic id -> label; unknown ids (and -1 without a label) -> Otros.
    AQE broadcasts the label table by its measured size."""
    lb = labels.select(F.col("topic_id").alias(topic), "label")
    return (assigned.join(lb, topic, "left")
            .withColumn("label", F.coalesce(F.col("label"), F.lit(OTHER))))


def topic_share(labelled: DataFrame, candidate: str = "candidate") -> DataFrame:
    """A7 + A8: posts per (candidate, label) and their share of the
    candidate's posts in percent (the denominator includes Otros)."""
    counts = labelled.groupBy(candidate, "label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(candidate))
    return counts.withColumn("share", F.col("n") * F.lit(100.0) / total)


def topic_matrix(share: DataFrame, labels: DataFrame, candidates=None, candidate: str = "candidate",
                 exclude_other: bool = True) -> DataFrame:
    """Label x candidate matrix of shares, missing cells 0, one row per
    label in label-table order (``label_order``), Otros optionally dropped
    (after the shares were computed). The columns are the candidates of the data;
    a given list fixes their order and may name more, but a candidate of the data
    that it leaves out is an error, never lost."""
    present = sorted(r[0] for r in share.select(candidate).where(F.col(candidate).isNotNull())
                     .distinct().collect())
    candidates = list(present if candidates is None else candidates)
    if set(present) - set(candidates):
        raise ValueError(f"candidates not listed: {sorted(set(present) - set(candidates))}")
    order = labels.select("label", F.col("topic_id").alias("label_order"))
    if not exclude_other:
        order = order.unionByName(
            share.sparkSession.range(1).select(F.lit(OTHER).alias("label"),
                                               F.lit(1 << 30).alias("label_order")))
    order = order.groupBy("label").agg(F.min("label_order").alias("label_order"))
    if exclude_other:
        order = order.where(F.col("label") != OTHER)
    wide = share.groupBy("label").pivot(candidate, candidates).agg(F.first("share"))
    return (order.join(wide, "label", "left").na.fill(0.0, subset=candidates))


def topic_profile_norm(share: DataFrame, candidate: str = "candidate",
                       exclude_other: bool = True) -> DataFrame:
    """A10: each candidate's shares divided by that candidate's largest share
    (taken after dropping Otros) when it is > 0."""
    s = share.where(F.col("label") != OTHER) if exclude_other else share
    mx = F.max("share").over(Window.partitionBy(candidate))
    return s.withColumn("_mx", mx).withColumn(
        "share_norm", F.when(F.col("_mx") > 0, F.col("share") / F.col("_mx"))
        .otherwise(F.col("share"))).drop("_mx")
