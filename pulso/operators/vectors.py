"""Vectors: mean pooling of token vectors, per-group mean vectors, cosine
(X12, A2, M2).

Embeddings are one ``array<float|double>`` column, never hundreds of wide
columns. Group means over unbounded groups (a day, a topic) use Spark ML's
``Summarizer`` (a real aggregate with map-side partial state of one vector
per group).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import tokens as text_tokens
from ..session import scratch_path
from ..sources.tables import write_table

# A piece of neighbouring posts holds at most 2 ** PIECE_BITS posts and 16 times as many tokens. Pieces
# are dealt to chunks of about 2 ** CHUNK_BITS posts of 16 tokens.
PIECE_BITS, CHUNK_BITS = 12, 16


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def cosine(a, b) -> Column:
    """Cosine similarity of two equal-length numeric arrays (null if a norm is 0)."""
    a, b = _c(a), _c(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v * v))
    return F.try_divide(dot, na * nb)


def token_hash_bucket(token, n_buckets: int) -> Column:
    """A stable bucket of a token: the first 32 bits of its MD5, modulo n."""
    h = F.conv(F.substring(F.md5(_c(token)), 1, 8), 16, 10).cast("bigint")
    return h % F.lit(n_buckets)


def _means(units, found, dim: int) -> pa.Array:
    """Mean vector of each list of ``units``: ``found`` has for a unit the number of its vectors
    and their sums by component. Zero without any match; a component without a value is null."""
    n = len(units)
    counts = pc.fill_null(pc.list_value_length(units), 0).to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.index_in(units.flatten(), value_set=found["_unit"].combine_chunks()), -1).to_numpy(
        zero_copy_only=False)
    row = np.repeat(np.arange(n), counts)[at >= 0]
    at = at[at >= 0]
    flat = found["_sums"].combine_chunks().flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float) if flat.null_count else None
    sums = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).reshape(-1, dim)
    size = found["_n"].to_numpy()
    out, void = np.zeros((n, dim)), np.zeros((n, dim), bool)
    step = max(1, n * 32768 // max(1, len(at)))
    for a in range(0, n, step):                # some ten thousand vectors at a time
        lo, hi = np.searchsorted(row, [a, a + step])
        if lo == hi:
            continue
        first = np.flatnonzero(np.diff(row[lo:hi], prepend=-1))
        own, k = row[lo:hi][first], at[lo:hi]
        total = np.add.reduceat(size[k], first).astype(float)
        out[own] = np.add.reduceat(sums[k], first, axis=0) / np.maximum(total, 1)[:, None]
        if known is not None:
            void[own] = np.add.reduceat(known[k], first, axis=0) == 0
    values = pa.array(out.ravel(), mask=void.ravel()) if void.any() else pa.array(out.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), values)


def _pool(df: DataFrame, units: Column, table: DataFrame, dim: int, out: str) -> DataFrame:
    """``df`` with the mean vector of each post's ``units`` (tokens or buckets, an array), zero
    without any match. ``table`` is ``(_unit, _v)``; a unit listed twice counts twice.

    A vector is some hundred bytes and a token a few, so no vector is sent for each token: posts
    are written once in pieces of neighbours, which are dealt to as many chunks as the written
    tokens ask for, only the distinct units of a chunk go to the table, and a chunk meets its
    vectors in one task. Pieces hold consecutive rows, whatever their texts, ids or copies, and the
    fewer the longer they are. Sums that are exact as floats are sent as such."""
    spark = df.sparkSession
    put = df.withColumns({"_units": units, "_row": F.monotonically_increasing_id()})
    length = F.greatest(F.size("_units"), F.lit(1)) / F.lit(16.0)
    put = put.withColumn("_class", F.least(F.greatest(F.ceil(F.log2(length)), F.lit(0)), F.lit(PIECE_BITS)).cast("int"))
    put = put.withColumn("_piece", F.floor(F.col("_row") / F.pow(F.lit(2.0), F.lit(PIECE_BITS) - F.col("_class")))).drop("_row")
    seen = Observation("pool-length")
    path = write_table(put.observe(seen, F.sum(F.greatest(length, F.lit(1.0))).alias("n")), scratch_path(spark, "pool"),
                       compression="zstd")
    chunks = max(1, math.ceil((seen.get["n"] or 0) / 2 ** CHUNK_BITS))
    rows, again = (spark.read.schema(put.schema).parquet(path).withColumn("_chunk", F.pmod(
        F.xxhash64("_class", "_piece"), F.lit(chunks))).drop("_class", "_piece") for _ in range(2))

    wanted = (again.select("_chunk", F.explode(F.array_distinct("_units")).alias("_unit"))
              .where(F.col("_unit").isNotNull()).distinct())
    sums = table.groupBy("_unit").agg(F.count("_v").alias("_n"), *[F.sum(F.col("_v")[i]).alias(f"_s{i}") for i in range(dim)])
    sums = sums.select("_unit", "_n", F.array(*[f"_s{i}" for i in range(dim)]).alias("_sums"))
    exact = F.forall("_sums", lambda x: x.eqNullSafe(x.cast("float").cast("double")))
    sums = sums.select("_unit", "_n", F.when(~exact, F.col("_sums")).alias("_sums"),
                       F.when(exact, F.col("_sums").cast("array<float>")).alias("_floats"))
    # another name than the rows' own: the two sides come from one table
    found = wanted.join(sums, "_unit").select(F.col("_chunk").alias("_chunk_of"), "_unit", "_n", "_sums", "_floats")

    def pooled(left: pa.Table, right: pa.Table) -> pa.Table:
        units = left["_units"].combine_chunks()
        if right.num_rows:
            sums = pc.coalesce(right["_sums"], right["_floats"].cast(pa.list_(pa.float64())))
            means = _means(units, right.drop_columns(["_sums", "_floats"]).append_column("_sums", sums), dim)
        else:
            means = pa.ListArray.from_arrays(
                pa.array(np.arange(len(units) + 1, dtype=np.int32) * dim), pa.array(np.zeros(len(units) * dim)))
        return left.drop_columns(["_units", "_chunk"]).append_column(out, means)

    result = StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))])
    return rows.groupBy("_chunk").cogroup(found.groupBy("_chunk_of")).applyInArrow(pooled, result)


def _tokens(text: str, max_tokens: int | None) -> Column:
    toks = text_tokens(text)
    return F.slice(toks, 1, max_tokens) if max_tokens else toks


def embed_posts(df: DataFrame, token_vectors: DataFrame, dim: int, text: str = "text",
                max_tokens: int | None = None, out: str = "embedding") -> DataFrame:
    """Mean of the vectors of each post's tokens (tokens without a
    vector are skipped; ``max_tokens`` asks for the first so many only); a post
    with no known token, or null text, gets the zero vector. ``token_vectors`` is a
    ``(token, vector)`` table; the distinct tokens of a chunk of posts join it on the token.
    """
    tv = token_vectors.select(F.col("token").alias("_unit"),
                              F.col("vector").cast("array<double>").alias("_v"))
    return _pool(df, _tokens(text, max_tokens), tv, dim, out)


def embed_posts_hashed(df: DataFrame, table: DataFrame, dim: int, text: str = "text",
                       max_tokens: int | None = None, out: str = "embedding",
                       id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """X12 with a hashed vector table: each token takes the row of ``table``
    whose id is its hash bucket (``token_hash_bucket`` over ``count(table)``
    ids). The join is on an integer bucket, so no vocabulary pass is needed.
    """
    n = table.count()
    vecs = table.select(F.col(id_col).cast("long").alias("_unit"), F.col(vec_col).cast("array<double>").alias("_v"))
    buckets = F.transform(_tokens(text, max_tokens), lambda t: token_hash_bucket(t, max(n, 1)))
    return _pool(df, buckets, vecs, dim, out)


def hashed_token_vectors(vocab: DataFrame, table: DataFrame, id_col: str = "vec_id",
                         vec_col: str = "embedding", token: str = "token") -> DataFrame:
    """The ``(token, vector)`` table equal to ``embed_posts_hashed``'s lookup
    for the tokens of ``vocab``."""
    n = table.count()
    keyed = vocab.select(token).distinct().withColumn("_b", token_hash_bucket(token, n))
    vecs = table.select(F.col(id_col).alias("_b"), F.col(vec_col).alias("vector"))
    return keyed.join(vecs, "_b").select(token, "vector")


def mean_vector(df: DataFrame, keys, col: str = "embedding", out: str | None = None) -> DataFrame:
    """A2 (array form): per-group, per-dimension mean of a vector column."""
    vec = array_to_vector(F.col(col).cast("array<double>"))
    agg = df.where(F.col(col).isNotNull()).groupBy(*keys).agg(Summarizer.mean(vec).alias("_m"))
    return agg.select(*keys, vector_to_array("_m").alias(out or col))


def mean_vector_long(df: DataFrame, keys, col: str = "embedding") -> DataFrame:
    """A2 (long form): ``(keys, pos, value)`` with pos from 0; a plain
    partial aggregate on (keys, pos)."""
    long = df.select(*keys, F.posexplode(F.col(col)).alias("pos", "_v"))
    return long.groupBy(*keys, "pos").agg(F.avg(F.col("_v").cast("double")).alias("value"))


def daily_embedding_mean(df: DataFrame, keys=(), col: str = "embedding",
                         date_col: str = "date") -> DataFrame:
    """A2: per (keys, day) mean embedding (array form)."""
    return mean_vector(df.where(F.col(date_col).isNotNull()), [*keys, date_col], col)
