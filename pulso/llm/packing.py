"""Conflict-constrained best-fit packing of documents into fixed-size sequences.

Items are documents measured in words (maximal runs without ASCII white space);
a document longer than a bin is cut, its full pieces get bins of their own and
the rest is an item. Within a shard the items are placed longest first. Open
bins are kept ordered by residual space; the search starts at the smallest
residual that fits and goes on to the successor until a bin is found that is
compatible, so each item goes to the tightest compatible bin, or a new one.

Each bin carries bitmaps: one bit per duplicate cluster (two members of a
cluster never share a bin) and, in ``max_per_source`` planes, one bit per source
(plane j is set once the bin holds j + 1 documents of the source).

Shards are slices of documents by hash of the id, the cluster and a row number, as many as
the counted words ask for, so a hot source, cluster or id (null ones too) is spread evenly
and no task grows with the corpus. The row number is written with the items: a shard that is
done again has the same rows.

Defined cases: null and empty texts have no words; they are returned with
``bin_id`` null. A null source is a source of its own. Pieces of one document are
not in conflict over their source or cluster with each other only as full pieces
(those fill a bin); the rest follows the rules like any item. Rows with the same
``doc_id`` are separate items. Ties: equal lengths by ``doc_id``, then row number; equal
residuals by the older bin. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import small_batches, table, written

CAPACITY = 2048
MAX_PER_SOURCE = 4
SHARD_WORDS = 2_000_000

_OUT = ("doc_id long, piece int, start_word long, n_words long, bin_id long, "
        "bin_offset long, bin_words long")


def measure(docs: DataFrame) -> DataFrame:
    """Words per document and a digest of its word sequence (A-Z lower-cased),
    by which copies are told: ``doc_id, source, n_words, cluster``."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                data, offs = W.flat(part.column(1))
                low = W.lower(data)
                s, e, first = W.bounds(low, offs, W.SPACED)
                h = W.hash_words(low, s, e)
                place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
                h = W.mix(h + W.mix(place.astype(np.uint64)))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.diff(first)),
                     pa.array((sums[first[1:]] - sums[first[:-1]]).view(np.int64))],
                    names=["doc_id", "source", "n_words", "cluster"])

    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       F.col("source").cast("string"))
    return cols.mapInArrow(run, "doc_id long, source string, n_words long, cluster long")


def best_fit(items: list[tuple[int, int, int]], capacity: int, max_per_source: int) -> list[tuple[int, int]]:
    """Bin number and offset of each ``(size, source bit, cluster bit)`` in turn;
    bits are single-bit integers, 0 for none."""
    order: list[tuple[int, int]] = []           # (residual, bin), ascending
    clusters: list[int] = []
    planes: list[list[int]] = []
    out = []
    for size, source, cluster in items:
        i = bisect_left(order, (size, -1))
        while i < len(order):
            b = order[i][1]
            if not (clusters[b] & cluster or planes[b][-1] & source):
                break
            i += 1                               # conflict: the next larger residual
        if i < len(order):
            residual, b = order.pop(i)
        else:
            residual, b = capacity, len(clusters)
            clusters.append(0)
            planes.append([0] * max_per_source)
        out.append((b, capacity - residual))
        clusters[b] |= cluster
        for j, plane in enumerate(planes[b]):
            if not plane & source:
                planes[b][j] |= source
                break
        if residual > size:
            insort(order, (residual - size, b))
    return out


def _shard(capacity: int, max_per_source: int):
    def run(t: pa.Table) -> pa.Table:
        rows = t.select(["shard", "doc_id", "source", "n_words", "cluster", "row"]).to_pylist()
        rows.sort(key=lambda r: (-(r["n_words"] % capacity), r["doc_id"] is None, r["doc_id"] or 0, r["row"]))
        bit_of: dict = {}
        seen: dict = {}
        for r in rows:
            seen[r["cluster"]] = seen.get(r["cluster"], 0) + 1
        shared: dict = {}
        items, owners, out = [], [], []
        for r in rows:
            n, whole = r["n_words"], r["n_words"] // capacity
            for p in range(whole):
                out.append([r["doc_id"], p, p * capacity, capacity, None, 0])
            if n % capacity:
                source = 1 << bit_of.setdefault(r["source"], len(bit_of))
                cluster = (1 << shared.setdefault(r["cluster"], len(shared))
                           if seen[r["cluster"]] > 1 else 0)
                items.append((n % capacity, source, cluster))
                owners.append([r["doc_id"], whole, whole * capacity, n % capacity])
        placed = best_fit(items, capacity, max_per_source)
        n_open = 1 + max((b for b, _ in placed), default=-1)
        for k, row in enumerate(out):
            row[4] = n_open + k
        out += [[*o, b, off] for o, (b, off) in zip(owners, placed)]
        fill = np.zeros(n_open + len(out), np.int64)
        for r in out:
            fill[r[4]] += r[3]
        base = (rows[0]["shard"] if rows else 0) << 32
        cols = list(zip(*out)) if out else [[]] * 6
        return pa.table({
            "doc_id": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int32()),
            "start_word": pa.array(cols[2], pa.int64()), "n_words": pa.array(cols[3], pa.int64()),
            "bin_id": pa.array([base + b for b in cols[4]], pa.int64()),
            "bin_offset": pa.array(cols[5], pa.int64()),
            "bin_words": pa.array([int(fill[b]) for b in cols[4]], pa.int64())})
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE,
         shard_words: int = SHARD_WORDS, classes: DataFrame | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start_word, n_words, bin_id, bin_offset,
    bin_words``. Documents without words come once, with ``bin_id`` null.

    ``classes`` (doc_id, component_id; a row per id counts once), such as ``minhash.link``
    gives, makes near copies one duplicate cluster; without it, and for ids that it lacks,
    copies with the same word sequence are one."""
    items = measure(docs)
    if classes is not None:
        of = classes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component"))
        items = items.join(of, "doc_id", "left").withColumn("cluster", F.when(
            F.col("component").isNull(), F.col("cluster")).otherwise(F.xxhash64(F.lit("class"), "component"))).drop("component")
    items = written(items.withColumn("row", F.monotonically_increasing_id()), "packing-items")
    total = items.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    packed = (items.where("n_words > 0")
              .withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "cluster", "row"), F.lit(shards)))
              .groupBy("shard").applyInArrow(_shard(capacity, max_per_source), _OUT))
    none = items.where("n_words = 0").selectExpr(
        "doc_id", "0 AS piece", "0L AS start_word", "0L AS n_words",
        "CAST(NULL AS LONG) AS bin_id", "CAST(NULL AS LONG) AS bin_offset",
        "CAST(NULL AS LONG) AS bin_words")
    return packed.unionByName(none)


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
