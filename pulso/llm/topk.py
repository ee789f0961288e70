"""Exact top-k inner product search by the threshold algorithm.

Vectors become integer points, ``floor(scale * x)`` of each component. Candidates
are dealt into blocks; in a block every dimension has its list of candidates sorted
by component. A query reads the lists of its non-zero components in parallel, from
the top where its own component is positive and from the bottom where it is
negative, a run of entries at a time. Each newly seen candidate is scored in full.
The threshold is the score that a candidate at the lists' current entries would
have: nothing unseen can score above it. A query ends when its kth score is above
the threshold, or the lists are read. Blocks' answers meet in a last top-k by query.

Equal points of a block are kept as one candidate with their ``k + 1`` smallest ids,
which is all that a top-k by smallest id can use.

Blocks of candidates meet blocks of queries, never all rows with all rows at once:
a task holds ``CANDIDATES`` and ``QUERIES`` points. The work of an exact search is
still the product of both numbers, less what the threshold spares.

Defined cases: a null vector, or one with a null, NaN or infinite component, takes
no part, neither as query nor as candidate. Vectors of unequal length count as
filled up with zeros; an empty one scores 0. The query's own row is left out by its
id, so rows that share an id don't find each other. Scores are exact as long as they
fit a long (beyond: they saturate). Fewer candidates than ``k``: all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import small_batches, table, written

K = 5
SCALE = 256
QUERY_STEP = 50            # queries: ids divisible by it
CANDIDATES = 8192          # points in a block
QUERIES = 2048
_FIRST = 32                # entries read of each list in the first run; then doubled

_EXACT = float(1 << 52)     # integers below it are exact as doubles
_BLOCK = "query_id long, vec_id long, score long"


def points(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, point array<long>`` of the valid vectors."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    valid = F.forall(x, lambda v: F.coalesce(
        ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .where(valid)
            .select(F.col("vec_id").cast("long"),
                    F.transform(x, lambda v: F.floor(v * float(scale)).cast("long")).alias("point")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of longs as rows of ``width``, filled up with zeros."""
    rows = column.combine_chunks()
    size = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), np.int64)
    first = np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - first] = flat
    return out


class SortedLists:
    """A block of points with a sorted list of rows for each dimension."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        order = np.lexsort((ids, *matrix.T))
        ids, matrix = ids[order], matrix[order]
        new = np.ones(len(ids), bool)
        new[1:] = (matrix[1:] != matrix[:-1]).any(axis=1)
        at = np.flatnonzero(new)
        self.ids = [np.unique(x)[:k + 1].tolist() for x in np.split(ids, at[1:])]
        self.only: dict[int, list[int]] = {}        # points that one id alone has
        for r, own in enumerate(self.ids):
            if len(own) == 1:
                self.only.setdefault(own[0], []).append(r)
        self.points = matrix[at]
        self.top = int(np.abs(self.points).max(initial=0))
        self.floats = self.points.astype(np.float64)
        self.lists = np.argsort(self.points, axis=0, kind="stable").astype(np.int32).T.copy()
        self.sorted = np.sort(self.floats, axis=0).T.copy()

    def scores(self, rows: np.ndarray, query: np.ndarray, reach: float) -> np.ndarray:
        """Exact integer scores of some rows (as floats while those are exact)."""
        if reach < _EXACT:
            q = query.astype(np.float64)
            if 4 * len(rows) > len(self.points):       # dearer to gather than to score all
                return (self.floats @ q)[rows]
            return self.floats[rows] @ q
        exact = self.points[rows].astype(object) @ query.astype(object)
        return np.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in exact], np.int64)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
        """The best ``(score, id)`` and how many points were scored."""
        n = len(self.points)
        reach = float(self.top) * float(np.abs(query.astype(np.float64)).sum())
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        weight = np.concatenate([query[up], query[down]]).astype(np.float64)
        unseen = np.ones(n, bool)
        best: list[tuple[int, int]] = []
        unseen[self.only.get(query_id, [])] = False    # the query's own points take no part
        depth, step, scored = 0, _FIRST, 0
        while depth < n:
            stop = min(n, depth + step) if len(weight) else n
            seen = np.zeros(n, bool)
            if len(weight):
                seen[self.lists[up, n - stop:n - depth]] = True
                seen[self.lists[down, depth:stop]] = True
            else:
                seen[:] = True                         # a zero query: every score is 0
            rows = np.flatnonzero(seen & unseen)
            unseen[rows] = False
            scored += len(rows)
            depth, step = stop, 2 * step
            s = self.scores(rows, query, reach)
            if len(best) == k:
                keep = s >= best[-1][0]
                rows, s = rows[keep], s[keep]
            if len(s) > k:                             # each point left has another id to offer
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                rows, s = rows[keep], s[keep]
            new = [(int(v), i) for r, v in zip(rows.tolist(), s.tolist())
                   for i in self.ids[r] if i != query_id]
            best = sorted(best + new, key=lambda x: (-x[0], x[1]))[:k]
            if len(best) == k and len(weight) and depth < n:
                edge = np.concatenate([self.sorted[up, n - depth], self.sorted[down, depth - 1]])
                bound = float(edge @ weight)
                if bound + reach * 1e-12 < best[-1][0]:
                    break
        return best, scored


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            width = max(1, *(int(pc.max(pc.list_value_length(t["point"])).as_py()) for t in (left, right)))
            block = SortedLists(right["vec_id"].to_numpy(), _matrix(right["point"], width), k)
            for query_id, query in zip(left["vec_id"].to_pylist(), _matrix(left["point"], width)):
                out += [(query_id, i, s) for s, i in block.search(query_id, query, k)[0]]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), cols)})
    return run


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, query_step: int = QUERY_STEP,
          candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest inner products."""
    small_batches(vectors.sparkSession, 4096)
    # a row that repeats id and vector says nothing new: once, so that copies don't fill a block
    rows = written(points(vectors, scale).distinct(), "points")
    wanted = F.col("vec_id") % query_step == 0
    n, m = rows.agg(F.count("*"), F.count_if(wanted)).first()
    blocks, asked = max(1, -(-n // candidates)), max(1, -(-m // queries))
    spread = F.xxhash64("vec_id", "point", F.lit("block"))
    left = (rows.where(wanted).withColumn("b", F.pmod(spread, F.lit(asked)))
            .withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    # rows that share an id and all its copies must not meet in one block only: deal by id and point
    right = (rows.withColumn("a", F.pmod(F.xxhash64("vec_id", "point"), F.lit(blocks)).cast("int"))
             .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(asked - 1)).cast("array<long>"))))
    found = (left.groupBy("a", "b").cogroup(right.groupBy("a", "b"))
             .applyInArrow(_search(k), _BLOCK))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def query(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH p AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM p q JOIN p c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
