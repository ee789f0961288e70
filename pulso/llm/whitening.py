"""Embedding whitening by FEAST: contour integrals give the covariance's eigenvectors.

Each entry ``c`` of a vector becomes the integer ``floor(64 * c) + 1000000``. Spark jobs sum
the integer vectors (exactly), then the products of the centred ones: one d x d matrix from
each task, added up row by row. The covariance, d x d whatever the number of rows, is then
decomposed:

1. *Inertia counts.* The signs of a symmetric factorisation L D L' of V - s I (pivots of one
   or two rows) tell how many eigenvalues lie above the shift s. Bisection cuts the part of
   the spectrum that holds the wanted components into intervals of at most ``PER_INTERVAL``
   eigenvalues.
2. *Contour integrals.* For an interval, Gauss-Legendre quadrature of (z I - V)^-1 Y over a
   circle through its ends filters a random block Y onto the interval's eigenspace: a few
   complex shifted solves a round.
3. *Rayleigh-Ritz* in the orthonormalised block gives eigenvalues and vectors; rounds repeat
   until the residuals are at double precision.
4. The number found in each interval must be the inertia count, else the interval is done
   again with a larger block: no component is missed or found twice.

The whitened value of a row for a component is the centred vector's projection over the
square root of the eigenvalue. One more pass takes the covariance of the whitened values
and their largest departure from the identity.

Defined results: rows with a null vector, or a null or non-finite entry, are dropped. Rows
take part where their vector has the most frequent length of the rest (ties: the longer);
empty vectors have no components. Repeated rows and ids count and come out each time, null
ids too. Components whose eigenvalue is not above ``RANK`` times the trace (constant
dimensions, fewer rows than dimensions) do not exist, so an empty table, or one of equal
vectors, gives no rows. Other columns are not read. Numbers past 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

COMPONENTS = 32             # components returned, the first by falling eigenvalue
SCALE, SHIFT = 64, 1_000_000    # fixed values: x = floor(SCALE * c) + SHIFT
PER_INTERVAL = 12           # eigenvalues in one contour at most
NODES = 8                   # quadrature points on the upper half circle
ROUNDS = 12                 # filter rounds for one block
RESIDUAL = 1e-13            # of an eigenvector, over the norm of the covariance
RANK = 1e-12                # least eigenvalue over the trace
CELLS = 65_536              # values in one Arrow batch of results


# -- the decomposition -------------------------------------------------------------------

def above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``v`` above ``shift``: positive signs of D in L D L' = v - shift I,
    with the pivoting of Bunch and Kaufman."""
    a = v - shift * np.eye(len(v))
    bound, count, k, n = (1 + np.sqrt(17)) / 8, 0, 0, len(v)
    tiny = np.finfo(float).eps * max(np.abs(a).max(initial=0.0), np.finfo(float).tiny)

    def swap(i, j):
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        column = np.abs(a[k + 1:, k])
        most = column.max(initial=0.0)
        two = False
        if abs(a[k, k]) < bound * most:
            r = k + 1 + int(column.argmax())
            other = np.abs(a[k:, r])
            other[r - k] = 0
            widest = other.max()
            if abs(a[k, k]) * widest >= bound * most * most:
                pass
            elif abs(a[r, r]) >= bound * widest:
                swap(k, r)
            else:
                swap(k + 1, r)
                two = True
        if two:
            block, rest = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2]
            count += int((np.linalg.eigvalsh(block) > 0).sum())
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(block, rest.T)
            k += 2
        else:
            pivot, rest = a[k, k], a[k + 1:, k]
            count += pivot > tiny
            if abs(pivot) > tiny:
                a[k + 1:, k + 1:] -= np.outer(rest, rest / pivot)
            k += 1
    return int(count)


def intervals(v: np.ndarray, wanted: int, least: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues between) that together hold the ``wanted`` largest eigenvalues
    above ``least``, and those equal to the last one."""
    top = np.abs(v).sum(axis=1).max(initial=0.0) * (1 + 1e-12)      # Gershgorin
    close = 64 * np.finfo(float).eps * top
    floor = least if above(v, least) <= wanted else None
    if floor is None:
        low, high = least, top              # more than wanted above low, fewer or as many above high
        while high - low > close and above(v, high) != wanted:
            middle = (low + high) / 2
            if above(v, middle) > wanted:
                low = middle
            else:
                high = middle
        floor = high if above(v, high) == wanted else low
    out, todo = [], [(floor, top, above(v, floor))]
    while todo:
        low, high, n = todo.pop()
        if n > PER_INTERVAL and high - low > close:
            middle = (low + high) / 2
            upper = above(v, middle) - above(v, high)
            todo += [(low, middle, n - upper), (middle, high, upper)]
        elif n:
            out.append((low, high, n))
    return out


def contour(v: np.ndarray, low: float, high: float, count: int, seed: int = 3):
    """Eigenvalues in (low, high] and their vectors; ``count`` of them must come out."""
    size, eye = len(v), np.eye(len(v))
    norm = np.abs(v).sum(axis=1).max()
    centre, radius = (low + high) / 2, max((high - low) / 2, 8 * np.finfo(float).eps * norm)
    radius *= 1 + 1e-9
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi * (points + 1) / 2)
    random = np.random.default_rng(seed)
    slack = 64 * np.finfo(float).eps * norm
    block = min(size, count + max(4, count // 2))
    while True:
        y, done = random.standard_normal((size, block)), False
        for _ in range(ROUNDS):
            y = sum((w / 2 * radius * z * np.linalg.solve((centre + radius * z) * eye - v, y)).real
                    for z, w in zip(turn, weights))
            y = np.linalg.qr(y)[0]
            small = y.T @ v @ y
            e, u = np.linalg.eigh((small + small.T) / 2)
            y = y @ u
            near = np.argsort(np.abs(e - centre), kind="stable")[:count]
            left = np.linalg.norm(v @ y[:, near] - y[:, near] * e[near], axis=0) / norm
            if done:                    # one round more: what is left is rounding
                return e[near], y[:, near]
            done = left.max() <= RESIDUAL and np.abs(e[near] - centre).max() <= radius + slack
        if block == size:
            raise ArithmeticError(f"contour from {low} to {high}: {count} eigenvalues not found")
        block = min(size, 2 * block)


def components(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of the symmetric ``v``, falling, and their unit
    vectors as columns."""
    trace = float(np.trace(v))
    if not len(v) or trace <= 0:
        return np.zeros(0), np.zeros((len(v), 0))
    found = [contour(v, *part) for part in intervals(v, min(wanted, len(v)), RANK * trace)]
    if not found:
        return np.zeros(0), np.zeros((len(v), 0))
    u = np.linalg.qr(np.concatenate([x for _, x in found], axis=1))[0]      # orthonormal across intervals
    small = u.T @ v @ u
    e, w = np.linalg.eigh((small + small.T) / 2)
    first = np.argsort(-e, kind="stable")[:wanted]
    return e[first], (u @ w)[:, first]


# -- the passes over the vectors ---------------------------------------------------------

def integers(df: DataFrame, vector: str = "embedding", key: str = "vec_id"):
    """(vec_id, x) of the rows that take part, the length of x and the number of rows."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(SCALE * c).cast("long") + SHIFT)
    kept = df.where(F.col(vector).isNotNull() & ~bad).select(F.col(key).alias("vec_id"), x.alias("x"))
    most = (kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), F.desc("d")).first())
    dims, rows = (most.d, most.n) if most else (0, 0)
    return kept.where(F.size("x") == dims), dims, rows


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _exact(bound: float) -> None:
    if bound >= 2.0 ** 63:
        raise OverflowError("a sum over the vectors does not fit in 64 bits")


def _added(x: DataFrame, make, shape, dims: int, dtype=np.float64) -> np.ndarray:
    """The sum of ``make(batch of x)`` over all rows. Each task adds its batches up and sends
    one row for each row of the matrix; these are added up as they arrive, by row number."""
    height, width = shape
    kind = "long" if dtype == np.int64 else "double"
    schema = pa.schema([("i", pa.int32()), ("v", pa.list_(pa.from_numpy_dtype(dtype)))])

    def rows_of(totals):
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(
            [t.tolist() for t in totals.values()], schema.field("v").type)], schema=schema)

    def add(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = make(_matrix(b.column(0), dims)).reshape(height, width)
                if dtype == np.int64:
                    _exact(np.abs(part.astype(float) + (0 if total is None else total)).max())
                total = part if total is None else total + part
        if total is not None:
            yield rows_of(dict(enumerate(total)))

    def merge(batches):
        totals = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), _matrix(b.column(1), width)):
                if dtype == np.int64 and i in totals:
                    _exact(np.abs(v.astype(float) + totals[i]).max())
                totals[i] = totals[i] + v if i in totals else v.copy()
        if totals:
            yield rows_of(totals)

    sums = (x.select("x").mapInArrow(add, f"i int, v array<{kind}>")
            .repartition("i").mapInArrow(merge, f"i int, v array<{kind}>").collect())
    out = np.zeros(shape, dtype)
    for r in sums:
        out[r.i] = r.v
    return out


def whiten(df: DataFrame, wanted: int = COMPONENTS, vector: str = "embedding",
           key: str = "vec_id") -> DataFrame:
    """A row for each row that takes part and each component."""
    x, dims, rows = integers(df, vector, key)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    if not rows or not dims:
        return df.sparkSession.createDataFrame([], schema)

    def totals(m):
        _exact(float(np.abs(m).max()) * len(m))
        return m.sum(axis=0)

    sums = _added(x, totals, (1, dims), dims, np.int64)[0]

    def spread(m):              # rows * x - S: exact
        _exact(float(np.abs(m).max()) * rows + float(np.abs(sums).max()))
        return rows * m - sums

    def products(m):
        c = spread(m) / rows
        return c.T @ c

    v = _added(x, products, (dims, dims), dims) / rows
    v = (v + v.T) / 2
    e, u = components(v, wanted)
    project, share, k = u / np.sqrt(e), e / np.trace(v), len(e)

    def white(m):
        w = spread(m) / rows @ project
        return w.T @ w

    error = float(np.abs(_added(x, white, (k, k), dims) / rows - np.eye(k)).max()) if k else 0.0

    def task(batches):
        step = max(1, CELLS // max(k, 1))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                n, far = part.num_rows, spread(_matrix(part.column(1), dims))
                _exact(float((far.astype(float) ** 2).sum(axis=1).max()))
                values = far / rows @ project
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0).take(pa.array(np.repeat(np.arange(n), k))),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), n),
                    "n": np.full(n * k, rows), "deviation": np.repeat((far * far).sum(axis=1), k),
                    "whitened": values.ravel(), "explained": np.tile(share, n),
                    "identity_error": np.full(n * k, error)})

    return x.select(F.col("vec_id").cast("long"), "x").mapInArrow(task, schema)


def query(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
