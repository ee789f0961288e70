import math
import random
from fractions import Fraction

import numpy as np
import pytest

from pulso.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n long"


def rows_of(vectors, start=0):
    return [(start + i, None if v is None else [None if c is None else float(c) for c in v], 0, 9, 9)
            for i, v in enumerate(vectors)]


def spectrum(values, seed=0):
    g = np.random.default_rng(seed)
    q = np.linalg.qr(g.standard_normal((len(values), len(values))))[0]
    v = q @ np.diag(values) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values", [
    list(range(64, 0, -1)), [5.0] * 40 + [1.0] * 24, [3.0, 3.0] + [2.0] * 10 + [0.0] * 20,
    [1e6] + [1.0] * 31, [2.0] * 31 + [1.0] * 33, [7.0]])
def test_components_are_the_eigenvectors(values):
    v = spectrum(values)
    want = sorted((x for x in values if x > 0), reverse=True)[:W.COMPONENTS]
    e, u = W.components(v)
    assert len(e) == len(want) and np.allclose(e, want, rtol=1e-12)
    assert np.abs(v @ u - u * e).max() < 1e-13 * max(values)
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13


def test_inertia_counts():
    g = np.random.default_rng(4)
    for n in (1, 2, 3, 10, 40):
        a = g.standard_normal((n, n))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for s in g.uniform(e[0] - 1, e[-1] + 1, 20):
            assert W.above(a, s) == (e > s).sum()
    assert W.above(np.zeros((4, 4)), 0.0) == 0
    assert W.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1     # no pivot on the diagonal


def test_no_eigenvalue_lies_outside_the_intervals():
    g = np.random.default_rng(5)
    v = spectrum(list(g.uniform(0, 1, 90)))
    e = np.linalg.eigvalsh(v)
    parts = W.intervals(v, 32, 0.0)
    assert sum(n for *_, n in parts) == 32
    for low, high, n in parts:
        assert ((e > low) & (e <= high)).sum() == n <= W.PER_INTERVAL


def brute(vectors):
    ok = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 10 ** 6 for c in v] for v in ok]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    far = [[n * c - s for c, s in zip(v, sums)] for v in x]
    c = np.array([[float(Fraction(d, n)) for d in v] for v in far])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    k = min(W.COMPONENTS, len(e))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, [sum(d * d for d in v) for v in far], c @ u / np.sqrt(e), e / np.trace(v)


def test_equal_to_a_dense_decomposition(spark):
    g = np.random.default_rng(1)
    vectors = [list(v) for v in (g.standard_normal((300, 40)) * np.linspace(3, 0.2, 40)).astype(np.float32)]
    bad = [None, [None] + [0.5] * 39, [float("nan")] * 40, [float("inf")] + [0.0] * 39,
           [float("-inf")] * 40, [], [1.0, 2.0]]
    vectors += vectors[:5]                              # repeated rows count each time
    df = spark.createDataFrame(rows_of(vectors) + rows_of(bad, 1000), SCHEMA).repartition(7)
    got = {}
    for r in W.whiten(df).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    n, deviation, white, share = brute(vectors)
    assert len(got) == n == 305
    values = np.array([[got[i][k + 1].whitened for k in range(32)] for i in range(n)])
    sign = np.sign((values * white).sum(axis=0))
    assert np.abs(values * sign - white).max() < 1e-7
    assert [got[i][1].deviation for i in range(n)] == deviation
    assert np.allclose([got[0][k + 1].explained for k in range(32)], share, rtol=1e-10)
    assert {r.n for d in got.values() for r in d.values()} == {n}
    error = {r.identity_error for d in got.values() for r in d.values()}
    assert len(error) == 1 and error.pop() < 1e-9
    assert np.abs(values.T @ values / n - np.eye(32)).max() < 1e-9


def test_few_components_and_no_rows(spark):
    rnd = random.Random(2)
    flat = [[rnd.choice([0.0, 1.0]), 5.0, rnd.uniform(0, 9)] for _ in range(60)]    # a constant dimension
    df = spark.createDataFrame(rows_of(flat), SCHEMA)
    assert sorted({r.component for r in W.whiten(df).collect()}) == [1, 2]
    null_id = spark.createDataFrame([(None, *r[1:]) for r in rows_of(flat[:9])], SCHEMA)
    assert [r.vec_id for r in W.whiten(null_id, wanted=1).collect()] == [None] * 9
    assert W.whiten(df.where("false")).collect() == []
    assert W.whiten(spark.createDataFrame(rows_of([[1.0, 2.0]] * 5), SCHEMA)).collect() == []
    assert W.whiten(spark.createDataFrame(rows_of([[], None]), SCHEMA)).collect() == []


def test_sums_that_pass_64_bits_raise(spark):
    far = spark.createDataFrame(rows_of([[1e12], [-1e12], [0.0]]), SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        W.whiten(far).collect()
