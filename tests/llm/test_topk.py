import math
import random

import numpy as np

from pulso.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, step):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in ok:
        if q % step == 0:
            found = sorted({(-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q})
            best = {}
            for s, i in found:
                best.setdefault((s, i), None)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(list(best)[:k])]
    return sorted(out)


def test_threshold_search_is_exact_and_stops_early():
    g = np.random.default_rng(1)
    skewed = (g.pareto(1.0, (500, 6)) * 50).astype(np.int64)       # a few large values: lists end early
    block = T.SortedLists(np.arange(500), skewed, 5)
    scored = 0
    for i in range(40):
        got, n = block.search(i, skewed[i], 5)
        s = skewed @ skewed[i]
        want = sorted((-int(v), j) for j, v in enumerate(s) if j != i)[:5]
        assert got == [(-a, b) for a, b in want]
        scored += n
    assert scored < 40 * 500 / 2


def test_top_k_equals_brute_force(spark):
    rnd = random.Random(6)
    f = lambda: float(np.float32(rnd.uniform(-1, 1)))
    rows = [(i, [f() for _ in range(4)], 0) for i in range(120)]
    hot = [f() for _ in range(4)]
    rows += [(i, hot, 1) for i in range(200, 260)]                  # equal vectors: ties by id
    rows += [(300, None, 0), (301, [None, 1.0, 0.0, 0.0], 0), (302, [float("nan")] * 4, 0),
             (304, [float("inf"), 0.0, 0.0, 0.0], 0), (None, hot, 0), (305, [0.0] * 4, 0), (306, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 5, 5)
    for size in (10000, 37):
        got = sorted(map(tuple, T.top_k(df, query_step=5, candidates=size, queries=size).collect()))
        assert got == want


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (7, [1.0, 1.0], 0)], SCHEMA)
    assert [tuple(r) for r in T.top_k(df).collect()] == [(0, 1, 7, 256 * 256 + 512 * 256)]
    assert T.top_k(df.where("false")).collect() == []


def test_a_query_id_with_many_high_points(spark):
    """The query's own points are left out before the best are cut to k."""
    own = [(0, [float(9 - j), float(j)], 0) for j in range(8)]
    others = [(i, [1.0 / i, 0.5], 0) for i in range(1, 8)]
    both = [(9, [9.0, 0.0], 0)]                          # the point of another id as well
    rows = own + others + both + own[:3] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for i, v, _ in rows:
        if i == 0:
            for j, w, _ in rows:
                if j:
                    want.setdefault((sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w)), j), 0)
    best = sorted(want, key=lambda x: (-x[0], x[1]))[:5]
    for size in (10000, 4):
        got = sorted((r["rank"], r.vec_id, r.score) for r in T.top_k(df, query_step=50, candidates=size, queries=size)
                     .where("query_id = 0").collect())
        assert got == [(k + 1, j, s) for k, (s, j) in enumerate(best)]
