import math

import numpy as np
import pytest

from risklens.llm.ann import DIMS, AnnRules, Cells, ann_query, chi_square, nearest

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def exact(rows, every, k):
    ids = np.array([i for i, v in rows], dtype=np.int64)
    x = np.array([v for _, v in rows], dtype=np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        cos = (x @ x[q]) / (norm * norm[q])
        order = sorted((c for c in range(len(ids)) if c != q), key=lambda c: (-round(cos[c], 12), ids[c]))[:k]
        out[int(ids[q])] = [(int(ids[c]), cos[c]) for c in order]
    return out


def clustered(n, dim, seed, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = (centres[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, dim))).astype(np.float32)
    return [(i, [float(v) for v in r]) for i, r in enumerate(x)]


@pytest.mark.parametrize("n,block", [(1500, 100), (700, 4096)])
def test_recall_and_scores(spark, n, block):
    rows = clustered(n, 24, n)
    rows += [(n + i, rows[7][1]) for i in range(20)]  # a vector that many share
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    got = {}
    for r in nearest(df, 20, AnnRules(block=block)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    want = exact(rows, 20, 5)
    assert set(got) == set(want)
    hits = 0
    by_id = dict(rows)
    for q, found in got.items():
        assert [r["rank"] for r in found] == list(range(1, 6)) and q not in [r.vec_id for r in found]
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        for r in found:
            a, b = np.array(by_id[q]), np.array(by_id[r.vec_id])
            assert math.isclose(r.score, a @ b / math.sqrt((a @ a) * (b @ b)), rel_tol=1e-12)
        hits += len({r.vec_id for r in found} & {i for i, _ in want[q]})
    assert hits >= 0.93 * 5 * len(want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (50, [nan, 1.0], 1),
            (6, [inf, 1.0], 1), (7, [1.0, 0.0, 0.0], None), (None, [1.0, 1.0], 1), (8, [], 1), (100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as cell", "3 as score")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert ann_query(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ann_query(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)).collect() == []


def test_chi_square_and_cells():
    rng = np.random.default_rng(0)
    draws = (rng.standard_normal((200000, DIMS)) ** 2).sum(axis=1)
    for x in (2.0, 7.0, 15.5):
        assert abs(chi_square(np.array(x)) - (draws <= x).mean()) < 0.005
    points = rng.standard_normal((1000, DIMS))
    sizes = np.bincount(Cells(points, 3).of(points), minlength=8)
    assert sizes.sum() == 1000 and sizes.min() > 100
    assert set(Cells(np.zeros((5, DIMS)), 2).of(np.zeros((5, DIMS))).tolist()) == {0}
