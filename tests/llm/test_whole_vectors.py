"""Exact top-k search and hard negatives against all pairs."""

import math
from itertools import groupby

import numpy as np
import pytest

from relvec.llm import columnar_topk, one_bit_mining
from relvec.llm import whole_vectors as V

KIND = "vec_id long, embedding array<float>, label int, VEC_ID string, x string, score int"


def made(n, size, seed=0, labels=4):
    """Vectors with groups, ties, repeated rows, a hot label, nulls, a zero vector, other lengths and unusual numbers."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(7, size))
    x = (centre[rng.integers(0, 7, n)] + rng.normal(size=(n, size)) * 0.7).astype(np.float32)
    label = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, labels, n))
    rows = [(i - 60, [float(v) for v in x[i]], int(label[i])) for i in range(n)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(40)]  # ties
    rows += [rows[3], rows[3], (rows[5][0], rows[6][1], rows[5][2])]  # repeated rows, two vectors of one id
    rows += [(None, rows[0][1], 1), (2001, None, 1), (2050, [0.0] * size, 1), (2100, [], 1), (2150, [1.0, 2.0], 1)]
    rows += [(2200, [float("nan")] * size, 1), (2201, [float("inf")] * size, 1), (2202, [None] * size, 1), (2203, rows[9][1], None)]
    return [(*r, "a", "b", 1) for r in rows]


def sound(rows, size):
    return [(r[0], [math.floor(256 * v) for v in r[1]], r[2]) for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == size
            and all(v is not None and math.isfinite(v) for v in r[1])]


def best(q, rows, k):
    found = sorted((-sum(a * b for a, b in zip(q[1], c[1])), c[0]) for c in rows if c[0] != q[0])
    return [(i, -s) for s, i in found[:k]]


@pytest.mark.parametrize("n, size", [(700, 13), (900, 70), (3, 64)])
def test_top_k_equals_all_pairs(spark, n, size):
    rows = made(max(n, 60), size, seed=n)
    frame = spark.createDataFrame(rows, KIND).repartition(5)
    want = []
    whole = sound(rows, size)
    for q in {(r[0], tuple(r[1])) for r in whole if r[0] % 50 == 0}:
        want += [(q[0], rank, i, s) for rank, (i, s) in enumerate(best(q, whole, 5), 1)]
    found = columnar_topk.top_k(frame)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 10


@pytest.mark.parametrize("n, size", [(900, 13), (700, 70)])
def test_hard_negatives_equal_all_pairs(spark, n, size):
    rows = made(n, size, seed=n + 1)
    whole = [(i, x, (y + 1) % 10 if i % 7 == 0 else y) for i, x, y in sound(rows, size) if y is not None]
    want = []
    for a in {(r[0], tuple(r[1]), r[2]) for r in whole if r[0] % 50 == 0}:
        others = best(a, [r for r in whole if r[2] != a[2]], len(whole))
        for p, s in best(a, [r for r in whole if r[2] == a[2]], 5):
            want += [(a[0], p, rank, i, s, t) for rank, (i, t) in enumerate([o for o in others if 50 * s <= 100 * o[1] <= 95 * s][:3], 1)]
    found = one_bit_mining.hard_negatives(spark.createDataFrame(rows, KIND).repartition(4))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 50


def test_empty_and_small_tables(spark):
    for rows in ([], [(0, [1.0, 2.0], 1)], [(0, None, 1)]):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        assert columnar_topk.top_k(frame).count() == one_bit_mining.hard_negatives(frame).count() == 0
    two = spark.createDataFrame([(0, [0.0, 0.0], 1), (1, [1.0, 1.0], 1)], "vec_id long, embedding array<double>, label long")
    assert [tuple(r) for r in columnar_topk.top_k(two).collect()] == [(0, 1, 1, 0)]


def test_too_large_numbers_fail(spark):
    kind = "vec_id long, embedding array<double>"
    with pytest.raises(Exception, match="too large"):
        columnar_topk.top_k(spark.createDataFrame([(0, [1e30]), (1, [1.0])], kind)).collect()
    large = spark.createDataFrame([(0, [1e6] * 3), (1, [-1e6 - 1] * 3)], kind)  # scores beyond 52 bits are exact too
    assert [r.score for r in columnar_topk.top_k(large).collect()] == [-3 * 256_000_000 * 256_000_256]


def test_scan_abandons_and_keeps_what_counts():
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(size=(4000, 64)) * np.geomspace(400, 4, 64)).astype(np.int64)
    edges = [*range(0, 64, columnar_topk.COLUMNS), 64]
    q, rest = x[:20].astype(float), columnar_topk._remaining(x, edges)
    every = (x[:20] @ x.T)
    limit = np.sort(every, axis=1)[:, -5]
    columns = [np.ascontiguousarray(x[:, a:b].T).astype(float) for a, b in zip(edges, edges[1:])]
    i, j, score = columnar_topk.scan(q, rest[:20], columns, rest, limit, edges)
    assert (score == every[i, j]).all()
    assert {(a, b) for a, b in zip(i, j) if every[a, b] >= limit[a]} == {(a, b) for a, b in zip(*np.nonzero(every >= limit[:, None]))}


def test_intervals_hold_every_score():
    rng = np.random.default_rng(2)
    for size in (5, 64, 100):
        x = np.rint(rng.normal(size=(300, size)) * 100).astype(np.int64)
        x[7] = 0
        words, aligned, left = one_bit_mining.codes(x)
        planes = one_bit_mining.Planes(x[:10])
        pairs = np.indices((10, 300)).reshape(2, -1)
        score, seen = (x[pairs[0]] * x[pairs[1]]).sum(1), []

        def wanted(i, low, high):
            seen.append(high - low)
            assert (low <= score).all() and (score <= high).all()
            return np.ones(len(i), bool)

        one_bit_mining.filtered(planes, *pairs, words, aligned, left, V.norms(x), wanted)
        assert all(b.mean() < a.mean() for a, b in zip(seen, seen[1:]))  # each level narrows
