"""Operator 11 against all pairs in exact integers."""

import math

import numpy as np
import pytest

from siltstone.llm import inner


def expected(rows, k=5, step=50):
    good = [(i, [math.floor(256 * v) for v in x]) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v * 256) for v in x)]
    out = []
    for qi, q in good:
        if qi % step == 0:
            scores = [(min(max(sum(a * b for a, b in zip(q, x, strict=True)), -(2**63)), 2**63 - 1), i) for i, x in good if i != qi and len(x) == len(q)]
            out += [(qi, r + 1, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda t: (-t[0], t[1]))[:k])]
    return sorted(out)


def got(spark, rows, kind="double", **cfg):
    found = inner.top_inner_products(spark, spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), cfg=inner.TopConfig(**cfg))
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())


SMALL = {"block": 64, "queries": 4, "chunk": 16, "seeds": 40, "sample": 100}


@pytest.mark.parametrize("shape", ["plain", "lengths", "low rank", "ties"])
def test_against_all_pairs(spark, shape):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16))
    if shape == "lengths":
        x *= np.exp(rng.normal(size=700))[:, None]
    if shape == "low rank":
        x = rng.normal(size=(700, 3)) @ rng.normal(size=(3, 16)) + 0.01 * x
    if shape == "ties":
        x = np.round(x[rng.integers(0, 9, 700)])
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    assert got(spark, rows, **SMALL) == expected(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (None, [9.0, 9.0]), (50, [1e306, 1.0]), (100, [0.0, 0.0]), (150, [1.0]), (7, [-1.0, 0.5]), (8, [1.0, 2.0]), (9, [0.001, -0.001]), (-50, [3.0, -2.0]), (8, [1.0, 2.0]), (200, [1e18, -1e18]), (201, [1e17, 1e17]), (250, [3.0] * 3), (251, [float(2**40), 1.0, 3.0])]
    assert got(spark, rows) == expected(rows)
    assert got(spark, rows, **SMALL) == expected(rows)


def test_fewer_candidates_than_k_and_none(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0])]) == []
    assert got(spark, [(50, [1.0])]) == []
    assert got(spark, [(50, [1.0]), (3, [2.0])]) == [(50, 1, 3, 131072)]


def test_other_columns_and_floats(spark):
    rows = [(i, [float(np.float32(v)) for v in np.random.default_rng(i).normal(size=8)]) for i in range(120)]
    frame = spark.createDataFrame([(i, x, i, "a", 1.0) for i, x in rows], "vec_id long, embedding array<float>, row_no long, block string, score double")
    found = inner.top_inner_products(spark, frame)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == expected(rows)


def test_bounds_leave_work_out():
    """On vectors of low rank most pairs end before their exact product."""
    rng = np.random.default_rng(2)
    x = inner.scaled(rng.normal(size=(4000, 4)) @ rng.normal(size=(4, 32)) * np.exp(rng.normal(size=4000))[:, None])
    length = np.sqrt((x**2).sum(1))
    x, length = x[np.argsort(-length)], np.sort(length)[::-1]
    none = np.zeros(20, np.int64)
    top = inner.TopK(x[::200], np.arange(20) - 100, none, none, np.zeros(20, bool), 5, inner.singular_basis(x))
    seen, take = [], top._take
    top._take = lambda row, ids, score: (seen.append(len(row)), take(row, ids, score))
    top.meet(x, np.arange(4000), length, 256)
    assert sum(seen) < 0.1 * 20 * 4000
    order = np.lexsort((np.tile(np.arange(4000), (20, 1)), -(x[::200] @ x.T)))[:, :5]
    assert (top.found[1].reshape(20, 5) == order).all()
