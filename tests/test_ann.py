"""The approximate index against all pairs: recall on data of several shapes, the exact way, odd vectors."""

import numpy as np
import pytest

from siltstone.operators import ann
from siltstone.operators.vectors import top_k


def vectors(shape, n=3000, dim=32):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, dim))
    if shape == "clusters":
        x = np.repeat(rng.normal(size=(n // 30, dim)), 30, axis=0) + 0.3 * x
    if shape == "low rank":
        x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, dim)) + 0.05 * x
    if shape == "copies":
        x[: n // 3] = x[0]
    return np.float32(x / np.linalg.norm(x, axis=1)[:, None])


def exact(x, ids, k):
    s = np.round((x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]) @ (x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]).T, 9)
    return {i: [int(j) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k]] for i in ids}


@pytest.mark.parametrize("shape", ["plain", "clusters", "low rank", "copies"])
def test_recall(spark, tmp_path, shape):
    x = vectors(shape)
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "id long, vector array<float>")
    index = ann.AnnIndex(spark, str(tmp_path))
    report = index.build(df, ann.AnnConfig(per_cell=64, sample=1500))["report"]
    assert report["cells"] > 20 and report["rows"] == 3000
    asked = df.where("id % 50 = 0")
    rows = index.search(asked, 20).collect()
    want = exact(x, range(0, 3000, 50), 20)
    if shape == "copies":  # any of the copies is as near as another
        s = x.astype(float) @ x.astype(float).T
        hit = sum(s[r.query_id, r.id] >= s[r.query_id, want[r.query_id][-1]] - 1e-6 for r in rows)
    else:
        hit = sum(r.id in want[r.query_id] for r in rows)
    assert len(rows) == 60 * 20 and hit >= 0.9 * 60 * 20
    if shape == "plain":
        assert ann.recall(index.search(asked, 20), top_k(asked, df, 20)) == hit / 1200
        full = index.search(asked, 20, probes=10**6, rerank=3000).orderBy("query_id", "rank").collect()
        assert {i: [r.id for r in full if r.query_id == i] for i in want} == want
    if shape == "low rank":
        assert report["probes"] < report["cells"] / 2


def test_odd_vectors(spark, tmp_path):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, [0.6, 0.8]), (6, [0.6, 0.8]), (7, [None, 1.0]), (8, [-2.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    index = ann.AnnIndex(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no index"):
        index.search(df, 3)
    with pytest.raises(ValueError, match="no vector"):
        index.build(df.where("id in (2, 4)"))
    index.build(df)
    got = [(r.query_id, r.id, r.rank) for r in index.search(df.where("id in (1, 2, 3, 5)"), 3).orderBy("rank").collect()]
    assert got == [(1, 1, 1), (1, 6, 2), (1, 6, 3)]
    assert index.search(df.where("id is null"), 3).count() == 0
    assert [ann.results_each(n, q) for n, q in ((10, 3), (9, 3), (1, 5), (4, 0))] == [4, 3, 1, 4]
