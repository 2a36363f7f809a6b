"""Counts of eligible candidates against all pairs, and exact search whose tasks hold few products at a time."""

import random
import tracemalloc

import numpy as np

from siltstone.operators.retrieval import eligible_counts, met_criteria
from siltstone.operators.vectors import best_of


def test_counts_of_eligible(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["", "a", "b b", "b b", "c c c", None, "d d d d d"]), r.choice([0, 1, 1])) for i in range(120)]
    rows = [(i, t, s, len(t.split()) if t is not None else None) for i, t, s in rows]
    asked = [(i, t, s, n // 2 if n is not None else None, r.choice([None, n]) if n is not None else None) for i, t, s, n in rows if i % 4 == 0]
    want = []
    for q, t, s, low, high in asked:
        fit = [i for i, u, v, n in rows if None not in (t, u) and v == s and u != t and n >= low and (high is None or n <= high)]
        if fit:
            want.append((q, len(fit), min(fit) if high is None else None))
    got = eligible_counts(spark.createDataFrame(rows, "id long, text string, sentences int, size int"), spark.createDataFrame(asked, "query_id long, text string, sentences int, low long, high long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_counts_make_no_pairs(spark):
    # 40,000 candidates of one number of sentences and 2,000 queries: 80 M pairs
    c = spark.range(40_000).selectExpr("id", "concat('t', id % 30000) AS text", "1 AS sentences", "int(id % 30000 % 7) AS size")
    q = c.where("id % 20 = 0").selectExpr("id AS query_id", "text", "sentences", "0L AS low", "CAST(NULL AS long) AS high")
    found = eligible_counts(c, q)
    got = {r.query_id: (r.candidates, r.first) for r in found.collect()}
    assert len(got) == 2000 and got[0] == (39_998, 1) and got[20_000] == (39_999, 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_best_of_rows_holds_little():
    x = np.random.default_rng(1).integers(-3, 4, (64, 5000)) / 4
    x[3, 7] = np.nan
    i, j, s = best_of(x, 20)
    for row in range(64):
        want = sorted(range(5000), key=lambda c: (-(np.inf if np.isnan(x[row, c]) else x[row, c]), c))[:20]
        assert list(j[i == row]) == want
    assert len(best_of(x[:, :5], 20)[0]) == 64 * 5
    tracemalloc.start()
    best_of(np.random.default_rng(2).random((64, 8192)), 20)
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()


def test_hits_of_questions_without_passages(spark):
    c = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (3, "")], "question long, criterion string")
    p = spark.createDataFrame([(1, "a cat"), (3, "x")], "question long, passage string")
    assert sorted(map(tuple, met_criteria(c, p).collect())) == [(1, 1, 2), (2, None, 1), (3, 1, 1)]
