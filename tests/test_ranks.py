"""Row numbers by ranges against sorted lists: ties, nulls, empty tables, clashing names, any page."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import ranks
from siltstone.operators.retrieval import page_of, replace_store
from siltstone.sources.shared import Workspace


def table(spark, n, per=50):
    rng = random.Random(n)
    rows = [(rng.choice(["", "a", "ä", "b", None]), rng.randint(0, 5), i if rng.random() < 0.9 else None) for i in range(n)]
    df = spark.createDataFrame(rows + rows[:7], "k string, part_ int, at_ long").repartition(5)
    order = [F.col("k"), F.col("part_").desc(), F.col("at_")]
    least = lambda x: (x is not None, (x or "").encode() if isinstance(x, str) else x)
    return ranks.sorted_table(Workspace(spark, "ranks"), df, order, rows_per_part=per), sorted(rows + rows[:7], key=lambda r: (least(r[0]), -r[1], least(r[2])))


def test_numbers(spark):
    got, want = table(spark, 700)
    assert got.n == 707 and len(got.parts) > 5
    rows = got.numbered().orderBy("row_no").collect()
    assert [tuple(r) for r in rows] == [(*r, i) for i, r in enumerate(want)]


@pytest.mark.parametrize(("start", "stop"), [(0, 1), (0, 707), (49, 260), (700, 900), (707, 710), (-5, 3), (10, 10)])
def test_between(spark, start, stop):
    got, want = table(spark, 700)
    assert {r.row_no: tuple(r)[:3] for r in got.between(start, stop).collect()} == {i: r for i, r in enumerate(want) if start <= i < stop}


def test_a_page_reads_its_range_alone(spark):
    got, want = table(spark, 700)
    for page, first in ((1, 0), (3, 20), (-4, 0), (71, 700), (10**9, 700)):
        rows = page_of(got, page, 10)
        assert [tuple(r)[:3] for r in rows.orderBy("row_no").collect()] == want[first : first + 10]
        assert len(rows.inputFiles()) <= 2
    plan = page_of(got, 70, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan and "PushedFilters: [IsNotNull" in plan


def test_empty_table(spark):
    got, _ = table(spark, 0)
    assert got.n == 0 and got.numbered().count() == 0 and page_of(got, 5, 10).count() == 0


def test_store_is_replaced(spark):
    old = spark.createDataFrame([(5, "s", 1, "x")], "id long, source string, start long, digest string")
    assert replace_store(old).count() == 0
    new = spark.createDataFrame([(9, "b", 1, "x"), (9, "a", 2, "y"), (9, "a", 1, "z")], old.schema)
    assert sorted(tuple(r) for r in replace_store(old, new).collect()) == [(0, "a", 1, "z"), (1, "a", 2, "y"), (2, "b", 1, "x")]
