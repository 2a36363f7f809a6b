"""Stop strings and natural order against loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T


def stopped(text, stops):
    """By loops: the first stop string of the list that stands in the text, else the longest start of the first that the text ends with."""
    for stop in stops:
        for i in range(len(text)):
            if text[i : i + len(stop)] == stop:
                return text[:i]
    for stop in stops:
        for n in range(len(stop) - 1, 0, -1):
            if text[len(text) - n :] == stop[:n] and len(text) >= n:
                return text[: len(text) - n]
    return text


@pytest.mark.parametrize("stops", [("aba", "c"), ("bb", "ab", "cab")])
def test_stops_against_loops(spark, stops):
    rng = random.Random(len(stops))
    texts = ["".join(rng.choice("abcd"[: rng.randint(2, 4)]) for _ in range(rng.randint(0, 6))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.cut_at_stop(F.col("t"), stops).alias("x")).collect()
    assert [r.x for r in sorted(rows)] == [stopped(t, stops) for t in texts]


def test_natural_order(spark):
    names = ["a10", "a9", "a", "a ", "a007", "a7b", "b" + "9" * 30, "b1" + "0" * 30, "A8", "12", "7x", "", "a10b2", "a10b10"]
    rows = spark.createDataFrame([(n,) for n in names], "t string").orderBy(T.natural_key(F.col("t")), "t").collect()
    key = lambda t: [int(p) if i % 2 else p for i, p in enumerate(re.split("([0-9]+)", t.lower()))]
    assert [r.t for r in rows] == sorted(names, key=lambda t: (key(t), t))
