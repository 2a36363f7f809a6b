"""Products at 32 bits, clean-up without offsets, and the memory of both."""

import tracemalloc

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltstone.catalog import ORACLE_SQL, QUERIES
from siltstone.functions import sentences as S
from siltstone.functions import text as T


def test_tokens_seen_by_products_of_32_bits(spark, tmp_path):
    e = pa.table({"vec_id": [1, 2], "embedding": pa.array([[0.29, 0.03] * 32, [-0.11, 0.5] * 32], pa.list_(pa.float32())), "label": pa.array([0, 1], pa.int32())})
    pq.write_table(e, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.register("embeddings", e)
    for name in ("penalty_presence_frequency", "penalty_repetition"):
        want = con.execute(ORACLE_SQL[name]).fetchall()
        got = QUERIES[name](spark, str(tmp_path)).select("vec_id", "total", "weighted").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_counts_of_clean_up_without_offsets(spark):
    texts = ["﻿a \t b\r\n\r\n\r\nc­\nd", "Page 12\nx  y\n", "", None, "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    for mode in ("conservative", "scanned_book"):
        full = df.select("id", T.clean_report(F.col("t"), mode).alias("c")).select("id", "c.counts", "c.snippets")
        assert sorted(df.select("id", T.clean_counts(F.col("t"), mode).alias("c")).select("id", "c.counts", "c.snippets").collect()) == sorted(full.collect())


def test_clean_up_holds_few_texts():
    column = pa.array(["some words  of a text " * 500] * 2000)
    kind = pa.struct([("counts", pa.map_(pa.string(), pa.int32()))])
    tracemalloc.start()
    T.in_slices(column, lambda t: {"counts": [("chars", len(t))]}, kind)
    assert tracemalloc.get_traced_memory()[1] < 5e6  # all texts are 22 MB
    tracemalloc.stop()


def test_sentences_are_sized_once(spark):
    plan = spark.createDataFrame([("a. b.",)], "t string").select(S.assessed(F.col("t"), True).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count") <= 3  # one for sizes and two in flags; there were nine


def test_no_offsets_without_passes(spark):
    df = spark.createDataFrame([("a  b",), (None,)], "t string").select(T.clean_report(F.col("t"), "none").alias("c"))
    assert [r.c and (r.c.text, r.c.offsets, r.c.counts, r.c.changes, r.c.snippets) for r in df.collect()] == [("a  b", None, {}, 0, []), None]
    assert df.where("c is not null").select(T.source_span(F.col("c"), F.lit(1), F.lit(4)).alias("s")).first().s == (1, 4)
    with pytest.raises(Exception, match="no such span"):
        df.where("c is not null").select(T.source_span(F.col("c"), F.lit(1), F.lit(5))).collect()
