"""Every query with SQL has the same rows as DuckDB over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest

from siltstone.catalog import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table):
    names = sorted(table.column_names)
    out = [tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in zip(*(table[n].to_pylist() for n in names))]
    return names, sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.register(t, pq.read_table(DATA / f"{t}.parquet"))
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours = QUERIES[name](spark, str(DATA)).toArrow()
    theirs = duck.execute(ORACLE_SQL[name]).to_arrow_table()
    assert rows(ours) == rows(theirs)
    kinds = lambda t: {n: str(t.schema.field(n).type).replace("large_", "") for n in t.column_names}
    assert kinds(ours) == kinds(theirs)
