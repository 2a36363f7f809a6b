"""Operator 12 against a plain rendering of its contract, in lists, file by file."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter
from urllib.parse import unquote, urlparse

import duckdb
import pyarrow.parquet as pq
import pytest

from siltstone.llm import erasure

KINDS = {
    "clients": "client_id long, master_id long, source string, balance double",
    "clicks": "click_id long, client_id long, kind string, value double",
    "sales": "sale_id long, client_id long, status string, total double",
    "sale_lines": "sale_id long, line_no int, flag string, amount double",
}


def crc(x):
    return zlib.crc32(b"" if x is None else str(x).encode())


def low(x):
    return (x is not None, x)


def expected(tables, columns):
    """Per file: table, file_no, rows, erased, cents, rewritten, ids, columns, and the rows themselves."""
    at = {t: {c: i for i, c in enumerate(columns[t])} for t in tables}
    master_of = {}
    for r in tables["clients"]:
        c, m = r[at["clients"]["client_id"]], r[at["clients"]["master_id"]]
        if m is not None:
            master_of.setdefault(m, set()).add(c)
    clicks = Counter(r[at["clicks"]["client_id"]] for r in tables["clicks"])
    chosen = {m for m in master_of if crc(m) % 100 == 0}
    if master_of:
        chosen.add(min(master_of, key=lambda m: (-sum(clicks[c] for c in master_of[m] if c is not None), m)))
    clients = {r[at["clients"]["client_id"]] for r in tables["clients"] if r[at["clients"]["master_id"]] in chosen} - {None}
    sales = {r[at["sales"]["sale_id"]] for r in tables["sales"] if r[at["sales"]["client_id"]] in clients} - {None}
    owner = {r[at["sales"]["sale_id"]]: r[at["sales"]["client_id"]] for r in tables["sales"]}
    hit = {
        "clients": lambda r: r[at["clients"]["master_id"]] in chosen, "clicks": lambda r: r[at["clicks"]["client_id"]] in clients,
        "sales": lambda r: r[at["sales"]["client_id"]] in clients, "sale_lines": lambda r: r[at["sale_lines"]["sale_id"]] in sales,
    }
    out = {}
    for t, rows in tables.items():
        client = (lambda r: owner.get(r[at[t]["sale_id"]]) if r[at[t]["sale_id"]] is not None else None) if t == "sale_lines" else (lambda r: r[at[t]["client_id"]])
        rows = sorted(rows, key=lambda r: (crc(client(r)), *map(low, r)))
        size = 1 + len(rows) // 150
        for n, i in enumerate(range(0, len(rows), size)):
            part = rows[i : i + size]
            kept = [r for r in part if not hit[t](r)]
            if kept:
                x = at[t][erasure.AMOUNTS[t]]
                cents = sum(math.floor(100 * r[x] + 0.5) for r in kept if r[x] is not None)
                ids = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in kept).encode()).hexdigest()
                out[t, n] = (len(kept), len(part) - len(kept), cents, len(kept) < len(part), ids, ",".join(columns[t]), kept)
    return out


def path_of(uri):
    return unquote(urlparse(uri).path)


def check(got, want):
    assert {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256, r.columns) for r in got} == {k: v[:6] for k, v in want.items()}
    folders = {os.path.dirname(path_of(r.path)) for r in got}
    assert {os.path.join(f, x) for f in folders for x in os.listdir(f) if not x.startswith(".")} == {path_of(r.path) for r in got}
    for r in got:
        kept = want[r.table_name, r.file_no][6]
        file = pq.ParquetFile(path_of(r.path))
        assert [tuple(x.values()) for x in file.read().to_pylist()] == kept
        for g in range(file.metadata.num_row_groups):
            group, ids = file.metadata.row_group(g).column(0), [x[0] for x in kept if x[0] is not None]
            if ids and group.statistics.has_min_max and file.metadata.num_row_groups == 1:
                assert (group.statistics.min, group.statistics.max) == (min(ids), max(ids))


def shop(seed, n):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.05 else x
    client = lambda: maybe(7 if rng.random() < 0.3 else rng.randrange(n))
    clients = [(maybe(i), maybe(i if rng.random() < 0.8 else rng.randrange(n)), maybe("é" * rng.randint(0, 2)), maybe(rng.uniform(-9, 9))) for i in range(n)]
    clicks = [(maybe(i), client(), maybe("view"), maybe(round(rng.uniform(-9, 99), 2))) for i in range(4 * n)]
    sales = [(i if rng.random() < 0.97 else None, client(), maybe("done"), maybe(float(i))) for i in range(2 * n)]
    lines = [(maybe(3 if rng.random() < 0.3 else rng.randrange(2 * n + 20)), rng.randint(1, 3), maybe("kept"), maybe(0.005 * i)) for i in range(5 * n)]
    return {"clients": clients + clients[:3], "clicks": clicks + clicks[:5], "sales": sales, "sale_lines": lines + lines[:9]}


@pytest.mark.parametrize(("seed", "n"), [(1, 90), (2, 40)])
def test_files_against_lists(spark, seed, n):
    tables = shop(seed, n)
    frames = {t: spark.createDataFrame(rows, KINDS[t]) for t, rows in tables.items()}
    check(erasure.erase_from_shop(spark, frames).collect(), expected(tables, {t: f.columns for t, f in frames.items()}))


def test_empty_tables(spark):
    frames = {t: spark.createDataFrame([], k) for t, k in KINDS.items()}
    assert erasure.erase_from_shop(spark, frames).collect() == []
    frames["clients"] = spark.createDataFrame([(1, 1, "a", None), (2, None, None, 1.0), (None, 3, None, 2.0)], KINDS["clients"])
    got = erasure.erase_from_shop(spark, frames).collect()
    check(got, expected({t: [tuple(r) for r in f.collect()] for t, f in frames.items()}, {t: f.columns for t, f in frames.items()}))


def test_clashing_columns(spark):
    more = {"clients": "k", "clicks": "row_number_", "sales": "n", "sale_lines": "key"}
    tables = {t: [(*r, i % 3) for i, r in enumerate(rows)] for t, rows in shop(3, 30).items()}
    frames = {t: spark.createDataFrame(rows, f"{KINDS[t]}, {more[t]} int") for t, rows in tables.items()}
    check(erasure.erase_from_shop(spark, frames).collect(), expected(tables, {t: f.columns for t, f in frames.items()}))


def test_unmounted_folder_is_refused():
    with pytest.raises(ValueError, match="mounted"):
        erasure.mounted("hdfs://host/folder")


def test_query_on_given_tables(spark):
    from siltstone.llm import entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    tables, columns = {}, {}
    for t in KINDS:
        found = con.execute(f"SELECT * FROM '{folder}/{t}.parquet'")
        columns[t] = [c[0] for c in found.description]
        tables[t] = found.fetchall()
    check(entry.QUERIES["op12_cascading_erasure"](spark, folder).collect(), expected(tables, columns))
