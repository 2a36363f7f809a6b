"""Operator 12: erasure that cascades over tables, file by file, with an embedded DuckDB in each file's task.

1. A table is sorted once by a key and all its columns (``operators/ranks``); its files of equally many rows are cut out of
   the sorted ranges, each by one task that streams, and a line for each file keeps the lowest and the highest sort key.
2. Victims are found by joins, as keys of each table beside the sort key that they were filed under.
3. A key is routed to the files whose range of sort keys holds it, by halving over the files' lines, and written as one shard
   for each file.
4. A task for each file with a shard opens the file and the shard in DuckDB, counts the victims, and where there are some
   copies the rest, in the order of the original row numbers, to a new file, whose statistics come from these rows alone.
5. When all tasks have ended, files that aren't part of the result are removed: replaced and emptied ones, and what lost
   attempts left.  Until then no original is touched, so that any task can be run again.

A table has at most ``files`` files, so the driver sees that many lines for each table, never keys or rows.  DuckDB opens
files by itself: the shared folder must be mounted on all machines (a ``file:`` address), which is checked first.

A null key is filed under 0, the checksum of the empty text, and is nobody's.  Rows may repeat; each is a row.  A table without
rows has no files.  Names of columns are free and may clash with any used inside: in between they are numbered.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siltstone.llm.storage import Workspace, delete_path
from siltstone.llm.streams import trimmed
from siltstone.operators.ranks import sorted_table

_NULLS_FIRST = -(1 << 63)


@dataclass(frozen=True)
class ErasureConfig:
    """``files`` is the divisor that gives the rows of a file; ``memory`` is DuckDB's, beyond which it spills to the shared folder."""

    files: int = 150
    batch: int = 1 << 16
    row_group: int = 122_880
    memory: str = "300MB"


@dataclass(frozen=True)
class Filed:
    """One file: its lowest and highest (sort key, first column) and its rows."""

    table: str
    file_no: int
    path: str
    rows: int
    low: tuple[int, int]
    high: tuple[int, int]


@dataclass(frozen=True)
class Layout:
    """The files of one table, in order, under ``folder``."""

    table: str
    folder: str
    files: tuple[Filed, ...]


@dataclass(frozen=True)
class Victims:
    """Keys to erase from a table: ``keys(sort_key, place, key)``; ``column`` is the table's column that ``key`` is compared with.

    ``place`` is the value of the table's first column where the key fixes it, and null where it doesn't.
    """

    column: str
    keys: DataFrame


def mounted(uri: str) -> str:
    """The path of a ``file:`` address."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"DuckDB opens files by itself and needs a shared folder that is mounted (file:), not {uri}")
    return unquote(parts.path)


def filing_key(client: Column) -> Column:
    """The checksum of the decimal text, 0 for null."""
    return F.coalesce(F.crc32(client.cast("string")), F.lit(0).cast("long"))


def _tasks(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """One task for each row; rows are lines about files, of which there is a bounded number."""
    return spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))


def cut_batches(folder: str, columns: pa.Schema, cfg: ErasureConfig):
    """A mapInArrow function: (table, file_no, ranges of (path, skip, take)) to a line for each file written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        names = [f"c{i}" for i in range(len(columns))]
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{folder}/file-{row['file_no']:05d}-{attempt}.parquet"
                rows, low, high = 0, None, None
                with pq.ParquetWriter(mounted(path), columns, compression="zstd") as out:
                    for piece in row["pieces"]:
                        skip, take = piece["skip"], piece["take"]
                        with pq.ParquetFile(mounted(piece["path"])) as file:
                            for part in file.iter_batches(cfg.batch, columns=["k", *names]):
                                if skip >= part.num_rows:
                                    skip -= part.num_rows
                                    continue
                                part = part.slice(skip, take)
                                skip, take = 0, take - part.num_rows
                                ends = [(part.column(0)[i].as_py(), _place(part.column(1)[i].as_py())) for i in (0, part.num_rows - 1)]
                                low, high = low or ends[0], ends[1]
                                body = pa.Table.from_batches([part.select(names)]).rename_columns(columns.names).cast(columns)
                                out.write_table(body, row_group_size=cfg.row_group)
                                rows += part.num_rows
                                if not take:
                                    break
                yield pa.RecordBatch.from_pylist(
                    [{"table": row["table"], "file_no": row["file_no"], "path": path, "rows": rows, "low": low[0], "low_place": low[1], "high": high[0], "high_place": high[1]}],
                    schema=pa.schema([("table", pa.string()), ("file_no", pa.int64()), ("path", pa.string()), ("rows", pa.int64()), ("low", pa.int64()), ("low_place", pa.int64()), ("high", pa.int64()), ("high_place", pa.int64())]),
                )

    return trimmed(run)


def _place(value: object) -> int:
    return value if isinstance(value, int) else _NULLS_FIRST


_FILED = "table string, file_no long, path string, rows long, low long, low_place long, high long, high_place long"


def write_layout(ws: Workspace, folder: str, table: str, rows: DataFrame, key: Column, cfg: ErasureConfig = ErasureConfig()) -> Layout:
    """Sorts ``rows`` by ``key``, then all columns but those that only ``key`` reads (given as ``rows.columns`` without them).

    ``rows`` are written as they are; ``key`` is an expression over them.
    """
    return _write(ws, folder, table, rows.select(key.alias("k"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns))), rows.schema, cfg)


def _write(ws: Workspace, folder: str, table: str, keyed: DataFrame, schema: StructType, cfg: ErasureConfig) -> Layout:
    """The layout of ``keyed(k, c0, c1, ...)`` with the names and types of ``schema``."""
    spark = ws.spark
    mounted(folder)
    order = [F.col("k"), *(F.col(f"c{i}").asc_nulls_first() for i in range(len(schema)))]
    ordered = sorted_table(ws, keyed, order)
    size = 1 + ordered.n // cfg.files
    jobs = []
    parts = list(ordered.parts)
    for file_no, start in enumerate(range(0, ordered.n, size)):
        stop = min(start + size, ordered.n)
        while parts and parts[0].first + parts[0].rows <= start:
            parts.pop(0)
        pieces = []
        for p in parts:
            if p.first >= stop:
                break
            skip = max(0, start - p.first)
            pieces.append((p.path, skip, min(p.rows, stop - p.first) - skip))
        jobs.append((table, file_no, pieces))
    if not jobs:
        ws.drop(ordered.rows)
        return Layout(table, folder, ())
    at = f"{folder}/{table}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    lines = _tasks(spark, jobs, "table string, file_no long, pieces array<struct<path: string, skip: long, take: long>>")
    found = ws.save(lines.mapInArrow(cut_batches(at, to_arrow_schema(schema), cfg), _FILED), "files").orderBy("file_no").collect()
    ws.drop(ordered.rows)
    return Layout(table, folder, tuple(Filed(table, r.file_no, r.path, r.rows, (r.low, r.low_place), (r.high, r.high_place)) for r in found))


def route_batches(files: tuple[Filed, ...]):
    """A mapInArrow function: (sort_key, place, key) to (file_no, key) for every file that may hold it."""
    lows, highs = [f.low for f in files], [f.high for f in files]
    above, below = (1 << 63) - 1, _NULLS_FIRST
    numbers = [f.file_no for f in files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file_no, row = [], []
            for i, (k, place) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                first = bisect_left(highs, (k, below if place is None else place))
                last = bisect_right(lows, (k, above if place is None else place))
                for j in range(first, last):
                    file_no.append(numbers[j])
                    row.append(i)
            if row:
                yield pa.RecordBatch.from_arrays([pa.array(file_no, pa.int64()), batch.column(2).take(pa.array(row, pa.int64()))], names=["file_no", "key"])

    return run


def erase_batches(folder: str, spill: str, cfg: ErasureConfig):
    """A mapInArrow function: (table, file_no, path, shard, column) to (table, file_no, path, rows, rewritten); no path where nothing is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        name = lambda c: '"' + c.replace('"', '""') + '"'
        text = lambda t: "'" + t.replace("'", "''") + "'"
        for batch in batches:
            for row in batch.to_pylist():
                new = f"{folder}/{row['table']}/file-{row['file_no']:05d}-{attempt}-kept.parquet"
                con = duckdb.connect(config={"threads": 1, "memory_limit": cfg.memory, "temp_directory": f"{spill}/{attempt}", "preserve_insertion_order": True})
                try:
                    file, shard = text(mounted(row["path"])), text(mounted(row["shard"]) + "/*.parquet")
                    columns = [c[0] for c in con.execute(f"DESCRIBE SELECT * FROM read_parquet({file})").fetchall()]
                    number = "row_number_"
                    while number.lower() in {c.lower() for c in columns}:
                        number = "_" + number
                    on = f"o.{name(row['column'])} = s.key"
                    con.execute(f"CREATE TEMP TABLE s AS SELECT DISTINCT key FROM read_parquet({shard}, hive_partitioning = false)")
                    there, gone = con.execute(f"SELECT count(*), count(*) FILTER (WHERE EXISTS (SELECT 1 FROM s WHERE {on})) FROM read_parquet({file}) o").fetchone()
                    kept = {"path": row["path"], "rows": there, "rewritten": False}
                    if gone == there:
                        kept = {"path": None, "rows": 0, "rewritten": True}
                    elif gone:
                        numbered = f"SELECT *, row_number() OVER () AS {name(number)} FROM read_parquet({file})"
                        con.execute(
                            f"COPY (SELECT {', '.join('o.' + name(c) for c in columns)} FROM ({numbered}) o ANTI JOIN s ON {on} ORDER BY o.{name(number)}) "
                            f"TO {text(mounted(new))} (FORMAT parquet, COMPRESSION zstd, ROW_GROUP_SIZE {cfg.row_group})"
                        )
                        kept = {"path": new, "rows": there - gone, "rewritten": True}
                finally:
                    con.close()
                yield pa.RecordBatch.from_pylist([{"table": row["table"], "file_no": row["file_no"], "erased": gone, **kept}], schema=pa.schema([("table", pa.string()), ("file_no", pa.int64()), ("path", pa.string()), ("rows", pa.int64()), ("erased", pa.int64()), ("rewritten", pa.bool_())]))

    return trimmed(run)


@dataclass(frozen=True)
class Left:
    """A file of the result."""

    table: str
    file_no: int
    path: str
    rows: int
    erased: int
    rewritten: bool


def erase(ws: Workspace, layouts: list[Layout], victims: dict[str, Victims], cfg: ErasureConfig = ErasureConfig()) -> list[Left]:
    """Removes the victims of each table from its files; what is left, by table and file_no."""
    spark, jobs = ws.spark, []
    files = {(f.table, f.file_no): f for layout in layouts for f in layout.files}
    for layout in layouts:
        if layout.table not in victims or not layout.files:
            continue
        found = victims[layout.table]
        keys = found.keys.select(F.col("sort_key").cast("long"), F.col("place").cast("long"), "key")
        routed = keys.mapInArrow(route_batches(layout.files), f"file_no long, key {keys.schema['key'].dataType.simpleString()}")
        at = f"{ws.root}/shards/{layout.table}"
        routed.repartition(max(1, min(len(layout.files), 10_000)), "file_no").write.mode("overwrite").partitionBy("file_no").parquet(at)
        sparked = spark.read.schema(f"key {keys.schema['key'].dataType.simpleString()}, file_no long").parquet(at)
        jobs += [(layout.table, r.file_no, files[layout.table, r.file_no].path, f"{at}/file_no={r.file_no}", found.column) for r in sparked.select("file_no").distinct().collect()]
    done = {}
    if jobs:
        folder = next(x.folder for x in layouts)
        lines = _tasks(spark, jobs, "table string, file_no long, path string, shard string, column string")
        kept = ws.save(lines.mapInArrow(erase_batches(folder, mounted(f"{ws.root}/spill"), cfg), "table string, file_no long, path string, rows long, erased long, rewritten boolean"), "erased")
        done = {(r.table, r.file_no): r for r in kept.collect()}
    left = []
    for key, f in sorted(files.items()):
        r = done.get(key)
        if r is None:
            left.append(Left(f.table, f.file_no, f.path, f.rows, 0, False))
        elif r.path is not None:
            left.append(Left(f.table, f.file_no, r.path, r.rows, r.erased, r.rewritten))
    for layout in layouts:
        _only(spark, f"{layout.folder}/{layout.table}", {x.path for x in left if x.table == layout.table})
    return left


def _only(spark: SparkSession, folder: str, wanted: set[str]) -> None:
    """Removes files of ``folder`` that aren't wanted."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(at):
        names = {p.rpartition("/")[2] for p in wanted}
        for status in system.listStatus(at):
            if status.getPath().getName() not in names:
                delete_path(spark, status.getPath().toString())


def digest_batches(cfg: ErasureConfig):
    """A mapInArrow function: (table, file_no, path, amount) to what the file itself holds, read in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for row in batch.to_pylist():
                rows, cents, ids = 0, 0, hashlib.sha256()
                with pq.ParquetFile(mounted(row["path"])) as file:
                    names = file.schema_arrow.names
                    wanted = [names[0], *([row["amount"]] if row["amount"] else [])]
                    for part in file.iter_batches(cfg.batch, columns=list(dict.fromkeys(wanted))):
                        shown = ",".join("" if x is None else str(x) for x in part.column(0).to_pylist())
                        ids.update((("," if rows else "") + shown).encode())
                        rows += part.num_rows
                        if row["amount"]:
                            x = part.column(wanted[-1]).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
                            c = np.floor(100 * x + 0.5)
                            cents += sum(int(v) for v in c[np.isfinite(c)].tolist())
                yield pa.RecordBatch.from_pylist(
                    [{"table_name": row["table"], "file_no": row["file_no"], "n_rows": rows, "n_erased": row["erased"], "cents": cents, "rewritten": row["rewritten"], "ids_sha256": ids.hexdigest(), "columns": ",".join(names), "path": row["path"]}],
                    schema=pa.schema([("table_name", pa.string()), ("file_no", pa.int64()), ("n_rows", pa.int64()), ("n_erased", pa.int64()), ("cents", pa.int64()), ("rewritten", pa.bool_()), ("ids_sha256", pa.string()), ("columns", pa.string()), ("path", pa.string())]),
                )

    return trimmed(run)


_DIGESTS = "table_name string, file_no long, n_rows long, n_erased long, cents long, rewritten boolean, ids_sha256 string, columns string, path string"


def read_back(spark: SparkSession, left: list[Left], amounts: dict[str, str], cfg: ErasureConfig = ErasureConfig()) -> DataFrame:
    """A line for each file of ``left``, from a reading of the file; ``amounts`` names a column to add up, in hundredths, for a table.

    Amounts that are null or not finite add nothing.
    """
    lines = [(x.table, x.file_no, x.path, x.erased, x.rewritten, amounts.get(x.table)) for x in left]
    return _tasks(spark, lines, "table string, file_no long, path string, erased long, rewritten boolean, amount string").mapInArrow(digest_batches(cfg), _DIGESTS)


AMOUNTS = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def shop_victims(ws: Workspace, clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_keys: DataFrame, divisor: int = 100) -> dict[str, Victims]:
    """Masters whose checksum ``divisor`` divides and the one with most clicks, their clients, these clients' clicks and sales, these sales' lines.

    ``sale_keys(sale_id, k)`` has the key that a sale's lines are filed under.
    """
    owners = ws.save(clients.where("client_id is not null and master_id is not null").select("client_id", "master_id").distinct(), "owners")
    clicked = clicks.where("client_id is not null").groupBy("client_id").agg(F.count("*").alias("n"))
    most = owners.join(clicked, "client_id", "left").groupBy("master_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")).orderBy(F.desc("n"), "master_id").limit(1)
    masters = clients.where("master_id is not null").select("master_id").distinct()
    chosen = ws.save(masters.where(F.crc32(F.col("master_id").cast("string")) % divisor == 0).unionByName(most.select("master_id")).distinct(), "masters")
    own = ws.save(clients.select("client_id", "master_id").join(chosen, "master_id", "left_semi").distinct(), "victims")
    sort_key = filing_key(F.col("client_id"))
    nowhere = F.lit(None).cast("long")
    ids = ws.save(own.where("client_id is not null").select("client_id").distinct(), "ids")
    sold = sales.where("sale_id is not null").select("sale_id", "client_id").join(ids, "client_id", "left_semi").select("sale_id").distinct()
    by_client = ids.select(sort_key.alias("sort_key"), nowhere.alias("place"), F.col("client_id").cast("long").alias("key"))
    return {
        "clients": Victims("master_id", own.select(sort_key.alias("sort_key"), F.coalesce(F.col("client_id").cast("long"), F.lit(_NULLS_FIRST)).alias("place"), F.col("master_id").cast("long").alias("key"))),
        "clicks": Victims("client_id", by_client),
        "sales": Victims("client_id", by_client),
        "sale_lines": Victims("sale_id", sold.join(sale_keys, "sale_id").select(F.col("k").alias("sort_key"), F.col("sale_id").cast("long").alias("place"), F.col("sale_id").cast("long").alias("key"))),
    }


def erase_from_shop(spark: SparkSession, tables: dict[str, DataFrame], cfg: ErasureConfig = ErasureConfig()) -> DataFrame:
    """Writes clients, clicks, sales and sale_lines as files in a new folder, erases the victims, and reads what is left.

    A line of a sale that isn't there, or has no client, is filed under 0; of a sale_id that stands twice the smallest client counts.
    """
    ws, final = Workspace(spark, "erasing"), Workspace(spark, "erased").root
    mounted(final)
    layouts = [write_layout(ws, final, name, tables[name], filing_key(F.col("client_id")), cfg) for name in ("clients", "clicks", "sales")]
    known = tables["sales"].where("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("client_id"))
    sale_keys = ws.save(known.select("sale_id", filing_key(F.col("client_id")).alias("k")), "sale_keys")
    lines = tables["sale_lines"]
    numbered = lines.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(lines.columns)))
    sale = F.col(f"c{[c.lower() for c in lines.columns].index('sale_id')}")
    filed = numbered.join(sale_keys, sale == F.col("sale_id"), "left").select(F.coalesce("k", F.lit(0).cast("long")).alias("k"), *numbered.columns)
    layouts.append(_write(ws, final, "sale_lines", filed, lines.schema, cfg))
    left = erase(ws, layouts, shop_victims(ws, tables["clients"], tables["clicks"], tables["sales"], sale_keys), cfg)
    delete_path(spark, ws.root)
    return read_back(spark, left, AMOUNTS, cfg)


def op12_cascading_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: erases from the shop's tables; a line for each file left."""
    return erase_from_shop(spark, {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("clients", "clicks", "sales", "sale_lines")})
