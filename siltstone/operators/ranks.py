"""Exact row numbers of a sorted table of any size.

Rows are dealt by ranges of the sort key and sorted within their range, with no window over all rows and no heap.  The
ranges are written once; a count for each gives running offsets, so that a row's number is its range's offset and its place
there, and rows ``i`` to ``j`` are read from the files of the ranges that hold them.  What the driver sees is a line for each range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shared import Workspace

_PLACE = (1 << 33) - 1


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores ahead until no column of ``taken`` has it in either case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


@dataclass(frozen=True)
class Part:
    """One range: its number, its file, its rows and the number of its first row."""

    part: int
    path: str
    rows: int
    first: int


@dataclass(frozen=True)
class SortedTable:
    """``rows`` has the columns of the table and ``at``: the range's number times 2**33 and the place in the range."""

    rows: DataFrame
    at: str
    parts: tuple[Part, ...]

    @property
    def n(self) -> int:
        return sum(p.rows for p in self.parts)

    def numbered(self, name: str = "row_no") -> DataFrame:
        """Every row with its number from 0 in column ``name``."""
        part, first = free_name(self.rows.columns, "part_"), free_name(self.rows.columns, "first_")
        spark = self.rows.sparkSession
        offsets = spark.createDataFrame([(p.part, p.first) for p in self.parts], f"`{part}` long, `{first}` long")
        keep = [F.col(f"`{c}`") for c in self.rows.columns if c != self.at]
        out = self.rows.withColumn(part, F.shiftright(self.at, 33)).join(F.broadcast(offsets), part)
        return out.select(*keep, (F.col(f"`{first}`") + F.col(f"`{self.at}`").bitwiseAND(F.lit(_PLACE))).alias(name))

    def between(self, start: int, stop: int, name: str = "row_no") -> DataFrame:
        """Rows ``start`` to ``stop - 1`` with their numbers; only files of ranges that hold some are read."""
        spark = self.rows.sparkSession
        keep = [F.col(f"`{c}`") for c in self.rows.columns if c != self.at]
        held = [p for p in self.parts if p.first < stop and p.first + p.rows > start]
        if not held:
            return self.rows.where(F.lit(False)).select(*keep, F.lit(0).cast("long").alias(name))
        at = F.col(f"`{self.at}`")
        low = (held[0].part << 33) + max(0, start - held[0].first)
        high = (held[-1].part << 33) + min(held[-1].rows, stop - held[-1].first)
        rows = spark.read.schema(self.rows.schema).parquet(*(p.path for p in held)).where((at >= low) & (at < high))
        first = F.lit(None).cast("long")
        for p in held:
            first = F.when(F.shiftright(at, 33) == p.part, F.lit(p.first).cast("long")).otherwise(first)
        return rows.select(*keep, (first + at.bitwiseAND(F.lit(_PLACE))).alias(name))


def sorted_table(ws: Workspace, df: DataFrame, order: list[Column], n: int | None = None, rows_per_part: int = 1 << 17, max_parts: int = 10_000) -> SortedTable:
    """Writes ``df`` in ``order``, which should tell all rows apart but equal ones: a key that many rows share is one range.

    ``n`` saves the count of ``df`` where it is known.  ``max_parts`` bounds what the driver sees; ranges grow beyond it.
    """
    n = df.count() if n is None else n
    at = free_name(df.columns, "at_")
    parts = max(1, min(max_parts, -(-n // rows_per_part)))
    rows = ws.save(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "sorted")
    file, part, held = (free_name(df.columns, c) for c in ("file_", "part_", "held_"))
    found = rows.select(F.col("_metadata.file_path").alias(file), F.shiftright(f"`{at}`", 33).alias(part)).groupBy(file, part).agg(F.count("*").alias(held)).orderBy(part).collect()
    out, first = [], 0
    for r in found:
        out.append(Part(r[part], r[file], r[held], first))
        first += r[held]
    return SortedTable(rows, at, tuple(out))
