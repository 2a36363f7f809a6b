"""Operator 1: near-duplicate documents by min-max hashing.

Every permutation yields two signature values, the least and the greatest hash of a document's shingles, so that 128
hash evaluations a shingle give 256 values.  Bands of minima and bands of maxima propose candidates; each candidate
pair is confirmed on the whole shingle sets.

Plan, built for groups of any size:

1. One pass sketches every document.  Documents with equal shingle sets collapse to their smallest doc_id by a plain
   aggregate, so a third of all rows being copies costs one row further on.
2. Band keys of these representatives meet by shuffle.  A bucket sends its members' 256-byte sketches to one task, which
   returns a spanning forest of the pairs whose estimate reaches ``threshold - margin``: never all pairs.  A bucket of more
   than ``block`` members becomes one cluster by its hub instead.
3. Shingle sets are made again for documents in clusters alone, and compared within the cluster in blocks of bounded rows
   and bytes.  Only where a cluster has several blocks, the documents outside its main component then meet all others.

Probability to miss a pair at 0.8 by its bands: (1 - 0.8**6)**42 < 3e-6.

Nulls and texts without words have no shingles, are linked with nothing and stand for themselves.  doc_ids should be distinct: rows
that share one are rows of their own, each in the group of its own text.  Rows with a null doc_id are left out of the groups and
returned with null component.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.graph import connected_components
from siltstone.llm.storage import Workspace
from siltstone.llm.streams import groups, trimmed
from siltstone.llm.words import hash_words, mix64, shingle_hashes, text_blocks


@dataclass(frozen=True)
class MinMaxConfig:
    """``threshold`` is a percentage: sets are linked with 100 * intersection >= threshold * union."""

    shingle: int = 5
    threshold: int = 80
    permutations: int = 128
    rows: int = 6
    margin: float = 0.15
    block: int = 256
    block_shingles: int = 4_000_000
    broadcast_rows: int = 1_000_000

    @property
    def bands(self) -> int:
        return 2 * (self.permutations // self.rows)


_MIX = np.uint64(0xD6E8FEB86659FD93)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b = (x[:n] >> np.uint64(32)).astype(np.uint32), (x[n:] >> np.uint64(32)).astype(np.uint32)
    return a | np.uint32(1), b


def document_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block of rows: first row, sorted distinct shingle hashes, and bounds by row."""
    for at, _, data, bounds in text_blocks(column):
        words, _, _, first = hash_words(data, bounds)
        x, owner = shingle_hashes(words, first, k)
        cut = np.searchsorted(owner, np.arange(len(bounds)))
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if j - i > 1:
                x[i:j].sort()
        if len(x):
            keep = np.ones(len(x), bool)
            keep[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
            x, owner = x[keep], owner[keep]
        yield at, x, np.searchsorted(owner, np.arange(len(bounds)))


def sketch_batches(cfg: MinMaxConfig):
    """A mapInArrow function: (id, text) to (doc_id, n_shingles, f1, f2, sketch, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (x[:, None] for x in _coefficients(cfg.permutations))
        used, half = cfg.rows * (cfg.permutations // cfg.rows), cfg.permutations // cfg.rows
        salt = mix64(np.arange(1, 2 * half + 1, dtype=np.uint64))
        for batch in batches:
            for at, x, cut in document_sets(batch.column(1), cfg.shingle):
                n = len(cut) - 1
                size = np.diff(cut)
                sketch, bands = np.zeros((n, 2 * cfg.permutations), np.uint8), np.zeros((n, 2 * half), np.uint64)
                f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                y = mix64(x ^ _MIX)
                short = (x >> np.uint64(32)).astype(np.uint32)
                for i in np.flatnonzero(size):
                    low, high = np.full(cfg.permutations, 0xFFFFFFFF, np.uint32), np.zeros(cfg.permutations, np.uint32)
                    for s in range(cut[i], cut[i + 1], 1024):
                        h = short[None, s : min(s + 1024, cut[i + 1])] * a
                        h += b
                        np.minimum(low, h.min(1), out=low)
                        np.maximum(high, h.max(1), out=high)
                    f1[i], f2[i] = x[cut[i] : cut[i + 1]].sum(), y[cut[i] : cut[i + 1]].sum()
                    sketch[i, : cfg.permutations], sketch[i, cfg.permutations :] = low & 255, high & 255
                    key = salt.copy()
                    parts = np.concatenate([low[:used].reshape(half, -1), high[:used].reshape(half, -1)]).astype(np.uint64)
                    for r in range(cfg.rows):
                        key = mix64((key ^ parts[:, r]) * _MIX)
                    bands[i] = key
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (2 * half)), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([r.tobytes() for r in sketch], pa.binary()), lists],
                    names=["doc_id", "n_shingles", "f1", "f2", "sketch", "bands"],
                )

    return run


def _components(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row that it reaches."""
    n = len(near)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            reach = np.zeros(n, bool)
            reach[i] = True
            edge = reach.copy()
            while edge.any():
                edge = near[edge].any(0) & ~reach
                reach |= edge
            label[reach] = i
    return label


def forest_batches(floor: float):
    """A mapInArrow function over rows (key, rep, sketch) in order of key: star edges of pairs with an estimate of ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            key, rep = table.column(0).to_numpy(), table.column(1).to_numpy()
            sketch = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8).reshape(len(rep), -1)
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            size = np.diff(cut)
            first = cut[:-1][size == 2]
            ok = (sketch[first] == sketch[first + 1]).mean(1) >= floor
            a, b = [rep[first[ok]]], [rep[first[ok] + 1]]
            for i in np.flatnonzero(size > 2):
                s, ids = sketch[cut[i] : cut[i + 1]], rep[cut[i] : cut[i + 1]]
                near = np.stack([(s == row).mean(1) >= floor for row in s])
                label = _components(near)
                a.append(ids[label])
                b.append(ids)
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def set_batches(k: int):
    """A mapInArrow function: (id, text) to (rep, shingles) with the sorted distinct 64-bit hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x, cut in document_sets(batch.column(1), k):
                n = len(cut) - 1
                sets = [x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return run


def similar_sets(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """The symmetric matrix of 100 * intersection >= threshold * union, for sorted distinct arrays."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    common = np.zeros((n, n))
    if n < 6:
        for i in range(n):
            for j in range(i):
                if 100 * min(size[i], size[j]) >= threshold * max(size[i], size[j]):
                    common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        values, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), size)
        shared = count[number] > 1
        number, row = (np.cumsum(count > 1) - 1)[number[shared]], row[shared]
        order = np.argsort(number, kind="stable")
        number, row = number[order], row[order]
        step = max(256, (1 << 22) // n)
        for at in range(0, int(number[-1]) + 1 if len(number) else 0, step):
            i, j = np.searchsorted(number, [at, at + step])
            has = np.zeros((n, step), np.float32)
            has[row[i:j], number[i:j] - at] = 1
            common += has @ has.T
    np.fill_diagonal(common, size)
    union = size[:, None] + size[None, :] - common
    return (100 * common >= threshold * union) & (union > 0)


def link_batches(threshold: int):
    """A mapInArrow function over rows (task, rep, shingles) in order of task: star edges of confirmed links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            key, rep = table.column(0).to_numpy(), table.column(1).to_numpy()
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(2)[i:j]]
                label = _components(similar_sets(sets, threshold))
                moved = label != np.arange(j - i)
                a.append(rep[i:j][label[moved]])
                b.append(rep[i:j][moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _in_tasks(rows: DataFrame, key: str, fn, schema: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, "rep").mapInArrow(trimmed(fn), schema)


def near_duplicates(spark: SparkSession, docs: DataFrame, cfg: MinMaxConfig = MinMaxConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    ws = Workspace(spark, "minmax")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = ws.save(texts.mapInArrow(trimmed(sketch_batches(cfg)), "doc_id long, n_shingles long, f1 long, f2 long, sketch binary, bands array<long>"), "sketches")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    classes = ws.save(classes, "classes")
    reps = full.join(classes.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "rep"), (F.col("doc_id") == F.col("rep")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left_semi").select(F.col("doc_id").alias("rep"), "sketch", "bands")

    keyed = reps.select("rep", F.explode("bands").alias("key"))
    dense = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).where("n > 1")
    members = ws.save(keyed.join(dense, "key"), "members")
    wide = members.where(F.col("n") > cfg.block).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    narrow = members.where(F.col("n") <= cfg.block).select("key", "rep").join(reps.select("rep", "sketch"), "rep").select("key", "rep", "sketch")
    floor = cfg.threshold / 100 - cfg.margin
    edges = ws.save(_in_tasks(narrow, "key", forest_batches(floor), "a long, b long").unionByName(wide).where("a <> b").distinct(), "edges")
    clusters = connected_components(ws, edges)
    ws.drop(members, edges)

    sizes = classes.groupBy("rep").agg(F.max("n").alias("n"))
    placed = clusters.join(sizes, clusters.node == sizes.rep).select(F.col("component").alias("cluster"), "rep", "n")
    shape = placed.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / cfg.block), F.ceil(F.sum("n") / cfg.block_shingles)).alias("blocks"))
    placed = ws.save(placed.join(shape, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))), "placed")
    bounded = placed.count() <= cfg.broadcast_rows
    chosen = texts.join(F.broadcast(placed.select("rep")) if bounded else placed.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")
    sets = ws.save(chosen.mapInArrow(trimmed(set_batches(cfg.shingle)), "rep long, shingles binary").join(placed, "rep"), "sets")

    hub = F.col("rep") == F.col("cluster")
    blocks = F.when(hub, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    rows = sets.select("cluster", "rep", "shingles", F.explode(blocks).alias("block"))
    links = ws.save(_in_tasks(rows.select(F.xxhash64("cluster", "block").alias("task"), "rep", "shingles"), "task", link_batches(cfg.threshold), "a long, b long").distinct(), "links")
    if not placed.where("blocks > 1").isEmpty():
        links = links.unionByName(_across_blocks(ws, sets, links, cfg))
    joined = connected_components(ws, links).select(F.col("node").alias("rep"), "component")
    ws.drop(sets, placed, clusters)

    found = classes.join(joined, "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    rest = sketches.where("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    out = full.join(found, ["f1", "f2"]).unionByName(rest, allowMissingColumns=True)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _across_blocks(ws: Workspace, sets: DataFrame, links: DataFrame, cfg: MinMaxConfig) -> DataFrame:
    """Links between blocks: what isn't in a cluster's main component meets every other member, block by block."""
    comps = connected_components(ws, links).select(F.col("node").alias("rep"), "component")
    many = sets.where("blocks > 1").join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    many = ws.save(many, "many")
    counts = many.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum(F.length("shingles") / 8).alias("shingles"))
    most = counts.groupBy("cluster").agg(F.max_by("component", F.struct("n", F.negative("component"))).alias("main"))
    parts = counts.join(most, "cluster").groupBy("cluster", (F.col("component") != F.col("main")).alias("out"))
    parts = parts.agg(F.greatest(F.ceil(F.sum("n") / cfg.block), F.ceil(F.sum("shingles") / cfg.block_shingles)).alias("k"))
    shape = parts.groupBy("cluster").agg(F.sum(F.when(F.col("out"), F.col("k")).otherwise(0)).alias("outs"), F.sum(F.when(~F.col("out"), F.col("k")).otherwise(0)).alias("mains"))
    shape = shape.where("outs > 0").join(most, "cluster")
    rows = many.join(shape, "cluster").withColumn("out", F.col("component") != F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(1)), F.when(F.col("out"), F.col("outs")).otherwise(F.col("mains"))))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    pair = lambda i, j: F.xxhash64("cluster", i, j)
    as_first = F.transform(F.sequence(F.col("own"), F.col("outs") + F.col("mains") - one), lambda j: pair(F.col("own"), j))
    as_second = F.when(F.col("own") > 0, F.transform(F.sequence(zero, F.greatest(F.col("own") - one, zero)), lambda i: pair(i, F.col("own")))).otherwise(F.array().cast("array<bigint>"))
    of_main = F.transform(F.sequence(zero, F.col("outs") - one), lambda i: pair(i, F.col("outs") + F.col("own")))
    rows = rows.select("rep", "shingles", F.explode(F.when(F.col("out"), F.concat(as_first, as_second)).otherwise(of_main)).alias("task"))
    found = ws.save(_in_tasks(rows.select("task", "rep", "shingles"), "task", link_batches(cfg.threshold), "a long, b long").distinct(), "links")
    ws.drop(many)
    return found


def keep_one(spark: SparkSession, docs: DataFrame, cfg: MinMaxConfig = MinMaxConfig()) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its near-duplicate group; null doc_ids stay."""
    gone = near_duplicates(spark, docs.select("doc_id", "text"), cfg).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def op1_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: 4-word shingles at a similarity of 0.8 over all documents."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), MinMaxConfig(shingle=4))
