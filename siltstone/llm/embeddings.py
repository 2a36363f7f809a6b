"""Operator 2: near-duplicate embeddings by spherical k-means cells and blocked cosines.

Equal vectors of a label collapse to one, with their number.  Every label with more vectors than a cell should hold has cells
of its own, whose centroids are fitted on a bounded sample; a vector goes home to its nearest centroid and visits the cells of
its label whose border is near.  Two linked vectors are at most ``sqrt(2 - 2 * threshold)`` apart, so along the line between
their centroids their distances to the border add up to no more than that, and one of the two is within half of it: a vector
visits each cell within that half, and no link is lost, whatever the vectors are like.  Where both of a pair visit each other's
cell, each counts its own links; where one does, it counts for both.

``sigmas`` trades that certainty for speed and is for vectors known to fill all their directions alike: the part of a
difference along one line is then about normal with a deviation of the distance over the root of the dimensions, and the half
shrinks to so many of these.  On vectors of low rank it loses links.

Within a cell, blocks of queries meet blocks of residents in one matrix product each, in double precision; a task returns
counts of links and a spanning forest, never all pairs.  Vectors travel in the type of their column.

Only vectors with an equal label that isn't null, of equal length, without null or non-finite components and not zero are
compared; any other row, and one with a null vec_id, has 0 links and stands for itself.  Rows that share a vec_id are rows of
their own.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.graph import connected_components
from siltstone.llm.storage import Workspace
from siltstone.llm.streams import groups


@dataclass(frozen=True)
class CellConfig:
    """``sample`` bounds the vectors that centroids are fitted on, ``max_cells`` the centroids of all labels, which are sent to every task."""

    threshold: float = 0.93
    sigmas: float = math.inf
    sample: int = 20_000
    rows_per_cell: int = 1024
    max_cells: int = 1024
    rounds: int = 12
    block: int = 2048

    def reach(self, dim: int) -> float:
        """How far from the border a vector still visits the cell behind it."""
        return np.sqrt(2 - 2 * self.threshold) / 2 * min(1.0, self.sigmas / np.sqrt(dim)) + 1e-9


def spherical_kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Unit centroids of unit vectors; starts from vectors spread over the sample."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return np.unique(c, axis=0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(float)
    x /= np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def assign_batches(centroids: dict[int, tuple[int, np.ndarray]], cfg: CellConfig):
    """A mapInArrow function: (rep, label, m, embedding) to one row for each cell that a vector lives in or visits.

    ``centroids`` has, by label, the number of its first cell and its centroids; a label without, and a vector of another size,
    have one cell.  ``others`` are the cells that a resident visits, as 32-bit numbers, or the home of a visitor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = {label: np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) for label, (_, c) in centroids.items()}
        known = np.array(sorted(centroids), np.int64)
        for batch in batches:
            rep, label, m = (batch.column(i).to_numpy() for i in range(3))
            vectors = batch.column(3)
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
            dims = np.diff(at)
            celled = np.where(np.isin(label, known), label, -1) if len(known) else np.full(len(label), -1)
            has = np.isin(label, known) if len(known) else np.zeros(len(label), bool)
            for dim in np.unique(dims):
                for own, chosen in [(None, ~has), *((x, has & (celled == x)) for x in known[np.isin(known, celled[has])])]:
                    same = np.flatnonzero((dims == dim) & chosen)
                    first, c = centroids[int(own)] if own is not None else (0, np.zeros((0, 0)))
                    for part in np.array_split(same, -(-len(same) // 2048)) if len(same) else []:
                        raw = flat[at[part][:, None] + np.arange(dim)]
                        n = len(part)
                        if len(c) and c.shape[1] == dim:
                            s = unit_rows(raw) @ c.T
                            home = s.argmax(1)
                            near = s[np.arange(n), home][:, None] - s <= cfg.reach(dim) * gaps[int(own)][home]
                            near[np.arange(n), home] = False
                        else:
                            home, near = np.zeros(n, np.int64), np.zeros((n, 1), bool)
                        row, cell = np.nonzero(near)
                        home, cell = home + first, cell + first
                        visited = np.split(cell.astype(np.int32), np.searchsorted(row, np.arange(1, n)))
                        who, where = np.concatenate([np.arange(n), row]), np.concatenate([home, cell])
                        others = [v.tobytes() for v in visited] + [h.tobytes() for h in home[row].astype(np.int32)]
                        bytes_of = [v.tobytes() for v in raw]
                        for i in range(0, len(who), 4096):
                            a = who[i : i + 4096]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(label[part[a]].astype(np.int64)), pa.array(np.full(len(a), dim, np.int64)), pa.array(where[i : i + 4096].astype(np.int64)), pa.array(np.arange(i, i + len(a)) < n),
                                 pa.array(rep[part[a]]), pa.array(m[part[a]]), pa.array(others[i : i + 4096], pa.binary()), pa.array([bytes_of[k] for k in a], pa.binary())],
                                names=["label", "dim", "cell", "home", "rep", "m", "others", "x"],
                            )

    return run


def _local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_batches(threshold: float, kind: str):
    """A mapInArrow function over rows (task, query, cell, home, rep, m, others, x) in order of task: (a, b, n), an edge or a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            key = table.column(0).to_numpy()
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                part = table.slice(i, j - i)
                query, home = (part.column(c).to_numpy(zero_copy_only=False) for c in (1, 3))
                rep, m, others = part.column(4).to_numpy(), part.column(5).to_numpy(), part.column(6)
                q, r = np.flatnonzero(query), np.flatnonzero(~query)
                if not len(q) or not len(r):
                    continue
                x = unit_rows(np.frombuffer(b"".join(part.column(7).to_pylist()), kind).reshape(j - i, -1))
                near = x[q] @ x[r].T >= threshold
                near &= rep[q][:, None] != rep[r][None, :]
                a, b = np.nonzero(near)
                counts = np.bincount(a, m[r][b], len(q))
                # a resident that doesn't visit the visitor's home has no other way to learn of the link
                silent = ~home[q][a]
                silent[silent] = ~_visits(others, q[a[silent]], r[b[silent]])
                told = np.bincount(b[silent], m[q][a[silent]], len(r))
                ids, number = np.unique(rep, return_inverse=True)
                label = _local_components(len(ids), number[q][a], number[r][b])
                moved, linked, heard = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(counts), np.flatnonzero(told)
                own = np.concatenate([rep[q][linked], rep[r][heard]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[moved], own])), pa.array(np.concatenate([ids[label[moved]], own])), pa.array(np.concatenate([np.zeros(len(moved)), counts[linked], told[heard]]).astype(np.int64))],
                    names=["a", "b", "n"],
                )

    return run


def _visits(others: pa.Array, visitors: np.ndarray, residents: np.ndarray) -> np.ndarray:
    """Whether each resident visits the home of the visitor beside it; both are rows of ``others``."""
    if not len(residents):
        return np.zeros(0, bool)
    rows, place = np.unique(residents, return_inverse=True)
    lists = others.take(pa.array(rows)).to_pylist()
    cells = np.frombuffer(b"".join(lists), np.int32).astype(np.int64)
    there = np.repeat(np.arange(len(rows)), [len(x) // 4 for x in lists]) << 32 | cells
    guests, which = np.unique(visitors, return_inverse=True)
    homes = np.frombuffer(b"".join(others.take(pa.array(guests)).to_pylist()), np.int32).astype(np.int64)
    asked = place << 32 | homes[which]
    if not len(there):
        return np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(there, asked), len(there) - 1)
    return there[at] == asked


def fitted_cells(classes: DataFrame, dim: int, cfg: CellConfig) -> dict[int, tuple[int, np.ndarray]]:
    """Centroids for each label of more than ``rows_per_cell`` vectors of size ``dim``, from a sample dealt by the labels' shares.

    Where ``max_cells`` is less than asked for, the largest labels come first and all have fewer.
    """
    own = classes.where(F.size("embedding") == dim)
    large = own.groupBy("label").count().where(F.col("count") > cfg.rows_per_cell).orderBy(F.desc("count"), "label").limit(max(1, cfg.max_cells // 2)).collect()
    total = sum(r["count"] for r in large)
    if not total:
        return {}
    wanted = {r.label: -(-r["count"] // cfg.rows_per_cell) for r in large}
    share = min(1.0, cfg.max_cells / sum(wanted.values()))
    spread = own.select("label", "embedding", F.xxhash64("h1", "h2").alias("h"))
    bound = min(1.0, cfg.sample / total)
    # a hash below the share is a sample of about that many rows, the same at every run; the limit holds the bound itself
    picked = spread.where(F.col("label").isin(list(wanted))).where(F.pmod("h", F.lit(1_000_000)) < math.ceil(1_000_000 * bound)).orderBy("h").limit(cfg.sample).toArrow()
    labels, vectors = picked["label"].to_numpy(), picked["embedding"].combine_chunks()
    x = unit_rows(vectors.flatten().to_numpy().reshape(len(vectors), -1)) if len(vectors) else np.zeros((0, dim))
    out, first = {}, 0
    for label, k in wanted.items():
        mine = x[labels == label]
        k = min(max(1, math.floor(k * share)), len(mine))
        if k > 1:
            c = spherical_kmeans(mine, k, cfg.rounds)
            out[int(label)] = (first, c)
            first += len(c)
    return out


def near_embeddings(spark: SparkSession, vectors: DataFrame, cfg: CellConfig = CellConfig()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, label)``."""
    ws = Workspace(spark, "cells")
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite, F.lit(False))).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    good = rows.where("ok")
    classes = ws.save(good.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("embedding").alias("embedding")), "classes")

    dim = classes.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    centroids = fitted_cells(classes, dim.d, cfg) if dim else {}

    placed = ws.save(classes.select("rep", "label", "m", "embedding").mapInArrow(assign_batches(centroids, cfg), "label long, dim long, cell long, home boolean, rep long, m long, others binary, x binary"), "placed")
    cell = ["label", "dim", "cell"]
    shape = placed.groupBy(*cell).agg(F.ceil(F.count_if("home") / cfg.block).alias("rs"), F.ceil(F.count("*") / cfg.block).alias("qs")).where("rs > 0")
    spread = placed.join(shape, cell).withColumn("h", F.xxhash64("rep"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    q, r = F.pmod("h", F.col("qs")), F.pmod("h", F.col("rs"))
    asks = F.transform(F.sequence(zero, F.col("rs") - one), lambda j: F.struct(F.xxhash64(*cell, q, j).alias("task"), F.lit(True).alias("query")))
    answers = F.transform(F.sequence(zero, F.col("qs") - one), lambda i: F.struct(F.xxhash64(*cell, i, r).alias("task"), F.lit(False).alias("query")))
    tasks = spread.select(F.explode(F.when(F.col("home"), F.concat(asks, answers)).otherwise(asks)).alias("t"), "cell", "home", "rep", "m", "others", "x").select("t.task", "t.query", "cell", "home", "rep", "m", "others", "x")
    found = ws.save(tasks.repartition("task").sortWithinPartitions("task", "rep").mapInArrow(compare_batches(cfg.threshold, kind.replace("float", "f4").replace("double", "f8")), "a long, b long, n long"), "found")
    ws.drop(placed)

    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    comps = connected_components(ws, found.where("n = 0").select("a", "b")).select(F.col("node").alias("rep"), "component")
    known = classes.select("label", "h1", "h2", "rep", "m").join(counts, "rep", "left").join(comps, "rep", "left")
    known = known.select("label", "h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.select("vec_id", "label", "h1", "h2").join(known, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all embeddings at a cosine of 0.93."""
    return near_embeddings(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
