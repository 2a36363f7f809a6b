"""Approximate nearest neighbours: an index kept as tables, searched by joins, with exact scores at the end.

Vectors are scaled to length 1.  Coarse centroids and, for what is left of a vector after its centroid, a book of codes for
each part of the axes are fitted on a bounded sample; every vector is indexed, as its cell and a byte for each part.  A query
visits its nearest cells, adds up code by code what each vector there scores about, and its best ``rerank`` are scored
exactly from their vectors.  How many cells a query visits is measured when the index is built: for some vectors all true neighbours
are found by the exact search, and so many cells are taken as hold ``target`` of them.

Null vectors, and those of another length than most, of null or non-finite numbers or of zeros, aren't indexed and find nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators.vectors import top_k
from siltstone.sources.index import Index
from siltstone.sources.shared import Workspace


@dataclass(frozen=True)
class AnnConfig:
    """``sample`` bounds what centroids and codes are fitted on, ``tuned`` the queries that the number of visited cells is measured by."""

    sample: int = 20_000
    per_cell: int = 256
    max_cells: int = 1024
    parts: int = 16
    codes: int = 256
    rounds: int = 10
    tuned: int = 64
    neighbours: int = 20
    target: float = 0.97
    rerank: int = 200
    block: int = 4096


def results_each(n: int, queries: int) -> int:
    """How many results each of several queries gives, so that there are ``n`` at least."""
    return -(-n // max(queries, 1))


def lloyd(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """At most ``k`` centres of the rows of ``x``, from rows spread over it."""
    c = np.unique(x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        home = (2 * x @ c.T - (c**2).sum(1)).argmax(1)
        size = np.bincount(home, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


@dataclass(frozen=True)
class AnnModel:
    """Centroids, a book of codes for each part of the axes, the bounds of the parts, and how many cells a query visits."""

    centroids: np.ndarray
    books: tuple[np.ndarray, ...]
    cuts: tuple[int, ...]
    probes: int

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The nearest cells of each row, nearest first."""
        return np.argsort(-(2 * x @ self.centroids.T - (self.centroids**2).sum(1)), axis=1, kind="stable")

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        home = self.homes(x)[:, 0]
        rest = x - self.centroids[home]
        codes = [(2 * rest[:, a:b] @ book.T - (book**2).sum(1)).argmax(1) for book, a, b in zip(self.books, self.cuts, self.cuts[1:], strict=False)]
        return home, np.stack(codes, 1).astype(np.uint8)

    def scores(self, cell: int, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """About the product of each query with each coded vector of a cell."""
        out = np.repeat((queries @ self.centroids[cell])[:, None], len(codes), axis=1)
        for j, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            out += (queries[:, a:b] @ book.T)[:, codes[:, j]]
        return out


def fit(sample: np.ndarray, rows: int, cfg: AnnConfig) -> AnnModel:
    """A model from unit vectors; ``rows`` is how many vectors there are in all."""
    k = max(1, min(cfg.max_cells, -(-rows // cfg.per_cell), len(sample)))
    centroids = lloyd(sample, k, cfg.rounds)
    home = (2 * sample @ centroids.T - (centroids**2).sum(1)).argmax(1)
    rest = sample - centroids[home]
    dim = sample.shape[1]
    cuts = tuple(int(c) for c in np.unique(np.linspace(0, dim, min(cfg.parts, dim) + 1).astype(int)))
    books = tuple(lloyd(rest[:, a:b], cfg.codes, cfg.rounds) for a, b in zip(cuts, cuts[1:], strict=False))
    return AnnModel(centroids, books, cuts, 1)


def _unit(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _usable(rows: DataFrame, dim: int | None = None) -> DataFrame:
    good = F.col("id").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    return rows.where(F.coalesce(good & (F.lit(True) if dim is None else F.size("vector") == dim), F.lit(False)))


class AnnIndex:
    """The index under ``root``: ``build`` publishes it, ``search`` reads it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.index = spark, Index(spark, root)

    def build(self, vectors: DataFrame, cfg: AnnConfig = AnnConfig()) -> dict:
        """Publishes the index of ``vectors(id, vector)``; no usable vector is an error."""
        ws = Workspace(self.spark, "ann")
        rows = vectors.select(F.col("id").cast("long").alias("id"), "vector")
        common = _usable(rows).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if common is None:
            raise ValueError("there is no vector to index")
        good, dim = _usable(rows, common.d), common.d
        share = min(1.0, 1.2 * cfg.sample / common["count"])
        picked = good.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * share) + 1).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(cfg.sample).select("vector").toArrow()["vector"]
        model = fit(_unit(picked, dim), common["count"], cfg)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    home, codes = model.encode(_unit(batch.column(1), dim))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "cell", "code"])

        codes = ws.save(good.mapInArrow(encode, "id long, cell int, code binary").repartitionByRange(max(1, min(1000, common["count"] // 50_000)), "cell", "id").sortWithinPartitions("cell", "id"), "codes")
        asked = ws.save(good.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(cfg.tuned), "tuned")
        near = top_k(asked, good, min(cfg.neighbours, common["count"])).join(codes.select("id", "cell"), "id").join(asked.select(F.col("id").alias("query_id"), "vector"), "query_id").select("cell", "vector").toArrow()  # tuned x neighbours rows
        order = model.homes(_unit(near["vector"], dim))
        place = np.sort((order == near["cell"].to_numpy()[:, None]).argmax(1))
        model = AnnModel(model.centroids, model.books, model.cuts, int(place[min(len(place) - 1, int(np.ceil(cfg.target * len(place))) - 1)]) + 1)

        listed = lambda x: [float(v) for v in x]
        tables = {
            "codes": codes, "vectors": good,
            "cells": self.spark.createDataFrame([(i, listed(c)) for i, c in enumerate(model.centroids)], "cell int, centroid array<double>"),
            "books": self.spark.createDataFrame([(j, i, listed(v)) for j, book in enumerate(model.books) for i, v in enumerate(book)], "part int, code int, vector array<double>"),
        }
        report = {"rows": common["count"], "dim": dim, "probes": model.probes, "cells": len(model.centroids), "cuts": list(model.cuts), "rerank": cfg.rerank, "block": cfg.block}
        made = self.index.publish(tables, uuid.uuid4().hex, report)
        ws.drop_all()
        return made

    def model(self) -> AnnModel:
        """The model of the published index, from its tables of at most a few MB."""
        manifest = self.index.manifest()
        if manifest is None:
            raise ValueError("there is no index")
        cells = self.index.table("cells").orderBy("cell").collect()
        books = self.index.table("books").orderBy("part", "code").collect()
        cuts = tuple(manifest["report"]["cuts"])
        split = tuple(np.array([r.vector for r in books if r.part == j]) for j in range(len(cuts) - 1))
        return AnnModel(np.array([r.centroid for r in cells]), split, cuts, manifest["report"]["probes"])

    def search(self, queries: DataFrame, k: int, probes: int | None = None, rerank: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): about the ``k`` vectors of greatest cosine for each of ``queries(id, vector)``, smaller ids first among equals.

        ``probes`` and ``rerank`` take the place of what the index was built with; all cells and all rows give the exact result.
        """
        model, report = self.model(), self.index.manifest()["report"]
        n, deep = min(probes or model.probes, len(model.centroids)), max(rerank or report["rerank"], k)
        ws = Workspace(self.spark, "ann-search")
        asked = ws.save(_usable(queries.select(F.col("id").cast("long").alias("id"), "vector"), model.dim), "asked")

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    part = batch.slice(low, 1024)
                    cells = model.homes(_unit(part.column(1), model.dim))[:, :n]
                    row = np.repeat(np.arange(len(cells)), n)
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], names=["cell", "id", "vector"])

        codes = self.index.table("codes")
        kind = asked.schema["vector"].dataType.simpleString()
        going = asked.mapInArrow(visits, f"cell int, id long, vector {kind}")
        # at most max_cells rows
        size = codes.groupBy("cell").agg(F.ceil(F.count("*") / report["block"]).cast("int").alias("nc")).join(going.groupBy("cell").agg(F.ceil(F.count("*") / report["block"]).cast("int").alias("nq")), "cell")
        size = F.broadcast(ws.save(size, "size"))
        whole = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
        task = lambda i, j: F.struct("cell", i.alias("q"), j.alias("c"))
        q = going.join(size, "cell").select(F.explode(F.transform(whole("nc"), lambda j: task(own("nq"), j))).alias("task"), "id", "vector", F.lit(None).cast("binary").alias("code"))
        c = codes.join(size, "cell").select(F.explode(F.transform(whole("nq"), lambda i: task(i, own("nc")))).alias("task"), "id", F.lit(None).cast(kind).alias("vector"), "code")

        def run(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = pa.Table.from_batches(list(tables))
            coded = found["code"].is_valid().to_numpy()
            if coded.all() or not coded.any():
                return
            offers = found.filter(pa.array(coded)).sort_by("id")
            ids, packed = offers["id"].to_numpy(), np.frombuffer(b"".join(offers["code"].to_pylist()), np.uint8).reshape(len(offers), -1)
            asks = found.filter(pa.array(~coded))
            x = _unit(asks["vector"], model.dim)
            for low in range(0, len(x), 256):
                s = model.scores(key[0].as_py()["cell"], x[low : low + 256], packed)
                best = np.argpartition(-s, deep - 1, axis=1)[:, :deep] if s.shape[1] > deep else np.tile(np.arange(s.shape[1]), (len(s), 1))
                who = asks["id"].to_numpy()[low : low + 256]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who, best.shape[1])), pa.array(ids[best.ravel()]), pa.array(np.take_along_axis(s, best, 1).ravel())], names=["query_id", "id", "about"])

        met = q.unionByName(c).groupBy("task").applyInArrow(run, "query_id long, id long, about double")
        order = lambda *by: F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
        pool = met.withColumn("place", order(F.desc("about"), "id")).where(F.col("place") <= deep).select("query_id", "id")
        pairs = pool.join(self.index.table("vectors"), "id").join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("asked")), "query_id")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    s = np.round(np.einsum("ij,ij->i", _unit(b.column(2), model.dim), _unit(b.column(3), model.dim)), 9)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["query_id", "id", "score"])

        exact = pairs.select("query_id", "id", "vector", "asked").mapInArrow(score, "query_id long, id long, score double")
        return exact.withColumn("rank", order(F.desc("score"), "id")).where(F.col("rank") <= k)


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the rows of ``true(query_id, id)`` that ``found`` has."""
    r = true.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.sum("hit").alias("hit"), F.count("*").alias("n")).first()
    return (r.hit or 0) / r.n if r.n else 1.0
