"""Operator 11: exact top-k by inner product, over vectors in order of descending length.

1. Components become ``floor(256 * x)``.  Vectors are sorted by length with exact numbers (``operators/ranks``) and cut into
   blocks of neighbours; the longest length of each block is known.
2. Every query first meets the longest vectors, a bounded number, which gives it a score to beat.  As no inner product exceeds
   the product of the lengths, the query needs the blocks up to the last whose longest vector could still reach that score.
3. Queries, sorted by the last block they need, are cut into blocks as well.  A task holds one block of each and takes the
   vectors by descending length.  It turns both into the singular basis of a sample and adds up the products over the first
   quarter of the axes, then the first half; Cauchy and Schwarz bound the rest by the lengths of the remainders, and what
   can't reach the query's k-th score, which rises meanwhile, is left out.  Scores of what remains are exact integers.
4. A task returns k rows for each of its queries at most; these are ranked by a window over the query.

The sample fits the basis alone: any rotation gives the same result.  Bounds are taken with a margin for rounding.

Rows without a vec_id, vectors that are null or of no components, and vectors with components that are null or for which
256 * x isn't finite take no part.  Vectors meet only those of equal size.  Rows that share a query's vec_id count as its own and
aren't its candidates; each row of a repeated query is a query, and a repeated candidate is as many candidates.  Scores beyond
64 bits stand as the nearest such number.  An empty table, and one without queries, give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.storage import Workspace
from siltstone.llm.streams import groups, trimmed
from siltstone.operators.ranks import sorted_table

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class TopConfig:
    """``sample`` and ``seeds`` bound the vectors that the driver sees, both also by ``bytes``; ``max_blocks`` the lines about blocks."""

    k: int = 5
    sample: int = 20_000
    seeds: int = 4096
    bytes: int = 32 << 20
    block: int = 2048
    queries: int = 2048
    chunk: int = 1024
    max_blocks: int = 65_536


def scaled(flat: np.ndarray) -> np.ndarray:
    """``floor(256 * x)`` as doubles, which is exact."""
    return np.floor(flat.astype(float) * 256)


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row as bytes: floats where they hold its numbers exactly, else doubles."""
    small = np.abs(rows).max(1, initial=0) <= 1 << 24
    single = rows.astype("f4") if small.any() else None
    return [(single if s else rows)[i].tobytes() for i, s in enumerate(small)]


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    raw = column.to_pylist()
    if all(len(x) == 4 * dim for x in raw):
        return np.frombuffer(b"".join(raw), "f4").reshape(-1, dim).astype(float)
    return np.stack([np.frombuffer(x, "f4" if len(x) == 4 * dim else "f8").astype(float) for x in raw])


def prepare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, dim, length, x)."""
    for batch in batches:
        vectors = batch.column(1)
        flat, at = scaled(vectors.flatten().to_numpy(zero_copy_only=False)), vectors.offsets.to_numpy()
        at = at - at[0]
        dims = np.diff(at)
        for dim in np.unique(dims):
            same = np.flatnonzero(dims == dim)
            for part in np.array_split(same, -(-len(same) // 4096)):
                x = flat[at[part][:, None] + np.arange(dim)]
                top = np.maximum(np.abs(x).max(1), 1e-300)
                with np.errstate(over="ignore"):
                    length = np.sqrt(((x / top[:, None]) ** 2).sum(1)) * top
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(part)), pa.array(np.full(len(part), dim, np.int64)), pa.array(length), pa.array(packed(x), pa.binary())], names=["vec_id", "dim", "length", "x"]
                )


def singular_basis(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns are the right singular vectors of the sample, the strongest first."""
    dim = sample.shape[1]
    top = np.abs(sample).max(initial=0)
    if not len(sample) or not top > 0:
        return np.eye(dim)
    return np.linalg.svd(np.linalg.qr(sample / top, mode="r"), full_matrices=True)[2].T


class TopK:
    """The best k candidates so far of each of a block of queries: highest score, then smallest vec_id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, score: np.ndarray, last: np.ndarray, known: np.ndarray, k: int, basis: np.ndarray | None) -> None:
        """``score`` and ``last`` are a score and vec_id that the k-th candidate is at least as good as, where ``known``."""
        self.q, self.ids, self.k, self.basis = queries, ids, k, basis
        self.score, self.last, self.known = score.copy(), last.copy(), known.copy()
        self.q_length = np.sqrt((queries**2).sum(1))
        self.steps = self._steps(queries)
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _steps(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each cut: the rotated components before it since the cut before, and the length of what comes after."""
        dim = x.shape[1]
        r = x @ self.basis if self.basis is not None else x
        cuts = sorted({-(-dim // 4), -(-dim // 2)})
        rest = np.sqrt(np.cumsum((r**2)[:, ::-1], axis=1)[:, ::-1])
        rest = np.c_[rest, np.zeros(len(x))]
        return [(r[:, a:b], rest[:, b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _floor(self, rows: np.ndarray) -> np.ndarray:
        return np.where(self.known[rows] & (self.score[rows] > _LEAST), self.score[rows].astype(float), -np.inf)

    def meet(self, x: np.ndarray, ids: np.ndarray, length: np.ndarray, chunk: int) -> None:
        """Takes candidates, by descending ``length``."""
        for at in range(0, len(x), chunk):
            part = slice(at, at + chunk)
            floor = self._floor(np.arange(len(self.q)))
            with np.errstate(over="ignore", invalid="ignore"):
                live = np.flatnonzero(~(self.q_length * length[at] * (1 + 1e-9) + 1 < floor))
                if not len(live):
                    return
                self._chunk(live, floor[live], x[part], ids[part], length[part])

    def _chunk(self, live: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        q = self.q[live]
        exact = x.shape[1] * max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) < 2**53
        margin = 1e-9 * self.q_length[live][:, None] * length[None, :] + 1
        steps = list(zip(self.steps, self._steps(x), strict=True))
        (head, q_rest), (x_head, x_rest) = steps[0]
        sums = head[live] @ x_head.T
        a, b = np.nonzero(~(sums + q_rest[live][:, None] * x_rest[None, :] + margin < floor[:, None]))
        if exact and len(a) > 0.1 * sums.size:
            score = q @ x.T
            score[self.ids[live][:, None] == ids[None, :]] = -np.inf
            if score.shape[1] > self.k:
                floor = np.maximum(floor, np.partition(score, -self.k, axis=1)[:, -self.k])
            a, b = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
            self._take(live[a], ids[b], score[a, b].astype(np.int64))
            return
        near = sums[a, b]
        for (head, q_rest), (x_head, x_rest) in steps[1:]:
            near = near + np.einsum("ij,ij->i", head[live[a]], x_head[b])
            on = ~(near + q_rest[live[a]] * x_rest[b] + margin[a, b] < floor[a])
            a, b, near = a[on], b[on], near[on]
        on = self.ids[live[a]] != ids[b]
        a, b = a[on], b[on]
        if exact:
            score = np.einsum("ij,ij->i", q[a], x[b]).astype(np.int64)
        else:
            score = np.array([min(max(sum(int(u) * int(v) for u, v in zip(q[i], x[j], strict=True)), _LEAST), _MOST) for i, j in zip(a, b, strict=True)], np.int64)
        self._take(live[a], ids[b], score)

    def _take(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        better = ~self.known[row] | (score > self.score[row]) | ((score == self.score[row]) & (ids <= self.last[row]))
        row, ids, score = (np.concatenate([old, new[better]]) for old, new in zip(self.found, (row, ids, score), strict=True))
        # two's complement: ~score falls where score rises, at the ends of the range as well
        order = np.lexsort((ids, ~score, row))
        row, ids, score = row[order], ids[order], score[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < self.k
        row, ids, score = row[keep], ids[keep], score[keep]
        self.found = (row, ids, score)
        full = np.flatnonzero(np.bincount(row, minlength=len(self.q)) == self.k)
        end = np.searchsorted(row, full, side="right") - 1
        self.known[full], self.score[full], self.last[full] = True, score[end], ids[end]


def seed_batches(cfg: TopConfig, dim: int, seeds: np.ndarray, seed_ids: np.ndarray, basis: np.ndarray | None, lengths: dict[int, tuple[np.ndarray, int]]):
    """A mapInArrow function: (row_no, vec_id, dim, length, x) of queries to the same with (score, last, known, reach).

    ``lengths`` has, by size, the longest length of each block and the number of the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, length = (batch.column(i).to_numpy() for i in (1, 2, 3))
            score, last, known, reach = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
            for low in range(0, len(ids), cfg.queries):
                rows = np.arange(low, min(low + cfg.queries, len(ids)))
                own = rows[dims[rows] == dim]
                if len(own) and len(seeds):
                    top = TopK(unpacked(batch.column(4).take(pa.array(own)), dim), ids[own], score[own], last[own], known[own], cfg.k, basis)
                    top.meet(seeds, seed_ids, np.sqrt((seeds**2).sum(1)), cfg.chunk)
                    score[own], last[own], known[own] = top.score, top.last, top.known
            for d in np.unique(dims):
                longest, first = lengths[int(d)]
                rows = np.flatnonzero(dims == d)
                floor = np.where(known[rows], score[rows].astype(float), -np.inf)
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    need = np.where(floor > 0, (floor - 1) / (1 + 1e-9) / length[rows], -np.inf)
                reach[rows] = first + np.maximum(np.searchsorted(-longest, -need, side="right"), 1) - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(last), pa.array(known), pa.array(reach)], names=["row_no", "vec_id", "dim", "length", "x", "score", "last", "known", "reach"])

    return trimmed(run)


def search_batches(cfg: TopConfig, dim: int, basis: np.ndarray | None):
    """A mapInArrow function over rows (task, dim, query, row_no, vec_id, length, x, score, last, known) in order of task, dim: (query_no, query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 2):
            task, dims = table.column(0).to_numpy(), table.column(1).to_numpy()
            cut = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (dims[1:] != dims[:-1]), True])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                part, d = table.slice(i, j - i), int(dims[i])
                query, no, ids, length, score, last, known = (part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4, 5, 7, 8, 9))
                q, c = np.flatnonzero(query), np.flatnonzero(~query)
                if not len(q) or not len(c):
                    continue
                c = c[np.argsort(no[c], kind="stable")]
                x = unpacked(part.column(6), d)
                top = TopK(x[q], ids[q], score[q], last[q], known[q], cfg.k, basis if d == dim else None)
                top.meet(x[c], ids[c], length[c], cfg.chunk)
                row, found, scores = top.found
                yield pa.RecordBatch.from_arrays([pa.array(no[q][row]), pa.array(ids[q][row]), pa.array(found), pa.array(scores)], names=["query_no", "query_id", "vec_id", "score"])

    return trimmed(run)


_ROW = "vec_id long, dim long, length double, x binary"


def top_inner_products(spark: SparkSession, vectors: DataFrame, queries: str = "vec_id % 50 = 0", cfg: TopConfig = TopConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` of ``vectors(vec_id, embedding)`` for every row that ``queries`` picks by vec_id."""
    ws = Workspace(spark, "inner")
    fine = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * 256) < float("inf"))), F.lit(False))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    order = [F.col("dim"), F.col("length").desc(), F.col("vec_id"), F.col("x")]
    ordered = sorted_table(ws, rows.mapInArrow(prepare_batches, _ROW), order, n=rows.count(), rows_per_part=1 << 15)
    numbered = ordered.numbered()
    n = ordered.n
    block = max(cfg.block, -(-n // cfg.max_blocks))
    placed = numbered.withColumn("block", F.expr(f"row_no div {block}"))
    shape = placed.groupBy("dim", "block").agg(F.max("length").alias("longest"), F.count("*").alias("n"), F.min("row_no").alias("first")).orderBy("dim", "block").collect()
    lengths, sizes = {}, {}
    for d in sorted({r.dim for r in shape}):
        own = [r for r in shape if r.dim == d]
        lengths[d], sizes[d] = (np.array([r.longest for r in own]), own[0].block), (sum(r.n for r in own), own[0].first)

    dim, basis, seeds, seed_ids = 0, None, np.zeros((0, 0)), np.zeros(0, np.int64)
    if sizes:
        dim = max(sizes, key=lambda d: (sizes[d][0], d))
        most = max(1, cfg.bytes // (8 * dim))
        chosen = numbered.where(F.col("dim") == dim)
        sample = chosen.orderBy(F.xxhash64("x"), "vec_id").select("x").limit(min(cfg.sample, most)).toArrow()["x"].combine_chunks()
        basis = singular_basis(unpacked(sample, dim))
        first = sizes[dim][1]
        longest = ordered.between(first, first + min(cfg.seeds, most, sizes[dim][0])).orderBy("row_no").select("vec_id", "x").toArrow()
        seeds, seed_ids = unpacked(longest["x"].combine_chunks(), dim), longest["vec_id"].to_numpy()

    asked = numbered.where(queries).select("row_no", "vec_id", "dim", "length", "x")
    begun = asked.mapInArrow(seed_batches(cfg, dim, seeds, seed_ids, basis, lengths), f"row_no long, {_ROW}, score long, last long, known boolean, reach long")
    begun = sorted_table(ws, begun, [F.col("dim"), F.col("reach").desc(), F.col("row_no")], rows_per_part=1 << 15)
    per = max(cfg.queries, -(-begun.n // cfg.max_blocks))
    wanted = begun.numbered("place").withColumn("group", F.expr(f"place div {per}"))
    reached = wanted.groupBy("dim", "group").agg(F.max("reach").alias("reach")).orderBy("dim", "group").collect()
    visits = []
    for r in shape:
        own = [g.group for g in reached if g.dim == r.dim and g.reach >= r.block]
        if own:
            visits.append((r.dim, r.block, own[0], own[-1]))
    visited = spark.createDataFrame(visits, "dim long, block long, low long, high long")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    task = lambda b, g: (b * F.lit(1 << 31) + g).alias("task")
    first_of = spark.createDataFrame([(d, b) for d, (_, b) in lengths.items()], "dim long, low long")
    asks = wanted.join(F.broadcast(first_of), "dim").withColumn("b", F.explode(F.sequence("low", "reach"))).select(task(F.col("b"), F.col("group")), "dim", F.lit(True).alias("query"), "row_no", "vec_id", "length", "x", "score", "last", "known")
    answers = placed.join(F.broadcast(visited), ["dim", "block"]).withColumn("g", F.explode(F.sequence("low", "high"))).select(task(F.col("block"), F.col("g")), "dim", no.alias("query"), "row_no", "vec_id", "length", "x", zero.alias("score"), zero.alias("last"), no.alias("known"))
    dealt = asks.unionByName(answers).repartition("task", "dim").sortWithinPartitions("task", "dim", "row_no")
    found = dealt.mapInArrow(search_batches(cfg, dim, basis), "query_no long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_no", "query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")


def op11_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the five best of all embeddings for every fiftieth."""
    return top_inner_products(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
