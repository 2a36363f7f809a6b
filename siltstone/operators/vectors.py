"""Exact vector search in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def best_of(products: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k greatest of each row of a matrix at nine places, in order, smaller columns first among equals."""
    score = np.round(products, 9)
    if score.shape[1] > k:
        low = np.partition(score, -k, axis=1)[:, -k, None]
        i, j = np.nonzero((score >= low) | np.isnan(score))
    else:
        i, j = (a.ravel() for a in np.indices(score.shape))
    found = score[i, j]
    order = np.lexsort((j, -np.where(np.isnan(found), np.inf, found), i))
    i, j, found = i[order], j[order], found[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], found[kept]


def top_k(queries: DataFrame, rows: DataFrame, k: int, block: int = 2048, lines: int = 64) -> DataFrame:
    """(query_id, id, score): the k rows of greatest dot product for each query, smaller ids first among equals.

    ``queries`` and ``rows`` have (id, vector).  Blocks of queries meet blocks of rows in one task each, which returns k rows a
    query at most; nothing is broadcast and no pair of rows is emitted.  Of a block's products a task holds those of ``lines`` queries at a time.
    """
    sizes = queries.agg(F.count("*").alias("q")).crossJoin(rows.agg(F.count("*").alias("r"))).first()
    nq, nr = max(1, -(-sizes.q // block)), max(1, -(-sizes.r // (4 * block)))
    key = F.xxhash64("id")
    asks = queries.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(nr - 1)), lambda j: F.pmod(key, F.lit(nq)).cast("long") * nr + j)).alias("task"), F.lit(True).alias("query"), "id", "vector")
    answers = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(nq - 1)), lambda i: i.cast("long") * nr + F.pmod(key, F.lit(nr)))).alias("task"), F.lit(False).alias("query"), "id", "vector")

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(tables))
        query, ids = found["query"].to_numpy(), found["id"].to_numpy()
        if not query.any() or query.all():
            return
        flat = found["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = flat.astype(float).reshape(found.num_rows, -1)
        q, r = np.flatnonzero(query), np.flatnonzero(~query)
        r = r[np.argsort(ids[r], kind="stable")]
        offers, answer_ids = x[r].T, ids[r]
        for at in range(0, len(q), lines):
            asked = q[at : at + lines]
            i, j, score = best_of(x[asked] @ offers, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[asked][i]), pa.array(answer_ids[j]), pa.array(score)], names=["query_id", "id", "score"])

    met = asks.unionByName(answers).groupBy("task").applyInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
