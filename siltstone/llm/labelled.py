"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` documents with a label 0 or 1 among those for which ``learn`` holds.

    The documents are the first by a hash of doc_id.  A doc_id with contradicting labels counts with the greater one;
    repeated documents count once, by their smallest text.  The sample's ids are broadcast: ``rows`` bounds them.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(learn)
    ids = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return joined.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
