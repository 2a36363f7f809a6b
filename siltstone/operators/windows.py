"""Windows over the tokens of all documents in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_offsets(rows: DataFrame, order: str, size: str, bucket: int = 4096) -> DataFrame:
    """``rows`` with ``offset``: the sum of ``size`` over all rows before in order of the whole number ``order``.

    Sums are made in two steps, over buckets of ``order`` and within them: one task sees a row for each bucket, never all rows.
    """
    b = rows.withColumn("_bucket", F.floor(F.col(order) / bucket))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy("_bucket").agg(F.sum(size).alias("_sum")).select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return b.join(sums, "_bucket").withColumn("offset", F.col("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("_bucket", "_before")


def token_windows(docs: DataFrame, cutoff: int, stride: int) -> DataFrame:
    """(start, length, tokens): windows of ``cutoff`` tokens that share ``stride`` with the next, over docs(doc_id, tokens) in a row.

    Each document sends each window the slice it has in it; a window is put together from its slices, at most ``cutoff`` tokens.
    """
    step = cutoff - stride
    if step <= 0:
        raise ValueError("the stride is smaller than the cutoff")
    d = running_offsets(docs.withColumn("_n", F.size("tokens").cast("long")).where("_n > 0"), "doc_id", "_n")
    first = F.greatest(F.floor((F.col("offset") - cutoff) / step) + 1, F.lit(0))
    last = F.floor((F.col("offset") + F.col("_n") - 1) / step)
    p = d.withColumn("_k", F.explode(F.sequence(first, last)))
    at = F.greatest(F.col("_k") * step - F.col("offset"), F.lit(0))
    end = F.least(F.col("_k") * step + cutoff - F.col("offset"), F.col("_n"))
    p = p.select("_k", "offset", F.slice("tokens", (at + 1).cast("int"), (end - at).cast("int")).alias("part")).where("size(part) > 0")
    w = p.groupBy("_k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda x: x.part)).alias("tokens"))
    return w.select((F.col("_k") * step).alias("start"), F.size("tokens").cast("long").alias("length"), "tokens")


def training_windows(docs: DataFrame, cutoff: int, stride: int, pad: int, end: int | None = None, ignored: int = -100) -> DataFrame:
    """(start, input_ids, labels, attention_mask) over docs(doc_id, ids) in a row, with ``end`` behind each document if given.

    The last window is padded: its padding has the label ``ignored`` and no attention.  Fewer tokens than one window are an error.
    """
    ids = F.coalesce("ids", F.array().cast(docs.schema["ids"].dataType))
    tokens = docs.select("doc_id", (ids if end is None else F.concat(ids, F.array(F.lit(end)))).alias("tokens"))
    if (tokens.agg(F.sum(F.size("tokens"))).first()[0] or 0) < cutoff:
        raise ValueError("the documents don't fill one window")
    missing = F.lit(cutoff) - F.size("tokens")
    filled = lambda x: F.array_repeat(F.lit(x), missing)
    return token_windows(tokens, cutoff, stride).select(
        "start", F.concat("tokens", filled(pad)).alias("input_ids"), F.concat("tokens", filled(ignored)).alias("labels"), F.concat(F.array_repeat(F.lit(1), F.size("tokens")), filled(0)).alias("attention_mask")
    )
