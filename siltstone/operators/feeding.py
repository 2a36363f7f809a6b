"""What goes into a store of chunks: a row on date and time, matches of a pattern, and chunks of words at several lengths, as one stream for each text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.small import time_sentence
from siltstone.functions.text import regex_chunks
from siltstone.operators.passages import word_chunks


def sections(text: Column, separator: str) -> Column:
    """Array of (section, offset): a text cut at each ``separator``, or the whole text where that is empty."""
    if not separator:
        return F.array(F.struct(text.alias("section"), F.lit(0).alias("offset")))
    parts = F.split(text, re.escape(separator), -1)
    kind = "struct<at:int,made:array<struct<section:string,offset:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<section:string,offset:int>>").alias("made")).cast(kind)
    step = lambda s, p: F.struct((s.at + F.length(p) + len(separator)).alias("at"), F.concat(s.made, F.array(F.struct(p.alias("section"), s.at.alias("offset")))).alias("made"))
    return F.aggregate(parts, start, step, lambda s: s.made)


def chunk_stream(docs: DataFrame, lengths: list[int], left: int = 0, right: int | None = None, separator: str = "", pattern: str = "", now: Column | None = None, clean=lambda c: c) -> DataFrame:
    """(source, place, chunk, context, start) of ``docs(source, text)``, one row a source, with the columns' order of a stream.

    First comes the row on ``now``, if given; then the matches of ``pattern``, if given; then chunks of whole words for each of ``lengths``.  Texts
    are cut at ``separator`` before, and ``start`` counts from the text's begin to that of the context.  ``clean`` changes chunks, not contexts.
    """
    right = left if right is None else right
    parts = docs.where("source is not null").select("source", F.explode(sections(F.coalesce("text", F.lit("")), separator)).alias("s")).select("source", "s.section", "s.offset")
    # the stream a row belongs to, then its section, then its place there
    streams = []
    if now is not None:
        sentence = time_sentence(now)
        streams.append(docs.where("source is not null").select("source", F.lit(0).alias("stream"), F.lit(0).alias("offset"), F.lit(0).alias("n"), sentence.alias("chunk"), sentence.alias("context"), F.lit(0).alias("start")))
    if pattern:
        sided = left if left == right else max(left, right)
        found = parts.select("source", "section", "offset", F.posexplode(regex_chunks(F.col("section"), pattern, sided)).alias("n", "m"))
        begin = F.greatest(F.col("m.start") - left, F.lit(0))
        context = F.substring("section", begin + 1, F.least(F.col("m.stop") + right, F.length("section")) - begin)
        streams.append(found.select("source", F.lit(1).alias("stream"), "offset", "n", F.col("m.text").alias("chunk"), context.alias("context"), (F.col("offset") + begin).alias("start")))
    for i, size in enumerate(lengths):
        found = parts.select("source", "section", "offset", F.posexplode(word_chunks(F.col("section"), size, left, right)).alias("n", "c"))
        cut = lambda a, b: F.substring("section", F.col(a) + 1, F.col(b) - F.col(a))
        streams.append(found.select("source", F.lit(2 + i).alias("stream"), "offset", "n", cut("c.start", "c.stop").alias("chunk"), cut("c.context_start", "c.context_stop").alias("context"), (F.col("offset") + F.col("c.context_start")).alias("start")))
    out = streams[0]
    for more in streams[1:]:
        out = out.unionByName(more)
    return out.select("source", F.struct("stream", "offset", "n").alias("place"), clean(F.col("chunk")).alias("chunk"), "context", "start")


def distinct_chunks(stream: DataFrame, apart: int) -> DataFrame:
    """``stream`` without chunks that hold no letter or digit, and without those whose start is less than ``apart`` from that of the last equal chunk
    kept before them in the stream of their source.  A kept chunk at start 0 keeps no other away."""
    held = stream.where(F.col("chunk").rlike(r"[\p{L}\p{N}]"))
    rows = held.groupBy("source", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "start", "context"))).alias("rows"))
    kind = rows.schema["rows"].dataType.simpleString()

    def step(kept: Column, r: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1)).start
        return F.when(F.coalesce((last != 0) & (F.abs(last - r.start) < apart), F.lit(False)), kept).otherwise(F.concat(kept, F.array(r)))

    kept = F.aggregate("rows", F.array().cast(kind), step)
    return rows.select("source", "chunk", F.explode(kept).alias("r")).select("source", "r.place", "chunk", "r.context", "r.start")
