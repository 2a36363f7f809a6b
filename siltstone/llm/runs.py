"""Operator 13: runs of repeated words, by Lyndon roots and rolling hashes.

A run is a stretch of consecutive words with smallest period q, at least ``max(min_length, 2 * q)`` long, that no
neighbouring word extends keeping that period.  Each run holds, for one of the two orders of words (any order and its
reverse, the end of the text lowest in both), a longest Lyndon word of length q.  So one scan from right to left for each
order keeps a stack of Lyndon words, merges the top while the word at hand is less, and extends what comes out to both sides
as far as words q apart agree.  Two places are compared by the first words directly, then by galloping and halving over
polynomial hashes modulo 2**61 - 1; no suffix array is built.  Every run is then held against the words themselves; where a
hash has lied, the stretch is done again with another base.

Only stretches of words that lie in a window of ``window`` words met twice in the text are scanned.  Nothing is lost: a run
of length at least 12 and 2q has, for each of its words, such a window that comes again q words further or earlier, and so has
any word that would extend it.  That takes ``min_length >= 2 * window``.

Words are ``[^\\x20\\x09-\\x0D]+``, told apart by their bytes.  A text that is null, empty or without words has no runs and
collapses to the empty text; texts of any length are worked on whole, in a task's memory of about 200 bytes a word of the
stretches.  Rows with equal doc_id are rows of their own, a null doc_id is kept; an empty table gives an empty result and other
columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.streams import trimmed
from siltstone.llm.words import hash_words, mix64, shingle_hashes, text_blocks

WORD = r"[^\x20\x09-\x0D]+"
_MODULUS = (1 << 61) - 1
_DIRECT = 8
RUNS = "array<struct<start: long, length: long, period: long>>"


@dataclass(frozen=True)
class RunConfig:
    """Runs of fewer than ``min_length`` words aren't reported; ``window`` is at most half of it."""

    min_length: int = 12
    window: int = 6

    def __post_init__(self) -> None:
        if self.min_length < 2 * self.window or self.window < 1:
            raise ValueError("window must be at least 1 and at most half of min_length")


class Extensions:
    """How far two places of a sequence agree, to the right and to the left."""

    def __init__(self, ids: list[int], base: int) -> None:
        self.ids = ids
        sums, powers, h, p = [0], [1], 0, 1
        for x in ids:
            h = (h * base + x + 1) % _MODULUS
            p = p * base % _MODULUS
            sums.append(h)
            powers.append(p)
        self.sums, self.powers = sums, powers

    def _agree(self, i: int, j: int, size: int) -> bool:
        s = self.sums
        return (s[i + size] - s[j + size] - (s[i] - s[j]) * self.powers[size]) % _MODULUS == 0

    def right(self, i: int, j: int) -> int:
        """The number of equal words from ``i`` and ``j > i`` on."""
        ids, most = self.ids, len(self.ids) - j
        k, near = 0, min(_DIRECT, most)
        while k < near and ids[i + k] == ids[j + k]:
            k += 1
        if k < near or k == most:
            return k
        step = _DIRECT
        while k + step <= most and self._agree(i + k, j + k, step):
            k += step
            step *= 2
        high = min(step - 1, most - k)
        low = 0
        while low < high:
            mid = (low + high + 1) // 2
            if self._agree(i + k, j + k, mid):
                low = mid
            else:
                high = mid - 1
        return k + low

    def left(self, i: int, j: int) -> int:
        """The number of equal words before ``i`` and ``j > i``."""
        ids = self.ids
        k, near = 0, min(_DIRECT, i)
        while k < near and ids[i - 1 - k] == ids[j - 1 - k]:
            k += 1
        if k < near or k == i:
            return k
        step = _DIRECT
        while k + step <= i and self._agree(i - k - step, j - k - step, step):
            k += step
            step *= 2
        high = min(step - 1, i - k)
        low = 0
        while low < high:
            mid = (low + high + 1) // 2
            if self._agree(i - k - mid, j - k - mid, mid):
                low = mid
            else:
                high = mid - 1
        return k + low


def _scan(ids: list[int], order: list[int], reach: Extensions, min_length: int, found: set[tuple[int, int, int]]) -> None:
    """Adds the runs whose Lyndon root stands in this order."""
    n = len(ids)
    ends = [n] * (n + 1)
    last: dict[int, tuple[int, int]] = {}
    for i in range(n - 1, -1, -1):
        a, j = order[i], i + 1
        while j < n:
            b = order[j]
            if a == b:
                start, stop = last.get(j - i, (0, -1))
                same = stop - j if start <= i and j <= stop else reach.right(i, j)
                if j + same == n:
                    break
                if order[i + same] >= order[j + same]:
                    break
            elif a > b:
                break
            j = ends[j]
        ends[i] = j
        period = j - i
        need = max(period, min_length - period)
        start, stop = last.get(period, (0, -1))
        if start <= i and j <= stop:
            continue
        ahead = reach.right(i, j) if j < n and ids[i] == ids[j] else 0
        behind = reach.left(i, j) if i and ids[i - 1] == ids[j - 1] else 0
        if ahead + behind >= need:
            last[period] = (i - behind, j + ahead)
            found.add((i - behind, period + ahead + behind, period))


def _holds(ids: list[int], start: int, length: int, period: int) -> bool:
    """Whether the words themselves have this run: the period all along, and beyond neither end."""
    end = start + length
    return (
        ids[start : end - period] == ids[start + period : end]
        and (start == 0 or ids[start - 1] != ids[start - 1 + period])
        and (end == len(ids) or ids[end] != ids[end - period])
    )


def runs_of(words: list, min_length: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``words``, in that order."""
    numbers: dict = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    reverse = [-x for x in ids]
    draw = random.Random(len(ids))
    while True:
        reach = Extensions(ids, draw.randrange(1 << 32, _MODULUS))
        found: set[tuple[int, int, int]] = set()
        _scan(ids, ids, reach, min_length, found)
        _scan(ids, reverse, reach, min_length, found)
        if all(_holds(ids, *run) for run in found):
            return sorted(found)


def repeated_stretches(hashes: np.ndarray, first: np.ndarray, cfg: RunConfig) -> list[tuple[int, int, int]]:
    """(row, from, to) of the stretches of each document whose words lie in a window that the document has twice."""
    windows, owner = shingle_hashes(hashes, first, cfg.window)
    if not len(windows):
        return []
    made = np.bincount(owner, minlength=len(first) - 1)
    key = mix64(windows ^ mix64((owner + 1).astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    at = np.flatnonzero(twice)
    if not len(at):
        return []
    place = at - (np.cumsum(made) - made)[owner[at]] + first[owner[at]]
    depth = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(depth, place, 1)
    np.add.at(depth, np.minimum(place + cfg.window, first[owner[at] + 1]), -1)
    held = np.cumsum(depth)[:-1] > 0
    edge = np.diff(np.r_[False, held, False].astype(np.int8))
    inner = first[1:-1]
    cut = inner[(inner > 0) & (inner < len(held))]
    cut = cut[held[cut] & held[cut - 1]]
    starts, stops = np.sort(np.r_[np.flatnonzero(edge == 1), cut]), np.sort(np.r_[np.flatnonzero(edge == -1), cut])
    row = np.searchsorted(first, starts, side="right") - 1
    long = stops - starts >= cfg.min_length
    return [(int(r), int(a - first[r]), int(b - first[r])) for r, a, b in zip(row[long], starts[long], stops[long], strict=True)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run contains after its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone), strict=False) if not g]
    return b" ".join(words)


def run_batches(cfg: RunConfig):
    """A mapInArrow function: (doc_id, text) to (doc_id, runs, collapsed)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for low, high, data, bounds in text_blocks(texts):
                hashes, _, _, first = hash_words(data, bounds)
                words = [data[a:b].tobytes().split() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
                for row, a, b in repeated_stretches(hashes, first, cfg):
                    runs[row] += [(a + start, length, period) for start, length, period in runs_of(words[row][a:b], cfg.min_length)]
                lists = pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in own] for own in runs], kind)
                shown = pa.array([collapsed(w, own) for w, own in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists, shown], names=["doc_id", "runs", "collapsed"])

    return trimmed(run)


def word_runs(docs: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """(doc_id, runs, collapsed) for every row of ``docs(doc_id, text)``; runs by start, then period."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run_batches(cfg), f"doc_id long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the tail of every tenth document, by the checksum of its doc_id, repeats one stretch of words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    listed = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("listed"))
    sized = listed.withColumn("n", F.size("listed")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    ready = sized.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform(F.sequence("a", F.col("n") - 1), lambda i: F.get("listed", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    text = F.concat_ws(" ", F.slice("listed", F.lit(1), F.col("a").cast("int")), again)
    return ready.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def _lines(runs: Column) -> Column:
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: runs of all documents, a tenth of them with a planted period; digests of runs and of collapsed texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = word_runs(with_planted_runs(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
