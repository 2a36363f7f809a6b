"""Operator 7: language-model scores from a log-frequency Bloom filter.

Unigrams and bigrams of all training texts are counted exactly by hash.  The filter holds each one under every level from 1 to
1 + floor(log2(count)), so that a count of one is level 1 and no count is level 0; a level is found by probing upwards until a probe fails, so a stored count is at most its true one
(but for false positives).  All probes of one n-gram fall into one 64 KB block, so blocks are built on executors and only
joined on the driver; the filter's size is proportional to its entries, at ``bits`` an entry.  It is broadcast while it has at
most ``filter_bytes``; beyond that its blocks stay in the shared folder, the distinct keys of each run of texts are shuffled to
slices of blocks, and the levels go back to the run: the same levels and scores as by broadcast.  A run's texts are stored once,
compressed; keys travel as differences, and levels without them, in the order of keys that the run's texts give again.

A level stands for the mean count of all n-grams of that level, taken over the whole corpus.  Probability of a word after
another: a * c(vw) / c(v) + (1 - a) * (c(w) + 1) / (N + V + 1), where a word without a level counts 0.  Here a is the share of
training pairs that would have been seen without the pair itself, the sum of c - 1 over N, times (c(v) - 1) / (c(v) - 1 + prior).

The base score needs exact counts: they are broadcast with the filter while there are at most ``broadcast_tokens`` of them; beyond
that, nothing is broadcast, and a slice that is asked for levels has the counts of its tokens too.

A null or empty text is its end token alone.  Without training texts all counts are 0.  Rows with a null doc_id are scored as held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.labelled import fold
from siltstone.llm.storage import Workspace
from siltstone.llm.streams import trimmed
from siltstone.llm.words import hash_words, mix64, text_blocks


@dataclass(frozen=True)
class BloomConfig:
    bits: int = 8
    probes: int = 5
    prior: float = 50.0
    filter_bytes: int = 96 << 20
    broadcast_tokens: int = 12_000_000


_END = np.uint64(0x5EED0E4D0E4D5EED)
_PAIR = np.uint64(0x9FB21C651E98DF25)
_ONE = np.uint64(0xA24BAED4963EE407)
_BLOCK_BITS = 1 << 19
_BLOCK_BYTES = _BLOCK_BITS // 8
_BIT, _THREE, _SEVEN = np.uint64(_BLOCK_BITS - 1), np.uint64(3), np.uint64(7)
#: Blocks of the filter that are built and probed together.
_SLICE = 32
#: Bytes of text whose distinct keys are probed together where the filter isn't broadcast.
_RUN_BYTES = 16 << 20
#: Keys packed in one row at most: Spark puts up to 10,000 rows in a batch.
_PACKED = 1024
#: Levels go up to 1 + floor(log2(2**63 - 1)): no count has a higher one, so probing ends there.
_LEVELS = 63


def tokens_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of rows: first, end, token hashes with an end token after each row's words, and bounds by row."""
    for at, end, data, bounds in text_blocks(column):
        words, _, _, first = hash_words(data, bounds)
        n = end - at
        cut = first + np.arange(n + 1)
        out = np.full(len(words) + n, _END, np.uint64)
        out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))] = words
        yield at, end, out, cut


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    """Hashes of neighbours; the first has the end token before it."""
    before = np.empty_like(tokens)
    before[1:], before[:1] = tokens[:-1], _END
    return mix64(mix64(before ^ _PAIR) + tokens)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: (text) to (kind, h, n), counted within runs of blocks; kind 1 is a token, 2 a pair."""

    def summed(parts: list[np.ndarray], kind: int) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["kind", "h", "n"])

    ones: list[np.ndarray] = []
    twos: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for _, _, tokens, _ in tokens_of(batch.column(0)):
            ones.append(tokens)
            twos.append(pair_hashes(tokens))
            size += len(tokens)
            if size > 1_000_000:
                yield summed(ones, 1)
                yield summed(twos, 2)
                ones, twos, size = [], [], 0
    if size:
        yield summed(ones, 1)
        yield summed(twos, 2)


def _places(h: np.ndarray, level: int, probes: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block numbers and bit numbers (n, probes) of one level."""
    place, step = _strides(h, level)
    bits = (place[:, None] + np.arange(probes, dtype=np.uint64) * step[:, None]) & _BIT
    return block_of(h, blocks), bits.astype(np.int64)


def _strides(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of a level start, and the odd distance between them."""
    place = mix64(h + np.array([level], np.uint64) * _PAIR)
    return place, mix64(place ^ _ONE) | np.uint64(1)


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def key_of(kind: np.ndarray | int, h: np.ndarray) -> np.ndarray:
    """Tokens and pairs share the filter under different keys."""
    return mix64(h + np.asarray(kind).astype(np.uint64) * _ONE)


def build_batches(blocks: int, probes: int):
    """A mapInArrow function over rows (block, key, n) in order of block: (block, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = -1, np.zeros(_BLOCK_BITS, bool)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])
        for batch in batches:
            block, key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if block[i] != now:
                    if now >= 0:
                        yield done()
                    now, bits = int(block[i]), np.zeros(_BLOCK_BITS, bool)
                level = 1 + np.floor(np.log2(n[i:j])).astype(int)
                for q in range(1, int(level.max()) + 1):
                    _, at = _places(key[i:j][level >= q], q, probes, blocks)
                    bits[at.ravel()] = True
        if now >= 0:
            yield done()

    return run


def slices_of(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Slice numbers of the filter and row numbers whose block lies in each, ``_PACKED`` at most at once."""
    part = block // _SLICE
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        for k in range(i, j, _PACKED):
            yield int(part[i]), order[k : min(k + _PACKED, j)]


def entry_batches(blocks: int, exact: bool = False):
    """A mapInArrow function: (kind, h, n) to (slice, keys, numbers), packed in runs of 1 M rows; numbers are floor(log2(n)) in a byte, or n if ``exact``."""

    def packed(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        kind, h, n = (np.concatenate([b.column(i).to_numpy() for b in kept]) for i in range(3))
        key = key_of(kind, h.view(np.uint64))
        number = n.astype(np.int64) if exact else np.floor(np.log2(n)).astype(np.uint8)
        rows = [(part, key[at].tobytes(), number[at].tobytes()) for part, at in slices_of(block_of(key, blocks))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["slice", "keys", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                size += batch.num_rows
            if size > 1_000_000:
                yield packed(kept)
                kept, size = [], 0
        if kept:
            yield packed(kept)

    return run


def filter_batches(blocks: int, probes: int):
    """A mapInArrow function over the rows of ``entry_batches`` in order of slice: (block, bits)."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            key, n = np.frombuffer(b"".join(keys), np.uint64), np.int64(1) << np.frombuffer(b"".join(numbers), np.uint8).astype(np.int64)
            block = block_of(key, blocks)
            order = np.argsort(block)
            return pa.RecordBatch.from_arrays([pa.array(block[order]), pa.array(key[order].view(np.int64)), pa.array(n[order])], names=["block", "key", "n"])

        now, keys, numbers = -1, [], []
        for batch in batches:
            for part, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and keys:
                    yield rows()
                    keys, numbers = [], []
                now = part
                keys.append(k)
                numbers.append(n)
        if keys:
            yield rows()

    return lambda batches: build_batches(blocks, probes)(unpacked(batches))


def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: (row, text) to (run, data), the rows of a run as a compressed stream."""
    run = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at, end, _, _ in text_blocks(batch.column(1), _RUN_BYTES):
            sink = pa.BufferOutputStream()
            part = batch.slice(at, end - at)
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["run", "data"])
            run += 1


def rows_of(data: bytes) -> pa.RecordBatch:
    """The rows of a run."""
    return pa.ipc.open_stream(data).read_next_batch()


def keys_of(column: pa.Array) -> np.ndarray:
    """The distinct keys of all tokens and pairs of a run's texts, in order; so those of a slice follow each other."""
    return np.unique(np.concatenate([np.unique(np.concatenate([key_of(1, tokens), key_of(2, pair_hashes(tokens))])) for _, _, tokens, _ in tokens_of(column)]))


def as_differences(key: np.ndarray) -> bytes:
    """Ascending keys as differences, all first bytes, then all second ones: the upper ones are zeros, which Spark's codec takes away."""
    return np.diff(key, prepend=np.zeros(1, np.uint64)).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_differences(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def ask_batches(blocks: int):
    """A mapInArrow function: (run, data) to (slice, run, at, keys), the distinct keys of a run by slice; ``at`` is the place of the first among all of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                key = keys_of(rows_of(data.as_buffer()).column(1))
                parts, at, keys = zip(*((part, int(rows[0]), as_differences(key[rows])) for part, rows in slices_of(block_of(key, blocks))), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(np.full(len(parts), number)), pa.array(at, pa.int64()), pa.array(keys, pa.binary())], names=["slice", "run", "at", "keys"])

    return run


#: What stands for a run where a slice gets the counts of its tokens, and its blocks of the filter: before all runs.
_COUNTS, _BLOCKS = -2, -1


def answer_batches(blocks: int, probes: int):
    """A mapInArrow function over rows (slice, run, at, keys, numbers) in order of slice and run: (run, at, levels, places, counts).

    Levels are those of the keys asked for, in their order; counts those of the keys at ``places``, the others have none.  ``keys`` of a block are its bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits, kept, counts = -1, np.zeros(_SLICE * _BLOCK_BYTES, np.uint8), [], None
        for batch in batches:
            for part, asked, at, data, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, bits, kept, counts = part, np.zeros(_SLICE * _BLOCK_BYTES, np.uint8), [], None
                if asked == _COUNTS:
                    kept.append((data, numbers))
                    continue
                if asked == _BLOCKS:
                    place = at % _SLICE * _BLOCK_BYTES
                    bits[place : place + _BLOCK_BYTES] = np.frombuffer(data, np.uint8)
                    continue
                if kept:
                    key, n = np.frombuffer(b"".join(k for k, _ in kept), np.uint64), np.frombuffer(b"".join(n for _, n in kept), np.int64)
                    order = np.argsort(key)
                    counts, kept = (key[order], n[order]), []
                key = from_differences(data)
                level = LogBloom(bits, blocks, probes, part * _SLICE).levels(key).astype(np.uint8)
                c = looked_up(*counts, key) if counts else np.zeros(len(key), np.int64)
                met = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([asked], pa.int64()), pa.array([at], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (level, met.astype(np.uint16), c[met]))], names=["run", "at", "levels", "places", "counts"]
                )

    return run


def looked_up(keys: np.ndarray, numbers: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The number of each key that is asked for, 0 for those that aren't there; ``keys`` ascend."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    place = np.searchsorted(keys, asked)
    place[place == len(keys)] = 0
    return np.where(keys[place] == asked, numbers[place], 0)


class FoundLevels:
    """Levels and counts of a run's keys that were looked up elsewhere."""

    def __init__(self, keys: np.ndarray, answers: list[tuple[int, bytes, bytes, bytes]]) -> None:
        self.keys, self.found, self.numbers = keys, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for at, levels, places, counts in answers:
            self.found[at : at + len(levels)] = np.frombuffer(levels, np.uint8)
            self.numbers[at + np.frombuffer(places, np.uint16).astype(np.int64)] = np.frombuffer(counts, np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return self.found[np.searchsorted(self.keys, keys)]

    def counts(self, words: np.ndarray) -> np.ndarray:
        return self.numbers[np.searchsorted(self.keys, key_of(1, words))]


class LogBloom:
    """The filter, or its blocks from ``first`` on: levels of keys by probing."""

    def __init__(self, data: np.ndarray, blocks: int, probes: int, first: int = 0) -> None:
        self.data, self.blocks, self.probes, self.first = data, blocks, probes, first

    def levels(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), np.int64)
        if not self.blocks:
            return found
        base = (block_of(keys, self.blocks) - self.first) * _BLOCK_BYTES
        live = np.arange(len(keys))
        for q in range(1, _LEVELS + 1):
            place, step = _strides(keys, q)
            for _ in range(self.probes):
                bit = place & _BIT
                hit = np.flatnonzero((self.data[base + (bit >> _THREE).astype(np.int64)] >> (_SEVEN - (bit & _SEVEN)).astype(np.uint8)) & 1)
                if len(hit) < len(live):
                    live, keys, base, place, step = live[hit], keys[hit], base[hit], place[hit], step[hit]
                place = place + step
            if not len(live):
                break
            found[live] = q
        return found


def score_batches(shared, blocks: int, cfg: BloomConfig, total: int, distinct: int, means: dict[int, np.ndarray], share: float, whole: bool = True):
    """A mapInArrow function: (row, text) to (row, n_tokens, score, n_known, base_score).

    Where the filter isn't ``whole``, rows are (run, part, at, levels, places, counts, data) in order of run and part: a run's answers
    are part 0, its texts part 1.
    """

    def scored(batch: pa.RecordBatch, levels: LogBloom | FoundLevels, counts_of) -> Iterator[pa.RecordBatch]:
        norm = float(total + distinct + 1)
        table = np.log10((np.arange(1, 65).astype(float)) / norm)
        for at, end, tokens, cut in tokens_of(batch.column(1)):
            size = np.diff(cut)
            words, number = np.unique(tokens, return_inverse=True)
            one = means[1][levels.levels(key_of(1, words))]
            unigram = (one + 1) / norm
            before = np.concatenate([[np.searchsorted(words, _END)], number[:-1]])
            pairs, place = np.unique(pair_hashes(tokens), return_inverse=True)  # frequent pairs have many levels to probe
            pair = means[2][levels.levels(key_of(2, pairs))][place]
            history = one[before]
            a = share * np.maximum(history - 1, 0) / (history - 1 + cfg.prior)
            p = (1 - a) * unigram[number] + a * np.minimum(pair, history) / np.maximum(history, 1)
            score = np.add.reduceat(np.log10(p), cut[:-1])
            c = counts_of(words)
            base = np.where(c < 64, table[np.minimum(c, 63)], np.log10((c + 1) / norm))
            known = pa.array(np.add.reduceat((c > 0)[number].astype(np.int64), cut[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(size), pa.array(score), known, pa.array(np.add.reduceat(base[number], cut[:-1]))], names=["row", "n_tokens", "score", "n_known", "base_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if whole:
            data, keys, counts = (np.frombuffer(x, kind) for x, kind in zip(shared.value, (np.uint8, np.uint64, np.int32 if total < 1 << 31 else np.int64), strict=True))
            bloom = LogBloom(data, blocks, cfg.probes)
            for batch in batches:
                yield from scored(batch, bloom, lambda words: looked_up(keys, counts, words))
            return
        now, answers = -1, []
        for batch in batches:
            for number, part, at, levels, places, found, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != now:
                    now, answers = number, []
                if part == 0:
                    answers.append((at, levels, places, found))
                    continue
                rows = rows_of(data)
                run = FoundLevels(keys_of(rows.column(1)), answers)
                yield from scored(rows, run, run.counts)

    return run


def score_texts(spark: SparkSession, docs: DataFrame, learn: Column, cfg: BloomConfig = BloomConfig()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; learns from rows where ``learn``."""
    ws = Workspace(spark, "lm")
    learn = F.coalesce(learn, F.lit(False))
    counts = docs.where(learn).select("text").mapInArrow(trimmed(count_batches), "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))
    counts = ws.save(counts, "counts", once=True)
    level = (1 + F.floor(F.log2("n"))).cast("int").alias("level")
    stats = counts.groupBy("kind", level).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    of = lambda kind, f: sum(f(r) for r in stats if r.kind == kind)
    total, distinct = of(1, lambda r: r.n), of(1, lambda r: r.v)
    means = {1: np.zeros(64), 2: np.zeros(64)}
    for r in sorted(stats, key=lambda r: r.level):
        means[r.kind][r.level :] = r.n / r.v
    share = of(2, lambda r: r.n - r.v) / max(total, 1)
    entries = int(sum(r.level * r.v for r in stats))
    blocks = -(-entries * cfg.bits // _BLOCK_BITS)
    whole = blocks * _BLOCK_BYTES <= cfg.filter_bytes and distinct <= cfg.broadcast_tokens
    packed = "slice long, keys binary, numbers binary"
    rows = counts.mapInArrow(trimmed(entry_batches(blocks)), packed).repartition("slice").sortWithinPartitions("slice")
    bloom = ws.save(rows.mapInArrow(trimmed(filter_batches(blocks, cfg.probes)), "block long, bits binary"), "filter", once=True)
    texts = docs.select(F.col("doc_id").cast("long").alias("row"), "text")
    shared = None
    if whole:
        data = np.zeros(blocks * _BLOCK_BYTES, np.uint8)
        for batch in bloom.toArrow().to_batches():
            for block, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data[block * _BLOCK_BYTES : (block + 1) * _BLOCK_BYTES] = np.frombuffer(bits.as_buffer(), np.uint8)
        found = counts.where("kind = 1").select("h", F.col("n").cast("int" if total < 1 << 31 else "long").alias("n")).toArrow()
        keys, numbers = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
        order = np.argsort(keys)
        keys, numbers = keys[order], numbers[order]
        del found
        # bytes are read back in place by a worker; arrays would be copied once more
        shared = spark.sparkContext.broadcast((data.tobytes(), keys.tobytes(), numbers.tobytes()))
        del data, keys, numbers
        ws.drop(counts, bloom)
    else:
        tokens = ws.save(counts.where("kind = 1").mapInArrow(trimmed(entry_batches(blocks, exact=True)), packed), "tokens")
        ws.drop(counts)
        runs = ws.save(texts.mapInArrow(trimmed(run_batches), "run long, data binary"), "runs")
        none = F.lit(None).cast("binary")
        asked = runs.mapInArrow(trimmed(ask_batches(blocks)), "slice long, run long, at long, keys binary").withColumn("numbers", none)
        stored = bloom.select(F.expr(f"block div {_SLICE}").alias("slice"), F.lit(_BLOCKS).cast("long").alias("run"), F.col("block").alias("at"), F.col("bits").alias("keys"), none.alias("numbers"))
        counted = tokens.select("slice", F.lit(_COUNTS).cast("long").alias("run"), F.lit(0).cast("long").alias("at"), "keys", "numbers")
        both = counted.unionByName(stored).unionByName(asked).repartition("slice").sortWithinPartitions("slice", "run")
        answers = ws.save(both.mapInArrow(trimmed(answer_batches(blocks, cfg.probes)), "run long, at long, levels binary, places binary, counts binary"), "answers", once=True)
        ws.drop(tokens, bloom)
        parts = answers.select("run", F.lit(0).alias("part"), "at", "levels", "places", "counts", none.alias("data"))
        parts = parts.unionByName(runs.select("run", F.lit(1).alias("part"), F.lit(0).cast("long").alias("at"), *(none.alias(n) for n in ("levels", "places", "counts")), "data"))
        texts = parts.repartition("run").sortWithinPartitions("run", "part")
    score = score_batches(shared, blocks, cfg, total, distinct, means, share, whole)
    out = texts.mapInArrow(score if whole else trimmed(score), "row long, n_tokens long, score double, n_known long, base_score double")
    return out.select(F.col("row").alias("doc_id"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: learns from documents whose fold isn't 2 of 7, scores all."""
    out = score_texts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), fold("doc_id", 7) != 2)
    return out.select("doc_id", F.coalesce(fold("doc_id", 7) == 2, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
