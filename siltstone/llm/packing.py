"""Operator 3: packing documents into training sequences by bounded-space online best fit.

Tokenizing is one pass without a shuffle that leaves a few numbers for each piece.  These are dealt by hash, in tasks of
Spark's advisory size, and packed as they come: a bounded number of bins is open, held in a bitset keyed by free space,
a piece goes to the fullest bin that takes it, and when all bins are in use the fullest is closed first.  Order within a
task is by hash, so a task that is run again packs alike; ``lookahead`` pieces are gathered and placed longest first.

Pure online order leaves about 1 % more sequences, so pieces are buffered for that; it's a departure from the online rule.

A null or empty text is the end token alone.  A text is cut only if it is longer than a sequence: all its pieces but the
first are full.  Strings of special tokens in a text are ordinary text.  A null doc_id stays null; rows that share a doc_id are
packed each for itself, with pieces counted from 0 in each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.streams import trimmed
from siltstone.llm.words import SPACE, hash_chunks, text_blocks


@dataclass(frozen=True)
class PackConfig:
    """``tokenizer``: name of a file of the public tokenizers, or a path with a slash."""

    length: int = 2048
    end_id: int = 0
    tokenizer: str = "byte_bpe_50k.json"
    open_bins: int = 16_384
    lookahead: int = 32_768
    cached_chunks: int = 3_000_000


#: White space that isn't ASCII, and ASCII controls that only some engines count as white space.
_ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xe1\xa0\x8e|[\x1c-\x1f]")


#: Chunks that are encoded as one string.
_JOINED = 2048


class _Crossing(Exception):
    """A token crosses the border of a chunk."""


class DocumentTokenizer:
    """Token ids of whole documents, without the end token.

    Texts are cut where the tokenizer's own pattern always cuts, before the last white space ahead of a word; each
    distinct chunk is encoded once and found again by its hash, so that common words cost a lookup in numpy.  New chunks
    that start with one white space and a word are encoded joined, and the ids dealt back by the bytes of each token.  A text with
    other white space than ASCII's is encoded whole, and so are all texts of a block in which a token crosses the border of a
    chunk after all.  The table of chunks is emptied at ``cached_chunks``.
    """

    def __init__(self, cfg: PackConfig) -> None:
        from tokenizers import Tokenizer

        if "/" in cfg.tokenizer:
            path = cfg.tokenizer
        else:
            import public_tokenizers

            path = public_tokenizers.path(cfg.tokenizer)
        self.model = Tokenizer.from_file(str(path))
        self.model.encode_special_tokens = True
        self.limit = cfg.cached_chunks
        self.bytes_of = np.zeros(self.model.get_vocab_size(), np.int64)
        for token, number in self.model.get_vocab().items():
            self.bytes_of[number] = len(token)  # a character stands for each byte
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _encode(self, chunks: list[bytes], apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and how many each has; those ``apart`` can't be joined to others."""
        near, far = np.flatnonzero(~apart), np.flatnonzero(apart)
        size = np.zeros(len(chunks), np.int64)
        alone = [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast([chunks[i].decode() for i in far], add_special_tokens=False)]
        size[far] = [len(x) for x in alone]
        groups = [near[i : i + _JOINED] for i in range(0, len(near), _JOINED)]
        together = self.model.encode_batch_fast([b"".join(chunks[i] for i in g).decode() for g in groups], add_special_tokens=False)
        joined = np.fromiter(chain.from_iterable(e.ids for e in together), "<u4")
        ends = np.cumsum(np.fromiter((len(chunks[i]) for i in near), np.int64, len(near)))
        reached = np.cumsum(self.bytes_of[joined])
        last = np.searchsorted(reached, ends)
        if len(near) and not np.array_equal(reached[last], ends):
            raise _Crossing
        size[near] = np.diff(last + 1, prepend=0)
        ids = np.empty(int(size.sum()), "<u4")
        ids[np.repeat(~apart, size)] = joined
        ids[np.repeat(apart, size)] = np.concatenate([np.zeros(0, "<u4"), *alone])
        return ids, size

    def _learn(self, keys: np.ndarray, chunks: list[bytes], apart: np.ndarray) -> None:
        """Adds new chunks; ``keys`` is sorted and none of them is known."""
        if len(self.keys) > self.limit:
            self._clear()
        ids, size = self._encode(chunks, apart)
        at = np.cumsum(size) - size + len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def _known(self, keys: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = 0
        return (self.keys[place] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row of a string column in turn; null is empty."""
        for at, end, data, bounds in text_blocks(column):
            keys, starts, ends, first = hash_chunks(data, bounds)
            distinct, where, number = np.unique(keys, return_index=True, return_inverse=True)
            raw = data.tobytes()
            odd = any(x in raw for x in (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80", b"\xe1\xa0", b"\x1c", b"\x1d", b"\x1e", b"\x1f"))
            whole = False
            if len(distinct):
                new = np.flatnonzero(~self._known(distinct))
                if len(self.keys) + len(new) > self.limit:
                    self._clear()
                    new = np.arange(len(distinct))
                if len(new):
                    new_at = where[new]
                    chunks = [raw[i:j] for i, j in zip(starts[new_at].tolist(), ends[new_at].tolist(), strict=True)]
                    second = np.minimum(starts[new_at] + 1, len(data) - 1)
                    apart = ~SPACE[data[starts[new_at]]] | (ends[new_at] - starts[new_at] < 2) | SPACE[data[second]]
                    if odd:
                        apart |= np.fromiter((_ODD_SPACE.search(c) is not None for c in chunks), bool, len(chunks))
                    try:
                        self._learn(distinct[new], chunks, apart)
                    except _Crossing:
                        whole = True
            if len(distinct) and not whole:
                place = np.searchsorted(self.keys, distinct)[number]
                size = self.size[place]
                total = np.concatenate([[0], np.cumsum(size)])
                ids = self.ids[np.repeat(self.at[place] - total[:-1], size) + np.arange(total[-1])]
                cut = total[first]
            else:
                ids, cut = np.zeros(0, "<u4"), np.zeros(end - at + 1, np.int64)
            for i in range(end - at):
                if whole or (odd and _ODD_SPACE.search(raw, bounds[i], bounds[i + 1])):
                    yield np.array(self.model.encode(raw[bounds[i] : bounds[i + 1]].decode(), add_special_tokens=False).ids, "<u4")
                else:
                    yield ids[cut[i] : cut[i + 1]]


def piece_batches(cfg: PackConfig):
    """A mapInArrow function: (id, text) to (doc_id, piece, start, length, ids_crc32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens, end = DocumentTokenizer(cfg), np.array([cfg.end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for doc, found in zip(batch.column(0).to_pylist(), tokens(batch.column(1)), strict=True):
                ids = found.tobytes() + end
                total = len(ids) // 4
                at, piece = 0, 0
                step = (total - 1) % cfg.length + 1
                while at < total:
                    for x, v in zip(rows, (doc, piece, at, step, zlib.crc32(ids[4 * at : 4 * (at + step)])), strict=True):
                        x.append(v)
                    at, piece, step = at + step, piece + 1, cfg.length
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class BestFit:
    """Bounded-space online best fit; bins are known by number."""

    def __init__(self, length: int, open_bins: int) -> None:
        self.length, self.limit = length, open_bins
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.open = self.made = 0

    def add(self, size: int) -> tuple[int, int]:
        """Puts a piece away: bin and offset."""
        fit = self.bits >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.made, self.length
            self.made += 1
        left = free - size
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.length - free

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return number


def pack_batches(cfg: PackConfig):
    """A mapInArrow function that adds sequence_id and offset; numbers are apart by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = BestFit(cfg.length, cfg.open_bins), TaskContext.get().partitionId() << 40

        def placed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            ahead = pa.concat_batches(rows)
            sizes = ahead.column("length").to_numpy()
            number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            order = np.argsort(-sizes, kind="stable")
            for i, n in zip(order.tolist(), sizes[order].tolist(), strict=True):
                number[i], offset[i] = bins.add(n)
            return pa.RecordBatch.from_arrays([*ahead.columns, pa.array(number + base), pa.array(offset)], names=[*ahead.schema.names, "sequence_id", "offset"])

        rows: list[pa.RecordBatch] = []
        for batch in batches:
            rows.append(batch)
            if sum(x.num_rows for x in rows) >= cfg.lookahead:
                yield placed(rows)
                rows = []
        if rows:
            yield placed(rows)

    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack_documents(docs: DataFrame, cfg: PackConfig = PackConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(trimmed(piece_batches(cfg)), PIECES)
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.repartition(order).sortWithinPartitions(order, "doc_id", "piece", "start")
    return dealt.mapInArrow(trimmed(pack_batches(cfg)), f"{PIECES}, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents into sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
