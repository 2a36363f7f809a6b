"""Vectorised word and shingle hashing over Arrow text buffers.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``; ASCII capitals count as small letters.  The
hash of a word is a polynomial over its bytes modulo 2**64, read off prefix sums, so that a whole block of documents is
hashed by a handful of numpy passes and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_EXACT = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BYTE = _EXACT.copy()
_BYTE[65:91] = _BYTE[97:123]


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, BLOCK_BYTES)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def lower_hash_table() -> np.ndarray:
    """The byte table of hashes that don't tell ASCII capitals from small letters."""
    return _BYTE


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _EXACT) -> np.ndarray:
    """Hashes of ``data[start:end]`` for each pair; equal bytes have equal hashes wherever they stand."""
    up, down = _POWERS.get(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def hash_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and byte ends of all words of ``data``, and for each document its first word's number.

    ``bounds`` (n + 1 ascending offsets) splits ``data`` into documents; the last array has n + 1 entries.
    """
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(bounds), np.int64)
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~(word[1:] & ~first[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = hash_ranges(data, starts, ends, _BYTE)
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def hash_chunks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``hash_words`` for chunks that cover the text: each starts with the last white space before a word.

    Case counts here.  GPT-2's splitting pattern never matches across such a start.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(bounds), np.int64)
    space = SPACE[data]
    first = np.zeros(n + 1, bool)
    first[: n - 1] = space[:-1] & ~space[1:]
    inner = bounds[1:][bounds[1:] > 0]
    first[inner - 1] = False
    first[bounds[:-1]] = True
    starts = np.flatnonzero(first[:n])
    ends = np.append(starts[1:], n)
    return hash_ranges(data, starts, ends), starts, ends, np.searchsorted(starts, bounds)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits a string column into blocks of about ``limit`` bytes: first row, last row, bytes, bounds.  Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles, and the owner of each as a row number; a shorter document with words gives one shingle.

    Shingles of a document follow each other; they aren't distinct yet.
    """
    n = len(first) - 1
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(n), made)
    at = np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made) + first[owner]
    size = np.minimum(counts, k)[owner]
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    x = size.astype(np.uint64)
    for j in range(k):
        w = padded[at + j]
        x = np.where(j < size, mix64((x ^ w) * _BASE), x) if counts.min(initial=k) < k else mix64((x ^ w) * _BASE)
    return x, owner
