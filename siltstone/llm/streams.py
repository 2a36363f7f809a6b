"""Helpers for mapInArrow functions."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and when a task ends, what it has freed goes back to the system: workers outlive their tasks and wait for others."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Cuts a stream that is sorted by its first ``keys`` columns into batches that end where a group ends.

    A batch holds one group at least; it's for groups of bounded size.
    """
    kept: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if kept is not None:
            batch = pa.concat_batches([kept, batch])
        change = np.zeros(batch.num_rows - 1, bool)
        for c in range(keys):
            x = batch.column(c).to_numpy(zero_copy_only=False)
            change |= x[1:] != x[:-1]
        at = np.flatnonzero(change)
        if len(at) == 0:
            kept = batch
            continue
        cut = int(at[-1]) + 1
        yield batch.slice(0, cut)
        kept = batch.slice(cut)
    if kept is not None and kept.num_rows:
        yield kept
