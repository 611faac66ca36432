"""Word tables over blocks of UTF-8 texts, as NumPy arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one block holds at most, besides its last text.
BLOCK = 1_000_000
#: Base of the rolling word hash, odd so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15

_byte = np.arange(256)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: Bytes of [0-9A-Za-z] and of all characters above 0x7F.
WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def blocks(values: list[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold about ``limit`` bytes; each row is in one range."""
    start = held = 0
    for i, value in enumerate(values):
        held += len(value)
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(values):
        yield start, len(values)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
    up, down = np.full(size, base), np.full(size, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``size`` of each."""
    if size > 4 * BLOCK:
        return _powers.__wrapped__(size)
    return _powers(BLOCK + 200_000 if size <= BLOCK + 200_000 else 4 * BLOCK)


class Table:
    """The words of a block: ``start``, ``end`` (byte offsets in ``joined``), ``doc`` and ``hash``."""

    def __init__(self, values: list[bytes]):
        self.joined = b"\0".join(values)
        raw = np.frombuffer(self.joined, np.uint8)
        inside = WORD[raw]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.start, self.end = edge[::2], edge[1::2]
        self.bounds = np.cumsum([0] + [len(v) + 1 for v in values])
        self.first = np.searchsorted(self.start, self.bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(values)), self.count)
        up, down = powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        self.hash = (total[self.end] - total[self.start]) * down[self.start]

    def word(self, i: int) -> bytes:
        return self.joined[self.start[i] : self.end[i]].lower()


def sliced(batch: pa.RecordBatch, at: int, limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with the texts of column ``at``, of which each holds about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= limit or i + 1 == len(sizes):
            rows = batch.slice(start, i + 1 - start)
            yield rows, texts(rows.column(at))
            start, held = i + 1, 0


def by_batch(fn, batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Apply ``fn(slice, texts)`` to slices of each batch that hold a bounded number of bytes."""
    for batch in batches:
        for rows, values in sliced(batch, batch.schema.get_field_index(column)):
            yield from fn(rows, values)
