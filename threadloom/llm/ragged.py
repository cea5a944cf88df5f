"""Texts of an Arrow batch as flat arrays: words, hashes, sliding minima.

Everything here works on a bounded piece of a partition inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task turns into arrays at a time (one text is never split).
CHUNK_BYTES = 6_000_000

#: Separators between words: blank and 0x09-0x0D.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_UNSTEP = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_CODES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes of ``column``, in the order of the batches."""
    held, size = [], 0
    for batch in batches:
        start = 0
        for row, n in enumerate(pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()):
            size += n
            if size >= limit:
                held.append(batch.slice(start, row + 1 - start))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, start = [], 0, row + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none) and the offsets of the texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


@dataclass
class Words:
    """Words of several texts: ``data`` has one blank inside a text between two words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word, from its bytes alone."""
        n = len(self.data)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[self.data] * powers(_STEP, n), out=run[1:])
        return mix((run[self.end] - run[self.start]) * powers(_UNSTEP, n)[self.start] if n else run[self.start])


def split_words(raw: np.ndarray, off: np.ndarray) -> Words:
    """Cut texts at runs of blanks; the bytes of a word are unchanged."""
    n = len(raw)
    inside = ~BLANK[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True  # a text starts or ends here
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, off)
    keep = inside | before
    data = raw.copy()
    data[~inside] = 32
    if not keep.all():
        to = np.cumsum(keep) - keep
        lens = ends - starts
        starts = to[starts] if n else starts
        ends = starts + lens
        data = data[keep]
    return Words(data, starts.astype(np.int64), ends.astype(np.int64), first.astype(np.int64))


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Polynomial combination of ``n`` values from each position on (by doubling)."""
    done, size, part, width = None, 0, values, 1
    left = n
    while left:
        if left & 1:
            if done is None:
                done, size = part, width
            else:
                m = len(values) - size - width + 1
                done = done[:m] * _power(width) + part[size : size + m] if m > 0 else values[:0]
                size += width
        left >>= 1
        if left:
            m = len(values) - 2 * width + 1
            part = part[:m] * _power(width) + part[width : width + m] if m > 0 else values[:0]
            width *= 2
    return done


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 2**64))


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of ``n`` values from each position on (by doubling)."""
    width, part = 1, values
    if len(values) < n:
        return values[:0]
    while 2 * width <= n:
        part = np.minimum(part[:-width], part[width:])
        width *= 2
    m = len(values) - n + 1
    return np.minimum(part[:m], part[n - width : n - width + m])


def runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs that begin where ``breaks`` is true; the first entry is, so there is at least one row."""
    s = np.flatnonzero(breaks)
    return s, np.diff(np.append(s, len(breaks)))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), then start[1], ..."""
    total = int(count.sum())
    at = np.arange(total)
    return at + np.repeat(start - (np.cumsum(count) - count), count)
