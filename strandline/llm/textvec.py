"""Vectorised hashing of words over Arrow string columns.

Texts of a batch are handled as one UTF-8 buffer with row offsets, cut at row
boundaries into chunks of bounded size; a single longer text is a chunk of its
own.  Null counts as the empty text.  No text is ever shortened.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 18
#: Bytes of an Arrow batch on its way to Python: long texts would make batches of ten thousand rows very large.
BATCH_BYTES = 4 << 20
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Everything but ASCII letters, digits and bytes of longer code points.
NON_WORD = np.ones(256, bool)
NON_WORD[48:58] = NON_WORD[65:91] = NON_WORD[97:123] = NON_WORD[128:] = False


def arrow(frame: DataFrame) -> DataFrame:
    """`frame`, in a session whose Arrow batches are bounded to BATCH_BYTES unless a smaller bound is set."""
    conf = frame.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, "67108864b").rstrip("b")) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return frame


def release() -> None:
    """Gives freed memory back to the system; a worker that waits for its next task should not hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU system
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_pow.get("up", ())):
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _R), ("down", _R_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _pow[key] = np.cumprod(p, dtype=np.uint64)
        if size > 16 << 20:
            up, down = _pow.pop("up"), _pow.pop("down")
            return up, down
    return _pow["up"], _pow["down"]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets of the rows in them)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, buf[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


@dataclass
class Words:
    """Hashes of the words of a chunk, their byte spans, and where each row's words begin."""

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)


def words(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> Words:
    n = len(buf)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~sep[buf]
    inner = offs[(offs > 0) & (offs < n)]
    begin = solid[1:-1] & ~solid[:-2]
    begin[inner] = solid[1:-1][inner]
    last = solid[1:-1] & ~solid[2:]
    last[inner - 1] = solid[1:-1][inner - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((fold[buf].astype(np.uint64) + np.uint64(1)) * up[:n], out=run[1:])
    h = mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(h, start, end, np.searchsorted(start, offs))


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word numbers, the words they stand for, where each row's words begin); words are runs of other bytes than ASCII white space."""
    lists = pc.ascii_split_whitespace(texts)
    words, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.binary_length(words).to_numpy() > 0
    coded = words.filter(pa.array(full)).dictionary_encode()
    ptr = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(row[full], minlength=len(texts)), out=ptr[1:])
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, ptr


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of n words in a row; a row of fewer words gives one for all of them, an empty one none."""
    counts = w.counts
    rows = len(counts)
    windows = np.maximum(counts - n + 1, 0)
    row = np.repeat(np.arange(rows), windows)
    first = np.repeat(w.ptr[:-1], windows) + (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows))
    x = np.zeros(len(row), np.uint64)
    for i in range(n):
        x = mix(x * np.uint64(_R) + w.h[first + i])
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        y = counts[short].astype(np.uint64)
        for i in range(n - 1):
            here = counts[short] > i
            y[here] = mix(y[here] * np.uint64(_R_INV) + w.h[w.ptr[short[here]] + i])
        x, row = np.concatenate([x, mix(y)]), np.concatenate([row, short])
    return x, row


def distinct(x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, by row and then hash."""
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[keep], row[keep]


def ptr(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row begins in a sorted column of row numbers."""
    return np.searchsorted(row, np.arange(rows + 1))


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]], zero for empty rows; values may have columns."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


@dataclass
class Sorted:
    """Keys in order of their hash, with an index of the hash's leading bits."""

    hashes: np.ndarray
    order: np.ndarray
    first: np.ndarray
    shift: np.uint64
    deep: int

    @staticmethod
    def of(keys: np.ndarray) -> Sorted:
        h = mix(keys.astype(np.uint64) + np.uint64(1))
        order = np.argsort(h)
        h = h[order]
        bits = max(4, int(np.ceil(np.log2(max(len(h), 1)))) + 1)
        shift = np.uint64(64 - bits)
        first = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << shift).astype(np.int32)
        first = np.append(first, np.int32(len(h)))
        return Sorted(np.append(h, np.uint64(0)), order.astype(np.int32), first, shift, int(np.diff(first).max(initial=0)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position in hash order, or -1."""
        h = mix(keys.astype(np.uint64) + np.uint64(1))
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        hit = (self.hashes[at] == h) & (at < end)
        out = np.where(hit, at, -1)
        left = np.flatnonzero(~hit & (at + 1 < end))
        step = 1
        while len(left):
            p = at[left] + step
            same = self.hashes[p] == h[left]
            out[left[same]] = p[same]
            left = left[~same & (p + 1 < end[left])]
            step += 1
        return out
