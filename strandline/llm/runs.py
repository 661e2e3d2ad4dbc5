"""Periodic runs of words: maximal stretches that repeat a period four times or more.

A run of period p is found on the harmonic grid of p: for grid places x = jp and
y = (j+1)p, the stretch that x and y have in common forward and backward is the
maximal stretch of period p around them, so it begins backward(x, y) words before x
and ends forward(x, y) words after y.  A run of four periods or more holds three
grid steps in a row whose ends are equal words, so the two queries are made at
places where that is so; elsewhere one of them is known to be too short.  Both
queries are range minima over the longest common prefixes of neighbours in a suffix
array, of the texts and of the texts reversed.  Suffixes are sorted by prefix
doubling among those not yet told apart, and their common prefixes come from the
round that told them apart.  A stretch found by several periods keeps the smallest,
which divides the others.

Texts are handled in chunks of bounded bytes, a longer text by itself; every text's
suffixes are sorted among themselves, so equal texts in a chunk cost nothing extra.
Memory is in proportion to the words of a chunk, time to n log n of a text's words.

Cases: a null or empty text, or one of white space alone, has no words and no runs.
A null key plants nothing.  Repeated rows each give their row; texts of any length are
taken whole.  Runs come by start, then period; among runs of equal exponent the first
start and then the smallest period is the greatest.  An empty table gives no rows;
extra columns are ignored unless kept, and kept ones named as those made here are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textvec as tv

#: The least length of a run, in words and in periods.
WORDS, PERIODS = 6, 4
#: Grid places looked at at once.
GRID = 1 << 20
BLOCK = 16
_UNSET = np.iinfo(np.int32).max
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUN_SQL = "array<struct<start:bigint,length:bigint,period:bigint>>"


class RangeMin:
    """Least values of ranges: minima within blocks, and a sparse table over whole blocks."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        self.values = np.full(blocks * BLOCK, _UNSET, np.int32)
        self.values[: len(values)] = values
        grid = self.values.reshape(blocks, BLOCK)
        self.head = np.minimum.accumulate(grid, axis=1).ravel()
        self.tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(1)]
        while 2 << (len(self.levels) - 1) <= blocks:
            before, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(before[:-step], before[step:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of values[lo..hi], both ends included."""
        first, last = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.tail[lo], self.head[hi])
        near = np.flatnonzero(first == last)
        if len(near):
            a, b = lo[near], hi[near]
            least = self.values[a]
            for k in range(1, BLOCK):
                least = np.minimum(least, self.values[np.minimum(a + k, b)])
            out[near] = least
        gap = last - first - 1
        far = np.flatnonzero(gap > 0)
        level = np.log2(gap[far]).astype(np.int64)
        for k in np.unique(level):
            at = far[level == k]
            row = self.levels[k]
            out[at] = np.minimum(out[at], np.minimum(row[first[at] + 1], row[last[at] - (1 << k)]))
        return out


class Suffixes:
    """A suffix array by prefix doubling, with ranks and the common prefixes of neighbours.

    `keys` must begin and end with keys that occur once, as must hold between texts.
    """

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        order = np.argsort(keys, kind="stable")
        new = np.ones(n, bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        lcp = np.where(new, 0, _UNSET).astype(np.int32)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in `order` whose group has several suffixes
        h = 1
        while len(open_):
            here = order[open_]
            group, then = rank[here], rank[here + h]  # within a group the first h keys are equal, so none is a separator
            turn = np.argsort(group * n + then)
            here, group, then = here[turn], group[turn], then[turn]
            order[open_] = here
            same = group[1:] == group[:-1]
            told = np.flatnonzero(same & (then[1:] != then[:-1])) + 1
            lcp[open_[told]] = h + RangeMin(lcp)(then[told - 1] + 1, then[told])
            new = np.ones(len(open_), bool)
            new[1:] = ~same | (then[1:] != then[:-1])
            rank[here] = np.maximum.accumulate(np.where(new, open_, 0))
            open_ = open_[~(new & np.append(new[1:], True))]
            h *= 2
        self.rank = rank
        self.least = RangeMin(lcp)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many keys from x on equal those from y on; x and y differ."""
        a, b = self.rank[x], self.rank[y]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def _grid(word: np.ndarray, ptr: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, period) of grid places from which three steps of the period lead over equal words."""
    n = np.diff(ptr)
    most = np.where(n >= WORDS, n // PERIODS, 0)
    row = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most) + 1
    steps = (n[row] - 1) // period - (PERIODS - 2)
    edge = np.cumsum(steps)
    at = 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + GRID, "right")))
        k = steps[at:end]
        p = np.repeat(period[at:end], k)
        r = np.repeat(row[at:end], k)
        x = ptr[r] + (np.arange(len(p)) - np.repeat(np.cumsum(k) - k, k)) * p
        for step in range(PERIODS - 1):
            same = np.flatnonzero(word[x + step * p] == word[x + (step + 1) * p])
            x, p, r = x[same], p[same], r[same]
        yield r, x, p
        at = end


def find(word: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs, by row, start and period; starts count from the row's first word."""
    none = np.zeros(0, np.int64)
    row, x, p = (np.concatenate(c) for c in zip((none,) * 3, *_grid(word, ptr), strict=True))
    if not len(row):
        return none, none, none, none
    held, of = np.unique(row, return_inverse=True)
    size = ptr[held + 1] - ptr[held]
    # the texts that have such places, one after another, a key of its own before, between and after them
    into = np.cumsum(size + 1) - size
    keys = np.zeros(int(size.sum()) + len(held) + 1, np.int64)
    each = np.repeat(np.arange(len(held)), size)
    inner = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
    wide = int(word.max()) + 2
    keys[into[each] + inner] = (each + 1) * wide + 1 + word[ptr[held][each] + inner]
    keys[into + size] = (np.arange(len(held)) + 1) * wide
    x = x - ptr[row] + into[of]
    y = x + p
    forward = Suffixes(keys).common(x, y)
    back = Suffixes(keys[::-1])
    n = len(keys)
    backward = back.common(n - x, n - y)  # the words before x and y, in the reversed row
    start, length = x - backward, y + forward - x + backward
    whole = np.flatnonzero(length >= np.maximum(WORDS, PERIODS * p))
    row, start, length, p = row[whole], (start - into[of])[whole], length[whole], p[whole]
    order = np.lexsort((p, length, start, row))
    row, start, length, p = row[order], start[order], length[order], p[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    row, start, length, p = row[first], start[first], length[first], p[first]
    order = np.lexsort((p, start, row))
    return row[order], start[order], length[order], p[order]


def plant(word: np.ndarray, ptr: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The words, with those of each row with h >= 0 and h % 10 = 0 repeating a stretch from one place on."""
    out = word.copy()
    for r in np.flatnonzero((h >= 0) & (h % 10 == 0) & (np.diff(ptr) > 0)):
        n, g = int(ptr[r + 1] - ptr[r]), int(h[r]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[ptr[r] + a : ptr[r + 1]] = word[ptr[r] + a + np.arange(n - a) % p]
    return out


def periodic_runs(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), planted: Column | None = None) -> DataFrame:
    """The columns `keep`, `runs` (start, length, period) and `collapsed`: the text without what repeats, words joined by one space.

    Of each run, the words after its first period are left out of `collapsed`.
    `planted`, a number a row, makes the words of some rows periodic first.
    """
    own = [c for c in dict.fromkeys(keep) if c not in ("runs", "collapsed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_text").cast(pa.large_string()).fill_null("")
            h = batch.column("_h").to_numpy()
            for a, b, _, _ in tv.chunks(column):
                word, names, ptr = tv.split(column.slice(a, b - a))
                word = plant(word, ptr, h[a:b])
                row, start, length, period = find(word, ptr)
                edge = np.zeros(len(word) + 1, np.int64)
                np.add.at(edge, ptr[row] + start + period, 1)
                np.add.at(edge, ptr[row] + start + length, -1)
                kept = np.cumsum(edge[:-1]) == 0
                upto = np.concatenate([[0], np.cumsum(kept)])[ptr]
                text_of = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), names.take(pa.array(word[kept]))), pa.scalar(" ", names.type))
                structs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(RUN_TYPE.value_type))
                runs = pa.ListArray.from_arrays(pa.array(tv.ptr(row, b - a).astype(np.int32)), structs)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in own), runs, text_of.cast(pa.string())], [*own, "runs", "collapsed"])
        tv.release()

    h = F.lit(-1) if planted is None else F.coalesce(planted, F.lit(-1))
    taken = docs.select(*own, F.col(text).alias("_text"), h.cast("long").alias("_h"))
    schema = StructType([*docs.select(*own).schema.fields, *StructType.fromDDL(f"runs {RUN_SQL}, collapsed string").fields])
    return tv.arrow(taken).mapInArrow(run, schema)


def greatest(runs: Column) -> Column:
    """The first run of greatest length / period, compared as exact fractions; null without runs."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def op12_runs(docs: DataFrame) -> DataFrame:
    """Runs of every whole text, a tenth of them made periodic first, and digests of runs and collapsed texts."""
    found = periodic_runs(docs.select("doc_id", "text"), planted=F.crc32(F.col("doc_id").cast("string")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), greatest(F.col("runs")).alias("b"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("(1000 * b.length) div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
