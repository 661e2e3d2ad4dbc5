"""Benchmark decontamination by greedy string tiling.

Texts are sequences of lower-cased words (runs of letters and digits).  Windows
of `least` words are hashed as Karp and Rabin do; windows that a document
shares with a benchmark item are its seeds.  Equal windows in a row on one
diagonal are a maximal match.  The longest match whose words are unmarked on
both sides becomes a tile and marks them; what is left of an overlapped match
goes back to the queue while it has `least` words.  Where a text repeats itself
and equal positions would multiply, the same tiles are found row by row.  Tiles
may come in any order, so a reordered passage is still covered.  The share of an item's words
under tiles is its coverage, and from `coverage` up the document is
contaminated.

Seeds of a benchmark whose text is below BROADCAST_BYTES go to every task, and
each document is tiled where it is read: no shuffle.  Beyond that size seeds
are joined by hash, and only pairs with seeds enough meet again for tiling.

Cases: null and empty texts on either side match nothing, nor do items with
fewer words than a window.  Repeated rows are judged alike; an item with a null
id is ignored.  Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.scratch import Scratch
from . import textvec as tv

LEAST = 5
COVERAGE = 0.5
BROADCAST_BYTES = 32 << 20
#: Pairs of equal positions that are listed; beyond that an item is tiled a row of matches at a time.
PAIRS_AT_ONCE = 1 << 20

PAIRS = "item_id {kind}, coverage double, n_tiles int, longest int, tiles array<struct<item_start:int,doc_start:int,length:int>>"


def tile(i: np.ndarray, j: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (item position, document position, words) from the positions of equal windows."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    start = np.flatnonzero(np.concatenate([[True], (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)]))
    run = np.diff(np.append(start, len(i)))
    heap = [(-int(n) - least + 1, int(i[s]), int(j[s])) for s, n in zip(start, run, strict=True)]
    heapq.heapify(heap)
    marked_i, marked_j, tiles = set(), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [a + k not in marked_i and b + k not in marked_j for k in range(-n)]
        if all(free):
            marked_i.update(range(a, a - n))
            marked_j.update(range(b, b - n))
            tiles.append((a, b, -n))
            continue
        k = 0
        while k < -n:
            if not free[k]:
                k += 1
                continue
            end = k
            while end < -n and free[end]:
                end += 1
            if end - k >= least:
                heapq.heappush(heap, (k - end, a + k, b + k))
            k = end
    return tiles


def tile_by_rows(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The same tiles from the window hashes of both sides, a row of matches at a time.

    For texts that repeat themselves: equal positions multiply, rows do not.
    `doc` may hold zeros where a window is no seed.
    """
    free_i, free_j = np.ones(len(item), bool), doc != 0
    tiles = []
    while True:
        best, run = (0, 0, 0), np.zeros(len(doc) + 1, np.int64)
        for i in range(len(item)):
            if not free_i[i]:
                run[:] = 0
                continue
            run[1:] = np.where((doc == item[i]) & free_j, run[:-1] + 1, 0)
            top = int(run.max())
            j = int(run.argmax()) - 1
            # the longest; of equals the one that begins first in the item, then in the document
            if top and (top, top - i, top - j) > best:
                best = (top, top - i, top - j)
        n = best[0]
        if not n:
            return tiles
        a, b = 1 - best[1], 1 - best[2]
        tiles.append((a, b, n + least - 1))
        free_i[max(a - least + 1, 0) : a + n + least - 1] = False
        free_j[max(b - least + 1, 0) : b + n + least - 1] = False


@dataclass
class Seeds:
    """Windows of all items: where each hash occurs."""

    ids: list
    sizes: np.ndarray
    found: tv.Sorted
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    whole: np.ndarray  # the items' windows in order, and where each item's begin
    begin: np.ndarray


def _windows(column: pa.Array, least: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, window hashes, row, position in the row, words of each row) of full windows."""
    for a, b, buf, offs in tv.chunks(pc.utf8_lower(column.cast(pa.large_string()))):
        w = tv.words(buf, offs, tv.NON_WORD)
        x, row = tv.shingles(w, least)
        full = w.counts[row] >= least
        x, row = x[full], row[full]
        yield a, b, x, row, np.arange(len(row)) - tv.ptr(row, b - a)[row], w.counts


def seeds_of(ids: list, texts: pa.Array, least: int) -> Seeds:
    hashes, items, places, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(ids), np.int64)
    for a, b, x, row, place, n in _windows(texts, least):
        hashes.append(x)
        items.append(row + a)
        places.append(place)
        sizes[a:b] = n
    x, item, place = np.concatenate(hashes), np.concatenate(items), np.concatenate(places)
    found = tv.Sorted.of(np.unique(x))
    at = found.find(x)
    order = np.argsort(at, kind="stable")
    return Seeds(ids, sizes, found, np.searchsorted(at[order], np.arange(len(found.hashes))), item[order], place[order], x, np.searchsorted(item, np.arange(len(ids) + 1)))


def _judge(x: np.ndarray, place: np.ndarray, hit: np.ndarray, s: Seeds, least: int, coverage: float) -> Iterator[tuple]:
    """(id, coverage, tiles) of the items that one document covers; hit: positions of x's seeds."""
    n = s.first[hit + 1] - s.first[hit]
    seeds, times = np.unique(hit, return_counts=True)
    many = s.first[seeds + 1] - s.first[seeds]
    if int((many * times).sum()) <= PAIRS_AT_ONCE:
        at = np.repeat(s.first[hit], n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        item, i, j = s.item[at], s.place[at], np.repeat(place, n)
        order = np.argsort(item, kind="stable")
        item, i, j = item[order], i[order], j[order]
        starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        for a, b in zip(starts, np.append(starts[1:], len(item)), strict=True):
            if _reach(i[a:b], int(s.sizes[item[a]]), least, coverage):
                yield from _covered(tile(i[a:b], j[a:b], least), int(item[a]), s, coverage)
        return
    # places of seeds in the items, without their places in the document
    at = np.repeat(s.first[seeds], many) + (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
    item, i, weight = s.item[at], s.place[at], np.repeat(times, many)
    order = np.argsort(item, kind="stable")
    item, i, weight = item[order], i[order], weight[order]
    starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    dense = np.zeros(int(place.max()) + 1, np.uint64)
    dense[place] = x
    for a, b in zip(starts, np.append(starts[1:], len(item)), strict=True):
        k = int(item[a])
        if not _reach(i[a:b], int(s.sizes[k]), least, coverage):
            continue
        whole = s.whole[s.begin[k] : s.begin[k + 1]]
        if int(weight[a:b].sum()) <= PAIRS_AT_ONCE:
            here = np.flatnonzero(np.isin(x, whole))
            low, high = np.sort(whole), np.argsort(whole, kind="stable")
            first, last = np.searchsorted(low, x[here], "left"), np.searchsorted(low, x[here], "right")
            size = last - first
            ii = high[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            tiles = tile(ii, np.repeat(place[here], size), least)
        else:
            tiles = tile_by_rows(whole, dense, least)
        yield from _covered(tiles, k, s, coverage)


def _reach(i: np.ndarray, size: int, least: int, coverage: float) -> bool:
    """Whether the seeds cover enough words of an item; tiles cover no more."""
    reach = np.zeros(size + 1, np.int64)
    mine = np.unique(i)
    np.add.at(reach, mine, 1)
    np.add.at(reach, np.minimum(mine + least, size), -1)
    return (np.cumsum(reach)[:size] > 0).sum() >= coverage * size


def _covered(tiles: list[tuple[int, int, int]], k: int, s: Seeds, coverage: float) -> Iterator[tuple]:
    share = sum(t[2] for t in tiles) / int(s.sizes[k])
    if share >= coverage:
        yield s.ids[k], share, tiles


def _rows(key: pa.Array, found: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    own = key.take(pa.array([f[0] for f in found], pa.int64()))
    tiles = pa.array([[{"item_start": a, "doc_start": b, "length": n} for a, b, n in f[3]] for f in found], kinds[1])
    return pa.RecordBatch.from_arrays(
        [own, pa.array([f[1] for f in found], kinds[0]), pa.array([f[2] for f in found], pa.float64()), pa.array([len(f[3]) for f in found], pa.int32()), pa.array([max(t[2] for t in f[3]) for f in found], pa.int32()), tiles],
        ["doc_id", "item_id", "coverage", "n_tiles", "longest", "tiles"],
    )


_TILES = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))


def _scan(held, least: int, coverage: float, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        for batch in batches:
            found = []
            for a, b, x, row, place, _ in _windows(batch.column("text"), least):
                at = s.found.find(x)
                hit = np.flatnonzero(at >= 0)
                own = row[hit]
                for r in np.unique(own):
                    mine = hit[own == r] if len(hit) < 64 else hit[np.searchsorted(own, r) : np.searchsorted(own, r, "right")]
                    found += [(int(r) + a, *f) for f in _judge(x[mine], place[mine], at[mine], s, least, coverage)]
            if found:
                yield _rows(batch.column("doc_id"), found, [item_type, _TILES])

    return run


def _seed_rows(least: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, row, _, n in _windows(batch.column("text"), least):
                order = np.lexsort((x, row))
                x, row = x[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (row[1:] != row[:-1])])) if len(x) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(x)))
                x, row = x[first], row[first]
                key = batch.column(name).slice(a, b - a).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([key, pa.array(x.view(np.int64)), pa.array(times.astype(np.int64)), pa.array(n[row].astype(np.int64))], [name, "seed", "times", "words"])

    return run


def _pairwise(least: int, coverage: float, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in range(batch.num_rows):
                s = seeds_of([batch.column("item_id")[r].as_py()], batch.column("item_text").slice(r, 1), least)
                for _, _, x, _, place, _ in _windows(batch.column("text").slice(r, 1), least):
                    at = s.found.find(x)
                    hit = np.flatnonzero(at >= 0)
                    if len(hit):
                        found += [(r, *f) for f in _judge(x[hit], place[hit], at[hit], s, least, coverage)]
            if found:
                yield _rows(batch.column("doc_id"), found, [item_type, _TILES])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest, tiles) of every document and item that it covers enough."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    kind = items.schema["item_id"].dataType
    item_type = to_arrow_type(kind)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + PAIRS.format(kind=kind.simpleString())
    size = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if (size[0] or 0) + 16 * size[1] <= broadcast_bytes:
        table = items.toArrow()
        texts = table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())
        held = spark.sparkContext.broadcast(seeds_of(table["item_id"].to_pylist(), texts, least))
        return tv.arrow(docs).mapInArrow(_scan(held, least, coverage, item_type), schema)
    scratch = Scratch(spark, "tiling")
    # ids may be null or come again, so rows are numbered, and written so that their numbers stay
    docs = scratch.save(docs.where("text is not null").withColumn("doc_row", F.monotonically_increasing_id()), "docs")
    items = scratch.save(items.withColumn("item_row", F.monotonically_increasing_id()), "items")
    ours = tv.arrow(items).mapInArrow(_seed_rows(least, "item_row"), "item_row long, seed long, times long, words long")
    theirs = tv.arrow(docs).mapInArrow(_seed_rows(least, "doc_row"), "doc_row long, seed long, times long, words long").select("doc_row", "seed")
    # each window covers `least` words at most, so fewer windows than this cannot reach the coverage
    pairs = theirs.join(ours, "seed").groupBy("doc_row", "item_row").agg(F.sum("times").alias("n"), F.max("words").alias("words")).where(F.col("n") * least >= F.col("words") * coverage)
    pairs = scratch.save(pairs.select("doc_row", "item_row"), "pairs")
    met = pairs.join(docs, "doc_row").join(items.withColumnRenamed("text", "item_text"), "item_row")
    return tv.arrow(met.select("doc_id", "item_id", "text", "item_text")).mapInArrow(_pairwise(least, coverage, item_type), schema)


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """`docs` without the contaminated documents; rows with a null doc_id stay."""
    scratch = Scratch(docs.sparkSession, "clean")
    gone = scratch.save(contaminated(docs, benchmark, **how).where("doc_id is not null").select("doc_id").distinct(), "gone")
    if gone.count() <= 2_000_000:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op6_decontam(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that cover half of a benchmark item's words with tiles of five words or more."""
    return contaminated(docs, benchmark)
