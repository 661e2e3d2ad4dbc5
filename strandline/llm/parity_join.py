"""N-gram Jaccard self-join by parity sketches.

A document is the set of its distinct word shingles.  Tokens (shingle hashes)
are XORed into the cells of a sketch, one cell a token: two sketches differ in
at most |A xor B| cells, bit plane by bit plane the parity sketch's bound on
the symmetric difference.  A similarity of t bounds that difference by
(a + b) (1 - t) / (1 + t), so of more cells than that, one is equal: the
pigeonhole.  Cells are counted out by size band (sizes up to a power of two);
a document publishes its first cells with two tokens or more until it has one
more than the bound, and every cell where it has too few of those, which keeps
the pigeonhole whole and leaves out cells that say little.

1. Exact copies fall together by a hash of their set.
2. Cells are matched in hashed shards of packed arrays.  Each task first folds
   what it has seen of a cell, so a hot cell adds at most a row a task there.
3. A cell's documents are compared with its best connected one, true sets are
   intersected, and links merge documents into components.  What is still apart
   in a cell is compared with some documents of the cell's largest component,
   and what remains apart then with every document of another component and a
   size in reach there, large cells dealt out over tasks.
   A bit sketch of 1,024 parities goes along: pairs whose Hamming distance is
   above the bound are dropped within the join, before they become rows.
So no link between components is lost, and a group of near copies costs a star,
not a square of rows.  `links` gives every single link instead.

Cases: a null or empty text, or one without words, has an empty set and links
with nothing; fewer words than a shingle make one shingle of all.  Repeated rows
are copies.  A null id is kept but is never the smallest.  Empty tables give
empty results.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.scratch import Scratch
from . import textvec as tv

KEY_BYTES = 6
#: Cells that a publishing task holds, and that a matching task takes at once.
FLUSH, SHARD = 300_000, 1_000_000
#: Rows of a cell that are compared in one task; larger cells are dealt out.
BLOCK = 512
#: Ids of candidates that a semi-join may broadcast; more are shuffled.
BROADCAST_ROWS = 2_000_000
#: Documents of a cell's largest component that each document apart from it is compared with first.
TARGETS = 16
SKETCH = 16


def token_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by row, sorted, and where each row begins."""
    x, row = tv.distinct(*tv.shingles(tv.words(buf, offs), n))
    return x, tv.ptr(row, len(offs) - 1)


def set_ids(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set, as int64; 0 for the empty set."""
    run = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(tv.mix(x + np.uint64(0x51ED27)), out=run[1:])
    size = np.diff(at)
    ids = tv.mix((run[at[1:]] - run[at[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)) | np.uint64(1)
    return np.where(size > 0, ids.view(np.int64), 0)


def most_apart(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


@cache
def cells_of(band: int, percent: int) -> int:
    bound = int(most_apart(1 << band, 1 << band, percent))
    return -(-(bound + 1) * 6 // 5) + 2


def cell_keys(x: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the cells that each row publishes."""
    size = np.diff(at)
    band = np.where(size > 0, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), 0)
    reach = size * 100 // percent
    keys, rows = [], []
    for up in (0, 1):
        level = band + up
        bound = most_apart(size, np.minimum(1 << level, reach), percent)
        # a set's own band holds partners up to the band's end, the next one those beyond it
        use = np.flatnonzero((size > 0) & (bound > 0) & ((up == 0) | (reach > (1 << band))))
        if not len(use):
            continue
        cells = np.array([cells_of(int(v), percent) for v in range(int(level.max()) + 1)])[level[use]]
        base = np.cumsum(cells) - cells
        count = size[use]
        own = np.repeat(np.arange(len(use)), count)
        token = x[np.repeat(at[use], count) + (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count))]
        h = tv.mix(token ^ (level[use][own].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        cell = base[own] + (((h >> np.uint64(32)) * cells[own].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        word = np.zeros(int(cells.sum()), np.uint64)
        np.bitwise_xor.at(word, cell, tv.mix(h))
        filled = np.bincount(cell, minlength=len(word)) >= 2
        of = np.repeat(np.arange(len(use)), cells)
        run = np.concatenate([[0], np.cumsum(filled)])
        rank = run[1:] - run[base][of]
        enough = (run[base + cells] - run[base] > bound[use])[of]
        out = np.where(enough, filled & (rank <= bound[use][of] + 1), True)
        place = (np.arange(len(word)) - base[of]).astype(np.uint64) | (level[use][of].astype(np.uint64) << np.uint64(40))
        keys.append(tv.mix(word[out] + tv.mix(place[out])) >> np.uint64(64 - 8 * KEY_BYTES))
        rows.append(use[of[out]])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def pack(x: np.ndarray, size: int = KEY_BYTES) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpack(data: bytes, size: int = KEY_BYTES) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def _sizes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in tv.chunks(batch.column("text")):
                x, at = token_sets(buf, offs, n)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(np.diff(at).astype(np.int64)), pa.array(set_ids(x, at))], ["id", "n", "sid"])
        tv.release()

    return run


def _publish(n: int, percent: int, shards: int):
    """Packed (key, set) pairs by shard; `alone` says that the task has seen no other set in that cell."""

    def out(keys: list[np.ndarray], sids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, s = np.concatenate(keys), np.concatenate(sids)
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        k, s = k[fresh], s[fresh]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        last = np.append(first[1:], True)
        # the first set of a cell goes to the cell's shard; others only need to be listed, by any shard
        kind = np.where(first, np.where(last, 0, 1), 2).astype(np.int64)
        shard = np.where(first, k % np.uint64(shards), s.view(np.uint64) % np.uint64(shards)).astype(np.int64)
        group = shard * 3 + kind
        order = np.argsort(group, kind="stable")
        k, s, group = k[order], s[order], group[order]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        ends = np.append(starts[1:], len(group))
        yield pa.RecordBatch.from_arrays(
            [pa.array((group[starts] // 3).astype(np.int32)), pa.array((group[starts] % 3).astype(np.int32)), pa.array([pack(k[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary()), pa.array([s[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())],
            ["shard", "kind", "keys", "sids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sids, held = [], [], 0
        for batch in batches:
            for _, _, buf, offs in tv.chunks(batch.column("text")):
                x, at = token_sets(buf, offs, n)
                k, row = cell_keys(x, at, percent)
                if len(k):
                    keys.append(k)
                    sids.append(set_ids(x, at)[row])
                    held += len(k)
                if held >= FLUSH:
                    yield from out(keys, sids)
                    keys, sids, held = [], [], 0
        if held:
            yield from out(keys, sids)
        tv.release()

    return run


def _match(rows: pa.Table) -> pa.Table:
    """(key, sid) of the cells with two sets or more."""
    kind = np.repeat(rows["kind"].to_numpy(), [len(x.as_py()) // 8 for x in rows["sids"]])
    k = unpack(b"".join(x.as_py() for x in rows["keys"]))
    s = np.frombuffer(b"".join(x.as_py() for x in rows["sids"]), np.int64)
    listed, heads = kind == 2, np.flatnonzero(kind != 2)
    order = heads[np.lexsort((s[heads], k[heads]))]
    hk, hs, many = k[order], s[order], kind[order] == 1
    fresh = np.ones(len(hk), bool)
    fresh[1:] = (hk[1:] != hk[:-1]) | (hs[1:] != hs[:-1])
    start = np.flatnonzero(np.concatenate([[True], hk[1:] != hk[:-1]])) if len(hk) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(hk)))
    shared = (np.add.reduceat(fresh, start, dtype=np.int64) > 1) | (np.add.reduceat(many, start, dtype=np.int64) > 0) if len(hk) else np.zeros(0, bool)
    take = fresh & np.repeat(shared, size)
    return pa.table({"key": pa.array(np.concatenate([hk[take], k[listed]]).astype(np.int64)), "sid": pa.array(np.concatenate([hs[take], s[listed]]))})


def bit_sketch(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 * SKETCH parity bits of each set: each token flips one."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    h = tv.mix(x ^ np.uint64(0xA24BAED4963EE407))
    out = np.zeros((len(at) - 1) * SKETCH, np.uint64)
    np.bitwise_xor.at(out, row * SKETCH + (h % np.uint64(SKETCH)).astype(np.int64), np.uint64(1) << ((h >> np.uint64(32)) & np.uint64(63)))
    return out.reshape(-1, SKETCH).view(np.int64)


def _sets(n: int):
    names = ["sid", "tokens", "n", *[f"b{i}" for i in range(SKETCH)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in tv.chunks(batch.column("text")):
                x, at = token_sets(buf, offs, n)
                bits = bit_sketch(x, at)
                # 48 bits tell apart the tokens of two sets
                tokens = pa.array([pack(x[at[i] : at[i + 1]] >> np.uint64(16)) for i in range(len(at) - 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(x, at)), tokens, pa.array(np.diff(at).astype(np.int64)), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(SKETCH)]], names)
        tv.release()

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, last, left = np.zeros(batch.num_rows, bool), None, None
            xs = batch.column("x").to_numpy()
            for i in range(batch.num_rows):
                if xs[i] != last:
                    left, last = unpack(batch.column("tx")[i].as_py()), xs[i]
                right = unpack(batch.column("ty")[i].as_py())
                small, large = (left, right) if len(left) <= len(right) else (right, left)
                if 100 * len(small) < percent * len(large):
                    continue
                both = large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small
                common = int(both.sum())
                ok[i] = 100 * common >= percent * (len(small) + len(large) - common)
            yield batch.select(["x", "y"]).filter(pa.array(ok))
        tv.release()

    return run


class _Join:
    """What both results share: sets by row, cells with two sets or more, and the sets that lie in them."""

    def __init__(self, docs: DataFrame, n: int, percent: int, key: str, text: str):
        spark = docs.sparkSession
        self.percent, self.scratch = percent, Scratch(spark, "parity")
        save = self.scratch.save
        rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        kind = rows.schema["id"].dataType.simpleString()
        self.every = save(tv.arrow(rows).mapInArrow(_sizes(n), f"id {kind}, n long, sid long"), "rows")
        # a set publishes a cell more than the bound on its difference, for two levels at most
        cells = self.every.agg(F.sum(4 * F.col("n") * (100 - percent) / (100 + percent) + 4)).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(cells) // SHARD + 1)
        published = tv.arrow(rows.select("text")).mapInArrow(_publish(n, percent, shards), "shard int, kind int, keys binary, sids binary")
        self.shared = save(tv.arrow(published).groupBy("shard").applyInArrow(_match, "key long, sid long"), "cells")
        self.of_set = self.every.where("sid <> 0").groupBy("sid").agg(F.min("id").alias("first"), F.count("*").alias("n_copies"))
        wanted = save(self.of_set.join(self.shared.select("sid").distinct(), "sid", "left_semi").select(F.col("first").alias("want")).distinct(), "wanted")
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        self.bits = [f"b{i}" for i in range(SKETCH)]
        sets = tv.arrow(rows.join(wanted, F.col("id").eqNullSafe(F.col("want")), "left_semi").select("text")).mapInArrow(_sets(n), "sid long, tokens binary, n long, " + ", ".join(f"{b} long" for b in self.bits))
        self.sets = save(sets.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("tokens", "n", *self.bits)]), "sets")

    def links_of(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (x, y) that are links."""
        left = self.sets.select(F.col("sid").alias("x"), F.col("tokens").alias("tx"))
        right = self.sets.select(F.col("sid").alias("y"), F.col("tokens").alias("ty"))
        return self.scratch.save(tv.arrow(pairs.join(left, "x").join(right, "y").select("x", "y", "tx", "ty")).mapInArrow(_verify(self.percent), "x long, y long"), name)

    def near(self) -> Column:
        """Whether rows a and b may be linked, by sizes and sketches alone."""
        apart = sum((F.bit_count(F.col(f"a.{b}").bitwiseXOR(F.col(f"b.{b}"))) for b in self.bits), F.lit(0))
        both = F.col("a.n") + F.col("b.n")
        return (100 * F.least("a.n", "b.n") >= self.percent * F.greatest("a.n", "b.n")) & (apart <= F.floor(both * (100 - self.percent) / (100 + self.percent)))

    def sketched(self, rows: DataFrame) -> DataFrame:
        """Rows of cells (key, sid, parts and others) with the size and sketch of their set."""
        return rows.join(self.sets.drop("tokens"), "sid")

    def within_cells(self, cells: DataFrame, test: Column) -> DataFrame:
        """Distinct pairs (x, y) of sets that share a cell, may be linked and pass a test of rows a and b.

        A cell of more than BLOCK rows has several parts: one side is dealt over them, the
        other goes to all, and sets meet only those of their size band and the next one.
        """
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / self.percent) + 1e-9))
        hot = F.col("parts") > 1
        cells = cells.withColumn("band", F.when(hot, band).otherwise(0))
        small = cells.select("*", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part"), F.explode(F.when(hot, F.array("band", F.col("band") + 1)).otherwise(F.array("band"))).alias("meets")).alias("a")
        large = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).alias("b")
        met = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.meets") == F.col("b.band"))
        order = F.struct("a.n", "a.sid") < F.struct("b.n", "b.sid")
        return small.join(large, met & order & self.near() & test).select(F.col("a.sid").alias("x"), F.col("b.sid").alias("y")).distinct()


def _parts() -> Column:
    """Into how many parts a cell is dealt, by its rows."""
    return F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")


def links(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members): all pairs (x, y) of different sets that are linked, and the rows (key, sid, n_shingles) of each set.

    No link between different texts is lost and copies are not expanded; the pairs
    of a group of near copies grow with its square, which `components` avoids.
    """
    join = _Join(docs, n, percent, key, text)
    parts = join.shared.groupBy("key").agg(_parts())
    pairs = join.within_cells(join.sketched(join.shared.join(parts, "key")), F.lit(True))
    found = join.links_of(pairs, "links")
    members = join.every.where("sid <> 0").select(F.col("id").alias(key), "sid", F.col("n").alias("n_shingles"))
    join.scratch.keep("rows", "links")
    return found, members


def components(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of `docs`: the key, n_shingles, component_id (smallest key in reach of links) and n_copies (rows with the same set)."""
    join = _Join(docs, n, percent, key, text)
    scratch, every, shared, of_set, sets, links_of, near = join.scratch, join.every, join.shared, join.of_set, join.sets, join.links_of, join.near

    # the best connected set of a cell is its star; parents come later in (w, sid), so there are no cycles
    weighed = shared.join(shared.groupBy("sid").agg(F.count("*").alias("w")), "sid")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("w", "sid")).alias("hub")).select("key", F.col("hub.sid").alias("hub"))
    stars = shared.join(hubs, "key").where("sid <> hub").groupBy("sid", "hub").agg(F.count("*").alias("k")).groupBy("sid").agg(F.max_by("hub", F.struct("k", "hub")).alias("hub"))
    found = links_of(stars.select(F.col("sid").alias("x"), F.col("hub").alias("y")), "stars")
    labels = scratch.save(found.select(F.col("x").alias("sid"), F.col("y").alias("c")), "parents")
    while True:
        up = labels.select(F.col("sid").alias("c"), F.col("c").alias("top"))
        if labels.join(up, "c", "left_semi").isEmpty():
            break
        labels = scratch.save(labels.join(up, "c", "left").select("sid", F.coalesce("top", "c").alias("c")), "parents")

    for last in (False, True):
        member = shared.join(labels, "sid", "left").select("key", "sid", F.coalesce("c", "sid").alias("c"))
        apart = member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), _parts()).where("lo <> hi").select("key", "parts")
        cells = scratch.save(join.sketched(member.join(apart, "key")), f"apart{last}")
        if last:
            pairs = join.within_cells(cells, F.col("a.c") != F.col("b.c"))
        else:
            largest = cells.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("c"))
            first = Window.partitionBy("key").orderBy(F.xxhash64("sid"), "sid")
            targets = cells.join(largest, ["key", "c"]).withColumn("place", F.row_number().over(first)).where(F.col("place") <= TARGETS)
            pairs = cells.alias("a").join(targets.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.c") != F.col("b.c")) & near())
            pairs = pairs.select(F.col("a.sid").alias("x"), F.col("b.sid").alias("y")).distinct()
        found = links_of(pairs, f"links{last}")
        if found.isEmpty():
            continue
        of = lambda end: labels.select(F.col("sid").alias(end), F.col("c").alias(f"c{end}"))
        between = found.join(of("x"), "x", "left").join(of("y"), "y", "left").select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"))
        merged = scratch.save(connected_components(between, scratch, "x", "y").select(F.col("node").alias("c"), "component"), f"merged{last}")
        moved = labels.join(merged, "c", "left").select("sid", F.coalesce("component", "c").alias("c"))
        alone = merged.join(labels.select(F.col("sid").alias("c")), "c", "left_anti").select(F.col("c").alias("sid"), F.col("component").alias("c"))
        labels = scratch.save(moved.unionByName(alone), f"labels{last}")
    grouped = of_set.join(labels, "sid", "left").select("sid", "first", "n_copies", F.coalesce("c", "sid").alias("c"))
    least = grouped.groupBy("c").agg(F.min("first").alias("component_id"))
    of = scratch.save(grouped.join(least, "c").select("sid", "component_id", "n_copies"), "classes")
    scratch.keep("rows", "classes")
    return every.join(of, "sid", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("sid") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")
    )


def op10_parity_join(docs: DataFrame) -> DataFrame:
    """Components of three-word shingle sets that share nine tenths of their union."""
    return components(docs.select("doc_id", "text"), 3, 90)


def distinct_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without near copies: of each component one row stays, of the smallest doc_id.

    Rows with an empty set have no links and stay; so do rows with a null doc_id.
    The ids to drop are broadcast only while they are few; more are a shuffled anti-join.
    """
    scratch = Scratch(docs.sparkSession, "distinct")
    found = scratch.save(components(docs, n, percent), "found")
    small = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    gone = scratch.save(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    again = scratch.save(found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    again = small(again)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
