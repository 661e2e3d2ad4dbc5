"""SentencePiece encoding and decoding, with Gumbel top-k sampling of segmentations.

Encoding is the library's own, whole texts, made a unit at a time: a unit is a
run of spaces and line feeds with what follows it, up to the next one or to the
border between a letter and another character of ASCII.  No piece of the vocabulary crosses the start
of a unit (checked when the vocabulary is read), so the units' ids put together
are the text's ids, and repeated units are encoded once.

Sampling draws k distinct segmentations without replacement from
P(segmentation) ~ prod weight(piece), weight = (rank + 2)^-temperature, over the
lattice of all pieces.  A text's lattice is the chain of its units' lattices.
The search is A* on perturbed log probabilities: a node is a set of
segmentations with a common beginning, its priority the largest Gumbel-perturbed
log probability within it, drawn top-down (the maximum of a set is a Gumbel at
its log mass, and what hangs off the path to the maximum is truncated there).
Popping a node gives its best segmentation by forward filtering and backward
sampling, and splits off the rest as new nodes.  The unit at which a node
branches off is drawn from the exact complement of the cuts that are spent there.
The first value left in the queue, kappa, gives each sample's inclusion score
1 - exp(-exp(log p - kappa)).
All draws hash the row's key, so a row gets the same samples in any layout.

Cases: a null or empty text has no ids and one empty segmentation (score 1).
Where fewer segmentations exist than are asked for, fewer come.  Equal keys and
texts give equal rows; a null key counts as zero.  Characters that no piece has
become bytes.  Any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textvec as tv

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
TEMPERATURE = 0.5
#: The longest piece that the lattice looks for.
REACH = 16
#: Units that a worker's store holds; beyond that the less frequent half goes.
UNITS = 80_000
#: Bytes of texts handled at once, and of new units that the library gets in one string.
CHUNK, JOIN = 1 << 18, 1 << 13
#: New units whose lattices are built at once.
FRESH = 8_000
#: Units up to this length are summed as products, longer ones as logarithms.
PLAIN = 48
BAR = 0x2581
FLAG = np.uint64(42)
_R = np.uint64(0x9E3779B97F4A7C15)
_M = (1 << 64) - 1
SAMPLE_TYPE = pa.list_(pa.struct([("rank", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())]))
SAMPLE_SQL = "array<struct<rank:int,ids:array<int>,log_prob:double,perturbed:double,inclusion:double>>"

#: Class of each byte: 0 space or line feed, 1 letter, 2 other of ASCII, 3 beyond it (letters up to U+00FF are 1, see kinds).
KIND = np.full(256, 2, np.uint8)
KIND[65:91] = KIND[97:123] = 1
KIND[128:] = 3
KIND[[32, 10]] = 0


def kinds(text: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8; the library's own sign for a space counts as one."""
    out = KIND[text]
    bar = np.flatnonzero((text[:-2] == 0xE2) & (text[1:-1] == 0x96) & (text[2:] == 0x81))
    out[bar] = out[bar + 1] = out[bar + 2] = 0
    latin = np.flatnonzero((text[:-1] == 0xC3) & (text[1:] != 0x97) & (text[1:] != 0xB7))
    out[latin] = out[latin + 1] = 1
    return out


def starts(text: np.ndarray) -> np.ndarray:
    """Whether a unit starts at each byte: before a gap, and between a letter and another character of ASCII."""
    kind = kinds(text)
    out = np.ones(len(text), bool)
    out[1:] = (kind[:-1] > 0) & ((kind[1:] == 0) | (kind[1:] + kind[:-1] == 3))
    return out


def _take(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges start..start+size, one after another."""
    return values[_ranges(start, size)]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode().encode("utf-32-le"), np.uint32).copy()


class Spans:
    """Hashes of spans of a row of code points."""

    def __init__(self, points: np.ndarray):
        self.up, self.down = tv._powers(len(points) + 1)
        self.run = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.up[: len(points)], out=self.run[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.run[end] - self.run[start]) * self.down[start]


class Column:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(0, kind), 0

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            self.room = np.concatenate([self.all, np.zeros(len(x) + self.n // 4, self.room.dtype)])
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)

    def put(self, x: np.ndarray) -> None:
        self.room[: len(x)] = x
        self.n = len(x)


class Vocabulary:
    """Pieces and weights, and a bounded store of the units met so far.

    Of a unit the store has its ids and its lattice: for each place the pieces
    that can end there, longest first, each with its share of the mass up to there.
    """

    def __init__(self, proto: bytes, temperature: float = TEMPERATURE):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.sp.get_piece_size()
        special = [self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i) for i in range(n)]
        plain = [i for i in range(n) if not (special[i] or self.sp.is_byte(i))]
        pieces = [self.sp.id_to_piece(i) for i in plain]
        bare = [p.lstrip("▁").encode() for p in pieces]
        if any(len(p) > REACH for p in pieces) or any(starts(np.frombuffer(b, np.uint8))[1:].any() or b"\n" in b for b in bare if b):
            raise ValueError("pieces cross the starts of units or are too long")
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        last = np.cumsum(length)
        spans = Spans(_points("".join(pieces).encode()))
        keys = spans(last - length, last)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.found = tv.Sorted.of(keys)
        self.flags = np.zeros(1 << (64 - int(FLAG)), np.uint8)  # 2: maybe a piece; 1: maybe the end of one, so that longer spans may be
        for k in range(1, REACH + 1):
            self.flags[(tv.mix(spans((last - k)[length >= k], last[length >= k])) >> FLAG).astype(np.int64)] |= 1
        self.flags[(tv.mix(keys) >> FLAG).astype(np.int64)] |= 2
        self.ids = np.array(plain, np.uint16)[self.found.order]
        self.weight = (-temperature * np.log(2 + np.maximum(0, -np.array([self.sp.get_score(i) for i in plain]))))[self.found.order]
        self.byte_ids = np.array([self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint16)
        self.byte_weight = -temperature * np.log(2.0 + n)
        self.space = self.sp.piece_to_id("▁")
        spelt = [b"" if special[i] else self.sp.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids.tolist()):
            spelt[i] = bytes([b])
        self.wide = np.fromiter(map(len, spelt), np.int64, n)
        self.spelt, self.spelt_at = np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(self.wide) - self.wide
        self.clear()

    def clear(self) -> None:
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash
        self.uses, self.first, self.length, self.fixed_at, self.fixed_n = (Column(np.int64) for _ in range(5))
        self.same = Column(bool)
        self.fixed, self.point = Column(np.int32), Column(np.uint32)
        self.edge_at, self.edges, self.rest = Column(np.int32), Column(np.uint8), Column(np.float32)
        self.p, self.span, self.id = Column(np.float32), Column(np.uint8), Column(np.uint16)

    def shrink(self) -> None:
        """The more frequent half of the units stays."""
        keep = np.sort(np.argsort(-self.uses.all, kind="stable")[: UNITS // 2])
        place = np.full(self.uses.n, -1)
        place[keep] = np.arange(len(keep))
        stays = place[self.slot] >= 0
        self.hash, self.slot = self.hash[stays], place[self.slot[stays]]
        rows = _ranges(self.first.all[keep], self.length.all[keep])
        many = self.edges.all[rows].astype(np.int64)
        cells = _ranges(self.edge_at.all[rows], many)
        ids = _ranges(self.fixed_at.all[keep], self.fixed_n.all[keep])
        for column, at in ((self.point, rows), (self.rest, rows), (self.edges, rows), (self.p, cells), (self.span, cells), (self.id, cells), (self.fixed, ids), (self.uses, keep), (self.length, keep), (self.fixed_n, keep), (self.same, keep)):
            column.put(column.all[at])
        self.uses.put(self.uses.all // 2)
        self.edge_at.put(np.cumsum(many) - many)
        self.first.put(np.cumsum(self.length.all) - self.length.all)
        self.fixed_at.put(np.cumsum(self.fixed_n.all) - self.fixed_n.all)

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of units, each by itself; the first space is the one that the library puts before a text."""
        got = self.sp.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [(ids or [self.space]) if u[0] == " " else ids[1:] for u, ids in zip(units, got, strict=True)]

    def _joined(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, how many of each unit) by few calls on units put together with line feeds; None if they do not spell the units."""
        part = (np.cumsum(size) - size) // JOIN
        opens = np.concatenate([[True], part[1:] != part[:-1]])
        # expected bytes: a space before each string, which the library adds, and a line feed before each unit
        lead = 1 + opens.astype(np.int64)
        begin = np.cumsum(size + lead) - size
        text = np.full(int((size + lead).sum()), 10, np.uint8)
        text[begin[opens] - 2] = 32
        text[_ranges(begin, size)] = raw
        cuts = [*(begin[opens] - 1).tolist(), len(text) + 1]
        data = text.tobytes()
        got = self.sp.encode([data[a : b - 1].decode() for a, b in zip(cuts, cuts[1:], strict=False)], num_threads=1)
        ids = np.fromiter(chain.from_iterable(got), np.int64, sum(map(len, got)))
        wide = self.wide[ids]
        if int(wide.sum()) != len(text) or not np.array_equal(_take(self.spelt, self.spelt_at[ids], wide), text):
            return None
        at = np.cumsum(wide) - wide
        added = np.zeros(len(text), bool)
        added[begin - 1] = added[begin[opens] - 2] = True
        at, ids = at[~added[at]], ids[~added[at]]
        return ids, np.bincount(np.searchsorted(begin, at, "right") - 1, minlength=len(size))

    def add(self, hashes: np.ndarray, raw: np.ndarray, size: np.ndarray) -> None:
        """Takes new units in, given as bytes one after another."""
        many, base = len(hashes), self.uses.n
        begin = np.cumsum(size) - size
        bar = (raw == 0xE2) & (np.append(raw[1:], 0) == 0x96) & (np.append(raw[2:], [0, 0]) == 0x81)
        got = None if bar.any() else self._joined(raw, size)
        same = np.ones(many, bool)
        if got is None:
            data = raw.tobytes()
            units = [data[a:b].decode() for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
            ids = self.encode(units)
            same[:] = [b == (u[1:] if u[0] == " " else u) for b, u in zip(self.sp.decode(ids), units, strict=True)]
            got = np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, many)
        flat, count = got
        points = _points(raw.tobytes())
        points[points == 32] = BAR
        length = np.add.reduceat(((raw & 0xC0) != 0x80).astype(np.int64), begin)
        first = np.cumsum(length) - length
        self.fixed_at.add(self.fixed.n + np.cumsum(count) - count)
        self.fixed_n.add(count)
        self.fixed.add(flat)
        self.first.add(self.point.n + first)
        self.length.add(length)
        self.point.add(points)
        self.same.add(same)
        self.uses.add(np.zeros(many, np.int64))
        self._lattice(points, first, length)
        every, slot = np.concatenate([self.hash, hashes]), np.concatenate([self.slot, base + np.arange(many)])
        order = np.argsort(every, kind="stable")
        self.hash, self.slot = every[order], slot[order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each unit, or -1."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, self.slot[at], -1)

    def _lattice(self, points: np.ndarray, first: np.ndarray, length: np.ndarray) -> None:
        n, many = len(points), len(first)
        owner = np.repeat(np.arange(many), length)
        off = np.arange(n) - first[owner]  # characters before this one
        spans = Spans(points)
        live, count = np.arange(n), np.zeros(n, np.uint8)
        found = []
        for k in range(1, REACH + 1):
            h = spans(live - (k - 1), live + 1)
            flag = self.flags[(tv.mix(h) >> FLAG).astype(np.int64)]
            maybe = np.flatnonzero(flag & 2)
            at = self.found.find(h[maybe])
            end, at = live[maybe[at >= 0]], at[at >= 0]
            found.append((end, k, count[end], self.ids[at], self.weight[at]))
            count[end] += 1
            if k == 1:  # characters that no piece has are spelt in bytes; longer ones later, when they are drawn
                end = np.flatnonzero(count == 0)
                c = points[end]
                bytes_of = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                found.append((end, 1, count[end], np.where(c < 0x80, self.byte_ids[np.minimum(c, 255)], 0), self.byte_weight * bytes_of))
                count[end] = 1
            live = live[((flag & 1) > 0) & (off[live] >= k)]
            if not len(live):
                break
        size = count.astype(np.int64)
        stop = np.cumsum(size)
        at = stop - size
        total = int(stop[-1])
        span, ids, weight = np.zeros(total, np.uint8), np.zeros(total, np.uint16), np.zeros(total)
        for end, k, rank, i, w in found:
            to = stop[end] - 1 - rank
            span[to], ids[to], weight[to] = k, i, w
        share = np.zeros(total)
        node = np.arange(n) + owner + 1  # a unit has a node more than characters
        for units, plain in ((np.flatnonzero(length <= PLAIN), True), (np.flatnonzero(length > PLAIN), False)):
            if not len(units):
                continue
            units = units[np.argsort(-length[units], kind="stable")]
            reach = -length[units]
            mass = np.full(n + many, 1.0 if plain else 0.0)
            w = np.exp(weight) if plain else weight
            for j in range(int(-reach[0])):
                end = first[units[: int(np.searchsorted(reach, -j, "left"))]] + j
                c = size[end]
                e = _ranges(at[end], c)
                begin = np.cumsum(c) - c
                before = mass[np.repeat(node[end], c) - span[e]]
                if plain:
                    x = w[e] * before
                    mass[node[end]] = s = np.add.reduceat(x, begin)
                else:
                    x = w[e] + before
                    top = np.maximum.reduceat(x, begin)
                    x = np.exp(x - np.repeat(top, c))
                    s = np.add.reduceat(x, begin)
                    mass[node[end]] = top + np.log(s)
                share[e] = x / np.repeat(s, c)
        self.rest.add(np.add.reduceat(np.where(share > 0.5, 0.0, share), at))
        self.edge_at.add(self.p.n + at)
        self.edges.add(count)
        self.p.add(share)
        self.span.add(span)
        self.id.add(ids)

    def ids_of(self, edges: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of edges, and how many each group of them has, with characters that no piece has as bytes."""
        ids = self.id.all[edges].astype(np.int32)
        spelt = np.flatnonzero(ids == 0)
        if not len(spelt):
            return ids, sizes
        point = self.point.all[np.searchsorted(self.edge_at.all, edges[spelt], "right") - 1]
        by = [self.byte_ids[list(chr(c).encode())] for c in point.tolist()]
        wide = np.ones(len(ids), np.int64)
        wide[spelt] = [len(b) for b in by]
        out = np.repeat(ids, wide)
        out[_ranges((np.cumsum(wide) - wide)[spelt], wide[spelt])] = np.concatenate(by)
        ends = np.concatenate([[0], np.cumsum(wide)])
        stop = np.cumsum(sizes)
        return out, ends[stop] - ends[stop - sizes]

    def other(self, end: int, paths: list[list[int]], seed: int) -> tuple[list[int], float, float]:
        """A segmentation (edges from the end) of the unit whose last place is `end`, other than `paths`.

        Returns it, its log probability and what mass is left beside it and `paths`, summed of
        positive terms only, so that a small rest stays exact.
        """
        def group(row: int) -> tuple[list[int], list[float], list[int]]:
            a = int(self.edge_at.all[row])
            b = a + int(self.edges.all[row])
            return list(range(a, b)), self.p.all[a:b].tolist(), self.span.all[a:b].tolist()

        def trie(paths: list[list[int]]) -> tuple[list[dict[int, int]], list[float]]:
            nodes: list[dict[int, int]] = [{}]
            rows = [end]
            for path in paths:
                at = 0
                for e in path:
                    if e not in nodes[at]:
                        nodes[at][e] = len(nodes)
                        nodes.append({})
                        rows.append(rows[at] - int(self.span.all[e]))
                    at = nodes[at][e]
            left = [0.0] * len(nodes)
            for i in range(len(nodes) - 1, -1, -1):
                if nodes[i]:
                    edges, p, _ = group(rows[i])
                    left[i] = sum(x * left[nodes[i][e]] if e in nodes[i] else x for e, x in zip(edges, p, strict=True))
            return nodes, left

        nodes, left = trie(paths)
        stop = end - self._before(end)
        path, logp, at, row, step = [], 0.0, 0, end, 0
        while row > stop:
            edges, p, span = group(row)
            w = [x * left[nodes[at][e]] if at >= 0 and e in nodes[at] else x for e, x in zip(edges, p, strict=True)]
            x = (seed + (step + 1) * int(_R)) & _M
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
            want = (((x ^ (x >> 31)) >> 11) + 0.5) * 2.0**-53 * sum(w)
            pick = max(i for i, v in enumerate(w) if v > 0)
            for i, v in enumerate(w):
                if v > 0 and want <= v:
                    pick = i
                    break
                want -= v
            path.append(edges[pick])
            logp += float(np.log(p[pick]))
            at = nodes[at].get(edges[pick], -1) if at >= 0 else -1
            row, step = row - span[pick], step + 1
        return path, logp, trie([*paths, path])[1][0]

    def _before(self, end: int) -> int:
        """Length of the unit whose last place is `end`."""
        return int(self.length.all[np.searchsorted(self.first.all, end, "right") - 1])


class Draws:
    """Uniform numbers from hashes of a document's key, a stream, a place and a step."""

    def __init__(self, keys: np.ndarray):
        self.keys = tv.mix(keys.astype(np.uint64) + np.uint64(0x5EED))

    def seeds(self, doc: np.ndarray, stream: int, place: np.ndarray) -> np.ndarray:
        x = tv.mix(self.keys + np.uint64((stream * 0x10001 + 1) * int(_R) & _M))
        return tv.mix(x[doc] ^ (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    @staticmethod
    def uniform(x: np.ndarray) -> np.ndarray:
        return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53

    def __call__(self, doc: np.ndarray, stream: int, place: np.ndarray) -> np.ndarray:
        return self.uniform(self.seeds(doc, stream, place))


class Chunk:
    """The units of some rows, and draws of segmentations for them."""

    def __init__(self, v: Vocabulary, buf: np.ndarray, offs: np.ndarray, keys: np.ndarray):
        filled = (np.diff(offs) > 0).astype(np.int64)
        shift = np.cumsum(filled)
        row = np.repeat(np.arange(len(filled)), np.diff(offs))
        text = np.full(len(buf) + int(shift[-1] if len(shift) else 0), 32, np.uint8)
        text[np.arange(len(buf)) + shift[row]] = buf
        offs = offs + np.concatenate([[0], shift])
        begin = starts(text)
        begin[offs[:-1][filled > 0]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(text))
        up, down = tv._powers(len(text) + 1)
        run = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=run[1:])
        h = tv.mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
        self.v, self.docs, self.n = v, len(filled), len(start)
        self.ptr = np.searchsorted(start, offs)
        self.doc = np.repeat(np.arange(self.docs), np.diff(self.ptr))
        self.place = np.arange(self.n) - self.ptr[:-1][self.doc]
        self.draws = Draws(keys)
        uniq, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        slots = v.find(uniq)
        if v.uses.n > UNITS:
            v.uses.all[slots[slots >= 0]] += 1
            v.shrink()
            slots = v.find(uniq)
        new = np.flatnonzero(slots < 0)
        if len(new):
            for k in range(0, len(new), FRESH):
                some = new[k : k + FRESH]
                size = end[at[some]] - start[at[some]]
                v.add(uniq[some], _take(text, start[at[some]], size), size)
            slots[new] = v.uses.n - len(new) + np.arange(len(new))
        v.uses.all[slots] += 1
        self.unit = slots[inverse]

    def fixed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each row's begin, whether each row decodes to its text)."""
        at, size = self.v.fixed_at.all[self.unit], self.v.fixed_n.all[self.unit]
        ends = np.concatenate([[0], np.cumsum(size)])[self.ptr]
        bad = np.bincount(self.doc, ~self.v.same.all[self.unit], self.docs)
        return _take(self.v.fixed.all, at, size), ends, bad == 0

    def draw(self, occ: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Backward samples of the units at `occ`: log probability, the mass beside each, edges in order, and edges a unit."""
        v = self.v
        unit = self.unit[occ]
        left = v.length.all[unit]
        row = v.first.all[unit] + left - 1
        seed = self.draws.seeds(self.doc[occ], stream, self.place[occ])
        edge_at, edges, rest, share, spans = v.edge_at.all, v.edges.all, v.rest.all, v.p.all, v.span.all
        p_all, beside, size = np.ones(len(occ)), np.zeros(len(occ)), np.zeros(len(occ), np.int64)
        logp = np.zeros(len(occ))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.arange(len(occ))
        while len(live):
            seed = seed + _R
            u = Draws.uniform(tv.mix(seed))
            e = edge_at[row]
            last = e + edges[row] - 1
            p = share[e].astype(np.float64)
            todo = np.flatnonzero((u > p) & (e < last))
            u = u[todo] - p[todo]
            while len(todo):
                e[todo] += 1
                p[todo] = q = share[e[todo]].astype(np.float64)
                more = (u > q) & (e[todo] < last[todo])
                u, todo = (u - q)[more], todo[more]
            beside[live] += p_all[live] * np.where(p > 0.5, rest[row], 1 - p)
            p_all[live] *= p
            logp[live] += np.log(p)
            steps.append((live, e))
            k = spans[e].astype(np.int64)
            left, row = left - k, row - k
            on = left > 0
            size[live] = len(steps)
            live, left, row, seed = live[on], left[on], row[on], seed[on]
        stop = np.cumsum(size)
        out = np.zeros(int(stop[-1]) if len(stop) else 0, np.int64)
        for i, (own, e) in enumerate(steps):
            out[stop[own] - 1 - i] = e
        return logp, beside, out, size

    def sample(self, k: int) -> list[tuple]:
        """For each of up to k samples: (rows that have it, log p, perturbed, edges, edges of each unit); and last the kappas."""
        n, docs, v = self.n, self.docs, self.v
        every, units = np.arange(docs), np.arange(n)
        some = np.flatnonzero(np.diff(self.ptr))
        starts = self.ptr[:-1][some]
        gumbel = -np.log(-np.log(self.draws(every, 0, np.zeros(docs, np.int64))))
        has, branch, parent = np.ones(docs, bool), self.ptr[:-1].copy(), np.zeros(docs, np.int64)
        spent = np.zeros((docs, k), bool)  # samples whose cuts of the branch unit are spent
        queue, kept, out, branches, spents = [], [], [], [], []
        fresh = np.ones(n, bool)
        for s in range(k):
            branches.append(branch.copy())
            spents.append(spent.copy())
            lp, beside, size = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            occ = np.flatnonzero(fresh)
            lp[occ], beside[occ], edges, size[occ] = self.draw(occ, 2 * s + 1)
            at = np.cumsum(size) - size
            if s:
                pool, base = [edges], len(edges)
                old = np.flatnonzero(has[self.doc] & (units < branch[self.doc]))
                for t, (lp_t, beside_t, edges_t, size_t, at_t) in enumerate(kept):
                    mine = old[parent[self.doc[old]] == t]
                    lp[mine], beside[mine], size[mine], at[mine] = lp_t[mine], beside_t[mine], size_t[mine], at_t[mine] + base
                    pool.append(edges_t)
                    base += len(edges_t)
                rows = np.flatnonzero(has)
                at_unit = branch[rows]
                seeds = self.draws.seeds(rows, 2 * s + 1, self.place[at_unit]).tolist()
                ends = (v.first.all[self.unit[at_unit]] + v.length.all[self.unit[at_unit]] - 1).tolist()
                more: list[int] = []
                for r, i, end, seed in zip(rows.tolist(), at_unit.tolist(), ends, seeds, strict=True):
                    paths = [kept[t][2][kept[t][4][i] : kept[t][4][i] + kept[t][3][i]][::-1].tolist() for t in np.flatnonzero(spent[r]).tolist()]
                    path, lp[i], beside[i] = v.other(end, paths, seed)
                    size[i], at[i] = len(path), base + len(more)
                    more += path[::-1]
                edges = np.concatenate([*pool, np.array(more, np.int64)])
            use = has[self.doc]
            size = np.where(use, size, 0)
            edges = _take(edges, at, size)
            at = np.cumsum(size) - size
            kept.append((lp, beside, edges, size, at))
            run = np.concatenate([[0.0], np.cumsum(np.where(use, lp, 0.0))])
            total = run[self.ptr[1:]] - run[self.ptr[:-1]]
            out.append((has.copy(), total, gumbel.copy(), edges, size))
            # what hangs off this path: at each unit from the branch on, every other cut
            mass = np.full(n, -np.inf)
            open_ = np.flatnonzero(use & (units >= branch[self.doc]) & (beside > 0))
            mass[open_] = run[:-1][open_] - run[self.ptr[:-1]][self.doc[open_]] + np.log(beside[open_])
            value = np.full(n, -np.inf)
            e = -np.log(self.draws(self.doc[open_], 2 * s + 2, self.place[open_]))
            with np.errstate(over="ignore"):
                value[open_] = -np.logaddexp(-gumbel[self.doc[open_]], -mass[open_] + np.log(e))
            queue.append(value)
            # the largest of the queue of each row
            top, which, where = np.full(docs, -np.inf), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
            for t, q in enumerate(queue):
                if not n:
                    break
                best = np.full(docs, -np.inf)
                best[some] = np.maximum.reduceat(q, starts)
                place = np.zeros(docs, np.int64)
                place[some] = np.minimum.reduceat(np.where(q >= best[self.doc], units, n), starts)
                better = best > top
                top[better], which[better], where[better] = best[better], t, place[better]
            has = np.isfinite(top)
            if s == k - 1 or not has.any():
                out.append((has, top))
                break
            spent = np.zeros((docs, k), bool)
            for t in range(s + 1):
                mine = np.flatnonzero(has & (which == t))
                queue[t][where[mine]] = -np.inf
                again = t > 0 and branches[t][mine] == where[mine]
                spent[mine] = spents[t][mine] & np.reshape(again, (-1, 1))
                spent[mine, t] = True
            gumbel, parent, branch = top, which, where
            fresh = has[self.doc] & (units > branch[self.doc])
        return out


def _samples(chunk: Chunk, k: int) -> pa.Array:
    *got, (more, kappa) = chunk.sample(k)
    docs = chunk.docs
    lists = []
    for _, _, _, edges, size in got:
        ids, size = chunk.v.ids_of(edges, size)
        begin = np.concatenate([[0], np.cumsum(size)])[chunk.ptr]
        lists.append(pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids)))
    lists = pa.concat_arrays(lists)
    has = np.array([g[0] for g in got])
    order = np.flatnonzero(has.T.ravel())
    doc, rank = order // len(got), order % len(got)
    logp, value = np.array([g[1] for g in got])[rank, doc], np.array([g[2] for g in got])[rank, doc]
    with np.errstate(over="ignore"):
        inclusion = np.where(more[doc], -np.expm1(-np.exp(np.minimum(logp - np.where(more[doc], kappa[doc], 0.0), 700))), 1.0)
    rows = pa.StructArray.from_arrays([pa.array((rank + 1).astype(np.int32)), lists.take(pa.array(rank * docs + doc)), pa.array(logp), pa.array(value), pa.array(inclusion)], fields=list(SAMPLE_TYPE.value_type))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has.sum(0))]).astype(np.int32)), rows)


_open: dict[tuple, Vocabulary] = {}


def encode(docs: DataFrame, samples: int = SAMPLES, model: str = MODEL, temperature: float = TEMPERATURE, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (its columns `keep`, all by default) with ids, n_tokens, round_trip and `samples` segmentations.

    The vocabulary's file (under 1 MB) is read by the driver and broadcast.
    """
    made = ["ids", "n_tokens", "round_trip", "samples"]
    own = [c for c in docs.columns if (keep is None or c in keep) and c not in made]
    with open(model, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto = held.value
        v = _open.get((model, temperature, len(proto)))
        if v is None:
            v = _open[model, temperature, len(proto)] = Vocabulary(proto, temperature)
        for batch in batches:
            seed = batch.column("_seed").to_numpy()
            for a, b, buf, offs in tv.chunks(batch.column(text), CHUNK):
                chunk = Chunk(v, buf, offs, seed[a:b].view(np.uint64))
                ids, begin, same = chunk.fixed()
                columns = [pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids)), pa.array(np.diff(begin).astype(np.int64)), pa.array(same), _samples(chunk, samples)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in own), *columns], [*own, *made])
        tv.release()

    added = StructType.fromDDL(f"ids array<int>, n_tokens bigint, round_trip boolean, samples {SAMPLE_SQL}")
    schema = StructType([*docs.select(*own).schema.fields, *added.fields])
    seed = F.coalesce(F.xxhash64(F.col(key)), F.lit(0)).alias("_seed")
    return tv.arrow(docs.select(*dict.fromkeys([*own, text]), seed)).mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """The columns of `rows` and the text of its ids; null ids give a null text."""
    own = [c for c in rows.columns if c != out]
    with open(model, "rb") as f:
        held = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=held.value)
        for batch in batches:
            got = batch.column(ids).to_pylist()
            texts = sp.decode([x or [] for x in got]) if got else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array([None if x is None else t for x, t in zip(got, texts, strict=True)], pa.string())], [*own, out])

    return tv.arrow(rows.select(*dict.fromkeys([*own, ids]))).mapInArrow(run, rows.select(*own).schema.add(out, "string"))


def op8_spm(docs: DataFrame) -> DataFrame:
    """Ids of every whole text, whether they decode to it, and two sampled segmentations."""
    return encode(docs, keep=["doc_id"])
