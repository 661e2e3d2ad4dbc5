"""Packing of documents' tokens into as few sequences of bounded length as linear grouping finds.

Only the number of pieces of each length takes part in the search: a histogram of at
most `capacity` rows, whatever the number of documents.  Pieces longer than a
quarter of the capacity are large.  Large pieces, longest first, are cut into groups
of equal cardinality and rounded up to the longest of their group; which multisets of
these few sizes to use, and how often, is a linear program solved by column
generation (patterns priced by a knapsack over the capacity), whose whole parts are
kept.  Then the actual pieces take their groups' places, longest first, which frees
what rounding up had claimed; what the whole parts left over and all small pieces,
longest first, go where they fit best, or into new sequences.  This is done with few
and with many groups, and the plan of fewest sequences is used.

Every decision is a range: the pieces of one length from one rank to another go to
consecutive sequences, a fixed number to each, from a fixed offset on.  A piece's
rank among those of its length is its place within its task's rows plus the sum
over earlier tasks, so neither a length nor a key is ever ordered in one task.  Ranges
are bounded by the capacity, not by the pieces, and are broadcast.

Cases: a null or empty text is the end token alone.  Repeated rows and null keys are
documents like any other.  Texts of any length are taken whole; a document longer than
the capacity is cut into pieces of it, the last as long as what is left.  Equal lengths
are taken in the order of their rows, which does not change the number of sequences.  An
empty table gives no rows; extra columns are ignored unless kept, and kept ones named as
those made here are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.scratch import Scratch
from . import textvec as tv

CAPACITY = 4096
END = 1
#: Large pieces are longer than the capacity over LARGE; they are planned with each of these numbers of groups.
LARGE, GROUPS = 4, (8, 16, 32, 64, 128)
#: Words whose ids a worker remembers, how many are encoded as one line, and bytes of texts handled at once.
WORDS, LINE, CHUNK = 1 << 21, 64, 8 << 20

#: Marks of ASCII that may close a word; the apostrophe, which begins endings, is none of them.
MARK, ALNUM = np.zeros(256, bool), np.zeros(256, bool)
MARK[[ord(c) for c in ",.;:!?)*]}\""]] = True
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True


def _parts(names: pa.Array) -> pa.Array:
    """Each word as two strings that a tokenizer never joins: up to its last letter or digit of ASCII, and the marks after that, which may be none.

    Words of ASCII alone are put into lower case, as the tokenizer does itself, so that fewer are distinct.
    """
    _, offs, data = names.buffers()
    begin = np.frombuffer(offs, np.int64)[names.offset : names.offset + len(names) + 1]
    text = np.frombuffer(data, np.uint8)[begin[0] : begin[-1]].copy()
    begin = begin - begin[0]
    size = np.diff(begin)
    plain = np.repeat(np.maximum.reduceat(text, begin[:-1]) < 128, size)
    text[plain] = tv.LOWER[text[plain]]
    last = np.where(MARK[text], -1, np.arange(len(text)))
    cut = np.maximum(np.maximum.reduceat(last, begin[:-1]) + 1, begin[:-1])  # after the last byte that is no mark
    cut = np.where((cut > begin[:-1]) & ALNUM[text[np.maximum(cut - 1, 0)]], cut, begin[1:])
    both = np.append(np.stack([begin[:-1], cut], 1).ravel(), begin[-1])
    return pa.LargeStringArray.from_buffers(2 * len(names), pa.py_buffer(both), pa.py_buffer(text))


def _gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[first:first+size] of each, one after another."""
    return values[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class WordIds:
    """Ids of words by a tokenizer that drops white space; each word is encoded once while it is remembered."""

    def __init__(self, file: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(file.decode())
        self.encode = made.encode_batch_fast
        self.closes = np.zeros(made.get_vocab_size(), bool)  # ids that end a run of letters
        self.closes[[i for t, i in made.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _one_by_one(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.encode(words.to_pylist(), add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _fresh(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words not met before.  Words of small Latin letters alone are one run each, so many are encoded as one line and told apart by the ids that end a run."""
        letters = pc.match_substring_regex(words, "^[a-zß-öø-ÿ]+$").to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
        line = words.take(pa.array(order[: letters.sum()])).to_pylist()
        got = self.encode(["\n".join(line[i : i + LINE]) for i in range(0, len(line), LINE)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in got), np.uint32)
        size = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
        if len(size) != len(line):  # a tokenizer of another kind
            return self._one_by_one(words)
        rest, more = self._one_by_one(words.take(pa.array(order[len(line) :])))
        ids, size = np.append(ids, rest), np.append(size, more)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return _gather(ids, (np.cumsum(size) - size)[back], size[back]), size[back]

    def __call__(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has)."""
        if len(self.known) > WORDS:
            self.forget()
        if not len(names):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        parts = _parts(names).dictionary_encode()
        at = pc.index_in(parts.dictionary, self.known).fill_null(-1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        at[fresh] = len(self.known) + np.arange(len(fresh))
        new = parts.dictionary.take(pa.array(fresh))
        ids, size = self._fresh(new)
        self.ids, self.size = np.append(self.ids, ids), np.append(self.size, size)
        self.known = pa.concat_arrays([self.known, new])
        at = at[parts.indices.to_numpy()]
        size = self.size[at]
        return _gather(self.ids, (np.cumsum(self.size) - self.size)[at], size), size[::2] + size[1::2]


def tokens(words: WordIds, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the texts, each closed by END, one after another; where each begins)."""
    word, names, ptr = tv.split(texts)
    flat, size = words(names)
    count = size[word]
    begin = np.concatenate([[0], np.cumsum(count)])
    docs = begin[ptr] + np.arange(len(ptr))
    out = np.full(int(docs[-1]), END, np.uint32)
    into = np.ones(len(out), bool)
    into[docs[1:] - 1] = False
    out[into] = _gather(flat, (np.cumsum(size) - size)[word], count)
    return out, docs


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold CHUNK bytes, since each look into the store costs as much as the store is large."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, (None,)):
        if held and (batch is None or sum(b.nbytes for b in held) >= CHUNK):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        if batch is not None and len(batch):
            held.append(batch)


_open: dict[int, WordIds] = {}


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", keep: Sequence[str] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: `keep`, piece, start, length, ids_crc32 and, if asked, ids.

    The tokenizer's file is read by the driver and broadcast.  It must not join words over white space.
    """
    made = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    own = [c for c in dict.fromkeys(keep) if c not in made]
    with open(path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = zlib.crc32(held.value)
        words = _open.get(name) or _open.setdefault(name, WordIds(held.value))
        for batch in _joined(batches):
            column = batch.column("_text").cast(pa.large_string()).fill_null("")
            for a, b, _, _ in tv.chunks(column, CHUNK):
                ids, begin = tokens(words, column.slice(a, b - a))
                total = np.diff(begin)
                pieces = -(-total // capacity)
                row = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(total[row] - start, capacity)
                place = begin[row] + start
                view = ids.astype("<u4").data
                crc = [zlib.crc32(view[i : i + n]) for i, n in zip(place.tolist(), length.tolist(), strict=True)]
                columns = [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:  # pieces follow one another without gaps
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(place, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a).take(pa.array(row)) for c in own), *columns], [*own, *made])
        tv.release()

    added = "piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    schema = StructType([*docs.select(*own).schema.fields, *StructType.fromDDL(added).fields])
    return tv.arrow(docs.select(*own, F.col(text).alias("_text"))).mapInArrow(run, schema)


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """How often to use which multiset of sizes so that the demand is met with least sequences, fractions allowed.

    The dual prices of the basis value the sizes; the multiset of greatest value that
    fits enters while it is worth more than a sequence.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    use = demand / np.diag(basis)
    for _ in range(100 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        entering, worth = _best_fill(sizes, price, capacity)
        if worth <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, entering.astype(float))
        able = np.flatnonzero(change > 1e-11)
        ratio = use[able] / change[able]
        leave = able[ratio.argmin()]
        basis[:, leave] = entering
        use = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(np.rint(basis[:, i]).astype(np.int64), float(use[i])) for i in range(k) if use[i] > 0]


def _best_fill(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The multiset of sizes of greatest total price that fits, by layers of one more piece."""
    value, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        better, pick = value.copy(), np.full(capacity + 1, -1)
        for i, (s, p) in enumerate(zip(sizes.tolist(), price.tolist(), strict=True)):
            more = value[: capacity + 1 - s] + p
            gain = more > better[s:] + 1e-12
            better[s:][gain] = more[gain]
            pick[s:][gain] = i
        if (pick < 0).all():
            break
        value, choices = better, [*choices, pick]
    found, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(choices):
        if pick[room] >= 0:
            found[pick[room]] += 1
            room -= sizes[pick[room]]
    return found, float(found @ price)


class Plan:
    """Ranges of pieces of a length and the sequences they go to."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS[-1]):
        """counts[n]: the pieces of length n, for n up to the capacity."""
        self.capacity = capacity
        self.left = [int(c) for c in counts]
        self.taken = [0] * len(counts)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, sequence, pieces a sequence, offset
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # sequences by what is free in them
        self._large(capacity // large, groups)
        self._small()

    def _place(self, length: int, many: int, sequence: int, each: int, offset: int) -> None:
        self.rows.append((length, self.taken[length], sequence, each, offset))
        self.taken[length] += many
        self.left[length] -= many

    def _groups(self, above: int, groups: int) -> list[list[list[int]]]:
        """Runs [length, pieces], longest first, in groups of equal cardinality; groups of one size are one."""
        total, upto, out = sum(self.left[above + 1 :]), 0, []
        for n in range(self.capacity, above, -1):
            many = self.left[n]
            while many:
                g = upto * groups // total
                here = min(many, -(-(g + 1) * total // groups) - upto)  # up to the group's end
                if not out or out[-1][0] != g:
                    out.append((g, []))
                out[-1][1].append([n, here])
                upto, many = upto + here, many - here
        merged: list[list[list[int]]] = []
        for _, runs in out:
            if merged and merged[-1][0][0] == runs[0][0]:
                merged[-1] += runs
            else:
                merged.append(runs)
        return merged

    def _large(self, above: int, groups: int) -> None:
        queues = self._groups(above, groups)
        if not queues:
            return
        sizes = np.array([runs[0][0] for runs in queues])
        demand = np.array([sum(m for _, m in runs) for runs in queues], float)
        for pattern, use in patterns(sizes, demand / demand.sum(), self.capacity):
            held = [i for i in np.flatnonzero(pattern) for _ in range(pattern[i])]
            have = [sum(m for _, m in queues[i]) // pattern[i] for i in np.flatnonzero(pattern)]
            times = min(int(use * demand.sum() + 1e-6), *have)
            if times > 0:
                self._substitute([_pop(queues[i], times) for i in held], times)

    def _substitute(self, slots: list[list[list[int]]], times: int) -> None:
        """Sequences of a pattern, each slot given as runs of actual lengths; cut where any slot's length changes."""
        while times:
            many = min(runs[0][1] for runs in slots)
            offset = 0
            for runs in slots:
                n = runs[0][0]
                self._place(n, many, self.sequences, 1, offset)
                offset += n
                runs[0][1] -= many
                if not runs[0][1]:
                    runs.pop(0)
            self.room[self.capacity - offset].append((self.sequences, many))
            self.sequences += many
            times -= many

    def _small(self) -> None:
        """What is left, longest first, each to the sequence with the least room that takes it."""
        for n in range(self.capacity, 0, -1):
            room = n
            while self.left[n]:
                while room <= self.capacity and not self.room[room]:
                    room += 1
                if room > self.capacity:
                    room = self.capacity
                    fit = room // n
                    self.room[room].append((self.sequences, -(-self.left[n] // fit)))
                    self.sequences += self.room[room][-1][1]
                first, many = self.room[room].pop()
                fit = room // n
                full = min(many, self.left[n] // fit)
                if full:
                    self._place(n, full * fit, first, fit, self.capacity - room)
                    self.room[room - fit * n].append((first, full))
                rest = self.left[n] if full < many else 0  # fewer than `fit`
                if rest:
                    self._place(n, rest, first + full, fit, self.capacity - room)
                    self.room[room - rest * n].append((first + full, 1))
                    full += 1
                if full < many:
                    self.room[room].append((first + full, many - full))

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """(length << 48 | first rank, in order; sequence, pieces a sequence and offset of each range)."""
        rows = np.array(self.rows, np.int64).reshape(-1, 5)
        key = (rows[:, 0] << 48) | rows[:, 1]
        order = np.argsort(key)
        return key[order], rows[order, 2:]


def best_plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """The plan of fewest sequences: few groups leave room that small pieces fill well, many suit lengths without small ones."""
    return min((Plan(counts, capacity, LARGE, g) for g in GROUPS), key=lambda p: p.sequences)


def _pop(runs: list[list[int]], many: int) -> list[list[int]]:
    """Takes `many` pieces from the front of runs."""
    out = []
    while many:
        n, have = runs[0]
        here = min(have, many)
        out.append([n, here])
        many -= here
        runs[0][1] -= here
        if not runs[0][1]:
            runs.pop(0)
    return out


def _numbered(pieces: DataFrame, length: str, capacity: int) -> DataFrame:
    """Adds the task and, within it, the place among pieces of the same length.

    Written at once by the caller: numbers of one attempt belong together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 2, np.int64)
        for batch in batches:
            n = np.clip(batch.column(length).fill_null(0).to_numpy(zero_copy_only=False), 0, capacity + 1)  # wrong lengths are refused by the caller
            order = np.argsort(n, kind="stable")
            n = n[order]
            first = np.concatenate([[0], np.flatnonzero(n[1:] != n[:-1]) + 1]) if len(n) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(n)))
            place = np.empty(len(n), np.int64)
            place[order] = np.arange(len(n)) - np.repeat(first, size) + seen[n]
            seen[n[first]] += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), task, np.int32)), pa.array(place)], [*batch.schema.names, "_task", "_place"])

    return pieces.mapInArrow(run, StructType([*pieces.schema.fields, *StructType.fromDDL("_task int, _place bigint").fields]))


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset; lengths must lie between 1 and the capacity."""
    scratch = Scratch(pieces.sparkSession, "packing")
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset", "_task", "_place")]
    table = scratch.save(_numbered(pieces.select(*own), length, capacity), "pieces")
    each = scratch.save(table.groupBy("_task", F.col(length).alias("_n")).agg(F.count("*").alias("_many")), "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in each.groupBy("_n").agg(F.sum("_many").alias("many")).toLocalIterator():  # a row a length
        if r._n is None or not 0 < r._n <= capacity:
            raise ValueError(f"a piece of length {r._n}; lengths lie between 1 and {capacity}")
        counts[r._n] = r.many
    plan = best_plan(counts, capacity)
    held = pieces.sparkSession.sparkContext.broadcast(plan.lookup())
    earlier = Window.partitionBy("_n").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    before = each.select(F.col("_task").alias("_t"), "_n", F.coalesce(F.sum("_many").over(earlier), F.lit(0)).alias("_before"))
    ranked = table.join(before, (F.col("_task") == F.col("_t")) & (F.col(length) == F.col("_n")))
    ranked = ranked.select(*own, (F.col("_before") + F.col("_place")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, to = held.value
        for batch in batches:
            n, rank = batch.column(length).to_numpy().astype(np.int64), batch.column("_rank").to_numpy()
            key = (n << 48) | rank
            at = np.searchsorted(keys, key, "right") - 1
            sequence, fit, offset = to[at].T
            place = key - keys[at]
            columns = [*(batch.column(c) for c in own), pa.array(sequence + place // fit), pa.array(offset + place % fit * n)]
            yield pa.RecordBatch.from_arrays(columns, [*own, "sequence_id", "offset"])

    schema = StructType([*pieces.select(*own).schema.fields, *StructType.fromDDL("sequence_id bigint, offset bigint").fields])
    return tv.arrow(ranked).mapInArrow(run, schema)


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """One row a sequence: its ids, and where its pieces begin; a sequence's pieces hold no more ids than the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.col(ids).alias("ids"))))
    one = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return one.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.offset").alias("starts"))


def op13_packing(docs: DataFrame) -> DataFrame:
    """Pieces of every whole document, and the places they were packed into."""
    from public_tokenizers import path

    return pack(cut(docs, path("word_bpe_49k.json")))
