"""Operator 13: tokens against the library, plans against bounds and plain packing, and odd tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path

from strandline.llm import packing
from strandline.session import table

FILE = path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Ab's I'LL 'RE don't 12 3,4 !!..' s"), (4, "Ab's I'LL 'RE don't 12 3,4 !!..' s"), (None, "é É İ ΣΣ ͅa b　c x\x1cy \x85z"), (5, "<|endoftext|> a<|startoftext|>b"), (6, "x" * 30_000), (7, "many words " * 9000), (8, "日本語 😀\n\nÜber")]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def first_fit(lengths, capacity):
    """First-fit decreasing, plainly."""
    room = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= n), None)
        if at is None:
            room.append(capacity)
            at = -1
        room[at] -= n
    return len(room)


def fewest(lengths, capacity):
    """The least number of sequences, by search."""
    lengths = sorted(lengths, reverse=True)

    def fits(i, room):
        if i == len(lengths):
            return True
        for k in range(len(room)):
            if room[k] >= lengths[i] and room[k] not in room[:k]:
                room[k] -= lengths[i]
                if fits(i + 1, room):
                    return True
                room[k] += lengths[i]
        return False

    k = -(-sum(lengths) // capacity)
    while not fits(0, [capacity] * k):
        k += 1
    return k


def spread(plan, counts):
    """The sequences that a plan makes, as lists of (offset, length); every piece must be placed once."""
    keys, to = plan.lookup()
    made = {}
    for n, many in enumerate(counts):
        for rank in range(int(many)):
            key = (n << 48) | rank
            at = np.searchsorted(keys, key, "right") - 1
            assert keys[at] >> 48 == n
            sequence, fit, offset = to[at].tolist()
            place = key - int(keys[at])
            made.setdefault(sequence + place // fit, []).append((offset + place % fit * n, n))
    for pieces in made.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= plan.capacity
    assert sorted(made) == list(range(plan.sequences))
    return made


@pytest.mark.parametrize("most", [1 << 20, 50])  # a store that is emptied again and again gives the same
def test_tokens_are_the_library_s(tokenizer, spark, sf_dir, monkeypatch, most):
    monkeypatch.setattr(packing, "WORDS", most)
    texts = [r.text for r in table(spark, sf_dir, "documents").collect()] + [t for _, t in ODD]
    words = packing.WordIds(open(FILE, "rb").read())
    for some in (texts[:100], texts[100:], texts[::-1]):
        ids, begin = packing.tokens(words, pa.array(some, pa.large_string()).fill_null(""))
        assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [whole(tokenizer, t) for t in some]


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_whole_and_near_the_least(seed):
    rng = random.Random(seed)
    capacity = rng.choice([64, 100, 256])
    kind = rng.choice(["any", "large", "small", "two", "half"])
    draw = {"any": lambda: rng.randint(1, capacity), "large": lambda: rng.randint(capacity // 4 + 1, capacity), "small": lambda: rng.randint(1, capacity // 8), "two": lambda: rng.choice([capacity // 3 + 1, capacity // 2 - 3]), "half": lambda: capacity // 2}[kind]
    lengths = [draw() for _ in range(rng.choice([1, 7, 300, 2000]))]
    counts = np.bincount(lengths, minlength=capacity + 1)
    made = spread(packing.best_plan(counts, capacity), counts)
    assert -(-sum(lengths) // capacity) <= len(made) <= max(first_fit(lengths, capacity) * 1.02 + 2, 1)


@pytest.mark.parametrize("seed", range(25))
def test_small_plans_against_the_optimum(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(2, 30) for _ in range(12)]
    counts = np.bincount(lengths, minlength=31)
    assert len(spread(packing.best_plan(counts, 30), counts)) <= fewest(lengths, 30) + 1


def test_patterns_meet_the_demand_with_the_least():
    sizes, demand = np.array([45, 36, 31, 14]), np.array([97, 610, 395, 211], float)  # a textbook case: 452.25 rolls of 100
    found = packing.patterns(sizes, demand, 100)
    assert np.allclose(sum(a * use for a, use in found), demand)
    assert all(a @ sizes <= 100 for a, _ in found)
    assert sum(use for _, use in found) == pytest.approx(452.25)


def test_many_pieces_need_no_more_ranges():
    rng = np.random.default_rng(0)
    counts = np.zeros(4097, np.int64)
    counts[1:] = rng.integers(0, 50, 4096)
    few, many = packing.Plan(counts), packing.Plan(counts * 10**6)
    assert len(many.rows) < 3 * len(few.rows)
    total = int((counts * np.arange(4097)).sum())
    assert many.sequences <= 1.02 * 10**6 * total / 4096


def check(rows, texts, tokenizer, capacity=4096):
    """Pieces of a packed table against whole token lists."""
    want = []
    for key, text in texts:
        ids = whole(tokenizer, text)
        for i in range(0, len(ids), capacity):
            part = np.array(ids[i : i + capacity], "<u4")
            want.append((str(key), i // capacity, i, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values(), default=0) <= capacity
    return len(ends)


def test_query_on_documents(spark, sf_dir, tokenizer):
    docs = table(spark, sf_dir, "documents")
    rows = packing.op13_packing(docs.repartition(7)).collect()
    used = check(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert used <= first_fit([r.length for r in rows], 4096) + 1


def test_odd_tables(spark, tokenizer):
    frame = spark.createDataFrame([(i, t, 9, "x") for i, t in ODD], "doc_id long, text string, piece int, offset string")
    check(packing.op13_packing(frame).collect(), ODD, tokenizer)
    assert packing.op13_packing(frame.where("false")).collect() == []
    same = spark.range(1).selectExpr("7L doc_id", "'one text of a few words' text").crossJoin(spark.range(5000).select())
    check(packing.op13_packing(same).collect(), [(7, "one text of a few words")] * 5000, tokenizer)


def test_sequences_hold_the_ids(spark, tokenizer):
    frame = spark.createDataFrame([(i, t) for i, t in ODD if i], "doc_id long, text string")
    pieces = packing.pack(packing.cut(frame, FILE, 100, with_ids=True), capacity=100)
    of = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    for r in pieces.collect():
        assert of[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids and r.offset in of[r.sequence_id].starts
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert all(len(s.ids) <= 100 for s in of.values())


def test_lengths_out_of_bounds_are_refused(spark):
    for bad in (0, 4097, None):
        with pytest.raises(ValueError, match="length"):
            packing.pack(spark.createDataFrame([(1, 5), (2, bad)], "doc_id long, length long"))
