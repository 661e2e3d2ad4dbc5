"""Operator 12 against plain search for runs, plain suffix arrays, and odd tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import runs, textvec
from strandline.session import table


def plain(w):
    """All runs: maximal stretches of each period, kept where no smaller period fits the whole stretch."""
    n, found = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            e = i
            while e + p < n and w[e] == w[e + p]:
                e += 1
            length = e + p - i
            if length >= max(6, 4 * p) and not any(all(w[k] == w[k + q] for k in range(i, e + p - q)) for q in range(1, p)):
                found.append((i, length, p))
            i = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def answer(doc_id, text):
    """The contract's row, written plainly."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain(w)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *top, sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def coded(texts):
    ids = {}
    word = np.array([ids.setdefault(x, len(ids)) for t in texts for x in t], np.int64)
    return word, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


@pytest.mark.parametrize("seed", range(6))
def test_find_is_the_plain_search(seed, monkeypatch):
    monkeypatch.setattr(runs, "GRID", 50 if seed % 2 else 1 << 20)  # grids in slices give the same
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        t = [rng.choice("ab" if rng.random() < 0.5 else "abcd") for _ in range(rng.randrange(70))]
        for _ in range(rng.randrange(3)):  # planted repeats, some of them of repeats
            at, unit = rng.randrange(len(t) + 1), [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
            t[at:at] = (unit * rng.randrange(2, 9))[: rng.randrange(1, 50)]
        texts.append(t)
    texts += [["a"] * 40, ["a"] * 5, ["a"] * 6, list("abababab"), list("abababa"), [], list("aab" * 9 + "aab" * 2), texts[0]]
    word, ptr = coded(texts)
    got = [[] for _ in texts]
    for r, s, n, p in zip(*runs.find(word, ptr), strict=True):
        got[r].append((s, n, p))
    assert got == [plain(t) for t in texts]


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    for n, letters in ((30, 1), (200, 2), (500, 3), (300, 200)):
        keys = np.concatenate([[0], 2 + rng.integers(0, letters, n), [1]])
        s = runs.Suffixes(keys)
        text = keys.tolist()
        assert np.argsort(s.rank).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        x, y = rng.integers(1, n, 300), rng.integers(1, n, 300)
        x, y = x[x != y], y[x != y]
        want = [next(k for k in range(n + 2) if a + k > n or b + k > n or text[a + k] != text[b + k]) for a, b in zip(x, y, strict=True)]
        assert s.common(x, y).tolist() == want


def test_range_minima():
    v = np.random.default_rng(1).integers(0, 1000, 1777).astype(np.int32)
    r = runs.RangeMin(v)
    lo = np.random.default_rng(2).integers(0, len(v), 4000)
    hi = np.minimum(lo + np.random.default_rng(3).integers(0, 1800, 4000), len(v) - 1)
    assert r(lo, hi).tolist() == [int(v[a : b + 1].min()) for a, b in zip(lo, hi, strict=True)]


def test_words_are_runs_of_other_bytes():
    texts = ["a b\tc\n\x0b\x0c\rd", "", " \t ", None, "\x1ca\x1d b c 　", " x"]
    word, names, ptr = textvec.split(pa.array(texts, pa.large_string()).fill_null(""))
    got = [[names[int(i)].as_py() for i in word[a:b]] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_query_on_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in runs.op12_runs(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if len(r.text or "") < 30_000:  # the plain search is cubic
            assert got[r.doc_id] == answer(r.doc_id, r.text)
    assert sum(g[1] > 0 for g in got.values()) > 5


def test_odd_tables(spark):
    planted = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "x y " * 9), (4, "w " * 5000 + "end"), (planted, " ".join(map(str, range(400)))), (planted, " ".join(map(str, range(400)))), (5, "é日本 😀 " * 4), (106, "A a A a A a A a")]
    frame = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, runs string, start int")
    order = lambda t: (t[0] is None, t[0] or 0)
    assert sorted((tuple(r) for r in runs.op12_runs(frame).collect()), key=order) == sorted((answer(i, t) for i, t in rows), key=order)
    assert runs.op12_runs(frame.where("false")).collect() == []
    kept = runs.periodic_runs(frame.where("doc_id = 106"), keep=("doc_id", "runs", "start")).collect()
    assert [r.asDict(True) for r in kept] == [{"doc_id": 106, "start": 3, "runs": [{"start": 0, "length": 8, "period": 2}], "collapsed": "A a"}]
