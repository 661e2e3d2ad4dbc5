"""The ten operators against plain versions, planted cases, and nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import chat, decontam, langid, media, parity_join, quality, queries, samples, secrets, spm, textvec, toxicity, urlfilter
from strandline.session import table

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "123 !!"), (5, "x" * 200_000), (6, "straße ÉTÉ 日本語 😀"), (6, "straße ÉTÉ 日本語 😀"), (None, "no id here at all")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names clash with what operators make."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 7) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, score string, n int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def held(i, mod):
    return zlib.crc32(str(i).encode()) % mod


# --- shared hashing


def test_words_and_shingles():
    texts = ["A b  c\td", "", None, "x", "a B c d"]
    for a, b, buf, offs in textvec.chunks(pa.array(texts)):
        w = textvec.words(buf, offs)
        assert (a, b, w.counts.tolist()) == (0, 5, [4, 0, 0, 1, 4])
        assert w.h[:4].tolist() == w.h[5:].tolist()
        x, row = textvec.distinct(*textvec.shingles(w, 3))
        assert np.bincount(row, minlength=5).tolist() == [2, 0, 0, 1, 2]
    assert [x[:2] for x in textvec.chunks(pa.array(["abc"] * 5), 6)] == [(0, 2), (2, 4), (4, 5)]


def test_bounded_samples(spark):
    d = spark.range(10_000).select("id", (F.col("id") % 2).cast("string").alias("y"))
    n = {r.y: r["count"] for r in samples.bounded(d, "y", "id", 500).groupBy("y").count().collect()}
    assert all(400 < v < 600 for v in n.values())
    assert samples.bounded(d, "y", "id", 10**6).count() == 10_000


# --- 1 language


def test_kneser_ney_sums_to_one():
    codes, row = langid.letters(*_one("the cat sat on the mat and the rat ran to the hat"))
    keys, n = np.unique(langid.grams(codes, row), return_counts=True)
    m = langid.train({"x": langid.levels(keys, n)})
    for context in (keys[3] >> 12, keys[9] >> 12, 99999):
        p = 2.0 ** m.score((context << 12) + np.arange(4096)).astype(float)
        assert p.sum() == pytest.approx(1, abs=1e-3)


def test_kneser_ney_is_the_plain_one():
    """Probabilities of two languages against dictionaries and the textbook formula."""
    texts = {"a": "der hund und die katze und der rabe an der wand", "b": "the cat sat on the mat and the rat ran to the hat"}
    counts, plain = {}, {}
    for lang, text in texts.items():
        keys, n = np.unique(langid.grams(*langid.letters(*_one(text))), return_counts=True)
        counts[lang] = langid.levels(keys, n)
        orders = [dict(zip(keys.tolist(), n.tolist(), strict=True))]
        for k in range(langid.ORDER - 1, 0, -1):
            orders.insert(0, dict(collections.Counter(x & langid.MASK[k] for x in orders[0])))
        plain[lang] = orders

    def p(orders, key, n):
        if n == 0:
            return 1 / 4096
        seen = orders[n - 1]
        context = (key & langid.MASK[n]) >> 12
        of = {k: c for k, c in seen.items() if k >> 12 == context}
        n1, n2 = (sum(c == v for c in seen.values()) for v in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        if not of:
            return p(orders, key, n - 1)
        total = sum(of.values())
        return max(of.get(key & langid.MASK[n], 0) - d, 0) / total + d * len(of) / total * p(orders, key, n - 1)

    m = langid.train(counts)
    probes = langid.grams(*langid.letters(*_one("the hand und that katz zzz under")))
    got = m.score(probes)
    for i, lang in enumerate(m.langs):
        want = [math.log2(p(plain[lang], int(k), langid.ORDER)) for k in probes]
        assert np.allclose(got[:, i], want, atol=1e-3)


def test_letters_beyond_the_first_plane():
    for text, many in (("𐌰𐌱𐌲", 3), ("𝒜𝒷", 2), ("𠀀", 1), ("\U000e0041\U000f0000😀", 0), ("é1ß", 2)):
        codes, _ = langid.letters(*_one(text))
        assert (codes != langid.SPACE).sum() == many


def test_rare_grams_count_as_unseen(spark, docs):
    few = docs.where("lang is not null and text is not null")
    small, whole = langid.fit(few, most=2000), langid.fit(few)
    assert sum(len(x.order) for x in small.index[3:]) <= 2000 < len(whole.index[3].order)
    context = np.array([int(k) >> 12 for k in langid.grams(*langid.letters(*_one("the house and the")))])
    for c in context:
        p = 2.0 ** small.score((int(c) << 12) + np.arange(4096)).astype(float)
        assert np.allclose(p.sum(0), 1, atol=0.02)
    got = langid.predict(few, small).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)


def test_unseen_languages_are_rejected(spark):
    """Each language in turn is left out; most of its texts are told to be none of the others, and few known ones go."""
    d = table(spark, "/root/testdata/sf0.01", "documents").where("text is not null and lang is not null")
    for lang in [r.lang for r in d.select("lang").distinct().collect()]:
        model = langid.fit(d.where(F.col("lang") != lang))
        got = langid.predict(d.where(F.col("lang") == lang), model).where("n_chars > 100").agg(F.avg(F.col("rejected").cast("double"))).first()[0]
        known = langid.predict(d.where(F.col("lang") != lang), model).agg(F.avg(F.col("rejected").cast("double"))).first()[0]
        print(lang, got, known)
        assert got > 0.8 and known < 0.03


def _one(text):
    ((_, _, buf, offs),) = list(textvec.chunks(pa.array([text])))
    return buf, offs


def test_language_of_held_out(docs):
    got = langid.op1_langid(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 0.02 * len(got)


def test_language_odd_rows(docs, odd):
    model = langid.fit(docs)
    got = langid.predict(odd, model).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(ODD) and all(by[i][0].lang_pred == "und" and by[i][0].rejected for i in (1, 2, 3, 4))
    assert by[6][0][7:] == by[6][1][7:] and "lang" in got[0].asDict() and isinstance(got[0].score, float)
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(odd, model, only_known=True).columns == odd.columns
    assert langid.op1_langid(docs.limit(0)).count() == 0


# --- 2 and 3 classifiers


def _auc(rows, label):
    pos, neg = ([r.score for r in rows if r[label] == v] for v in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "labels")
    got = toxicity.op2_toxicity(table(spark, d, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    assert _auc(got, "toxic") > 0.95 and all(r.predicted == (r.score >= 0.5) for r in got)
    assert all((held(r.doc_id, 5) == 0) == r.held_out for r in got)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = table(spark, d, "labels")
    got = quality.op3_quality(table(spark, d, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    assert _auc(got, "quality") > 0.95 and all(r.predicted == (r.score >= 0.7) for r in got)


def test_machine_is_the_pairwise_sum():
    rng = np.random.default_rng(0)
    m = quality.Model(0.3, rng.normal(size=50), rng.normal(size=(50, 8)), None, None)
    index, value = np.array([3, 7, 9, 20]), rng.normal(size=4)
    want = 0.3 + (m.linear[index] * value).sum() + sum(m.factors[index[i]] @ m.factors[index[j]] * value[i] * value[j] for i, j in itertools.combinations(range(4), 2))
    assert quality.raw(index, value, np.zeros(4, int), 1, m)[0][0] == pytest.approx(want)


def test_ftrl_matches_plain():
    rng = random.Random(1)
    data = [(rng.randrange(2), np.array(sorted(rng.sample(range(16), 4)))) for _ in range(60)]
    a, beta, l1, l2 = 0.5, 1.0, 0.4, 0.1
    z, n, zb, nb = [0.0] * 16, [0.0] * 16, 0.0, 0.0
    w = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + n[i] ** 0.5) / a + l2)
    for _ in range(2):
        for y, at in data:
            b = -zb * a / (beta + nb**0.5)
            p = 1 / (1 + math.exp(-(sum(w(i) for i in at) + b)))
            for i in at:
                wi = w(i)
                z[i] += (p - y) - ((n[i] + (p - y) ** 2) ** 0.5 - n[i] ** 0.5) / a * wi
                n[i] += (p - y) ** 2
            zb += (p - y) - ((nb + (p - y) ** 2) ** 0.5 - nb**0.5) / a * b
            nb += (p - y) ** 2
    m = toxicity.ftrl(data, 4, a, beta, l1, l2, 2)
    assert m.weights == pytest.approx([w(i) for i in range(16)], abs=1e-6)


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_odd_rows(spark, odd, module, label):
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, None), (99, 1), (None, 1)], f"doc_id long, {label} int")
    model = module.fit(odd, labels)
    got = module.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    a, b = (r.score for r in got if r.doc_id == 6)
    assert a == b and {r.score for r in module.score(odd, None).collect()} == {0.0}
    assert module.fit(odd, labels.limit(0)) is None and module.score(odd.limit(0), model).count() == 0


# --- 4 chat


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|>"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, "system", "x"), (None, 0, "a", "b"), (3, None, None, "q")]
    turns = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, own string, start int")
    got = {(r.conv_id, r.perspective): r for r in chat.examples(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (3, "unknown")}
    r = got[1, "ann"]
    assert r.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [r.text[m.start : m.stop] for m in r.masks] == ["hi<|im_end|>\n", "<|im_end|>\n"]
    assert chat.segments(turns.limit(0)).count() == 0
    long = spark.range(2000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.repeat(F.lit("é"), F.col("id").cast("int") % 7).alias("text"))
    at = 0
    for s in chat.segments(long, 64).where("perspective = 'b'").orderBy("turn").collect():
        assert (s.start, s.stop) == (at, at + len(s.segment)) and (s.mask_start is not None) == (s.role == "b")
        at = s.stop


def test_chat_without_turn_numbers(spark):
    """Null and equal turns go by role and text; places stay whole however many there are."""
    rows = [(1, None, "a", f"t{i:04d}") for i in range(700)] + [(1, 5, "b", "late"), (1, 5, "b", "early"), (2, 1, "a", "x" * 200_000), (2, 2, "b", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for persp in ("a", "b"):
        at = 0
        for s in chat.segments(turns, 64).where(f"conv_id = 1 and perspective = '{persp}'").orderBy("start").collect():
            assert s.start == at
            at = s.stop
    texts = [s.segment for s in chat.segments(turns, 64).where("conv_id = 1 and perspective = 'b'").orderBy("start").collect()]
    assert "t0000" in texts[0] and "t0699" in texts[-3] and "early" in texts[-2] and "late" in texts[-1]
    assert max(s.stop for s in chat.segments(turns).where("conv_id = 2").collect()) > 200_000


# --- 5 URLs


def test_url_rules(spark):
    cases = {
        "http://EXAMPLE.org/es/x?q": ("example.org", "/es/x", "example.org/es/", "block"), "https://a.example.org/en/12#t": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"), "x://b.com/fr/1": ("b.com", "/fr/1", "com/fr/", "allow"), "x://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
        "http://notorg/x": ("notorg", "/x", None, None), "http://a.org": ("a.org", "", None, None), "http://a.org?x/y": ("a.org", "", None, None), "nothing/org/": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.op5_urlfilter(pages).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict or verdict is None and got[i].verdict in ("allow", "block")
    urls = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(urlfilter.LABELLED)], "page_id long, url string, y int")
    assert all((r.score > 0.5) == bool(r.y) for r in urlfilter.judge(urls, (), keep=("page_id", "y")).collect())
    assert urlfilter.op5_urlfilter(pages.limit(0)).count() == 0


# --- 6 decontamination


def _plain_tiles(item, doc, least):
    """Greedy string tiling by comparing every start with every other."""
    mi, md, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mi[i + n] and not md[j + n]:
                    n += 1
                if n > best[0] or n == best[0] and n and (i, j) < best[1:]:
                    best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        mi[i : i + n] = md[j : j + n] = [True] * n
        out.append((i, j, n))


def test_tiling_is_greedy_string_tiling(spark):
    rng = random.Random(4)
    item = [f"w{rng.randrange(12)}" for _ in range(30)]
    texts = []
    for k in range(40):
        parts = [item[a : a + rng.randrange(3, 12)] for a in rng.sample(range(25), 4)]
        texts.append((k, " ".join(sum(parts, [f"w{rng.randrange(12)}" for _ in range(rng.randrange(9))]))))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item), 1)], "item_id long, text string, doc_id int")
    got = {r.doc_id: r for r in decontam.contaminated(docs, bench, 4, 0.0001).collect()}
    for k, t in texts:
        want = _plain_tiles(item, t.split(), 4)
        assert (k in got) == bool(want)
        if want:
            assert sorted((x.item_start, x.doc_start, x.length) for x in got[k].tiles) == sorted(want)
            assert got[k].coverage == pytest.approx(sum(w[2] for w in want) / 30)
    other = decontam.contaminated(docs, bench, 4, 0.3, broadcast_bytes=0).collect()
    assert {(r.doc_id, round(r.coverage, 9)) for r in other} == {(r.doc_id, round(r.coverage, 9)) for r in got.values() if r.coverage >= 0.3}


def test_decontamination_paths_agree_on_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, long), (2, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "zz one two three four five six"), (7, "one two three four five six"), (7, "one two three four five six"), (7, long), (8, None)], "doc_id long, text string")
    small, large = (sorted((r.doc_id or 0, r.item_id, r.coverage, r.n_tiles) for r in decontam.contaminated(docs, bench, 3, 0.8, size).collect()) for size in (1 << 20, 0))
    assert small == large and len(small) == 7


def test_decontamination_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, "straße ÉTÉ 日本語 😀 no id"), (4, "one two three four five six")], "item_id long, text string")
    extra = spark.createDataFrame([(50, "Four, FIVE six! one two three", "en", "s", 0, "c", 1), (51, "zz one two three four five zz", "en", "s", 0, "c", 1)], odd.schema)
    every = odd.unionByName(extra)
    for size in (1 << 20, 0):
        got = decontam.contaminated(every, bench, 3, 0.8, size).collect()
        assert [(r.doc_id, r.item_id, r.n_tiles) for r in sorted(got)] == [(50, 4, 2), (51, 4, 1)]
    assert sorted(r.doc_id or 0 for r in decontam.clean(every, bench, least=3, coverage=0.8).collect()) == sorted(i or 0 for i, _ in ODD)
    assert decontam.contaminated(every, bench.limit(0)).count() == 0 and decontam.contaminated(every.limit(0), bench).count() == 0


def test_tiles_row_by_row_are_the_same(monkeypatch):
    rng = random.Random(9)
    for turn in range(60):
        words = "a" if turn % 3 == 0 else "abc"
        item, doc = ([rng.choice(words) for _ in range(rng.randrange(6, 40))] for _ in range(2))
        doc += ["q"] * 3 + doc[:7] + item[3:9]
        want = _plain_tiles(item, doc, 4)
        seeds = decontam.seeds_of([5], pa.array([" ".join(item)]), 4)
        ((_, _, x, _, place, _),) = list(decontam._windows(pa.array([" ".join(doc)]), 4))
        at = seeds.found.find(x)
        hit = np.flatnonzero(at >= 0)
        for most in (1 << 20, 0):
            monkeypatch.setattr(decontam, "PAIRS_AT_ONCE", most)
            got = [t for _, _, t in decontam._judge(x[hit], place[hit], at[hit], seeds, 4, 0.0001)] if len(hit) else []
            assert (got[0] if got else []) == want


def test_long_runs_of_one_word_are_tiled():
    seeds = decontam.seeds_of([1], pa.array(["la " * 3000]), 5)
    ((_, _, x, _, place, _),) = list(decontam._windows(pa.array(["la " * 20_000 + "end"]), 5))
    at = seeds.found.find(x)
    hit = np.flatnonzero(at >= 0)
    ((_, share, tiles),) = list(decontam._judge(x[hit], place[hit], at[hit], seeds, 5, 0.5))
    assert share == 1 and tiles == [(0, 0, 3000)]


def test_decontamination_takes_any_id(spark):
    text = "one two three four five six seven eight"
    for ids in (["a", "b"], [1.5, 2.5]):
        bench = spark.createDataFrame([(ids[0], text), (ids[1], "no words of it at all here")], f"item_id {'string' if ids[0] == 'a' else 'double'}, text string")
        docs = spark.createDataFrame([("x", "so: " + text), ("y", "else")], "doc_id string, text string")
        for size in (1 << 20, 0):
            assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, broadcast_bytes=size).collect()] == [("x", ids[0])]


# --- 7 secrets


def _plain_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets_against_plain(spark):
    rng = random.Random(6)
    bits = ["password", "PassWord", "token", "api_key", "apikey", "=", ": ", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP12", "deadbeefdeadbeef01", "short", "é😀", "secret=secret: abcdefghijklmno", "a1b2c3d4e5f6g7h8i9j0Z", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(14))), f"s{rng.randrange(5)}") for i in range(400)] + [(900, None, None), (901, "", "s1"), (901, "", "s1")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, spans string")
    got = collections.defaultdict(list)
    for r in secrets.op7_secrets(docs).collect():
        got[r.doc_id].append(r)
    for i, t, _ in rows:
        want = _plain_secrets(t or "")
        line = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        r = got[i][0]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3)), t
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("opaque")) == line
    assert len(got[901]) == 2 and secrets.op7_secrets(docs.limit(0)).count() == 0


def test_many_repositories_of_one_owner(spark):
    """A value that one owner has in very many repositories is a template; in few, it is a credential."""
    few, many = "Zx81q0W4pLmN7vB2tYe6", "Ab12Cd34Ef56Gh78Ij90"
    rows = [(i, f"a {many} b" + (f" {few}" if i < 3 else ""), "one") for i in range(secrets.EXAMPLE_REPOSITORIES + 1)] + [(900, "x" * 200_000 + f" {few} token={'z' * 50_000}", None)]
    got = {r.doc_id: r for r in secrets.op7_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].spans == f"opaque:{len(many) + 5}:{len(many) + 5 + len(few)}" and got[0].n_live == 1 and got[20].spans == ""
    assert (got[900].n_assign, got[900].n_live) == (1, 2) and got[900].spans.endswith("assign:200022:250028")


def test_ownership(spark):
    live, copied = "Zx81q0W4pLmN7vB2tYe6", "Ab12Cd34Ef56Gh78Ij90"
    rows = [(1, f"key {live} end", "a"), (1, f"key {live} end", "a")] + [(10 + i, f"use {copied} here password={'q' * 12}", f"s{i}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.op7_secrets(docs).collect()}
    assert got[1].spans == "opaque:4:24" and got[10].spans.startswith("assign:") and "opaque" not in got[10].spans and got[10].n_copied == 1
    out = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert out[1] == "key <opaque:live> end" and out[10] == f"use {copied} here <assign:example>"
    kept = secrets.redact(spark.createDataFrame([(1, None, "a", 3)], "doc_id long, text string, source string, n_chars long")).first()
    assert kept.text is None and kept.n_chars == 3


# --- 8 SentencePiece


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)


def test_encoding_is_the_librarys(spark, docs, odd, processor):
    few = docs.select("doc_id", "text").limit(60).unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(70, "  a  b\n The\tx ﬁ é "), (71, "a▁b"), (72, "\n\nx ")], "doc_id long, text string"))
    got = spm.encode(few, samples=3).collect()
    for r in got:
        want = processor.encode(r.text or "")
        assert r.ids == want and r.n_tokens == len(want) and r.round_trip == (processor.decode(want) == (r.text or ""))
        seen = [tuple(s.ids) for s in r.samples]
        assert len(set(seen)) == len(seen) and all(processor.decode(s.ids) == processor.decode(want) for s in r.samples)
        assert [s.perturbed for s in r.samples] == sorted((s.perturbed for s in r.samples), reverse=True) and all(0 < s.inclusion <= 1 or s.log_prob < -700 for s in r.samples)
    text = {(r.doc_id, tuple(r.ids)): r.text for r in got}
    for r in spm.decode(spm.encode(few, keep=["doc_id"])).collect():
        assert r.text == processor.decode(processor.encode(text[r.doc_id, tuple(r.ids)] or ""))
    again = {(r.doc_id, r.text): r.samples for r in spm.encode(few.repartition(7), samples=3).collect()}
    assert all([s.ids for s in again[r.doc_id, r.text]] == [s.ids for s in r.samples] for r in got)
    assert spm.encode(few.limit(0)).count() == 0


def test_samples_follow_the_law():
    """Ordered pairs drawn without replacement come as often as p_i p_j / (1 - p_i) says."""
    with open(spm.MODEL, "rb") as f:
        v = spm.Vocabulary(f.read())
    n, seen, p = 20_000, collections.Counter(), {}
    for a, b, buf, offs in textvec.chunks(pa.array(["théa ab"] * n)):
        for r in spm._samples(spm.Chunk(v, buf, offs, np.arange(a, b, dtype=np.uint64)), 2).to_pylist():
            seen[tuple(tuple(s["ids"]) for s in r)] += 1
            p |= {tuple(s["ids"]): math.exp(s["log_prob"]) for s in r}
    assert sum(p.values()) == pytest.approx(1, abs=1e-3)
    for (i, j), k in seen.most_common(6):
        want = p[i] * p[j] / (1 - p[i])
        assert abs(k / n - want) < 5 * math.sqrt(want / n)


def _segmentations(v, unit):
    """Every segmentation of a text of known characters, with its log weight."""
    piece = {v.sp.id_to_piece(int(i)): float(w) for i, w in zip(v.ids, v.weight, strict=True)}
    unit = unit.replace(" ", "▁")

    def rest(at):
        if at == len(unit):
            yield (), 0.0
        for end in range(at + 1, min(len(unit), at + spm.REACH) + 1):
            if unit[at:end] in piece:
                for tail, w in rest(end):
                    yield (unit[at:end], *tail), piece[unit[at:end]] + w

    return dict(rest(0))


@pytest.mark.parametrize("text", ["the cat", "of, to", "a", "été 12"])
def test_samples_are_those_of_the_enumerated_lattice(text):
    with open(spm.MODEL, "rb") as f:
        v = spm.Vocabulary(f.read())
    every = _segmentations(v, " " + text)
    total = np.logaddexp.reduce(list(every.values()))
    k = min(len(every), 40) + 1
    keys = np.arange(3, dtype=np.uint64)
    ((_, _, buf, offs),) = list(textvec.chunks(pa.array([text] * 3)))
    for rows in spm._samples(spm.Chunk(v, buf, offs, keys), k).to_pylist():
        seen = [tuple(v.sp.id_to_piece(i) for i in s["ids"]) for s in rows]
        assert len(seen) == min(k, len(every)) == len(set(seen))
        for s, pieces in zip(rows, seen, strict=True):
            assert s["log_prob"] == pytest.approx(every[pieces] - total, abs=1e-4)
        if k > len(every):
            assert sum(math.exp(s["log_prob"]) for s in rows) == pytest.approx(1, abs=1e-4)
            assert all(s["inclusion"] == 1 for s in rows)


def test_inclusion_scores_weigh_samples_without_bias():
    """Sums over k samples of f / inclusion estimate the sum of p f: here the share of one-piece words."""
    with open(spm.MODEL, "rb") as f:
        v = spm.Vocabulary(f.read())
    n, text = 4000, "the cat"
    every = _segmentations(v, " " + text)
    total = np.logaddexp.reduce(list(every.values()))
    want = sum(math.exp(w - total) * len(p) for p, w in every.items())
    ((_, _, buf, offs),) = list(textvec.chunks(pa.array([text] * n)))
    got = [sum(math.exp(s["log_prob"]) / s["inclusion"] * len(s["ids"]) for s in r) for r in spm._samples(spm.Chunk(v, buf, offs, np.arange(n, dtype=np.uint64)), 3).to_pylist()]
    assert abs(np.mean(got) - want) < 5 * np.std(got) / math.sqrt(n)


def test_store_of_units_is_bounded(monkeypatch):
    monkeypatch.setattr(spm, "UNITS", 40)
    with open(spm.MODEL, "rb") as f:
        v = spm.Vocabulary(f.read())
    words = ["alpha beta", "gamma 12, delta", "日本語 x▁y"] + [f"w{i}q{i * 7919 % 97} zz{i}" for i in range(60)]
    for turn in range(2):
        for w in words:
            ((_, _, buf, offs),) = list(textvec.chunks(pa.array([w])))
            c = spm.Chunk(v, buf, offs, np.zeros(1, np.uint64))
            assert c.fixed()[0].tolist() == v.sp.encode(w)
            assert all(v.sp.decode(s["ids"]) == w.replace("▁", " ") for s in spm._samples(c, 2).to_pylist()[0])
    assert v.uses.n < 60


# --- 9 Matroska


def test_matroska_round_trip():
    for size, how in itertools.product((0, 1, 575, 576, 577, 5000, 300_000), ("none", "xiph", "fixed", "ebml")):
        samples_ = os.urandom(size) + b"\xff" * (max(576, -(-size // 576) * 576) - size)
        stored = media.mux(samples_, how=how)
        m = media.parse(stored)
        assert media.read_back(stored, m) == samples_ and m.tracks[0]["rate"] == 8000
        assert [p[1] for p in m.packets] == [72 * k for k in range(len(m.packets))]
        assert all(stored[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in m.cues) and len(m.cues) == m.clusters
    frames = [os.urandom(k) for k in (3, 600, 10, 255, 254, 511, 1)]
    for how in ("xiph", "ebml"):
        flags, body = media.lace(frames, how)
        assert [body[a : a + n] for a, n in media._frames(body, 0, len(body), flags >> 1 & 3)] == frames
    for cut in range(0, 3000, 11):
        media.parse(stored[:cut])
    assert media.parse(None).packets == [] and media.parse(b"RIFFxxxx").packets == []


def test_unknown_sizes_and_groups():
    block = media.element(media.GROUP, media.element(media.BLOCK, b"\x81\x00\x05\x00abc") + media.number(media.REFERENCE, 1))
    cluster = media._id(media.CLUSTER) + b"\xff" + media.number(media.TIMESTAMP, 100) + block
    data = media.element(media.EBML, b"") + media._id(media.SEGMENT) + b"\x01" + b"\xff" * 7 + media.element(media.TRACKS, media.element(media.TRACK, media.number(media.NUMBER, 1))) + cluster
    m = media.parse(data)
    assert [(p[0], p[1], data[p[2] : p[2] + p[3]], p[4]) for p in m.packets] == [(1, 105, b"abc", False)]


def test_media_digest(spark, odd):
    got = {(r.doc_id): r for r in media.op9_media(odd).collect()}
    for i, t in ODD:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    files = media.with_media(odd)
    packets = media.packet_table(files).where("doc_id = 5").count()
    assert packets == -(-200_000 // 576) and media.op9_media(odd.limit(0)).count() == 0
    assert hashlib.sha256(files.where("doc_id = 5").first().media).hexdigest() == got[5].media_sha256


# --- 10 near copies


def _plain_components(rows, n, percent):
    sets, part = {}, {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])
        part[i] = i

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
            k = len(x & y)
            if 100 * k >= percent * (len(x) + len(y) - k):
                p, q = sorted((find(a), find(b)))
                part[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def _near(seed):
    """Groups of copies with edits about the bound, chains, short texts, exact copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(60)}"
    out = ["", None, " ", "A b", "a  B", "a b c", "one", "ONE"]
    passage = [word() for _ in range(60)]
    for size in (6, 14, 40, 90, 250):
        base = [word() for _ in range(size)]
        out.append(" ".join(base))
        for _ in range(14):
            copy = list(base) if rng.random() < 0.7 else out[-1].split()
            for _ in range(rng.randrange(0, max(2, size // 25))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[: len(copy) - rng.randrange(1, max(2, len(copy) // 15))]
            out.append(" ".join(copy))
    out += [" ".join(passage + [word() for _ in range(rng.randrange(1, 40))]) for _ in range(25)]
    out += [out[20]] * 5
    return list(enumerate(out))


@pytest.mark.parametrize("n,percent,seed", [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_components_against_plain(spark, n, percent, seed):
    rows = _near(seed)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_shingles string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.components(docs, n, percent).collect()}
    assert got == _plain_components(rows, n, percent)


def test_links_against_plain(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 3)
    monkeypatch.setattr(parity_join, "SHARD", 200)
    rows = _near(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, members = parity_join.links(docs, 3, 90)
    of = {}
    for r in members.collect():
        of.setdefault(r.sid, []).append(r.doc_id)
    got = {frozenset((min(of[r.x]), min(of[r.y]))) for r in found.collect()}
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        if w:
            sets.setdefault(frozenset([tuple(w)] if len(w) < 3 else [tuple(w[k : k + 3]) for k in range(len(w) - 2)]), i)
    want = {frozenset((i, j)) for (a, i), (b, j) in itertools.combinations(sets.items(), 2) if 100 * len(a & b) >= 90 * len(a | b)}
    assert got == want and len(want) > 10 and sum(map(len, of.values())) == sum(bool((t or "").split()) for _, t in rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.components(docs, 3, 90).collect()}
    assert got == _plain_components(rows, 3, 90)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for size in (5, 30, 200, 900):
        for percent in (60, 80, 90):
            a = np.sort(rng.choice(pool, size, replace=False))
            most = int(parity_join.most_apart(size, size, percent)) // 2
            b = np.sort(np.concatenate([a[most:], rng.integers(0, 2**62, most).astype(np.uint64)]))
            x, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            keys, row = parity_join.cell_keys(x, at, percent)
            both = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            if both * 100 >= percent and most:
                assert set(keys[row == 0].tolist()) & set(keys[row == 1].tolist())
            bits = parity_join.bit_sketch(x, at).view(np.uint64)
            assert sum(int(v).bit_count() for v in bits[0] ^ bits[1]) <= len(np.setxor1d(a, b))


def test_near_copies_odd_rows(spark, odd):
    got = parity_join.op10_parity_join(odd).collect()
    assert len(got) == len(ODD) and sorted(r.component_id for r in got if r.doc_id == 6) == [6, 6]
    assert [r.component_id for r in got if r.doc_id in (1, 2, 3)] == [r.doc_id for r in got if r.doc_id in (1, 2, 3)]
    kept = parity_join.distinct_documents(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert parity_join.op10_parity_join(odd.limit(0)).count() == 0


# --- queries and pipeline


def test_sql_of_queries(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "conversations", "sale_lines"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf_dir).toPandas()
        want = con.sql(sql).df()[list(got.columns)]
        show = lambda f: sorted(tuple("" if pd.isna(x) else str(int(x) if isinstance(x, float) else x) for x in r) for r in f.itertuples(index=False))
        assert show(got) == show(want), name


def test_pipeline_against_plain(spark, sf_dir):
    import corpus_pipeline

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    known = {r.doc_id for r in langid.predict(table(spark, sf_dir, "documents"), langid.fit(table(spark, sf_dir, "documents"))).where("not rejected").collect()}
    kept = {i: t for i, t in rows if i in known}
    part = _plain_components(kept.items(), 5, 80)
    kept = {i: t for i, t in kept.items() if part[i][1] == i}
    items = [[w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", r.text.lower()) if w] for r in table(spark, sf_dir, "benchmark").collect()]
    for i, t in list(kept.items()):
        w = [x for x in re.split(r"[^0-9a-z\x80-\U0010ffff]+", t.lower()) if x]
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for item in items:
            if any(tuple(item[k : k + 5]) in grams for k in range(len(item) - 4)) and sum(x[2] for x in _plain_tiles(item, w, 5)) >= 0.5 * len(item):
                kept.pop(i, None)
    assert set(got) == set(kept)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    for i, t in kept.items():
        if not _plain_secrets(t) and "opaque" not in sp.decode(got[i].ids):
            assert got[i].ids == sp.encode(t)
        assert not _plain_secrets(sp.decode(got[i].ids))
    first = known and corpus_pipeline.STAGES[0][1](spark, table(spark, sf_dir, "documents").limit(0), sf_dir)
    assert first.count() == 0 and len(corpus_pipeline.STAGES) == 5


def test_only_this_subpackage_knows_itself():
    root = os.path.join(os.path.dirname(__file__), "..", "..", "strandline")
    for d, _, names in os.walk(root):
        if "llm" not in os.path.relpath(d, root).split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(d, name), encoding="utf-8") as f:
                        assert not re.search(r"\bllm\b", f.read()), name


def test_pipeline_over_odd_tables(spark, sf_dir, tmp_path):
    """Nulls, empty and long texts, repeated and missing ids, clashing columns, and an empty benchmark."""
    import corpus_pipeline

    some = table(spark, sf_dir, "documents").limit(60)
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, samples int, score string, n int, _row int"
    rows = [(i, t, None if (i or 0) % 2 else "en", None if i == 3 else "s", None, "clash", 1, "clash", 7, 1) for i, t in ODD]
    long = some.first().text
    rows += [(500, (long + " ") * (200_000 // len(long) + 1), "en", "s", 1, "x", 1, "x", 1, 1), (500, "again the same id with other words in it", "en", "s", 1, "x", 1, "x", 1, 1)]
    more = some.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("ids", "string"), ("samples", "int"), ("score", "string"), ("n", "int"), ("_row", "int"))])
    spark.createDataFrame(rows, schema).unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf_dir, "benchmark").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {r.doc_id for r in got} <= {r.doc_id for r in some.collect()} | {500, None, 5, 6}
    assert all(r.n_tokens == len(r.ids) and r.samples for r in got)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/documents.parquet")
    table(spark, sf_dir, "benchmark").write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
