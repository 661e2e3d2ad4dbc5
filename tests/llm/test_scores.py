"""Scores of operators 2 and 3 against plain words, bins, statistics and sums."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import quality, textvec, toxicity

M = (1 << 64) - 1
TEXTS = ["You fool, you FOOL you", "", None, "a", "a b", "É été straße 12-34 don't", "kind words and kind words again", "x " * 300, "日本語 mixed ascii"]


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def plain_bins(text, bits):
    """Distinct bins of unigrams, bigrams and skip-grams, word by word."""
    data, words, now = (text or "").lower().encode(), [], b""
    for byte in [*data, 32]:
        if byte >= 128 or chr(byte).isalnum():
            now += bytes([byte])
        elif now:
            words.append(now)
            now = b""
    h = [mix((sum((b + 1) * pow(textvec._R, i, 1 << 64) for i, b in enumerate(w)) + len(w)) & M) for w in words]
    out = {x >> (64 - bits) for x in h}
    for gap, salt in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        out |= {mix((a * salt + b) & M) >> (64 - bits) for a, b in zip(h, h[gap:], strict=False)}
    return out


def test_toxicity_scores_are_plain_sums(spark):
    weights = np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32)
    weights[np.random.default_rng(2).random(len(weights)) < 0.5] = 0
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")
    got = {r.doc_id: r.score for r in toxicity.score(frame, toxicity.Model(weights, -0.3)).collect()}
    for i, t in enumerate(TEXTS):
        total = sum(float(weights[b]) for b in plain_bins(t, toxicity.BITS)) - 0.3
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), rel=1e-6)


def test_toxicity_is_learnt_from_words_and_their_order(spark):
    """Two classes told apart by a bigram alone."""
    rows = [(i, "one kind fool here" if i % 2 else "one fool kind here", i % 2) for i in range(400)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id int, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got)


def word_hash(w):
    return mix((sum((b + 1) * pow(textvec._R, i, 1 << 64) for i, b in enumerate(w)) + len(w)) & M)


def plain_inputs(text):
    """(values by bin, statistics, buckets) of one text, counted one by one."""
    data = (text or "").encode()
    share = lambda test: sum(map(test, data)) / max(len(data), 1)
    upper, digit, space = (lambda b: 65 <= b <= 90), (lambda b: 48 <= b <= 57), (lambda b: b == 32 or 9 <= b <= 13)
    alpha = lambda b: b >= 128 or 65 <= b <= 90 or 97 <= b <= 122
    mark = lambda b: not (alpha(b) or digit(b) or space(b))
    spans = [m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", data)]
    words = [data[a:b].lower() for a, b in spans]
    n = max(len(words), 1)
    count = collections.Counter(words)
    threes = {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 0))} or ({tuple(words)} if words else set())
    lines = data.count(10)
    second = lambda a: upper(data[a + 1]) if a + 1 < len(data) else upper(data[-1])
    stats = [
        share(upper), share(alpha), share(digit), share(space), share(mark), sum(map(len, words)) / n, sum(len(w) > 20 for w in words) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(second(a) for a, _ in spans) / n, sum(mark(data[b - 1]) for _, b in spans) / n, len(count) / n, max(count.values(), default=0) / n, len(threes) / max(len(words) - 2, 1), math.log1p(len(words)), lines / n, math.log1p(len(data)),
    ]
    values = collections.Counter()
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in count.values())) or 1
    for w, c in count.items():
        values[word_hash(w) >> (64 - quality.BITS)] += math.log1p(c) / norm
    buckets = [min(int(math.log2(x + 1)), quality.BUCKETS - 1) + i * quality.BUCKETS for i, x in enumerate((len(data), len(words), lines))]
    return values, stats, buckets


ROWS = ["Plain text, with Words.\nAnd lines\n", "", None, "AB CD ab cd ab", "a a a b! (x) 12 3.4", "é É straße 日本 Ünï", " \t\n", "w" * 30 + " end", "one two three one two three one two three"]


def test_quality_inputs_are_plain_counts():
    column = pa.array(ROWS)
    for _, _, buf, offs in textvec.chunks(column):
        bins, value, own, stats, meta = quality.inputs(buf, offs)
        for i, text in enumerate(ROWS):
            values, want, buckets = plain_inputs(text)
            got = collections.Counter()
            for b, v in zip(bins[own == i].tolist(), value[own == i].tolist(), strict=True):
                got[b] += v
            assert got.keys() == values.keys() and all(got[k] == pytest.approx(values[k]) for k in got), text
            assert stats[i] == pytest.approx(want), text
            assert meta[i].tolist() == buckets


def test_quality_scores_are_plain_pair_sums(spark):
    rng = np.random.default_rng(3)
    size = (1 << quality.BITS) + quality.STATS + 3 * quality.BUCKETS
    m = quality.Model(0.2, rng.normal(size=size).astype(np.float32) * 0.3, rng.normal(size=(size, quality.RANK)).astype(np.float32) * 0.1, rng.random(quality.STATS), rng.random(quality.STATS) + 0.5)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ROWS)], "doc_id int, text string")
    got = {r.doc_id: r.score for r in quality.score(frame, m).collect()}
    for i, text in enumerate(ROWS):
        values, stats, buckets = plain_inputs(text)
        x = [*values.items(), *(((1 << quality.BITS) + j, max(-5, min(5, (s - m.mean[j]) / m.scale[j])) / 2) for j, s in enumerate(stats)), *(((1 << quality.BITS) + quality.STATS + b, 0.5) for b in buckets)]
        total = m.bias + sum(float(m.linear[j]) * v for j, v in x)
        total += sum(float(m.factors[a].astype(float) @ m.factors[b]) * v * w for p, (a, v) in enumerate(x) for b, w in x[p + 1 :])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-4), text
