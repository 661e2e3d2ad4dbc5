"""The segmenter in columns against plain loops over regular expressions."""

import random
import re

import pytest

from strandline.operators import extract, segment

SHORT = re.compile(r"(?:e\.g\.|i\.e\.|et al\.|fig\.|dr\.)$")
PARTS = ["one two", "Label", "label here", " e.g. ", "i.e. ", "Fig. ", "; ", ". ", "! ", ".\n", "\n\n", " 3.5 ", "A", "Big ", "é日😀 ", "et al. ", "  ", "?", "\t", "word " * 30]


def texts(seed, n):
    rng = random.Random(seed)
    return ["", " ", "label", "...", "No. 5 is. e.g. this", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(n))]


def plain_focus(text, label, words):
    at = text.lower().find(label.lower())
    if at < 0:
        return -1, None, None, None
    stop, cuts = at + len(label), [0]
    for d in re.finditer(r";\s+|[.!?]\s+(?=[A-Z])|\n+", text):
        if SHORT.search(text[max(0, d.start() - 8) : d.start() + 1].lower()) or (at < d.end() and d.start() < stop):
            continue
        cuts.append(d.end())
    cuts.append(len(text))
    a, b = max(c for c in cuts if c <= at), min(c for c in cuts if c >= stop)
    own = text[a:b]
    a, b = a + len(own) - len(own.lstrip()), b - (len(own) - len(own.rstrip()))
    if len(text[a:b].split()) <= words:
        return at, a, b, "source_sentence_or_semicolon_clause"
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    first = next(i for i, w in enumerate(spans) if w[1] > at)
    last = max(i for i, w in enumerate(spans) if w[0] < stop)
    begin = max(0, min(first - 20, len(spans) - words))
    begin = last - words + 1 if last >= begin + words else begin
    return at, spans[begin][0], spans[min(len(spans), begin + words) - 1][1], "long_clause_existing_80_word_window"


@pytest.mark.parametrize("words", [80, 25])
def test_focused_is_the_plain_one(spark, words):
    rows = [(i, t, random.Random(i).choice(["label", "Label here", "one", "missing", "word Big"])) for i, t in enumerate(texts(5, 250))]
    got = segment.focused(spark.createDataFrame(rows, "i int, t string, w string"), "t", "w", words).collect()
    assert {r.i: (r["at"], r.start, r.stop, r.method) for r in got} == {i: plain_focus(t, w, words) for i, t, w in rows}
    methods = {r.method for r in got}
    assert len(methods) == 3


def test_sentences_are_the_plain_ones(spark):
    rows = [(i, t) for i, t in enumerate([*texts(6, 250), None, "a. " * 3000])]
    got = {}
    for r in extract.sentences(spark.createDataFrame(rows, "i int, t string"), "i", "t").orderBy("i", "sentence_id").collect():
        assert r.sentence == dict(rows)[r.i][r.start : r.stop]
        got.setdefault(r.i, []).append((r.start, r.stop))
    assert got == {i: s for i, t in rows if t and (s := extract.sentence_spans_of(t))}


def test_matches_and_running_sums(spark):
    rows = [(i, t) for i, t in enumerate(texts(7, 80) + ["ab " * 1000])]
    got = {r.i: [tuple(x) for x in r.m] for r in segment.matches(spark.createDataFrame(rows, "i int, t string"), "t", segment.WORD, "m").collect()}
    assert got == {i: [m.span() for m in re.finditer(r"\S+", t)] for i, t in rows}
