"""Concepts, predicates and relations from whole texts, with exact spans; sentence pairs and their banks.

A document is the unit: what is found in it depends on its own text, a lexicon and
nothing else.  Counts over documents, scores and banks are aggregates.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.text import stable_id
from .extract import sentence_spans_of, sentences
from .grams import dealt

TOKEN = re.compile(r"[^\W_]+(?:[-/:][^\W_]+)*[+\-]*")
#: Marks that end a phrase.
PARTED = re.compile(r"[,;:.!?()]")
DASHES = str.maketrans("–—−", "---")
#: Greek letters as words, the score of each category, and which category a relation's end prefers.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "Δ": "delta"}
PRIORITY = {"mechanism_or_process": 4.0, "material_or_structure": 3.8, "outcome_or_property": 3.0, "literal_formula": 2.8, "untyped_extractive_keyword": 2.6, "evidence_method": 2.0, "device_or_context": 1.5}
#: Words that a worker remembers, and documents whose concepts are handed on at once.
REMEMBERED, DOCUMENTS = 200_000, 64
END_ORDER = {"mechanism_or_process": 4, "outcome_or_property": 3, "material_or_structure": 2, "literal_formula": 1}


@dataclass(frozen=True)
class Lexicon:
    """What makes a concept: patterns of head words with their category, words that end a phrase, heads that stand alone, plurals, and formulae that are none."""

    heads: tuple[tuple[str, str], ...]
    boundary: frozenset[str] = frozenset()
    alone: frozenset[str] = frozenset()
    plurals: tuple[tuple[str, str], ...] = ()
    blocked: frozenset[str] = frozenset()
    predicates: tuple[tuple[str, str], ...] = ()
    unit: str = r"(?:k|m|μ|n)?(?:[gmsVAWKJN]|mol|eV)(?:\d)?"
    _found: dict = field(default_factory=dict, compare=False, hash=False)
    _words: dict = field(default_factory=dict, compare=False, hash=False)
    _held: dict = field(default_factory=dict, compare=False, hash=False)

    def category(self, head: str) -> str | None:
        if head not in self._found:
            if len(self._found) >= REMEMBERED:
                self._found.clear()
            self._found[head] = next((c for p, c in self.heads if re.fullmatch(p, head)), None)
        return self._found[head]

    def plain_word(self, surface: str) -> tuple[str, str, str | None, bool, bool, bool] | None:
        """What `word` says of a word of Latin letters alone, which has no parts: it is most often asked.  None for others, and for those that may be formulae."""
        if not surface.isalpha() or max(surface) >= "\u0370" or not (surface[1:].islower() or len(surface) == 1):
            return None
        if not self._held:
            self._held.update(plurals=dict(self.plurals), unit=re.compile(self.unit).fullmatch, heads=[(re.compile(p).fullmatch, c) for p, c in self.heads])
        held, label = self._held, surface.casefold()
        if label in held["plurals"]:
            return None
        return label, label, next((c for fits, c in held["heads"] if fits(label)), None), label in self.boundary or bool(held["unit"](label)), False, False

    def word(self, surface: str) -> tuple[str, str, str | None, bool, bool, bool]:
        """(label, head, category, whether it ends a phrase, hyphenated keyword, formula) of a word, which depend on nothing else and are remembered."""
        found = self._words.get(surface)
        if found is None:
            if len(self._words) >= REMEMBERED:
                self._words.clear()
            found = self._words[surface] = self.plain_word(surface)
        if found is None:
            label = normal_label(surface, self.plurals)[0]
            head, stops = head_of(label), _stops(label, self)
            keyword = "-" in surface and bool(re.fullmatch(r"[^\W\d_]{3,}(?:-[^\W\d_]{3,})+", surface)) and not any(p.isupper() for p in surface.split("-")) and not stops
            formula = formula_like(surface) and surface.upper().strip("+-") not in self.blocked
            found = self._words[surface] = (label, head, self.category(head), stops, keyword, formula)
        return found


def normal_label(surface: str, plurals: Sequence[tuple[str, str]] = ()) -> tuple[str, tuple[str, ...]]:
    """(label, what was done to it): one kind of dash, Greek as words, lower case, no hyphens within, no brackets, singular."""
    steps, x = [], " ".join(surface.split())

    def change(name: str, to: str) -> None:
        nonlocal x
        if to != x and name not in steps:
            steps.append(name)
        x = to

    change("unicode_dash_to_ascii", x.translate(DASHES))
    for letter, name in GREEK.items():
        change("greek_transliteration", x.replace(letter, name))
    change("lowercase", x.casefold())
    change("hyphen_to_space", re.sub(r"(?<=\w)-(?=\w)", " ", x))
    x = re.sub(r"\s+", " ", re.sub(r"[(),;:]", " ", x)).strip(" .")
    one = dict(plurals)
    change("simple_plural_to_singular", " ".join(one.get(w, w) for w in x.split()))
    return x, tuple(steps) or ("identity",)


def formula_like(surface: str) -> bool:
    """A chemical formula: letters with digits, or element symbols in a row; plain abbreviations are none."""
    x = "".join(surface.split())
    if re.search(r"[A-Za-z]+\d[+\-/A-Za-z0-9()]*", x):
        return True
    return not re.fullmatch(r"[A-Z]{2,8}(?::[A-Z]{2,8})?", x) and bool(re.fullmatch(r"(?:[A-Z][a-z]?\d*){2,}[+\-]*", x))


def head_of(label: str) -> str:
    return re.split(r"[-/ :]", label.casefold())[-1]


def _stops(label: str, lexicon: Lexicon) -> bool:
    """Whether a word cannot modify a head."""
    return not label or not lexicon.boundary.isdisjoint(label.split()) or bool(re.fullmatch(lexicon.unit, label)) or bool(re.fullmatch(r"\d+(?:\.\d+)?", label))


def concepts_of(text: str, lexicon: Lexicon) -> Iterator[tuple]:
    """(sentence, start, stop, surface, label, category, head, how) of every concept of a text."""
    for n, (a, b) in enumerate(sentence_spans_of(text)):
        yield from _concepts_within(text, n, a, b, lexicon)


def _concepts_within(text: str, n: int, a: int, b: int, lexicon: Lexicon) -> Iterator[tuple]:
    """The concepts of the sentence n at a..b."""
    known, learn = lexicon._words.get, lexicon.word
    words = list(TOKEN.finditer(text, a, b))
    for i, m in enumerate(words):
        surface = m[0]
        label, head, category, _, keyword, formula = known(surface) or learn(surface)
        if not (category or keyword or formula):
            continue
        start, stop = m.span()
        bare = (start == 0 or text[start - 1] != "(") and text[stop : stop + 1] != ")"
        if category:
            first, labels, spaced = i, [label], True
            while first > max(0, i - 3):
                before = words[first - 1]
                gap = text[before.end() : words[first].start()]
                if gap != " " and PARTED.search(gap):
                    break
                one = known(before[0]) or learn(before[0])
                if one[3]:
                    break
                spaced = spaced and (gap == " " or gap.isspace())
                labels.append(one[0])
                first -= 1
            phrase = text[words[first].start() : stop]
            # words that white space alone parts are normal one by one
            name = " ".join(reversed(labels)) if spaced else normal_label(phrase, lexicon.plurals)[0]
            if name and (" " in name or name in lexicon.alone):
                yield n, words[first].start(), stop, phrase, name, category, head, "head_noun_phrase"
        elif keyword and bare:
            yield n, start, stop, surface, label, "untyped_extractive_keyword", head, "generic_hyphenated_keyword"
        if bare and formula:
            yield n, start, stop, surface, label, "literal_formula", label, "literal_formula"


def candidates(docs: DataFrame, key: str, text: str, lexicon: Lexicon) -> DataFrame:
    """(key, sentence_id, start, stop, surface, label, category, head, pattern) of every concept of every whole text; null and empty texts give none."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "sentence_id", "start", "stop", "surface", "label", "category", "head", "pattern"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), DOCUMENTS):
                part = f.iloc[i : i + DOCUMENTS]
                yield pd.DataFrame([(k, *c) for k, t in zip(part["k"], part["t"], strict=True) if t for c in concepts_of(t, lexicon)], columns=names)

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"{key} {kind}, sentence_id int, start int, stop int, surface string, label string, category string, head string, pattern string").distinct()


def weighed(found: DataFrame, key: str) -> DataFrame:
    """Adds times (in the document), df, words and the selection score."""
    times = found.groupBy(key, "label").agg(F.count("*").alias("times"))
    df = times.groupBy("label").agg(F.count("*").alias("df"))
    out = found.join(times, [key, "label"]).join(df, "label").withColumn("words", F.size(F.split("label", " ")))
    kinds = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    score = F.coalesce(kinds[F.col("category")], F.lit(1.0)) + 0.30 * F.least(F.log1p(F.col("times").cast("double")), F.lit(2.0)) + 0.06 * F.least("words", F.lit(4))
    return out.withColumn("score", F.round(score, 4))


def choose(rows: Sequence[tuple], limit: int) -> list[str]:
    """Labels taken greedily in order: (label, head, sentence); none whose words are within, or hold, those of one taken with the same head and sentence."""
    taken: list[tuple[str, frozenset, str, int]] = []
    for label, head, sentence in rows:
        words = frozenset(label.split())
        if any(h == head and n == sentence and (words < w or w < words) for _, w, h, n in taken):
            continue
        taken.append((label, words, head, sentence))
        if len(taken) == limit:
            break
    return [t[0] for t in taken]


def select(scored: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """The occurrences of each document's best `limit` labels without nested ones."""
    first = Window.partitionBy(key, "label").orderBy(F.desc("score"), F.desc("times"), F.desc("words"), "start", "stop", "category")
    each = scored.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    kind = scored.schema[key].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["score", "times", "words", "start", "label"], ascending=[False, False, False, True, True])
        return pd.DataFrame({key: frame[key].iloc[0], "label": choose(list(zip(f["label"], f["head"], f["sentence_id"], strict=True)), limit)})

    kept = each.select(key, "label", "head", "sentence_id", "score", "times", "words", "start").groupBy(key).applyInPandas(run, f"{key} {kind}, label string")
    return scored.join(kept, [key, "label"])


#: What a predicate claims by the words before it, in order of precedence: (status, words, how many words back; 0: the whole clause).
STANCES = (
    ("negated", ("not", "never", "neither", "without"), 6),
    ("purpose_or_design", ("to",), 4),
    ("hypothetical_or_epistemic", ("aim", "aims", "aimed", "aiming", "seek", "seeks", "seeking", "suggest", "suggests", "suggested", "hypothesize", "hypothesizes", "hypothesized", "will"), 0),
    ("hypothetical_or_modal", ("can", "may", "might", "could", "would", "should", "possibly", "potentially", "potential", "capable"), 0),
)
ASSERTED = "observed_assertion"
#: Pairs of neighbouring words that take a cue back: an emphasis, and reports of something seen.
TAKEN_BACK = (("not", "only"), *((w, "to") for w in ("found", "shown", "observed", "demonstrated", "reported", "confirmed")))
#: Words that begin another clause, words that carry a subject on, and how far (in characters) ends and an earlier predicate may lie.
CLAUSE, CARRY = ("while", "whereas", "but", "however"), (",", "and", "while", "but")
FAR, CARRIED = 60, 80


@dataclass(frozen=True)
class Risk:
    """A reason for doubt: one of `words` stands in a stretch of the sentence, at its first or last place or anywhere, if the predicate is one of `verbs`."""

    name: str
    stretch: str
    words: tuple[str, ...]
    place: str = "any"
    verbs: tuple[str, ...] = ()


#: Doubts that words raise.  Stretches: before and after the predicate, from the source to the predicate, from there to the target, and between the ends.
DOUBTS = (
    Risk("nominal_predicate", "before", ("the", "an", "a", "this", "that", "such", "net", "rate", "level"), "last", ("increase", "decrease", "form", "limit", "control", "drive")),
    Risk("nominal_predicate", "after", ("in", "of"), "first", ("increase", "decrease", "form")),
    Risk("nominal_predicate", "after", ("and",), "first", ("limit",)),
    Risk("cross_clause", "between", (",", ";", *CLAUSE)),
    Risk("intervening_head", "object", ("pathway", "pathways", "route", "routes", "means", "method", "methods", "strategy", "strategies", "mechanism", "mechanisms")),
)
RISKS = ("nominal_predicate", "hyphenated_predicate", "cross_clause", "other_predicate_between", "long_gap", "inherited_subject", "compound_subject", "intervening_head")


def tokens(text: Column) -> Column:
    """Lower-case words and single marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def _among(word: Column, words: Sequence[str]) -> Column:
    return F.coalesce(word.isin(*words), F.lit(False))


def _clause(words: Column) -> Column:
    """The words after the last semicolon, or the last comma that a word of CLAUSE follows."""
    breaks = F.transform(words, lambda w, i: F.when((w == ";") | (_among(w, CLAUSE) & F.coalesce(F.get(words, i - 1) == ",", F.lit(False))), i + 1).otherwise(0))
    cut = F.coalesce(F.array_max(breaks), F.lit(0))
    return F.slice(words, cut + 1, F.greatest(F.size(words) - cut, F.lit(0)))


def assertion(before: Column) -> Column:
    """What a predicate claims, given the sentence before it: the first of STANCES with a cue near enough, else an observation."""
    return stance(clause_words(tokens(before)))


def clause_words(words: Column) -> Column:
    """The words, without marks, of the last clause; `words` is asked for each word, so it should be a column that is held."""
    return F.filter(_clause(words), lambda w: w.rlike("^[\\p{L}\\p{N}_]"))


def stance(clause: Column) -> Column:
    """The first of STANCES with a cue near enough in a clause's words, else an observation; `clause` should be a column that is held."""
    out = F.lit(ASSERTED)
    for status, words, back in reversed(STANCES):
        out = F.when(_cue(clause, words, back), status).otherwise(out)
    return out


def _cue(clause: Column, words: Sequence[str], back: int) -> Column:
    """Whether one of `words` stands among the last `back` (0: among all) and is not taken back."""
    held = F.transform(clause, lambda w, i: _among(w, words) & (F.lit(back == 0) | (i >= F.size(clause) - back)) & ~_taken_back(clause, w, i))
    return F.exists(held, lambda x: x)


def _taken_back(words: Column, word: Column, at: Column) -> Column:
    pairs = [((word == a) & (F.get(words, at + 1) == b)) | ((word == b) & (F.get(words, at - 1) == a)) for a, b in TAKEN_BACK]
    return F.coalesce(reduce(lambda x, y: x | y, [F.coalesce(p, F.lit(False)) for p in pairs]), F.lit(False))


def doubts(sentence: Column, name: Column, start: Column, stop: Column, left: Column, right: Column, others: Column) -> Column:
    """The RISKS of a predicate at start..stop whose source ends at `left` and whose target begins at `right`; `others`: all predicates' spans in the sentence."""
    return raised_by(stretches(sentence, start, stop, left, right), sentence, name, start, stop, left, right, others)


def stretches(sentence: Column, start: Column, stop: Column, left: Column, right: Column) -> dict[str, Column]:
    """The words of the stretches that DOUBTS look at."""
    part = lambda a, b: F.substring(sentence, a + 1, F.greatest(b - a, F.lit(0)))
    return {"before": tokens(part(F.lit(0), start)), "after": tokens(part(stop, F.length(sentence))), "subject": tokens(part(left, start)), "object": tokens(part(stop, right)), "between": tokens(part(left, right))}


def raised_by(stretch: dict[str, Column], sentence: Column, name: Column, start: Column, stop: Column, left: Column, right: Column, others: Column) -> Column:
    """The RISKS of a predicate, given its stretches' words."""
    part = lambda a, b: F.substring(sentence, a + 1, F.greatest(b - a, F.lit(0)))
    raised: dict[str, Column] = {}
    for r in DOUBTS:
        words = stretch[r.stretch]
        seen = F.arrays_overlap(words, F.array(*map(F.lit, r.words))) if r.place == "any" else _among(F.get(words, F.lit(0) if r.place == "first" else F.size(words) - 1), r.words)
        raised[r.name] = raised.get(r.name, F.lit(False)) | (seen & name.isin(*r.verbs) if r.verbs else seen)
    glued = (F.substring(sentence, start, F.lit(1)) == "-") & (start > 0) | (F.substring(sentence, stop + 1, F.lit(1)) == "-")
    earlier = F.array_max(F.transform(F.filter(others, lambda o: o["stop"] <= left), lambda o: o["stop"]))
    subject = stretch["subject"]
    joined = F.array_position(subject, "and")
    raised |= {
        "hyphenated_predicate": glued,
        "other_predicate_between": F.exists(others, lambda o: (o["start"] >= left) & (o["stop"] <= right) & (o["start"] != start)),
        "long_gap": (start - left > FAR) | (right - stop > FAR),
        "inherited_subject": (left - earlier <= CARRIED) & F.arrays_overlap(tokens(part(earlier, start)), F.array(*map(F.lit, CARRY))),
        "compound_subject": (joined > 0) & ~((F.array_position(subject, "between") > 0) & (F.array_position(subject, "between") < joined)),
    }
    return F.filter(F.array(*[F.when(raised[r], F.lit(r)) for r in RISKS]), lambda r: r.isNotNull())


def predicates(docs: DataFrame, key: str, text: str, lexicon: Lexicon) -> DataFrame:
    """(key, sentence_id, at, sentence, name, start, stop, others): every predicate of a text; places count within the sentence, which begins `at`."""
    verb = "|".join(f"(?:{p})" for p, _ in lexicon.predicates)
    each = sentences(docs, key, text)
    hits, gaps = F.regexp_extract_all("sentence", F.lit(f"({verb})"), F.lit(0)), F.split("sentence", verb, -1)
    rows = each.where(F.col("sentence").rlike(verb)).select(key, "sentence_id", F.col("start").alias("at"), "sentence", F.arrays_zip(hits.alias("hit"), gaps.alias("gap")).alias("p"))
    spans = F.aggregate("p", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")), lambda s, x: F.struct((s["at"] + F.length(x["gap"]) + F.length(F.coalesce(x["hit"], F.lit("")))).alias("at"), F.when(x["hit"].isNull(), s["spans"]).otherwise(F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(x["gap"])).alias("start"), (s["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("stop"))))).alias("spans")))["spans"]  # a sentence's predicates are few
    rows = rows.select(key, "sentence_id", "at", "sentence", spans.alias("others"))
    one = rows.select("*", F.explode("others").alias("o")).select(key, "sentence_id", "at", "sentence", "o.start", "o.stop", "others")
    return one.withColumn("name", predicate_name(F.substring("sentence", F.col("start") + 1, F.col("stop") - F.col("start")), lexicon))


def predicate_name(surface: Column, lexicon: Lexicon) -> Column:
    name = F.replace(F.lower(surface), F.lit(" "), F.lit("_"))
    for pattern, to in reversed(lexicon.predicates):
        name = F.when(surface.rlike(f"^(?:{pattern})$"), to).otherwise(name)
    return name


def relations(docs: DataFrame, key: str, text: str, chosen: DataFrame, lexicon: Lexicon, reach: int = 180) -> DataFrame:
    """(key, sentence_id, predicate, start, stop, source, target, status, risks, strict, relation_id): directed relations between chosen concepts.

    Of the concepts of a sentence that lie within `reach` of a predicate, the source is
    taken from those before it and the target from those after: the category that
    END_ORDER prefers, then the nearest, then the longest, then by label.
    """
    worth = F.create_map(*[F.lit(x) for kv in END_ORDER.items() for x in kv])
    near = chosen.where(F.col("category").isin(*END_ORDER)).select(key, "sentence_id", F.col("start").alias("c_start"), F.col("stop").alias("c_stop"), "label", worth[F.col("category")].alias("worth"))
    found = predicates(docs, key, text, lexicon)
    met = found.join(near.withColumns({"c_size": F.col("c_stop") - F.col("c_start")}), [key, "sentence_id"])
    met = met.withColumns({"c_start": F.col("c_start") - F.col("at"), "c_stop": F.col("c_stop") - F.col("at")})
    best = lambda ok, nearest: F.max(F.when(ok, F.struct("worth", nearest.alias("near"), F.col("c_size"), "label")))
    ahead, behind = F.col("start") - F.col("c_stop"), F.col("c_start") - F.col("stop")
    ends = met.groupBy(key, "sentence_id", "at", "sentence", "name", "start", "stop", "others").agg(best(ahead.between(0, reach), F.col("c_stop")).alias("s"), best(behind.between(0, reach), -F.col("c_start")).alias("t"))
    rows = ends.where("s.label <> t.label").withColumns({"left": F.col("s.near"), "right": -F.col("t.near"), "source": F.col("s.label"), "target": F.col("t.label")})
    return judged(rows, key).select(key, *RELATION)


#: What is told of a relation, beside its document.
RELATION = ("sentence_id", "predicate", "start", "stop", "source", "target", "status", "risks", "strict", "relation_id")


def judged(rows: DataFrame, key: str) -> DataFrame:
    """Adds predicate, status, risks, strict and relation_id to rows with a predicate (at, sentence, name, start, stop, others) and its ends (source, left, target, right); start and stop then count within the text."""
    place = [F.col(c) for c in ("start", "stop", "left", "right")]
    made = stretches(F.col("sentence"), *place)
    # words are columns before they are looked at word by word: within an expression they would be found again for each of them
    rows = rows.withColumns({f"_{x}": words for x, words in made.items()}).withColumn("_clause", clause_words(F.col("_before")))
    rows = rows.withColumns({"status": stance(F.col("_clause")), "risks": raised_by({x: F.col(f"_{x}") for x in made}, F.col("sentence"), F.col("name"), *place, F.col("others"))})
    rows = rows.withColumns({"predicate": F.col("name"), "start": F.col("start") + F.col("at"), "stop": F.col("stop") + F.col("at"), "strict": (F.col("status") == ASSERTED) & (F.size("risks") == 0)})
    return rows.withColumn("relation_id", stable_id("AR", F.col(key).cast("string"), "source", "predicate", "target", F.col("start").cast("string")))


def sentence_pairs(chosen: DataFrame, key: str, found: DataFrame | None = None, most: int = 8) -> DataFrame:
    """(key, sentence_id, u, v, related): pairs of the best `most` concepts of each sentence, and whether a strict relation joins them."""
    w = Window.partitionBy(key, "sentence_id").orderBy(F.desc("score"), F.desc("times"), "start", "label")
    one = Window.partitionBy(key, "sentence_id", "label").orderBy(F.desc("score"), F.desc("times"), "start")
    each = chosen.withColumn("_o", F.row_number().over(one)).where("_o = 1").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).select(key, "sentence_id", "label")
    pairs = each.withColumnRenamed("label", "u").join(each.withColumnRenamed("label", "v"), [key, "sentence_id"]).where("u < v")
    if found is None:
        return pairs.withColumn("related", F.lit(False))
    strict = found.where("strict").select(key, "sentence_id", F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), F.lit(True).alias("related")).distinct()
    return pairs.join(strict, [key, "sentence_id", "u", "v"], "left").na.fill(False, ["related"])


def sentence_bank(pairs: DataFrame, key: str, years: DataFrame, examples: int = 5) -> DataFrame:
    """(u, v, papers, sentences, related_papers, first_year, last_year, first_papers): the bank of sentence pairs."""
    return banked(pairs.join(years, key).select(key, "u", "v", "year", "related", F.lit(1).alias("sentences")), key, examples)


def banked(rows: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """The bank of rows (key, u, v, year, related, sentences), which are shuffled once, by pair.

    Only the first `examples` papers by year are listed.
    """
    papers = rows.repartition("u", "v").groupBy("u", "v", key).agg(F.sum("sentences").alias("n"), F.max("related").alias("related"), F.collect_set(F.struct("year")).alias("years"))
    each = papers.select("u", "v", key, "n", "related", F.posexplode("years").alias("_i", "_y")).select("u", "v", key, "n", "related", (F.col("_i") == 0).alias("once"), "_y.year")
    each = each.withColumn("k", F.row_number().over(Window.partitionBy("u", "v").orderBy("year", key)))
    once, listed = F.col("once"), F.when(F.col("k") <= examples, F.struct("k", F.col(key).cast("string").alias("p")))
    return each.groupBy("u", "v").agg(
        F.count_if(once).alias("papers"), F.sum(F.when(once, F.col("n")).otherwise(0)).alias("sentences"), F.count_if(once & F.col("related")).alias("related_papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.array_join(F.transform(F.array_sort(F.collect_list(listed)), lambda x: x["p"]), "; ").alias("first_papers"),
    )


def support_rows(pairs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(u, v, key, sentence_id, relation_id, kind): each pair's relations, and a row of its own where it has co-occurrence alone."""
    rel = found.select(key, "sentence_id", F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), "relation_id", "strict")
    return supported(pairs.select("u", "v", key, "sentence_id").join(rel, ["u", "v", key, "sentence_id"], "left"), key)


def supported(rows: DataFrame, key: str) -> DataFrame:
    """The rows of `support_rows` of pairs that lie beside their relations."""
    return rows.select("u", "v", key, "sentence_id", F.coalesce("relation_id", F.lit("")).alias("relation_id"), F.when(F.col("relation_id").isNull(), "cooccurrence_only").when(F.col("strict"), "strict_relation").otherwise("relation_for_review").alias("kind"))


class Reading:
    """What one text says: its chosen concepts as `select` gives them, their pairs by sentence, and predicates with both ends as `relations` finds them."""

    def __init__(self, text: str, lexicon: Lexicon, verb: re.Pattern | None = None, limit: int = 20):
        self.text, self.verb, self.spans = text, verb, sentence_spans_of(text)
        found = [c for n, (a, b) in enumerate(self.spans) for c in _concepts_within(text, n, a, b, lexicon)]
        self.times = Counter(c[4] for c in found)
        first: dict[str, tuple] = {}
        rows = [(_score(c[5], self.times[c[4]], c[4].count(" ") + 1), c) for c in found]
        for score, c in rows:
            n, start, stop, _, label, category, head, _ = c
            held = (-score, start, stop, category, head, n)
            if label not in first or held < first[label]:
                first[label] = held
        order = sorted(first, key=lambda x: (first[x][0], -self.times[x], -x.count(" "), first[x][1], x))
        kept = set(choose([(x, first[x][4], first[x][5]) for x in order], limit))
        self.chosen = [(c[0], c[1], c[2], c[4], c[5], self.times[c[4]], score) for score, c in rows if c[4] in kept]

    def by_sentence(self) -> dict[int, list[tuple]]:
        held: dict[int, list[tuple]] = {}
        for c in self.chosen:
            held.setdefault(c[0], []).append(c)
        return held

    def ends(self, n: int, rows: Sequence[tuple], reach: int) -> Iterator[tuple]:
        """(sentence_id, at, sentence, start, stop, others, source, left, target, right) of the sentence n, whose chosen concepts are `rows`."""
        near = [(END_ORDER[c[4]], c[1], c[2], c[3]) for c in rows if c[4] in END_ORDER]
        if len({c[3] for c in near}) < 2:
            return
        a, b = self.spans[n]
        sentence = self.text[a:b]
        others = [m.span() for m in self.verb.finditer(sentence)]
        for start, stop in others:
            s = max(((w, e - a, e - f, x) for w, f, e, x in near if 0 <= start + a - e <= reach), default=None)
            t = max(((w, a - f, e - f, x) for w, f, e, x in near if 0 <= f - a - stop <= reach), default=None)
            if s and t and s[3] != t[3]:
                yield n, a, sentence, start, stop, others, s[3], s[1], t[3], -t[1]

    def relations(self, reach: int) -> Iterator[tuple]:
        for n, rows in self.by_sentence().items():
            yield from self.ends(n, rows, reach)

    def pairs(self, most: int, reach: int) -> Iterator[tuple]:
        """(sentence_id, u, v, first, then `ends` from at on): a row for each end of a pair, or one without; `first` tells one row of each."""
        for n, rows in self.by_sentence().items():
            best: dict[str, tuple] = {}
            for c in rows:
                held = (-c[6], -c[5], c[1], c[3])
                best[c[3]] = min(held, best.get(c[3], held))
            labels = sorted(sorted(best, key=best.get)[:most])
            met: dict[tuple[str, str], list[tuple]] = {}
            for e in self.ends(n, rows, reach) if len(labels) > 1 else ():
                met.setdefault((min(e[6], e[8]), max(e[6], e[8])), []).append(e[1:])
            for i, u in enumerate(labels):
                for v in labels[i + 1 :]:
                    for k, e in enumerate(met.get((u, v)) or [(None,) * 9]):
                        yield n, u, v, k == 0, *e


@cache
def _score(category: str, times: int, words: int) -> float:
    return round(PRIORITY.get(category, 1.0) + 0.30 * min(math.log1p(times), 2.0) + 0.06 * min(words, 4), 4)


def unshared(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key no other row has, all others or none): the former can be read one by one.  They are dealt anew where they come in too few parts, as from a file of one row group."""
    rows, parallel = docs.select(key, text), docs.sparkSession.sparkContext.defaultParallelism
    few = rows.select(F.spark_partition_id().alias("p")).distinct().count() < 2 * parallel
    often = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).select(key)
    others = None
    if not often.isEmpty():
        others = rows.join(often, key, "left_semi").unionByName(rows.where(F.col(key).isNull()))
        rows = rows.where(F.col(key).isNotNull()).join(often, key, "left_anti")
    return (dealt(rows, key, text) if few else rows), others


def _each(docs: DataFrame, key: str, text: str, fields: str, told: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """The rows that `told` makes of each text, with its key; nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()
    out = _parse_datatype_string(f"{key} {kind}, {fields}")
    schema = to_arrow_schema(StructType(out.fields[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for i in range(0, len(texts), DOCUMENTS):
                at, rows = [], []
                for k in range(i, min(i + DOCUMENTS, len(texts))):
                    t = texts[k].as_py()
                    made = list(told(t)) if t else ()
                    rows += made
                    at += [k] * len(made)
                if rows:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=[key, *schema.names])

    return docs.select(key, text).mapInArrow(run, out)


def _verb(lexicon: Lexicon) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p, _ in lexicon.predicates))


def chosen_by_text(docs: DataFrame, key: str, text: str, lexicon: Lexicon, limit: int = 20) -> DataFrame:
    """(key, labels, chosen) of each text of its own key: all its labels, and the occurrences that `select` keeps of them."""

    def told(t: str) -> Iterator[tuple]:
        r = Reading(t, lexicon, limit=limit)
        if r.times:
            yield list(r.times), [dict(zip(CHOSEN, c, strict=True)) for c in r.chosen]

    return _each(docs, key, text, "labels array<string>, chosen array<struct<sentence_id:int,start:int,stop:int,label:string,category:string,times:bigint,score:double>>", told)


#: What is told of a chosen occurrence.
CHOSEN = ("sentence_id", "start", "stop", "label", "category", "times", "score")
_ENDS = "at int, sentence string, start int, stop int, others array<struct<start:int,stop:int>>, source string, left int, target string, right int"


def _ended(e: Sequence) -> tuple:
    """The columns of _ENDS of what `Reading.ends` gives from at on."""
    return (*e[:4], e[4] and [{"start": a, "stop": b} for a, b in e[4]], *e[5:])


def _named(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    return rows.withColumn("name", predicate_name(F.substring("sentence", F.col("start") + 1, F.col("stop") - F.col("start")), lexicon))


def relations_by_text(docs: DataFrame, key: str, text: str, lexicon: Lexicon, limit: int = 20, reach: int = 180) -> DataFrame:
    """The rows of `relations` between the chosen concepts of each text of its own key; nothing is shuffled or written."""
    verb = _verb(lexicon)
    rows = _each(docs, key, text, f"sentence_id int, {_ENDS}", lambda t: ((e[0], *_ended(e[1:])) for e in Reading(t, lexicon, verb, limit).relations(reach)))
    return judged(_named(rows, lexicon), key).select(key, *RELATION)


def pairs_by_text(docs: DataFrame, key: str, text: str, lexicon: Lexicon, limit: int = 20, most: int = 8, reach: int = 180) -> DataFrame:
    """(key, sentence_id, u, v, first, relation_id, strict): the rows of `sentence_pairs` of each text of its own key, once for each relation of the pair, or once with nulls; `first` tells one of them."""
    verb = _verb(lexicon)
    rows = _each(docs, key, text, f"sentence_id int, u string, v string, first boolean, {_ENDS}", lambda t: ((*p[:4], *_ended(p[4:])) for p in Reading(t, lexicon, verb, limit).pairs(most, reach)))
    held = F.col("source").isNotNull()
    return judged(_named(rows, lexicon), key).select(key, "sentence_id", "u", "v", "first", F.when(held, F.col("relation_id")).alias("relation_id"), F.when(held, F.col("strict")).alias("strict"))


def cross_role_edges(rows: DataFrame, key: str, label: str, role: str, order: Sequence[str]) -> DataFrame:
    """(a, b, role_a, role_b, papers): labels of different roles in one paper, the earlier role of `order` first."""
    rank = F.array_position(F.array(*[F.lit(r) for r in order]), F.col(role))
    each = rows.select(key, F.col(label).alias("l"), F.col(role).alias("r"), rank.alias("k")).where("k > 0").distinct()
    a, b = (each.select(key, *[F.col(c).alias(f"{c}_{x}") for c in ("l", "r", "k")]) for x in "ab")
    met = a.join(b, key).where("k_a < k_b")
    return met.groupBy(F.col("l_a").alias("a"), F.col("l_b").alias("b"), F.col("r_a").alias("role_a"), F.col("r_b").alias("role_b")).agg(F.count_distinct(key).alias("papers"))


def affirmed_match(text: Column, pattern: str, before: str, after: str, back: int = 55, ahead: int = 30) -> Column:
    """The first match of a pattern that no `before` ends at and no `after` follows; null if every match is negated."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    size = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    spans = F.transform(F.sequence(F.lit(1), F.size(hits)), lambda i: F.struct((size(F.slice(gaps, 1, i)) + size(F.slice(hits, 1, i - 1))).alias("at"), F.element_at(hits, i).alias("hit")))
    ok = lambda x: ~F.lower(F.substring(text, F.greatest(x["at"] - back, F.lit(0)) + 1, F.least(x["at"], F.lit(back)))).rlike(f"(?:{before})\\z") & ~F.lower(F.substring(text, x["at"] + F.length(x["hit"]) + 1, F.lit(ahead))).rlike(f"^(?:{after})")
    return F.when(F.size(hits) > 0, F.get(F.filter(spans, ok), F.lit(0))["hit"])


def contrastive(text: Column, at: Column, stop: Column) -> Column:
    """Whether a cue at a place stands in contrast, or is said to be absent after it."""
    before = F.lower(F.substring(text, F.greatest(at - 70, F.lit(0)) + 1, F.least(at, F.lit(70))))
    after = F.lower(F.substring(text, stop + 1, F.lit(180)))
    return (at >= 0) & (before.rlike(r"(?:different from|unlike|in contrast to|rather than|as opposed to)\s+(?:\w+[ -]?){0,3}$") | after.rlike(r"(?s)^[^.!?]{0,130}\b(?:eliminated|excluded|absent|negligible|not observed|suppressed)\b"))
