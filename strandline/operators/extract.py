"""Extraction with exact spans: sentences, clauses, relations, nested terms."""

from __future__ import annotations

import difflib
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import positions
from . import segment

#: Fixed value: abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "et al.", "Fig.", "vs.", "Dr.", "etc.", "No.")


_GUARD = re.compile("|".join(re.escape(a) for a in ABBREVIATIONS))
_END = re.compile(r"[.!?]+(?=\s|$)")


def sentence_spans_of(text: str, guard: re.Pattern = _GUARD) -> list[tuple[int, int]]:
    """Exact spans of a text's sentences; stops in abbreviations and numbers end nothing."""
    shut = {m.end() for m in guard.finditer(text)}
    out, at = [], 0
    for cut in [m.end() for m in _END.finditer(text) if m.end() not in shut] + [len(text)]:
        piece = text[at:cut]
        start = at + len(piece) - len(piece.lstrip())
        if piece.strip():
            out.append((start, start + len(piece.strip())))
        at = cut
    return out


def sentences(docs: DataFrame, key: str, text: str, abbreviations: Sequence[str] = ABBREVIATIONS) -> DataFrame:
    """(key, sentence_id, start, stop, sentence): exact code-point spans."""
    return segment.sentences(docs, key, text, abbreviations)


def sentence_array(text: Column, least: int = 7) -> Column:
    """Sentences by look-behind in the JVM, of `least` words or more."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[\p{Lu}0-9])"), lambda s: F.size(F.split(s, r"\s+")) >= least)


def matches(rows: DataFrame, keep: Sequence[str], text: str, pattern: str, group: int = 0) -> DataFrame:
    """(keep, hit, times): distinct matches of a pattern and how often each comes."""
    hits = rows.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("hit"))
    return hits.groupBy(*keep, "hit").agg(F.count("*").alias("times"))


def phrase_hits(docs: DataFrame, phrases: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item, p): all places of each phrase (column `phrase`) in each text (column `text`) that holds it.

    A text that holds a phrase holds the words within it, so phrases of four words or
    more meet texts by a pair of inner words, the one with the smallest hash; pairs are
    verified.  Shorter phrases are looked for in every text.
    """
    word = r"([\p{L}\p{N}]+)"
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1)))
    items = phrases.where(F.length("phrase") > 0).select(item, "phrase", F.regexp_extract_all("phrase", F.lit(word), F.lit(1)).alias("w"))
    inner = F.slice("w", 2, F.size("w") - 2)
    long = items.where(F.size("w") >= 4).select(item, "phrase", F.array_min(pairs(inner)).alias("h"))
    seen = docs.select(key, "text", F.regexp_extract_all("text", F.lit(word), F.lit(1)).alias("w")).where(F.size("w") >= 2).select(key, "text", F.explode(F.array_distinct(pairs(F.col("w")))).alias("h"))
    asked = long.select("h").distinct()
    met = seen.join(asked, "h", "left_semi").join(long, "h").select(key, item, "text", "phrase")
    short = items.where(F.size("w") < 4).select(item, "phrase")
    met = met.unionByName(docs.select(key, "text").join(short, F.contains("text", "phrase")).select(key, item, "text", "phrase"))
    return met.where(F.contains("text", "phrase")).select(key, item, positions(F.col("text"), F.col("phrase")).alias("p"))


def nested_terms(terms: DataFrame, by: Sequence[str], term: str) -> DataFrame:
    """(by, inner, outer): terms whose words are a proper subset of another's in the same group."""
    words = terms.select(*by, term, F.split(term, " ").alias("w")).distinct()
    each = words.select(*by, F.col(term).alias("inner"), F.col("w").alias("wi"), F.explode("w").alias("word"))
    outer = words.select(*by, F.col(term).alias("outer"), F.col("w").alias("wo"), F.explode("w").alias("word"))
    met = each.join(outer, [*by, "word"]).where("inner <> outer").select(*by, "inner", "outer", "wi", "wo").distinct()
    return met.where((F.size(F.array_except("wi", "wo")) == 0) & (F.size(F.array_distinct("wi")) < F.size(F.array_distinct("wo")))).select(*by, "inner", "outer")


def similar_labels(pairs: DataFrame, a: str, b: str, least: float = 0.88) -> DataFrame:
    """Pairs of labels whose matching-blocks ratio reaches `least`; lengths that cannot reach it are dropped before Python sees them."""
    bound = 2 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y, strict=True)])

    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (bound >= least)).withColumn("ratio", ratio(F.col(a), F.col(b))).where(F.col("ratio") >= least)
