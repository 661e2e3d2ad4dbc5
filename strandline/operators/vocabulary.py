"""Open vocabularies from whole texts: phrases, their scores, who has them, alias lookups, edges from raw text, roles of sentences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import split_claims
from ..functions.text import stable_id, tokens, word_ngrams
from .extract import sentence_spans_of, similar_labels
from .grams import dealt, runs


def clauses(text: Column) -> Column:
    """The texts between marks that no phrase crosses."""
    return F.filter(F.split(F.lower(text), r"[.,;:!?()\[\]\n]+"), lambda c: F.trim(c) != "")


def phrase_runs(docs: DataFrame, key: str, text: str, sizes: tuple[int, int], stop: Sequence[str], domain: str | None = None) -> DataFrame:
    """(key, phrase): word n-grams within a clause wherever they come, no stop word at an end, with a word of the domain if one is given."""
    each = docs.select(key, F.explode(clauses(F.col(text))).alias("clause")).select(key, tokens("clause").alias("words"))
    each = runs(each, [key], "words", sizes, stop, "phrase")
    return each.where(F.col("phrase").rlike(domain)) if domain else each


def phrases(docs: DataFrame, key: str, text: str, sizes: tuple[int, int], stop: Sequence[str], domain: str | None = None) -> DataFrame:
    """(key, phrase, times): the phrases of each text, counted; rows lie by `key`."""
    return phrase_runs(dealt(docs, key, text), key, text, sizes, stop, domain).groupBy(key, "phrase").agg(F.count("*").alias("times"))


def vocabulary(found: DataFrame, key: str, least: int, most: int, top: int) -> DataFrame:
    """(phrase, df, times, score, place): the best phrases of a document-frequency gate by log frequency, words and specificity."""
    n = found.groupBy("phrase").agg(F.count("*").alias("df"), F.sum("times").alias("times")).where(F.col("df").between(least, most))
    score = F.round(F.log1p(F.col("df").cast("double")) * F.sqrt(F.size(F.split("phrase", " ")).cast("double")) / (1 + F.log10(F.col("df").cast("double"))), 9)
    best = n.withColumn("score", score).orderBy(F.desc("score"), F.desc("times"), "phrase").limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("times"), "phrase")))  # `top` rows


def assign(found: DataFrame, words: DataFrame, key: str, most: int) -> DataFrame:
    """(key, phrase, place): each document's first `most` phrases of the vocabulary, in its order.  Phrases meet documents by equality, not by search; a document may have one many times."""
    w = Window.partitionBy(key).orderBy("place")
    met = found.select(key, "phrase").join(words.select("phrase", "place"), "phrase").distinct()
    return met.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def claim_units(docs: DataFrame, key: str, text: str, context: DataFrame, least: int = 40) -> DataFrame:
    """(key, unit, claim, unit_id, and the columns of context): the claims of each text, numbered, with an id and their document's context."""
    each = docs.select(key, F.posexplode(split_claims(F.col(text), least)).alias("unit", "claim"))
    return each.withColumn("unit_id", stable_id("CU", F.col(key).cast("string"), F.col("unit").cast("string"), "claim")).join(context, key, "left")


def pattern_hits(rows: DataFrame, key: str, fields: Sequence[str], pattern: str, blocked: Sequence[str] = ()) -> DataFrame:
    """(key, fields, terms): where a pattern is found, and its distinct hits without blocked ones, sorted without regard to case; rows without a hit go."""
    hits = {f: F.filter(F.regexp_extract_all(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(pattern), F.lit(0)), lambda h: ~h.isin(*blocked) if blocked else F.lit(True)) for f in fields}
    where = F.filter(F.array(*[F.when(F.size(h) > 0, F.lit(f)) for f, h in hits.items()]), lambda x: x.isNotNull())
    terms = F.transform(F.array_sort(F.transform(F.array_distinct(F.concat(*hits.values())), lambda h: F.struct(F.lower(h).alias("l"), h.alias("h")))), lambda x: x["h"])
    return rows.select(key, F.array_join(where, "; ").alias("fields"), F.array_join(terms, "; ").alias("terms")).where("fields <> ''")


def family_hits(rows: DataFrame, key: str, text: str, families: dict[str, str]) -> DataFrame:
    """(key, family, hits): how often each family's pattern is found; families without a hit go."""
    n = F.array(*[F.struct(F.lit(f).alias("family"), F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), F.lit(0))).alias("hits")) for f, p in families.items()])
    return rows.select(key, F.explode(n).alias("x")).select(key, "x.*").where("hits > 0")


def term_lookup(concepts: DataFrame, aliases: DataFrame, manual: DataFrame, merge: DataFrame) -> DataFrame:
    """(term, concept): canonical labels, aliases and manual terms, cleaned, after the merge map; a term of several concepts stays with each."""
    every = concepts.select(F.col("label").alias("term"), "concept").unionByName(aliases.select(F.col("alias").alias("term"), "concept")).unionByName(manual.select("term", "concept"))
    clean = F.trim(F.regexp_replace(F.lower("term"), r"[^\p{L}\p{N}]+", " "))
    return every.join(merge, "concept", "left").select(clean.alias("term"), F.coalesce("into", "concept").alias("concept")).where("term <> ''").distinct()


def text_concepts(docs: DataFrame, key: str, text: str, terms: DataFrame, most_words: int = 3) -> DataFrame:
    """(key, concept): concepts whose terms are runs of words in a text.  The runs of each text meet the terms by equality."""
    split = docs.select(key, tokens(text).alias("words"))
    grams = split.select(key, F.explode(F.array_distinct(F.concat("words", word_ngrams(F.col("words"), 2, most_words)))).alias("term"))
    return grams.join(terms, "term").select(key, "concept").distinct()


def augmented_edges(mapped: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(u, v, papers, fresh): pairs of concepts that a paper has by mapping or by its raw text; fresh where no paper has them by mapping alone."""
    pairs = lambda rows: rows.select(key, F.col("concept").alias("u")).join(rows.select(key, F.col("concept").alias("v")), key).where("u < v")
    every = mapped.select(key, "concept").unionByName(found.select(key, "concept")).distinct()
    known = pairs(mapped.select(key, "concept").distinct()).select("u", "v").distinct().withColumn("_k", F.lit(1))
    return pairs(every).groupBy("u", "v").agg(F.count("*").alias("papers")).join(known, ["u", "v"], "left").select("u", "v", "papers", F.col("_k").isNull().alias("fresh"))


def overlap_audit(vocab: DataFrame, label: str, role: str, least: float = 0.88) -> DataFrame:
    """(a, b, kind): labels that come in two roles, whose words nest within one role, or that look alike within one role.

    Nested and alike labels share a word, so pairs come from words, not from a product.
    """
    rows = vocab.select(F.col(label).alias("l"), F.col(role).alias("r")).distinct()
    twice = rows.groupBy("l").agg(F.count("*").alias("n")).where("n > 1").select(F.col("l").alias("a"), F.col("l").alias("b"), F.lit("same_label").alias("kind"))
    words = rows.select("l", "r", F.split("l", " ").alias("w")).select("l", "r", "w", F.explode(F.array_distinct("w")).alias("word"))
    met = words.select(F.col("l").alias("a"), "r", F.col("w").alias("wa"), "word").join(words.select(F.col("l").alias("b"), "r", F.col("w").alias("wb"), "word"), ["r", "word"]).where("a <> b").select("a", "b", "r", "wa", "wb").distinct()
    within = (F.size(F.array_except("wa", "wb")) == 0) & (F.size(F.array_distinct("wa")) < F.size(F.array_distinct("wb")))
    nested = met.where(within).select("a", "b", F.lit("nested").alias("kind")).distinct()
    alike = similar_labels(met.where((F.col("a") < F.col("b")) & ~within).select("a", "b").distinct(), "a", "b", least).select("a", "b", F.lit("alike").alias("kind"))
    return twice.unionByName(nested).unionByName(alike)


def choose_roles(scores: Sequence[Sequence[float]]) -> list[int | None]:
    """For each role in order the sentence with the best positive score that no earlier role took; ties go to the earlier sentence."""
    taken: set[int] = set()
    out: list[int | None] = []
    for role in scores:
        best = max((s, -i) for i, s in enumerate(role) if i not in taken) if len(taken) < len(role) else (0.0, 0)
        out.append(-best[1] if best[0] > 0 else None)
        if best[0] > 0:
            taken.add(-best[1])
    return out


def role_sentences(docs: DataFrame, key: str, text: str, roles: dict[str, tuple[Sequence[str], float]]) -> DataFrame:
    """(key, role, start, stop, score): each role's sentence by the share of its cue words and a bonus, no sentence twice; a role without a cue has no row.

    A text's sentences compete for roles, so a document is judged whole.
    """
    import re

    kind = docs.schema[key].dataType.simpleString()
    cues = {r: (frozenset(w), bonus) for r, (w, bonus) in roles.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, t in zip(f["k"], f["t"], strict=True):
                spans = sentence_spans_of(t) if t else []
                words = [re.findall(r"[^\W_]+", t[a:b].casefold()) for a, b in spans]
                score = [[round(sum(w in c for w in s) / max(len(s), 1) + (bonus if s and s[0] in c else 0.0), 9) if any(w in c for w in s) else 0.0 for s in words] for c, bonus in cues.values()]
                out += [(k, r, *spans[i], score[j][i]) for j, (r, i) in enumerate(zip(cues, choose_roles(score), strict=True)) if i is not None]
            yield pd.DataFrame(out, columns=[key, "role", "start", "stop", "score"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, role string, start int, stop int, score double")
