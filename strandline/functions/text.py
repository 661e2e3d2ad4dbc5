"""Column functions on text: cleaning, keys, stable ids, tokens, n-grams, spans, rule lists.  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column | str) -> Column:
    """White space collapsed and trimmed; null becomes the empty text."""
    return F.coalesce(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def norm_key(x: Column | str) -> Column:
    """Title key: lower case, one kind of dash, everything but ASCII letters and digits as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[–—−]", "-"), "[^a-z0-9]+", " "))


def alnum_key(x: Column | str) -> Column:
    """Equality key: letters and digits only, lower case."""
    return F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def clean_doi(x: Column | str) -> Column:
    """A DOI without resolver, `doi:` prefix and outer punctuation, lower case; empty becomes null."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"^https?://(dx\.)?doi\.org/", ""), r"^doi:\s*", "")
    return F.nullif(F.regexp_replace(bare, r"^[ .;,]+|[ .;,]+$", ""), F.lit(""))


def as_bool(x: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(x) if isinstance(x, str) else x)).isin("true", "1", "yes"), F.lit(False))


def safe_int(x: Column | str, default: int = 0) -> Column:
    return F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string").try_cast("int"), F.lit(default))


def stable_id(prefix: str, *parts: Column | str, digits: int = 12, upper: bool = False) -> Column:
    """prefix_ and the leading hex digits of the SHA-1 of the cleaned, lower-cased parts."""
    x = F.substring(F.sha1(F.concat_ws("\x1f", *[F.lower(clean(p)) for p in parts])), 1, digits)
    return F.concat(F.lit(prefix + "_"), F.upper(x) if upper else x)


def pair_id(prefix: str, a: Column | str, b: Column | str, digits: int = 20) -> Column:
    """The same id for either order of a pair."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256), 1, digits))


def fingerprint(*columns: Column | str) -> Column:
    """SHA-256 of the columns as JSON in the order given."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def has_layer(packed: Column | str, layer: str) -> Column:
    return F.array_contains(F.split(packed, r"\|"), layer)


def unpack(packed: Column | str) -> Column:
    """The non-empty cells of a `;` separated list."""
    return F.filter(F.split(packed, r"\s*;\s*"), lambda v: v != "")


def tokens(x: Column | str) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}]+)"), 1)


def word_ngrams(words: Column, least: int, most: int) -> Column:
    """All runs of `least` to `most` words, joined by spaces."""
    return F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))))


def char_grams(key: Column | str, sizes: Sequence[int] = (3, 4)) -> Column:
    """Distinct character n-grams of ^key$."""
    t = F.concat(F.lit("^"), key, F.lit("$"))
    one = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[one(n) for n in sizes]))


def positions(text: Column, phrase: Column, offset: int = 0) -> Column:
    """All places of a phrase, overlaps too: array of struct(start, stop), from 0.

    The text is cut before each place by a look-ahead, so the work follows its
    length and the number of places; the pieces' lengths give the places.
    """
    n = F.length(phrase)
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.transform(F.split(text, quoted, -1), lambda p: F.length(p))
    start = F.struct(F.lit(0).alias("at"), F.when(F.startswith(text, phrase), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + p).alias("at"), F.concat(acc["out"], F.array(acc["at"] + p)).alias("out"))
    found = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step)["out"]
    return F.when((n > 0) & F.contains(text, phrase), F.transform(found, lambda i: F.struct((i + offset).alias("start"), (i + offset + n).alias("stop")))).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))


def first_rule(x: Column | str, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that matches, in the order given."""
    out = F.lit(default).cast("string")
    for pattern, label in reversed(rules):
        out = F.when((F.col(x) if isinstance(x, str) else x).rlike(pattern), label).otherwise(out)
    return out


def all_rules(x: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """Labels of all patterns that match, in the order given."""
    x = F.col(x) if isinstance(x, str) else x
    return F.filter(F.array(*[F.when(x.rlike(p), F.lit(label)) for p, label in rules]), lambda v: v.isNotNull())


def rewrite(x: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        x = F.regexp_replace(x, pattern, to)
    return x


def flags(x: Column | str, **patterns: str) -> list[Column]:
    """One boolean a pattern, named by its keyword."""
    return [(F.col(x) if isinstance(x, str) else x).rlike(p).alias(name) for name, p in patterns.items()]


def near(x: Column, at: Column, before: int, after: int) -> Column:
    """The window of `before` and `after` characters around place `at`, from 0."""
    start = F.greatest(at - before, F.lit(0))
    return F.substring(x, start + 1, at - start + after)


def proper_subset(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_distinct(a)) < F.size(F.array_distinct(b)))


def bands(x: Column, cuts: Sequence[tuple[float, str]], below: str) -> Column:
    """The label of the highest cut that x reaches; null stays null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for cut, label in sorted(cuts, reverse=True):
        out = out.when(x >= cut, label)
    return out.otherwise(below)


def lookup(x: Column, table: dict[str, object], default: object = None) -> Column:
    """A small in-plan map; larger ones are joined."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.coalesce(F.create_map(*pairs)[x], F.lit(default))
