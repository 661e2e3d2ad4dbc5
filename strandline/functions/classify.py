"""Classifiers as columns: layers of pairs, grades, scopes, caveats, phrase tests, weights and scores from rules.

Every list of rules is a parameter; the first that holds decides unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import all_rules, first_rule, lookup

#: Classes and orders of review grades and of machine grades, and weights of tiers and supports.
REVIEW_GRADES = {"R2_dual_direct_sentence_relations": ("R2", 1), "R1_single_direct_sentence_relation": ("R1", 2), "R0_cooccurrence_only_or_rejected": ("R0", 3)}
MACHINE_GRADES = {"G2_dual_strict_syntax_candidates": ("G2", 1), "G1_single_strict_syntax_candidate": ("G1", 2), "G0_cooccurrence_only": ("G0", 3)}
UNGRADED = ("UNCLASSIFIED", 99)


def layer_code(kind: Column, codes: dict[str, str], default: str = "O") -> Column:
    return lookup(kind, codes, default)


def layer_pair(a: Column, b: Column, order: Sequence[str]) -> Column:
    """The two codes joined by a dash, the earlier of `order` first."""
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in order]), c)
    return F.when(place(a) <= place(b), F.concat_ws("-", a, b)).otherwise(F.concat_ws("-", b, a))


def role_pair(a: Column, b: Column) -> Column:
    return F.concat_ws("+", F.least(a, b), F.greatest(a, b))


def grade_class(grade: Column) -> Column:
    return lookup(grade, {k: v[0] for k, v in REVIEW_GRADES.items()}, UNGRADED[0])


def grade_order(grade: Column, namespace: Column) -> Column:
    """The order that a grade should have in its namespace (R_ review, G_ machine); 99 if unknown."""
    of = lambda table: lookup(grade, {k: v[1] for k, v in table.items()}, UNGRADED[1])
    return F.when(namespace.startswith("R_"), of(REVIEW_GRADES)).when(namespace.startswith("G_"), of(MACHINE_GRADES)).otherwise(UNGRADED[1])


def scope(text: Column, cues: dict[str, str], cascade: Sequence[tuple[tuple[str, ...], tuple[str, ...], str]], default: str) -> Column:
    """The first scope whose cues all hold and whose excluding cues do not; null texts get the default."""
    has = {name: F.coalesce(text.rlike(p), F.lit(False)) for name, p in cues.items()}
    out = F.lit(default)
    for needs, without, label in reversed(cascade):
        test = F.lit(True)
        for n in needs:
            test = test & has[n]
        for n in without:
            test = test & ~has[n]
        out = F.when(test, label).otherwise(out)
    return out


def matched_fields(pattern: str, **fields: Column) -> Column:
    """Names of the fields that a pattern is found in, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(c.rlike(pattern), F.lit(False)), F.lit(n)) for n, c in fields.items()]), lambda x: x.isNotNull())


def first_evidence(pattern: str, *fields: Column, group: int = 0) -> Column:
    """What the pattern finds in the first field that has it; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(f, F.lit("")), pattern, group), F.lit("")) for f in fields])


def snippet(text: Column, pattern: str, before: int = 100, after: int = 140) -> Column:
    """The first match with the characters around it, white space collapsed; null without a match."""
    at = F.length(F.element_at(F.split(text, pattern, 2), 1))
    found = F.regexp_extract(text, pattern, 0)
    start = F.greatest(at - before, F.lit(0))
    cut = F.substring(text, start + 1, at - start + F.length(found) + after)
    return F.when(text.rlike(pattern), F.trim(F.regexp_replace(cut, r"\s+", " ")))


def caveat(code: Column, known: dict[str, str], text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The caveat listed for a code, else the first that the text suggests, else none."""
    listed = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[code] if known else F.lit(None).cast("string")
    return F.coalesce(listed, first_rule(text, rules, ""))


def points(tests: Sequence[tuple[Column, int]]) -> Column:
    """The sum of the points whose test holds; a null test gives none."""
    return sum((F.when(F.coalesce(t, F.lit(False)), F.lit(n)).otherwise(0) for t, n in tests), F.lit(0))


def evidence_weight(tier: Column, support: Column, has_caveat: Column, tiers: dict[str, float], supports: dict[str, float]) -> Column:
    """Tier by support, reduced to three fifths by a caveat; unknown tiers weigh 0.35, unknown supports 0.5."""
    return lookup(tier, tiers, 0.35) * lookup(support, supports, 0.50) * F.when(has_caveat, 0.60).otherwise(1.00)


def evidence_tier(review: Column, coupled: Column, scope_: Column, ready: Column, scopes: dict[str, str]) -> Column:
    """R for reviews, P for coupled precedents, then by scope; the scope named `core` is A if its evidence is ready, else B."""
    by_scope = F.when(scope_ == scopes["coupled"], "P_coupled_precedent").when((scope_ == scopes["core"]) & ready, "A_direct_evidence_ready").when(scope_ == scopes["core"], "B_direct_needs_evidence_repair")
    by_scope = by_scope.when(scope_ == scopes["adjacent"], "C_adjacent_enabling_evidence").when(scope_ == scopes["cross"], "D_cross_domain_inspiration").otherwise("U_unresolved_or_outside")
    return F.when(review, "R_review").when(coupled, "P_coupled_precedent").otherwise(by_scope)


def good_phrase(phrase: Column, words: tuple[int, int], length: tuple[int, int], stop: Sequence[str], domain: str | None = None) -> Column:
    """Whether a phrase has allowed numbers of words and characters, no stop word at an end, a letter, and a word of the domain."""
    parts = F.split(phrase, " ")
    ok = F.size(parts).between(*words) & F.length(phrase).between(*length) & phrase.rlike("[a-z]") & ~F.element_at(parts, 1).isin(*stop) & ~F.element_at(parts, -1).isin(*stop)
    return ok & phrase.rlike(domain) if domain else ok


def canonical(label: Column, kind: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(label, kind) by the first rule (pattern, canonical label, kind) that matches; others stay."""
    name, to = label, kind
    for pattern, new, new_kind in reversed(rules):
        name, to = F.when(label.rlike(pattern), new).otherwise(name), F.when(label.rlike(pattern), new_kind).otherwise(to)
    return name, to


def families(text: Column, rules: Sequence[tuple[str, str]], default: str = "other") -> tuple[Column, Column]:
    """(all family labels in order, the first of them); a text of no family has the default."""
    found = all_rules(text, rules)
    found = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))
    return found, F.element_at(found, 1)


def family_match(a: Column, b: Column, family: Column, patterns: dict[str, str], wildcard: str) -> Column:
    """Whether either label is of the family; the wildcard is met by all."""
    out = F.lit(False)
    for name, p in patterns.items():
        out = F.when(family == name, a.rlike(p) | b.rlike(p)).otherwise(out)
    return F.when(family == wildcard, True).otherwise(out)


def term_present(text: Column, term: Column) -> Column:
    """Whether a term is in a text: short ones (four characters or fewer) between non-alphanumerics, others anywhere."""
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), term, F.lit(r"\E(?![a-z0-9])"))
    return F.when(F.length(term) <= 4, F.regexp_like(text, quoted)).otherwise(F.contains(text, term))


def short_label(x: Column, length: int) -> Column:
    return F.when(F.length(x) > length, F.concat(F.rtrim(F.substring(x, 1, length - 1)), F.lit("…"))).otherwise(x)


def split_claims(text: Column, least: int = 40) -> Column:
    """Claims between semicolons and line ends; a piece below `least` characters goes to the one before it."""
    parts = F.filter(F.transform(F.split(text, r"[;\n]+"), lambda p: F.trim(p)), lambda p: p != "")
    step = lambda acc, p: F.when((F.size(acc) > 0) & (F.length(p) < least), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("; "), p)))).otherwise(F.concat(acc, F.array(p)))
    return F.aggregate(parts, F.array().cast("array<string>"), step)
