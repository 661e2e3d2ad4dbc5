"""Aggregates over facts, pairs and papers: modes, lists, quantiles, status tables, registries, coverage and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import distances
from .order import running_sums
from .tiles import common


def mode_by(rows: DataFrame, by: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group; of equals the smallest.  mode() leaves ties open."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(name), F.max("n").alias(f"{name}_n"))


def top_values(rows: DataFrame, by: str, value: str, k: int, sep: str = "; ") -> DataFrame:
    """(by, top): the k most frequent values of each group with their counts, packed in order."""
    n = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), value)
    few = n.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)
    shown = F.concat(F.col(value).cast("string"), F.lit(":"), F.col("n").cast("string"))
    return few.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", shown.alias("v")))), lambda x: x["v"]), sep).alias("top"))


def packed_lists(rows: DataFrame, by: str, value: str, lists: dict[str, Column], sep: str = "; ") -> DataFrame:
    """One sorted distinct list a named condition, packed; groups are small (a paper's concepts)."""
    return rows.groupBy(by).agg(*[F.array_join(F.array_sort(F.collect_set(F.when(test, F.col(value)))), sep).alias(name) for name, test in lists.items()])


def quantiles(rows: DataFrame, value: str, by: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation by group, from running counts of distinct values: no group is held whole."""
    ties = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("ties"))
    upto = running_sums(ties, [F.col("v")], {"ties": "upto"}, [by])
    n = ties.groupBy(by).agg(F.sum("ties").alias("n"))
    at = upto.join(n, by)
    place = lambda q: (F.col("n") - 1) * F.lit(q)
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    out = at.groupBy(by, "n").agg(*[x for name, q in qs.items() for x in (first(F.floor(place(q))).alias(f"_a_{name}"), first(F.ceil(place(q))).alias(f"_b_{name}"))])
    return out.select(by, *[(F.col(f"_a_{c}") + (F.col(f"_b_{c}") - F.col(f"_a_{c}")) * (place(q) - F.floor(place(q)))).alias(c) for c, q in qs.items()])


def describe(rows: DataFrame, value: str, by: str) -> DataFrame:
    """count, mean, sample standard deviation, min, quartiles and max by group, all exact."""
    flat = rows.groupBy(by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return flat.join(quantiles(rows, value, by, {"q25": 0.25, "median": 0.5, "q75": 0.75}), by, "left")


def status_table(rows: DataFrame, by: str, status: str, values: Sequence[str], share: str) -> DataFrame:
    """Counts of each status as columns, zero-filled, the total, and the share of one status."""
    out = rows.groupBy(by).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values], F.count("*").alias("total"))
    return out.withColumn("ratio", F.col(share) / F.col("total"))


def type_matrix(rows: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """(a, b, n, best) of unordered type pairs, whichever way round they come."""
    x, y = F.least(a, b), F.greatest(a, b)
    return rows.groupBy(x.alias("type_a"), y.alias("type_b")).agg(F.count("*").alias("n"), F.max(score).alias("best"))


def weighted_degrees(pairs: DataFrame, weight: str) -> DataFrame:
    """(node, degree, weighted_degree) of undirected pairs (u, v)."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node"), F.col(weight).alias("w"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("w").alias("weighted_degree"))


def node_registry(banks: dict[str, DataFrame]) -> DataFrame:
    """(node, and for each bank its pairs, papers and best pair's papers, and in_all) of every end of any pair."""
    each = None
    for name, bank in banks.items():
        one = bank.select(F.explode(F.array("u", "v")).alias("node"), "papers", F.lit(name).alias("bank"))
        each = one if each is None else each.unionByName(one)
    aggs = [x for name in banks for x in (F.count_if(F.col("bank") == name).alias(f"{name}_pairs"), F.sum(F.when(F.col("bank") == name, F.col("papers")).otherwise(0)).alias(f"{name}_papers"), F.coalesce(F.max(F.when(F.col("bank") == name, F.col("papers"))), F.lit(0)).alias(f"{name}_best"))]
    return each.groupBy("node").agg(*aggs, (F.count_distinct("bank") == len(banks)).alias("in_all"))


def layer_roles(facts: DataFrame, by: str = "concept_type") -> DataFrame:
    """Concepts of each type: all, in both layers, and in one alone."""
    of = lambda layer: F.max((F.col("layer").isin(layer, "hybrid")).cast("int"))
    each = facts.groupBy(by, "concept_id").agg(of("source").alias("s"), of("target").alias("t"), F.count_distinct("paper_id").alias("papers"))
    return each.groupBy(by).agg(F.count("*").alias("concepts"), F.sum(F.col("s") * F.col("t")).alias("shared"), F.sum(F.col("s") * (1 - F.col("t"))).alias("source_only"), F.sum(F.col("t") * (1 - F.col("s"))).alias("target_only"), F.sum("papers").alias("mentions"))


def paper_audit(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Counts of each paper in one pass a table: concepts, types, pairs and pairs across types; zero where it has none."""
    own = facts.groupBy("paper_id").agg(F.count_distinct("concept_id").alias("concepts"), F.count_distinct("concept_type").alias("types"))
    pairs = evidence.groupBy("paper_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("u_type") != F.col("v_type")).alias("mixed_pairs"))
    return own.join(pairs, "paper_id", "left").na.fill(0, ["pairs", "mixed_pairs"])


def coverage_status(papers: DataFrame, claims: DataFrame, programs: DataFrame, freeze: int) -> DataFrame:
    """Each paper's numbers of claims and programs, and its status: outside the window, covered, claimed or empty."""
    c = claims.groupBy("paper_id").agg(F.count("*").alias("claims"))
    p = programs.groupBy("paper_id").agg(F.count_distinct("program").alias("programs"))
    out = papers.join(c, "paper_id", "left").join(p, "paper_id", "left").na.fill(0, ["claims", "programs"])
    return out.withColumn("status", F.when(F.col("year") > freeze, "after_freeze").when(F.col("programs") > 0, "in_program").when(F.col("claims") > 0, "claims_only").otherwise("no_claim"))


def knowledge_flow(facts: DataFrame) -> DataFrame:
    """Concepts whose first target year comes after their first source year, with the lag."""
    first = lambda layer: F.min(F.when(F.col("layer") == layer, F.col("year")))
    each = facts.groupBy("concept_id").agg(first("source").alias("source_year"), first("target").alias("target_year"))
    return each.where("target_year > source_year").withColumn("lag", F.col("target_year") - F.col("source_year"))


def emergent_edges(evidence: DataFrame, split: int, least: int = 1, most: int = 8) -> DataFrame:
    """Pairs that join after `split` only, with papers, first papers and their distance in the early graph."""
    early = evidence.where(F.col("year") <= split).select("u", "v").distinct()
    late = evidence.where(F.col("year") > split).groupBy("u", "v").agg(F.count_distinct("paper_id").alias("papers"), F.min_by("paper_id", F.struct("year", "paper_id")).alias("first_paper"))
    fresh = late.where(F.col("papers") >= least).join(early, ["u", "v"], "left_anti")
    return fresh.join(distances(fresh.select("u", "v"), early, most).withColumnRenamed("distance", "early_distance"), ["u", "v"])


def gated(facts: DataFrame, least: int, most: int, keep: Column | None = None) -> DataFrame:
    """Concepts with `least` to `most` papers, or that `keep` names whatever their count, with the mode of their layers."""
    df = facts.groupBy("concept_id").agg(F.count_distinct("paper_id").alias("df"), F.min("year").alias("first_year"))
    inside = F.col("df").between(least, most)
    return df.where(inside | keep if keep is not None else inside).join(mode_by(facts, ["concept_id"], "layer", "layer_mode").drop("layer_mode_n"), "concept_id")


def specific_concepts(facts: DataFrame, least: int, most: int, top: int) -> DataFrame:
    """The `top` concepts of a frequency gate by log frequency times specificity 1 / (1 + log10 df)."""
    df = facts.groupBy("concept_id").agg(F.count_distinct("paper_id").alias("df")).where(F.col("df").between(least, most))
    score = F.round(F.log1p("df") / (1 + F.log10("df")), 9)
    return df.withColumn("score", score).orderBy(F.desc("score"), "concept_id").limit(top)


def percentile_split(rows: DataFrame, value: str, q: float, above: str, below: str) -> DataFrame:
    """Adds `part`: `above` where the value exceeds the exact q quantile of all rows."""
    cut = quantiles(rows.select(F.lit(1).alias("g"), value), value, "g", {"cut": q}).select("cut")
    return rows.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col(value) > F.col("cut"), above).otherwise(below))  # one row


def shared_pairs(rows: DataFrame, item: str, shared: Sequence[str]) -> DataFrame:
    """(a, b, kind, n): pairs of items that share values of each named column, and how many, counted by tiles of items."""
    out = None
    for c in shared:
        held = rows.select(F.col(item).alias("i"), F.col(c).cast("string").alias("x")).where("i is not null and x is not null").distinct()
        one = common(held).select("a", "b", F.lit(c).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def support_table(rows: DataFrame, by: str, paper: str, weight: Column) -> DataFrame:
    """(by, evidence, papers, weighted_support, hhi): support of each program, and how concentrated it is in single papers."""
    n = rows.groupBy(by, paper).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    return n.groupBy(by).agg(F.sum("n").alias("evidence"), F.count("*").alias("papers"), F.sum("w").alias("weighted_support"), (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi"))


def axis_order(rows: DataFrame, end: str) -> DataFrame:
    """Ends of scored pairs in display order: predicted, positives, best score, rows."""
    n = rows.groupBy(F.col(end).alias("label")).agg(F.sum("predicted").alias("predicted"), F.sum("y").alias("positives"), F.max("score").alias("best"), F.count("*").alias("n"))
    order = [F.desc("predicted"), F.desc("positives"), F.desc("best"), F.desc("n"), F.asc("label")]
    return running_sums(n.withColumn("_one", F.lit(1).cast("long")), order, {"_one": "place"}).drop("_one")


def bounded_ngrams(docs: DataFrame, key: str, text: str, sizes: tuple[int, int], least: int, most_share: float, stop: Sequence[str]) -> DataFrame:
    """(gram, df) of word n-grams in `least` documents or more and at most a share of all; n-grams of stop words at either end are left out."""
    from ..functions.text import tokens
    from . import grams

    split = grams.dealt(docs, key, text).select(key, tokens(text).alias("words"))
    df = grams.counted(grams.runs(split, [key], "words", sizes, stop), key, docs="df")
    total = docs.agg(F.count("*").alias("docs"))
    return df.crossJoin(F.broadcast(total)).where((F.col("df") >= least) & (F.col("df") <= F.col("docs") * most_share)).select("gram", "df")
