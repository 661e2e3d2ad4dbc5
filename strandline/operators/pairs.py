"""Typed concept facts, co-occurrence pairs and pair banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import strength


#: Lines of a part.
PART_ROWS = 250_000


def parts(lines: DataFrame) -> int:
    """How many parts the lines, and what is made of them by paper or pair, are dealt into: a task's rows stay the same as the input grows.

    Left to themselves, plans deal by the bytes that are shuffled, and lines become many more bytes as pairs.
    """
    return max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // PART_ROWS))


def facts_from_orders(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Distinct (paper_id, concept_id, concept_type, year, layer): an order is a paper, brand and size a concept.

    The priority gives the layer: two classes are the source, two the target, one is both (hybrid).
    """
    papers = orders.select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"), layer_of(F.col("o_orderpriority")).alias("layer"))
    concepts = part.select("p_partkey", F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("concept_id"), F.concat(F.lit("T"), F.substring("p_brand", 7, 1)).alias("concept_type"))
    held = lineitem.select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("p_partkey"))
    return held.join(concepts, "p_partkey").repartition(parts(lineitem), "paper_id").join(papers, "paper_id").select("paper_id", "concept_id", "concept_type", "year", "layer").distinct()


def layer_of(priority: Column) -> Column:
    return F.when(priority.isin("1-URGENT", "2-HIGH"), "source").when(priority.isin("4-NOT SPECIFIED", "5-LOW"), "target").otherwise("hybrid")


def layer_facts(facts: DataFrame, layer: str, membership: str = "inclusive") -> DataFrame:
    """Facts of a layer; inclusive counts hybrid papers in both layers, exclusive in neither."""
    return facts.where(F.col("layer").isin(layer, "hybrid") if membership == "inclusive" else F.col("layer") == layer)


def pair_evidence(facts: DataFrame) -> DataFrame:
    """One row a paper and unordered pair of its concepts, u < v."""
    a = facts.select("paper_id", "year", F.col("concept_id").alias("u"), F.col("concept_type").alias("u_type")).distinct()
    b = facts.select("paper_id", F.col("concept_id").alias("v"), F.col("concept_type").alias("v_type")).distinct()
    return a.join(b, "paper_id").where("u < v").select("u", "v", "u_type", "v_type", "year", "paper_id")


def pair_summary(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("u", "v").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("paper_id").alias("papers"), F.min_by("paper_id", F.struct("year", "paper_id")).alias("first_paper"))


def pair_bank(evidence: DataFrame, examples: int = 5, parts: int | None = None) -> DataFrame:
    """Summary with strength and the first papers' ids, joined in order; pairs are dealt into `parts`.

    Only the first `examples` ids of a pair are listed, which is the feature: they
    are ranked with a group limit, never collected whole.
    """
    evidence = evidence.repartition(parts, "u", "v") if parts else evidence
    first = Window.partitionBy("u", "v").orderBy("year", "paper_id")
    listed = evidence.select("u", "v", "year", "paper_id", F.row_number().over(first).alias("k")).where(F.col("k") <= examples)
    listed = listed.groupBy("u", "v").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "paper_id"))), lambda x: x["paper_id"].cast("string")), "; ").alias("first_papers"))
    return pair_summary(evidence).join(listed, ["u", "v"]).withColumn("strength", strength(F.col("papers")))


def kth_support(evidence: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    """(u, v, support_year, support_paper): the k-th evidence of each pair by year and paper; pairs are dealt into `parts`."""
    evidence = evidence.repartition(parts, "u", "v") if parts else evidence
    w = Window.partitionBy("u", "v").orderBy("year", "paper_id")
    return evidence.select("u", "v", "year", "paper_id", F.row_number().over(w).alias("k")).where(F.col("k") == k).select("u", "v", F.col("year").alias("support_year"), F.col("paper_id").alias("support_paper"))


def vocabulary(facts: DataFrame, least: int = 2) -> DataFrame:
    """Document frequencies over all and by layer, years, the latest paper and whether a concept may be predicted."""
    held = lambda *layers: F.max((F.col("layer").isin(*layers) & F.col("paper_id").isNotNull()).cast("long"))
    papers = facts.groupBy("concept_id", "concept_type", "paper_id").agg(held("source", "hybrid").alias("s"), held("target", "hybrid").alias("t"), F.min("year").alias("low"), F.max("year").alias("high"))  # a concept's papers, before anything is counted
    return papers.groupBy("concept_id", "concept_type").agg(
        F.count("paper_id").alias("df"), F.coalesce(F.sum("s"), F.lit(0)).alias("source_df"), F.coalesce(F.sum("t"), F.lit(0)).alias("target_df"),
        F.min("low").alias("first_year"), F.max("high").alias("last_year"), F.max_by("paper_id", F.struct("high", "paper_id")).alias("latest_paper"),
    ).withColumn("eligible", F.col("df") >= least)


def trend(facts: DataFrame, cutoff: int) -> DataFrame:
    """Distinct papers up to the cutoff, in the last three and the three years before, trend and age."""
    in_years = lambda a, b: F.count_distinct(F.when(F.col("year").between(a, b), F.col("paper_id")))
    out = facts.where(F.col("year") <= cutoff).groupBy("concept_id").agg(F.count_distinct("paper_id").alias("freq"), in_years(cutoff - 2, cutoff).alias("recent"), in_years(cutoff - 5, cutoff - 3).alias("previous"), F.min("year").alias("first_year"))
    return out.select("concept_id", "freq", "recent", "previous", ((F.col("recent") - F.col("previous")) / 3).alias("trend"), (cutoff - F.col("first_year")).alias("age"))


def overlap(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs of both banks, side by side."""
    s = source.select("u", "v", F.col("papers").alias("source_papers"), F.col("first_year").alias("source_first"))
    t = target.select("u", "v", F.col("papers").alias("target_papers"), F.col("first_year").alias("target_first"))
    return s.join(t, ["u", "v"])


def status(source: DataFrame, target: DataFrame) -> DataFrame:
    """Full outer join of two pair summaries with the diffusion status and the lag in years."""
    s = source.select("u", "v", F.col("first_year").alias("source_year"), F.col("papers").alias("source_papers"))
    t = target.select("u", "v", F.col("first_year").alias("target_year"), F.col("papers").alias("target_papers"))
    a, b = F.col("source_year"), F.col("target_year")
    cascade = F.when(a.isNull(), "target_only").when(b.isNull(), "not_in_target").when(b < a, "target_before_source").when(b == a, "same_year").otherwise("source_then_target")
    return s.join(t, ["u", "v"], "full").withColumn("status", cascade).withColumn("lag_years", F.when(b > a, b - a))


def cooccurrence(facts: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, both, n_a, n_b, jaccard) of items that share a group."""
    held = facts.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null").distinct()
    n = held.groupBy("i").agg(F.count("*").alias("n"))
    both = held.withColumnRenamed("i", "a").join(held.withColumnRenamed("i", "b"), "g").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    out = both.join(n.select(F.col("i").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("i").alias("b"), F.col("n").alias("n_b")), "b")
    return out.select("a", "b", "both", "n_a", "n_b", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("jaccard"))


def hinges(source: DataFrame, target: DataFrame, top: int = 20) -> DataFrame:
    """Pairs of two banks that share a concept and differ at both other ends; each side's best `top` pairs of a concept meet.

    Both sides are cut by rank first (a group limit), so a hub concept adds at most top * top rows.
    """
    ends = lambda bank, name: _ends(bank, name).where(F.col(f"{name}_rank") <= top)
    return ends(source, "source").join(ends(target, "target"), "shared").where("source_other <> target_other")


def _ends(bank: DataFrame, name: str) -> DataFrame:
    each = bank.select(F.explode(F.array(F.struct(F.col("u").alias("shared"), F.col("v").alias("other")), F.struct(F.col("v").alias("shared"), F.col("u").alias("other")))).alias("x"), "papers").select("x.*", "papers")
    w = Window.partitionBy("shared").orderBy(F.desc("papers"), "other")
    return each.select("shared", F.col("other").alias(f"{name}_other"), F.col("papers").alias(f"{name}_papers"), F.row_number().over(w).alias(f"{name}_rank"))


def all_tiers(source: DataFrame, target: DataFrame, strong: int = 3, chunk: int = 256) -> DataFrame:
    """The rows of `tiers` over every source x target combination of a shared concept, none cut.

    A combination's tier and place depend on its two paper counts and names alone,
    so tier ranks come from running sums over the source ends and are not sorted
    out of the combinations.  Target ends of a concept and count are dealt in
    chunks, so a hub concept is joined in many parts.
    """
    s, t = _ends(source, "source"), _ends(target, "target")
    t = t.withColumn("place", F.row_number().over(Window.partitionBy("shared", "target_papers").orderBy("target_other")))
    own = t.select("shared", F.col("target_other").alias("source_other"), F.col("target_papers").alias("own_papers"), F.col("place").alias("own_place"))
    kinds = t.groupBy("shared", "target_papers").agg(F.count("*").alias("n"))
    low, high = F.least("source_papers", "target_papers"), F.greatest("source_papers", "target_papers")
    itself = F.coalesce(F.col("own_papers") == F.col("target_papers"), F.lit(False))
    blocks = s.join(own, ["shared", "source_other"], "left").join(kinds, "shared").withColumns({"tier": F.when(low >= strong, "A").when(high >= strong, "B").otherwise("C"), "support": low, "own_place": F.when(itself, F.col("own_place"))})
    before = Window.partitionBy("shared", "tier").orderBy(F.desc("support"), F.desc(high), "source_other").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum(F.col("n") - itself.cast("int")).over(before), F.lit(0)))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk).cast("int")))).drop("own_papers", "n")
    out = blocks.join(t.withColumn("part", F.floor((F.col("place") - 1) / chunk).cast("int")), ["shared", "target_papers", "part"]).where("source_other <> target_other")
    rank = F.col("before") + F.col("place") - F.coalesce(F.col("own_place") < F.col("place"), F.lit(False)).cast("int")
    return out.select("shared", "source_other", "source_papers", "source_rank", "target_other", "target_papers", "target_rank", "tier", "support", rank.alias("tier_rank"))


def tiers(candidates: DataFrame, strong: int = 3) -> DataFrame:
    """Tier by the weaker and stronger side, and the rank by support within shared concept and tier."""
    low, high = F.least("source_papers", "target_papers"), F.greatest("source_papers", "target_papers")
    tier = F.when(low >= strong, "A").when(high >= strong, "B").otherwise("C")
    out = candidates.withColumn("tier", tier).withColumn("support", low)
    w = Window.partitionBy("shared", "tier").orderBy(F.desc("support"), F.desc(high), "source_other", "target_other")
    return out.withColumn("tier_rank", F.row_number().over(w))


def balanced_queue(tiered: DataFrame, each: int = 5) -> DataFrame:
    """All of the tiers A and B, and the best `each` of C a shared concept."""
    return tiered.where((F.col("tier") != "C") | (F.col("tier_rank") <= each))
