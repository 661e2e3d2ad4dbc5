"""Link-prediction frames: pair histories, time-cut graphs, candidates and their features.

Evidence is joined once and folded to one row a pair with the years in which each
layer joined it; the cutoff is a column from then on, so all folds come from the
same tables.  Neighbourhoods are arrays of packed node numbers and degrees that
are intersected in the JVM: with a graph of checked size the arrays are broadcast
and no wedge row is ever made; beyond that they are joined by node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import cosines, distances
from .graph import connected_components
from .order import pct_ranks, running_sums
from .scratch import Scratch

#: Bytes of neighbour arrays that are broadcast, at most.
BROADCAST_BYTES = 64 << 20
#: Hops beyond which a pair counts as apart, and the distance it then gets.
REACH, APART = 8, 9

#: Weights of the percentile ranks in the graph score; closeness is the negative distance.
GRAPH_SCORE = {"adamic_adar": 0.24, "common_neighbors": 0.18, "jaccard": 0.12, "preferential_attachment": 0.12, "closeness": 0.12, "semantic_similarity": 0.12, "recent_frequency_sum": 0.10}


def pair_years(facts: DataFrame, source: Sequence[str], target: Sequence[str]) -> DataFrame:
    """(u, v, source_years, target_years): the years in which papers of either group of layers joined each pair.

    Years are few, so the arrays stay short however often a pair comes.
    """
    a = facts.select("paper_id", "year", "layer", F.col("concept_id").alias("u"))
    b = facts.select("paper_id", F.col("concept_id").alias("v"))
    years = lambda layers: F.array_sort(F.collect_set(F.when(F.col("layer").isin(*layers), F.col("year"))))
    return a.join(b, "paper_id").where("u < v").groupBy("u", "v").agg(years(source).alias("source_years"), years(target).alias("target_years"))


def concept_years(facts: DataFrame, source: Sequence[str], target: Sequence[str]) -> DataFrame:
    """(concept_id, concept_type, year, source_papers, target_papers)."""
    n = lambda layers: F.count_distinct(F.when(F.col("layer").isin(*layers), F.col("paper_id")))
    return facts.groupBy("concept_id", "concept_type", "year").agg(n(source).alias("source_papers"), n(target).alias("target_papers"))


def cutoff_rows(rows: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    return rows.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))


def node_states(years: DataFrame, cutoffs: Sequence[int], papers: str = "source_papers", other: str = "target_papers") -> DataFrame:
    """(cutoff, node, type, papers, first_year, recent, previous, other_papers) of concepts known by each cutoff."""
    at = cutoff_rows(years, cutoffs).where(F.col("year") <= F.col("cutoff"))
    within = lambda a, b: F.sum(F.when(F.col("year").between(F.col("cutoff") - a, F.col("cutoff") - b), F.col(papers)).otherwise(0))
    return at.groupBy("cutoff", F.col("concept_id").alias("node"), F.col("concept_type").alias("type")).agg(
        F.sum(papers).alias("papers"), F.min(F.when(F.col(papers) > 0, F.col("year"))).alias("first_year"), within(2, 0).alias("recent"), within(5, 3).alias("previous"), F.sum(other).alias("other_papers")
    )


def cut_edges(pairs: DataFrame, cutoffs: Sequence[int], years: str = "source_years") -> DataFrame:
    """(cutoff, u, v) of the pairs that were joined by each cutoff."""
    return cutoff_rows(pairs, cutoffs).where(F.get(years, F.lit(0)) <= F.col("cutoff")).select("cutoff", "u", "v")


def _known(states: DataFrame, least: int, end: str) -> DataFrame:
    return states.where(F.col("papers") >= least).select("cutoff", F.col("node").alias(end))


def _label(years: str, horizon: int) -> Column:
    return F.exists(years, lambda y: (y > F.col("cutoff")) & (y <= F.col("cutoff") + horizon)).cast("int")


def transfer_candidates(pairs: DataFrame, states: DataFrame, cutoffs: Sequence[int], horizon: int, least: int = 2) -> DataFrame:
    """(cutoff, u, v, label): source pairs of frequent concepts that the target has not joined; the label says whether it does within the horizon."""
    at = cutoff_rows(pairs, cutoffs).where((F.get("source_years", F.lit(0)) <= F.col("cutoff")) & ((F.size("target_years") == 0) | (F.get("target_years", F.lit(0)) > F.col("cutoff"))))
    at = at.join(_known(states, least, "u"), ["cutoff", "u"], "left_semi").join(_known(states, least, "v"), ["cutoff", "v"], "left_semi")
    return at.select("cutoff", "u", "v", _label("target_years", horizon).alias("label"))


def _grid(u: DataFrame, v: DataFrame, parts: int = 64) -> DataFrame:
    """All rows of `u` with all of `v` of one cutoff: `u` is dealt over parts and `v` copied to each, so that few cutoffs are not few tasks."""
    dealt = u.withColumn("_p", F.pmod(F.xxhash64("u"), F.lit(parts)).cast("int"))
    return dealt.join(v.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["cutoff", "_p"]).drop("_p")


def self_candidates(pairs: DataFrame, states: DataFrame, cutoffs: Sequence[int], horizon: int, least: int = 2, years: str = "source_years") -> DataFrame:
    """(cutoff, u, v, label): all pairs of frequent concepts that are not joined by the cutoff.

    This is the reference's rule; the rows grow with the square of the frequent
    concepts, which `least` bounds.
    """
    u, v = _known(states, least, "u"), _known(states, least, "v")
    known = cut_edges(pairs, cutoffs, years)
    every = _grid(u, v).where("u < v").join(known, ["cutoff", "u", "v"], "left_anti")
    future = cutoff_rows(pairs, cutoffs).select("cutoff", "u", "v", _label(years, horizon).alias("label")).where("label = 1")
    return every.join(future, ["cutoff", "u", "v"], "left").na.fill(0, ["label"])


def neighbourhoods(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(cutoff, node, degree, around) and the bytes of `around`: sorted neighbours, each packed as its number and degree."""
    both = edges.select("cutoff", F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select("cutoff", F.col("v").alias("node"), F.col("u").alias("other")))
    both = scratch.save(both.distinct(), "both")
    degree = both.groupBy("cutoff", "node").agg(F.count("*").alias("degree"))
    names = degree.select("node").distinct().withColumn("one", F.lit(1).cast("long"))
    number = running_sums(names, [F.col("node")], {"one": "number"}).select(F.col("node").alias("other"), "number")
    packed = F.col("number") * F.lit(1 << 32) + F.col("other_degree")
    around = both.join(number, "other").join(degree.select("cutoff", F.col("node").alias("other"), F.col("degree").alias("other_degree")), ["cutoff", "other"]).groupBy("cutoff", "node").agg(F.array_sort(F.collect_list(packed)).alias("around"), F.count("*").alias("degree"))
    around = scratch.save(around, "around")
    return around, 8 * int(around.agg(F.sum("degree")).first()[0] or 0)


def neighbour_features(pairs: DataFrame, edges: DataFrame, scratch: Scratch | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`pairs` (with cutoff, u, v) and degree_u, degree_v, common_neighbors, jaccard, adamic_adar, resource_allocation, preferential_attachment, degree_balance."""
    scratch = scratch or Scratch(pairs.sparkSession, "neighbours")
    around, size = neighbourhoods(edges, scratch)
    out = pairs
    for end in ("u", "v"):
        side = around.select("cutoff", F.col("node").alias(end), F.col("around").alias(f"around_{end}"), F.col("degree").alias(f"degree_{end}"))
        out = out.join(F.broadcast(side) if size <= broadcast_bytes else side, ["cutoff", end], "left")
    none = F.array().cast("array<bigint>")
    a, b = (F.coalesce(f"around_{end}", none) for end in ("u", "v"))
    common = F.when(F.size(a) <= F.size(b), F.array_intersect(a, b)).otherwise(F.array_intersect(b, a))
    deg = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("double")
    total = lambda f: F.aggregate("common", F.lit(0.0), lambda s, x: s + f(deg(x)))
    out = out.withColumn("common", common).na.fill(0, ["degree_u", "degree_v"])
    out = out.withColumns({
        "common_neighbors": F.size("common").cast("long"), "adamic_adar": total(lambda d: 1 / F.log(F.greatest(F.lit(2.0), d))), "resource_allocation": total(lambda d: 1 / F.greatest(F.lit(1.0), d)),
        "preferential_attachment": F.col("degree_u") * F.col("degree_v"), "degree_balance": F.least("degree_u", "degree_v") / F.greatest(F.lit(1), F.greatest("degree_u", "degree_v")),
    })
    union = F.greatest(F.lit(1), F.col("degree_u") + F.col("degree_v") - F.col("common_neighbors"))
    return out.withColumn("jaccard", F.col("common_neighbors") / union).drop("common", "around_u", "around_v")


def paths(rows: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """`rows` and shortest_path (APART beyond REACH hops) and same_component.

    Joined pairs are one hop apart, others with a common neighbour two.  Only the
    rest are searched, all cutoffs at once, with the cutoff as part of a node.
    """
    joined = edges.select("cutoff", "u", "v", F.lit(1).alias("joined")).distinct()
    near = scratch.save(rows.join(joined, ["cutoff", "u", "v"], "left").withColumn("near", F.when(F.col("joined") == 1, 1).when(F.col("common_neighbors") > 0, 2)).drop("joined"), "near")
    rest = near.where("near is null")
    if rest.isEmpty():
        return near.withColumn("shortest_path", F.col("near")).withColumn("same_component", F.lit(1)).drop("near")
    tag = lambda c: F.struct(F.col("cutoff"), F.col(c).alias("n"))
    tagged = edges.select(tag("u").alias("u"), tag("v").alias("v"))
    far = scratch.save(distances(rest.select(tag("u").alias("u"), tag("v").alias("v")), tagged, REACH, APART), "far")
    found = far.select(F.col("u.cutoff").alias("cutoff"), F.col("u.n").alias("u"), F.col("v.n").alias("v"), "distance")
    out = near.join(found, ["cutoff", "u", "v"], "left").withColumn("shortest_path", F.coalesce("near", "distance")).drop("near", "distance")
    if far.where(F.col("distance") == APART).isEmpty():
        return out.withColumn("same_component", F.lit(1))
    part = connected_components(edges.select(F.to_json(tag("u")).alias("u"), F.to_json(tag("v")).alias("v")), scratch, "u", "v")
    for end in ("u", "v"):
        out = out.withColumn("tag", F.to_json(tag(end))).join(part.select(F.col("node").alias("tag"), F.col("component").alias(f"part_{end}")), "tag", "left").drop("tag")
    same = (F.col("shortest_path") < APART) | F.coalesce(F.col("part_u") == F.col("part_v"), F.lit(False))
    return out.withColumn("same_component", same.cast("int")).drop("part_u", "part_v")


def link_frame(candidates: DataFrame, edges: DataFrame, states: DataFrame, vectors: DataFrame, materials: Sequence[str], mechanisms: Sequence[str]) -> DataFrame:
    """All features of each candidate pair at its cutoff; `vectors` (node, dim, x) give the semantic similarity."""
    scratch = Scratch(candidates.sparkSession, "links")
    pairs, edges = scratch.save(candidates, "candidates"), scratch.save(edges, "edges")
    rows = paths(neighbour_features(pairs, edges, scratch), edges, scratch)
    for end in ("u", "v"):
        rows = rows.join(states.select("cutoff", F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("type", "papers", "first_year", "recent", "previous", "other_papers")]), ["cutoff", end], "left")
    rows = rows.join(cosines(pairs.select("u", "v").distinct(), vectors).withColumnRenamed("cosine", "semantic_similarity"), ["u", "v"])
    rows = rows.na.fill(0, [f"{c}_{end}" for c in ("papers", "recent", "previous", "other_papers") for end in ("u", "v")])
    a, b = F.col("papers_u"), F.col("papers_v")
    is_in = lambda end, kinds: F.coalesce(F.col(f"type_{end}").isin(*kinds), F.lit(False))
    um, vm, ux, vx = is_in("u", materials), is_in("v", materials), is_in("u", mechanisms), is_in("v", mechanisms)
    features = {
        "degree_min": F.least("degree_u", "degree_v"), "degree_max": F.greatest("degree_u", "degree_v"),
        "document_frequency_u": a, "document_frequency_v": b, "frequency_min": F.least(a, b), "frequency_max": F.greatest(a, b), "frequency_balance": F.least(a, b) / F.greatest(F.lit(1), F.greatest(a, b)),
        "recent_frequency_u": F.col("recent_u"), "recent_frequency_v": F.col("recent_v"), "recent_frequency_sum": F.col("recent_u") + F.col("recent_v"),
        "trend_u": (F.col("recent_u") - F.col("previous_u")) / 3, "trend_v": (F.col("recent_v") - F.col("previous_v")) / 3,
        "age_u": F.col("cutoff") - F.coalesce("first_year_u", "cutoff"), "age_v": F.col("cutoff") - F.coalesce("first_year_v", "cutoff"),
        "same_type": (F.col("type_u") == F.col("type_v")).cast("int"), "material_material_pair": (um & vm).cast("int"), "material_mechanism_pair": ((um & vx) | (vm & ux)).cast("int"), "mechanism_mechanism_pair": (ux & vx).cast("int"),
        "target_frequency_u": F.col("other_papers_u"), "target_frequency_v": F.col("other_papers_v"), "target_frequency_sum": F.col("other_papers_u") + F.col("other_papers_v"), "target_both_seen": ((F.col("other_papers_u") > 0) & (F.col("other_papers_v") > 0)).cast("int"),
    }
    kept = ["degree_u", "degree_v", "common_neighbors", "jaccard", "adamic_adar", "resource_allocation", "preferential_attachment", "degree_balance", "shortest_path", "same_component", "semantic_similarity"]
    exact = {c: F.round(c, 9) for c in ("jaccard", "adamic_adar", "resource_allocation", "semantic_similarity")}
    out = rows.select("cutoff", "u", "v", "label", F.col("type_u").alias("u_type"), F.col("type_v").alias("v_type"), *[exact.get(c, F.col(c)).alias(c) for c in kept], *[x.alias(c) for c, x in features.items()])
    return scratch.save(out, "frame")


def weighted_ranks(rows: DataFrame, key: Sequence[str], weights: dict[str, float], by: str, name: str) -> DataFrame:
    """Adds the weighted sum of average-tie percent ranks within `by`, all columns ranked in one pass."""
    ranks = pct_ranks(rows, key, list(weights), by).withColumn(name, sum((w * F.col(f"pr_{c}") for c, w in weights.items()), F.lit(0.0)))
    return rows.join(ranks.select(*key, by, name), [*key, by])


def graph_score(frame: DataFrame) -> DataFrame:
    """Adds graph_score: seven weighted percent ranks within each cutoff."""
    return weighted_ranks(frame.withColumn("closeness", -F.col("shortest_path")), ["u", "v"], GRAPH_SCORE, "cutoff", "graph_score").drop("closeness")


def risk_set(pairs: DataFrame, papers: DataFrame, states: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """Annual risk set: source pairs with both ends known to the target and not yet joined there, and the mean of five readiness ranks.

    `papers` has the source papers of each pair and year; `states` count the target's papers.
    """
    scratch = Scratch(pairs.sparkSession, "risk")
    at = cutoff_rows(papers, cutoffs).where(F.col("year") <= F.col("cutoff")).groupBy("cutoff", "u", "v").agg(F.sum("n").alias("source_papers"), F.sum(F.when(F.col("year") > F.col("cutoff") - 3, F.col("n")).otherwise(0)).alias("recent_papers"))
    known = pairs.select("u", "v", "target_years")
    at = at.join(known, ["u", "v"]).where((F.size("target_years") == 0) | (F.get("target_years", F.lit(0)) > F.col("cutoff")))
    for end in ("u", "v"):
        at = at.join(states.where("papers > 0").select("cutoff", F.col("node").alias(end), F.col("papers").alias(f"n_{end}")), ["cutoff", end])
    rows = at.select("cutoff", "u", "v", "source_papers", "recent_papers", F.exists("target_years", lambda y: y == F.col("cutoff") + 1).cast("int").alias("next_year"), F.least("n_u", "n_v").alias("target_frequency_min"))
    edges = scratch.save(cut_edges(pairs, cutoffs, "target_years"), "edges")
    rows = neighbour_features(scratch.save(rows, "rows"), edges, scratch).select(*rows.columns, F.col("common_neighbors").alias("target_common_neighbors"), F.round("jaccard", 9).alias("target_jaccard"))
    rows = scratch.save(rows, "featured")
    ranks = ("source_papers", "recent_papers", "target_frequency_min", "target_common_neighbors", "target_jaccard")
    return weighted_ranks(rows, ["u", "v"], dict.fromkeys(ranks, 0.2), "cutoff", "readiness")


def policy_candidates(pairs: DataFrame, states: DataFrame, cutoffs: Sequence[int], policy: str, least: int = 2, years: str = "source_years") -> DataFrame:
    """(cutoff, u, v) of unjoined pairs of known concepts under a policy.

    frontier: at least one end is recent (first seen within three years); near: two or
    three hops apart; broad: all.  The near pairs come from the graph, not from a grid.
    """
    edges = cut_edges(pairs, cutoffs, years)
    ok = states.where(F.col("papers") >= least)
    end = lambda c: ok.select("cutoff", F.col("node").alias(c), F.col("first_year").alias(f"first_{c}"))
    if policy == "near":
        both = edges.unionByName(edges.select("cutoff", F.col("v").alias("u"), F.col("u").alias("v")))
        hop = lambda rows: rows.withColumnRenamed("v", "w").join(both.withColumnRenamed("u", "w"), ["cutoff", "w"]).select("cutoff", "u", "v").distinct()
        two = hop(both)
        grid = two.unionByName(hop(two)).distinct().where("u < v").join(end("u"), ["cutoff", "u"]).join(end("v"), ["cutoff", "v"])
    else:
        grid = _grid(end("u"), end("v")).where("u < v")
    if policy == "frontier":
        grid = grid.where((F.col("first_u") > F.col("cutoff") - 3) | (F.col("first_v") > F.col("cutoff") - 3))
    return grid.select("cutoff", "u", "v").join(edges, ["cutoff", "u", "v"], "left_anti")


def donor_anchor(states: DataFrame, similar: DataFrame, cutoffs: Sequence[int], least: float, donors: Sequence[str], anchors: Sequence[str]) -> DataFrame:
    """(cutoff, donor, anchor, cosine): concepts of donor types that the target lacks beside similar concepts of anchor types that it has; pairs come from the similar ones, not from a grid."""
    d = states.where(F.col("type").isin(*donors) & (F.col("papers") > 0) & (F.col("other_papers") == 0)).select("cutoff", F.col("node").alias("donor"))
    a = states.where(F.col("type").isin(*anchors) & (F.col("other_papers") > 0)).select("cutoff", F.col("node").alias("anchor"))
    near = similar.where(F.col("cosine") >= least).select(F.col("a").alias("donor"), F.col("b").alias("anchor"), "cosine")
    return near.join(d, "donor").join(a, ["cutoff", "anchor"]).select("cutoff", "donor", "anchor", "cosine")
