"""Snapshots of a two-sided graph (levers and targets) at a cutoff: the grid, bridges, heuristics, states and matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import pair_weight
from .features import distances
from .order import running_sums
from .scratch import Scratch

#: Terms of the popularity baseline and of the graph heuristic, each scaled 0 to 1 by average rank.
POPULARITY = {"preferential_attachment_log": 0.45, "lever_recent_log": 0.25, "target_recent_log": 0.20, "lever_papers_log": 0.10}
FIXED = {
    "resource_allocation": 0.22, "adamic_adar": 0.16, "common_neighbors": 0.14, "jaccard": 0.10, "inverse_path": 0.10, "neighbor_fraction": 0.08,
    "lever_recent_log": 0.08, "lever_papers_log": 0.05, "target_recent_log": 0.04, "preferential_attachment_log": 0.03,
}
DEGREE_RECENCY = {"side_attachment_log": 0.40, "lever_recent_log": 0.20, "target_recent_log": 0.20, "lever_papers_log": 0.10, "target_papers_log": 0.10}
BRIDGED = {"ll_bridge": 0.30, "bb_bridge": 0.22, "context_bridge": 0.14, "inverse_path": 0.12, "lever_recent_log": 0.08, "target_recent_log": 0.06, "lever_papers_log": 0.05, "side_attachment_log": 0.03}


def rank01_scores(rows: DataFrame, key: Sequence[str], scores: dict[str, dict[str, float]]) -> DataFrame:
    """Adds one column a score: the weighted sum of its terms, each its average-tie rank scaled to 0..1 (0 for a single row).

    All terms are ranked in one range-partitioned pass over (term, value).
    """
    columns = sorted({c for terms in scores.values() for c in terms})
    long = rows.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.round(F.col(c).cast("double"), 9).alias("value")) for c in columns])).alias("x")).select(*key, "x.what", "x.value")
    ties = long.groupBy("what", "value").agg(F.count("*").alias("ties"))
    upto = running_sums(ties, [F.col("value")], {"ties": "upto"}, ["what"])
    n = upto.groupBy("what").agg(F.sum("ties").alias("n"))
    place = F.col("upto") - (F.col("ties") - 1) / 2
    ranked = upto.join(n, "what").select("what", "value", F.when(F.col("n") <= 1, F.lit(0.0)).otherwise((place - 1) / (F.col("n") - 1)).alias("r"))
    met = long.join(ranked, ["what", "value"])
    total = [F.sum(sum((F.when(F.col("what") == c, w * F.col("r")).otherwise(0.0) for c, w in terms.items()), F.lit(0.0))).alias(name) for name, terms in scores.items()]
    return rows.join(met.groupBy(*key).agg(*total), list(key))


def snapshot(sources: DataFrame, adoptions: DataFrame, papers: DataFrame, cutoff: int, observed: int) -> DataFrame:
    """Every lever and target that have not met by the cutoff, with neighbourhood, path, history and label.

    `sources` (lever, paper, year): the levers' own papers.  `adoptions` (lever, target,
    year): first meetings and later ones.  `papers` (target, paper, year): the
    targets' papers.  The graph has an edge between levers that share a source paper
    and between a lever and each target that took it up by the cutoff.
    """
    scratch = Scratch(sources.sparkSession, "snapshot")
    hist = scratch.save(sources.where(F.col("year") <= cutoff), "sources")
    took = scratch.save(adoptions.groupBy("lever", "target").agg(F.min("year").alias("first_year")), "adoptions")
    known = papers.where(F.col("year") <= cutoff)
    within = lambda a, b: F.count_distinct(F.when(F.col("year").between(cutoff - a, cutoff - b), F.col("paper")))
    lever = hist.groupBy("lever").agg(F.count_distinct("paper").alias("lever_papers"), within(2, 0).alias("lever_recent"), within(5, 3).alias("lever_previous"))
    target = known.groupBy("target").agg(F.count_distinct("paper").alias("target_papers"), within(2, 0).alias("target_recent"), within(5, 3).alias("target_previous"))
    past = took.where(F.col("first_year") <= cutoff)
    grid = scratch.save(lever.crossJoin(target).join(took, ["lever", "target"], "left").where(f"first_year is null or first_year > {cutoff}"), "grid")

    tag = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    a = hist.select("paper", "lever").distinct()
    co = a.join(a.withColumnRenamed("lever", "other"), "paper").where("lever < other").select(tag("lever:", "lever").alias("u"), tag("lever:", "other").alias("v")).distinct()
    graph = scratch.save(co.unionByName(past.select(tag("lever:", "lever").alias("u"), tag("target:", "target").alias("v"))), "graph")
    both = scratch.save(graph.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(graph.select(F.col("v").alias("a"), F.col("u").alias("b"))), "both")
    deg = both.groupBy("a").agg(F.count("*").alias("degree"), F.count_if(F.col("b").startswith("lever:")).alias("lever_degree"), F.count_if(F.col("b").startswith("target:")).alias("target_degree"))
    pairs = grid.select("lever", "target", tag("lever:", "lever").alias("u"), tag("target:", "target").alias("v"))
    wedge = pairs.join(both.select(F.col("a").alias("u"), F.col("b").alias("w")), "u").join(both.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"]).join(deg.select(F.col("a").alias("w"), "degree"), "w")
    d = F.col("degree")
    common = wedge.groupBy("lever", "target").agg(F.count("*").alias("common_neighbors"), F.sum(1 / F.log(F.greatest(F.lit(2), d).cast("double"))).alias("adamic_adar"), F.sum(1 / F.greatest(F.lit(1), d)).alias("resource_allocation"))
    far = distances(pairs.select("u", "v"), graph, 8, 9)
    out = grid.join(common, ["lever", "target"], "left").na.fill(0, ["common_neighbors", "adamic_adar", "resource_allocation"])
    out = out.withColumns({"u": tag("lever:", "lever"), "v": tag("target:", "target")}).join(far, ["u", "v"], "left")
    side = lambda c, name: deg.select(F.col("a").alias(c), F.col("degree").alias(f"{name}_degree"), F.col("lever_degree").alias(f"{name}_levers"), F.col("target_degree").alias(f"{name}_targets"))
    out = out.join(side("u", "l"), "u", "left").join(side("v", "t"), "v", "left").na.fill(0, [f"{x}_{y}" for x in "lt" for y in ("degree", "levers", "targets")])
    log = lambda c: F.log1p(F.col(c).cast("double"))
    return out.select(
        "lever", "target", F.when(F.lit(cutoff + 1 <= observed), F.coalesce(F.col("first_year") == cutoff + 1, F.lit(False)).cast("int")).alias("label"), "common_neighbors", F.round("adamic_adar", 9).alias("adamic_adar"), F.round("resource_allocation", 9).alias("resource_allocation"),
        F.round(F.col("common_neighbors") / F.greatest(F.lit(1), F.col("l_degree") + F.col("t_degree") - F.col("common_neighbors")), 9).alias("jaccard"), F.round(F.log1p((F.col("l_degree") * F.col("t_degree")).cast("double")), 9).alias("preferential_attachment_log"),
        F.col("distance").alias("shortest_path"), F.round(1 / (1 + F.col("distance")), 9).alias("inverse_path"), F.round(F.col("common_neighbors") / F.greatest(F.lit(1), F.col("l_levers")), 9).alias("neighbor_fraction"),
        F.col("l_targets").alias("lever_target_degree"), F.col("t_levers").alias("target_lever_degree"), F.round(F.log1p((F.col("l_targets") * F.col("t_levers")).cast("double")), 9).alias("side_attachment_log"),
        "lever_papers", "target_papers", F.round((F.col("lever_recent") - F.col("lever_previous")) / 3, 9).alias("lever_growth"), F.round((F.col("target_recent") - F.col("target_previous")) / 3, 9).alias("target_growth"),
        *[F.round(log(c), 9).alias(f"{c}_log") for c in ("lever_recent", "lever_papers", "target_recent", "target_papers")],
    )


def bridges(grid: DataFrame, adoptions: DataFrame, lever_docs: DataFrame, target_docs: DataFrame, contexts: DataFrame, cutoff: int) -> DataFrame:
    """(lever, target, ll_bridge, bb_bridge, context_bridge) of grid rows.

    A lever reaches a target through other levers that the target has, weighed by
    how often the two levers share documents, and through other targets that it is
    in; contexts (lever, target, context) give the contexts that both sides have.
    """
    scratch = Scratch(grid.sparkSession, "bridges")
    past = scratch.save(adoptions.where(F.col("year") <= cutoff).select("lever", "target").distinct(), "past")

    def weights(docs: DataFrame, item: str) -> DataFrame:
        held = docs.where(F.col("year") <= cutoff).select(F.col(item).alias("i"), "paper").distinct()
        n = held.groupBy("i").agg(F.count("*").alias("n"))
        both = held.join(held.withColumnRenamed("i", "j"), "paper").where("i <> j").groupBy("i", "j").agg(F.count("*").alias("k"))
        return both.join(n, "i").join(n.select(F.col("i").alias("j"), F.col("n").alias("m")), "j").select("i", "j", pair_weight(F.col("k"), F.col("n"), F.col("m")).alias("w"))

    pairs = grid.select("lever", "target")
    ll = pairs.join(past.withColumnRenamed("lever", "j"), "target").join(weights(lever_docs, "lever").withColumnRenamed("i", "lever"), ["lever", "j"]).groupBy("lever", "target").agg(F.sum("w").alias("ll_bridge"))
    bb = pairs.join(past.withColumnRenamed("target", "j"), "lever").join(weights(target_docs, "target").withColumnRenamed("i", "target"), ["target", "j"]).groupBy("lever", "target").agg(F.sum("w").alias("bb_bridge"))
    seen = contexts.where(F.col("year") <= cutoff)
    cc = pairs.join(seen.select("lever", "context").distinct(), "lever").join(seen.select("target", "context").distinct(), ["target", "context"]).groupBy("lever", "target").agg(F.count("*").alias("context_bridge"))
    out = pairs
    for one in (ll, bb, cc):
        out = out.join(one, ["lever", "target"], "left")
    return out.na.fill(0, ["ll_bridge", "bb_bridge", "context_bridge"]).select("lever", "target", F.round("ll_bridge", 9).alias("ll_bridge"), F.round("bb_bridge", 9).alias("bb_bridge"), "context_bridge")


def forecast(rows: DataFrame, score: str, tiers: Sequence[tuple[int, str]]) -> DataFrame:
    """Adds the place over all, the tier by place, and the scaled place within the target (0..1, best 1)."""
    every = running_sums(rows.withColumn("_one", F.lit(1).cast("long")), [F.desc(score), F.asc("lever"), F.asc("target")], {"_one": "place"})
    name = F.lit(None).cast("string")
    for most, label in sorted(tiers, reverse=True):
        name = F.when(F.col("place") <= most, label).otherwise(name)
    w = Window.partitionBy("target")
    r = F.rank().over(w.orderBy(score)) + (F.count("*").over(Window.partitionBy("target", score)) - 1) / 2
    n = F.count("*").over(w)
    return every.withColumn("tier", F.coalesce(name, F.lit("rest"))).withColumn("within_target", F.round(F.when(n <= 1, F.lit(0.0)).otherwise((r - 1) / (n - 1)), 9)).drop("_one")


def state_matrix(levers: DataFrame, targets: DataFrame, first: DataFrame, forecast_rows: DataFrame, cutoff: int, least: int) -> DataFrame:
    """Each lever and target with its state: observed, forecast, or insufficient (too few papers on a side)."""
    out = levers.crossJoin(targets).join(first, ["lever", "target"], "left").join(forecast_rows.select("lever", "target", "place"), ["lever", "target"], "left")
    enough = (F.col("lever_papers") >= least) & (F.col("target_papers") >= least)
    state = F.when(F.col("first_year") <= cutoff, "observed").when(~F.coalesce(enough, F.lit(False)), "insufficient").otherwise("forecast")
    return out.select("lever", "target", state.alias("state"), F.when(state == "observed", F.col("first_year")).alias("first_year"), F.when(state == "forecast", F.col("place")).alias("place"))


def block_weights(rows: DataFrame, block: Sequence[str]) -> DataFrame:
    """Adds w: every block weighs the same, and all weights average 1."""
    n = rows.groupBy(*block).agg(F.count("*").alias("_n"))
    totals = n.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_blocks"))
    return rows.join(n, list(block)).crossJoin(F.broadcast(totals)).withColumn("w", F.col("_rows") / (F.col("_blocks") * F.col("_n"))).drop("_n", "_rows", "_blocks")  # one row


def square_matrix(pairs: DataFrame, score: str, top_pairs: int, top_nodes: int) -> DataFrame:
    """(row, col, score) of the nodes that the best pairs touch most: both orientations, zero where no pair is."""
    best = pairs.orderBy(F.desc(score), "u", "v").limit(top_pairs)
    nodes = best.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(top_nodes).select("node")
    grid = nodes.withColumnRenamed("node", "row").crossJoin(nodes.withColumnRenamed("node", "col"))
    both = best.select(F.col("u").alias("row"), F.col("v").alias("col"), score).unionByName(best.select(F.col("v").alias("row"), F.col("u").alias("col"), score))
    return grid.join(both, ["row", "col"], "left").na.fill(0, [score])


def subgraph(pairs: DataFrame, score: str, edges: int, nodes: int) -> DataFrame:
    """The best `edges` pairs among the `nodes` of the largest weighted degree over the best 3 * `edges` pairs."""
    first = pairs.orderBy(F.desc(score), "u", "v").limit(3 * edges)
    heavy = first.select(F.explode(F.array("u", "v")).alias("node"), score).groupBy("node").agg(F.sum(score).alias("weight")).orderBy(F.desc(F.round("weight", 9)), "node").limit(nodes)
    keep = lambda c: heavy.select(F.col("node").alias(c))
    return first.join(keep("u"), "u", "left_semi").join(keep("v"), "v", "left_semi").orderBy(F.desc(score), "u", "v").limit(edges).select("u", "v", score)


def typed_rows(pairs: DataFrame, a: str, b: str, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Pairs with one end of either set of types, turned so that the left type comes first."""
    straight = F.col(a).isin(*left) & F.col(b).isin(*right)
    turned = F.col(b).isin(*left) & F.col(a).isin(*right)
    pick = lambda x, y: F.when(straight, F.col(x)).otherwise(F.col(y))
    return pairs.where(straight | turned).select(pick("u", "v").alias("left"), pick("v", "u").alias("right"), *[c for c in pairs.columns if c not in ("u", "v", a, b)])


def best_per_layer(rows: DataFrame, layer: str, score: str, key: Sequence[str], most: int) -> DataFrame:
    """The first `most` rows of each layer among those observed and those not, with their place."""
    w = Window.partitionBy(layer, "y").orderBy(F.desc(score), *key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def tile_tops(points: DataFrame, x: str, y: str, density: str, size: float, key: str) -> DataFrame:
    """The densest point of each tile of a grid over the plane."""
    low = points.agg(F.min(x).alias("_x"), F.min(y).alias("_y"))
    tiles = points.crossJoin(F.broadcast(low)).select(key, density, F.floor((F.col(x) - F.col("_x")) / size).alias("tile_x"), F.floor((F.col(y) - F.col("_y")) / size).alias("tile_y"))  # one row
    w = Window.partitionBy("tile_x", "tile_y").orderBy(F.desc(density), key)
    return tiles.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
