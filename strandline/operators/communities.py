"""Typed graphs and their views, communities, themes and node adoption.

Degrees, paths, modularity and agreement are aggregates over edge tables.
`spread_louvain` is steps over tables for a graph of any size; `louvain` is the
sequential method, a task a seed, for many seeds over a graph of a stated size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Edges that a sequential run takes at most.
EDGES = 2_000_000


def typed_degrees(edges: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(node, out_<kind>, in_<kind>, degree) of typed directed edges (src, dst, kind)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit("out").alias("way")), F.struct(F.col("dst").alias("node"), F.lit("in").alias("way")))).alias("x"), "kind").select("x.*", "kind")
    n = lambda way, k: F.count_if((F.col("way") == way) & (F.col("kind") == k))
    return ends.groupBy("node").agg(*[n(way, k).alias(f"{way}_{k}") for k in kinds for way in ("out", "in")], F.count("*").alias("degree"))


def union_graph(parts: Sequence[DataFrame]) -> DataFrame:
    """Edges (src, dst, kind, weight) of several tables; equal edges fold, their weights add."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"))


def add_layer(nodes: DataFrame, edges: DataFrame, extra: DataFrame, relation_kinds: dict[str, str], default: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with a layer of relations (src, dst, relation): relations become edge kinds, unknown ends become nodes."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in relation_kinds.items() for x in kv])[F.col("relation")], F.lit(default))
    fresh = extra.select("src", "dst", kind.alias("kind"), F.lit(1.0).alias("weight")).distinct()
    ends = fresh.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    more = ends.join(nodes, "node", "left_anti").withColumn("type", F.lit("paper"))
    return nodes.unionByName(more.select(*nodes.columns)), union_graph([edges, fresh])


def evidence_paths(evidence: DataFrame, programs: DataFrame, weight: Column) -> DataFrame:
    """(evidence_id, path, weight): source --supports--> program --acts_on--> target, a row an evidence; evidence of no program keeps its source alone."""
    out = evidence.join(programs, "program", "left")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    whole = F.concat_ws(" ", node("paper", "paper"), F.lit("--supports-->"), node("program", "program"), F.lit("--acts_on-->"), node("target", "target"))
    return out.select("evidence_id", F.when(F.col("target").isNotNull(), whole).otherwise(node("paper", "paper")).alias("path"), weight.alias("weight"))


def projection(members: DataFrame, item: str, group: str) -> DataFrame:
    """(a, b, weight): items that share groups, and how many."""
    held = members.select(F.col(item).alias("i"), F.col(group).alias("g")).distinct()
    return held.withColumnRenamed("i", "a").join(held.withColumnRenamed("i", "b"), "g").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def backfill(rows: DataFrame, repair: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Missing or blank cells filled from the repair table, and how many were."""
    r = repair.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(r, key, "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    filled = sum(((blank(c) & F.col(f"_{c}").isNotNull()).cast("int") for c in columns), F.lit(0))
    kept = [F.when(blank(c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return out.select(*kept, filled.alias("filled"))


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(edges, modularity) of a partition (node, part) of undirected edges (u, v, weight): sum of e_cc - a_c^2."""
    of = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"p_{c}"))
    met = edges.join(of("u"), "u").join(of("v"), "v")
    inside = met.groupBy().agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("p_u") == F.col("p_v"), F.col("weight")).otherwise(0)).alias("within"), F.count("*").alias("edges"))
    ends = met.select(F.explode(F.array("p_u", "p_v")).alias("part"), "weight").groupBy("part").agg(F.sum("weight").alias("k"))
    share = ends.agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return inside.crossJoin(share).select("edges", (F.col("within") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, ari): agreement of two partitions of the same rows, from the counts of their cells."""
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("k")).agg(two("k").alias(name))
    flat = cells.agg(two("n").alias("both"), F.sum("n").alias("n")).crossJoin(side(a, "x")).crossJoin(side(b, "y"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    expected = F.col("x") * F.col("y") / pairs
    most = (F.col("x") + F.col("y")) / 2
    return flat.select("n", F.when(most == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def louvain_parts(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, nodes: int, seed: int) -> np.ndarray:
    """The community of each node: local moves in a seeded order until none gains, then the same over communities."""
    rng = np.random.default_rng(seed)
    label = np.arange(nodes)
    u, v, w = src.astype(np.int64), dst.astype(np.int64), weight.astype(float)
    total = w.sum()
    while total > 0:
        n = int(max(u.max(initial=-1), v.max(initial=-1))) + 1 if len(u) else 0
        a, b, x = np.concatenate([u, v[u != v]]), np.concatenate([v, u[u != v]]), np.concatenate([w, w[u != v]])
        order = np.argsort(a, kind="stable")
        a, b, x = a[order], b[order], x[order]
        start = np.searchsorted(a, np.arange(n + 1))
        k = np.bincount(u, w, n) + np.bincount(v, w, n)  # a loop counts twice
        part, held = np.arange(n), k.copy()
        moved = True
        any_move = False
        while moved:
            moved = False
            for i in rng.permutation(n):
                near, links = b[start[i] : start[i + 1]], x[start[i] : start[i + 1]]
                other = near != i
                if not other.any():
                    continue
                found, at = np.unique(part[near[other]], return_inverse=True)
                gain = np.bincount(at, links[other])
                own = part[i]
                held[own] -= k[i]
                value = gain - k[i] * held[found] / (2 * total)
                stay = (gain[found == own].sum() if (found == own).any() else 0.0) - k[i] * held[own] / (2 * total)
                best = int(value.argmax())
                if value[best] > stay + 1e-12:
                    part[i], moved, any_move = found[best], True, True
                held[part[i]] += k[i]
        if not any_move:
            break
        names, part = np.unique(part, return_inverse=True)
        label = part[label] if len(label) and n else label
        lo, hi = np.minimum(part[u], part[v]), np.maximum(part[u], part[v])
        key, at = np.unique(lo * len(names) + hi, return_inverse=True)
        u, v, w = key // len(names), key % len(names), np.bincount(at, w)
    return label


def louvain(edges: DataFrame, seeds: Sequence[int], most: int = EDGES) -> DataFrame:
    """(seed, node, part): Louvain communities of undirected edges (u, v, weight) for each seed; a part is named by its smallest node.

    One run is sequential, so the graph is taken to one task a seed; graphs of more than `most` edges are refused.
    """
    spark = edges.sparkSession
    folded = edges.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    if folded.count() > most:
        raise ValueError(f"more than {most} edges")
    kind = edges.schema["u"].dataType.simpleString()
    table = folded.orderBy("u", "v").toPandas()
    held = spark.sparkContext.broadcast(table)

    def run(frames):
        t = held.value
        names, codes = np.unique(np.concatenate([t["u"].to_numpy(), t["v"].to_numpy()]), return_inverse=True)
        for f in frames:
            for seed in f["seed"]:
                part = louvain_parts(codes[: len(t)], codes[len(t) :], t["weight"].to_numpy(), len(names), int(seed))
                least = pd.Series(names).groupby(part).min()
                yield pd.DataFrame({"seed": seed, "node": names, "part": least.loc[part].to_numpy()})

    rows = spark.createDataFrame([(int(s),) for s in seeds], "seed int").repartition(min(len(seeds), 64))
    return rows.mapInPandas(run, f"seed int, node {kind}, part {kind}")


def _moves(both: DataFrame, nodes: DataFrame, doubled: float, seed: int, turn: int) -> DataFrame:
    """nodes (node, k, part) after one step: each allowed node goes to the neighbouring part with the largest gain, if it beats staying.

    Half of the nodes, by a hash of node, seed and step, may move in a step, so that
    neighbours seldom change places; of two single nodes the larger one moves.
    """
    totals = nodes.groupBy("part").agg(F.sum("k").alias("total"), F.count("*").alias("members"))
    links = both.join(nodes.select(F.col("node").alias("b"), F.col("part").alias("p")), "b").groupBy("a", "p").agg(F.sum("w").alias("links"))
    own = nodes.join(totals, "part").withColumns({"alone": F.col("members") == 1}).select(F.col("node").alias("a"), "k", F.col("part").alias("own"), F.col("total").alias("own_total"), "alone")
    rows = links.join(own, "a").join(totals.select(F.col("part").alias("p"), "total", (F.col("members") == 1).alias("p_alone")), "p")
    here = F.col("p") == F.col("own")
    value = F.round(F.col("links") - F.col("k") * (F.col("total") - F.when(here, F.col("k")).otherwise(0)) / doubled, 9)
    stay = F.round(-F.col("k") * (F.col("own_total") - F.col("k")) / doubled, 9)
    fair = ~(F.col("alone") & F.col("p_alone") & (F.col("p") > F.col("own")))
    best = rows.withColumn("value", value).groupBy("a").agg(F.min(F.when(~here & fair, F.struct((-F.col("value")).alias("v"), "p"))).alias("best"), F.max(F.when(here, F.col("value"))).alias("with_own"), F.first(stay).alias("without"))
    better = best.where(-F.col("best.v") > F.coalesce("with_own", "without") + 1e-9)
    allowed = F.pmod(F.xxhash64("a", F.lit(seed), F.lit(turn)), F.lit(2)) == 0
    to = better.select(F.col("a").alias("node"), F.col("best.p").alias("to"), allowed.alias("go"))
    return nodes.join(to, "node", "left").select("node", "k", F.when(F.col("go"), F.col("to")).otherwise(F.col("part")).alias("part"), F.col("to").isNotNull().alias("wants"))


def _quality(both: DataFrame, loops: DataFrame, nodes: DataFrame, doubled: float) -> float:
    part = lambda end: nodes.select(F.col("node").alias(end), F.col("part").alias(f"p_{end}"))
    inside = both.join(part("a"), "a").join(part("b"), "b").where("p_a = p_b").agg(F.sum("w")).first()[0] or 0.0
    looped = loops.agg(F.sum("w")).first()[0] or 0.0
    squares = nodes.groupBy("part").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return (inside + 2 * looped) / doubled - squares / doubled**2


def spread_louvain(edges: DataFrame, seed: int, steps: int = 30, patience: int = 3, least: float = 1e-6) -> DataFrame:
    """(node, part): Louvain communities of undirected edges (u, v, weight) by synchronous steps over tables; a part is named by its smallest node.

    No task and not the driver sees more than rows and sums.  A level ends when no
    node wants to move or when `patience` steps raise modularity by less than `least`; the best
    step counts.  Then parts become nodes, and inner edges loops, until a level gains nothing.
    Repeated edges add up, loops are left out, a graph without edges gives no rows.
    """
    scratch = Scratch(edges.sparkSession, "louvain")
    level = edges.where("u <> v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
    level = scratch.save(level, "level")
    member = scratch.save(level.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("part", F.col("node")), "member")
    doubled = 2 * (level.agg(F.sum("w")).first()[0] or 0.0)
    reached = -1.0
    while doubled:
        between, loops = level.where("a <> b"), level.where("a = b")
        both = scratch.save(between.unionByName(between.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "both")
        k = both.select("a", "w").unionByName(loops.select("a", (2 * F.col("w")).alias("w"))).groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
        nodes = scratch.save(k.select("node", "k", F.col("node").alias("part")), "nodes")
        best, quality, idle = nodes, _quality(both, loops, nodes, doubled), 0
        for turn in range(steps):
            stepped = scratch.save(_moves(both, nodes, doubled, seed, turn), "step")
            nodes = stepped.drop("wants")
            now = _quality(both, loops, nodes, doubled)
            idle = 0 if now > quality + least else idle + 1
            if now > quality:
                best, quality = nodes, now
            if idle >= patience or not stepped.where("wants").head(1):
                break
        if quality <= reached + least:
            break
        reached = quality
        named = scratch.save(best.groupBy("part").agg(F.min("node").alias("name")).join(best.select("node", "part"), "part").select("node", "name"), "named")
        member = scratch.save(member.join(named.select(F.col("node").alias("part"), "name"), "part").select("node", F.col("name").alias("part")), "member")
        to = lambda end: named.select(F.col("node").alias(end), F.col("name").alias(f"n_{end}"))
        met = level.join(to("a"), "a").join(to("b"), "b")
        level = scratch.save(met.groupBy(F.least("n_a", "n_b").alias("a"), F.greatest("n_a", "n_b").alias("b")).agg(F.sum("w").alias("w")), "level")
    names = member.groupBy("part").agg(F.min("node").alias("name"))
    return member.join(names, "part").select("node", F.col("name").alias("part"))


def rand_indices(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, n, ari): the adjusted Rand index of two partitions within each group, all groups in one pass."""
    cells = rows.groupBy(by, a, b).agg(F.count("*").alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    side = lambda c, name: cells.groupBy(by, c).agg(F.sum("n").alias("k")).groupBy(by).agg(two("k").alias(name))
    flat = cells.groupBy(by).agg(two("n").alias("both"), F.sum("n").alias("n")).join(side(a, "x"), by).join(side(b, "y"), by)
    expected, most = F.col("x") * F.col("y") / (F.col("n") * (F.col("n") - 1) / 2), (F.col("x") + F.col("y")) / 2
    return flat.select(by, "n", F.when(F.col("n") < 2, 1.0).otherwise(F.when(most == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (most - expected))).alias("ari"))


def stability(edges: DataFrame, nodes: DataFrame, thresholds: Sequence[float], seeds: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """How much communities depend on the seed and on the least weight of an edge.

    (threshold, nodes, edges, parts, parts_beyond_one, modularity_mean, modularity_sd, ari_mean, ari_min) against
    the first seed, and (left, right, ari) between the best partitions of two thresholds: that
    of largest modularity, then the smallest seed.  Nodes without an edge are parts of their own.
    """
    scratch = Scratch(edges.sparkSession, "stability")
    edges = scratch.save(edges, "edges")
    tables, best = [], {}
    for t in thresholds:
        kept = edges.where(F.col("weight") >= t)
        runs = louvain(kept, seeds)
        every = nodes.select("node").distinct().crossJoin(F.broadcast(edges.sparkSession.createDataFrame([(int(s),) for s in seeds], "seed int")))  # a row a seed
        runs = scratch.save(every.join(runs, ["seed", "node"], "left").select("seed", "node", F.coalesce("part", "node").alias("part")), "runs")
        of = lambda c: runs.select("seed", F.col("node").alias(c), F.col("part").alias(f"p_{c}"))
        met = kept.join(of("u"), "u").join(of("v"), ["seed", "v"])
        inside = met.groupBy("seed").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("p_u") == F.col("p_v"), F.col("weight")).otherwise(0)).alias("within"))
        ends = met.select("seed", F.explode(F.array("p_u", "p_v")).alias("part"), "weight").groupBy("seed", "part").agg(F.sum("weight").alias("k")).groupBy("seed").agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
        quality = inside.join(ends, "seed").select("seed", F.round(F.col("within") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m")), 12).alias("modularity"))
        first = runs.where(F.col("seed") == seeds[0]).select("node", F.col("part").alias("first"))
        each = scratch.save(rand_indices(runs.join(first, "node"), "seed", "first", "part").join(quality, "seed", "left"), "each")
        top = each.orderBy(F.desc_nulls_last("modularity"), "seed").first()
        chosen = best[t] = runs.where(F.col("seed") == (seeds[0] if top is None else top.seed)).select("node", F.col("part").alias(f"part_{t}"))
        parts = chosen.groupBy(f"part_{t}").agg(F.count("*").alias("n")).agg(F.count("*").alias("parts"), F.count_if(F.col("n") > 1).alias("parts_beyond_one"))
        size = kept.agg(F.count("*").alias("edges"))
        figures = each.agg(F.avg("modularity").alias("modularity_mean"), F.stddev_pop("modularity").alias("modularity_sd"), F.avg("ari").alias("ari_mean"), F.min("ari").alias("ari_min"))
        tables.append(figures.crossJoin(parts).crossJoin(size).crossJoin(nodes.agg(F.count_distinct("node").alias("nodes"))).select(F.lit(float(t)).alias("threshold"), "nodes", "edges", "parts", "parts_beyond_one", "modularity_mean", "modularity_sd", "ari_mean", "ari_min"))
    pairs = [rand_indices(best[a].join(best[b], "node").withColumn("by", F.lit(0)), "by", f"part_{a}", f"part_{b}").select(F.lit(float(a)).alias("left"), F.lit(float(b)).alias("right"), "ari") for i, a in enumerate(thresholds) for b in thresholds[i + 1 :]]
    whole = lambda frames: reduce(lambda x, y: x.unionByName(y), frames)
    return whole(tables), whole(pairs)


def adoption_frame(nodes: DataFrame, edges: DataFrame, active: DataFrame, similar: DataFrame) -> DataFrame:
    """Each node not yet active with its weighted degree, exposure (weight to active nodes), active neighbours, and mean and largest similarity to active nodes.

    edges (u, v, weight) undirected; active (node); similar (a, b, cosine).
    """
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other"), "weight").unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other"), "weight"))
    lit = active.select(F.col("node").alias("other"), F.lit(1).alias("on")).distinct()
    near = both.join(lit, "other", "left").groupBy("node").agg(F.sum("weight").alias("weighted_degree"), F.sum(F.when(F.col("on") == 1, F.col("weight")).otherwise(0)).alias("exposure"), F.count("on").alias("active_neighbors"))
    cos = similar.select(F.col("a").alias("node"), F.col("b").alias("other"), "cosine").join(lit, "other").groupBy("node").agg(F.avg("cosine").alias("mean_cosine"), F.max("cosine").alias("max_cosine"))
    rest = nodes.join(active, "node", "left_anti")
    out = rest.join(near, "node", "left").join(cos, "node", "left").na.fill(0, ["weighted_degree", "exposure", "active_neighbors", "mean_cosine", "max_cosine"])
    return out.withColumn("exposure_share", F.col("exposure") / F.greatest(F.lit(1), F.col("weighted_degree")))


def graph_audit(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str]) -> dict[str, DataFrame]:
    """Frames of offending rows: repeated nodes, dangling ends, loops, repeated edges, unknown kinds."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return {
        "node_repeated": nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "end_without_node": ends.join(nodes, "node", "left_anti"), "loop": edges.where("src = dst"),
        "edge_repeated": edges.groupBy("src", "dst", "kind").agg(F.count("*").alias("n")).where("n > 1"), "kind_unknown": edges.where(~F.col("kind").isin(*kinds)),
    }


def first_edge_examples(evidence: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """(u, v, papers, example): pairs in a window of years and the paper that shows them first."""
    rows = evidence if years is None else evidence.where(F.col("year").between(*years))
    return rows.groupBy("u", "v").agg(F.count_distinct("paper_id").alias("papers"), F.min_by("paper_id", F.struct("year", "paper_id")).alias("example"))


def layered_years(pairs: DataFrame, cutoff: int) -> DataFrame:
    """(u, v, all_first, source_first, target_first, lead, past, future): a pair's first years by layer up to and after a cutoff; a pair seen before is never a future one."""
    first = lambda c: F.get(F.filter(c, lambda y: y <= cutoff), F.lit(0))
    later = lambda c: F.exists(c, lambda y: y > cutoff)
    s, t = first("source_years"), first("target_years")
    past = s.isNotNull() | t.isNotNull()
    return pairs.select("u", "v", F.least(s, t).alias("all_first"), s.alias("source_first"), t.alias("target_first"), (t - s).alias("lead"), past.cast("int").alias("past"), (~past & (later("source_years") | later("target_years"))).cast("int").alias("future"))


def stable_labels(parts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Parts numbered from 0 by size, then by their smallest node: the label vector of a partition."""
    n = parts.groupBy(*order, "part").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    w = Window.partitionBy(*order).orderBy(F.desc("n"), "least") if order else Window.orderBy(F.desc("n"), "least")
    return parts.join(n.withColumn("label", F.row_number().over(w) - 1).select(*order, "part", "label"), [*order, "part"])
