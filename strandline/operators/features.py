"""Degrees, bounded distances and cosines over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def edges_until(evidence: DataFrame, cutoff: int) -> DataFrame:
    return evidence.where(F.col("year") <= cutoff).select("u", "v").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("a").agg(F.count("*").alias("degree")).withColumnRenamed("a", "node")


def distances(pairs: DataFrame, edges: DataFrame, most: int = 8, default: int = 9) -> DataFrame:
    """(u, v, distance) by breadth-first frontiers of at most `most` hops; unreached pairs get `default`.

    Only the sources that still lack a pair are carried on, and each frontier is written before the next.
    """
    scratch = Scratch(pairs.sparkSession, "bfs")
    both = scratch.save(both_ways(edges).distinct(), "edges")
    want = scratch.save(pairs.select("u", "v").distinct(), "want")
    seen = scratch.save(want.select(F.col("u").alias("s"), F.col("u").alias("x")).distinct().withColumn("d", F.lit(0)), "hop0")
    front, found = seen, want.where("u = v").withColumn("d", F.lit(0))
    for hop in range(1, most + 1):
        front = front.select("s", F.col("x").alias("a")).join(both, "a").select("s", F.col("b").alias("x")).distinct().join(seen, ["s", "x"], "left_anti").withColumn("d", F.lit(hop))
        front = scratch.save(front, f"hop{hop}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        hit = scratch.save(want.join(front.select(F.col("s").alias("u"), F.col("x").alias("v"), "d"), ["u", "v"]), f"hit{hop}")
        found = found.unionByName(hit)
        left = want.join(found, ["u", "v"], "left_anti").select(F.col("u").alias("s")).distinct()
        front = front.join(left, "s", "left_semi")
    return want.join(found, ["u", "v"], "left").select("u", "v", F.coalesce("d", F.lit(default)).alias("distance"))


def all_distances(edges: DataFrame, most: int = 8) -> DataFrame:
    """(u, v, distance) of all ordered pairs of nodes within `most` hops, a node and itself too; other pairs are further apart."""
    scratch = Scratch(edges.sparkSession, "hops")
    both = scratch.save(both_ways(edges).distinct(), "edges")
    seen = front = scratch.save(both.select(F.col("a").alias("s"), F.col("a").alias("x")).distinct().withColumn("d", F.lit(0)), "hop0")
    for hop in range(1, most + 1):
        front = front.select("s", F.col("x").alias("a")).join(both, "a").select("s", F.col("b").alias("x")).distinct().join(seen, ["s", "x"], "left_anti").withColumn("d", F.lit(hop))
        front = scratch.save(front, f"hop{hop}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.select(F.col("s").alias("u"), F.col("x").alias("v"), F.col("d").alias("distance"))


def twin_distances(nodes: DataFrame, node: str, group: list[str], place: str, reach: int, most: int = 8, block: int = 1000) -> DataFrame:
    """(u, v, distance) as `all_distances` over the graph that joins nodes of one group whose places differ by `reach` at most.

    Nodes with the same groups and places are twins: they are next to each other and as far from all others.  So
    distances are found between kinds of twins, and nodes take them over last, in lists of about `block` by as many.
    """
    scratch = Scratch(nodes.sparkSession, "twins")
    rows = nodes.select(node, *group, place).dropna()
    held = scratch.save(rows.groupBy(F.col(node).alias("node")).agg(F.array_sort(F.collect_set(F.struct(*group, place))).alias("kind")), "nodes")
    kinds = scratch.save(held.groupBy("kind").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "kinds")
    each = kinds.select("id", F.explode("kind").alias("k")).select("id", "k.*")
    a, b = each.select(F.col("id").alias("u"), *group, F.col(place).alias("_a")), each.select(F.col("id").alias("v"), *group, F.col(place).alias("_b"))
    edges = scratch.save(a.join(b, group).where((F.col("u") < F.col("v")) & (F.abs(F.col("_a") - F.col("_b")) <= reach)).select("u", "v").distinct(), "edges")
    twins = kinds.where("n > 1").select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(1).alias("distance"))
    apart = scratch.save(all_distances(edges, most).where("u <> v").unionByName(twins), "apart")
    members = held.join(kinds, "kind").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block)).cast("int"))
    lists = scratch.save(members.groupBy("id", "part").agg(F.collect_list("node").alias("nodes")), "lists")
    end = lambda c: lists.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part"), F.col("nodes").alias(f"{c}_nodes"))
    size = lambda c: kinds.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    total = apart.join(size("u"), "u").join(size("v"), "v").agg(F.sum(F.col("n_u") * F.col("n_v"))).first()[0] or 0
    met = apart.join(end("u"), "u").join(end("v"), "v").repartition(max(1, -(-total // (4 * block * block))), "u", "v", "u_part", "v_part")
    out = met.select(F.explode("u_nodes").alias("u"), "v_nodes", "distance").select("u", F.explode("v_nodes").alias("v"), "distance").where("u <> v")
    itself = members.join(apart.select(F.col("u").alias("id")).distinct(), "id", "left_semi").select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(0).alias("distance"))
    return out.unionByName(itself)


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(u, v, cosine) of pairs over sparse vectors (node, dim, x); 0 where nothing is shared."""
    norm = vectors.groupBy("node").agg(F.sum(F.col("x") * F.col("x")).alias("q"))
    end = lambda c: vectors.select(F.col("node").alias(c), "dim", F.col("x").alias(f"x_{c}"))
    q = lambda c: norm.select(F.col("node").alias(c), F.col("q").alias(f"q_{c}"))
    dot = pairs.select("u", "v").join(end("u"), "u").join(end("v"), ["v", "dim"]).groupBy("u", "v").agg(F.sum(F.col("x_u") * F.col("x_v")).alias("dot"))
    out = dot.join(q("u"), "u").join(q("v"), "v").select("u", "v", (F.col("dot") / F.sqrt(F.col("q_u") * F.col("q_v"))).alias("cosine"))
    return pairs.select("u", "v").join(out, ["u", "v"], "left").na.fill(0, ["cosine"])


def label_vectors(facts: DataFrame) -> DataFrame:
    """(node, dim, x): counts of the character trigrams of each concept's label and type."""
    label = F.lower(F.concat_ws(" | ", "concept_id", "concept_type"))
    each = facts.select("concept_id", "concept_type").distinct().select(F.col("concept_id").alias("node"), label.alias("l"))
    grams = F.transform(F.sequence(F.lit(1), F.length("l") - 2), lambda i: F.substring(F.col("l"), i, F.lit(3)))
    return each.where(F.length("l") >= 3).select("node", F.explode(grams).alias("dim")).groupBy("node", "dim").agg(F.count("*").alias("x"))
