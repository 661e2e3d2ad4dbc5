"""Links over audited neighbours and curated programs, and candidate endpoint pairs rolled up from paths, with a review overlay.

A path is a source pair and a target pair on a shared node; its far ends are a
candidate pair of endpoints, oriented from source to target.  Paths are made by
`transfer.met`, in parts, and folded by endpoint pair in one aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import strength
from ..functions.text import lookup
from . import tiles
from .order import running_sums
from .transfer import FAMILY, REVIEWED, bridge_score, cross_bucket, ends, link_type, met

#: The base of a program's bridge, what roles at either side add, the weights of support, and the most links of a program.
PROGRAM_BASE = 0.79
FAR_BONUS = {"mechanism": 0.075, "structure_state": 0.065, "material_system": 0.050, "outcome_property": 0.025}
GROUND_BONUS = {True: 0.075, False: 0.070}
SUPPORT_WEIGHTS = (0.025, 0.015)
PROGRAM_LINKS = 20
#: What reviews make of a side.
ACCEPTED, REJECTED, PENDING, NONE = "direct_sentence_relation_accepted", "machine_relation_rejected_retain_cooccurrence_only", "machine_relation_pending_semantic_review", "cooccurrence_only"


def both_ways(neighbours: DataFrame) -> DataFrame:
    """(node, near, similarity) from an audit's (left, right, similarity), each row read from either end; of equal pairs the most similar."""
    each = neighbours.select(F.col("left").alias("node"), F.col("right").alias("near"), "similarity").unionByName(neighbours.select(F.col("right").alias("node"), F.col("left").alias("near"), "similarity"))
    return each.where("node <> near").groupBy("node", "near").agg(F.max("similarity").alias("similarity"))


def family_links(source: DataFrame, target: DataFrame, audit: DataFrame, roles: DataFrame, df: DataFrame) -> DataFrame:
    """Links from a target pair's end to source pairs on its audited neighbours.

    A link is known by both pairs, its type and its anchor: the target's end, or
    the whole pair where source and target pair are the same.  Of several ways to
    one link the most similar neighbour is kept, then the first by name.

    An anchor has two ways to a source pair only if both of its ends are near, which is settled
    between anchors and source pairs, before target pairs come in; two anchors have ways to one link only
    if both pairs are the same.  So links are made without a shuffle of their own.
    """
    near = both_ways(audit)
    value = lambda c: F.coalesce(F.col(c), F.lit(float("-inf")))
    rival = near.select(F.col("node").alias("shared"), F.col("near").alias("source_other"), value("similarity").alias("_rival"))
    kinds = roles.select(F.col("node").alias("shared"), "role", link_type(F.col("role"), F.lit(False), family=True).alias("link_type")).groupBy("shared", "link_type").agg(F.min("role").alias("role"))
    ways = ends(source, "source").withColumnRenamed("shared", "near").join(near.withColumnRenamed("node", "shared"), "near").join(rival, ["shared", "source_other"], "left")
    beaten = (F.col("_rival") > value("similarity")) | ((F.col("_rival") == value("similarity")) & (F.col("source_other") < F.col("near")))
    ways = ways.where(~F.coalesce(beaten, F.lit(False))).drop("_rival")
    ways = ways.join(kinds, "shared", "left").join(df.select(F.col("node").alias("shared"), "shared_df"), "shared", "left")
    ways = ways.withColumn("link_type", F.coalesce("link_type", F.lit(FAMILY["outcome_property"])))
    t = ends(target, "target")
    other = met(ways, t).where("source_pair <> target_pair").withColumn("anchor", F.col("shared"))
    same = ways.join(t, (ways["shared"] == t["shared"]) & (F.col("source_pair") == F.col("target_pair"))).drop(t["shared"])
    first = Window.partitionBy("target_pair", "link_type").orderBy(F.desc("similarity"), "near", "shared")  # two rows at most
    same = same.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k").withColumn("anchor", F.lit("__full_pair__"))
    rows = other.unionByName(same).withColumnRenamed("shared", "anchor_node")
    score = bridge_score(F.col("link_type"), strength(F.col("source_papers")), strength(F.col("target_papers")), F.coalesce("shared_df", F.lit(1)), F.col("similarity"))
    return rows.withColumn("bridge_score", score)


def source_lane(programs: DataFrame, declared: DataFrame, source: DataFrame, evidence: DataFrame) -> DataFrame:
    """(program, source columns, aligned): source pairs on a program's lever whose papers meet the papers it declares.

    programs: (program, lever, ...); declared: (program, paper_id); evidence: (u, v, paper_id) of the source layer.
    Papers are met as postings: a pair is never compared with a program it shares no paper with.
    """
    asked = declared.join(programs.select("program", "lever"), "program").distinct()
    hits = evidence.select("u", "v", "paper_id").distinct().join(asked, "paper_id").where((F.col("u") == F.col("lever")) | (F.col("v") == F.col("lever")))
    hits = hits.groupBy("program", "lever", "u", "v").agg(F.array_sort(F.collect_set("paper_id")).alias("aligned"))  # papers declared by one program
    far = F.when(F.col("u") == F.col("lever"), F.col("v")).otherwise(F.col("u"))
    return hits.join(source, ["u", "v"]).select("program", far.alias("source_other"), F.concat_ws("~", "u", "v").alias("source_pair"), F.col("papers").alias("source_papers"), "aligned")


def target_lane(programs: DataFrame, target: DataFrame, evidence: DataFrame, roles: DataFrame, family_ok: Column) -> DataFrame:
    """(program, target columns, grounded): target pairs that hold a program's baseline paper, fit its family and join a material to a mechanism or structure.

    `family_ok` is over u, v and the program's columns.
    """
    hits = evidence.select("u", "v", "paper_id").distinct().join(programs.withColumnRenamed("baseline", "paper_id"), "paper_id").where(family_ok)
    role = lambda end: roles.select(F.col("node").alias(end), F.col("role").alias(f"{end}_role"))
    pair = F.array("u_role", "v_role")
    held = hits.join(role("u"), "u").join(role("v"), "v").where(F.array_contains(pair, "material_system") & F.arrays_overlap(pair, F.array(F.lit("mechanism"), F.lit("structure_state"))))
    return held.join(target, ["u", "v"]).select("program", F.concat_ws("~", "u", "v").alias("target_pair"), F.col("papers").alias("target_papers"), F.array_contains(pair, "mechanism").alias("by_mechanism")).distinct()


def program_bridges(sources: DataFrame, targets: DataFrame, roles: DataFrame, most: int = PROGRAM_LINKS) -> DataFrame:
    """The best `most` links of each program: its source lane with its target lane, by score, papers and names."""
    s = sources.join(roles.select(F.col("node").alias("source_other"), "role"), "source_other", "left").withColumnRenamed("program", "shared")
    t = targets.withColumnRenamed("program", "shared").withColumn("target_other", F.col("target_pair"))
    rows = met(s, t)
    raw = F.lit(PROGRAM_BASE) + lookup(F.col("role"), FAR_BONUS, 0.0) + F.when(F.col("by_mechanism"), GROUND_BONUS[True]).otherwise(GROUND_BONUS[False]) + SUPPORT_WEIGHTS[0] * strength(F.col("source_papers")) + SUPPORT_WEIGHTS[1] * strength(F.col("target_papers"))
    rows = rows.withColumn("bridge_score", F.round(F.least(raw, F.lit(0.99)), 4))
    best = Window.partitionBy("shared").orderBy(F.desc("bridge_score"), F.desc("source_papers"), F.desc("target_papers"), "source_pair", "target_pair")
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).withColumnRenamed("shared", "program").drop("target_other")


def reviewed_bank(bank: DataFrame, relations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A layer's bank with what reviews make of each pair: `strict` relations, and its `status`.

    relations: (u, v, relation_id); verdicts: (relation_id, verdict).  A relation without a verdict is pending.
    """
    return judged_bank(bank, relations.join(verdicts, "relation_id", "left"))


def judged_bank(bank: DataFrame, judged: DataFrame) -> DataFrame:
    """`reviewed_bank` of relations that have their verdict beside them: (u, v, relation_id, verdict)."""
    n = judged.groupBy("u", "v").agg(F.count_distinct("relation_id").alias("strict"), F.max((F.col("verdict") == "accepted").cast("int")).alias("_yes"), F.max((F.col("verdict") == "rejected").cast("int")).alias("_no"))
    out = bank.join(n, ["u", "v"], "left")
    status = F.when(F.col("_yes") == 1, ACCEPTED).when(F.col("_no") == 1, REJECTED).when(F.col("strict") > 0, PENDING).otherwise(NONE)
    return out.select(*bank.columns, F.coalesce("strict", F.lit(0)).alias("strict"), status.alias("status"))


def base_grade(rows: DataFrame) -> DataFrame:
    """Adds grade_order and base_order of paths from both sides' status and strict relations, and the weaker support."""
    count = lambda test: test("source").cast("int") + test("target").cast("int")
    yes, strict = count(lambda x: F.col(f"{x}_status") == ACCEPTED), count(lambda x: F.col(f"{x}_strict") > 0)
    weaker = {f"min_{c}": F.least(f"source_{c}", f"target_{c}") for c in ("papers", "sentences")}
    return rows.withColumns({"grade_order": 3 - yes, "base_order": 3 - strict, **weaker})


def paths(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every path of two reviewed banks, graded."""
    keep = ["u", "v", "papers", "sentences", "strict", "status"]
    return base_grade(met(ends(source.select(*keep), "source"), ends(target.select(*keep), "target")).where("source_other <> target_other"))


def hubness(source: DataFrame, target: DataFrame) -> DataFrame:
    """(shared, hubness): the paths over each shared node, counted from its ends without making them."""
    s, t = ends(source.select("u", "v"), "s").select("shared", F.col("s_other").alias("other")), ends(target.select("u", "v"), "t").select("shared", F.col("t_other").alias("other"))
    n = lambda f, name: f.groupBy("shared").agg(F.count("*").alias(name))
    out = n(s, "a").join(n(t, "b"), "shared").join(n(s.join(t, ["shared", "other"]), "c"), "shared", "left")
    return out.select("shared", (F.col("a") * F.col("b") - F.coalesce("c", F.lit(0))).alias("hubness"))


def fold(rows: DataFrame) -> DataFrame:
    """One row a pair of endpoints: counts of paths by grade, the best and worst grade, and the best path."""
    at = lambda k: F.count_if(F.col("grade_order") == k).alias(f"r{3 - k}_paths")
    best = F.min(F.struct("grade_order", (-F.col("min_papers")).alias("p"), (-F.col("min_sentences")).alias("s"), "shared")).alias("_b")
    out = rows.groupBy(F.col("source_other").alias("source_end"), F.col("target_other").alias("target_end")).agg(at(1), at(2), at(3), best)
    return ordered(out.withColumns({"best_shared": F.col("_b.shared"), "best_papers": -F.col("_b.p"), "best_sentences": -F.col("_b.s")}).drop("_b"))


def ordered(folded: DataFrame) -> DataFrame:
    """Adds all paths, and the best and worst grade with its name, to the counts by grade."""
    has = lambda k: F.col(f"r{3 - k}_paths") > 0
    levels = {v[1]: v[0] for v in REVIEWED.values()}
    out = folded.withColumns({"paths": F.col("r2_paths") + F.col("r1_paths") + F.col("r0_paths"), "best_order": F.when(has(1), 1).when(has(2), 2).otherwise(3), "worst_order": F.when(has(3), 3).when(has(2), 2).otherwise(1)})
    best = reduce(lambda x, k: F.when(F.col("best_order") == k, F.col(f"r{3 - k}_paths")).otherwise(x), (1, 2, 3), F.lit(0))
    out = out.withColumns({"best_grade": lookup(F.col("best_order"), levels), "worst_grade": lookup(F.col("worst_order"), levels), "best_paths": best})
    return out.select("source_end", "target_end", "paths", "best_order", "worst_order", "r2_paths", "r1_paths", "r0_paths", "best_grade", "worst_grade", "best_paths", "best_shared", "best_papers", "best_sentences")


def folded_paths(source: DataFrame, target: DataFrame, keys: DataFrame | None = None, side: int = tiles.SIDE) -> DataFrame:
    """`fold` of `paths` by tiles of endpoint pairs, so that no path becomes a row; of the pairs in `keys` alone, if given."""
    keep = lambda bank, name: ends(bank.select("u", "v", F.col("papers").cast("long").alias("papers"), F.col("sentences").cast("long").alias("sentences"), (F.col("status") == ACCEPTED).cast("long").alias("yes")), name)
    s, t = keep(source, "source"), keep(target, "target")
    if keys is not None:
        s = s.join(keys.select(F.col("source_end").alias("source_other")).distinct(), "source_other", "left_semi")
        t = t.join(keys.select(F.col("target_end").alias("target_other")).distinct(), "target_other", "left_semi")
    out = tiles.best_paths(s, t, side)
    return ordered(out if keys is None else out.join(keys, ["source_end", "target_end"], "left_semi"))


def placed(folded: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Adds where the endpoint pair itself was observed, how often its best path's node is passed, and whether the mirrored pair is a candidate too."""
    seen = lambda bank, name: bank.select(F.col("u").alias("lo"), F.col("v").alias("hi"), F.lit(f"in_{name}").alias(f"{name}_seen"))
    out = folded.withColumns({"lo": F.least("source_end", "target_end"), "hi": F.greatest("source_end", "target_end")})
    out = out.join(seen(source, "source"), ["lo", "hi"], "left").join(seen(target, "target"), ["lo", "hi"], "left").na.fill({"source_seen": "not_in_source", "target_seen": "not_in_target"})
    out = out.withColumn("bucket", cross_bucket(F.col("source_seen"), F.col("target_seen"), ("not_in_source", "not_in_target"), ("in_source", "in_target")))
    out = out.join(hubness(source, target).withColumnRenamed("shared", "best_shared"), "best_shared")
    mirror = folded.select(F.col("target_end").alias("source_end"), F.col("source_end").alias("target_end"), F.lit(True).alias("mirrored"))
    return out.join(mirror, ["source_end", "target_end"], "left").na.fill({"mirrored": False}).drop("lo", "hi", "source_seen", "target_seen")


def touched(source: DataFrame, target: DataFrame, changed_source: DataFrame, changed_target: DataFrame) -> DataFrame:
    """(source_end, target_end): endpoint pairs that a path over a changed pair leads to; changed_*: (u, v)."""
    only = lambda bank, rows: bank.select("u", "v").join(rows.select("u", "v").distinct(), ["u", "v"], "left_semi")
    way = lambda s, t: tiles.ways(ends(s.select("u", "v"), "source"), ends(t.select("u", "v"), "target")).select("source_end", "target_end")
    return way(only(source, changed_source), target).unionByName(way(source, only(target, changed_target))).distinct()


def overlaid(folded: DataFrame, source: DataFrame, target: DataFrame, keys: DataFrame) -> DataFrame:
    """`folded` with the endpoint pairs of `keys` folded again from newly reviewed banks; no other ends are met."""
    again = folded_paths(source, target, keys).select(*folded.columns)
    return folded.join(keys, ["source_end", "target_end"], "left_anti").unionByName(again)


def incident_relations(source: DataFrame, target: DataFrame, in_focus: DataFrame, relations: DataFrame) -> DataFrame:
    """(layer, shared, pair, relation_id, paths, dual_paths, review_order): relations of pairs that lie on paths in focus, in order of review.

    relations: (layer, u, v, paper_id, relation_id).  A pair with a relation is on a path of the first
    tier with every pair across that has one, and of the second with every other; these are counted from the
    node's ends, less the pair's own far end, so no path is made.  Review goes by layer, node, paper and relation.
    """
    node_ok = in_focus.where("shared_focus").select(F.col("node").alias("shared"))
    far_ok = in_focus.where("other_focus").select(F.col("node").alias("other"))

    def side(bank: DataFrame) -> DataFrame:
        e = ends(bank.select("u", "v", "relations"), "x").select("shared", F.col("x_other").alias("other"), F.col("x_pair").alias("pair"), (F.col("x_relations") > 0).cast("long").alias("has"))
        return e.join(node_ok, "shared", "left_semi").join(far_ok, "other", "left_semi")

    out = None
    for layer, own, across in (("source", side(source), side(target)), ("target", side(target), side(source))):
        totals = across.groupBy("shared").agg(F.count("*").alias("n"), F.sum("has").alias("nh"))
        itself = across.select("shared", "other", F.lit(1).alias("mine"), F.col("has").alias("mine_has"))
        rows = own.where("has = 1").join(totals, "shared").join(itself, ["shared", "other"], "left").na.fill(0, ["mine", "mine_has"])
        rows = rows.select(F.lit(layer).alias("layer"), "shared", "pair", (F.col("n") - F.col("mine")).alias("paths"), (F.col("nh") - F.col("mine_has")).alias("dual_paths")).where("paths > 0")
        out = rows if out is None else out.unionByName(rows)
    said = relations.select("layer", F.concat_ws("~", "u", "v").alias("pair"), "paper_id", "relation_id")
    rows = out.join(said, ["layer", "pair"]).withColumn("_one", F.lit(1).cast("long"))
    order = [F.asc(c) for c in ("layer", "shared", "paper_id", "relation_id")]
    return running_sums(rows, order, {"_one": "review_order"}).drop("_one")
