"""Evidence grades, tiers and ranks of two-layer candidates; link types, bridge and transfer scores; programs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, StructField, StructType

from ..functions.ranks import strength
from ..functions.text import lookup
from .order import running_sums
from .scratch import Scratch

#: Grade and its order by the weaker side's level, and by the stronger side's where the weaker has 1.
GRADES = {3: ("G3_dual_human_confirmed_relations", 0), 2: ("G2_dual_strict_syntax_candidates", 1), 1: ("G1_single_strict_syntax_candidate", 2), 0: ("G0_cooccurrence_only", 3)}
REVIEWED = {2: ("R2_dual_direct_sentence_relations", 1), 1: ("R1_single_direct_sentence_relation", 2), 0: ("R0_cooccurrence_only_or_rejected", 3)}
TIERS = ("A_dual_strict_syntax_candidates", "B_single_strict_syntax_candidate", "C_cooccurrence_only")

#: Link types by the role of what is shared, and each type's base score.
SHARED = {"mechanism": "shared_mechanism_completion", "intervention": "shared_intervention_transfer", "structure_state": "shared_structure_extension", "material_system": "shared_material_context", "outcome_property": "shared_outcome_only"}
FAMILY = {"mechanism": "family_mechanism_completion", "intervention": "family_intervention_transfer", "structure_state": "family_structure_extension", "material_system": "family_material_context", "outcome_property": "family_outcome_only"}
BASE = {
    "direct_pair_overlap": 0.92, "shared_mechanism_completion": 0.82, "shared_intervention_transfer": 0.80, "shared_structure_extension": 0.74, "shared_material_context": 0.62, "shared_outcome_only": 0.32,
    "family_mechanism_completion": 0.66, "family_intervention_transfer": 0.63, "family_structure_extension": 0.58, "family_material_context": 0.48, "family_outcome_only": 0.24,
}
ROLE_POINTS = {"mechanism": 15, "intervention": 15, "structure_state": 10, "material_system": 5}


def side_level(relation_papers: Column, human_papers: Column) -> Column:
    """3 with a confirmed relation, 2 with a relation by syntax, 1 with co-occurrence alone."""
    return F.when(human_papers > 0, 3).when(relation_papers > 0, 2).otherwise(1)


def grade(floor: Column, ceiling: Column) -> tuple[Column, Column]:
    level = F.when(floor >= 3, 3).when(floor >= 2, 2).when(ceiling >= 2, 1).otherwise(0)
    return lookup(level, {k: v[0] for k, v in GRADES.items()}), lookup(level, {k: v[1] for k, v in GRADES.items()})


def tier(source_relations: Column, target_relations: Column) -> tuple[Column, Column]:
    """(tier, side that has the relation)."""
    s, t = source_relations > 0, target_relations > 0
    return F.when(s & t, TIERS[0]).when(s | t, TIERS[1]).otherwise(TIERS[2]), F.when(s & t, "both").when(s, "source").when(t, "target").otherwise("none")


def side_review(verdicts: Column) -> tuple[Column, Column]:
    """(level, status) of a side from the verdicts on its relations: any accepted, all rejected, or pending; null counts as pending."""
    known = F.transform(verdicts, lambda v: F.coalesce(v, F.lit("pending")))
    none, some, out = F.size(known) <= 0, F.exists(known, lambda v: v == "accepted"), F.forall(known, lambda v: v == "rejected")
    level = F.when(none, 1).when(some, 2).when(out, 1).otherwise(2)
    status = F.when(none, "cooccurrence_only").when(some, "direct_sentence_relation_accepted").when(out, "machine_relation_rejected_retain_cooccurrence_only").otherwise("strict_syntax_pending_semantic_review")
    return level, status


def reviewed_grade(a: Column, b: Column) -> tuple[Column, Column]:
    level = F.when(F.least(a, b) >= 2, 2).when(F.greatest(a, b) >= 2, 1).otherwise(0)
    return lookup(level, {k: v[0] for k, v in REVIEWED.items()}), lookup(level, {k: v[1] for k, v in REVIEWED.items()})


def cross_bucket(source: Column, target: Column, absent: tuple[str, str], present: tuple[str, str]) -> Column:
    """Where a closing pair was observed; a status that is not allowed quarantines the row."""
    known = F.coalesce(source.isin(absent[0], present[0]) & target.isin(absent[1], present[1]), F.lit(False))
    s, t = source == present[0], target == present[1]
    out = F.when(~s & ~t, "both_not_observed_in_frozen_direct_corpora").when(s & ~t, "observed_in_source_only").when(~s & t, "observed_in_target_only").otherwise("observed_in_both_direct_corpora")
    return F.when(known, out).otherwise("unknown_or_not_evaluated_quarantine")


def production_eligible(strict: Column, assertion: Column, verdict: Column, entailed: Column, graph: Column, confirmed: Column) -> Column:
    """All six conditions of promotion; null fails."""
    return F.coalesce(strict & (assertion == "observed_assertion") & (verdict == "accepted") & entailed & graph & (confirmed == "affirmed"), F.lit(False))


def ends(bank: DataFrame, name: str, top: int | None = None) -> DataFrame:
    """A row for either end of each pair as `shared`; with `top`, the best of each shared node by papers, relations and name."""
    columns = [c for c in bank.columns if c not in ("u", "v")]
    pair = F.concat_ws("~", "u", "v")
    each = bank.select(F.explode(F.array(F.struct(F.col("u").alias("shared"), F.col("v").alias("other")), F.struct(F.col("v").alias("shared"), F.col("u").alias("other")))).alias("x"), pair.alias("pair"), *columns)
    out = each.select("x.shared", F.col("x.other").alias(f"{name}_other"), F.col("pair").alias(f"{name}_pair"), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    if top is None:
        return out
    w = Window.partitionBy("shared").orderBy(F.desc(f"{name}_papers"), F.desc(f"{name}_relations"), f"{name}_other")
    return out.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top).drop("_k")


def wedge(source: DataFrame, target: DataFrame, top: int | None = None, allowed: Column | None = None, block: int = 1024) -> DataFrame:
    """Every source and target pair on a shared node with different far ends.

    `allowed` gates nodes by category; with `top`, the best `top` a side of each node
    meet.  A node's ends are dealt into parts of about `block` on either side and
    every part meets every other, so a hub is joined in many tasks.
    """
    s, t = source, target
    if allowed is not None:
        s, t = s.where(allowed), t.where(allowed)
    return met(ends(s, "source", top), ends(t, "target", top), block).where("source_other <> target_other")


def met(s: DataFrame, t: DataFrame, block: int = 1024) -> DataFrame:
    """`s` and `t` joined on `shared`, nodes with many rows on a side in parts of about `block`.

    Tasks are as many as the joined rows ask for: by the bytes that go in, few tasks would make them all.
    """
    parts = lambda f, name: f.groupBy("shared").agg(F.count("*").alias(f"{name}_rows"), F.ceil(F.count("*") / block).cast("int").alias(name))
    grid = parts(s, "_sn").join(parts(t, "_tn"), "shared")
    tasks = max(1, -(-(grid.agg(F.sum(F.col("_sn_rows") * F.col("_tn_rows"))).first()[0] or 0) // (2 * block * block)))
    grid = grid.drop("_sn_rows", "_tn_rows")
    place = lambda name, n: F.pmod(F.xxhash64(f"{name}_other"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = s.join(grid, "shared").withColumn("_i", place("source", "_sn")).withColumn("_j", every("_tn")).drop("_sn", "_tn")
    b = t.join(grid, "shared").withColumn("_j", place("target", "_tn")).withColumn("_i", every("_sn")).drop("_sn", "_tn")
    at = ["shared", "_i", "_j"]
    return a.repartition(tasks, *at).join(b.repartition(tasks, *at), at).drop("_i", "_j")


#: The support order: thirteen keys with the shared node, all but the last two descending.
SUPPORT = ("floor", "ceiling", "min_humans", "sum_humans", "min_relations", "sum_relations", "min_papers", "sum_papers", "min_sentences", "sum_sentences")


#: What an end's support consists of.
COUNTS = ("humans", "relations", "papers", "sentences")


def graded(candidates: DataFrame) -> DataFrame:
    """Adds levels, grade and tier to rows with relations and humans of a source and a target side, and support sums where all counts are there."""
    c = candidates.withColumns({"source_level": side_level(F.col("source_relations"), F.col("source_humans")), "target_level": side_level(F.col("target_relations"), F.col("target_humans"))})
    c = c.withColumns({"floor": F.least("source_level", "target_level"), "ceiling": F.greatest("source_level", "target_level")})
    (g, order), (name, side) = grade(F.col("floor"), F.col("ceiling")), tier(F.col("source_relations"), F.col("target_relations"))
    both = {}
    for x in COUNTS if "source_papers" in c.columns else ():
        both |= {f"min_{x}": F.least(f"source_{x}", f"target_{x}"), f"sum_{x}": F.col(f"source_{x}") + F.col(f"target_{x}")}
    return c.withColumns({**both, "grade": g, "grade_order": order, "tier": name, "relation_side": side})


#: The most combinations of a node that are placed in one task.
WITHIN = 1 << 21


def support_words(keys: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Keys that descend, as few whole numbers that ascend in the same order."""
    words, room = [], 0
    for k in keys:
        least, most = int(k.min()), int(k.max())
        wide = most - least + 1
        if room and room * wide < 1 << 62:
            words[-1], room = words[-1] * wide + (most - k), room * wide
        else:
            words.append(most - k.astype(np.int64))
            room = wide
    return words


def _level(relations: np.ndarray, humans: np.ndarray) -> np.ndarray:
    return np.where(humans > 0, 3, np.where(relations > 0, 2, 1))


def support_places(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each source end, class of each target end, place of each two classes by support): ends of equal counts are of one class, and equal support is one place."""
    (p, of_source), (q, of_target) = (np.unique(np.stack([side[c] for c in COUNTS]), axis=1, return_inverse=True) for side in (x, y))
    level = [_level(k[COUNTS.index("relations")], k[COUNTS.index("humans")]) for k in (p, q)]
    low, high = (f(level[0][:, None], level[1][None, :]).ravel() for f in (np.minimum, np.maximum))
    keys = [low, high]
    for u, v in zip(p, q, strict=True):
        keys += [np.minimum(u[:, None], v[None, :]).ravel(), (u[:, None] + v[None, :]).ravel()]
    words = np.stack(support_words(keys))
    order = np.lexsort(words[::-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(np.append(False, (np.diff(words[:, order], axis=1) != 0).any(axis=0)))
    small = np.uint16 if len(place) <= 1 << 16 else np.int64  # a stable sort of short numbers is by radix
    return of_source.ravel(), of_target.ravel(), place.astype(small).reshape(p.shape[1], q.shape[1])


def placed_nodes(s: DataFrame, t: DataFrame, tasks: int, keep: Sequence[str] | None = None, strip: int = 1 << 17) -> DataFrame:
    """Combinations of source ends `s` and target ends `t` with their places, for nodes that fit a task.

    Only ends are dealt, by node; a task orders a node's combinations and gives them in strips, so
    they are neither shuffled nor written.  With `keep`, of the ends these columns alone, and of their relations and
    humans whether there are any: what is not read need not leave the task.
    """
    own = lambda f, side: [c.removeprefix(f"{side}_") for c in f.columns if c.startswith(f"{side}_")]
    flat = lambda f, side: f.select("shared", "shared_focus", F.lit(side == "target").alias("_target"), *[F.col(f"{side}_{c}").alias(c) for c in own(f, side)])
    of_source, of_target = own(s, "source"), own(t, "target")
    each = flat(s, "source").unionByName(flat(t, "target"), allowMissingColumns=True).repartition(tasks, "shared")
    sides = [StructField(f.name, f.dataType) for f in [*s.schema, *t.drop("shared", "shared_focus").schema] if keep is None or f.name in ("shared", *keep)]
    of_source, of_target = ([c for c in names if keep is None or f"{side}_{c}" in keep] for names, side in ((of_source, "source"), (of_target, "target")))
    figures = ("node_rank", "tier_rank", "focus_rank", "focus_tier_rank", "shared_paths")
    schema = StructType(sides + [StructField(c, IntegerType()) for c in figures] + ([] if keep is None else [StructField("_signs", ByteType())]))
    names = schema.fieldNames()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        a, b = (table.filter(x).sort_by("pair").combine_chunks() for x in (pc.invert(table["_target"]), table["_target"]))
        if not len(a) or not len(b):
            return
        number = lambda f, c: pc.fill_null(f[c], 0).to_numpy()
        x, y = ({c: number(f, c) for c in (*COUNTS, "focus")} for f in (a, b))
        codes = pc.dictionary_encode(pa.chunked_array(a["other"].chunks + b["other"].chunks)).combine_chunks().indices.to_numpy()
        other = codes[: len(a), None] != codes[None, len(a) :]
        i, j = (k.astype(np.int32) for k in np.nonzero(other))
        if not len(i):
            return
        of_a, of_b, places = support_places(x, y)
        by = np.argsort(places[of_a][:, of_b][other], kind="stable")  # what is equal stays in order of pairs
        sign = lambda side, c: (side[c] > 0).astype(np.int8)
        tier = (sign(x, "relations")[:, None] + sign(y, "relations")[None, :])[other][by]
        sought = ((x["focus"] == 1)[:, None] & (y["focus"] == 1)[None, :])[other][by] & bool(table["shared_focus"][0].as_py())
        found = {c: np.zeros(len(i), np.int32) for c in figures[:4]}

        def count(name: str, rows: np.ndarray) -> None:
            found[name][rows] = np.arange(1, len(rows) + 1, dtype=np.int32)

        count("node_rank", by)
        count("focus_rank", by[sought])
        for k in range(3):
            count("tier_rank", by[tier == k])
            count("focus_tier_rank", by[sought & (tier == k)])
        signs = None if keep is None else ((sign(x, "relations") + 2 * sign(x, "humans"))[:, None] + (4 * sign(y, "relations") + 8 * sign(y, "humans"))[None, :])[other]
        a, b = a.select(["shared", "shared_focus", *of_source]), b.select(of_target)
        rows = lambda f, index: f.take(pa.array(index)).combine_chunks()
        for lo in range(0, len(i), strip):
            here = slice(lo, lo + strip)
            left, right = rows(a, i[here]), rows(b, j[here])
            out = {"shared": left["shared"], "shared_focus": left["shared_focus"]}
            out |= {f"source_{c}": left[c] for c in of_source} | {f"target_{c}": right[c] for c in of_target}
            out |= {c: pa.array(v[here], mask=v[here] == 0) for c, v in found.items()} | {"shared_paths": pa.array(np.full(len(left), len(i), np.int32))}
            if signs is not None:
                out["_signs"] = pa.array(signs[here])
            yield from pa.table({c: out[c] for c in names}).combine_chunks().to_batches()

    rows = each.groupBy("shared").applyInArrow(place, schema)
    return rows.withColumns({c: F.col(c).cast("long") for c in figures})


#: Columns of combinations that follow from their places and from whether either side has relations and humans.
LIGHT = frozenset(("shared", "source_other", "target_other", "tier", "relation_side", "source_level", "target_level", "floor", "ceiling", "grade", "grade_order", "shared_paths", "node_rank", "tier_rank", "focus_rank", "focus_tier_rank"))


def graded_candidates(source: DataFrame, target: DataFrame, in_focus: DataFrame, chunk: int = 256, salt: int = 16, within: int = WITHIN, keep: Sequence[str] | None = None) -> DataFrame:
    """Every combination of a source and a target pair on a shared node, with levels, grade, tier and four places; none is cut.

    Places by support: within the shared node and within node and tier, over all
    combinations and over those in focus.  in_focus: (node, shared_focus, other_focus);
    a combination is in focus if its shared node and both far ends are.

    A node of up to `within` combinations is placed in one task (`placed_nodes`), a larger one by blocks (`placed_blocks`).
    `keep`: the columns that are read, if not all.
    """
    shared_ok = in_focus.select(F.col("node").alias("shared"), "shared_focus")
    flags = lambda side: in_focus.select(F.col("node").alias(f"{side}_other"), F.col("other_focus").cast("long").alias(f"{side}_focus"))
    s = ends(source, "source").join(flags("source"), "source_other")
    t = ends(target, "target").join(flags("target"), "target_other")
    many = lambda f, name: f.groupBy("shared").agg(F.count("*").alias(name))
    grid = many(s, "_s").join(many(t, "_t"), "shared").join(shared_ok, "shared")
    grid = grid.select("shared", "shared_focus", (F.col("_s") * F.col("_t")).alias("_rows"), ((F.col("_s") * F.col("_t") > within) | (F.col("_s") + F.col("_t") > within)).alias("_large"))
    grid = Scratch(source.sparkSession, "graded").save(grid, "nodes")
    sizes = grid.agg(F.sum(F.when(~F.col("_large"), F.col("_rows"))).alias("rows"), F.count_if("_large").alias("large")).first()
    small, large = (grid.where(x).select("shared", "shared_focus") for x in (~F.col("_large"), F.col("_large")))
    light = keep is not None and LIGHT.issuperset(keep)
    rows = placed_nodes(s.join(small, "shared"), t.join(small, "shared"), max(1, -(-(sizes["rows"] or 0) // max(within, 1))), keep if light else None)
    if light:
        signs = [f"{side}_{c}" for side in ("source", "target") for c in ("relations", "humans")]
        rows = graded(rows.withColumns({c: F.col("_signs").bitwiseAND(F.lit(1 << i)) for i, c in enumerate(signs)}))
    else:
        rows = graded(rows).withColumn("focus", F.col("shared_focus") & (F.col("source_focus") == 1) & (F.col("target_focus") == 1)).drop("shared_focus", "source_focus", "target_focus")
    rows = rows if keep is None else rows.select(*keep)
    if not sizes["large"]:
        return rows
    blocks = placed_blocks(s.join(large.select("shared"), "shared"), t.join(large.select("shared"), "shared"), large, chunk, salt)
    return rows.unionByName(blocks if keep is None else blocks.select(*keep))


def placed_blocks(s: DataFrame, t: DataFrame, shared_ok: DataFrame, chunk: int = 256, salt: int = 16) -> DataFrame:
    """Combinations of source ends `s` and target ends `t` as `graded_candidates` gives them, for nodes of any size.

    The ten support keys of a combination depend on the two ends' counts alone, and
    a source end with the keys gives the target's counts.  So combinations are first
    blocks: a source end with all target ends of the same counts.  Blocks are ordered and
    summed up over a range partition; within a block the place is the target end's
    place among its equals, less one if the source's own far end comes before it.  Rows are made
    last, in chunks of target ends.
    """
    scratch = Scratch(s.sparkSession, "graded")
    like = ["shared", *[f"target_{c}" for c in COUNTS]]
    t = t.withColumn("_one", F.lit(1).cast("long"))
    t = scratch.save(running_sums(t, [F.col("target_pair")], {"_one": "place", "target_focus": "focus_place"}, like).drop("_one"), "targets")
    kinds = t.groupBy(*like).agg(F.count("*").alias("n"), F.sum("target_focus").alias("nf")).join(shared_ok, "shared")
    kinds = kinds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    own = t.select("shared", F.col("target_other").alias("source_other"), *[F.col(f"target_{c}").alias(f"_{c}") for c in COUNTS], F.col("place").alias("own_place"), F.col("target_focus").alias("own_focus"))
    blocks = s.join(own, ["shared", "source_other"], "left").withColumn("_salt", F.pmod(F.xxhash64("source_other"), F.lit(salt)).cast("int")).join(kinds, ["shared", "_salt"])
    itself = F.coalesce(reduce(lambda x, y: x & y, [F.col(f"_{c}") == F.col(f"target_{c}") for c in COUNTS]), F.lit(False))
    blocks = blocks.withColumns({"own_place": F.when(itself, F.col("own_place")), "own_focus": F.when(itself, F.col("own_focus")).otherwise(0)}).drop("_salt", *[f"_{c}" for c in COUNTS])
    sought = F.col("shared_focus") & (F.col("source_focus") == 1)
    blocks = graded(blocks).withColumns({"here": F.col("n") - F.col("own_place").isNotNull().cast("long"), "here_focus": F.when(sought, F.col("nf") - F.col("own_focus")).otherwise(0)})
    order = [*[F.desc(c) for c in SUPPORT], F.asc("source_pair")]
    blocks = running_sums(blocks, order, {"here": "upto", "here_focus": "upto_focus"}, ["shared"])
    blocks = running_sums(blocks, order, {"here": "upto_tier", "here_focus": "upto_focus_tier"}, ["shared", "tier"])
    total = blocks.groupBy("shared").agg(F.sum("here").alias("shared_paths"))
    blocks = blocks.join(total, "shared").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk).cast("int"))))
    rows = blocks.join(t.withColumn("part", F.floor((F.col("place") - 1) / chunk).cast("int")), [*like, "part"]).where("source_other <> target_other")
    ahead = F.coalesce(F.col("own_place") < F.col("place"), F.lit(False)).cast("long")
    focus = sought & (F.col("target_focus") == 1)
    rank = lambda upto: F.col(upto) - F.col("here") + F.col("place") - ahead
    inner = lambda upto: F.when(focus, F.col(upto) - F.col("here_focus") + F.col("focus_place") - ahead * F.col("own_focus"))
    rows = rows.withColumns({"focus": focus, "node_rank": rank("upto"), "tier_rank": rank("upto_tier"), "focus_rank": inner("upto_focus"), "focus_tier_rank": inner("upto_focus_tier")})
    return rows.drop("part", "n", "nf", "place", "focus_place", "own_place", "own_focus", "here", "here_focus", "upto", "upto_tier", "upto_focus", "upto_focus_tier", "shared_focus", "source_focus", "target_focus")


def closure_paths(source: DataFrame, target: DataFrame) -> DataFrame:
    """(a, b, paths): how many combinations would close each pair of far ends, counted by tiles of end pairs."""
    from . import tiles

    n = tiles.ways(ends(source.select("u", "v"), "source"), ends(target.select("u", "v"), "target"))
    return n.groupBy(F.least("source_end", "target_end").alias("a"), F.greatest("source_end", "target_end").alias("b")).agg(F.sum("paths").alias("paths"))


def bridge_score(link_type: Column, source_strength: Column, target_strength: Column, endpoint_df: Column, similarity: Column | None = None) -> Column:
    """Base of the link type, support of both sides and the shared end's specificity; family links are discounted by similarity."""
    similarity = F.lit(1.0) if similarity is None else similarity
    specificity = 1 / (1 + F.log10(F.greatest(endpoint_df, F.lit(1)).cast("double")))
    raw = lookup(link_type, BASE) + 0.035 * source_strength + 0.025 * target_strength + 0.035 * specificity
    raw = F.when(link_type.startswith("family_"), raw * (0.88 + 0.12 * similarity)).otherwise(raw)
    return F.round(F.least(raw, F.lit(0.99)), 4)


def support_points(n: Column) -> Column:
    return F.when(n >= 5, 5).when(n >= 3, 4).when(n == 2, 2).otherwise(1)


def hub_penalty(df: Column, papers: Column) -> Column:
    share = df / papers
    return F.when(share > 0.20, 12).when(share > 0.10, 8).when(share > 0.05, 4).otherwise(0)


def scored_links(links: DataFrame, target_papers: Column) -> DataFrame:
    """Adds the transfer score of 0 to 100 with its cap and the statuses that follow.

    Columns: link_type, role, curated (with family and program_status, else null), source_papers, shared_df;
    curated rows also have source_roles and target_roles (arrays).
    """
    curated, overlap, broad = F.col("curated"), F.col("link_type") == "direct_pair_overlap", F.coalesce(F.col("family") == "any", F.lit(False))
    has = lambda side, *roles: F.arrays_overlap(F.col(f"{side}_roles"), F.array(*[F.lit(r) for r in roles]))
    chain = has("source", "intervention") & has("source", "mechanism", "structure_state") & has("target", "material_system") & has("target", "mechanism", "structure_state")
    # fixed values: points of the components, and the most that each kind of link may score
    rule = F.when(curated & broad, 36).when(curated, 49).otherwise(30)
    route = F.when(curated & F.coalesce(chain, F.lit(False)), 15).when(curated, 10).otherwise(lookup(F.col("role"), ROLE_POINTS, 0))
    lever = F.when(curated & F.coalesce(has("source", "intervention"), F.lit(False)), 15).when(curated, 10).otherwise(7)
    penalty = F.when(curated | F.col("shared_df").isNull(), 0).otherwise(hub_penalty(F.col("shared_df"), target_papers))
    most = F.when(overlap, 0).when(~curated, 59).when(broad, 69).otherwise(100)
    reason = F.when(overlap, "exact_pair_overlap_is_precedent").when(~curated, "topological_hinge_without_directional_rule").when(broad, "broad_any_target_rule").otherwise("")
    out = links.withColumns({"hub_penalty": penalty, "score_cap_reason": reason})
    out = out.withColumn("transfer_score", F.least(rule + route + lever + 4 + support_points(F.col("source_papers")) - F.col("hub_penalty"), most))
    control = F.coalesce(F.col("program_status").contains("positive_control"), F.lit(False))
    strong = (F.col("transfer_score") >= 75) & ~broad
    inference = F.when(overlap, "precedent_or_positive_control").when(curated & control, "known_positive_control").when(curated & strong, "mechanistic_transfer_candidate").when(curated, "rule_bridge_needs_review").otherwise("topological_retrieval_only")
    upgrade = F.coalesce(F.col("program_status") == "direct_precedent_upgrade_candidate", F.lit(False))
    novelty = (
        F.when(overlap, "exact_target_pair_overlap").when(curated & control, "known_target_positive_control").when(curated & strong & upgrade, "direct_prior_art_upgrade_candidate")
        .when(curated & strong, "white_space_in_frozen_local_corpus").when(curated, "curated_status_requires_review").otherwise("not_assessed")
    )
    return out.withColumns({"inference_status": inference, "novelty_status": novelty})


def link_type(role: Column, same: Column, family: bool = False) -> Column:
    kinds = FAMILY if family else SHARED
    found = lookup(role, kinds, kinds["outcome_property"])
    return found if family else F.when(same, "direct_pair_overlap").otherwise(found)


def temporal_alignment(source_year: Column, target_year: Column) -> Column:
    return F.when(source_year.isNull() | target_year.isNull(), "unknown").when(source_year <= target_year, "source_precedes_or_same_year").otherwise("source_observed_after_target_pair")


def typed(links: DataFrame) -> DataFrame:
    """Adds link type, bridge score and order in time to rows with role, same, shared_df and both sides' papers and first years."""
    links = links.withColumn("link_type", link_type(F.col("role"), F.col("same")))
    links = links.withColumn("bridge_score", bridge_score(F.col("link_type"), strength(F.col("source_papers")), strength(F.col("target_papers")), F.coalesce("shared_df", F.lit(1))))
    return links.withColumn("temporal_alignment", temporal_alignment(F.col("source_first_year"), F.col("target_first_year")))


def link_blocks(source: DataFrame, target: DataFrame, roles: DataFrame, df: DataFrame) -> DataFrame:
    """Direct overlaps and shared-node links of two banks with their type, bridge score and order in time, by block, and each block's number of `links`.

    What is said of a link depends on the shared node, both sides' papers and first years, and whether the pairs are
    the same; a block is one such combination.  Its links are the product of the ends on either side, less those where both ends
    are one, which are counted from the pairs of both banks.  A pair that is the same is one link, at its first end.
    `roles` has node and role, `df` node and shared_df (papers of the target that have it).
    """
    like = lambda side: [f"{side}_papers", f"{side}_first_year"]
    s, t = (ends(bank.select("u", "v", "papers", "first_year"), side) for bank, side in ((source, "source"), (target, "target")))
    n = lambda f, side: f.groupBy("shared", *like(side)).agg(F.count("*").alias(f"{side}_n"))
    key = ["shared", *like("source"), *like("target")]
    met = n(s, "source").join(n(t, "target"), "shared").select(*key, F.lit(False).alias("same"), (F.col("source_n") * F.col("target_n")).alias("links"))
    both = s.join(t, (s["shared"] == t["shared"]) & (F.col("source_other") == F.col("target_other"))).drop(t["shared"])
    itself = both.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col("shared") < F.col("source_other")).alias("once"))
    less, once = (itself.select(*key, F.lit(same).alias("same"), links.alias("links")) for same, links in ((False, -F.col("n")), (True, F.col("once"))))
    out = met.unionByName(less).unionByName(once).groupBy(*key, "same").agg(F.sum("links").alias("links")).where("links > 0")
    node = F.col("node").alias("shared")
    return typed(out.join(roles.select(node, "role"), "shared", "left").join(df.select(node, "shared_df"), "shared", "left"))


def block_links(blocks: DataFrame, source: DataFrame, target: DataFrame, chunk: int = 256) -> DataFrame:
    """The links of blocks, row by row: both pairs, far ends, closing ends and link_id beside the columns of `blocks`.

    The ends of a node with the same papers and first year come in lists of about `chunk`; lists meet by block, and rows are
    made last, where they are written.
    """
    columns = blocks.columns

    def lists(bank: DataFrame, side: str) -> DataFrame:
        e = ends(bank.select("u", "v", "papers", "first_year"), side)
        like = ["shared", f"{side}_papers", f"{side}_first_year"]
        many = e.groupBy(*like).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_n"))
        part = F.pmod(F.xxhash64(f"{side}_other"), F.col("_n"))
        e = joined(e, many, like)
        return e.groupBy(*like, part.alias("_part")).agg(F.collect_list(F.struct(f"{side}_other", f"{side}_pair")).alias(f"_{side}")).drop("_part")

    out = joined(joined(blocks, lists(source, "source"), ["shared", "source_papers", "source_first_year"]), lists(target, "target"), ["shared", "target_papers", "target_first_year"])
    out = out.select(*columns, F.explode("_source").alias("_s"), "_target").select(*columns, "_s.*", F.explode("_target").alias("_t")).select(*columns, "source_other", "source_pair", "_t.*")
    # of a pair that is the same, its first end alone
    other = F.col("source_other") != F.col("target_other")
    out = out.where(F.when(F.col("same"), ~other & (F.col("shared") < F.col("source_other"))).otherwise(other))
    closing = lambda c: F.when(F.col("same"), "").otherwise(F.col(c))
    return out.drop("links").withColumns({"closure_source": closing("source_other"), "closure_target": closing("target_other"), "link_id": F.concat_ws("/", "source_pair", "target_pair")})


def joined(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on columns of which null equals null; all but the first may be null."""
    same = reduce(lambda x, c: x & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), on[1:], F.col(f"a.{on[0]}") == F.col(f"b.{on[0]}"))
    return a.alias("a").join(b.alias("b"), same).select("a.*", *[f"b.{c}" for c in b.columns if c not in on])


def exact_links(source: DataFrame, target: DataFrame, roles: DataFrame, df: DataFrame) -> DataFrame:
    """Direct overlaps and shared-node links of two banks, row by row, with their type, bridge score, closing ends and order in time."""
    return block_links(link_blocks(source, target, roles, df), source, target)


def leading(blocks: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The blocks that hold the first `most` links by descending `order`, and all links that equal the last of them there."""
    n = running_sums(blocks.groupBy(*order).agg(F.sum("links").alias("links")), [F.desc(c) for c in order], {"links": "upto"})
    return blocks.join(n.where(F.col("upto") - F.col("links") < most).select(*order), list(order), "left_semi")


def best_blocks(blocks: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """Each group's blocks with its greatest values of `order`."""
    best = blocks.groupBy(by).agg(F.max(F.struct(*order)).alias("_best"))
    return blocks.join(best.select(by, "_best.*"), [by, *order], "left_semi")


#: The order of bridges, all descending.
BRIDGE_ORDER = ("curated", "transfer_score", "source_papers", "target_papers")


def useful(links: DataFrame) -> DataFrame:
    """Links, or blocks of them, that may be acted on."""
    return links.where(~F.col("link_type").isin("direct_pair_overlap", "shared_outcome_only", "family_outcome_only") & ~F.col("novelty_status").isin("exact_target_pair_overlap", "known_target_positive_control"))


def top_bridges(links: DataFrame, most: int = 500) -> DataFrame:
    """The best links that may be acted on: place within the target pair, and over all for the first `most`.

    The `leading` links are enough: what is better within a target pair is better over all, since its papers are the same.
    """
    order = [F.desc(c) for c in BRIDGE_ORDER]
    best = useful(links).withColumn("_k", F.row_number().over(Window.partitionBy("source_pair", "target_pair").orderBy(*order, "shared"))).where("_k = 1").drop("_k")
    best = best.withColumn("rank_within_target", F.row_number().over(Window.partitionBy("target_pair").orderBy(*order, "source_pair")))
    every = [*order, F.asc("target_pair"), F.asc("source_pair")]
    return best.orderBy(*every).limit(most).withColumn("global_rank", F.row_number().over(Window.orderBy(*every)))


def representatives(links: DataFrame, program: str, score: Sequence[str], most: int, fallback: Sequence[str]) -> DataFrame:
    """The best link of each program, best first, and then the best links of the fallback types until there are `most`."""
    order = [F.desc(c) for c in score]
    own = links.where(F.col(program).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(program).orderBy(*order, "link_id"))).where("_k = 1").drop("_k")
    first = own.orderBy(*order, "link_id").limit(most).withColumn("part", F.lit(0))
    more = links.join(first.select("link_id"), "link_id", "left_anti").where(F.col("link_type").isin(*fallback)).orderBy(*order, "link_id").limit(most).withColumn("part", F.lit(1))
    every = ["part", *order, "link_id"]
    return first.unionByName(more).orderBy(*every).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*every))).drop("part")  # 2 * most rows


def program_status(control: Column, direct: Column, related: Column, coupled: Column) -> Column:
    return (
        F.when(control, "known_precedent_positive_control").when((direct > 0) | (coupled > 0), "direct_precedent_upgrade_candidate")
        .when(related > 0, "mechanism_extension_white_space").otherwise("new_cross_mechanism_hypothesis")
    )


def program_results(programs: DataFrame, blocks: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each program with its numbers of links and overlaps, status and best link; programs without a link stay.

    `links` makes rows of blocks: only those of each program's best blocks are made.
    """
    order = ["transfer_score", "bridge_score", "source_papers", "target_papers"]
    direct = F.col("link_type") == "direct_pair_overlap"
    n = blocks.groupBy("program").agg(F.sum(F.when(~direct, F.col("links")).otherwise(0)).alias("related"), F.sum(F.when(direct, F.col("links")).otherwise(0)).alias("direct"))
    best = links(best_blocks(blocks, "program", order)).groupBy("program").agg(F.max("link_id").alias("best_link"), F.max("transfer_score").alias("best_score"))
    out = programs.join(n, "program", "left").join(best, "program", "left").na.fill(0, ["related", "direct"])
    status = program_status(F.col("control"), F.col("direct"), F.col("related"), F.lit(0))
    return out.select("program", "control", "related", "direct", status.alias("status"), "best_link", "best_score")
