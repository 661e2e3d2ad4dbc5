"""Graded candidates, links over neighbours and programs, and the rollup with its overlay, against plain loops."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.operators import bridges as B
from strandline.operators import transfer as X

BANK = "u string, v string, papers long, relations long, humans long, sentences long"


def bank(rng, nodes, many, hub=None, far=0):
    pairs = set()
    while len(pairs) < many:
        pairs.add(tuple(sorted(rng.sample(nodes, 2))))
    pairs |= {tuple(sorted((hub, f"z{i}"))) for i in range(far)}
    out = []
    for u, v in sorted(pairs):
        papers = rng.randrange(1, 4)
        relations = rng.randrange(papers + 1)
        out.append((u, v, papers, relations, rng.randrange(relations + 1), rng.randrange(1, 3)))
    return out


def incident(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append((r[1], r))
        out[r[1]].append((r[0], r))
    return out


def plain_graded(source, target, shared_ok, other_ok):
    s, t, rows = incident(source), incident(target), []
    for node in s.keys() & t.keys():
        for (a, p), (b, q) in itertools.product(s[node], t[node]):
            if a == b:
                continue
            level = lambda r: 3 if r[4] else 2 if r[3] else 1
            x, y = level(p), level(q)
            keys = [min(x, y), max(x, y)]
            for k in (4, 3, 2, 5):
                keys += [min(p[k], q[k]), p[k] + q[k]]
            tier = "A" if p[3] and q[3] else "B" if p[3] or q[3] else "C"
            rows.append((node, a, b, tier, [-k for k in keys], "~".join(p[:2]), "~".join(q[:2]), node in shared_ok and a in other_ok and b in other_ok))
    out, places = {}, Counter()
    for r in sorted(rows, key=lambda r: (r[0], r[4], r[5], r[6])):
        got = []
        for focus, by in ((False, (r[0],)), (False, (r[0], r[3])), (True, (r[0],)), (True, (r[0], r[3]))):
            if focus and not r[7]:
                got.append(None)
                continue
            places[focus, by] += 1
            got.append(places[focus, by])
        out[r[:3]] = (r[3], *got)
    return out


@pytest.mark.parametrize("seed,far", [(1, 0), (2, 60)])
def test_graded_candidates_are_whole_and_ranked(spark, seed, far):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(14)]
    source, target = bank(rng, nodes, 40, "n03", far), bank(rng, nodes, 45, "n03", far * 2)
    names = sorted({x for r in source + target for x in r[:2]})
    shared_ok, other_ok = {n for n in names if rng.random() < 0.7}, {n for n in names if rng.random() < 0.6}
    focus = spark.createDataFrame([(n, n in shared_ok, n in other_ok) for n in names], "node string, shared_focus boolean, other_focus boolean")
    got = X.graded_candidates(spark.createDataFrame(source, BANK), spark.createDataFrame(target, BANK), focus, chunk=7, salt=3)
    found = {(r.shared, r.source_other, r.target_other): (r.tier[0], r.node_rank, r.tier_rank, r.focus_rank, r.focus_tier_rank) for r in got.collect()}
    assert found == plain_graded(source, target, shared_ok, other_ok)


def test_a_hub_of_five_thousand_ends_a_side(spark):
    """25 million combinations less the equal ends: places are counted without making them all at once; every place occurs once."""
    side = lambda extra: spark.range(5000).select(F.lit("hub").alias("u"), F.concat(F.lit("x"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("v"), (F.col("id") % 7 + 1).alias("papers"), (F.col("id") % 3).alias("relations"), F.lit(0).cast("long").alias("humans"), (F.col("id") % 2 + extra).alias("sentences"))
    source, target = side(1), side(2)
    focus = source.select(F.col("v").alias("node"), F.lit(True).alias("shared_focus"), F.lit(True).alias("other_focus")).unionByName(spark.createDataFrame([("hub", True, False)], "node string, shared_focus boolean, other_focus boolean"))
    n = 5000 * 5000 - 5000
    got = X.graded_candidates(source, target, focus).agg(F.count("*").alias("n"), F.min("node_rank").alias("lo"), F.max("node_rank").alias("hi"), F.sum("node_rank").alias("s"), F.sum("focus_rank").alias("f"), F.max("shared_paths").alias("p")).first()
    assert tuple(got) == (n, 1, n, n * (n + 1) // 2, n * (n + 1) // 2, n)


def test_met_in_parts_is_the_whole_product(spark):
    s = spark.createDataFrame([("h", f"a{i}") for i in range(50)] + [("k", "a"), ("only", "x")], "shared string, source_other string")
    t = spark.createDataFrame([("h", f"b{i}") for i in range(70)] + [("k", "b")], "shared string, target_other string")
    rows = {(r.shared, r.source_other, r.target_other) for r in X.met(s, t, block=8).collect()}
    assert X.met(s, t, block=8).count() == len(rows) == 50 * 70 + 1


def test_family_links_keep_the_most_similar_way(spark):
    one = "u string, v string, papers long"
    source = spark.createDataFrame([("a2", "b", 3), ("a2", "a3", 1), ("a1", "x", 2)], one)
    target = spark.createDataFrame([("a1", "c", 5), ("a1", "x", 1)], one)
    audit = spark.createDataFrame([("a1", "a2", 0.9), ("a3", "a1", 0.95), ("a2", "a1", 0.8), ("x", "a1", 0.7)], "left string, right string, similarity double")
    roles = spark.createDataFrame([("a1", "mechanism")], "node string, role string")
    df = spark.createDataFrame([("a1", 10)], "node string, shared_df long")
    got = {(r.target_pair, r.source_pair, r.anchor): (r.near, r.similarity, r.link_type, r.bridge_score) for r in B.family_links(source, target, audit, roles, df).collect()}
    # from a1 to a2 (a2~b, a2~a3), to a3 (a2~a3, more similar) and to x; from x to a1
    assert set(got) == {(t, s, "a1") for t in ("a1~c", "a1~x") for s in ("a2~b", "a2~a3")} | {("a1~c", "a1~x", "a1"), ("a1~x", "a1~x", "__full_pair__")}
    assert got["a1~c", "a2~a3", "a1"][:3] == ("a3", 0.95, "family_mechanism_completion") and got["a1~c", "a2~b", "a1"][:2] == ("a2", 0.9)
    assert got["a1~x", "a1~x", "__full_pair__"][2] in ("family_mechanism_completion", "family_outcome_only")


def test_program_bridges(spark):
    evidence = "u string, v string, paper_id long"
    se = spark.createDataFrame([("L", "m", 1), ("L", "m", 2), ("L", "o", 3), ("k", "m", 1), ("L", "q", 9)], evidence)
    te = spark.createDataFrame([("mat", "mec", 50), ("mat", "str", 50), ("mat", "out", 50), ("mat", "mec", 51), ("mec", "str", 50)], evidence)
    papers = lambda e: e.groupBy("u", "v").agg(F.count_distinct("paper_id").alias("papers"))
    programs = spark.createDataFrame([("P", "L", 50, True), ("Q", "none", 50, True), ("R", "L", 77, True)], "program string, lever string, baseline long, ok boolean")
    declared = spark.createDataFrame([("P", 1), ("P", 2), ("P", 3), ("R", 1), ("Q", 1)], "program string, paper_id long")
    roles = spark.createDataFrame([("m", "mechanism"), ("o", "outcome_property"), ("mat", "material_system"), ("mec", "mechanism"), ("str", "structure_state"), ("out", "outcome_property")], "node string, role string")
    s, t = B.source_lane(programs, declared, papers(se), se), B.target_lane(programs, papers(te), te, roles, F.col("ok"))
    assert {(r.program, r.source_pair): r.aligned for r in s.collect()} == {("P", "L~m"): [1, 2], ("P", "L~o"): [3], ("R", "L~m"): [1]}
    assert {(r.program, r.target_pair, r.by_mechanism) for r in t.collect()} == {(p, x, y) for p in "PQ" for x, y in (("mat~mec", True), ("mat~str", False))}
    got = [(r.place, r.source_pair, r.target_pair) for r in B.program_bridges(s, t, roles).orderBy("program", "place").collect()]
    assert got == [(1, "L~m", "mat~mec"), (2, "L~m", "mat~str"), (3, "L~o", "mat~mec"), (4, "L~o", "mat~str")]
    assert B.program_bridges(s, t, roles, most=1).count() == 1


def _reviewed(spark, rows, verdict):
    """A bank whose pairs have `relations` relations each, with verdicts by (pair, number)."""
    rel = [(u, v, f"{u}{v}{i}") for u, v, _, n, *_ in rows for i in range(n)]
    said = [(r, verdict(r)) for *_, r in rel if verdict(r)]
    return B.reviewed_bank(spark.createDataFrame(rows, BANK), spark.createDataFrame(rel, "u string, v string, relation_id string"), spark.createDataFrame(said, "relation_id string, verdict string"))


def test_rollup_and_overlay(spark):
    rng = random.Random(4)
    nodes = [f"n{i}" for i in range(9)]
    source, target = bank(rng, nodes, 14), bank(rng, nodes, 15)
    first = lambda r: {0: "accepted", 1: "rejected"}.get(sum(map(ord, r)) % 3)
    changed = {u + v for u, v, *_ in source[:2] + target[:1]}
    second = lambda r: "accepted" if r[:-1] in changed else first(r)
    s, t = _reviewed(spark, source, first), _reviewed(spark, target, first)
    folded = B.fold(B.paths(s, t))
    status = lambda r, say: 1 if any(say(f"{r[0]}{r[1]}{i}") == "accepted" for i in range(r[3])) else 0

    def plain(say):
        by, a, b = defaultdict(list), incident(source), incident(target)
        for node in a.keys() & b.keys():
            for (x, p), (y, q) in itertools.product(a[node], b[node]):
                if x != y:
                    by[x, y].append((3 - status(p, say) - status(q, say), -min(p[2], q[2]), -min(p[5], q[5]), node))
        return {k: (len(v), min(v)[0], max(r[0] for r in v), *[sum(r[0] == g for r in v) for g in (1, 2, 3)], *min(v)[1:]) for k, v in by.items()}

    view = lambda f: {(r.source_end, r.target_end): (r.paths, r.best_order, r.worst_order, r.r2_paths, r.r1_paths, r.r0_paths, -r.best_papers, -r.best_sentences, r.best_shared) for r in f.collect()}
    want = plain(first)
    assert view(folded) == want
    hubs = {r.shared: r.hubness for r in B.hubness(s, t).collect()}
    a, b = incident(source), incident(target)
    assert hubs == {n: sum(x != y for x, _ in a[n] for y, _ in b[n]) for n in a.keys() & b.keys()}
    seen = lambda rows, x, y: (min(x, y), max(x, y)) in {r[:2] for r in rows}
    for r in B.placed(folded, s, t).collect():
        where = {(False, False): "both_not_observed_in_frozen_direct_corpora", (True, False): "observed_in_source_only", (False, True): "observed_in_target_only", (True, True): "observed_in_both_direct_corpora"}
        assert r.bucket == where[seen(source, r.source_end, r.target_end), seen(target, r.source_end, r.target_end)]
        assert r.mirrored == ((r.target_end, r.source_end) in want) and r.hubness == hubs[r.best_shared]
    s2, t2 = _reviewed(spark, source, second), _reviewed(spark, target, second)
    pairs = lambda rows: spark.createDataFrame([r[:2] for r in rows], "u string, v string")
    keys = B.touched(s2, t2, pairs(source[:2]), pairs(target[:1]))
    over = B.overlaid(folded, s2, t2, keys)
    assert view(over) == plain(second) == view(B.fold(B.paths(s2, t2)))
    assert 0 < keys.count() < len(want)
    touched_by_hand = {k for k in want if want[k] != plain(second)[k]}
    assert touched_by_hand <= {tuple(r) for r in keys.collect()}


def test_incident_relations_count_paths_without_making_them(spark):
    rng = random.Random(9)
    nodes = [f"n{i}" for i in range(9)]
    source, target = bank(rng, nodes, 16), bank(rng, nodes, 17)
    shared_ok, other_ok = set(nodes[:7]), set(nodes[2:])
    focus = spark.createDataFrame([(n, n in shared_ok, n in other_ok) for n in nodes], "node string, shared_focus boolean, other_focus boolean")
    rel = [(layer, u, v, i, f"{layer}{u}{v}{i}") for layer, rows in (("source", source), ("target", target)) for u, v, _, n, *_ in rows for i in range(n)]
    frame = spark.createDataFrame(rel, "layer string, u string, v string, paper_id int, relation_id string")
    got = B.incident_relations(spark.createDataFrame(source, BANK), spark.createDataFrame(target, BANK), focus, frame).collect()
    want, a, b = {}, incident(source), incident(target)
    for layer, own, across in (("source", a, b), ("target", b, a)):
        for node in shared_ok & own.keys():
            for x, p in own[node]:
                met = [q for y, q in across.get(node, []) if y in other_ok and y != x]
                if x in other_ok and p[3] and met:
                    want[layer, node, "~".join(p[:2])] = (p[3], len(met), sum(q[3] > 0 for q in met))
    assert {(r.layer, r.shared, r.pair): (r.paths, r.dual_paths) for r in got} == {k: v[1:] for k, v in want.items()}
    assert len(got) == sum(v[0] for v in want.values())
    assert [r.review_order for r in sorted(got, key=lambda r: (r.layer, r.shared, r.paper_id, r.relation_id))] == list(range(1, len(got) + 1))
