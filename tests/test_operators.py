"""Hand-sized fixtures whose results follow from the formulas."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import ranks, text
from strandline.operators import communities, concepts, extract, features, linkframe, metrics, models, order, pairs, retrieval, review, survival, transfer, vocabulary, workflow
from strandline.operators.graph import connected_components
from strandline.operators.scratch import Scratch
from strandline.sources import files, graphml
from strandline.streaming import windows


def test_pairs_of_a_paper(spark):
    f = spark.createDataFrame([("P", c, "t", 2000, "source") for c in "baca"], "paper_id string, concept_id string, concept_type string, year int, layer string").distinct()
    got = pairs.pair_evidence(f)
    assert sorted((r.u, r.v) for r in got.collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert pairs.pair_evidence(f.limit(0)).count() == 0


def test_kth_support(spark):
    e = spark.createDataFrame([("a", "b", 2001, "p2"), ("a", "b", 2000, "p1"), ("a", "b", 2001, "p1b")], "u string, v string, year int, paper_id string")
    assert [tuple(r) for r in pairs.kth_support(e, 2).collect()] == [("a", "b", 2001, "p1b")]
    assert pairs.kth_support(e, 4).count() == 0


def test_average_tie_ranks(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate([3, 1, 3, 2, 1, 1])], "i int, x int")
    got = [r.p * 6 for r in d.select("i", ranks.pct_rank("x").alias("p")).orderBy("i").collect()]
    assert got == pytest.approx([5.5, 2, 5.5, 4, 2, 2])
    assert [r.avg_rank for r in order.ranked(d, "x").orderBy("i").collect()] == pytest.approx([5.5, 2, 5.5, 4, 2, 2])
    assert spark.createDataFrame([(5,)], "x int").select(ranks.rank01("x").alias("r")).first().r == 0


def test_running_sums_by_group(spark):
    d = spark.createDataFrame([("a", i, 1) for i in range(50)] + [("b", i, 2) for i in range(20)], "g string, i int, n int")
    got = {(r.g, r.i): r.upto for r in order.running_sums(d, [F.col("i")], {"n": "upto"}, ["g"]).collect()}
    assert got == {("a", i): i + 1 for i in range(50)} | {("b", i): 2 * i + 2 for i in range(20)}


def test_kaplan_meier(spark):
    e = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0)], "duration int, event int")
    curve = survival.kaplan_meier(e)
    assert [r.survival for r in curve.orderBy("t").collect()] == pytest.approx([0.75, 0.375, 0.375])
    assert [r.incidence for r in survival.at_horizons(curve, [0, 1, 5]).orderBy("horizon").collect()] == pytest.approx([0, 0.25, 0.625])


def test_competing_risks_add_up(spark):
    e = spark.createDataFrame([(1, "target"), (1, None), (2, "hybrid"), (2, "ambiguous"), (3, None), (4, "target")], "duration int, cause string")
    for r in survival.competing_risks(e).collect():
        assert r.survival + r.cif_target + r.cif_hybrid + r.cif_ambiguous == pytest.approx(1)


def test_all_tiers_of_a_hub(spark):
    bank = lambda names, n: spark.createDataFrame([("h", x, 1 + (i + n) % 3) for i, x in enumerate(names)], "u string, v string, papers long")
    s, t = bank("pqrstv", 0), bank("qstvwxy", 1)
    rows = lambda out: sorted(tuple(r) for r in out.where("shared = 'h'").select("source_other", "target_other", "tier", "support", "tier_rank", "source_rank", "target_rank").collect())
    got = rows(pairs.all_tiers(s, t, 2, chunk=2))
    assert len(got) == 6 * 7 - 4 and got == rows(pairs.tiers(pairs.hinges(s, t, 100), 2))
    assert len(rows(pairs.tiers(pairs.hinges(s, t, 3), 2))) == 3 * 3 - 1


def test_status_cascade(spark):
    s = spark.createDataFrame([("a", str(k), 2000, 1) for k in range(4)], "u string, v string, first_year int, papers int")
    t = spark.createDataFrame([("a", "1", 1999, 1), ("a", "2", 2000, 1), ("a", "3", 2001, 1), ("a", "9", 2001, 1)], "u string, v string, first_year int, papers int")
    got = {r.v: (r.status, r.lag_years) for r in pairs.status(s, t).collect()}
    assert got == {"0": ("not_in_target", None), "1": ("target_before_source", None), "2": ("same_year", None), "3": ("source_then_target", 1), "9": ("target_only", None)}


def test_wilson(spark):
    low, high = ranks.wilson(F.lit(6), F.lit(55))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (r.a, r.b) == pytest.approx((0.05097, 0.21826), abs=1e-5)


def _edges(spark, rows):
    return spark.createDataFrame([(1998, *r) for r in rows], "cutoff int, u string, v string")


@pytest.mark.parametrize("size", [1 << 20, 0])
def test_neighbour_features(spark, size):
    """Common neighbours by array intersection, broadcast or joined."""
    e = _edges(spark, [("a", "w"), ("b", "w"), ("a", "x"), ("b", "y")])
    got = {r.u: r for r in linkframe.neighbour_features(_edges(spark, [("a", "b"), ("q", "b")]), e, broadcast_bytes=size).collect()}
    r = got["a"]
    assert (r.common_neighbors, r.degree_u, r.degree_v, r.preferential_attachment) == (1, 2, 2, 4)
    assert (r.adamic_adar, r.resource_allocation, r.jaccard) == pytest.approx((1 / math.log(2), 0.5, 1 / 3))
    assert (got["q"].common_neighbors, got["q"].degree_u, got["q"].jaccard) == (0, 0, 0)


def test_link_frame_by_hand(spark):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    years = spark.createDataFrame([("a", "M", 1998, 2, 1), ("a", "M", 1994, 3, 0), ("d", "X", 1990, 1, 0)], "concept_id string, concept_type string, year int, source_papers int, target_papers int")
    states = linkframe.node_states(years, [1998])
    vectors = spark.createDataFrame([("a", "x", 3), ("a", "y", 4), ("d", "x", 1), ("c", "z", 1)], "node string, dim string, x int")
    want = _edges(spark, [("a", "c"), ("a", "d"), ("a", "b"), ("a", "q")]).withColumn("label", F.lit(0))
    frame = linkframe.link_frame(want, e, states, vectors, ["M"], ["X"])
    got = {r.v: r for r in frame.collect()}
    assert {v: (r.shortest_path, r.same_component, round(r.semantic_similarity, 6)) for v, r in got.items()} == {"c": (2, 1, 0), "d": (3, 1, 0.6), "b": (1, 1, 0), "q": (9, 0, 0)}
    r = got["d"]
    assert (r.document_frequency_u, r.recent_frequency_u, r.trend_u, r.age_u, r.age_v, r.material_mechanism_pair, r.target_frequency_u, r.target_both_seen) == (5, 2, -1 / 3, 4, 8, 1, 1, 0)
    assert sum(linkframe.GRAPH_SCORE.values()) == pytest.approx(1) and linkframe.graph_score(frame).orderBy(F.desc("graph_score")).first().v == "c"


def test_percent_ranks_of_many_columns(spark):
    rows = [(g, i, float((i * 7) % 5), (i * 3) % 4) for g in ("p", "q") for i in range(30)]
    d = spark.createDataFrame(rows, "g string, i int, a double, b int")
    got = {(r.g, r.i): (r.pr_a, r.pr_b) for r in order.pct_ranks(d, ["i"], ["a", "b"], "g").collect()}
    for r in d.select("g", "i", ranks.pct_rank("a", ["g"]).alias("a"), ranks.pct_rank("b", ["g"]).alias("b")).collect():
        assert got[r.g, r.i] == pytest.approx((r.a, r.b))


def test_five_ranks_of_readiness(spark):
    pairs_ = spark.createDataFrame([("a", "b", [1997], []), ("a", "x", [1997], []), ("a", "w", [], [1997]), ("b", "w", [], [1997])], "u string, v string, source_years array<int>, target_years array<int>")
    papers = spark.createDataFrame([("a", "b", 1997, 1), ("a", "x", 1997, 1)], "u string, v string, year int, n int")
    states = linkframe.node_states(spark.createDataFrame([(c, "t", 1997, n, 0) for c, n in (("a", 1), ("w", 2), ("b", 1))], "concept_id string, concept_type string, year int, source_papers int, target_papers int"), [1997])
    got = [tuple(r) for r in linkframe.risk_set(pairs_, papers, states, [1997]).select("u", "v", "target_frequency_min", "target_common_neighbors", "target_jaccard", "readiness").collect()]
    assert got == [("a", "b", 1, 1, 1.0, 1.0)]


def test_candidates_by_hand(spark):
    pairs_ = spark.createDataFrame([("a", "b", [1990], []), ("a", "c", [1992], [1992]), ("c", "d", [1990], [1991])], "u string, v string, source_years array<int>, target_years array<int>")
    states = spark.createDataFrame([(1990, c, 2) for c in "abcd"] + [(1990, "e", 1)], "cutoff int, node string, papers int")
    got = sorted(tuple(r) for r in linkframe.self_candidates(pairs_, states, [1990], 2).collect())
    assert got == [(1990, "a", "c", 1), (1990, "a", "d", 0), (1990, "b", "c", 0), (1990, "b", "d", 0)]
    assert sorted(tuple(r) for r in linkframe.transfer_candidates(pairs_, states, [1990], 2).collect()) == [(1990, "a", "b", 0), (1990, "c", "d", 1)]


def test_distances_of_all_pairs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "u string, v string")
    got = {(r.u, r.v): r.distance for r in features.all_distances(e, 2).collect()}
    assert got == {(x, y): abs(ord(x) - ord(y)) for x in "abcdxy" for y in "abcdxy" if abs(ord(x) - ord(y)) <= 2}


def test_distances(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "u string, v string")
    want = spark.createDataFrame([("a", "d"), ("a", "y"), ("a", "a")], "u string, v string")
    assert {(r.u, r.v): r.distance for r in features.distances(want, e).collect()} == {("a", "d"): 3, ("a", "y"): 9, ("a", "a"): 0}


def test_components(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)] + [(500, 500 + i) for i in range(1, 200)]
    part = {}

    def find(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        part[b] = a
    frame = spark.createDataFrame(edges + edges[:20] + [(7, None), (9, 9)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(frame, Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(frame.limit(0), Scratch(spark, "t")).count() == 0


def test_step_average_precision(spark):
    y = [1, 0, 1, 0, 0, 1, 0]
    d = spark.createDataFrame([(1, 10.0 - i, v) for i, v in enumerate(y)], "g int, score double, y int")
    r = metrics.auc_ap(d, ["g"]).first()
    assert (r.ap, r.auc) == pytest.approx(((1 + 2 / 3 + 3 / 6) / 3, (4 + 3 + 1) / 12))
    assert metrics.auc_ap(d.where("y = 1"), ["g"]).first().auc is None
    k = {x.k: x for x in metrics.at_k(d, ["g"], [3, 50], ["score"]).collect()}
    assert (k[3].hits, k[3].precision, k[50].precision) == (2, pytest.approx(2 / 3), None)
    b = metrics.best_f1(d, []).first()
    assert (b.tp, b.fp, b.fn, b.tn) == (2, 1, 1, 3) and b.threshold == 8


def test_text_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    assert [tuple(p) for p in val(text.positions(F.lit("aaaa"), F.lit("aa"), 10))] == [(10, 12), (11, 13), (12, 14)]
    assert val(text.positions(F.lit("abc"), F.lit(""))) == []
    assert val(text.positions(F.lit(r"a\Eb\Eb"), F.lit(r"\Eb"))) != []
    assert set(val(text.char_grams(F.lit("abc")))) == {"^ab", "abc", "bc$", "^abc", "abc$"}
    assert val(text.clean(F.lit(" a \n b "))) == "a b" and val(text.clean(F.lit(None).cast("string"))) == ""
    assert val(text.clean_doi(F.lit("https://doi.org/10.1/X."))) == "10.1/x"
    assert val(text.safe_int(F.lit("x"), 7)) == 7 and val(text.as_bool(F.lit(" Yes ")))
    assert val(text.pair_id("p", F.lit("b"), F.lit("a"))) == val(text.pair_id("p", F.lit("a"), F.lit("b")))
    assert val(text.word_ngrams(F.array(F.lit("a"), F.lit("b")), 2, 3)) == ["a b"]
    assert val(text.bands(F.lit(5), ((10, "high"), (3, "mid")), "low")) == "mid"
    assert val(text.all_rules(F.lit("ab"), (("a", "A"), ("z", "Z"), ("b", "B")))) == ["A", "B"]


def test_bm25_and_fusion(spark):
    d = spark.createDataFrame([(0, "x y", "g"), (1, "x x z", "g"), (2, "q", "g"), (3, "x", "h")], "id long, t string, g string")
    got = retrieval.bm25(d, d.where("id = 0"), "id", "t", "g").collect()
    assert [r.id for r in got] == [1]
    a = spark.createDataFrame([(0, 7, 1), (0, 8, 2)], "q int, item int, rank int")
    b = spark.createDataFrame([(0, 7, 2)], "q int, item int, rank int")
    first = retrieval.fuse([a, b], ["q"], "item").orderBy("rank").first()
    assert (first.item, first.rrf) == (7, pytest.approx(1 / 61 + 1 / 62))


def test_review(spark):
    rel = spark.createDataFrame([(1, 2, "equivalent_to"), (2, 3, "equivalent_to"), (1, 3, "distinct_from"), (4, 5, "distinct_from")], "a int, b int, relation string")
    assert [tuple(r)[:2] for r in review.equivalence_conflicts(rel).collect()] == [(1, 3)]
    dec = spark.createDataFrame([(2, 1, "broader_than", 1)], "a int, b int, relation string, seq int")
    got = review.overlay(spark.createDataFrame([(1, 2), (1, 9)], "a int, b int"), dec)
    assert {r.b: (r.relation, r.status) for r in got.collect()} == {2: ("narrower_than", "decided"), 9: (None, "open")}
    rows = spark.createDataFrame([("s", i) for i in range(10)] + [("t", 99)], "k string, id int")
    w = {r.k: r for r in review.stratified_sample(rows, "k", "id", 3, "1").collect()}
    assert (w["s"].probability, w["s"].weight) == (0.2, 5) and w["t"].weight == 1


def test_extract(spark):
    d = spark.createDataFrame([(1, "See e.g. this one. It is 3.5 long! End"), (2, None), (3, "")], "id int, t string")
    got = extract.sentences(d, "id", "t").collect()
    assert [r.sentence for r in got] == ["See e.g. this one.", "It is 3.5 long!", "End"]
    assert all(d.where(f"id = {r.id}").first().t[r.start : r.stop] == r.sentence for r in got)
    t = spark.createDataFrame([("g", "a b", 3.0), ("g", "a", 2.0), ("g", "c", 1.0)], "g string, term string, score double")
    assert [(r.inner, r.outer) for r in extract.nested_terms(t, ["g"], "term").collect()] == [("a", "a b")]
    assert extract.similar_labels(spark.createDataFrame([("abcdefgh", "abcdefgi"), ("a", "z")], "a string, b string"), "a", "b", 0.8).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,t\n1,"x\ny"\n2,\n', encoding="utf-8")
    rows = files.read_csv(spark, f"file://{tmp_path}/a.csv", ["id", "t"]).collect()
    assert [(r.id, r.t) for r in rows] == [("1", "x\ny"), ("2", None)]
    with pytest.raises(ValueError):
        files.require(spark.range(1), ["nope"])
    bar = "=" * 20
    (tmp_path / "r.txt").write_text(f"name: a\n{bar}\nname: b\nyear: 3\n")
    rec = files.text_records(spark, f"file://{tmp_path}/r.txt").select(*files.record_fields(F.col("body"), {"name": "name", "year": "year"}))
    assert sorted((r.name, r.year) for r in rec.collect()) == [("a", None), ("b", "3")]
    (tmp_path / "m.json").write_text(json.dumps({"k1": {"v": 1}, "k2": {"v": 2}}))
    assert {r.key: r.value.v for r in files.json_map(spark, f"file://{tmp_path}/m.json", "struct<v:int>").collect()} == {"k1": 1, "k2": 2}
    (tmp_path / "u.jsonl").write_text('{"type":"turn.completed","usage":{"a":1,"b":2}}\n{"type":"other","usage":{"a":9}}\n{"type":"turn.completed","usage":{"a":4}}\n')
    assert {r.key: r.total for r in files.usage(spark, f"file://{tmp_path}/u.jsonl").collect()} == {"a": 5, "b": 2}
    out = f"file://{tmp_path}/p"
    files.guarded_overwrite(spark.createDataFrame([(1, "")], "id int, human string"), out, ["human"])
    files.guarded_overwrite(spark.createDataFrame([(1, "yes")], "id int, human string"), out, ["human"])
    with pytest.raises(ValueError):
        files.guarded_overwrite(spark.createDataFrame([(2, "")], "id int, human string"), out, ["human"])
    assert files.manifest(spark, f"file://{tmp_path}/u.jsonl").first().bytes > 0
    with pytest.raises(ValueError):
        files.write_csv(spark.range(0), f"file://{tmp_path}/none")


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = windows.windowed(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "1 hour")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.windowed(events, "1 hour")
    key = lambda r: (r.start, r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, batch.collect()))


def test_text_queries_read_the_documents(spark, tmp_path):
    from strandline.plans import text_queries as Q

    spark.createDataFrame([(1, "one two three four five six seven. Eight nine."), (2, "aXaXa b"), (3, "nothing"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "aXa"), (8, "three four"), (9, "o three four five s"), (10, "two three four five"), (11, "never to be seen here"), (12, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): (r.times, r.first, r.last, r.status) for r in Q.positions(spark, str(tmp_path)).collect()}
    none = (0, None, None, "none")
    assert got == {(1, 8): (1, 8, 18, "unique"), (2, 7): (2, 0, 5, "multiple"), (1, 9): (1, 6, 25, "unique"), (1, 10): (1, 4, 23, "unique"), (None, 11): none, (None, 12): none}
    assert [(r.doc_id, r.sentence) for r in Q.long_sentences(spark, str(tmp_path)).collect()] == [(1, "one two three four five six seven.")]
    assert ("axaxa b", 1, 1) in {tuple(r) for r in Q.document_bigrams(spark, str(tmp_path)).collect()}


LEXICON = concepts.Lexicon(
    heads=(("diffusion|transport", "mechanism_or_process"), ("electrode|membrane", "material_or_structure"), ("power|voltage", "outcome_or_property")),
    boundary=frozenset(("the", "of", "and", "a", "in", "increases", "limits")), alone=frozenset(("voltage",)), plurals=(("electrodes", "electrode"),), blocked=frozenset(("H2",)),
    predicates=((r"\bincreases?\b", "increase"), (r"\blimits?\b", "limit")),
)


def test_labels_and_formulae():
    assert concepts.normal_label("Porous–Carbon  α-Electrodes.", LEXICON.plurals) == ("porous carbon alpha electrode", ("unicode_dash_to_ascii", "greek_transliteration", "lowercase", "hyphen_to_space", "simple_plural_to_singular"))
    assert concepts.normal_label("plain") == ("plain", ("identity",))
    assert [x for x in ("NaI", "Fe3+", "K4Fe(CN)6", "SEM", "word", "CuSO4", "DNA") if concepts.formula_like(x)] == ["NaI", "Fe3+", "K4Fe(CN)6", "CuSO4"]


def test_concepts_of_a_text():
    text = "The fast ion diffusion, in the porous electrodes (NaCl) of H2 limits voltage. Power of CuSO4 and redox-active films."
    got = [(n, text[a:b], label, kind, how) for n, a, b, _, label, kind, _, how in concepts.concepts_of(text, LEXICON)]
    assert got == [
        (0, "fast ion diffusion", "fast ion diffusion", "mechanism_or_process", "head_noun_phrase"), (0, "porous electrodes", "porous electrode", "material_or_structure", "head_noun_phrase"),
        (0, "voltage", "voltage", "outcome_or_property", "head_noun_phrase"), (1, "CuSO4", "cuso4", "literal_formula", "literal_formula"), (1, "redox-active", "redox active", "untyped_extractive_keyword", "generic_hyphenated_keyword"),
    ]


def test_greedy_choice_against_plain():
    import random

    rng = random.Random(8)
    for _ in range(200):
        rows = [(" ".join(rng.sample("abcd", rng.randrange(1, 4))), rng.choice("hk"), rng.randrange(2)) for _ in range(12)]
        taken = []
        for label, head, n in rows:
            w = set(label.split())
            if len(taken) < 4 and not any(head == h and n == m and (w < x or x < w) for _, x, h, m in taken):
                taken.append((label, w, head, n))
        assert concepts.choose(rows, 4) == [t[0] for t in taken]


def test_stances(spark):
    cases = {
        "heat increases power": "observed_assertion", "heat never really increases power": "negated", "not only heat increases power": "observed_assertion", "built to increases power": "purpose_or_design", "was found to increases power": "observed_assertion",
        "results suggest heat increases power": "hypothetical_or_epistemic", "this may be how heat increases power": "hypothetical_or_modal", "it may be; heat increases power": "observed_assertion", "it may be, but heat increases power": "observed_assertion",
        "Without one two three four five increases": "negated", "without one two three four five six increases": "observed_assertion", "we will never say it increases": "negated", "to now, one may say that it fully increases": "hypothetical_or_modal", "increases": "observed_assertion",
    }
    rows = spark.createDataFrame([(s, s[: s.index("increases")]) for s in cases], "s string, b string")
    assert {r.s: r.x for r in rows.select("s", concepts.assertion(F.col("b")).alias("x")).collect()} == cases


def test_doubts(spark):
    """A sentence [source] ... <predicate> ... [target] a case; its other predicates in braces."""
    import re

    cases = {
        "[heat] <increases> [power]": [],
        "[heat] and the <limit> [power]": ["nominal_predicate", "compound_subject"],
        "[heat] <limit> and so [power]": ["nominal_predicate"],
        "[heat] <increase> in [power]": ["nominal_predicate"],
        "[heat] the <change> of [power]": [],
        "[heat] self-<limits> [power]": ["hyphenated_predicate"],
        "[heat] <limit>-free [power]": ["hyphenated_predicate"],
        "[heat], slow, <limits> [power]": ["cross_clause"],
        "[heat] <limits>, whereas [power]": ["cross_clause"],
        "[heat] <limits> what {limits} [power]": ["other_predicate_between"],
        f"[heat] {'x' * 60} <limits> [power]": ["long_gap"],
        f"[heat] <limits> {'x' * 58} [power]": [],
        "cold {limits} it and [heat] <limits> [power]": ["inherited_subject"],
        "cold {limits} [heat] <limits> [power]": [],
        "[heat] between a and b <limits> [power]": [],
        "[heat] and what is between it <limits> [power]": ["compound_subject"],
        "[heat] <limits> new routes to [power]": ["intervening_head"],
    }
    rows = []
    for case in cases:
        spans, plain = {"[": [], "<": [], "{": []}, ""
        for piece in re.split(r"([\[<{][^\]>}]*[\]>}])", case):
            if piece[:1] in spans:
                spans[piece[0]].append((len(plain), len(plain) + len(piece) - 2))
                piece = piece[1:-1]
            plain += piece
        (a, b), (left, right) = spans["<"][0], (spans["["][0][1], spans["["][1][0])
        verb = {"limits": "limit", "increases": "increase"}.get(plain[a:b], plain[a:b])
        rows.append((case, plain, verb, a, b, left, right, sorted(spans["<"] + spans["{"])))
    frame = spark.createDataFrame(rows, "c string, s string, n string, a int, b int, l int, r int, o array<struct<start:int,stop:int>>")
    got = frame.select("c", concepts.doubts(*map(F.col, ("s", "n", "a", "b", "l", "r", "o"))).alias("x")).collect()
    assert {r.c: r.x for r in got} == cases


def test_ends_of_predicates(spark):
    """Of several concepts the preferred category wins, then the nearest; beyond the reach there is none."""
    docs = spark.createDataFrame([(1, "Membrane voltage and ion transport by a fast membrane increases cell voltage of an ion diffusion. It limits and increases.")], "id long, t string")
    pick = [("ion transport", "mechanism_or_process"), ("fast membrane", "material_or_structure"), ("cell voltage", "outcome_or_property"), ("ion diffusion", "mechanism_or_process")]
    text = docs.first().t
    chosen = spark.createDataFrame([(1, 0, text.index(w), text.index(w) + len(w), w, c) for w, c in pick], "id long, sentence_id int, start int, stop int, label string, category string")
    rel = lambda **kw: [(r.source, r.predicate, r.target, text[r.start : r.stop]) for r in concepts.relations(docs, "id", "t", chosen, LEXICON, **kw).collect()]
    assert rel() == [("ion transport", "increase", "ion diffusion", "increases")]
    assert rel(reach=20) == rel() and rel(reach=19) == [("fast membrane", "increase", "cell voltage", "increases")] and rel(reach=0) == []


def test_relations_pairs_and_bank(spark):
    docs = spark.createDataFrame([(1, "Ion diffusion increases cell voltage. Ion diffusion limits cell voltage, but a membrane helps."), (2, "Ion diffusion increases cell voltage."), (3, None), (4, "")], "id long, t string")
    found = concepts.candidates(docs, "id", "t", LEXICON)
    chosen = concepts.select(concepts.weighed(found, "id"), "id")
    rel = concepts.relations(docs, "id", "t", chosen, LEXICON)
    got = {(r.id, r.sentence_id, r.predicate, r.source, r.target, r.strict) for r in rel.collect()}
    assert got == {(i, n, p, "ion diffusion", "cell voltage", True) for i, n, p in ((1, 0, "increase"), (1, 1, "limit"), (2, 0, "increase"))}
    pairs_ = concepts.sentence_pairs(chosen, "id", rel)
    bank = concepts.sentence_bank(pairs_, "id", docs.select("id", (F.col("id") + 2000).alias("year")))
    assert [tuple(r) for r in bank.collect()] == [("cell voltage", "ion diffusion", 2, 3, 2, 2001, 2002, "1; 2")]
    assert concepts.candidates(docs.limit(0), "id", "t", LEXICON).count() == 0
    assert concepts.support_rows(pairs_, rel, "id").where("kind = 'cooccurrence_only'").count() + concepts.support_rows(pairs_, rel, "id").where("relation_id <> ''").count() == concepts.support_rows(pairs_, rel, "id").count()


def test_negated_and_contrastive_cues(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    hit = lambda t: one(concepts.affirmed_match(F.lit(t), "[Rr]edox", r"\b(?:without|no)\s+(?:\w+ ){0,3}", r"\s*-?free"))
    assert hit("without any redox; a Redox pair") == "Redox" and hit("redox-free film") is None and hit("none") is None
    cue = lambda t: one(concepts.contrastive(F.lit(t), F.lit(t.index("X")), F.lit(t.index("X") + 1)))
    assert cue("unlike the X here") and cue("an X was negligible") and not cue("an X was here. All absent")


def test_louvain_finds_cliques_and_never_lowers_modularity(spark):
    import itertools

    edges = [(a, b, 1.0) for k in range(4) for a, b in itertools.combinations(range(5 * k, 5 * k + 5), 2)] + [(0, 5, 1.0), (5, 10, 1.0), (10, 15, 1.0), (3, 3, 9.0)]
    e = spark.createDataFrame(edges, "u long, v long, weight double")
    got = communities.louvain(e, [1, 2, 3]).collect()
    for seed in (1, 2, 3):
        assert {r.node: r.part for r in got if r.seed == seed} == {i: i // 5 * 5 for i in range(20)}
    parts = spark.createDataFrame([(r.node, r.part) for r in got if r.seed == 1], "node long, part long")
    alone = parts.select("node", F.col("node").alias("part"))
    plain = e.where("u <> v")
    assert communities.modularity(plain, parts).first().modularity > 0.6 > communities.modularity(plain, alone).first().modularity
    with pytest.raises(ValueError):
        communities.louvain(e, [1], most=3)


def test_modularity_by_hand(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 2)], "u string, v string, weight int")
    p = spark.createDataFrame([(x, x in "ab") for x in "abcd"], "node string, part boolean")
    assert communities.modularity(e, p).first().modularity == pytest.approx(3 / 4 - (3 / 8) ** 2 - (5 / 8) ** 2)
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (2, "y")], "a int, b string")
    assert communities.adjusted_rand(rows, "a", "b").first().ari == pytest.approx(1)


def test_resumable_chunks(spark, tmp_path):
    rows, path, seen = spark.range(200), f"file://{tmp_path}/out", []

    def work(part):
        seen.append(part.count())
        if len(seen) == 3:
            raise RuntimeError("lost")
        return part.select("id", (F.col("id") * 2).alias("x"))

    with pytest.raises(RuntimeError):
        list(workflow.resumable(rows, "id", path, 5, work))
    assert len(list(workflow.resumable(rows, "id", path, 5, work))) == 3
    assert list(workflow.resumable(rows, "id", path, 5, work)) == []
    assert spark.read.parquet(path).count() == 200 and len(list(workflow.resumable(spark.range(210), "id", path, 5, work))) >= 1
    assert spark.read.parquet(path).select("id").distinct().count() == 210


def test_workflow_guards(spark, tmp_path):
    rows, parent = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "p int")
    with pytest.raises(ValueError):
        workflow.require_keys(rows, "k", parent, "p")
    assert workflow.load_or_start(spark, f"file://{tmp_path}/none", "id", ["verdict"]).columns == ["id", "verdict"]
    names, coded = workflow.repeats(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "i int, q string"), "q")
    assert names.count() == 1 and {(r.i, r.q) for r in workflow.unrepeat(names, coded, "q").collect()} == {(1, "a"), (2, "a"), (3, "b"), (4, None)}
    docs = spark.createDataFrame([(1, "hello world")], "id int, t string")
    spans = spark.createDataFrame([(1, 0, 5, "hello"), (1, 6, 11, "World"), (2, 0, 1, "x")], "id int, start int, stop int, surface string")
    assert sorted((r.id, r.surface) for r in workflow.span_failures(spans, docs, "id", "t").collect()) == [(1, "World"), (2, "x")]


def test_grades_by_hand(spark):
    one = lambda *c: tuple(spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(c)]).first())
    assert [one(*transfer.grade(F.lit(a), F.lit(b)))[1] for a, b in ((3, 3), (2, 3), (1, 2), (1, 1))] == [0, 1, 2, 3]
    assert one(*transfer.side_review(F.array(F.lit("rejected"), F.lit(None)))) == (2, "strict_syntax_pending_semantic_review")
    assert one(*transfer.side_review(F.array().cast("array<string>")))[0] == 1
    assert one(transfer.cross_bucket(F.lit("in"), F.lit("?"), ("out", "out"), ("in", "in")))[0] == "unknown_or_not_evaluated_quarantine"
    assert one(transfer.bridge_score(F.lit("family_mechanism_completion"), F.lit(1.0), F.lit(1.0), F.lit(1), F.lit(0.5)))[0] == pytest.approx(round((0.66 + 0.035 + 0.025 + 0.035) * 0.94, 4))
    assert one(transfer.production_eligible(F.lit(True), F.lit("observed_assertion"), F.lit("accepted"), F.lit(True), F.lit(None).cast("boolean"), F.lit("affirmed")))[0] is False


def test_more_sources(spark, tmp_path):
    import decimal
    import zipfile

    base = f"file://{tmp_path}"
    (tmp_path / "a.csv").write_text("\ufeffid,n\n1,2\n2,x\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("id\n1\n")
    assert [r.n for r in files.read_typed(spark, f"{base}/a.csv", "id int, n int", ["n"]).collect()] == [2, None]
    assert dict(files.read_inferred(spark, f"{base}/b.csv").dtypes)["id"] == "int"
    assert files.load_all(spark, base, {"a": ["id"], "b": ["id"]})["a"].columns == ["id"]
    with pytest.raises(ValueError, match="a.z, c"):
        files.load_all(spark, base, {"a": ["z"], "c": ["id"]})
    d = spark.createDataFrame([(1, "2000"), (1, "x"), (2, None), (3, "2030")], "id int, year string")
    assert files.contract(d, ["id"], ["id"], ["year"]) == {"year_empty": 1, "key_repeated": 1}
    assert [tuple(r) for r in files.years(d, "year", 1990, 2026, 2025).collect()] == [(1, 2000)]
    u = files.union_sources({"p": d, "q": spark.createDataFrame([(9,)], "id int")}, "id")
    assert u.where("source = 'q'").first().row_id == "q:9" and u.count() == 5
    files.publish_json(spark, f"{base}/x.json", {"b": 1, "a": [1, 2]})
    assert files.get_text(spark, f"{base}/x.json") == '{"a":[1,2],"b":1}'
    with pytest.raises(ValueError):
        files.publish_json(spark, f"{base}/x.json", {}, overwrite=False)
    assert [files.scalar(x) for x in (None, float("nan"), np.int64(3), decimal.Decimal("1.5"), " a  b ", True)] == ["", "", 3, 1.5, "a b", True]
    rows = spark.createDataFrame([(2, "b|\n"), (1, None)], "id int, t string")
    assert files.csv_sha256(rows, ["id"]) == files.csv_sha256(rows.repartition(3), ["id"]) != files.csv_sha256(rows.limit(1), ["id"])
    assert files.markdown(rows, ["id"]) == "| id | t |\n|-|-|\n| 1 |  |\n| 2 | b\\| |\n"
    assert files.write_one_csv(rows, f"{tmp_path}/one.csv", ["id"]) == 2 and (tmp_path / "one.csv").read_bytes().startswith(b"\xef\xbb\xbfid,t\n1,")
    files.write_xlsx(f"{tmp_path}/w.xlsx", {"first": rows, "a/b": d}, {"first": ["id"], "a/b": ["id", "year"]})
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert z.testzip() is None and "frozen" in sheet and sheet.count("<row>") == 3 and 'name="a_b"' in z.read("xl/workbook.xml").decode()
    paths = files.write_report(spark, base, "rep", rows, ["id"], {"rows": 2})
    assert spark.read.parquet(paths["table"]).count() == 2 and "| 1 |" in files.get_text(spark, paths["page"])
    stamp = files.input_stamp(rows, ["id", "t"], "model")
    files.save_vectors(spark.createDataFrame([(1, [1.0])], "id int, v array<double>"), f"{base}/cache", stamp, "id", "v")
    assert files.load_vectors(spark, f"{base}/cache", stamp).count() == 1
    with pytest.raises(ValueError, match="stale"):
        files.load_vectors(spark, f"{base}/cache", "other")
    assert files.contract_hash(rows.withColumn("z", F.lit(1)), ["id", "t"]) == files.contract_hash(rows, ["id", "t"])
    assert [files.next_attempt(spark, f"{base}/runs").rsplit("/", 1)[1] for _ in range(2)] == ["attempt-001", "attempt-002"]
    spark.createDataFrame([(1, "s")], "id int, stamp string").write.parquet(f"{base}/plan")
    spark.createDataFrame([(7, "s")], "id int, stamp string").write.parquet(f"{base}/done")
    with pytest.raises(ValueError, match="1 decisions"):
        files.load_state(spark, f"{base}/plan", f"{base}/done", "id", "s")


def test_graphml(spark, tmp_path):
    import xml.etree.ElementTree as E

    nodes = spark.createDataFrame([("a", "A&", 1), ("b", None, 2)], "id string, label string, n int")
    edges = spark.createDataFrame([("b", "a", 0.5), ("b", "a", 1.5)], "u string, v string, w double")
    graphml.write_graphml({"g1": (nodes, edges), "g2": (nodes, edges.limit(0))}, f"{tmp_path}/g.graphml", multi=True)
    root = E.parse(f"{tmp_path}/g.graphml").getroot()
    ns = {"g": "http://graphml.graphdrawing.org/xmlns"}
    assert {(k.get("for"), k.get("attr.name"), k.get("attr.type")) for k in root.findall("g:key", ns)} == {("node", "label", "string"), ("node", "n", "int"), ("edge", "w", "double")}
    assert [len(g.findall("g:edge", ns)) for g in root.findall("g:graph", ns)] == [2, 0]
    assert [tuple(r) for r in graphml.read_graphml(spark, f"file://{tmp_path}/g.graphml").distinct().collect()] == [("a", "b")]
    with pytest.raises(ValueError, match="parallel"):
        graphml.write_graphml({"g": (nodes, edges)}, f"{tmp_path}/h.graphml")
    sig = graphml.signatures(spark.createDataFrame([("b", "a", "k", False), ("a", "b", "k", False), ("b", "a", "k", True)], "s string, t string, kind string, d boolean"), "s", "t", "kind", "d")
    assert sorted(tuple(r) for r in sig.collect()) == [("a", "b", "k"), ("b", "a", "k")]


def test_command_line():
    from strandline import cli

    args = cli.parser().parse_args(["km_curve", "--data", "x", "--freeze", "1999"])
    assert (args.name, args.freeze, args.cutoff) == ("km_curve", 1999, None)
    with pytest.raises(SystemExit):
        cli.main(["no_such_query", "--data", "x"])


def test_roles_and_overlaps(spark):
    import itertools
    import random

    assert vocabulary.choose_roles([[0.5, 0.9], [0.2, 0.9], [0.0, 0.0]]) == [1, 0, None]
    rng = random.Random(2)
    for _ in range(100):
        scores = [[rng.choice((0.0, 0.1, 0.4)) for _ in range(4)] for _ in range(3)]
        taken, want = [], []
        for role in scores:
            free = [i for i in range(4) if i not in taken and role[i] > 0]
            best = min(free, key=lambda i: (-role[i], i)) if free else None
            want.append(best)
            taken += [best] if best is not None else []
        assert vocabulary.choose_roles(scores) == want
    docs = spark.createDataFrame([(1, "We heat it. The power rose and rose."), (2, None)], "id int, t string")
    got = vocabulary.role_sentences(docs, "id", "t", {"act": (("heat",), 0.0), "out": (("rose",), 0.0)})
    assert {(r.role, r.start, r.stop) for r in got.collect()} == {("act", 0, 11), ("out", 12, 36)}
    labels = ["red film", "red", "thin red film", "red films", "blue gas"]
    v = spark.createDataFrame([(x, "r") for x in labels] + [("red", "other")], "l string, r string")
    found = {(r.a, r.b, r.kind) for r in vocabulary.overlap_audit(v, "l", "r", 0.9).collect()}
    nested = {(a, b, "nested") for a, b in itertools.permutations(labels, 2) if set(a.split()) < set(b.split())}
    assert found == nested | {("red", "red", "same_label"), ("red film", "red films", "alike")}


def test_model_families(spark):
    rng = np.random.default_rng(3)
    rows = [(1990 + i % 3, f"u{i}", "v", int(x + 0.3 * rng.normal() > 0.5), float(x), float(rng.normal())) for i, x in enumerate(rng.random(240))]
    d = spark.createDataFrame(rows, "cutoff int, u string, v string, y int, a double, b double")
    train, test = d.where("cutoff < 1992"), d.where("cutoff = 1992")
    small = {"forest": {"numTrees": 5}, "boosted": {"maxIter": 3}, "machine": {"maxIter": 20}, "perceptron": {"maxIter": 30}}
    for name in models.FAMILIES:
        got = models.fit_or_fallback(train, test, name, ["a", "b"], "a", **small.get(name, {}))
        auc = metrics.auc_ap(got.select(F.lit(1).alias("g"), F.col(name).alias("score"), "y"), ["g"]).first().auc
        assert auc > 0.7, name
    assert models.tuned(d, "tree", ["a", "b"], "cutoff", 1992) in models.grid("tree") and models.grid("svm") == [{"regParam": 0.01}, {"regParam": 0.1}]
    one = models.fit_or_fallback(train.where("y = 1"), test, "logistic", ["a", "b"], "a")
    assert one.orderBy(F.desc("logistic")).first().a == max(r[4] for r in rows if r[0] == 1992)
    w = models.type_priors(spark.createDataFrame([("x", "w", 2.0), ("q", "q", 2.0)], "s string, t string, z double"), "s", "t", "z", {("w", "x"): 0.5})
    assert sorted(r.prior_score for r in w.collect()) == [1.0, 2.0]


def test_scratch_folders_go(spark):
    import os

    from strandline.operators import scratch

    kept = Scratch(spark, "kept")
    kept.save(spark.range(3), "a")
    place = scratch.mark()
    gone = Scratch(spark, "gone")
    gone.save(spark.range(3), "a")
    scratch.drop_since(spark, place)
    there = lambda s: os.path.isdir(s.root.removeprefix("file://"))
    assert there(kept) and not there(gone) and scratch.mark() == place
