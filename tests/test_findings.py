"""Cases that once failed: one or more for each finding that was mended."""

from pyspark.sql import functions as F

from strandline.operators import concepts, models, pairs, search, workflow


def test_affirmed_match_looks_at_the_very_last_character(spark):
    one = lambda t: spark.range(1).select(concepts.affirmed_match(F.lit(t), "[0-9]+", "[-.]", "[%.]").alias("x")).first().x
    assert one("ends.\n42 begins") == "42" and one("minus-\n7") == "7"  # a line break stands between
    assert one("minus -7 and 8% and 9") == "9"


def test_papers_and_pairs_are_dealt_by_the_number_of_lines(spark, sf_dir, monkeypatch):
    from strandline.plans import pair_queries

    monkeypatch.setattr(pairs, "PART_ROWS", 300)
    used = lambda f: f.groupBy(F.spark_partition_id()).count().count()
    assert pair_queries.parts(spark, sf_dir) >= 20
    assert used(pair_queries.facts(spark, sf_dir)) > 10 and used(pairs.pair_evidence(pair_queries.facts(spark, sf_dir))) > 10
    e = spark.createDataFrame([("a", "b", 2000, 1), ("a", "b", 2001, 2), ("a", "c", 1999, 3)], "u string, v string, year int, paper_id long")
    assert sorted(map(tuple, pairs.kth_support(e, 1, 3).collect())) == [("a", "b", 2000, 1), ("a", "c", 1999, 3)]


def test_a_verification_queue_never_broadcasts_evidence(spark):
    e = spark.createDataFrame([("a", "b", 1990 + i, i) for i in range(9)] + [("a", "b", 1990, 0)], "u string, v string, year int, paper_id long")
    t = spark.createDataFrame([("a", "b", 1996)], "u string, v string, support_year int")
    got = workflow.verification_queue(t, e, parts=2)
    assert [tuple(r) for r in got.collect()] == [("a", "b", 1996, 7, "0; 1; 2; 3; 4")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_words_are_judged_once_and_stances_come_from_held_words(spark, monkeypatch):
    calls = []
    plain = concepts.normal_label
    monkeypatch.setattr(concepts, "normal_label", lambda *a: calls.append(a) or plain(*a))
    lexicon = concepts.Lexicon(heads=((r"[a-z]+tion", "mechanism_or_process"),))
    assert len(list(concepts.concepts_of("fast reaction slow wordy " * 200 + ".", lexicon))) == 200
    assert len(calls) <= 4 + 200  # four words, and a label for each phrase
    t = spark.createDataFrame([("The cell does not", 1), ("It was shown to", 2), ("We hope; it can", 3), (", but it", 4)], "t string, id int")
    held = t.withColumn("w", concepts.tokens(F.col("t"))).withColumn("c", concepts.clause_words(F.col("w")))
    assert held.where(concepts.stance(F.col("c")) != concepts.assertion(F.col("t"))).count() == 0
    assert [r[0] for r in held.orderBy("id").select(concepts.stance(F.col("c"))).collect()] == ["negated", "observed_assertion", "hypothetical_or_modal", "observed_assertion"]


def test_a_weight_search_without_candidates_has_no_figures(spark):
    rows = spark.createDataFrame([(1, 2, 1997, 1, 0.5, 0.1), (1, 3, 1997, 0, 0.2, 0.3)], "u long, v long, cutoff int, label int, a double, b double")
    weights = search.vectors([0.5, 0.5])[:4]
    run = lambda f, most: search.search(f, ["u", "v"], "cutoff", "label", ["a", "b"], weights, most)
    assert run(rows.limit(0), search.BLOCK).collect() == run(rows.limit(0), -1).collect() == []
    assert run(rows, search.BLOCK).count() == 4


def test_a_curve_without_training_rows_is_the_score(spark):
    rows = spark.createDataFrame([(1, 0.25), (0, 0.75)], "y int, s double")
    assert [r.p for r in models.platt(rows.limit(0), rows, "s").orderBy("s").collect()] == [0.25, 0.75]
    assert models.platt(rows, rows, "s").count() == 2


def test_chains_of_sizes_join_what_all_edges_join(spark, tmp_path):
    from strandline.operators.graph import connected_components
    from strandline.operators.scratch import Scratch
    from strandline.plans import pair_queries

    rows = [(i, "b", "t", "n" if i % 3 else "m", (i * 7) % 50) for i in range(1, 60)] + [(99, "b", "t", None, 3), (98, "b", "t", "n", None), (97, "c", "t", "n", 1), (97, "c", "t", "n", 2), (96, "c", "t", "n", 9), (5, "b", "t", "n", 30)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    every = connected_components(pair_queries.brand_edges(spark, str(tmp_path)), Scratch(spark, "t"), "u", "v")
    got = pair_queries.components(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))
    assert pair_queries.brand_chains(spark, str(tmp_path)).count() < len(rows) < pair_queries.brand_edges(spark, str(tmp_path)).count()


def test_blocks_hold_every_link_once_and_lead_to_the_best(spark):
    import itertools
    import random

    from strandline.operators import transfer

    rng, nodes = random.Random(3), [f"n{i}" for i in range(9)]
    side = lambda: [(u, v, rng.randrange(1, 4), rng.choice([1995, 1996, None])) for u, v in itertools.combinations(nodes, 2) if rng.random() < 0.6]
    (s, t), bank = (side(), side()), "u string, v string, papers long, first_year int"
    source, target = spark.createDataFrame(s, bank), spark.createDataFrame(t, bank)
    roles, df = spark.createDataFrame([(n, "mechanism") for n in nodes[:5]], "node string, role string"), spark.createDataFrame([(n, 3) for n in nodes], "node string, shared_df long")
    blocks = transfer.link_blocks(source, target, roles, df)
    want = {(x, *p[:2], *q[:2]) for p in s for q in t for x in {*p[:2]} & {*q[:2]} if p[:2] != q[:2] or x == p[0]}
    got = transfer.block_links(blocks, source, target, chunk=2).collect()
    assert len(got) == len(want) == blocks.agg(F.sum("links")).first()[0] and blocks.count() < len(want)
    assert {(r.shared, *r.source_pair.split("~"), *r.target_pair.split("~")) for r in got} == want
    order = lambda r: (r.bridge_score, r.source_papers, r.target_papers)
    few = transfer.block_links(transfer.leading(blocks, ["bridge_score", "source_papers", "target_papers"], 10), source, target).collect()
    assert sorted(map(order, few), reverse=True)[:10] == sorted(map(order, got), reverse=True)[:10] and len(few) < len(got)


def test_tiles_fold_every_path_as_plain_rows_do(spark, monkeypatch):
    import itertools
    import random

    from strandline.operators import bridges, tiles, transfer

    rng, nodes = random.Random(5), [f"n{i:02d}" for i in range(24)]
    kinds = "u string, v string, papers long, sentences long, strict long, status string"
    side = lambda: spark.createDataFrame([(u, v, rng.randrange(1, 5), rng.randrange(1, 3), 1, rng.choice([bridges.ACCEPTED, bridges.PENDING])) for u, v in itertools.combinations(nodes, 2) if rng.random() < 0.8], kinds)
    s, t = side(), side()
    want = sorted(map(tuple, bridges.fold(bridges.paths(s, t)).collect()))
    got = bridges.folded_paths(s, t, side=9)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want
    keys = spark.createDataFrame([r[:2] for r in want[::3]], "source_end string, target_end string")
    assert sorted(map(tuple, bridges.folded_paths(s, t, keys, 9).collect())) == want[::3]
    one, two = transfer.ends(s.select("u", "v"), "source"), transfer.ends(t.select("u", "v"), "target")
    assert sorted(map(tuple, tiles.ways(one, two, 9).collect())) == [r[:3] for r in want]
    monkeypatch.setattr(tiles, "ROWS", -(10**9))  # plain rows
    assert sorted(map(tuple, tiles.ways(one, two, 9).collect())) == [r[:3] for r in want]


def test_shared_pairs_are_counted_by_tiles(spark):
    import itertools

    from strandline.operators import summaries

    rows = [(i, f"b{i * k % 7}", k % 3 if i % 5 else None) for i in range(60) for k in range(4)]
    frame = spark.createDataFrame(rows, "i long, b string, z int")
    got = summaries.shared_pairs(frame, "i", ["b", "z"])
    held = {c: {i: {str(r[at]) for r in rows if r[0] == i and r[at] is not None} for i in range(60)} for at, c in ((1, "b"), (2, "z"))}
    want = {(x, y, c, len(s[x] & s[y])) for c, s in held.items() for x, y in itertools.combinations(range(60), 2) if s[x] & s[y]}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
