"""Review workflow: promotion, queues, checks, rule programs, evidence, revisions, excerpts, packing and resumable chunks.

What has to be exact is a plan over tables; only greedy packing, which depends on
the order of its rows, runs a group at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id
from .order import running_sums
from .review import audit, first_per_key


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_or_start(spark: SparkSession, path: str, key: str, review: Sequence[str]) -> DataFrame:
    """The adjudication table at `path`, missing review columns empty, or an empty one; a table without its key is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in (key, *review)))
    got = spark.read.parquet(path)
    if key not in got.columns:
        raise ValueError(f"{path} lacks {key}")
    return got.select("*", *[F.lit("").alias(c) for c in review if c not in got.columns])


def require_keys(rows: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """`rows`, after a check that every key is known and no parent key comes twice; either is an error."""
    unknown = rows.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").select(key).limit(3).collect()
    twice = parent.groupBy(parent_key).agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if unknown or twice:
        raise ValueError(f"unknown {key}: {[r[0] for r in unknown]}; repeated: {[r[0] for r in twice]}")
    return rows


def promote(base: DataFrame, found: DataFrame, verdicts: DataFrame, paper: str, content: str, index: str) -> DataFrame:
    """(paper, content, unit_id, index) of approved rows that `base` lacks, numbered after the last unit of their paper.

    verdicts: (candidate_id, approved); found: (candidate_id, paper, content).  Repeated contents of a paper are promoted once.
    """
    ok = found.join(verdicts.where("approved").select("candidate_id").distinct(), "candidate_id", "left_semi")
    fresh = ok.select(paper, content, stable_id("U", F.col(paper).cast("string"), content).alias("unit_id")).distinct()
    fresh = fresh.join(base.select("unit_id"), "unit_id", "left_anti")
    last = base.groupBy(paper).agg(F.max(index).alias("_last"))
    w = Window.partitionBy(paper).orderBy("unit_id")
    return fresh.join(last, paper, "left").select(paper, content, "unit_id", (F.coalesce("_last", F.lit(0)) + F.row_number().over(w)).alias(index))


def review_queue(rows: DataFrame, score: str, key: str, possible: float, strong: float, margin: float) -> DataFrame:
    """Rows with their band: strong, possible, near the threshold, or below; null scores have none."""
    s = F.col(score)
    band = F.when(s.isNull(), F.lit(None).cast("string")).when(s >= strong, "strong").when(s >= possible, "possible").when(s >= possible - margin, "near_threshold").otherwise("below")
    return rows.withColumn("band", band)


def checks(named: dict[str, DataFrame | Column], rows: DataFrame | None = None) -> DataFrame:
    """(check, failures): frames of offending rows, or conditions that rows of one table must not meet, counted in a single pass."""
    tests = {n: c for n, c in named.items() if isinstance(c, Column)}
    out = audit({n: f for n, f in named.items() if isinstance(f, DataFrame)})
    if tests and rows is not None:
        flat = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in tests.items()])
        long = flat.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in tests])).alias("x")).select("x.*")
        out = long if out is None else out.unionByName(long)
    return out


def mirror_failures(oriented: DataFrame, a: str, b: str) -> DataFrame:
    """Oriented rows whose mirror (ends turned) is missing."""
    turned = oriented.select(F.col(b).alias(a), F.col(a).alias(b)).distinct()
    return oriented.join(turned, [a, b], "left_anti")


def identity_mismatches(rows: DataFrame, parent: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows that disagree with their parent in a field that both have."""
    p = parent.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    differ = F.lit(False)
    for c in fields:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(p, key).where(differ).select(*rows.columns)


def tags(rows: DataFrame, text: str, rules: DataFrame, code: str = "code", pattern: str = "pattern") -> DataFrame:
    """A row for each rule whose pattern the text matches; rules are a table and may be many."""
    return rows.join(rules.select(code, pattern), F.expr(f"{text} rlike {pattern}")).drop(pattern)


def assemble(claims: DataFrame, rules: DataFrame, excluded: DataFrame) -> DataFrame:
    """(program, paper, claim): claims that carry a rule's lever and match its pattern, one a paper, without excluded pairs.

    claims (claim, paper, lever, text), rules (program, lever, pattern), excluded (program, claim).  The lever is an equi-join; the pattern is tested on what meets.
    """
    met = claims.join(rules, "lever").where(F.expr("text rlike pattern")).join(excluded, ["program", "claim"], "left_anti")
    return first_per_key(met.select("program", "paper", "claim"), ["program", "paper"], [F.asc("claim")])


def program_rows(programs: DataFrame, sources: DataFrame, direct: DataFrame, related: DataFrame) -> DataFrame:
    """Each program's sources, direct prior papers, related ones that are not direct, and its priority; programs without any stay."""
    n = lambda rows, name: rows.groupBy("program").agg(F.count_distinct("paper").alias(name))
    near = related.select("program", "paper").join(direct.select("program", "paper"), ["program", "paper"], "left_anti")
    out = programs
    for rows, name in ((sources, "sources"), (direct, "direct"), (near, "related")):
        out = out.join(n(rows, name), "program", "left")
    out = out.na.fill(0, ["sources", "direct", "related"])
    priority = 3 * F.least("sources", F.lit(5)) + 2 * F.least("related", F.lit(3)) - 4 * F.least("direct", F.lit(2))
    return out.withColumn("priority", priority)


def hit_products(rows: DataFrame, key: str, left: dict[str, str], right: dict[str, str], text: str) -> DataFrame:
    """(key, lever, target): every lever and target that a row's text matches; both lists are a row's own."""
    found = lambda rules: F.filter(F.array(*[F.when(F.col(text).rlike(p), F.lit(c)) for c, p in rules.items()]), lambda x: x.isNotNull())
    each = rows.select(key, found(left).alias("l"), F.explode(found(right)).alias("target"))
    return each.select(key, F.explode("l").alias("lever"), "target").distinct()


def manual_overlay(programs: DataFrame, priors: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Programs with the papers of their direct priors of allowed kinds: how many, the earliest year and the sorted ids."""
    ok = priors.where(F.col("kind").isin(*kinds)).select("program", "paper", "year").distinct()
    n = ok.groupBy("program").agg(F.count_distinct("paper").alias("prior_papers"), F.min("year").alias("prior_year"), F.array_join(F.transform(F.array_sort(F.collect_set("paper")), lambda x: x.cast("string")), "; ").alias("prior_ids"))
    return programs.join(n, "program", "left").na.fill(0, ["prior_papers"]).na.fill("", ["prior_ids"])


def verification_queue(events: DataFrame, evidence: DataFrame, examples: int = 5, parts: int | None = None) -> DataFrame:
    """Each transfer with its source papers up to the support year: how many, and the first few in order.

    Pairs are dealt into `parts` once; a pair's papers are numbered and counted in one pass.  Stored
    evidence is much larger in memory than its files, so that it is merged and never broadcast.
    """
    rows = evidence.select("u", "v", F.col("year").alias("y"), "paper_id")
    rows = (rows.repartition(parts, "u", "v") if parts else rows).distinct()
    met = rows.hint("merge").join(events.hint("merge"), ["u", "v"]).where("y <= support_year")
    pair = Window.partitionBy("u", "v")
    placed = met.withColumns({"k": F.row_number().over(pair.orderBy("y", "paper_id")), "n": F.count("*").over(pair)}).where(F.col("k") <= examples)
    return placed.groupBy("u", "v", "support_year").agg(F.max("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "paper_id"))), lambda x: x["paper_id"].cast("string")), "; ").alias("papers"))


def novelty(predictions: DataFrame, seen: DataFrame, score: str) -> DataFrame:
    """Predictions that the wider corpus does not hold, with their new places."""
    left = predictions.join(seen.select("u", "v").distinct(), ["u", "v"], "left_anti").withColumn("_one", F.lit(1).cast("long"))
    return running_sums(left, [F.desc(score), F.asc("u"), F.asc("v")], {"_one": "place"}).drop("_one")


def next_unreviewed(rows: DataFrame, done: DataFrame, key: str, score: str, count: int, possible: float, strong: float) -> DataFrame:
    """The next `count` rows without a decision by score, with their band."""
    left = rows.join(done.select(key), key, "left_anti")
    return review_queue(left.orderBy(F.desc(score), key).limit(count), score, key, possible, strong, 0.0)


def packets(groups: DataFrame, evidence: DataFrame, group: str, item: str) -> DataFrame:
    """A map from item id to evidence for each group's items, which are few."""
    met = groups.select(group, F.explode(item).alias("_i")).distinct().join(evidence.select(F.col("id").alias("_i"), "quote"), "_i")
    return met.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_i", "quote")))).alias("packet"))


def repeats(rows: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary, coded): values that come more than once get a reference; `unrepeat` gives the rows back."""
    n = rows.groupBy(value).agg(F.count("*").alias("n")).where("n > 1")
    names = n.select(value, F.concat(F.lit("$"), F.substring(F.sha2(value, 256), 1, 16)).alias("ref"))
    coded = rows.join(names, value, "left").withColumn(value, F.when(F.col("ref").isNull(), F.col(value))).select(*rows.columns, "ref")
    return names, coded


def unrepeat(names: DataFrame, coded: DataFrame, value: str) -> DataFrame:
    back = coded.join(names.withColumnRenamed(value, "_v"), "ref", "left").withColumn(value, F.coalesce(value, "_v"))
    return back.select(*[c for c in coded.columns if c != "ref"])


def apply_revisions(rows: DataFrame, revisions: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(revised rows, refused revisions): a revision holds only if its old value is the one there; the last of a key counts."""
    last = revisions.groupBy(key).agg(F.max_by(F.struct("old", "new"), "seq").alias("r")).select(key, "r.*")
    met = rows.join(last.withColumn("_has", F.lit(True)), key, "left")
    fits = F.coalesce("_has", F.lit(False)) & F.col(column).eqNullSafe(F.col("old"))
    done = met.withColumn(column, F.when(fits, F.col("new")).otherwise(F.col(column))).select(*rows.columns)
    refused = last.join(rows.select(key, F.col(column).alias("_now")), key, "left").where(~F.col("_now").eqNullSafe(F.col("old"))).select(key, "old", "new")
    return done, refused


def bind_excerpts(rows: DataFrame, quote: str, source: str, least: int = 8) -> DataFrame:
    """The quote where it is verbatim in its source and long enough, else the whole source, and which of them it is."""
    ok = F.coalesce(F.contains(F.col(source), F.col(quote)) & (F.length(quote) >= least), F.lit(False))
    return rows.withColumn("evidence", F.when(ok, F.col(quote)).otherwise(F.col(source))).withColumn("verbatim", ok)


def span_failures(rows: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stored spans (start, stop, surface) that are not what their text has there."""
    met = rows.join(docs.select(key, text), key, "left")
    return met.where(~F.coalesce(F.substring(F.col(text), F.col("start") + 1, F.col("stop") - F.col("start")) == F.col("surface"), F.lit(False))).select(*rows.columns)


def output_problems(rows: DataFrame, wanted: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """(key, problem): answers that are missing, unasked for, repeated, of an unknown relation or without a reason."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    of = lambda frame, name: frame.select(key, F.lit(name).alias("problem"))
    out = of(wanted.join(rows, key, "left_anti"), "missing").unionByName(of(rows.join(wanted, key, "left_anti").select(key).distinct(), "unasked")).unionByName(of(n.where("n > 1"), "repeated"))
    out = out.unionByName(of(rows.where(~F.coalesce(F.col("relation").isin(*allowed), F.lit(False))), "unknown_relation"))
    return out.unionByName(of(rows.where(F.trim(F.coalesce("reason", F.lit(""))) == ""), "no_reason"))


def review_summary(batches: DataFrame, decided: DataFrame, stamps: DataFrame) -> DataFrame:
    """(batch, items, decided, status): batches whose inputs have changed since are stale, and counted apart."""
    n = decided.groupBy("batch").agg(F.count_distinct("item").alias("decided"))
    rows = batches.groupBy("batch").agg(F.count_distinct("item").alias("items"), F.max("stamp").alias("stamp")).join(n, "batch", "left").na.fill(0, ["decided"]).join(stamps.withColumnRenamed("stamp", "_now"), "batch", "left")
    status = F.when(~F.col("stamp").eqNullSafe(F.col("_now")), "stale").when(F.col("decided") >= F.col("items"), "complete").when(F.col("decided") > 0, "partial").otherwise("open")
    return rows.select("batch", "items", "decided", status.alias("status"))


def role_states(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Each row's role, the latest override before the model's before the default, and where it comes from."""
    last = overrides.groupBy(key).agg(F.max_by("role", F.struct("seq", "role")).alias("_o"))
    out = rows.join(last, key, "left")
    return out.withColumn("state", F.when(F.col("_o").isNotNull(), "override").when(F.col("model_role").isNotNull(), "model").otherwise("default")).withColumn("role", F.coalesce("_o", "model_role", F.lit("unassigned"))).drop("_o", "model_role")


def resumable(rows: DataFrame, key: str, path: str, chunks: int, work: Callable[[DataFrame], DataFrame]) -> Iterator[int]:
    """Runs `work` over hashed chunks of the rows whose key has no result at `path` yet; each chunk is one atomic write.

    A run that is lost is taken up again: finished chunks stay, the one that failed left nothing.
    """
    spark = rows.sparkSession
    for i in range(chunks):
        done = spark.read.parquet(f"{path}/chunk={i}").select(key) if exists(spark, f"{path}/chunk={i}/_SUCCESS") else None
        part = rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(chunks)) == i)
        left = part if done is None else part.join(done, key, "left_anti")
        if done is not None and left.isEmpty():
            continue
        work(left).write.mode("append" if done is not None else "overwrite").parquet(f"{path}/chunk={i}")
        yield i
