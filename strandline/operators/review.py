"""Dedupe, audits, sampling, decision overlays and equivalence conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .order import running_sums
from .scratch import Scratch


def first_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; a group limit keeps it map-side first."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def keyed_dedupe(rows: DataFrame, key: Column, order: list[Column], member: str, label: str) -> DataFrame:
    """One row a key: the best row, the group's size and its distinct labels, packed and sorted."""
    each = rows.withColumn("dedupe_key", key)
    best = first_per_key(each, ["dedupe_key"], order)
    union = each.groupBy("dedupe_key").agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set(label)), "|").alias("labels"))
    return best.join(union, "dedupe_key").select("dedupe_key", member, "members", "labels")


def minus(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a whose key b lacks: the asymmetric removal between sources."""
    return a.join(b.select(*key).distinct(), key, "left_anti")


def same_set(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def audit(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, failures): one counted row a named frame of offending rows."""
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
        out = one if out is None else out.unionByName(one)
    return out


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").where(F.col(key).isNotNull())


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def draw(key: Column | str, seed: str) -> Column:
    """A deterministic order that replaces a random generator."""
    return F.sha2(F.concat(F.lit(seed), F.lit(":"), (F.col(key) if isinstance(key, str) else key).cast("string")), 256)


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int, seed: str) -> DataFrame:
    """One row a stratum, then the largest deficit to its share, and weights N / n.

    Strata are few; their sizes are one aggregate, and rows are taken by hash order.
    """
    n = rows.groupBy(stratum).agg(F.count("*").alias("population"))
    counts = {r[0]: r[1] for r in n.collect()}
    total = sum(counts.values())
    take = dict.fromkeys(counts, 1)
    while sum(take.values()) < min(size, total):
        open_ = [s for s in counts if take[s] < counts[s]]
        best = max(open_, key=lambda s: (size * counts[s] / total - take[s], str(s)))
        take[best] += 1
    plan = rows.sparkSession.createDataFrame([(s, counts[s], take[s]) for s in counts], f"{stratum} {rows.schema[stratum].dataType.simpleString()}, population long, taken int")
    w = Window.partitionBy(stratum).orderBy(draw(key, seed), key)
    each = rows.join(F.broadcast(plan), stratum).withColumn("_k", F.row_number().over(w)).where("_k <= taken")
    return each.select(stratum, key, "population", "taken", (F.col("taken") / F.col("population")).alias("probability"), (F.col("population") / F.col("taken")).alias("weight"))


def hard_negatives(rows: DataFrame, y: str, score: str, key: list[str], ratio: int = 15, seed: str = "27") -> DataFrame:
    """All positives, and up to `ratio` negatives a positive: half the highest scored, half by hash."""
    positives = rows.where(F.col(y) == 1)
    most = ratio * positives.count()
    half = most // 2
    negatives = rows.where(F.col(y) == 0)
    # a limit would bring all that it keeps to one task; running counts over a range partition do not
    first = lambda frame, order, n: running_sums(frame.withColumn("_one", F.lit(1)), [*order, *[F.col(k) for k in key]], {"_one": "_place"}).where(F.col("_place") <= n).drop("_one", "_place")
    hard = first(negatives, [F.desc(score)], half)
    rest = negatives.join(hard.select(*key), key, "left_anti")
    lot = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key]), 256)
    drawn = first(rest, [lot], most - half)
    return positives.withColumn("kind", F.lit("positive")).unionByName(hard.withColumn("kind", F.lit("hard"))).unionByName(drawn.withColumn("kind", F.lit("drawn")))


def bootstrap_mean(rows: DataFrame, value: str, key: str, times: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of a mean under Poisson(1) resampling weights from hashes: no row is moved for a resample.

    Weights come from the inverse distribution function of one hash a row and
    resample; the sums fold on the map side.
    """
    rep = rows.sparkSession.createDataFrame([(i,) for i in range(times)], "rep int")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("rep").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    cuts, total, p = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += p
        cuts.append(total)
        p /= k + 1
    weight = sum(((F.col("u") >= c).cast("int") for c in cuts), F.lit(0))
    each = rows.select(key, value).join(F.broadcast(rep)).withColumn("u", u).withColumn("w", weight)
    means = each.groupBy("rep").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"), F.avg("m").alias("middle"))


#: Each relation and what it is when the pair is turned round.
INVERSE = {"broader_than": "narrower_than", "narrower_than": "broader_than", "equivalent_to": "equivalent_to", "related_to": "related_to", "distinct_from": "distinct_from"}


def overlay(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """The latest decision on each pair (a, b), in the pair's own direction; later `seq` wins over either direction."""
    turned = F.coalesce(F.create_map(*[F.lit(x) for kv in INVERSE.items() for x in kv])[F.col("relation")], F.col("relation"))
    each = decisions.select("a", "b", "relation", "seq").unionByName(decisions.select(F.col("b").alias("a"), F.col("a").alias("b"), turned.alias("relation"), "seq"))
    latest = each.groupBy("a", "b").agg(F.max_by("relation", F.struct("seq", "relation")).alias("relation"))
    return candidates.join(latest, ["a", "b"], "left").withColumn("status", F.when(F.col("relation").isNull(), "open").otherwise("decided"))


def equivalence_conflicts(relations: DataFrame) -> DataFrame:
    """Pairs decided to differ whose ends are joined by a chain of equivalences: (a, b, component)."""
    scratch = Scratch(relations.sparkSession, "equivalence")
    parts = connected_components(relations.where("relation = 'equivalent_to'"), scratch, "a", "b")
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    return relations.where("relation = 'distinct_from'").join(of("a"), "a").join(of("b"), "b").where("c_a = c_b").select("a", "b", F.col("c_a").alias("component"))


def concentration(rows: DataFrame, by: str, part: str) -> DataFrame:
    """Sum of squared shares of `part` within `by`."""
    n = rows.groupBy(by, part).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi"), F.sum("n").alias("rows"), F.count("*").alias("parts"))


def cumulative_share(rows: DataFrame, by: str, part: str) -> DataFrame:
    n = rows.groupBy(by, part).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), part)
    total = Window.partitionBy(by)
    return n.select(by, part, "n", F.row_number().over(w).alias("place"), (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(total)).alias("share"))


def table_hash(rows: DataFrame) -> DataFrame:
    """Row count and an order-free hash of all rows: the sum of the leading 48 bits of each row's MD5."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in rows.columns])
    return rows.agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))
