"""Evaluation beyond single metrics: curves, error classes, audits, and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as M
from .order import running_sums
from .review import draw

def placed(scored: DataFrame, by: Sequence[str], score: str, key: Sequence[str]) -> DataFrame:
    """Adds place: 1 for the best score of each group, ties by key, from running counts over a range partition."""
    one = scored.withColumn("_one", F.lit(1).cast("long"))
    return running_sums(one, [F.desc(score), *[F.asc(k) for k in key]], {"_one": "place"}, list(by)).drop("_one")


def precision_curve(scored: DataFrame, by: Sequence[str], score: str, y: str, key: Sequence[str], most: int) -> DataFrame:
    """(by, place, hits, precision, recall) of the first `most` places."""
    top = placed(scored, by, score, key).where(F.col("place") <= most)
    w = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # `most` rows a group
    n = scored.groupBy(*by).agg(F.sum(y).alias("positives"))
    out = top.select(*by, "place", F.sum(y).over(w).alias("hits")).join(n, list(by))
    return out.select(*by, "place", "hits", (F.col("hits") / F.col("place")).alias("precision"), F.when(F.col("positives") > 0, F.col("hits") / F.col("positives")).alias("recall"))


def error_classes(scored: DataFrame, by: Sequence[str], score: str, y: str, key: Sequence[str], k: int) -> DataFrame:
    """Adds error: TP, FP, FN or TN when the first k of each group are predicted."""
    out = placed(scored, by, score, key)
    hit, inside = F.col(y) == 1, F.col("place") <= k
    return out.withColumn("error", F.when(inside & hit, "TP").when(inside, "FP").when(hit, "FN").otherwise("TN"))


def confusion_at_k(scored: DataFrame, by: Sequence[str], score: str, y: str, key: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """(by, k, tp, fp, fn, tn, precision, recall, f1) of the first k of each group."""
    rows = placed(scored, by, score, key).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    inside, hit = F.col("place") <= F.col("k"), F.col(y) == 1
    n = rows.groupBy(*by, "k").agg(F.count_if(inside & hit).alias("tp"), F.count_if(inside & ~hit).alias("fp"), F.count_if(~inside & hit).alias("fn"), F.count_if(~inside & ~hit).alias("tn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return n.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def contamination(scored: DataFrame, by: Sequence[str], ambiguous: Column, score: str = "score", y: str = "y") -> DataFrame:
    """AUC and AP of each group with all rows, and without the positives that are ambiguous."""
    rows = scored.withColumn("_odd", F.coalesce(ambiguous, F.lit(False)) & (F.col(y) == 1))
    both = rows.withColumn("audit", F.lit("with_ambiguous")).unionByName(rows.where("not _odd").withColumn("audit", F.lit("without_ambiguous")))
    return M.auc_ap(both, [*by, "audit"], score, y)


def hash_sample(rows: DataFrame, key: str, size: int, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """The first `size` rows of each group (or of all) in the order of a seeded hash."""
    w = Window.partitionBy(*by).orderBy(draw(key, seed), key)
    if not by:
        return rows.orderBy(draw(key, seed), key).limit(size)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= size).drop("_k")


def spaced_sample(rows: DataFrame, value: str, key: str, size: int) -> DataFrame:
    """`size` rows at even steps of the order by value and key, the first and the last among them."""
    at = running_sums(rows.withColumn("_one", F.lit(1).cast("long")), [F.asc(value), F.asc(key)], {"_one": "place"}).drop("_one")
    total = rows.agg(F.count("*").alias("_n"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(max(size - 1, 1))) + 1)
    return at.crossJoin(F.broadcast(total)).where(F.array_contains(wanted, F.col("place"))).drop("_n")  # one row


def yearly_sample(rows: DataFrame, year: str, y: str, score: str, key: Sequence[str], ratio: int, seed: str) -> DataFrame:
    """Each year's positives, and for each of them `ratio` negatives: half of the highest score, half by hash."""
    positives = rows.where(F.col(y) == 1).groupBy(year).agg(F.count("*").alias("_p"))
    negative = rows.where(F.col(y) == 0).join(positives, year)
    lot = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key]), 256)
    one = negative.withColumn("_one", F.lit(1).cast("long"))
    hard = running_sums(one, [F.desc(score), *[F.asc(k) for k in key]], {"_one": "_place"}, [year])
    half = F.floor(F.col("_p") * ratio / 2)
    rest = running_sums(hard.where(F.col("_place") > half).withColumn("_lot", lot).drop("_place"), [F.asc("_lot")], {"_one": "_place"}, [year])
    kept = hard.where(F.col("_place") <= half).select(*rows.columns).unionByName(rest.where(F.col("_place") <= F.col("_p") * ratio - half).select(*rows.columns))
    return rows.where(F.col(y) == 1).unionByName(kept)


def unified(a: DataFrame, b: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of both sources without those of `b` that share any non-null key with `a`, each key's first row only; a null key is no key."""
    rest = b
    for k in keys:
        known = a.where(F.col(k).isNotNull()).select(k).distinct()
        rest = rest.join(known, k, "left_anti").select(*b.columns)
    out = a.withColumn("origin", F.lit("a")).unionByName(rest.withColumn("origin", F.lit("b")))
    for k in keys:
        w = Window.partitionBy(k).orderBy("origin", *order)
        first = out.where(F.col(k).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
        out = first.unionByName(out.where(F.col(k).isNull()))
    return out


def dense_ids(rows: DataFrame, key: str, order: str, name: str = "dense_id") -> DataFrame:
    """(key, name): keys numbered from 1 by their first appearance."""
    first = rows.groupBy(key).agg(F.min(order).alias("_o")).withColumn("_one", F.lit(1).cast("long"))
    return running_sums(first, [F.asc("_o"), F.asc(key)], {"_one": name}).select(key, name)


def compared(old: DataFrame, new: DataFrame, key: Sequence[str], score: str) -> DataFrame:
    """(key, old, new, side): the outer join of two rankings with where each row comes from."""
    a, b = old.select(*key, F.col(score).alias("old"), F.lit(1).alias("_a")), new.select(*key, F.col(score).alias("new"), F.lit(1).alias("_b"))
    side = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "left_only").otherwise("right_only")
    return a.join(b, list(key), "full").select(*key, "old", "new", side.alias("side"))


def aliases(terms: DataFrame, merge: DataFrame) -> DataFrame:
    """(alias, concept): cleaned terms of each concept after the merge map, each alias and concept once; terms (term, concept), merge (concept, into)."""
    alias = F.lower(F.trim(F.regexp_replace("term", r"\s+", " ")))
    return terms.join(merge, "concept", "left").select(alias.alias("alias"), F.coalesce("into", "concept").alias("concept")).where("alias <> ''").distinct()
