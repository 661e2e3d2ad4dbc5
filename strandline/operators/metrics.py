"""Exact ranking metrics by group: AUC, step AP, precision, recall and NDCG at k, F1 thresholds, confusion, Brier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import running_sums


def ties(scored: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """Positives and rows of each score, and both cumulated from the top.

    Ties are folded before they are ordered, and distinct scores are dealt by range, so no group is ordered in one task.
    """
    each = scored.groupBy(*by, score).agg(F.sum(y).alias("tp"), F.count("*").alias("n"))
    return running_sums(each, [F.desc(score)], {"tp": "ctp", "n": "cn"}, by)


def first_rows(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """(key, r) of the k rows with the highest score; ties go by key.  Only k rows are numbered."""
    order = [F.desc(score), F.asc(key)]
    return rows.orderBy(*order).limit(k).select(key, F.row_number().over(Window.orderBy(*order)).alias("r"))


def auc_ap(scored: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """AUC by average ranks (null for a single class), AP as step sum, lift over prevalence."""
    t = ties(scored, by, score, y)
    below = F.col("n") - F.col("tp")
    out = t.groupBy(*by).agg(F.sum("tp").alias("positives"), F.sum("n").alias("rows"), F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("_ap"), F.sum(below * (F.col("ctp") - F.col("tp") / 2)).alias("_u"))
    p, q = F.col("positives"), F.col("rows") - F.col("positives")
    return out.select(*by, "positives", "rows", F.when((p > 0) & (q > 0), F.col("_u") / (p * q)).alias("auc"), F.when(p > 0, F.col("_ap") / p).alias("ap"), F.when(p > 0, F.col("_ap") / p / (p / F.col("rows"))).alias("lift"))


def at_k(scored: DataFrame, by: list[str], ks: list[int], key: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """(by, k, hits, precision, recall, ndcg), ranked by score, then key; precision is null where fewer than k rows exist."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *key)
    top = scored.select(*by, y, F.row_number().over(w).alias("r")).where(F.col("r") <= max(ks))
    total = scored.groupBy(*by).agg(F.sum(y).alias("positives"), F.count("*").alias("rows"))
    k = scored.sparkSession.createDataFrame([(x,) for x in ks], "k int")
    each = top.join(F.broadcast(k), F.col("r") <= F.col("k")).groupBy(*by, "k").agg(F.sum(y).alias("hits"), F.sum(F.col(y) / F.log2(F.col("r") + 1)).alias("_dcg"))
    out = each.join(total, by) if by else each.join(F.broadcast(total))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("k", "positives").cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return out.select(*by, "k", "hits", F.when(F.col("rows") >= F.col("k"), F.col("hits") / F.col("k")).alias("precision"), F.when(F.col("positives") > 0, F.col("hits") / F.col("positives")).alias("recall"), F.when(F.col("positives") > 0, F.col("_dcg") / ideal).alias("ndcg"))


def best_f1(scored: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """The highest threshold with the largest F1, and the confusion there."""
    t = ties(scored, by, score, y)
    total = scored.groupBy(*by).agg(F.sum(y).alias("positives"), F.count("*").alias("rows"))
    t = t.join(total, by) if by else t.join(F.broadcast(total))
    f1 = 2 * F.col("ctp") / (F.col("cn") + F.col("positives"))
    best = t.withColumn("f1", f1).groupBy(*by).agg(F.max_by(F.struct(F.col(score).alias("threshold"), "f1", "ctp", "cn", "positives", "rows"), F.struct("f1", score)).alias("b"))
    return best.select(*by, "b.threshold", "b.f1", F.col("b.ctp").alias("tp"), (F.col("b.cn") - F.col("b.ctp")).alias("fp"), (F.col("b.positives") - F.col("b.ctp")).alias("fn"), (F.col("b.rows") - F.col("b.cn") - F.col("b.positives") + F.col("b.ctp")).alias("tn"))


def brier(scored: DataFrame, by: list[str], p: str = "p", y: str = "y") -> DataFrame:
    return scored.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def topk_overlap(a: DataFrame, b: DataFrame, ks: list[int], item: str, rank: str) -> DataFrame:
    """Share of the first k that two rankings have in common."""
    k = a.sparkSession.createDataFrame([(x,) for x in ks], "k int")
    both = a.where(F.col(rank) <= max(ks)).select(item, F.col(rank).alias("ra")).join(b.where(F.col(rank) <= max(ks)).select(item, F.col(rank).alias("rb")), item)
    return k.join(F.broadcast(both), (F.col("ra") <= F.col("k")) & (F.col("rb") <= F.col("k")), "left").groupBy("k").agg((F.count(item) / F.col("k")).alias("overlap"))
