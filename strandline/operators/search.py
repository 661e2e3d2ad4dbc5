"""Many variants of one evaluation at once: weight vectors over rank columns, and resamples as columns of counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from .order import pct_ranks
from .scratch import Scratch

#: Bytes of rank matrices and labels that may be broadcast.
BLOCK = 256 << 20
#: Places at which precision counts, and the weights of AP and of these precisions in the objective; what spread over folds costs.
PLACES, AP_SHARE, PLACE_SHARE, SPREAD = (10, 25, 50), 0.40, 0.20, 0.10
#: Concentrations of the random weights, draws of each, and the seed.
ALPHAS, DRAWS, SEED = (0.25, 0.5, 1.0, 2.0, 5.0), 2500, 27
PRIME = 2147483647


def vectors(baseline: Sequence[float], alphas: Sequence[float] = ALPHAS, draws: int = DRAWS, seed: int = SEED) -> np.ndarray:
    """Weights to try, a row each: the baseline, equal weights, every column alone, and random ones that sum to 1."""
    k, rng = len(baseline), np.random.default_rng(seed)
    return np.vstack([np.asarray(baseline, float), np.full(k, 1 / k), np.eye(k), *[rng.dirichlet(np.full(k, a), draws) for a in alphas]])


def judge(score: np.ndarray, y: np.ndarray, places: Sequence[int] = PLACES) -> list[float]:
    """AP as a step sum over distinct scores, and precision at places; equal scores keep the order of the rows for these."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], y[order]
    end = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    tp = np.cumsum(hit)[end]
    ap = float((np.diff(tp, prepend=0) * tp / (end + 1)).sum() / max(tp[-1], 1)) if len(s) else 0.0
    return [ap, *(float(hit[:k].mean()) if len(hit) else 0.0 for k in places)]


def search(frame: DataFrame, key: Sequence[str], fold: str, y: str, names: Sequence[str], weights: np.ndarray, most: int = BLOCK, chunk: int = 32) -> DataFrame:
    """(choice, mean_ap, mean_p10, ..., mean_score, objective) of every weight vector over the folds.

    Columns are ranked once.  Ranks of up to `most` bytes are broadcast as a matrix a
    fold, and vectors are dealt over tasks, so that a vector costs one product and one
    sort a fold and nothing is shuffled.  More rows are scored as columns of the
    distributed frame, `chunk` vectors in one pass.  A fold without positives counts as
    zero AP; scores are rounded to nine digits, and ties go by key.  Without rows there are no folds, and no figures.
    """
    scratch = Scratch(frame.sparkSession, "search")
    ranks = pct_ranks(frame, key, names, fold).join(frame.select(*key, fold, F.col(y).cast("int").alias("y")), [*key, fold])
    ranks = scratch.save(ranks.select(fold, *key, *[f"pr_{c}" for c in names], "y"), "ranks")
    if ranks.count() * 8 * (len(names) + 1) > most:
        return _by_columns(ranks, key, fold, names, weights, chunk)
    t = ranks.orderBy(fold, *key).toPandas()
    blocks = [(g[[f"pr_{c}" for c in names]].to_numpy(), g["y"].to_numpy()) for _, g in t.groupby(fold, sort=True)]
    spark = frame.sparkSession
    held = spark.sparkContext.broadcast(blocks)
    rows = spark.createDataFrame(pd.DataFrame({"choice": np.arange(len(weights)), "w": list(weights.tolist())}), "choice int, w array<double>")
    made = ["mean_ap", *[f"mean_p{k}" for k in PLACES], "mean_score", "objective"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for choice, w in zip(f["choice"], f["w"], strict=True):
                each = np.array([judge(np.round(m @ np.asarray(w), 9), hit) for m, hit in held.value])
                score = each @ np.array([AP_SHARE, *[PLACE_SHARE] * len(PLACES)])
                out.append((choice, *each.mean(0), score.mean(), score.mean() - SPREAD * score.std()))
            yield pd.DataFrame(out, columns=["choice", *made])

    rows = rows if blocks else rows.limit(0)
    parts = max(1, min(len(weights), 4 * spark.sparkContext.defaultParallelism))
    return rows.repartition(parts, "choice").mapInPandas(run, "choice int, " + ", ".join(f"{c} double" for c in made))


def _by_columns(ranks: DataFrame, key: Sequence[str], fold: str, names: Sequence[str], weights: np.ndarray, chunk: int) -> DataFrame:
    """The same figures from the distributed frame."""
    out = None
    folds = ranks.select(fold).distinct().count()
    for a in range(0, len(weights), chunk):
        total = lambda w: F.round(sum((float(x) * F.col(f"pr_{c}") for c, x in zip(names, w, strict=True)), F.lit(0.0)), 9)
        each = F.explode(F.array(*[F.struct(F.lit(a + i).alias("choice"), total(w).alias("score")) for i, w in enumerate(weights[a : a + chunk])]))
        rows = ranks.select(fold, *key, "y", each.alias("c")).select(fold, *key, "y", "c.*")
        ap = M.auc_ap(rows, [fold, "choice"]).select(fold, "choice", F.coalesce("ap", F.lit(0.0)).alias("ap"))
        sizes = rows.groupBy(fold, "choice").agg(F.count("*").alias("n"))
        at = M.at_k(rows, [fold, "choice"], list(PLACES), list(key)).join(sizes, [fold, "choice"])
        at = at.groupBy(fold, "choice").agg(*[F.max(F.when(F.col("k") == k, F.col("hits") / F.least(F.col("n"), F.lit(k)))).alias(f"p{k}") for k in PLACES])
        got = ap.join(at, [fold, "choice"]).withColumn("score", AP_SHARE * F.col("ap") + sum((PLACE_SHARE * F.col(f"p{k}") for k in PLACES), F.lit(0.0)))
        mean = lambda c: (F.sum(c) / folds).alias(f"mean_{c}")
        got = got.groupBy("choice").agg(mean("ap"), *[mean(f"p{k}") for k in PLACES], mean("score"), F.stddev_pop("score").alias("_s"))
        got = got.select("choice", "mean_ap", *[f"mean_p{k}" for k in PLACES], "mean_score", (F.col("mean_score") - SPREAD * F.col("_s")).alias("objective"))
        out = got if out is None else out.unionByName(got)
    return out


def poisson_cuts(most: int = 8) -> list[float]:
    """The distribution function of Poisson(1) below `most`."""
    cuts, total, p = [], 0.0, float(np.exp(-1))
    for k in range(most):
        total += p
        cuts.append(total)
        p /= k + 1
    return cuts


def draws(key: np.ndarray, times: int) -> np.ndarray:
    """A number from 0 to 1 for each key and resample: products modulo a prime, the same in any engine with 64-bit integers."""
    k, r = np.mod(key.astype(np.int64), PRIME)[:, None], np.arange(times, dtype=np.int64)[None, :]
    h = (k * 48271 + r * 69621 + 12345) % PRIME
    h = (h * h % PRIME + k + r) % PRIME
    h = (h * h % PRIME + 7919 * r) % PRIME
    return (h * 48271 % PRIME) / PRIME


def resampled(scored: DataFrame, key: Column, score: str, y: str, times: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(metric, low, high, middle, valid): percentile intervals of AUC and AP over `times` resamples; those of one class do not count.

    A row counts Poisson(1) times in each resample, by a hash of its whole-number `key`.
    Rows are dealt by score ranges and folded there: a resample is a column of counts,
    rows are never copied.  The first pass gives each range's totals, the second the
    sums above it; a range gives four numbers a resample.  A null score or label is left out.
    """
    scratch = Scratch(scored.sparkSession, "resamples")
    rows = scored.select(key.cast("long").alias("k"), F.col(score).cast("double").alias("s"), F.col(y).cast("int").alias("y")).where("s is not null and y is not null")
    rows = scratch.save(rows.repartitionByRange(F.desc("s")).withColumn("part", F.spark_partition_id()).sortWithinPartitions(F.desc("s")), "ranges")
    cuts = np.array(poisson_cuts())

    def weights(f: pd.DataFrame) -> np.ndarray:
        return np.searchsorted(cuts, draws(f["k"].to_numpy(), times), "right")

    def total(f: pd.DataFrame) -> pd.DataFrame:
        n, tp = np.zeros(times, np.int64), np.zeros(times, np.int64)
        for a in range(0, len(f), 1024):
            w = weights(f[a : a + 1024])
            n += w.sum(0)
            tp += (w * f["y"].to_numpy()[a : a + 1024, None]).sum(0)
        return pd.DataFrame({"part": [f["part"].iloc[0]], "n": [n.tolist()], "tp": [tp.tolist()]})

    sums = scratch.save(rows.groupBy("part").applyInPandas(total, "part int, n array<long>, tp array<long>"), "totals")
    each = sums.select("part", F.posexplode(F.arrays_zip("n", "tp")).alias("rep", "x")).select("part", "rep", "x.*")
    above = each.alias("a").join(each.alias("b"), (F.col("a.rep") == F.col("b.rep")) & (F.col("b.part") < F.col("a.part")), "left").groupBy("a.part", "a.rep").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b.tp"), F.lit(0)).alias("tp"))
    above = above.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("rep", "n", "tp"))).alias("above"))

    def area(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        f = left.sort_values("s", ascending=False, kind="stable")
        start = right["above"].iloc[0]
        cn, ctp = (np.array([x[c] for x in start], np.int64) for c in ("n", "tp"))
        u, a = np.zeros(times), np.zeros(times)
        for _, g in f.groupby("s", sort=False):  # one score: its rows are one step
            n, tp = np.zeros(times, np.int64), np.zeros(times, np.int64)
            for i in range(0, len(g), 1024):
                w = weights(g[i : i + 1024])
                n += w.sum(0)
                tp += (w * g["y"].to_numpy()[i : i + 1024, None]).sum(0)
            cn, ctp = cn + n, ctp + tp
            u += (n - tp) * (ctp - tp / 2)
            a += np.where(tp > 0, tp * ctp / np.maximum(cn, 1), 0.0)
        return pd.DataFrame({"rep": np.arange(times), "u": u, "a": a})

    parts = rows.groupBy("part").cogroup(above.groupBy("part")).applyInPandas(area, "rep int, u double, a double").groupBy("rep").agg(F.sum("u").alias("u"), F.sum("a").alias("a"))
    size = each.groupBy("rep").agg(F.sum("tp").alias("p"), F.sum("n").alias("n"))
    ok = parts.join(size, "rep").where("p > 0 and p < n")
    one = lambda name, x: F.struct(F.lit(name).alias("metric"), x.alias("x"))
    long = ok.select(F.explode(F.array(one("auc", F.col("u") / (F.col("p") * (F.col("n") - F.col("p")))), one("ap", F.col("a") / F.col("p")))).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.percentile("x", F.lit(low)).alias("low"), F.percentile("x", F.lit(high)).alias("high"), F.avg("x").alias("middle"), F.count("*").alias("valid"))
