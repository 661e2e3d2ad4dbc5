"""Model queries: fitted, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import models as L
from ..operators.scratch import Scratch
from . import link_queries as P
from . import settings as cfg

FEATURES = (
    "degree_min", "degree_max", "common_neighbors", "jaccard", "adamic_adar", "resource_allocation", "preferential_attachment", "shortest_path", "semantic_similarity",
    "frequency_min", "frequency_max", "frequency_balance", "recent_frequency_sum", "trend_u", "trend_v", "age_u", "age_v", "target_frequency_sum", "target_both_seen", "same_type",
)


def frames(s: SparkSession, d: str) -> DataFrame:
    """Featured candidates of all cutoffs with the seven-term graph score, written once."""
    return Scratch(s, "frames").save(P.scored(s, d, cfg.CUTOFFS).withColumnRenamed("label", "y"), "frames")


def link_prediction(s: SparkSession, d: str) -> DataFrame:
    """AUC and AP on the last cutoff of a logistic model, a forest and the graph score, trained on the ones before."""
    rows = frames(s, d)
    train, test = rows.where(F.col("cutoff") < cfg.CUTOFFS[-1]), rows.where(F.col("cutoff") == cfg.CUTOFFS[-1])
    test = L.fit_or_fallback(train, test, "logistic", FEATURES, "graph_score", maxIter=50)
    test = L.fit_or_fallback(train, test, "forest", FEATURES, "graph_score", numTrees=20, maxDepth=5, seed=27)
    long = test.select("u", "v", "y", "logistic", "forest", "graph_score").unpivot(["u", "v", "y"], ["logistic", "forest", "graph_score"], "model", "score")
    return M.auc_ap(long.withColumn("y", F.col("y").cast("int")), ["model"])


def calibration(s: SparkSession, d: str) -> DataFrame:
    """Brier score of the graph score as it is and calibrated on the cutoffs before."""
    rows = frames(s, d)
    train, test = rows.where(F.col("cutoff") < cfg.CUTOFFS[-1]), rows.where(F.col("cutoff") == cfg.CUTOFFS[-1])
    fitted = L.platt(train, test, "graph_score")
    return M.brier(fitted.withColumn("kind", F.lit("calibrated")), ["kind"]).unionByName(M.brier(test.withColumn("p", F.col("graph_score")).withColumn("kind", F.lit("raw")), ["kind"]))


def blend_selection(s: SparkSession, d: str) -> DataFrame:
    """The blend of common neighbours and preferential attachment that the early cutoffs choose, on the last one."""
    return L.select(L.blends(frames(s, d), "common_neighbors", "preferential_attachment", "cutoff"), "cutoff", "blend", cfg.CUTOFFS[-1])


def families(s: SparkSession, d: str) -> DataFrame:
    """AUC and AP on the last cutoff of every model family, trained on the cutoffs before with fifteen negatives a positive."""
    from ..operators.review import hard_negatives

    rows = frames(s, d)
    train, test = rows.where(F.col("cutoff") < cfg.CUTOFFS[-1]), rows.where(F.col("cutoff") == cfg.CUTOFFS[-1])
    few = Scratch(s, "train").save(hard_negatives(train, "y", "graph_score", ["cutoff", "u", "v"], 15).drop("kind"), "train")
    params = {"forest": {"numTrees": 20, "maxDepth": 4}, "boosted": {"maxIter": 5, "maxDepth": 3}, "machine": {"maxIter": 20, "factorSize": 2}, "perceptron": {"maxIter": 30}, "svm": {"maxIter": 20}}
    for name in L.FAMILIES:
        test = Scratch(s, "families").save(L.fit_or_fallback(few, test, name, FEATURES, "graph_score", **params.get(name, {})), name)
    long = test.unpivot(["u", "v", "y"], [*L.FAMILIES, "graph_score"], "model", "score")
    return M.auc_ap(long.select("model", "score", F.col("y").cast("int").alias("y")), ["model"])


#: Parameters that are tried for the tuned models.
TRIED = {"logistic": ({"regParam": 0.0, "maxIter": 50}, {"regParam": 0.01, "maxIter": 50}, {"regParam": 0.1, "maxIter": 50}), "forest": ({"numTrees": 20, "maxDepth": 4, "seed": 27}, {"numTrees": 20, "maxDepth": 7, "seed": 27})}


def tuned(s: SparkSession, d: str) -> DataFrame:
    """AUC and AP on the last cutoff of a logistic model and a forest whose parameters, and of their hybrids whose shares, the earlier cutoffs choose."""
    rows, last = frames(s, d), cfg.CUTOFFS[-1]
    train, test = rows.where(F.col("cutoff") < last), rows.where(F.col("cutoff") == last)
    names = []
    for name, tried in TRIED.items():
        best = L.tuned(rows, name, FEATURES, "cutoff", last, tried=tried)
        share = L.hybrid_weight(rows, name, FEATURES, "graph_score", "cutoff", last, **best)
        test = L.hybrid(L.fit_or_fallback(train, test, name, FEATURES, "graph_score", **best), name, "graph_score", "cutoff", share).withColumnRenamed("hybrid", f"{name}_hybrid")
        test = Scratch(s, "tuned").save(test, name)
        names += [name, f"{name}_hybrid"]
    long = test.unpivot(["u", "v", "y"], [*names, "graph_score"], "model", "score")
    return M.auc_ap(long.select("model", "score", F.col("y").cast("int").alias("y")), ["model"])


def future(s: SparkSession, d: str) -> DataFrame:
    """The last cutoff's pairs by a logistic model of the ones before, blended with the graph score by the share that the earlier cutoffs choose, and weighed by the types' priors: the best 100 of each pair layer that are not joined yet."""
    rows = frames(s, d)
    train, test = rows.where(F.col("cutoff") < cfg.CUTOFFS[-1]), rows.where(F.col("cutoff") == cfg.CUTOFFS[-1])
    share = L.hybrid_weight(rows, "logistic", FEATURES, "graph_score", "cutoff", cfg.CUTOFFS[-1], maxIter=50)
    out = L.hybrid(L.fit_or_fallback(train, test, "logistic", FEATURES, "graph_score", maxIter=50), "logistic", "graph_score", "cutoff", share)
    out = L.type_priors(out, "u_type", "v_type", "hybrid", {("T1", "T2"): 1.2, ("T1", "T1"): 0.8})
    from ..operators.bipartite import best_per_layer

    ranked = best_per_layer(out.where("y = 0").withColumn("layer", P.kind_of("u_type", "v_type")), "layer", "prior_score", ["u", "v"], 100)
    return ranked.select("layer", "place", "u", "v", F.round("prior_score", 6).alias("prior_score"))


BLEND_SQL = (
    P._FOLDS.rsplit(", folds as (", 1)[0]
    + ", rows_ as (" + " union all ".join(f"select * from fx{c}" for c in P.CUTOFFS) + f"), rk as (select cutoff, u, v, label as y, {P.pct_sql('common_neighbors', 'cutoff')} as ra, {P.pct_sql('preferential_attachment', 'cutoff')} as rb from rows_),"
    " sc as (select cutoff, i / 10.0::double as blend, u, v, y, i / 10.0::double * ra + (1 - i / 10.0::double) * rb as score from rk, range(11) t(i)),"
    " tie as (select cutoff, blend, round(score, 12) as score, sum(y)::bigint as tp, count(*) as n from sc group by all), cum as (select *, sum(tp) over w as ctp, sum(n) over w as cn from tie window w as (partition by cutoff, blend order by score desc rows unbounded preceding)),"
    " m as (select cutoff, blend, sum((n - tp) * (ctp - tp / 2)) / (sum(tp) * sum(n - tp)) as auc, sum(tp * ctp / cn) / sum(tp) as ap from cum group by all),"
    " o as (select cutoff, blend, y, row_number() over (partition by cutoff, blend order by round(score, 12) desc, u, v) as r from sc),"
    " p as (select cutoff, blend, sum(y) filter (r <= 10) / 10 as p10, sum(y) filter (r <= 25) / 25 as p25, sum(y) filter (r <= 50) / 50 as p50 from o group by all),"
    " f as (select *, 0.4 * ap + 0.2 * (p10 + p25 + p50) as objective from m join p using (cutoff, blend)), e as (select blend, avg(objective) as mean_objective, stddev_pop(objective) as spread from f where cutoff < 1999 group by 1)"
    " select b.blend, round(mean_objective, 9) as mean_objective, round(spread, 9) as spread, round(ap, 9) as holdout_ap, round(auc, 9) as holdout_auc from (select * from e order by round(mean_objective - 0.1 * spread, 9) desc, blend limit 1) b join f on f.blend = b.blend and cutoff = 1999"
)


def blend_query(s: SparkSession, d: str) -> DataFrame:
    out = blend_selection(s, d)
    return out.select("blend", *[F.round(c, 9).alias(c) for c in out.columns if c != "blend"])


QUERIES = {"ml_link_prediction": (link_prediction, None), "ml_calibration_brier": (calibration, None), "ml_model_families": (families, None), "ml_future_pairs": (future, None), "ml_tuned_models": (tuned, None), "blend_selection": (blend_query, BLEND_SQL)}
