"""Link-prediction models with pyspark.ml: fit, score, blend, select by rolling folds, calibrate."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, FMClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from .order import pct_ranks
from .scratch import Scratch


#: The model families: the estimator and parameters that make it repeatable.
FAMILIES = {
    "logistic": (LogisticRegression, {}), "ridge": (LogisticRegression, {"regParam": 0.1}), "lasso": (LogisticRegression, {"regParam": 0.01, "elasticNetParam": 1.0}), "forest": (RandomForestClassifier, {"seed": 27}), "boosted": (GBTClassifier, {"seed": 27}),
    "tree": (DecisionTreeClassifier, {"seed": 27}), "svm": (LinearSVC, {}), "bayes": (NaiveBayes, {"modelType": "gaussian"}), "machine": (FMClassifier, {"seed": 27}), "perceptron": (MultilayerPerceptronClassifier, {"seed": 27}),
}
#: What a search tries for each family.
GRIDS = {"logistic": {"regParam": [0.0, 0.01, 0.1]}, "forest": {"numTrees": [20, 50], "maxDepth": [3, 5]}, "boosted": {"maxIter": [10, 20], "maxDepth": [2, 3]}, "tree": {"maxDepth": [3, 5, 7]}, "svm": {"regParam": [0.01, 0.1]}, "machine": {"factorSize": [2, 4]}}
UNWEIGHTED = ("machine", "perceptron")


def make(name: str, features: Sequence[str], label: str = "y", weight: str | None = None, **params) -> Pipeline:
    """A pipeline of one model family over standardised features."""
    kind, fixed = FAMILIES[name]
    own = {**fixed, **params}
    if name == "perceptron":
        own.setdefault("layers", [len(features), 8, 2])
    if weight and name not in UNWEIGHTED:
        own["weightCol"] = weight
    model = kind(featuresCol="x", labelCol=label, **own)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), model])


def grid(name: str) -> list[dict[str, object]]:
    """Every combination of a family's parameters, in a fixed order."""
    names = sorted(GRIDS.get(name, {}))
    return [dict(zip(names, values, strict=True)) for values in product(*[GRIDS[name][n] for n in names])]


def balanced(rows: DataFrame, label: str = "y") -> DataFrame:
    """Adds `w`: both classes weigh the same in sum."""
    n = rows.agg(F.sum(label).alias("p"), F.count("*").alias("n")).first()
    p, total = int(n["p"] or 0), int(n["n"])
    if not p or p == total:
        return rows.withColumn("w", F.lit(1.0))
    return rows.withColumn("w", F.when(F.col(label) == 1, total / (2 * p)).otherwise(total / (2 * (total - p))))


def score(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    out = model.transform(rows)
    # a margin stands in where a family has no probabilities: only its order counts
    value = vector_to_array("probability" if "probability" in out.columns else "rawPrediction")[1]
    return out.withColumn(name, value).drop("raw", "x", "rawPrediction", "probability", "prediction")


def fit_or_fallback(train: DataFrame, test: DataFrame, name: str, features: Sequence[str], fallback: str, label: str = "y", key: Sequence[str] = ("cutoff", "u", "v"), **params) -> DataFrame:
    """`test` with a column `name`: the model's probability, or the percentile rank of `fallback` if training has one class."""
    if train.select(label).distinct().count() < 2:
        ranks = pct_ranks(test.withColumn("_all", F.lit(1)), key, [fallback], "_all").drop("_all")
        return test.join(ranks.withColumnRenamed(f"pr_{fallback}", name), list(key))
    return score(make(name, features, label, "w", **params).fit(balanced(train, label)), test, name)


def blends(scored: DataFrame, a: str, b: str, by: str, key: Sequence[str] = ("u", "v"), steps: int = 10) -> DataFrame:
    """Every weight of a grid: score = w rank(a) + (1 - w) rank(b), ranked within each fold."""
    ranked = scored.join(pct_ranks(scored, key, [a, b], by).withColumnsRenamed({f"pr_{a}": "_ra", f"pr_{b}": "_rb"}), [*key, by])
    grid = scored.sparkSession.createDataFrame([(i / steps,) for i in range(steps + 1)], "blend double")
    return ranked.join(F.broadcast(grid)).withColumn("score", F.round(F.col("blend") * F.col("_ra") + (1 - F.col("blend")) * F.col("_rb"), 12)).drop("_ra", "_rb")


#: Weights of the objective by which a choice is made on the folds before the holdout.
OBJECTIVE = {"ap": 0.4, "p10": 0.2, "p25": 0.2, "p50": 0.2}
SPREAD = 0.1


def fold_metrics(scored: DataFrame, by: Sequence[str], key: Sequence[str] = ("u", "v")) -> DataFrame:
    """(by, auc, ap, p10, p25, p50, objective) of each fold and choice; precision counts as 0 where a fold has fewer rows."""
    by = list(by)
    at = M.at_k(scored, by, [10, 25, 50], list(key)).groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("precision"))), F.lit(0.0)).alias(f"p{k}") for k in (10, 25, 50)])
    return M.auc_ap(scored, by).join(at, by).withColumn("objective", sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in OBJECTIVE.items()), F.lit(0.0)))


def select(scored: DataFrame, fold: str, choice: str, holdout: int) -> DataFrame:
    """The choice with the best mean objective, less a tenth of its spread, on the folds before the holdout, and its figures there."""
    each = fold_metrics(scored, [fold, choice])
    early = each.where(F.col(fold) < holdout).groupBy(choice).agg(F.avg("objective").alias("mean_objective"), F.stddev_pop("objective").alias("spread"))
    best = early.orderBy(F.desc(F.round(F.col("mean_objective") - SPREAD * F.col("spread"), 9)), choice).limit(1)
    return best.join(each.where(F.col(fold) == holdout).select(choice, F.col("ap").alias("holdout_ap"), F.col("auc").alias("holdout_auc")), choice, "left")


def platt(train: DataFrame, rows: DataFrame, score_column: str, label: str = "y") -> DataFrame:
    """`rows` with `p`: a logistic curve through the score, fitted on `train`; the score itself, 0 to 1, where there is nothing to fit it on."""
    if train.isEmpty():
        return rows.withColumn("p", F.col(score_column).cast("double"))
    model = make("logistic", [score_column], label).fit(train)
    return score(model, rows, "p")


def tuned(rows: DataFrame, name: str, features: Sequence[str], fold: str, holdout: int, label: str = "y", tried: Sequence[dict[str, object]] | None = None) -> dict[str, object]:
    """The parameters whose models, each fitted on the folds before one and judged on it, have the best mean objective on the folds before the holdout."""
    folds = sorted(r[0] for r in rows.where(F.col(fold) < holdout).select(fold).distinct().collect())
    best, best_score = None, float("-inf")
    for params in tried or grid(name) or [{}]:
        scores = []
        for f in folds[1:]:
            train, test = rows.where(F.col(fold) < f), rows.where(F.col(fold) == f)
            got = fit_or_fallback(train, test, name, features, features[0], label, **params)
            scores.append(fold_metrics(got.select(fold, "u", "v", F.col(label).alias("y"), F.col(name).alias("score")), [fold]).first()["objective"])
        if scores and sum(scores) / len(scores) > best_score + 1e-9:
            best, best_score = params, sum(scores) / len(scores)
    return best or {}


def hybrid(scored: DataFrame, model: str, graph: str, by: str, weight: float, key: Sequence[str] = ("u", "v")) -> DataFrame:
    """Adds hybrid: the weighted sum of the ranks of a model and of the graph score within each fold."""
    ranks = pct_ranks(scored, key, [model, graph], by).withColumn("hybrid", F.round(weight * F.col(f"pr_{model}") + (1 - weight) * F.col(f"pr_{graph}"), 12))
    return scored.join(ranks.select(*key, by, "hybrid"), [*key, by])


def hybrid_weight(rows: DataFrame, name: str, features: Sequence[str], graph: str, fold: str, holdout: int, label: str = "y", key: Sequence[str] = ("u", "v"), steps: int = 20, **params) -> float:
    """The share of a model in a hybrid with the graph score that the folds before the holdout choose, each judged by a model fitted on the folds before it.

    One earlier fold at least is needed to fit; without a fold to judge, half.
    """
    folds = sorted(r[0] for r in rows.where(F.col(fold) < holdout).select(fold).distinct().collect())
    scored = None
    for f in folds[1:]:
        got = fit_or_fallback(rows.where(F.col(fold) < f), rows.where(F.col(fold) == f), name, features, graph, label, **params).select(fold, *key, F.col(label).cast("int").alias("y"), name, graph)
        scored = got if scored is None else scored.unionByName(got)
    if scored is None:
        return 0.5
    each = fold_metrics(blends(Scratch(rows.sparkSession, "hybrid").save(scored, "scored"), name, graph, fold, key, steps), [fold, "blend"], key)
    best = each.groupBy("blend").agg((F.avg("objective") - SPREAD * F.stddev_pop("objective")).alias("o")).orderBy(F.desc(F.round("o", 9)), "blend").first()
    return float(best.blend)


def type_priors(scored: DataFrame, a: str, b: str, score: str, priors: dict[tuple[str, str], float], default: float = 1.0) -> DataFrame:
    """Adds prior_score: the score times the prior of its unordered pair of types."""
    kind = F.concat_ws("+", F.least(a, b), F.greatest(a, b))
    table = {"+".join(sorted(k)): v for k, v in priors.items()}
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[kind], F.lit(default)) if table else F.lit(default)
    return scored.withColumn("prior_score", F.col(score) * weight)
