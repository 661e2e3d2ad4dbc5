"""Event tables, Kaplan-Meier curves, competing risks and risk sets over pair histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import wilson
from .pairs import kth_support, pair_summary


def event_table(source: DataFrame, target: DataFrame, freeze: int, k: int = 1, parts: int | None = None) -> DataFrame:
    """Pairs with k source papers by `freeze`: duration until the first later target year, or censored."""
    support = kth_support(source, k, parts).where(F.col("support_year") <= freeze)
    first = pair_summary(target).select("u", "v", F.col("first_year").alias("target_year"))
    out = support.join(first, ["u", "v"], "left").where("target_year is null or target_year > support_year")
    event = F.col("target_year").isNotNull() & (F.col("target_year") <= freeze)
    return out.select("u", "v", "support_year", "target_year", event.cast("int").alias("event"), F.when(event, F.col("target_year") - F.col("support_year")).otherwise(freeze - F.col("support_year")).alias("duration"))


def kaplan_meier(events: DataFrame) -> DataFrame:
    """(t, at_risk, events, censored, survival).  Times are few, rows are folded before they are ordered."""
    each = events.groupBy(F.col("duration").alias("t")).agg(F.count("*").alias("n"), F.sum("event").alias("events"))
    later, upto = Window.orderBy(F.desc("t")), Window.orderBy("t")
    each = each.withColumn("at_risk", F.sum("n").over(later))
    factor = F.when(F.col("t") > 0, 1 - F.col("events") / F.col("at_risk")).otherwise(F.lit(1.0))
    return each.select("t", "at_risk", "events", (F.col("n") - F.col("events")).alias("censored"), F.product(factor).over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias("survival"))


def at_horizons(curve: DataFrame, horizons: list[int]) -> DataFrame:
    """Cumulative incidence at the last time at or before each horizon."""
    h = curve.sparkSession.createDataFrame([(x,) for x in horizons], "horizon int")
    return h.join(F.broadcast(curve), F.col("t") <= F.col("horizon"), "left").groupBy("horizon").agg((1 - F.coalesce(F.max_by("survival", "t"), F.lit(1.0))).alias("incidence"))


def competing_risks(events: DataFrame) -> DataFrame:
    """`cause` (null if censored) and `duration` to cumulative incidences by cause: S(t-) d / n summed."""
    causes = ["target", "hybrid", "ambiguous"]
    n = lambda c: F.sum((F.col("cause") == c).cast("int"))
    each = events.groupBy(F.col("duration").alias("t")).agg(F.count("*").alias("n"), *[F.coalesce(n(c), F.lit(0)).alias(c) for c in causes])
    each = each.withColumn("at_risk", F.sum("n").over(Window.orderBy(F.desc("t"))))
    everything = sum((F.col(c) for c in causes), F.lit(0))
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("survival", F.product(1 - everything / F.col("at_risk")).over(upto))
    each = each.withColumn("before", F.coalesce(F.lag("survival").over(Window.orderBy("t")), F.lit(1.0)))
    return each.select("t", "at_risk", "survival", *[F.sum(F.col("before") * F.col(c) / F.col("at_risk")).over(upto).alias(f"cif_{c}") for c in causes])


def type_rates(events: DataFrame, types: DataFrame, horizon: int, freeze: int) -> DataFrame:
    """Share of pairs followed for `horizon` years that had their event by then, by pair of types, with its interval."""
    t = lambda c: types.select(F.col("concept_id").alias(c), F.col("concept_type").alias(f"{c}_type"))
    full = events.where(F.col("support_year") + horizon <= freeze).join(t("u"), "u").join(t("v"), "v")
    hit = (F.col("event") == 1) & (F.col("duration") <= horizon)
    pair = F.concat_ws("+", F.least("u_type", "v_type"), F.greatest("u_type", "v_type"))
    out = full.groupBy(pair.alias("type_pair")).agg(F.count("*").alias("n"), F.sum(hit.cast("int")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.withColumns({"rate": F.col("hits") / F.col("n"), "low": low, "high": high})
