"""Global running sums and ranks without a window over one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def running_sums(rows: DataFrame, order: Sequence[Column], sums: dict[str, str], by: Sequence[str] = (), deal: Sequence[Column] | None = None) -> DataFrame:
    """Adds cumulative sums (inclusive) of columns in a total order, within `by` or over all rows.

    Rows are range-partitioned once and written; each part keeps its own running
    sums.  A part begins within one group at most, so the offsets that are
    broadcast are no more rows than there are parts.  `deal` names coarser keys
    in the same order for the partitioning, where `order` has long values.
    """
    scratch = Scratch(rows.sparkSession, "order")
    keys = [F.col(c) for c in by]
    parted = rows.repartitionByRange(*keys, *(deal or order)).withColumn("_part", F.spark_partition_id())
    parted = scratch.save(parted, "parts")
    totals = parted.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    within_group = Window.partitionBy(*by).orderBy("_part")
    before = within_group.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *by, F.row_number().over(within_group).alias("_turn"), *[F.sum(f"_t_{c}").over(before).alias(f"_o_{c}") for c in sums]).where("_turn > 1").drop("_turn")
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parted.select("*", *[F.sum(c).over(within).alias(f"_w_{c}") for c in sums])
    same = F.col("a._part") == F.col("b._part")
    for c in by:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = placed.alias("a").join(F.broadcast(offsets).alias("b"), same, "left")
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], *[(F.col(f"_w_{c}") + F.coalesce(F.col(f"_o_{c}"), F.lit(0))).alias(name) for c, name in sums.items()])


def pct_ranks(rows: DataFrame, key: Sequence[str], columns: Sequence[str], by: str) -> DataFrame:
    """`key`, `by` and the average-tie percent rank of each column within `by`, as pr_<column>.

    All columns are ranked in one pass: values are unpivoted, ties folded, and the
    distinct values range-partitioned, so neither a large group nor a common value
    is ordered in one task.  A column's groups are (by, column).
    """
    long = rows.select(*key, by, F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(*key, by, "x.what", "x.value")
    ties = long.groupBy(by, "what", "value").agg(F.count("*").alias("ties"))
    placed = running_sums(ties, [F.col("value")], {"ties": "upto"}, [by, "what"])
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    rank = (F.col("upto") - (F.col("ties") - 1) / 2) / F.col("n")
    placed = placed.join(sizes, by).select(by, "what", "value", rank.alias("rank"))
    ranked = long.alias("l").join(placed.alias("p"), (F.col(f"l.{by}") == F.col(f"p.{by}")) & (F.col("l.what") == F.col("p.what")) & F.col("l.value").eqNullSafe(F.col("p.value")))
    wide = ranked.groupBy(*[F.col(f"l.{k}").alias(k) for k in key], F.col(f"l.{by}").alias(by))
    return wide.agg(*[F.max(F.when(F.col("l.what") == c, F.col("rank"))).alias(f"pr_{c}") for c in columns])


def ranked(rows: DataFrame, column: str, by: Sequence[str] = (), name: str = "avg_rank", total: str = "rows") -> DataFrame:
    """Adds the average-tie rank (from 1, ascending) and the group's rows; ties are folded before anything is ordered."""
    groups = rows.groupBy(*by, column).agg(F.count("*").alias("_ties"))
    placed = running_sums(groups, [F.col(column)], {"_ties": "_upto"}, by)
    n = groups.groupBy(*by).agg(F.sum("_ties").alias(total))
    placed = placed.select(*by, column, (F.col("_upto") - (F.col("_ties") - 1) / 2).alias(name))
    out = rows.join(placed, [*by, column])
    return out.join(n, list(by)) if by else out.join(F.broadcast(n))  # one row
