"""Rank and interval formulas as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z95 = 1.959963984540054


def average_rank(order: Column | str, by: Sequence[str] = ()) -> Column:
    """Ascending rank from 1, ties share the average of their ranks."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    ties = Window.partitionBy(*by, order)
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(ties) - 1) / 2


def pct_rank(order: Column | str, by: Sequence[str] = ()) -> Column:
    """Average rank over the count.  Not percent_rank(), which ignores ties."""
    return average_rank(order, by) / F.count("*").over(Window.partitionBy(*by))


def rank01(order: Column | str, by: Sequence[str] = ()) -> Column:
    """Average rank scaled to 0..1; a single row gets 0."""
    n = F.count("*").over(Window.partitionBy(*by))
    return F.when(n <= 1, F.lit(0.0)).otherwise((average_rank(order, by) - 1) / (n - 1))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval, clipped to 0..1; null where n is 0."""
    p = hits / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def strength(n: Column) -> Column:
    """Support on a log scale that ends at five."""
    return F.round(F.least(F.lit(1.0), F.log1p(n) / F.log(F.lit(6.0))), 4)


def pair_weight(n: Column, a: Column, b: Column) -> Column:
    return n / F.sqrt(F.greatest(F.lit(1.0), a * b))


def min_max(x: Column | str, by: Sequence[str] = ()) -> Column:
    w = Window.partitionBy(*by)
    x = F.col(x) if isinstance(x, str) else x
    span = F.max(x).over(w) - F.min(x).over(w)
    return F.when(span > 0, (x - F.min(x).over(w)) / span).otherwise(F.lit(0.0))
