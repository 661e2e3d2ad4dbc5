"""Bounded, deterministic samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def bounded(rows: DataFrame, by: str, key: str, bound: int, seed: int = 17) -> DataFrame:
    """About `bound` rows at most of each value of `by`, chosen by a hash of `key`; all where there are fewer.

    Only `by` is read to count.  The values of `by` are labels, so their counts fit the driver.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    if not counts:
        return rows.limit(0)
    share = F.coalesce(*[F.when(F.col(by) == v, F.lit(min(1.0, bound / n))) for v, n in sorted(counts.items(), key=str) if v is not None], F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(draw < share)


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text, y) of a sample of `bound` rows at most of each value of a binary label.

    The sample is drawn from the labels alone, so it is small whatever the texts
    weigh, and goes to the texts by broadcast; no text is shuffled.
    """
    drawn = bounded(labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y")).where("y in (0, 1)"), "y", "_key", bound)
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(drawn), F.col("key") == F.col("_key")).select("key", "text", "y")


def within_bytes(rows: DataFrame, packed: list[str], key: str, bound: int, seed: int = 23) -> DataFrame:
    """All of `rows` if their binary columns weigh `bound` bytes at most, else about that much, chosen by a hash of `key`."""
    total = rows.agg(F.sum(sum((F.octet_length(c) for c in packed), F.lit(64)).cast("long"))).first()[0] or 0
    if total <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * bound / total))
