"""Runs of words of whole texts as rows, and their counts, by one shuffle of folded runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text of a part: its runs are folded by document within one task.
CHARS = 4 << 20


def dealt(docs: DataFrame, key: str, text: str, chars: int = CHARS) -> DataFrame:
    """`docs` (key, text) in parts of about `chars` characters, all rows of a key in one, so that groups by key and more need no further shuffle."""
    rows = docs.select(key, text)
    total = rows.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return rows.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // chars)), key)


def runs(rows: DataFrame, keep: Sequence[str], words: str, sizes: tuple[int, int], stop: Sequence[str] = (), name: str = "gram") -> DataFrame:
    """(keep, gram): all runs of `sizes` words of the array `words`, joined by spaces, with no stop word at an end.

    A row's words are laid beside those that follow them, and a run is joined from columns.
    """
    least, most = sizes
    beside = [F.slice(F.col(words), i + 1, F.size(words)).alias(f"w{i}") for i in range(most)]
    each = rows.select(*keep, F.explode(F.arrays_zip(*beside)).alias("_x")).select(*keep, *[F.col(f"_x.w{i}").alias(f"_w{i}") for i in range(most)])
    starts = ~F.col("_w0").isin(*stop) if stop else F.lit(True)

    def run(n: int) -> Column:
        out = F.concat(*[x for i in range(n) for x in (F.lit(" "), F.col(f"_w{i}"))][1:])  # null beyond the last word
        return F.when(~F.col(f"_w{n - 1}").isin(*stop), out) if stop else out

    return each.where(starts).select(*keep, F.explode(F.array(*[run(n) for n in range(least, most + 1)])).alias(name)).where(F.col(name).isNotNull())


def counted(grams: DataFrame, key: str, name: str = "gram", docs: str = "docs") -> DataFrame:
    """(gram, docs, times): keys that have a run, and how often it comes; of rows that lie by `key`, only runs folded by task are shuffled."""
    return grams.groupBy(key, name).agg(F.count("*").alias("_n")).groupBy(name).agg(F.count("*").alias(docs), F.sum("_n").alias("times"))
