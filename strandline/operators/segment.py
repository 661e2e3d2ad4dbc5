"""Spans of sentences, clauses and windows of texts, in code points, without Python workers.

Places come from the lengths of what a pattern matches and of the gaps between,
summed up in blocks, so that a text costs its pieces times a block.  Each step is a
column of its own that later steps read more than once, so none is computed again
for every element of a lambda.  White space is that of Unicode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128
#: How many words a window has, and how many of them stand before what it is about.
WINDOW, BEFORE = 80, 20
#: Where clauses end, and abbreviations that end none.
CLAUSE_END = r"(?U);\s+|[.!?]\s+(?=[A-Z])|\n+"
SHORT = ("e.g.", "i.e.", "et al.", "fig.", "dr.")
WORD, SPACE = r"(?U)\S+", r"(?U)\s"


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda s, x: s + x)


def running(rows: DataFrame, lengths: str, name: str) -> DataFrame:
    """Adds `name`: for each length of an array the sum of all earlier ones."""
    n, empty = F.size(lengths), F.array().cast("array<int>")
    rows = rows.withColumn("_blocks", F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int")), lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))))
    rows = rows.withColumn("_starts", F.when(F.size("_blocks") > 0, F.transform(F.sequence(F.lit(0), F.size("_blocks") - 1), lambda b: _sum(F.slice("_blocks", F.lit(1), b)))))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    place = lambda i: F.get("_starts", block(i)) + _sum(F.slice(lengths, block(i) * BLOCK + 1, i % BLOCK))
    return rows.withColumn(name, F.when((n > 0) & (F.size("_starts") > 0), F.transform(F.sequence(F.lit(0), n - 1), place)).otherwise(empty)).drop("_blocks", "_starts")


def matches(rows: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Adds `name`: array<struct<start,stop>> of the matches of a pattern."""
    size = lambda c: F.transform(F.col(c), F.length)
    rows = rows.withColumns({"_h": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "_g": F.split(text, pattern, -1)}).withColumns({"_h": size("_h"), "_g": size("_g")})
    rows = rows.withColumn("_l", F.transform(F.arrays_zip("_g", "_h"), lambda x: x["_g"] + F.coalesce(x["_h"], F.lit(0))))
    rows = running(rows, "_l", "_at")
    each = F.transform(F.slice(F.arrays_zip("_at", "_g", "_h"), F.lit(1), F.size("_h")), lambda x: F.struct((x["_at"] + x["_g"]).alias("start"), (x["_at"] + x["_g"] + x["_h"]).alias("stop")))
    return rows.withColumn(name, each).drop("_h", "_g", "_l", "_at")


def sentence_cut(abbreviations: Sequence[str]) -> str:
    """Where a sentence ends: after a stop, before white space, and not after an abbreviation."""
    short = "|".join(a.replace(".", r"\.") for a in abbreviations)
    return rf"(?U)(?<=[.!?])(?<!{short})(?=\s)" if short else r"(?U)(?<=[.!?])(?=\s)"


def sentences(docs: DataFrame, key: str, text: str, abbreviations: Sequence[str]) -> DataFrame:
    """(key, sentence_id, start, stop, sentence): what lies between the ends of sentences, without white space around it; null and empty texts give none."""
    rows = docs.where(F.length(text) > 0).select(F.col(key), F.split(text, sentence_cut(abbreviations), -1).alias("_p"))
    rows = running(rows.withColumn("_n", F.transform("_p", F.length)), "_n", "_at")
    bare = lambda p: F.regexp_replace(p, f"^{SPACE}+|{SPACE}+$", "")
    each = F.transform(F.arrays_zip("_p", "_at"), lambda x: F.struct((x["_at"] + F.length(F.regexp_extract(x["_p"], f"^({SPACE}*)", 1))).alias("start"), bare(x["_p"]).alias("s")))
    out = rows.select(key, F.posexplode(F.filter(each, lambda x: x["s"] != "")).alias("sentence_id", "x"))
    return out.select(key, "sentence_id", F.col("x.start").cast("int").alias("start"), (F.col("x.start") + F.length("x.s")).cast("int").alias("stop"), F.col("x.s").alias("sentence"))


def word_windows(rows: DataFrame, text: str, at: str, stop: str, name: str, words: int = WINDOW, before: int = BEFORE) -> DataFrame:
    """Adds `name`, struct<start,stop>: `words` words around the phrase at..stop, `before` of them ahead of it where there are so many, and its last word in any case.

    Without a phrase (at < 0) the first words; a text without words gives an empty span.
    """
    rows = matches(rows, text, WORD, "_w")
    n, a, b = F.size("_w"), F.col(at), F.col(stop)
    first, last = F.size(F.filter("_w", lambda w: w["stop"] <= a)), F.size(F.filter("_w", lambda w: w["start"] < b)) - 1
    begin = F.greatest(F.lit(0), F.least(first - before, n - words))
    rows = rows.withColumn("_b", F.when(a < 0, 0).otherwise(F.when(last >= begin + words, last - words + 1).otherwise(begin)))
    span = F.struct(F.get("_w", F.col("_b"))["start"].alias("start"), F.get("_w", F.least(n, F.col("_b") + words) - 1)["stop"].alias("stop"))
    return rows.withColumn(name, F.when(n > 0, span).otherwise(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop")))).drop("_w", "_b")


def focused(rows: DataFrame, text: str, label: str, words: int = WINDOW, short: Sequence[str] = SHORT) -> DataFrame:
    """Adds at, start, stop and method: the clause in which a label first stands whatever its case, or a window of words where the clause is longer.

    A clause ends after a semicolon, a stop before a capital, or line feeds; not after
    an abbreviation, and not within the label.  Without the label `at` is -1 and the
    others are null.  An empty label stands at the start.
    """
    guard = "(?:" + "|".join(a.replace(".", r"\.") for a in short) + ")$"
    rows = rows.withColumn("at", F.coalesce(F.instr(F.lower(text), F.lower(label)), F.lit(0)) - 1).withColumn("_to", F.col("at") + F.length(label))
    rows = matches(rows, text, CLAUSE_END, "_ends")
    a, b = F.col("at"), F.col("_to")
    from_ = lambda d: F.greatest(d["start"] - 8, F.lit(0))
    ends = F.filter("_ends", lambda d: ((a >= d["stop"]) | (d["start"] >= b)) & ~F.lower(F.substring(F.col(text), from_(d) + 1, d["start"] + 1 - from_(d))).rlike(guard))
    rows = rows.withColumn("_ends", ends)
    low = F.coalesce(F.array_max(F.transform(F.filter("_ends", lambda d: d["stop"] <= a), lambda d: d["stop"])), F.lit(0))
    high = F.coalesce(F.array_min(F.transform(F.filter("_ends", lambda d: d["stop"] >= b), lambda d: d["stop"])), F.length(text))
    rows = rows.withColumns({"_low": low, "_high": high}).withColumn("_c", F.substring(F.col(text), F.col("_low") + 1, F.col("_high") - F.col("_low")))
    lead = F.length(F.regexp_extract("_c", f"^({SPACE}*)", 1))
    rows = rows.withColumns({"_low": F.col("_low") + lead, "_high": F.col("_low") + lead + F.length(F.regexp_replace("_c", f"^{SPACE}+|{SPACE}+$", "")), "_many": F.size(F.regexp_extract_all("_c", F.lit(WORD), F.lit(0)))})
    rows = word_windows(rows, text, "at", "_to", "_window", words)
    wide, found = F.col("_many") > words, F.col("at") >= 0
    pick = lambda own, other: F.when(found, F.when(wide, other).otherwise(own))
    rows = rows.withColumns({"start": pick(F.col("_low"), F.col("_window.start")), "stop": pick(F.col("_high"), F.col("_window.stop")), "method": pick(F.lit("source_sentence_or_semicolon_clause"), F.lit("long_clause_existing_80_word_window"))})
    return rows.drop("_to", "_ends", "_low", "_high", "_c", "_many", "_window")
