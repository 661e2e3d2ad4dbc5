"""URL filters: host and path rules, and logistic regression on hashed character n-grams, in SQL functions alone.

A URL gives a host (after the first `://`) and a path.  The longest rule whose
host is the URL's or a parent domain of it, and whose path starts the URL's,
decides.  Where no rule fits, the verdict is that of a logistic regression over
the distinct character trigrams of host and path.  It is trained by full-batch
gradient descent within one row, over a small labelled table of URLs (its size
does not depend on the input), and its DIMS weights reach the scan as a scalar
subquery: the scan is one projection without a shuffle.

Cases: a null URL and one without `://` have an empty host and path; the model
judges them by the trigrams of the empty strings.  Other characters than A-Z
keep their case.  Repeated rows are judged alike.  An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 1024
ROUNDS = 80
RATE = 4.0

# The contract's rules.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: The labelled table: 1 is to be blocked.
LABELLED = tuple(
    [(u, 1) for u in (
        "http://casino-bonus.win/free-spins", "http://best-casino.bet/slots/jackpot", "https://poker-bonus.club/play-now", "http://cheap-pills.shop/viagra", "http://pharma-discount.top/order/cheap",
        "http://free-download-crack.ru/keygen.exe", "http://warez-crack.to/serial/keygen", "http://adult-cams.xxx/live", "http://hot-singles.xxx/join", "http://xxx-video.club/watch/free",
        "http://win-prize.click/claim?id=7", "http://free-iphone.click/claim-prize", "http://loan-fast.top/apply-now", "http://crypto-double.win/bonus", "http://replica-watches.shop/cheap",
        "http://seo-links.top/buy-backlinks", "http://torrent-crack.to/free/download.exe", "http://slots-jackpot.bet/free-bonus", "http://betting-tips.bet/win", "http://pills-online.shop/cheap/order",
    )]
    + [(u, 0) for u in (
        "https://www.example.net/en/1200", "https://docs.example.net/en/guide.html", "https://news.example.com/en/2021/article.html", "https://blog.example.net/posts/welcome", "https://library.university.edu/catalog/item/12",
        "https://en.encyclopedia.info/wiki/Linear_algebra", "https://www.city.gov/services/permits", "https://journal.science.edu/articles/2020/17", "https://shop.bookstore.com/books/history", "https://museum.art/collection/451",
        "https://www.example.net/de/3400.html", "https://m.example.com/en/550/", "https://forum.example.net/t/question/88", "https://archive.example.net/fr/77#top", "https://www.hospital.info/departments/cardiology",
        "https://weather.gov/forecast/today", "https://recipes.kitchen.com/bread/sourdough", "https://www.railway.info/timetable.html", "https://code.example.net/project/readme", "https://school.edu/courses/biology/101",
    )]
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def bins(host: Column, path: Column, dims: int = DIMS) -> Column:
    """Distinct bins of the trigrams of `^host$` and `^path$`, from 2 up; bin 1 is the bias."""

    def grams(text: Column, salt: int) -> Column:
        s = F.concat(F.lit("^"), text, F.lit("$"))
        code = F.transform(F.split(s, ""), lambda c: F.ascii(c))
        n = F.greatest(F.length(s) - 2, F.lit(1))
        # each shifted copy is made once; a lambda over positions would make it again for each
        parts = F.arrays_zip(F.slice(code, 1, n).alias("a"), F.slice(code, 2, n).alias("b"), F.slice(F.concat(code, F.array(F.lit(0))), 3, n).alias("c"))
        return F.transform(parts, lambda x: F.pmod(x["a"] * 7919 + x["b"] * 131 + x["c"] * 17 + salt, F.lit(dims - 1)) + 2)

    return F.array_distinct(F.concat(grams(host, 0), grams(path, 499)))


def logit(weights: Column, own: Column) -> Column:
    return F.get(weights, F.lit(0)) + F.aggregate(own, F.lit(0.0), lambda a, b: a + F.get(weights, b - 1)) / F.sqrt(F.size(own).cast("double"))


def train(spark: SparkSession, labelled=LABELLED, dims: int = DIMS, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """One row, `weights`: full-batch gradient descent over the labelled table, held in one row."""
    rows = spark.createDataFrame([(i, u, int(y)) for i, (u, y) in enumerate(labelled)], "n int, url string, y int")
    x = rows.select("n", "y", bins(*host_and_path(F.col("url")), dims).alias("own"))
    table = x.agg(F.array_sort(F.collect_list(F.struct("n", "y", "own"))).alias("t"))
    table = table.select("t", F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda d: F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (d == 1) | F.array_contains(F.get("t", i)["own"], d))).alias("in"))
    # aggregates keep the optimiser from folding a column's making into every place that uses it
    table = table.groupBy("t", "in").agg(F.max(F.lit(0)).alias("_"))

    def step(w: Column, _: Column) -> Column:
        misses = F.transform("t", lambda r: (r["y"] - 1 / (1 + F.exp(-logit(w, r["own"])))) / F.size("t"))
        packed = F.struct(w.alias("w"), misses.alias("m"))
        # one aggregate over a single struct binds the misses once for all dimensions
        return F.aggregate(
            F.array(packed), F.array().cast("array<double>"),
            lambda _, p: F.transform(p["w"], lambda v, d: v + rate * F.aggregate(F.get("in", d), F.lit(0.0), lambda a, i: a + F.get(p["m"], i) / F.when(d == 0, F.lit(1.0)).otherwise(F.sqrt(F.size(F.get("t", i)["own"]).cast("double"))))),
        )

    return table.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array_repeat(F.lit(0.0), dims), step).alias("weights"))


def judge(pages: DataFrame, rules=RULES, url: str = "url", labelled=LABELLED, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """`keep`, host, path, rule, verdict and the model's score of every row."""
    model = train(pages.sparkSession, labelled)
    host, path = host_and_path(F.col(url))
    parts = pages.select(*keep, host.alias("host"), path.alias("path"), model.scalar().alias("_w"))
    found = parts.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("_r"), (1 / (1 + F.exp(-logit(F.col("_w"), bins(F.col("host"), F.col("path")))))).alias("score"))
    return found.select(*keep, "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op5_urlfilter(pages: DataFrame) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _duck(select: str, source: str) -> str:
    """host and path in DuckDB."""
    rest = "case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end"
    return f"select {select}, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) as path from (select *, {rest} as rest from {source})"


def _duck_bins() -> str:
    gram = "((unicode(s[i]) * 7919 + unicode(s[i + 1]) * 131 + coalesce(unicode(nullif(s[i + 2], '')), 0) * 17 + {salt}) % " + str(DIMS - 1) + ") + 2"
    one = lambda text, salt: f"list_transform(range(1, greatest(length({text}), 1) + 1), lambda i: {gram.format(salt=salt).replace('s[', f'''('^' || {text} || '$')[''')})"
    return f"list_distinct(list_concat({one('host', 0)}, {one('path', 499)}))"


def op5_sql() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda r: f"(host = '{r[0]}' or ends_with(host, '.{r[0]}')) and starts_with(path, '{r[1]}')"
    rule = "case " + " ".join(f"when {fits(r)} then '{r[0]}{r[1]}'" for r in rules) + " end"
    verdict = "case " + " ".join(f"when {fits(r)} then '{r[2]}'" for r in rules) + " end"
    values = ", ".join(f"({i}, '{u}', {y})" for i, (u, y) in enumerate(LABELLED))
    return f"""
with recursive seen as (select n, y, {_duck_bins()} as own from ({_duck('n, y', f'(values {values}) v(n, url, y)')})),
t as (select list(y order by n) as ys, list(own order by n) as owns, count(*)::int as many from seen),
inv as (select list(rows order by d) as ins from (select d, list_filter(range(1, many + 1), lambda i: d = 1 or list_contains(owns[i], d)) as rows from t, range(1, {DIMS} + 1) r(d))),
fit(e, w) as (
  select 0, list_transform(range({DIMS}), lambda i: 0.0::double)
  union all
  select e + 1, list_transform(range(1, {DIMS} + 1), lambda d: w[d] + {RATE} * coalesce(list_sum(list_transform(ins[d], lambda i: m[i] / case when d = 1 then 1.0::double else sqrt(len(owns[i])) end)), 0.0)) from (
    select e, w, owns, ins, list_transform(range(1, many + 1), lambda i: (ys[i] - 1 / (1 + exp(-(w[1] + list_sum(list_transform(owns[i], lambda b: w[b])) / sqrt(len(owns[i])))))) / many) as m
    from fit, t, inv where e < {ROUNDS})),
last as (select w from fit where e = {ROUNDS}),
p as ({_duck('page_id', 'pages')})
select page_id, host, path, {rule} as rule, coalesce({verdict}, case when 1 / (1 + exp(-(w[1] + list_sum(list_transform(own, lambda b: w[b])) / sqrt(len(own))))) >= 0.5 then 'block' else 'allow' end) as verdict
from (select *, {_duck_bins()} as own from p), last
"""
