"""Queries for dedupe, audits, samples, decisions, concentrations, fingerprints and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_key, pair_id, stable_id
from ..operators import metrics as M
from ..operators import review as V
from ..session import table
from ..streaming import windows as E


def keyed(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return V.keyed_dedupe(docs, F.sha1(norm_key("text")), [F.desc("n_chars"), F.col("doc_id")], "doc_id", "source")


KEY = "trim(regexp_replace(regexp_replace(lower(text), '[–—−]', '-', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def asymmetric(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "source", F.sha1(norm_key("text")).alias("k"))
    return V.minus(docs.where("source <> 'src0'"), docs.where("source = 'src0'"), ["k"]).select("doc_id", "source")


def audit(s: SparkSession, d: str) -> DataFrame:
    li, o, p, c, docs, lab = (table(s, d, t) for t in ("lineitem", "orders", "part", "customer", "documents", "labels"))
    return V.audit({
        "lineitem_without_order": V.dangling(li, "l_orderkey", o, "o_orderkey"),
        "lineitem_without_part": V.dangling(li, "l_partkey", p, "p_partkey"),
        "order_without_customer": V.dangling(o, "o_custkey", c, "c_custkey"),
        "label_without_document": V.dangling(lab, "doc_id", docs, "doc_id"),
        "document_id_repeated": V.repeated(docs, ["doc_id"]),
        "line_repeated": V.repeated(li, ["l_orderkey", "l_linenumber"]),
        "length_wrong": docs.where("n_chars <> length(text)"),
    })


def sample(s: SparkSession, d: str) -> DataFrame:
    out = V.stratified_sample(table(s, d, "documents"), "lang", "doc_id", 60, "7")
    return out.select("lang", "doc_id", "population", "taken", F.round("probability", 9).alias("probability"), F.round("weight", 9).alias("weight"))


def scored(s: SparkSession, d: str) -> DataFrame:
    docs, lab = table(s, d, "documents"), table(s, d, "labels")
    return docs.join(lab, "doc_id").select("doc_id", F.col("quality").alias("y"), F.round(F.ln(F.col("n_chars") + 1), 4).alias("score"), F.lit(1).alias("g"))


def negatives(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).withColumn("y", 1 - F.col("y"))
    return V.hard_negatives(rows, "y", "score", ["doc_id"], ratio=2).select("doc_id", "y", "kind")


def f1(s: SparkSession, d: str) -> DataFrame:
    out = M.best_f1(scored(s, d), [])
    return out.select(F.round("threshold", 4).alias("threshold"), F.round("f1", 9).alias("f1"), "tp", "fp", "fn", "tn")


SCORED = "sc as (select doc_id, quality as y, round(ln(n_chars + 1), 4) as score from documents join labels using (doc_id))"


def brier(s: SparkSession, d: str) -> DataFrame:
    docs, lab = table(s, d, "documents"), table(s, d, "labels")
    rows = docs.join(lab, "doc_id").select("lang", "quality", (F.least(F.col("n_chars"), F.lit(5000)) / 5000).alias("p"))
    return M.brier(rows, ["lang"], "p", "quality").withColumn("brier", F.round("brier", 9))


def bootstrap(s: SparkSession, d: str) -> DataFrame:
    return V.bootstrap_mean(table(s, d, "labels"), "quality", "doc_id", 200).select(*[F.round(c, 9).alias(c) for c in ("low", "high", "middle")])


def hhi(s: SparkSession, d: str) -> DataFrame:
    return V.concentration(table(s, d, "orders"), "o_orderpriority", "o_custkey").withColumn("hhi", F.round("hhi", 12))


def cumshare(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents")
    return V.cumulative_share(rows, "lang", "source").withColumn("share", F.round("share", 9)).withColumn("place", F.col("place").cast("long"))


def decisions(s: SparkSession, d: str) -> DataFrame:
    """Decisions made from order lines: a supplier pair of an order, the quantity gives the relation, the line the order."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    a, b = li.alias("x"), li.alias("y")
    both = a.join(b, F.col("x.l_orderkey") == F.col("y.l_orderkey")).where("x.l_suppkey <> y.l_suppkey and y.l_linenumber = x.l_linenumber + 1")
    kind = F.when(F.col("x.l_quantity") < 2, "equivalent_to").when(F.col("x.l_quantity") < 15, "broader_than").when(F.col("x.l_quantity") < 30, "related_to").otherwise("distinct_from")
    return both.select(F.col("x.l_suppkey").alias("a"), F.col("y.l_suppkey").alias("b"), kind.alias("relation"), (F.col("x.l_orderkey") * 100 + F.col("x.l_linenumber")).alias("seq"))


DECIDED = "dc as (select x.l_suppkey as a, y.l_suppkey as b, case when x.l_quantity < 2 then 'equivalent_to' when x.l_quantity < 15 then 'broader_than' when x.l_quantity < 30 then 'related_to' else 'distinct_from' end as relation, x.l_orderkey * 100 + x.l_linenumber as seq from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_suppkey <> y.l_suppkey and y.l_linenumber = x.l_linenumber + 1)"


def overlaid(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "supplier").select("s_suppkey", "s_nationkey")
    pairs = n.select(F.col("s_suppkey").alias("a"), "s_nationkey").join(n.select(F.col("s_suppkey").alias("b"), "s_nationkey"), "s_nationkey").where("a < b").select("a", "b")
    return V.overlay(pairs, decisions(s, d))


def conflicts(s: SparkSession, d: str) -> DataFrame:
    return V.equivalence_conflicts(decisions(s, d).select("a", "b", "relation").distinct())


def ids(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    return c.select("c_custkey", stable_id("cust", F.col("c_name"), F.col("c_mktsegment")).alias("stable"), pair_id("p", F.col("c_name"), F.col("c_mktsegment")).alias("pair"))


def digest(s: SparkSession, d: str) -> DataFrame:
    return V.table_hash(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


def tumbling(s: SparkSession, d: str) -> DataFrame:
    return E.windowed(table(s, d, "events"), "1 hour").withColumn("start", F.unix_micros(F.col("start").cast("timestamp"))).withColumn("total", F.round("total", 4))


def sliding(s: SparkSession, d: str) -> DataFrame:
    return E.windowed(table(s, d, "events"), "1 hour", "30 minutes").withColumn("start", F.unix_micros(F.col("start").cast("timestamp"))).withColumn("total", F.round("total", 4))


def sessionize(s: SparkSession, d: str) -> DataFrame:
    return E.session_numbers(table(s, d, "events"), 1800).select("user_id", "session", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n")


def event_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions by event time as a stream would close them."""
    out = E.sessions(table(s, d, "events"), "30 minutes")
    return out.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n", F.round("total", 4).alias("total"))


def rollup(s: SparkSession, d: str) -> DataFrame:
    """Counts by language and source, by language, and over all."""
    return table(s, d, "documents").rollup("lang", "source").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def usage(s: SparkSession, d: str) -> DataFrame:
    """Sums of the numeric keys of the events' properties, by type."""
    e = table(s, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,double>")).alias("key", "value"))
    return e.groupBy("event_type", "key").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


QUERIES = {
    "doc_dedupe_keyed": (
        keyed,
        f"with k as (select *, sha1({KEY}) as dedupe_key from documents) select dedupe_key, arg_max(doc_id, n_chars * 100000000 - doc_id) as doc_id, count(*) as members, list_aggregate(list_sort(list(distinct source)), 'string_agg', '|') as labels from k group by 1",
    ),
    "asymmetric_dedupe": (asymmetric, f"with k as (select doc_id, source, sha1({KEY}) as k from documents) select doc_id, source from k where source <> 'src0' and k not in (select k from k where source = 'src0')"),
    "reference_audit": (
        audit,
        """select 'lineitem_without_order' as "check", count(*) as failures from lineitem where l_orderkey not in (select o_orderkey from orders)
union all select 'lineitem_without_part', count(*) from lineitem where l_partkey not in (select p_partkey from part) union all select 'order_without_customer', count(*) from orders where o_custkey not in (select c_custkey from customer)
union all select 'label_without_document', count(*) from labels where doc_id not in (select doc_id from documents) union all select 'document_id_repeated', count(*) from (select doc_id from documents group by 1 having count(*) > 1)
union all select 'line_repeated', count(*) from (select l_orderkey, l_linenumber from lineitem group by all having count(*) > 1) union all select 'length_wrong', count(*) from documents where n_chars <> length(text)""",
    ),
    "stratified_sample": (
        sample,
        """with recursive n as (select lang, count(*) as population, sum(count(*)) over () as total from documents group by 1), t(step, m) as (
  select 0, (select map_from_entries(list((lang, 1::bigint) order by lang)) from n)
  union all select step + 1, map_concat(m, (select map([lang], [m[lang] + 1]) from n where m[lang] < population order by 60 * population / total - m[lang] desc, lang desc limit 1)) from t where list_sum(map_values(m)) < least(60, (select max(total) from n))),
f as (select m from t order by step desc limit 1), r as (select doc_id, d.lang, population, f.m[d.lang] as taken, row_number() over (partition by d.lang order by sha256('7:' || doc_id), doc_id) as k from documents d join n using (lang), f)
select lang, doc_id, population, taken, round(taken / population, 9) as probability, round(population / taken, 9) as weight from r where k <= taken""",
    ),
    "hard_negative_sample": (
        negatives,
        f"with {SCORED}, x as (select doc_id, 1 - y as y, score from sc), c as (select 2 * count(*) as most from x where y = 1), h as (select doc_id, row_number() over (order by score desc, doc_id) as k from x where y = 0), r as (select doc_id, row_number() over (order by sha256('27:' || doc_id), doc_id) as k from h, c where k > most // 2)"
        " select doc_id, 1 as y, 'positive' as kind from x where y = 1 union all select doc_id, 0, 'hard' from h, c where k <= most // 2 union all select doc_id, 0, 'drawn' from r, c where k <= most - most // 2",
    ),
    "confusion_best_f1": (
        f1,
        f"with {SCORED}, t as (select score, sum(y)::bigint as tp, count(*) as n from sc group by 1), c as (select score, sum(tp) over w as ctp, sum(n) over w as cn from t window w as (order by score desc rows unbounded preceding)), a as (select sum(y) as p, count(*) as n from sc), f as (select *, 2 * ctp / (cn + p) as f1 from c, a order by f1 desc, score desc limit 1)"
        " select score as threshold, round(f1, 9) as f1, ctp::bigint as tp, (cn - ctp)::bigint as fp, (p - ctp)::bigint as fn, (n - cn - p + ctp)::bigint as tn from f",
    ),
    "calibration_brier": (brier, "select lang, round(avg((least(n_chars, 5000) / 5000 - quality) ** 2), 9) as brier from documents join labels using (doc_id) group by 1"),
    "bootstrap_ci": (
        bootstrap,
        """with u as (select quality, rep, ('0x' || substr(md5(doc_id || ':' || rep), 1, 8))::bigint / 4294967296.0 as u from labels, range(200) r(rep)), w as (select rep, quality, (u >= 0.36787944117144233)::int + (u >= 0.7357588823428847)::int + (u >= 0.9196986029286058)::int + (u >= 0.9810118431238462)::int + (u >= 0.9963401531726563)::int + (u >= 0.9994058151824183)::int + (u >= 0.9999167588507120)::int + (u >= 0.9999897508033253)::int as w from u),
m as (select rep, sum(w * quality) / sum(w) as m from w group by 1) select round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high, round(avg(m), 9) as middle from m""",
    ),
    "hhi": (hhi, "with n as (select o_orderpriority, o_custkey, count(*) as n from orders group by all) select o_orderpriority, round(sum(n * n) / (sum(n) * sum(n)), 12) as hhi, sum(n)::bigint as rows, count(*) as parts from n group by 1"),
    "concentration_cumshare": (cumshare, "with n as (select lang, source, count(*) as n from documents group by all) select lang, source, n, row_number() over w as place, round(sum(n) over (w rows unbounded preceding) / sum(n) over (partition by lang), 9) as share from n window w as (partition by lang order by n desc, source)"),
    "decision_overlay": (
        overlaid,
        f"with {DECIDED}, e as (select * from dc union all select b, a, case relation when 'broader_than' then 'narrower_than' else relation end, seq from dc), l as (select a, b, arg_max(relation, {{'s': seq, 'r': relation}}) as relation from e group by all)"
        " select x.s_suppkey as a, y.s_suppkey as b, relation, case when relation is null then 'open' else 'decided' end as status from supplier x join supplier y on x.s_nationkey = y.s_nationkey and x.s_suppkey < y.s_suppkey left join l on l.a = x.s_suppkey and l.b = y.s_suppkey",
    ),
    "equivalence_conflicts": (
        conflicts,
        f"with recursive {DECIDED}, q as (select distinct a, b from dc where relation = 'equivalent_to' union select b, a from dc where relation = 'equivalent_to'), r(node, c) as (select a, a from q union select q.b, c from r join q on q.a = node where c < q.b), m as (select n.a as node, least(n.a, coalesce(min(c), n.a)) as component from (select distinct a from q) n left join r on r.node = n.a group by n.a)"
        " select distinct dc.a, dc.b, x.component from dc join m x on x.node = dc.a join m y on y.node = dc.b and x.component = y.component where relation = 'distinct_from'",
    ),
    "content_fingerprint": (ids, "select c_custkey, 'cust_' || substr(sha1(lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) || chr(31) || lower(trim(regexp_replace(c_mktsegment, '\\s+', ' ', 'g')))), 1, 12) as stable, 'p' || substr(sha256(least(c_name, c_mktsegment) || '|' || greatest(c_name, c_mktsegment)), 1, 20) as pair from customer"),
    "table_hash": (digest, "select count(*) as rows, sum(('0x' || substr(md5(o_orderkey || chr(31) || o_custkey || chr(31) || o_orderstatus || chr(31) || o_orderpriority), 1, 12))::bigint)::varchar as digest from orders"),
    "ext_stream_windows": (tumbling, "select epoch_us(time_bucket(interval '1 hour', ts)) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all"),
    "ext_sliding_windows": (sliding, "select epoch_us(time_bucket(interval '30 minutes', ts)) - k * 1800000000 as start, event_type, count(*) as n, round(sum(value), 4) as total from events, range(2) r(k) group by all"),
    "ext_sessionize": (
        sessionize,
        "with g as (select user_id, ts, sum(case when epoch_us(ts) - epoch_us(p) > 1800000000 or p is null then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session from (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events)) select user_id, session, epoch_us(min(ts)) as start, count(*) as n from g group by all",
    ),
    "ext_session_windows": (
        event_sessions,
        "with g as (select user_id, ts, value, sum(case when epoch_us(ts) - epoch_us(p) >= 1800000000 or p is null then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events)) select user_id, epoch_us(min(ts)) as start, count(*) as n, round(sum(value), 4) as total from g group by user_id, k",
    ),
    "ext_rollup": (rollup, "select lang, source, grouping_id(lang, source) as level, count(*) as n, sum(n_chars)::bigint as chars from documents group by rollup (lang, source)"),
    "usage_sums": (usage, "select event_type, key, sum(value) as total, count(*) as n from (select event_type, unnest(json_keys(props)) as key, (json_extract(props, '$.' || unnest(json_keys(props))))::double as value from events) group by all"),
}
