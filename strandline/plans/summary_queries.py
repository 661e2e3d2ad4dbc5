"""Queries of the aggregates: modes, lists, quantiles, status tables, registries, coverage, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import pairs as P
from ..operators import summaries as S
from ..operators.scratch import Scratch
from ..session import table
from .pair_queries import WITH, evidence, facts
from . import settings as cfg


def saved(s: SparkSession, d: str) -> DataFrame:
    return Scratch(s, "facts").save(facts(s, d), "facts")


def concept_modes(s: SparkSession, d: str) -> DataFrame:
    rows = saved(s, d)
    return S.mode_by(rows, ["concept_id"], "layer").join(S.mode_by(rows, ["concept_id"], "year", "year_mode"), "concept_id")


def name_words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("word"))


def typed_lists(s: SparkSession, d: str) -> DataFrame:
    kind = F.col("concept_type")
    return S.packed_lists(facts(s, d), "paper_id", "concept_id", {"materials": kind.isin("T1", "T2"), "mechanisms": kind.isin("T3", "T4", "T5")})


def price_stats(s: SparkSession, d: str) -> DataFrame:
    out = S.describe(table(s, d, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("price")), "price", "o_orderpriority")
    return out.select("o_orderpriority", "count", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


def transfer_status(s: SparkSession, d: str) -> DataFrame:
    """Statuses of pairs by the first concept's type."""
    rows = P.status(P.pair_summary(evidence(s, d, "source")), P.pair_summary(evidence(s, d, "target")))
    kinds = ["target_only", "not_in_target", "target_before_source", "same_year", "source_then_target"]
    out = S.status_table(rows.withColumn("type", F.substring("u", 7, 1)), "type", "status", kinds, "source_then_target")
    return out.withColumn("ratio", F.round("ratio", 9))


def type_matrix(s: SparkSession, d: str) -> DataFrame:
    rows = P.pair_evidence(saved(s, d)).groupBy("u", "v", "u_type", "v_type").agg(F.count_distinct("paper_id").alias("papers"))
    return S.type_matrix(rows, "u_type", "v_type", "papers")


def registry(s: SparkSession, d: str) -> DataFrame:
    return S.node_registry({"source": P.pair_summary(evidence(s, d, "source")), "target": P.pair_summary(evidence(s, d, "target"))})


def paper_audit(s: SparkSession, d: str) -> DataFrame:
    rows = saved(s, d)
    return S.paper_audit(rows, P.pair_evidence(rows))


def paper_coverage(s: SparkSession, d: str) -> DataFrame:
    """Orders as papers, lines as claims, lines returned as program evidence of their part's brand."""
    papers = table(s, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"))
    lines = table(s, d, "lineitem")
    claims = lines.where("l_quantity >= 10").select(F.col("l_orderkey").alias("paper_id"))
    programs = lines.where("l_returnflag = 'R'").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("paper_id"), F.col("p_brand").alias("program"))
    return S.coverage_status(papers, claims, programs, cfg.FREEZE)


def emergent(s: SparkSession, d: str) -> DataFrame:
    return S.emergent_edges(Scratch(s, "emergent").save(evidence(s, d, "target"), "evidence"), cfg.CUTOFF)


def split_concepts(s: SparkSession, d: str) -> DataFrame:
    """Frequent concepts (background) against the rest, at the 92nd percentile of document frequency."""
    df = saved(s, d).groupBy("concept_id").agg(F.count_distinct("paper_id").alias("df"))
    return S.percentile_split(Scratch(s, "split").save(df, "df"), "df", 0.92, "background", "recommended").withColumn("cut", F.round("cut", 9))


def brand_pairs(s: SparkSession, d: str) -> DataFrame:
    """Suppliers that share brands or sizes of what they delivered with returns."""
    rows = table(s, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand", "p_size")
    return S.shared_pairs(Scratch(s, "shared").save(rows, "rows"), "l_suppkey", ["p_brand", "p_size"])


def program_support(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    weight = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.75).otherwise(0.5)
    return S.support_table(rows, "p_brand", "l_orderkey", weight).withColumn("hhi", F.round("hhi", 12))


def axis(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("c_mktsegment", (F.col("o_orderstatus") == "F").cast("int").alias("predicted"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"), F.col("o_totalprice").cast("double").alias("score"))
    return S.axis_order(rows, "c_mktsegment")


STOP = ("the", "of", "and", "de", "der", "la", "le", "to", "in", "a")


def bounded_ngrams(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("text is not null")
    return S.bounded_ngrams(docs, "doc_id", "text", (2, 3), 3, 0.05, STOP)


_SUMS = "sx as (select u, v, papers from sums where layer = 'source'), tx as (select u, v, papers from sums where layer = 'target')"
QUERIES = {
    "concept_modes": (
        concept_modes,
        WITH + ", a as (select concept_id, layer, count(*) as n from facts group by all), b as (select concept_id, year, count(*) as n from facts group by all),"
        " x as (select concept_id, layer as mode, n as mode_n from a qualify row_number() over (partition by concept_id order by n desc, layer) = 1), y as (select concept_id, year as year_mode, n as year_mode_n from b qualify row_number() over (partition by concept_id order by n desc, year) = 1) select * from x join y using (concept_id)",
    ),
    "top_values": (
        lambda s, d: S.top_values(name_words(s, d), "p_brand", "word", 3),
        "with w as (select p_brand, unnest(string_split(p_name, ' ')) as word from part), n as (select p_brand, word, count(*) as n from w group by all), k as (select *, row_number() over (partition by p_brand order by n desc, word) as k from n qualify k <= 3) select p_brand, string_agg(word || ':' || n, '; ' order by k) as top from k group by 1",
    ),
    "typed_lists": (typed_lists, WITH + "select paper_id, coalesce(string_agg(distinct concept_id, '; ' order by concept_id) filter (concept_type in ('T1', 'T2')), '') as materials, coalesce(string_agg(distinct concept_id, '; ' order by concept_id) filter (concept_type in ('T3', 'T4', 'T5')), '') as mechanisms from facts group by 1"),
    "describe_prices": (
        price_stats,
        "with p as (select o_orderpriority, o_totalprice::double as x from orders) select o_orderpriority, count(x) as count, round(avg(x), 4) as mean, round(stddev_samp(x), 4) as std, round(min(x), 4) as min, round(max(x), 4) as max, round(quantile_cont(x, 0.25), 4) as q25, round(quantile_cont(x, 0.5), 4) as median, round(quantile_cont(x, 0.75), 4) as q75 from p group by 1",
    ),
    "transfer_status_table": (
        transfer_status,
        WITH + """, a as (select u, v, first_year as s from sums where layer = 'source'), b as (select u, v, first_year as t from sums where layer = 'target'), o as (select substr(u, 7, 1) as type, case when s is null then 'target_only' when t is null then 'not_in_target' when t < s then 'target_before_source' when t = s then 'same_year' else 'source_then_target' end as st from a full join b using (u, v))
select type, count(*) filter (st = 'target_only') as target_only, count(*) filter (st = 'not_in_target') as not_in_target, count(*) filter (st = 'target_before_source') as target_before_source, count(*) filter (st = 'same_year') as same_year, count(*) filter (st = 'source_then_target') as source_then_target, count(*) as total, round(count(*) filter (st = 'source_then_target') / count(*), 9) as ratio from o group by 1""",
    ),
    "type_pair_matrix": (type_matrix, WITH + ", p as (select u, v, u_type, v_type, count(distinct paper_id) as papers from ev group by all) select least(u_type, v_type) as type_a, greatest(u_type, v_type) as type_b, count(*) as n, max(papers) as best from p group by all"),
    "weighted_degrees": (lambda s, d: S.weighted_degrees(P.pair_summary(evidence(s, d, "source")), "papers"), WITH + ", x as (select unnest([u, v]) as node, papers from sums where layer = 'source') select node, count(*) as degree, sum(papers)::bigint as weighted_degree from x group by 1"),
    "node_registry": (
        registry,
        WITH + f", {_SUMS}, e as (select unnest([u, v]) as node, papers, 'source' as bank from sx union all select unnest([u, v]), papers, 'target' from tx) select node, count(*) filter (bank = 'source') as source_pairs, coalesce(sum(papers) filter (bank = 'source'), 0)::bigint as source_papers, coalesce(max(papers) filter (bank = 'source'), 0) as source_best,"
        " count(*) filter (bank = 'target') as target_pairs, coalesce(sum(papers) filter (bank = 'target'), 0)::bigint as target_papers, coalesce(max(papers) filter (bank = 'target'), 0) as target_best, count(distinct bank) = 2 as in_all from e group by 1",
    ),
    "layer_roles": (
        lambda s, d: S.layer_roles(facts(s, d)),
        WITH + ", e as (select concept_type, concept_id, max((layer <> 'target')::int) as s, max((layer <> 'source')::int) as t, count(distinct paper_id) as papers from facts group by all) select concept_type, count(*) as concepts, sum(s * t)::bigint as shared, sum(s * (1 - t))::bigint as source_only, sum(t * (1 - s))::bigint as target_only, sum(papers)::bigint as mentions from e group by 1",
    ),
    "paper_audit": (
        paper_audit,
        WITH + ", a as (select paper_id, count(distinct concept_id) as concepts, count(distinct concept_type) as types from facts group by 1), b as (select paper_id, count(*) as pairs, count(*) filter (u_type <> v_type) as mixed_pairs from ev group by 1) select paper_id, concepts, types, coalesce(pairs, 0) as pairs, coalesce(mixed_pairs, 0) as mixed_pairs from a left join b using (paper_id)",
    ),
    "paper_coverage": (
        paper_coverage,
        "with p as (select o_orderkey as paper_id, year(o_orderdate)::int as year from orders), c as (select l_orderkey as paper_id, count(*) as claims from lineitem where l_quantity >= 10 group by 1), g as (select l_orderkey as paper_id, count(distinct p_brand) as programs from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' group by 1),"
        " o as (select paper_id, year, coalesce(claims, 0) as claims, coalesce(programs, 0) as programs from p left join c using (paper_id) left join g using (paper_id)) select *, case when year > 2000 then 'after_freeze' when programs > 0 then 'in_program' when claims > 0 then 'claims_only' else 'no_claim' end as status from o",
    ),
    "knowledge_flow": (lambda s, d: S.knowledge_flow(facts(s, d)), WITH + ", e as (select concept_id, min(year) filter (layer = 'source') as source_year, min(year) filter (layer = 'target') as target_year from facts group by 1) select *, (target_year - source_year)::int as lag from e where target_year > source_year"),
    "emergent_edges": (
        emergent,
        WITH.replace("with ", "with recursive ", 1) + """, early as materialized (select distinct u, v from tgt where year <= 1998), fresh as materialized (select u, v, count(distinct paper_id) as papers, arg_min(paper_id, year * 1000000000000 + paper_id) as first_paper from tgt where year > 1998 and (u, v) not in (select (u, v) from early) group by u, v),
bw as materialized (select u as a, v as b from early union all select v, u from early), hop(s, x, d) as (select distinct u, u, 0 from fresh union select s, b, d + 1 from hop join bw on a = x where d < 8), sd as (select s, x, min(d) as d from hop group by 1, 2)
select f.u, f.v, papers, first_paper, coalesce(d, 9)::int as early_distance from fresh f left join sd on sd.s = f.u and sd.x = f.v""",
    ),
    "gated_concepts": (
        lambda s, d: S.gated(saved(s, d), 2, 60, F.col("concept_id").startswith("Brand#11")),
        WITH + ", a as (select concept_id, count(distinct paper_id) as df, min(year) as first_year from facts group by 1), n as (select concept_id, layer, count(*) as n from facts group by all), m as (select concept_id, layer as layer_mode from n qualify row_number() over (partition by concept_id order by n desc, layer) = 1) select * from a join m using (concept_id) where df between 2 and 60 or starts_with(concept_id, 'Brand#11')",
    ),
    "specific_concepts": (lambda s, d: S.specific_concepts(facts(s, d), 2, 120, 500), WITH + ", a as (select concept_id, count(distinct paper_id) as df from facts group by 1 having count(distinct paper_id) between 2 and 120) select *, round(ln(1 + df) / (1 + log10(df)), 9) as score from a order by score desc, concept_id limit 500"),
    "background_split": (split_concepts, WITH + ", a as (select concept_id, count(distinct paper_id) as df from facts group by 1), q as (select quantile_cont(df, 0.92) as cut from a) select concept_id, df, round(cut, 9) as cut, case when df > cut then 'background' else 'recommended' end as part from a, q"),
    "shared_program_pairs": (
        brand_pairs,
        "with r as (select distinct l_suppkey as i, p_brand, p_size from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' and l_quantity >= 45), h as (select distinct i, 'p_brand' as kind, p_brand as x from r union all select distinct i, 'p_size', p_size::varchar from r) select a.i as a, b.i as b, a.kind, count(*) as n from h a join h b on a.kind = b.kind and a.x = b.x and a.i < b.i group by all",
    ),
    "program_support": (
        program_support,
        "with n as (select p_brand, l_orderkey, count(*) as n, sum(case l_returnflag when 'A' then 1.0::double when 'N' then 0.75::double else 0.5::double end) as w from lineitem join part on l_partkey = p_partkey group by all) select p_brand, sum(n)::bigint as evidence, count(*) as papers, sum(w) as weighted_support, round(sum(n * n) / (sum(n) * sum(n)), 12) as hhi from n group by 1",
    ),
    "axis_order": (
        axis,
        "with n as (select c_mktsegment as label, sum((o_orderstatus = 'F')::int)::bigint as predicted, sum((o_orderpriority = '1-URGENT')::int)::bigint as positives, max(o_totalprice::double) as best, count(*) as n from orders join customer on o_custkey = c_custkey group by 1) select *, row_number() over (order by predicted desc, positives desc, best desc, n desc, label) as place from n",
    ),
    "bounded_ngrams": (
        bounded_ngrams,
        "with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null), g as (select distinct doc_id, unnest(list_concat(list_transform(range(1, greatest(len(w), 1)), lambda i: array_to_string(w[i:i+1], ' ')), list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i+2], ' ')))) as gram from d),"
        f" k as (select * from g where string_split(gram, ' ')[1] not in {STOP} and string_split(gram, ' ')[-1] not in {STOP}) select gram, count(*) as df from k group by 1 having count(*) >= 3 and count(*) <= (select count(*) from d) * 0.05",
    ),
}
