"""Queries of the review workflow over the documents, labels, orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairs as P
from ..operators import survival as S
from ..operators import batching as T
from ..operators import workflow as W
from ..operators.scratch import Scratch
from ..session import table
from .pair_queries import WITH, evidence, parts
from .review_queries import decisions
from . import settings as cfg


def promoted(s: SparkSession, d: str) -> DataFrame:
    """Labelled documents of good quality become units of their source, unless their source has the same text as a unit (the toxic ones stand for units)."""
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").where("text is not null").select("doc_id", "source", F.md5(F.substring("text", 1, 1000000).cast("binary")).alias("content"), "quality", "toxic")
    base = docs.where("toxic = 1").select("source", "content").distinct()
    from ..functions.text import stable_id

    base = base.select("source", stable_id("U", F.col("source"), "content").alias("unit_id"), F.lit(7).alias("unit"))
    found = docs.where("toxic = 0").select(F.col("doc_id").alias("candidate_id"), "source", "content")
    verdicts = docs.where("toxic = 0").select(F.col("doc_id").alias("candidate_id"), (F.col("quality") == 1).alias("approved"))
    return W.promote(base, found, verdicts, "source", "content", "unit").select("source", "unit_id", F.col("unit").cast("long").alias("unit"))


def queue(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", F.round(F.ln(F.col("n_chars") + 1), 6).alias("score"))
    return W.review_queue(rows, "score", "doc_id", 6.0, 8.0, 0.5)


def analysis_checks(s: SparkSession, d: str) -> DataFrame:
    """Keys, ranges, vocabularies, sums and references of the whole star, counted in a pass a table."""
    o, li, p, docs = (table(s, d, t) for t in ("orders", "lineitem", "part", "documents"))
    sizes = li.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.max("l_linenumber").alias("last"))
    frames = {
        "order_key_repeated": o.groupBy("o_orderkey").agg(F.count("*").alias("n")).where("n > 1"), "order_without_lines": o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_anti"),
        "line_numbers_with_gaps": sizes.where("lines <> last"), "line_without_supplier": li.join(table(s, d, "supplier"), li["l_suppkey"] == F.col("s_suppkey"), "left_anti"),
    }
    out = W.checks({**frames, "order_status_unknown": ~F.col("o_orderstatus").isin("F", "O", "P"), "order_price_not_positive": F.col("o_totalprice") <= 0, "order_date_missing": F.col("o_orderdate").isNull(), "order_priority_odd": ~F.col("o_orderpriority").rlike("^[1-5]-")}, o)
    out = out.unionByName(W.checks({"line_quantity_out_of_range": ~F.col("l_quantity").between(1, 50), "line_discount_out_of_range": ~F.col("l_discount").between(0, 0.1), "line_flag_unknown": ~F.col("l_returnflag").isin("A", "N", "R")}, li))
    out = out.unionByName(W.checks({"part_size_out_of_range": ~F.col("p_size").between(1, 50), "part_brand_odd": ~F.col("p_brand").rlike("^Brand#[1-9][0-9]$")}, p))
    return out.unionByName(W.checks({"text_missing": F.col("text").isNull(), "length_wrong": F.col("n_chars") != F.length("text"), "language_missing": F.col("lang").isNull()}, docs))


def mirrors(s: SparkSession, d: str) -> DataFrame:
    """Oriented decisions without a decision the other way round, and decisions whose ends lie in different nations."""
    dec = Scratch(s, "mirror").save(decisions(s, d).select("a", "b").distinct(), "decisions")
    nation = table(s, d, "supplier").select(F.col("s_suppkey").alias("a"), "s_nationkey")
    rows = dec.join(table(s, d, "supplier").select(F.col("s_suppkey").alias("b"), "s_nationkey"), "b")
    return W.checks({"decision_without_mirror": W.mirror_failures(dec, "a", "b"), "nations_differ": W.identity_mismatches(rows, nation, "a", ["s_nationkey"])})


RULES = {"Brand#1": "^(small|red|blue)", "Brand#2": "(steel|tin)$", "Brand#3": "e"}


def assembled(s: SparkSession, d: str) -> DataFrame:
    """Lines as claims with their part's brand family as lever; orders as papers; returned lines are excluded."""
    rules = s.createDataFrame([(f"P{i}", k, p) for i, (k, p) in enumerate(RULES.items())], "program string, lever string, pattern string")
    lines = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    claims = Scratch(s, "claims").save(lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim"), F.col("l_orderkey").alias("paper"), F.substring("p_brand", 1, 7).alias("lever"), F.col("p_name").alias("text"), "l_returnflag"), "claims")
    out = claims.where("l_returnflag = 'R'").select("claim").crossJoin(rules.select("program"))
    return W.assemble(claims.drop("l_returnflag"), rules, out)


def program_table(s: SparkSession, d: str) -> DataFrame:
    rules = s.createDataFrame([(f"P{i}",) for i in range(4)], "program string")
    rows = Scratch(s, "assembled").save(assembled(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("paper"), "o_orderpriority", "o_orderstatus"), "paper"), "rows")
    return W.program_rows(rules, rows.where("o_orderstatus = 'F'"), rows.where("o_orderpriority = '5-LOW'"), rows.where("o_orderpriority >= '4'"))


LEVERS = {"secret": "password|secret|token", "address": "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]", "loud": "!!"}
TARGETS = {"digits": "[0-9]{4}", "lines": "\n", "upper": "[A-Z]{4}"}


def adoption(s: SparkSession, d: str) -> DataFrame:
    return W.hit_products(table(s, d, "documents"), "doc_id", LEVERS, TARGETS, "text")


def lever_tags(s: SparkSession, d: str) -> DataFrame:
    rules = s.createDataFrame(list(LEVERS.items()), "code string, pattern string")
    return W.tags(table(s, d, "documents").select("doc_id", "text"), "text", rules).select("doc_id", "code")


def overlay(s: SparkSession, d: str) -> DataFrame:
    programs = table(s, d, "nation").select(F.col("n_nationkey").alias("program"))
    priors = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("o_totalprice > 400000").select(F.col("c_nationkey").alias("program"), F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("kind"))
    return W.manual_overlay(programs, priors, ["F", "P"])


def verification(s: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(s, "verify")
    src = scratch.save(evidence(s, d, "source"), "source")
    n = parts(s, d)
    events = S.event_table(src, evidence(s, d, "target"), cfg.FREEZE, parts=n).where("event = 1").select("u", "v", "support_year")
    return W.verification_queue(scratch.save(events, "events"), src, parts=n)


def novelty(s: SparkSession, d: str) -> DataFrame:
    src = P.pair_summary(evidence(s, d, "source"))
    return W.novelty(src.select("u", "v", F.col("papers").alias("score")), evidence(s, d, "target"), "score").select("u", "v", "score", "place")


def unreviewed(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", F.round(F.ln(F.col("n_chars") + 1), 6).alias("score"))
    return W.next_unreviewed(rows, table(s, d, "labels"), "doc_id", "score", 50, 6.0, 8.0)


def repeated_quotes(s: SparkSession, d: str) -> DataFrame:
    names, coded = W.repeats(table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("quote")), "quote")
    return coded.select("doc_id", "quote", "ref")


def revisions(s: SparkSession, d: str) -> DataFrame:
    """Sources' labels revised where the revision still fits, and those that do not."""
    rows = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    rev = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", "BUILDING").otherwise("MACHINERY").alias("old"), F.concat(F.lit("R:"), "o_orderpriority").alias("new"), F.col("o_orderkey").alias("seq"))
    done, refused = W.apply_revisions(rows, rev, "c_custkey", "c_mktsegment")
    return done.select("c_custkey", F.col("c_mktsegment").alias("value"), F.lit("row").alias("kind")).unionByName(refused.select("c_custkey", F.col("new").alias("value"), F.lit("refused").alias("kind")))


def excerpts(s: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation quoted from the turn before."""
    c = table(s, d, "conversations")
    rows = c.select("conv_id", "turn", F.substring("text", 3, 20).alias("quote"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, "").otherwise("?")).alias("source"))
    rows = rows.withColumn("quote", F.when(F.col("turn") % 3 == 0, F.upper("quote")).otherwise(F.col("quote")))
    return W.bind_excerpts(rows, "quote", "source").select("conv_id", "turn", F.md5("evidence").alias("evidence"), "verbatim")


def summary(s: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as a batch; finished ones are decided; a batch is stale where its newest order is not its largest key's."""
    o = table(s, d, "orders")
    batches = o.select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("item"), F.lit("x").alias("stamp"))
    stamps = o.groupBy(F.col("o_custkey").alias("batch")).agg(F.when(F.max("o_totalprice") > 450000, "y").otherwise("x").alias("stamp"))
    return W.review_summary(batches, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("item")), stamps)


def problems(s: SparkSession, d: str) -> DataFrame:
    """Labels as answers to the documents asked for."""
    docs, lab = table(s, d, "documents"), table(s, d, "labels")
    rows = lab.join(docs.select("doc_id", "source"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, "kept").when(F.col("toxic") == 1, "dropped").otherwise("odd").alias("relation"), F.when(F.col("toxic") == 0, F.col("source")).alias("reason"))
    return W.output_problems(rows, docs.where("lang = 'en'").select("doc_id"), "doc_id", ["kept", "dropped"])


def roles(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    rows = p.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_type")).alias("model_role"))
    over = table(s, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("role"), F.col("l_orderkey").alias("seq"))
    return W.role_states(rows, over, "p_partkey")


def _evidence(s: SparkSession, d: str) -> DataFrame:
    """Orders as items, by priority; their parts are evidence, as long as the part's size."""
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_orderpriority", "o_orderkey", F.lit(20).alias("own"), "p_partkey", "p_size")


def packed(s: SparkSession, d: str) -> DataFrame:
    return T.in_order(_evidence(s, d), "o_orderpriority", "o_orderkey", "p_partkey", "p_size", 20, 1200)


def shared_batches(s: SparkSession, d: str) -> DataFrame:
    return T.by_shared_evidence(_evidence(s, d), "o_orderpriority", "o_orderkey", "own", "p_partkey", "p_size", 20, 1200, 100)


_ASM = "cl as (select l_orderkey * 10 + l_linenumber as claim, l_orderkey as paper, substr(p_brand, 1, 7) as lever, p_name as text, l_returnflag as flag from lineitem join part on l_partkey = p_partkey), rl as (select * from (values " + ", ".join(f"('P{i}', '{k}', '{p}')" for i, (k, p) in enumerate(RULES.items())) + ") r(program, lever, pattern)), am as (select program, paper, min(claim) as claim from cl join rl using (lever) where regexp_matches(text, pattern) and claim not in (select claim from cl where flag = 'R') group by all)"
QUERIES = {
    "promoted_units": (
        promoted,
        "with dc as (select doc_id, source, md5(substr(text, 1, 1000000)) as content, quality, toxic from documents join labels using (doc_id) where text is not null), id as (select *, 'U_' || substr(sha1(lower(source) || chr(31) || content), 1, 12) as unit_id from dc), bs as (select distinct source, unit_id from id where toxic = 1),"
        " fr as (select distinct source, unit_id from id where toxic = 0 and quality = 1 and unit_id not in (select unit_id from bs)) select source, unit_id, (case when source in (select source from bs) then 7 else 0 end + row_number() over (partition by source order by unit_id))::bigint as unit from fr",
    ),
    "review_bands": (queue, "with r as (select doc_id, round(ln(n_chars + 1), 6) as score from documents) select *, case when score is null then null when score >= 8 then 'strong' when score >= 6 then 'possible' when score >= 5.5 then 'near_threshold' else 'below' end as band from r"),
    "analysis_checks": (
        analysis_checks,
        """with t as (select 'order_key_repeated' as "check", (select count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)) as failures union all select 'order_without_lines', (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem))
union all select 'line_numbers_with_gaps', (select count(*) from (select l_orderkey from lineitem group by 1 having count(*) <> max(l_linenumber))) union all select 'line_without_supplier', (select count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier))
union all select 'order_status_unknown', (select count(*) from orders where o_orderstatus not in ('F', 'O', 'P')) union all select 'order_price_not_positive', (select count(*) from orders where o_totalprice <= 0) union all select 'order_date_missing', (select count(*) from orders where o_orderdate is null)
union all select 'order_priority_odd', (select count(*) from orders where not regexp_matches(o_orderpriority, '^[1-5]-')) union all select 'line_quantity_out_of_range', (select count(*) from lineitem where not l_quantity between 1 and 50) union all select 'line_discount_out_of_range', (select count(*) from lineitem where not l_discount between 0 and 0.1)
union all select 'line_flag_unknown', (select count(*) from lineitem where l_returnflag not in ('A', 'N', 'R')) union all select 'part_size_out_of_range', (select count(*) from part where not p_size between 1 and 50) union all select 'part_brand_odd', (select count(*) from part where not regexp_matches(p_brand, '^Brand#[1-9][0-9]$'))
union all select 'text_missing', (select count(*) from documents where text is null) union all select 'length_wrong', (select count(*) from documents where n_chars <> length(text)) union all select 'language_missing', (select count(*) from documents where lang is null)) select * from t""",
    ),
    "mirror_audit": (
        mirrors,
        "with dc as (select distinct x.l_suppkey as a, y.l_suppkey as b from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_suppkey <> y.l_suppkey and y.l_linenumber = x.l_linenumber + 1) select 'decision_without_mirror' as \"check\", count(*) as failures from dc where (b, a) not in (select (a, b) from dc)"
        " union all select 'nations_differ', count(*) from dc join supplier p on p.s_suppkey = a join supplier q on q.s_suppkey = b where p.s_nationkey <> q.s_nationkey",
    ),
    "program_assembly": (assembled, f"with {_ASM} select program, paper, claim from am"),
    "program_table": (
        program_table,
        f"with {_ASM}, r as (select am.*, o_orderpriority as pr, o_orderstatus as st from am join orders on o_orderkey = paper), p as (select 'P' || i as program from range(4) t(i)), n as (select program, count(distinct paper) filter (st = 'F') as sources, count(distinct paper) filter (pr = '5-LOW') as direct, count(distinct paper) filter (pr >= '4' and pr <> '5-LOW') as related from r group by 1)"
        " select program, coalesce(sources, 0) as sources, coalesce(direct, 0) as direct, coalesce(related, 0) as related, 3 * least(coalesce(sources, 0), 5) + 2 * least(coalesce(related, 0), 3) - 4 * least(coalesce(direct, 0), 2) as priority from p left join n using (program)",
    ),
    "adoption_evidence": (
        adoption,
        "with h as (select doc_id, list_filter([case when regexp_matches(text, 'password|secret|token') then 'secret' end, case when regexp_matches(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]') then 'address' end, case when contains(text, '!!') then 'loud' end], lambda x: x is not null) as l, list_filter([case when regexp_matches(text, '[0-9]{4}') then 'digits' end, case when contains(text, chr(10)) then 'lines' end, case when regexp_matches(text, '[A-Z]{4}') then 'upper' end], lambda x: x is not null) as t from documents),"
        " e as (select doc_id, unnest(l) as lever, t from h) select distinct doc_id, lever, unnest(t) as target from e",
    ),
    "lever_tags": (lever_tags, "select doc_id, unnest(list_filter([case when regexp_matches(text, 'password|secret|token') then 'secret' end, case when regexp_matches(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]') then 'address' end, case when contains(text, '!!') then 'loud' end], lambda x: x is not null)) as code from documents"),
    "manual_overlay": (
        overlay,
        "with p as (select distinct c_nationkey as program, o_orderkey as paper, year(o_orderdate)::int as year from orders join customer on o_custkey = c_custkey where o_totalprice > 400000 and o_orderstatus in ('F', 'P')), n as (select program, count(distinct paper) as prior_papers, min(year) as prior_year, string_agg(paper::varchar, '; ' order by paper) as prior_ids from p group by 1) select n_nationkey as program, coalesce(prior_papers, 0) as prior_papers, prior_year, coalesce(prior_ids, '') as prior_ids from nation left join n on program = n_nationkey",
    ),
    "verification_queue": (
        verification,
        WITH + """, sup as (select u, v, year as support_year from src qualify row_number() over (partition by u, v order by year, paper_id) = 1), tf as (select u, v, first_year as t from sums where layer = 'target'), e as (select u, v, support_year from sup join tf using (u, v) where support_year <= 2000 and t > support_year and t <= 2000),
m as (select e.u, e.v, support_year, paper_id, row_number() over (partition by e.u, e.v order by year, paper_id) as k from e join src on src.u = e.u and src.v = e.v and year <= support_year) select u, v, support_year, count(*) as n, string_agg(paper_id::varchar, '; ' order by k) filter (k <= 5) as papers from m group by all""",
    ),
    "novelty_filter": (novelty, WITH + ", n as (select u, v, papers as score from sums where layer = 'source' and (u, v) not in (select (u, v) from sums where layer = 'target')) select *, row_number() over (order by score desc, u, v) as place from n"),
    "next_unreviewed": (unreviewed, "with r as (select doc_id, round(ln(n_chars + 1), 6) as score from documents where doc_id not in (select doc_id from labels) order by score desc, doc_id limit 50) select *, case when score >= 8 then 'strong' when score >= 6 then 'possible' else 'below' end as band from r"),
    "repeated_quotes": (repeated_quotes, "with q as (select doc_id, sha256(text) as quote from documents where text is not null), n as (select quote from q group by 1 having count(*) > 1) select doc_id, case when n.quote is null then q.quote end as quote, case when n.quote is not null then '$' || substr(sha256(q.quote), 1, 16) end as ref from q left join n using (quote)"),
    "revisions": (
        revisions,
        "with r as (select o_custkey as k, arg_max({'o': case when o_orderstatus = 'F' then 'BUILDING' else 'MACHINERY' end, 'n': 'R:' || o_orderpriority}, o_orderkey) as x from orders group by 1) select c_custkey, case when x is not null and c_mktsegment = x.o then x.n else c_mktsegment end as value, 'row' as kind from customer left join r on k = c_custkey union all select k, x.n, 'refused' from r left join customer on c_custkey = k where c_mktsegment is distinct from x.o",
    ),
    "excerpt_binding": (
        excerpts,
        "with r as (select conv_id, turn, case when turn % 3 = 0 then upper(substr(text, 3, 20)) else substr(text, 3, 20) end as quote, coalesce(text, '') || case when turn % 2 = 0 then '' else '?' end as source from conversations), v as (select *, coalesce(contains(source, quote) and length(quote) >= 8, false) as verbatim from r) select conv_id, turn, md5(case when verbatim then quote else source end) as evidence, verbatim from v",
    ),
    "review_summary": (
        summary,
        "with n as (select o_custkey as batch, count(*) as items, count(*) filter (o_orderstatus = 'F') as decided, max(o_totalprice) as top from orders group by 1) select batch, items, decided, case when top > 450000 then 'stale' when decided >= items then 'complete' when decided > 0 then 'partial' else 'open' end as status from n",
    ),
    "output_problems": (
        problems,
        "with r as (select doc_id, case when quality = 1 then 'kept' when toxic = 1 then 'dropped' else 'odd' end as relation, case when toxic = 0 then source end as reason from labels join documents using (doc_id)), w as (select doc_id from documents where lang = 'en') select doc_id, 'missing' as problem from w where doc_id not in (select doc_id from r) union all select distinct doc_id, 'unasked' from r where doc_id not in (select doc_id from w)"
        " union all select doc_id, 'repeated' from r group by 1 having count(*) > 1 union all select doc_id, 'unknown_relation' from r where relation not in ('kept', 'dropped') union all select doc_id, 'no_reason' from r where trim(coalesce(reason, '')) = ''",
    ),
    "role_states": (
        roles,
        "with o as (select l_partkey as k, arg_max(l_returnflag, {'s': l_orderkey, 'r': l_returnflag}) as o from lineitem where l_quantity = 50 group by 1), r as (select p_partkey, case when p_size > 25 then p_type end as m, o from part left join o on k = p_partkey) select p_partkey, coalesce(o, m, 'unassigned') as role, case when o is not null then 'override' when m is not null then 'model' else 'default' end as state from r",
    ),
    "packed_batches": (packed, None),
    "shared_batches": (shared_batches, None),
}
