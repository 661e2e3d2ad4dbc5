"""Queries of evaluation: curves, error classes, intervals, audits, densities, samples, searches, and unions of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_key
from ..operators import evaluation as V
from ..operators import linkframe as L
from ..operators import pairs as P
from ..operators import retrieval as R
from ..operators import search as X
from ..operators import survival as S
from ..operators import vectors as N
from ..operators.scratch import Scratch
from ..session import table
from . import link_queries as K
from .pair_queries import KM, WITH, evidence, parts
from .review_queries import SCORED, scored
from . import settings as cfg


#: Resamples of an interval.
RESAMPLES = 2000


def labelled(s: SparkSession, d: str) -> DataFrame:
    """Labelled documents: the logarithm of the length as score of quality, by language."""
    return scored(s, d).join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")


def curve(s: SparkSession, d: str) -> DataFrame:
    return K.rounded(V.precision_curve(labelled(s, d), ["lang"], "score", "y", ["doc_id"], 100), "precision", "recall")


def errors(s: SparkSession, d: str) -> DataFrame:
    return V.error_classes(labelled(s, d), ["lang"], "score", "y", ["doc_id"], 40).select("lang", "doc_id", "y", "place", "error")


def confusion(s: SparkSession, d: str) -> DataFrame:
    return K.rounded(V.confusion_at_k(labelled(s, d), ["lang"], "score", "y", ["doc_id"], [10, 50, 100000]), "precision", "recall", "f1")


def intervals(s: SparkSession, d: str) -> DataFrame:
    return K.rounded(X.resampled(scored(s, d), F.col("doc_id"), "score", "y", RESAMPLES), "low", "high", "middle")


def contamination(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return K.rounded(V.contamination(rows, ["lang"], F.col("toxic") == 1), "auc", "ap", "lift")


def densities(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return N.density(v, "vec_id", "x", "y", 0.1).withColumn("density", F.round("density", 6))


def cosine_flags(s: SparkSession, d: str) -> DataFrame:
    """Neighbouring vectors of a label as evidence pairs, their cosine and whether it is suspiciously high."""
    v = table(s, d, "embeddings").select("vec_id", "label", "embedding")
    other = v.select((F.col("vec_id") - 10).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("e2"))
    out = v.join(other, "vec_id").select("vec_id", "other", F.round(R.cosine("embedding", "e2"), 6).alias("cosine"))
    return out.withColumn("flag", F.col("cosine") > 0.95)


def hash_sample(s: SparkSession, d: str) -> DataFrame:
    return V.hash_sample(table(s, d, "documents").select("doc_id", "lang"), "doc_id", 20, "11", ["lang"])


def spaced(s: SparkSession, d: str) -> DataFrame:
    return V.spaced_sample(table(s, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 100)


def yearly(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "P").cast("int").alias("y"), F.col("o_totalprice").cast("double").alias("score"))
    return V.yearly_sample(rows, "year", "y", "score", ["o_orderkey"], 3, "27").select("o_orderkey", "year", "y")


def unified(s: SparkSession, d: str) -> DataFrame:
    """Documents of one source, then of the others, unified by text and by leading words."""
    docs = table(s, d, "documents").select("doc_id", F.when(F.col("source") != "src3", F.sha1(norm_key("text"))).alias("doi"), F.nullif(F.substring(norm_key("text"), 1, 40), F.lit("")).alias("title"), "source")
    docs = Scratch(s, "unify").save(docs, "docs")
    return V.unified(docs.where("source = 'src0'"), docs.where("source <> 'src0'"), ["doi", "title"], [F.asc("doc_id")]).select("doc_id", "origin")


def dense(s: SparkSession, d: str) -> DataFrame:
    return V.dense_ids(table(s, d, "orders"), "o_custkey", "o_orderkey")


def compared(s: SparkSession, d: str) -> DataFrame:
    bank = lambda layer: P.pair_summary(evidence(s, d, layer)).where("papers >= 2")
    return V.compared(bank("source"), bank("target"), ["u", "v"], "papers")


def aliases(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    merge = p.select(F.col("p_brand").alias("concept"), F.concat(F.substring("p_brand", 1, 7), F.lit("x")).alias("into")).distinct().where("concept like 'Brand#2%'")
    return V.aliases(p.select(F.concat(F.upper("p_name"), F.lit("  "), "p_type").alias("term"), F.col("p_brand").alias("concept")), merge)


def survival_by_support(s: SparkSession, d: str) -> DataFrame:
    """Incidence after 1, 3 and 5 years for supports of one to three papers."""
    scratch = Scratch(s, "support")
    src, tgt = scratch.save(evidence(s, d, "source"), "source"), scratch.save(evidence(s, d, "target"), "target")
    out = None
    for k in (1, 2, 3):
        rows = S.at_horizons(S.kaplan_meier(S.event_table(src, tgt, cfg.FREEZE, k, parts(s, d))), [1, 3, 5]).select(F.lit(k).alias("support"), "horizon", F.round("incidence", 9).alias("incidence"))
        out = rows if out is None else out.unionByName(rows)
    return out


RANKS = tuple(L.GRAPH_SCORE)
WEIGHTS = X.vectors([L.GRAPH_SCORE[c] for c in RANKS])
#: The first vectors, which are not random: the baseline, equal weights and each rank alone.
PLAIN = 2 + len(RANKS)


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return K.scored(s, d, cfg.CUTOFFS).withColumn("closeness", -F.col("shortest_path"))


def weight_search(s: SparkSession, d: str) -> DataFrame:
    """The vectors that are not random, over the folds."""
    out = X.search(_ranked(s, d), ["u", "v"], "cutoff", "label", RANKS, WEIGHTS[:PLAIN])
    return K.rounded(out, *[c for c in out.columns if c != "choice"])


def weight_search_full(s: SparkSession, d: str) -> DataFrame:
    """All vectors over the folds."""
    return X.search(_ranked(s, d), ["u", "v"], "cutoff", "label", RANKS, WEIGHTS)


def by_distance(s: SparkSession, d: str) -> DataFrame:
    """Metrics of the self task by the distance of a pair."""
    rows = K.scored_self(s, d).select(F.lit(cfg.SELF_CUTOFF).alias("cutoff"), F.least("shortest_path", F.lit(4)).alias("distance"), F.col("label").alias("y"), F.col("graph_score").alias("score"))
    from ..operators import metrics as M

    return K.rounded(M.auc_ap(rows, ["distance"]), "auc", "ap", "lift")


_LAB = f"with {SCORED}, lb as (select sc.*, lang from sc join documents using (doc_id)), pl as (select *, row_number() over (partition by lang order by score desc, doc_id) as place from lb)"
_POISSON = " + ".join(f"(u >= {c!r}::double)::int" for c in X.poisson_cuts())
_P = X.PRIME
_SEARCH = "".join(f", w{i} as (select cutoff, u, v, label as y, {i}::int as choice, round(" + " + ".join(f"{float(x)!r}::double * {K.pct_sql('-shortest_path' if c == 'closeness' else c, 'cutoff')}" for c, x in zip(RANKS, w, strict=True)) + ", 9) as score from rows_)" for i, w in enumerate(WEIGHTS[:PLAIN]))

QUERIES = {
    "precision_curve": (
        curve,
        _LAB + ", c as (select lang, place, sum(y) over (partition by lang order by place rows unbounded preceding)::bigint as hits from pl), n as (select lang, sum(y) as p from lb group by 1) select lang, place, hits, round(hits / place, 9) as precision, case when p > 0 then round(hits / p, 9) end as recall from c join n using (lang) where place <= 100",
    ),
    "error_classes": (errors, _LAB + " select lang, doc_id, y, place, case when place <= 40 and y = 1 then 'TP' when place <= 40 then 'FP' when y = 1 then 'FN' else 'TN' end as error from pl"),
    "confusion_at_k": (
        confusion,
        _LAB + ", c as (select lang, k::int as k, count(*) filter (place <= k and y = 1) as tp, count(*) filter (place <= k and y = 0) as fp, count(*) filter (place > k and y = 1) as fn, count(*) filter (place > k and y = 0) as tn from pl, (values (10), (50), (100000)) x(k) group by all),"
        " r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0::double end as p, case when tp + fn > 0 then tp / (tp + fn) else 0.0::double end as q from c) select lang, k, tp, fp, fn, tn, round(p, 9) as precision, round(q, 9) as recall, round(case when p + q > 0 then 2 * p * q / (p + q) else 0.0::double end, 9) as f1 from r",
    ),
    "bootstrap_metrics": (
        intervals,
        f"with {SCORED}, h0 as (select doc_id, y, score, rep, (doc_id % {_P} * 48271 + rep * 69621 + 12345) % {_P} as h from sc, range({RESAMPLES}) r(rep) where score is not null and y is not null), h1 as (select *, (h * h % {_P} + doc_id % {_P} + rep) % {_P} as h2 from h0), h3 as (select *, (h2 * h2 % {_P} + 7919 * rep) % {_P} as h4 from h1),"
        f" us as (select rep, score, y, (h4 * 48271 % {_P})::double / {_P} as u from h3), ws as (select rep, y, score, {_POISSON} as w from us), ti as (select rep, score, sum(w * y)::bigint as tp, sum(w)::bigint as n from ws where w > 0 group by all),"
        " cu as (select *, sum(tp) over w as ctp, sum(n) over w as cn from ti window w as (partition by rep order by score desc rows unbounded preceding)), pr as (select rep, sum(tp) as p, sum(n) as n, sum((n - tp) * (ctp - tp / 2)) as u, sum(tp * ctp / cn) as a from cu group by 1), ok as (select * from pr where p > 0 and p < n),"
        " m as (select 'auc' as metric, u / (p * (n - p)) as x from ok union all select 'ap', a / p from ok) select metric, round(quantile_cont(x, 0.025), 9) as low, round(quantile_cont(x, 0.975), 9) as high, round(avg(x), 9) as middle, count(*) as valid from m group by 1",
    ),
    "contamination_audit": (contamination, f"with {SCORED}, b as (select sc.*, toxic, lang from sc join labels using (doc_id) join documents using (doc_id)), a as (select lang, 'with_ambiguous' as audit, y, score from b union all select lang, 'without_ambiguous', y, score from b where not (toxic = 1 and y = 1))" + K.auc_sql("lang, audit", "a")),
    "kernel_density": (densities, "with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings) select a.vec_id, round(sum(exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (2 * 0.1::double ** 2))) / (2 * pi() * 0.1::double ** 2 * count(*)), 6) as density from p a cross join p b group by 1"),
    "cosine_flags": (
        cosine_flags,
        "with c as (select a.vec_id, b.vec_id as other, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[])), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 10) select *, cosine > 0.95 as flag from c",
    ),
    "hash_sample": (hash_sample, "select doc_id, lang from documents qualify row_number() over (partition by lang order by sha256('11:' || doc_id), doc_id) <= 20"),
    "spaced_sample": (spaced, "with p as (select doc_id, n_chars, row_number() over (order by n_chars, doc_id) as place, count(*) over () as n from documents) select doc_id, n_chars, place from p where place in (select floor(i * (n - 1) / 99) + 1 from range(100) t(i))"),
    "yearly_sample": (
        yearly,
        "with r as (select o_orderkey, year(o_orderdate)::int as year, (o_orderstatus = 'P')::int as y, o_totalprice::double as score from orders), p as (select year, count(*) as p from r where y = 1 group by 1), h as (select r.*, p, row_number() over (partition by year order by score desc, o_orderkey) as k from r join p using (year) where y = 0),"
        " l as (select *, row_number() over (partition by year order by sha256('27:' || o_orderkey)) as j from h where k > floor(p * 3 / 2)) select o_orderkey, year, y from r where y = 1 union all select o_orderkey, year, y from h where k <= floor(p * 3 / 2) union all select o_orderkey, year, y from l where j <= p * 3 - floor(p * 3 / 2)",
    ),
    "unified_sources": (
        unified,
        "with n as (select doc_id, source, trim(regexp_replace(regexp_replace(lower(text), '[–—−]', '-', 'g'), '[^a-z0-9]+', ' ', 'g')) as k from documents), d as (select doc_id, source, case when source <> 'src3' then sha1(k) end as doi, nullif(substr(k, 1, 40), '') as title from n), a as (select * from d where source = 'src0'),"
        " b as (select * from d where source <> 'src0' and (doi is null or doi not in (select doi from a where doi is not null)) and (title is null or title not in (select title from a where title is not null))), u as (select doc_id, doi, title, 'a' as origin from a union all select doc_id, doi, title, 'b' from b),"
        " f as (select *, row_number() over (partition by doi order by origin, doc_id) as k from u), g as (select * from f where doi is null or k = 1), h as (select *, row_number() over (partition by title order by origin, doc_id) as j from g) select doc_id, origin from h where title is null or j = 1",
    ),
    "dense_ids": (dense, "with f as (select o_custkey, min(o_orderkey) as o from orders group by 1) select o_custkey, row_number() over (order by o, o_custkey) as dense_id from f"),
    "compared_rankings": (
        compared,
        WITH + ", a as (select u, v, papers as old from sums where layer = 'source' and papers >= 2), b as (select u, v, papers as new from sums where layer = 'target' and papers >= 2) select u, v, old, new, case when old is not null and new is not null then 'both' when old is not null then 'left_only' else 'right_only' end as side from a full join b using (u, v)",
    ),
    "alias_map": (aliases, "select distinct lower(trim(regexp_replace(upper(p_name) || '  ' || p_type, '\\s+', ' ', 'g'))) as alias, case when p_brand like 'Brand#2%' then substr(p_brand, 1, 7) || 'x' else p_brand end as concept from part"),
    "survival_by_support": (
        survival_by_support,
        WITH + ", tf as (select u, v, first_year as target_year from sums where layer = 'target'), " + ", ".join(
            f"sup{k} as (select u, v, year as support_year from src qualify row_number() over (partition by u, v order by year, paper_id) = {k}), ets{k} as (select (target_year is not null and target_year <= 2000)::int as event, (case when target_year is not null and target_year <= 2000 then target_year - support_year else 2000 - support_year end)::int as duration from sup{k} left join tf using (u, v) where support_year <= 2000 and (target_year is null or target_year > support_year))"
            + ", " + KM.strip().lstrip(",").strip().replace("kt as", f"kt{k} as").replace("kr as", f"kr{k} as").replace("km as", f"km{k} as").replace("from ets", f"from ets{k}").replace("from kt)", f"from kt{k})").replace("from kr)", f"from kr{k})")
            for k in (1, 2, 3)
        ) + " " + " union all ".join(f"select {k} as support, horizon::int as horizon, round(1 - coalesce(arg_max(survival, t), 1.0), 9) as incidence from (values (1), (3), (5)) h(horizon) left join km{k} on t <= horizon group by horizon" for k in (1, 2, 3)),
    ),
    "weight_search": (
        weight_search,
        K._FOLDS.rsplit(", folds as (", 1)[0] + ", rows_ as materialized (" + " union all ".join(f"select * from fx{c}" for c in K.CUTOFFS) + ")" + _SEARCH + ", al as materialized (" + " union all ".join(f"select * from w{i}" for i in range(PLAIN)) + "),"
        " tie as (select cutoff, choice, score, sum(y)::bigint as tp, count(*) as n from al group by all), cum as (select *, sum(tp) over w as ctp, sum(n) over w as cn from tie window w as (partition by cutoff, choice order by score desc rows unbounded preceding)), ap as (select cutoff, choice, coalesce(sum(tp * ctp / cn) / nullif(sum(tp), 0), 0) as ap from cum group by all),"
        " pl as (select cutoff, choice, y, row_number() over (partition by cutoff, choice order by score desc, u, v) as r from al), pk as (select cutoff, choice, avg(y) filter (r <= 10) as p10, avg(y) filter (r <= 25) as p25, avg(y) filter (r <= 50) as p50 from pl group by all),"
        " sc as (select *, 0.4::double * ap + 0.2::double * p10 + 0.2::double * p25 + 0.2::double * p50 as score from ap join pk using (cutoff, choice)) select choice, round(avg(ap), 9) as mean_ap, round(avg(p10), 9) as mean_p10, round(avg(p25), 9) as mean_p25, round(avg(p50), 9) as mean_p50, round(avg(score), 9) as mean_score, round(avg(score) - 0.1::double * stddev_pop(score), 9) as objective from sc group by 1",
    ),
    "weight_search_full": (weight_search_full, None),
    "metrics_by_distance": (
        by_distance,
        K.HEAD + K._frame_sql(K.SELF_CUTOFF, True) + f", sc as (select least(shortest_path, 4) as distance, label as y, round({K._SCORE}, 9) as score from fx{K.SELF_CUTOFF})" + K.auc_sql("distance", "sc"),
    ),
}
