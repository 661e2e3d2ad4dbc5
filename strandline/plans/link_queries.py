"""Link prediction over cutoffs: candidates, features, scores, backtests, risk sets and models' frames.

Papers of both layers count in each (inclusive membership); neighbourhoods are
those of the source graph, readiness those of the target graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as G
from ..operators import linkframe as L
from ..operators import metrics as M
from ..operators.scratch import Scratch
from .pair_queries import FACTS, facts, pct_sql
from . import settings as cfg
from .settings import CUTOFF, CUTOFFS, HORIZON, SELF_CUTOFF  # for the SQL

SOURCE, TARGET = ("source", "hybrid"), ("target", "hybrid")
MATERIALS, MECHANISMS = ("T1", "T2"), ("T3", "T4", "T5")
EXACT = ("jaccard", "adamic_adar", "resource_allocation", "semantic_similarity", "degree_balance", "frequency_balance", "trend_u", "trend_v")


class Tables:
    """Facts, pair histories and node states, each written once for all that follows."""

    def __init__(self, s: SparkSession, d: str, cutoffs: tuple[int, ...]):
        self.scratch, self.cutoffs = Scratch(s, "link"), cutoffs
        self.facts = self.scratch.save(facts(s, d), "facts")
        self.pairs = self.scratch.save(L.pair_years(self.facts, SOURCE, TARGET), "pairs")
        self.years = self.scratch.save(L.concept_years(self.facts, SOURCE, TARGET), "years")
        self.states = self.scratch.save(L.node_states(self.years, cutoffs), "states")

    def frame(self) -> DataFrame:
        pairs = L.transfer_candidates(self.pairs, self.states, self.cutoffs, cfg.HORIZON)
        return L.link_frame(pairs, L.cut_edges(self.pairs, self.cutoffs), self.states, G.label_vectors(self.facts), MATERIALS, MECHANISMS)


def transfer(s: SparkSession, d: str) -> DataFrame:
    t = Tables(s, d, cfg.CUTOFFS)
    return L.transfer_candidates(t.pairs, t.states, cfg.CUTOFFS, cfg.HORIZON)


def selves(s: SparkSession, d: str) -> DataFrame:
    t = Tables(s, d, (cfg.SELF_CUTOFF,))
    return L.self_candidates(t.pairs, t.states, (cfg.SELF_CUTOFF,), cfg.HORIZON)


def link_frame(s: SparkSession, d: str) -> DataFrame:
    out = Tables(s, d, (cfg.CUTOFF,)).frame()
    return out.withColumns({c: F.round(c, 9) for c in EXACT})


def scored(s: SparkSession, d: str, cutoffs: tuple[int, ...] | None = None) -> DataFrame:
    """The frame with its graph score, written once."""
    return Scratch(s, "scored").save(L.graph_score(Tables(s, d, cutoffs or (cfg.CUTOFF,)).frame()).withColumn("graph_score", F.round("graph_score", 9)), "rows")


def scored_self(s: SparkSession, d: str) -> DataFrame:
    """All unjoined pairs of frequent source concepts with path, component and graph score."""
    t = Tables(s, d, (cfg.SELF_CUTOFF,))
    pairs = L.self_candidates(t.pairs, t.states, t.cutoffs, cfg.HORIZON)
    frame = L.link_frame(pairs, L.cut_edges(t.pairs, t.cutoffs), t.states, G.label_vectors(t.facts), MATERIALS, MECHANISMS)
    return L.graph_score(frame).select("u", "v", "label", "common_neighbors", "shortest_path", "same_component", F.round("graph_score", 9).alias("graph_score"))


def score_rank(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).select("u", "v", "label", "shortest_path", "recent_frequency_sum", "semantic_similarity", "graph_score")


def folds(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d, cfg.CUTOFFS).select("cutoff", "u", "v", "u_type", "v_type", F.col("label").alias("y"), F.col("graph_score").alias("score"))


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 9) for c in columns})


def backtest(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.auc_ap(folds(s, d), ["cutoff"]), "auc", "ap", "lift")


def ranking_at_k(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.at_k(folds(s, d), ["cutoff"], [10, 25, 50], ["u", "v"]), "precision", "recall", "ndcg")


def kind_of(u: str, v: str) -> F.Column:
    """Layer of a pair by the kinds of its ends: material (M) or other (X)."""
    m = F.col(u).isin(*MATERIALS).cast("int") + F.col(v).isin(*MATERIALS).cast("int")
    return F.when(m == 2, "M-M").when(m == 1, "M-X").otherwise("X-X")


def layer_metrics(s: SparkSession, d: str) -> DataFrame:
    """AUC, AP and lift by cutoff and pair layer, and over all layers (rollup)."""
    rows = folds(s, d).withColumn("kind", F.explode(F.array(kind_of("u_type", "v_type"), F.lit("all"))))
    return rounded(M.auc_ap(rows, ["cutoff", "kind"]), "auc", "ap", "lift")


def stability(s: SparkSession, d: str) -> DataFrame:
    """Overlap of the first k by graph score and by common neighbours."""
    rows = scored(s, d).withColumn("pair", F.concat_ws("~", "u", "v"))
    return M.topk_overlap(M.first_rows(rows, "graph_score", "pair", 100), M.first_rows(rows, "common_neighbors", "pair", 100), [10, 25, 50, 100], "pair", "r").select("k", F.round("overlap", 9).alias("overlap"))


def risk_set(s: SparkSession, d: str) -> DataFrame:
    """Exclusive membership: papers of both layers prove nothing about a transfer."""
    scratch = Scratch(s, "risk")
    rows = scratch.save(facts(s, d), "facts")
    pairs = scratch.save(L.pair_years(rows, ("source",), ("target",)), "pairs")
    own = rows.where("layer = 'source'")
    papers = own.select("paper_id", "year", F.col("concept_id").alias("u")).join(own.select("paper_id", F.col("concept_id").alias("v")), "paper_id").where("u < v").groupBy("u", "v", "year").agg(F.count_distinct("paper_id").alias("n"))
    states = scratch.save(L.node_states(L.concept_years(rows, ("target",), ("source",)), cfg.CUTOFFS), "states")
    return rounded(L.risk_set(pairs, scratch.save(papers, "papers"), states, cfg.CUTOFFS), "readiness")


FACTS_IN = FACTS.split("\nev as")[0]


def _frame_sql(c: int, own: bool = False) -> str:
    """CTEs with suffix c that end in fx{c}: every candidate at cutoff c with all its features."""
    known = f"se{c}" if own else f"te{c}"
    base = f"select x.concept_id as u, y.concept_id as v from st{c} x join st{c} y on x.concept_id < y.concept_id where x.papers >= 2 and y.papers >= 2" if own else f"select u, v from se{c} where u in (select concept_id from st{c} where papers >= 2) and v in (select concept_id from st{c} where papers >= 2)"
    future = "src" if own else "tgt"
    return f""",
se{c} as materialized (select distinct u, v from src where year <= {c}), te{c} as (select distinct u, v from tgt where year <= {c}), fu{c} as (select distinct u, v from {future} where year between {c + 1} and {c + HORIZON}),
st{c} as materialized (select concept_id, concept_type, count(distinct case when layer <> 'target' then paper_id end) as papers, min(case when layer <> 'target' then year end) as first_year, count(distinct case when layer <> 'target' and year >= {c - 2} then paper_id end) as recent,
  count(distinct case when layer <> 'target' and year between {c - 5} and {c - 3} then paper_id end) as previous, count(distinct case when layer <> 'source' then paper_id end) as other_papers from facts where year <= {c} group by all),
cand{c} as materialized (select b.u, b.v, (f.u is not null)::int as label from ({base}) b left join fu{c} f on f.u = b.u and f.v = b.v where not exists (from {known} t where t.u = b.u and t.v = b.v)),
bw{c} as materialized (select u as a, v as b from se{c} union all select v, u from se{c}), dg{c} as (select a as node, count(*) as degree from bw{c} group by 1),
cm{c} as (select c.u, c.v, count(*) as cn, sum(1 / ln(greatest(2, d.degree))) as aa, sum(1 / greatest(1, d.degree)) as ra from cand{c} c join bw{c} x on x.a = c.u join bw{c} y on y.a = c.v and y.b = x.b join dg{c} d on d.node = x.b group by 1, 2),
fa{c} as materialized (select c.u, c.v, c.label, coalesce(cn, 0) as cn, coalesce(aa, 0) as aa, coalesce(ra, 0) as ra, coalesce(p.degree, 0) as du, coalesce(q.degree, 0) as dv, (j.u is not null) as joined
  from cand{c} c left join cm{c} m on m.u = c.u and m.v = c.v left join dg{c} p on p.node = c.u left join dg{c} q on q.node = c.v left join se{c} j on j.u = c.u and j.v = c.v),
hop{c}(s, x, d) as (select distinct u, u, 0 from fa{c} where cn = 0 and not joined union select s, b, d + 1 from hop{c} join bw{c} on a = x where d < 8), sd{c} as (select s, x, min(d) as d from hop{c} group by 1, 2),
lb{c} as (select distinct concept_id, lower(concept_id || ' | ' || concept_type) as l from facts), gm{c} as (select concept_id, gram, count(*) as x from (select concept_id, unnest(list_transform(range(1, length(l) - 1), lambda i: substr(l, i, 3))) as gram from lb{c}) group by 1, 2),
nm{c} as (select concept_id, sum(x * x)::double as q from gm{c} group by 1), dt{c} as (select f.u, f.v, sum(a.x * b.x)::double as dot from fa{c} f join gm{c} a on a.concept_id = f.u join gm{c} b on b.concept_id = f.v and a.gram = b.gram group by 1, 2),
fx{c} as materialized (select {c} as cutoff, f.u, f.v, label, a.concept_type as u_type, b.concept_type as v_type, du as degree_u, dv as degree_v, cn as common_neighbors, round(cn / greatest(1, du + dv - cn), 9) as jaccard, round(aa, 9) as adamic_adar, round(ra, 9) as resource_allocation,
  du * dv as preferential_attachment, round(least(du, dv) / greatest(1, greatest(du, dv)), 9) as degree_balance, (case when joined then 1 when cn > 0 then 2 else coalesce(sd.d, 9) end)::int as shortest_path, (joined or cn > 0 or sd.d is not null)::int as same_component,
  round(coalesce(dot / sqrt(nu.q * nv.q), 0), 9) as semantic_similarity, least(du, dv) as degree_min, greatest(du, dv) as degree_max, a.papers as document_frequency_u, b.papers as document_frequency_v, least(a.papers, b.papers) as frequency_min, greatest(a.papers, b.papers) as frequency_max,
  round(least(a.papers, b.papers) / greatest(1, greatest(a.papers, b.papers)), 9) as frequency_balance, a.recent as recent_frequency_u, b.recent as recent_frequency_v, a.recent + b.recent as recent_frequency_sum, round((a.recent - a.previous) / 3, 9) as trend_u, round((b.recent - b.previous) / 3, 9) as trend_v,
  ({c} - a.first_year)::int as age_u, ({c} - b.first_year)::int as age_v, (a.concept_type = b.concept_type)::int as same_type, (a.concept_type in ('T1', 'T2') and b.concept_type in ('T1', 'T2'))::int as material_material_pair,
  ((a.concept_type in ('T1', 'T2') and b.concept_type in ('T3', 'T4', 'T5')) or (b.concept_type in ('T1', 'T2') and a.concept_type in ('T3', 'T4', 'T5')))::int as material_mechanism_pair, (a.concept_type in ('T3', 'T4', 'T5') and b.concept_type in ('T3', 'T4', 'T5'))::int as mechanism_mechanism_pair,
  a.other_papers as target_frequency_u, b.other_papers as target_frequency_v, a.other_papers + b.other_papers as target_frequency_sum, (a.other_papers > 0 and b.other_papers > 0)::int as target_both_seen
  from fa{c} f join st{c} a on a.concept_id = f.u join st{c} b on b.concept_id = f.v left join sd{c} sd on sd.s = f.u and sd.x = f.v left join dt{c} dt on dt.u = f.u and dt.v = f.v left join nm{c} nu on nu.concept_id = f.u left join nm{c} nv on nv.concept_id = f.v)"""


HEAD = "with recursive " + FACTS_IN + """
inc as materialized (select a.concept_id as u, b.concept_id as v, a.year, a.layer from facts a join facts b on a.paper_id = b.paper_id and a.concept_id < b.concept_id),
src as (select * from inc where layer <> 'target'), tgt as (select * from inc where layer <> 'source')"""
_PLAIN = HEAD.replace("with recursive", "with")
#: The seven weights of the graph score, written out again for the SQL.
_SCORE = " + ".join(f"{w} * {pct_sql(x, 'cutoff')}" for w, x in ((0.24, "adamic_adar"), (0.18, "common_neighbors"), (0.12, "jaccard"), (0.12, "preferential_attachment"), (0.12, "(-shortest_path)"), (0.12, "semantic_similarity"), (0.1, "recent_frequency_sum")))
_FOLDS = HEAD + "".join(_frame_sql(c) for c in CUTOFFS) + ", folds as (select cutoff, u, v, u_type, v_type, label as y, round(" + _SCORE + ", 9) as score from (" + " union all ".join(f"select * from fx{c}" for c in CUTOFFS) + "))"


def auc_sql(by: str, source: str) -> str:
    return f""", tie as (select {by}, score, sum(y)::bigint as tp, count(*) as n from {source} group by all),
cum as (select *, sum(tp) over w as ctp, sum(n) over w as cn from tie window w as (partition by {by} order by score desc rows unbounded preceding))
select {by}, sum(tp)::bigint as positives, sum(n)::bigint as rows, round(case when sum(tp) > 0 and sum(n - tp) > 0 then sum((n - tp) * (ctp - tp / 2)) / (sum(tp) * sum(n - tp)) end, 9) as auc,
  round(sum(tp * ctp / cn) / sum(tp), 9) as ap, round(sum(tp * ctp / cn) / sum(tp) / (sum(tp) / sum(n)), 9) as lift from cum group by all"""


def _risk_sql() -> str:
    parts = "".join(
        f""",
tn{c} as (select concept_id, count(distinct paper_id) as n from facts where layer = 'target' and year <= {c} group by 1), te{c} as (select distinct u, v from tx where year <= {c}), bw{c} as (select u as a, v as b from te{c} union all select v, u from te{c}), dg{c} as (select a as node, count(*) as degree from bw{c} group by 1),
g{c} as (select u, v, count(distinct paper_id) as source_papers, count(distinct case when year > {c} - 3 then paper_id end) as recent_papers from sx where year <= {c} group by 1, 2),
k{c} as (select g.*, least(p.n, q.n) as target_frequency_min from g{c} g join tn{c} p on p.concept_id = g.u join tn{c} q on q.concept_id = g.v where not exists (from te{c} t where t.u = g.u and t.v = g.v)),
cm{c} as (select k.u, k.v, count(*) as cn from k{c} k join bw{c} x on x.a = k.u join bw{c} y on y.a = k.v and y.b = x.b group by 1, 2),
r{c} as (select {c} as cutoff, k.*, coalesce(cn, 0) as target_common_neighbors, round(coalesce(cn, 0) / greatest(1, coalesce(p.degree, 0) + coalesce(q.degree, 0) - coalesce(cn, 0)), 9) as target_jaccard,
  (exists (from tx t where t.year = {c + 1} and t.u = k.u and t.v = k.v))::int as next_year from k{c} k left join cm{c} m on m.u = k.u and m.v = k.v left join dg{c} p on p.node = k.u left join dg{c} q on q.node = k.v)"""
        for c in CUTOFFS
    )
    ranks = " + ".join(pct_sql(x, "cutoff") for x in ("source_papers", "recent_papers", "target_frequency_min", "target_common_neighbors", "target_jaccard"))
    pairs = "px as materialized (select a.concept_id as u, b.concept_id as v, a.year, a.paper_id, a.layer from facts a join facts b on a.paper_id = b.paper_id and a.concept_id < b.concept_id), sx as (select * from px where layer = 'source'), tx as (select * from px where layer = 'target')"
    return "with " + FACTS_IN + pairs + parts + ", r as (" + " union all by name ".join(f"select * from r{c}" for c in CUTOFFS) + f") select *, round(({ranks}) / 5, 9) as readiness from r"


def policies(s: SparkSession, d: str) -> DataFrame:
    """Candidates under each policy at two cutoffs, over exclusive source papers of finished years."""
    t = Tables(s, d, (1995, cfg.SELF_CUTOFF))
    out = None
    for name in ("frontier", "near", "broad"):
        one = L.policy_candidates(t.pairs, t.states, t.cutoffs, name).select(F.lit(name).alias("policy"), "cutoff", "u", "v")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("policy", "cutoff", F.substring("u", 1, 8).alias("brand")).agg(F.count("*").alias("pairs"))


def donors(s: SparkSession, d: str) -> DataFrame:
    """Source concepts that the target lacks by 1995 beside similar ones that it has, by the trigrams of their names."""
    from ..operators import retrieval as R

    t = Tables(s, d, (1995,))
    names = t.facts.select("concept_id").distinct()
    similar = R.gram_neighbours(R.gram_weights(names, "concept_id", "concept_id", 1.0), "concept_id", 0.3, 1_000_000)
    out = L.donor_anchor(t.states, similar, (1995,), 0.3, MATERIALS, MECHANISMS + MATERIALS)
    return out.select("cutoff", "donor", "anchor", F.round("cosine", 6).alias("cosine"))


def _policy_sql(c: int) -> str:
    known = f"st{c} x join st{c} y on x.concept_id < y.concept_id where x.papers >= 2 and y.papers >= 2 and (x.concept_id, y.concept_id) not in (select (u, v) from se{c})"
    return f""" select 'broad' as policy, {c} as cutoff, x.concept_id as u from {known} union all select 'frontier', {c}, x.concept_id from {known} and (x.first_year > {c} - 3 or y.first_year > {c} - 3)
union all select 'near', {c}, u from (select distinct a as u, v from (select p.a, q.b as v from bw{c} p join bw{c} q on p.b = q.a union select p.a, r.b from bw{c} p join bw{c} q on p.b = q.a join bw{c} r on q.b = r.a)) n where u < v and u in (select concept_id from st{c} where papers >= 2) and v in (select concept_id from st{c} where papers >= 2) and (u, v) not in (select (u, v) from se{c})"""


QUERIES = {
    "candidate_policies": (policies, HEAD + _frame_sql(1995, True) + _frame_sql(SELF_CUTOFF, True) + ", al as (" + " union all ".join(f"select * from ({_policy_sql(c)})" for c in (1995, SELF_CUTOFF)) + ") select policy, cutoff, substr(u, 1, 8) as brand, count(*) as pairs from al group by all"),
    "donor_anchors": (
        donors,
        HEAD + _frame_sql(1995) + """, nm as (select distinct concept_id as k from facts), g as (select distinct k, unnest(list_concat(list_transform(range(1, greatest(length(k) + 1, 1)), lambda i: substr('^' || k || '$', i, 3)), list_transform(range(1, greatest(length(k), 1)), lambda i: substr('^' || k || '$', i, 4)))) as gram from nm),
df as (select gram, ln((1 + n) / (1 + count(*))) + 1 as idf from g, (select count(*) as n from nm) group by gram, n), w0 as (select k, gram, idf from g join df using (gram)), nn as (select k, sqrt(sum(idf * idf)) as norm from w0 group by 1), w as (select k, gram, idf / norm as w from w0 join nn using (k)), cg as (select x.k as a, y.k as b, sum(x.w * y.w) as cosine from w x join w y on x.gram = y.gram and x.k <> y.k group by all having round(sum(x.w * y.w), 12) >= 0.3)
select 1995 as cutoff, a as donor, b as anchor, round(cosine, 6) as cosine from cg join st1995 x on x.concept_id = a join st1995 y on y.concept_id = b where x.concept_type in ('T1', 'T2') and x.papers > 0 and x.other_papers = 0 and y.concept_type in ('T1', 'T2', 'T3', 'T4', 'T5') and y.other_papers > 0""",
    ),
    "link_candidates_transfer": (transfer, HEAD + "".join(_frame_sql(c) for c in CUTOFFS) + " " + " union all ".join(f"select {c} as cutoff, * from cand{c}" for c in CUTOFFS)),
    "link_candidates_self": (selves, HEAD + _frame_sql(SELF_CUTOFF, True) + f" select {SELF_CUTOFF} as cutoff, * from cand{SELF_CUTOFF}"),
    "graph_features": (link_frame, HEAD + _frame_sql(CUTOFF) + f" select * from fx{CUTOFF}"),
    "graph_score_rank": (score_rank, HEAD + _frame_sql(CUTOFF) + f" select u, v, label, shortest_path, recent_frequency_sum, semantic_similarity, round({_SCORE}, 9) as graph_score from fx{CUTOFF}"),
    "graph_score_self": (scored_self, HEAD + _frame_sql(SELF_CUTOFF, True) + f" select u, v, label, common_neighbors, shortest_path, same_component, round({_SCORE}, 9) as graph_score from fx{SELF_CUTOFF}"),
    "rolling_backtest_metrics": (backtest, _FOLDS + auc_sql("cutoff", "folds")),
    "ranking_at_k": (
        ranking_at_k,
        _FOLDS + """, o as (select *, row_number() over (partition by cutoff order by score desc, u, v) as r from folds), tot as (select cutoff, sum(y)::bigint as positives, count(*) as rows from folds group by 1),
g as (select cutoff, k::int as k, sum(y)::bigint as hits, sum(y / log2(r + 1)) as dcg from o join (values (10), (25), (50)) x(k) on r <= k group by all)
select cutoff, k, hits, case when rows >= k then hits / k end as precision, round(hits / positives, 9) as recall, round(dcg / (select sum(1 / log2(i + 1)) from range(1, greatest(least(k, positives), 1) + 1) t(i)), 9) as ndcg from g join tot using (cutoff)""",
    ),
    "layer_metrics": (layer_metrics, _FOLDS + ", kinds as (select cutoff, y, score, unnest([case (u_type in ('T1', 'T2'))::int + (v_type in ('T1', 'T2'))::int when 2 then 'M-M' when 1 then 'M-X' else 'X-X' end, 'all']) as kind from folds)" + auc_sql("cutoff, kind", "kinds")),
    "topk_stability": (
        stability,
        HEAD + _frame_sql(CUTOFF) + f""", sc as (select u || '~' || v as pair, common_neighbors as cn, round({_SCORE}, 9) as score from fx{CUTOFF}), rk as (select pair, row_number() over (order by score desc, pair) as ra, row_number() over (order by cn desc, pair) as rb from sc)
select k::int as k, round(count(pair) / k, 9) as overlap from (values (10), (25), (50), (100)) x(k) left join rk on ra <= k and rb <= k group by k""",
    ),
    "annual_risk_set": (risk_set, _risk_sql()),
}
