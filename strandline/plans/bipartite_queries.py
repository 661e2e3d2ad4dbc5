"""Queries of two-sided snapshots: orders as papers, clerks' brands as levers, customer segments by nation as targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bipartite as B
from ..operators import metrics as M
from ..operators.scratch import Scratch
from ..session import table
from . import link_queries as K
from . import settings as cfg
from .settings import CUTOFF  # for the SQL



class Snapshot:
    """Levers are brands in cheap lines of urgent orders; a target (segment and nation) takes one up in an expensive line of a finished order."""

    def __init__(self, s: SparkSession, d: str):
        self.scratch = Scratch(s, "sides")
        lines = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        rows = lines.select(F.col("p_brand").alias("lever"), F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("target"), F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year"), "o_orderpriority", "l_quantity", F.col("p_type").alias("context"))
        rows = self.scratch.save(rows, "rows")
        self.sources = rows.where("o_orderpriority in ('1-URGENT', '2-HIGH') and l_quantity < 12").select("lever", "paper", "year")
        took = rows.where("o_orderpriority = '5-LOW' and l_quantity >= 48")
        self.adoptions = self.scratch.save(took.select("lever", "target", "year", "context", "paper"), "adoptions")
        self.papers = rows.where("o_orderpriority in ('4-NOT SPECIFIED', '5-LOW')").select("target", "paper", "year").distinct()

    def rows(self) -> DataFrame:
        grid = self.scratch.save(B.snapshot(self.sources, self.adoptions, self.papers, cfg.CUTOFF, cfg.FREEZE), "grid")
        extra = B.bridges(grid, self.adoptions, self.adoptions, self.adoptions, self.adoptions, cfg.CUTOFF)
        return self.scratch.save(grid.join(extra, ["lever", "target"]), "rows2")

    def scored(self) -> DataFrame:
        scores = {"popularity_baseline": B.POPULARITY, "fixed_graph_heuristic": B.FIXED, "degree_recency_baseline": B.DEGREE_RECENCY, "fixed_graph": B.BRIDGED}
        out = B.rank01_scores(self.rows(), ["lever", "target"], scores)
        return self.scratch.save(out.withColumns({c: F.round(c, 9) for c in scores}), "scored")


def snapshot(s: SparkSession, d: str) -> DataFrame:
    return Snapshot(s, d).scored()


def backtest(s: SparkSession, d: str) -> DataFrame:
    """AUC, AP and lift of each score on the next year's first adoptions."""
    rows = Snapshot(s, d).scored()
    names = ["popularity_baseline", "fixed_graph_heuristic", "degree_recency_baseline", "fixed_graph"]
    long = rows.select("lever", "target", F.col("label").alias("y"), *names).unpivot(["lever", "target", "y"], names, "model", "score")
    return K.rounded(M.auc_ap(long, ["model"]), "auc", "ap", "lift")


TIERS = ((50, "A"), (200, "B"))


def forecasts(s: SparkSession, d: str) -> DataFrame:
    return B.forecast(Snapshot(s, d).scored(), "fixed_graph", TIERS).select("lever", "target", "place", "tier", "within_target")


def states(s: SparkSession, d: str) -> DataFrame:
    snap = Snapshot(s, d)
    ranked = B.forecast(snap.scored(), "fixed_graph", TIERS)
    levers = snap.sources.where(F.col("year") <= cfg.CUTOFF).groupBy("lever").agg(F.count_distinct("paper").alias("lever_papers"))
    targets = snap.papers.where(F.col("year") <= cfg.CUTOFF).groupBy("target").agg(F.count_distinct("paper").alias("target_papers"))
    first = snap.adoptions.groupBy("lever", "target").agg(F.min("year").alias("first_year"))
    return B.state_matrix(levers, targets, first, ranked, cfg.CUTOFF, 3)


def block_weights(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey")
    return B.block_weights(rows, ["o_custkey"]).select("o_orderkey", F.round("w", 9).alias("w"))


def square(s: SparkSession, d: str) -> DataFrame:
    return B.square_matrix(K.scored(s, d), "graph_score", 200, 12)


def subgraph(s: SparkSession, d: str) -> DataFrame:
    return B.subgraph(K.scored(s, d), "graph_score", 40, 25)


def typed(s: SparkSession, d: str) -> DataFrame:
    return B.typed_rows(K.scored(s, d).select("u", "v", "u_type", "v_type", "label", "graph_score"), "u_type", "v_type", K.MATERIALS, K.MECHANISMS)


def per_layer(s: SparkSession, d: str) -> DataFrame:
    rows = K.scored(s, d).select("u", "v", F.col("label").alias("y"), "graph_score", K.kind_of("u_type", "v_type").alias("layer"))
    return B.best_per_layer(rows, "layer", "graph_score", ["u", "v"], 25).select("layer", "y", "u", "v", "graph_score", F.col("place").cast("long").alias("place"))


def tiles(s: SparkSession, d: str) -> DataFrame:
    """Vectors by their first two coordinates; the norm stands for a density."""
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")), 6).alias("density"))
    return B.tile_tops(v, "x", "y", "density", 0.5, "vec_id")


_R01 = "case when count(*) over () <= 1 then 0 else (rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0 - 1) / (count(*) over () - 1) end"


def _score(terms: tuple[tuple[float, str], ...]) -> str:
    return "round(" + " + ".join(f"{w}::double * {_R01.format(c)}" for w, c in terms) + ", 9)"


SNAP = f"""with recursive rw as materialized (select p_brand as lever, c_mktsegment || '|' || c_nationkey as target, o_orderkey as paper, year(o_orderdate)::int as year, o_orderpriority as pr, l_quantity as q, p_type as context from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
so as (select lever, paper, year from rw where pr in ('1-URGENT', '2-HIGH') and q < 12), ad as materialized (select lever, target, year, context, paper from rw where pr = '5-LOW' and q >= 48), pp as (select distinct target, paper, year from rw where pr in ('4-NOT SPECIFIED', '5-LOW')),
hs as (select * from so where year <= {CUTOFF}), tk as (select lever, target, min(year) as first_year from ad group by all),
lv as (select lever, count(distinct paper) as lever_papers, count(distinct paper) filter (year >= {CUTOFF - 2}) as lr, count(distinct paper) filter (year between {CUTOFF - 5} and {CUTOFF - 3}) as lp from hs group by 1),
tg as (select target, count(distinct paper) as target_papers, count(distinct paper) filter (year >= {CUTOFF - 2}) as tr, count(distinct paper) filter (year between {CUTOFF - 5} and {CUTOFF - 3}) as tp from pp where year <= {CUTOFF} group by 1),
gd as materialized (select lever, target, first_year, lever_papers, lr, lp, target_papers, tr, tp from lv cross join tg left join tk using (lever, target) where first_year is null or first_year > {CUTOFF}),
gr as (select distinct 'lever:' || a.lever as u, 'lever:' || b.lever as v from hs a join hs b on a.paper = b.paper and a.lever < b.lever union all select 'lever:' || lever, 'target:' || target from tk where first_year <= {CUTOFF}),
bw as materialized (select u as a, v as b from gr union all select v, u from gr), dg as (select a, count(*) as degree, count(*) filter (b like 'lever:%') as levers, count(*) filter (b like 'target:%') as targets from bw group by 1),
cm as (select lever, target, count(*) as cn, sum(1 / ln(greatest(2, degree))) as aa, sum(1 / greatest(1, degree)) as ra from gd join bw x on x.a = 'lever:' || lever join bw y on y.a = 'target:' || target and y.b = x.b join dg on dg.a = x.b group by all),
hop(s, x, d) as (select distinct 'lever:' || lever, 'lever:' || lever, 0 from gd union select s, b, d + 1 from hop join bw on a = x where d < 8), sd as (select s, x, min(d) as d from hop group by 1, 2),
f0 as (select g.*, coalesce(cn, 0) as cn, coalesce(aa, 0) as aa, coalesce(ra, 0) as ra, coalesce(d, 9) as d, coalesce(p.degree, 0) as ld, coalesce(q.degree, 0) as td, coalesce(p.levers, 0) as ll, coalesce(p.targets, 0) as lt, coalesce(q.levers, 0) as tl
  from gd g left join cm using (lever, target) left join dg p on p.a = 'lever:' || lever left join dg q on q.a = 'target:' || target left join sd on sd.s = 'lever:' || lever and sd.x = 'target:' || target),
pa as (select distinct lever, target from ad where year <= {CUTOFF}), dl as (select distinct lever as i, paper from ad where year <= {CUTOFF}), dt as (select distinct target as i, paper from ad where year <= {CUTOFF}),
nl as (select i, count(*) as n from dl group by 1), nt as (select i, count(*) as n from dt group by 1),
wl as (select x.i, x.j, k / sqrt(greatest(1, a.n * b.n)) as w from (select x.i, y.i as j, count(*) as k from dl x join dl y on x.paper = y.paper and x.i <> y.i group by all) x join nl a on a.i = x.i join nl b on b.i = x.j),
wt as (select x.i, x.j, k / sqrt(greatest(1, a.n * b.n)) as w from (select x.i, y.i as j, count(*) as k from dt x join dt y on x.paper = y.paper and x.i <> y.i group by all) x join nt a on a.i = x.i join nt b on b.i = x.j),
bl as (select g.lever, g.target, sum(w) as s from gd g join pa on pa.target = g.target join wl on wl.i = g.lever and wl.j = pa.lever group by all), bb as (select g.lever, g.target, sum(w) as s from gd g join pa on pa.lever = g.lever join wt on wt.i = g.target and wt.j = pa.target group by all),
cx as (select g.lever, g.target, count(*) as s from gd g join (select distinct lever, context from ad where year <= {CUTOFF}) x on x.lever = g.lever join (select distinct target, context from ad where year <= {CUTOFF}) y on y.target = g.target and x.context = y.context group by all),
rows_ as materialized (select f.lever, f.target, coalesce(first_year = {CUTOFF + 1}, false)::int as label, cn as common_neighbors, round(aa, 9) as adamic_adar, round(ra, 9) as resource_allocation, round(cn / greatest(1, ld + td - cn), 9) as jaccard, round(ln(1 + ld * td), 9) as preferential_attachment_log, d::int as shortest_path, round(1 / (1 + d), 9) as inverse_path,
  round(cn / greatest(1, ll), 9) as neighbor_fraction, lt as lever_target_degree, tl as target_lever_degree, round(ln(1 + lt * tl), 9) as side_attachment_log, lever_papers, target_papers, round((lr - lp) / 3, 9) as lever_growth, round((tr - tp) / 3, 9) as target_growth,
  round(ln(1 + lr), 9) as lever_recent_log, round(ln(1 + lever_papers), 9) as lever_papers_log, round(ln(1 + tr), 9) as target_recent_log, round(ln(1 + target_papers), 9) as target_papers_log, round(coalesce(bl.s, 0), 9) as ll_bridge, round(coalesce(bb.s, 0), 9) as bb_bridge, coalesce(cx.s, 0) as context_bridge
  from f0 f left join bl on bl.lever = f.lever and bl.target = f.target left join bb on bb.lever = f.lever and bb.target = f.target left join cx on cx.lever = f.lever and cx.target = f.target),
sc as materialized (select *,
  {_score(((0.45, "preferential_attachment_log"), (0.25, "lever_recent_log"), (0.20, "target_recent_log"), (0.10, "lever_papers_log")))} as popularity_baseline,
  {_score(((0.22, "resource_allocation"), (0.16, "adamic_adar"), (0.14, "common_neighbors"), (0.10, "jaccard"), (0.10, "inverse_path"), (0.08, "neighbor_fraction"), (0.08, "lever_recent_log"), (0.05, "lever_papers_log"), (0.04, "target_recent_log"), (0.03, "preferential_attachment_log")))} as fixed_graph_heuristic,
  {_score(((0.40, "side_attachment_log"), (0.20, "lever_recent_log"), (0.20, "target_recent_log"), (0.10, "lever_papers_log"), (0.10, "target_papers_log")))} as degree_recency_baseline,
  {_score(((0.30, "ll_bridge"), (0.22, "bb_bridge"), (0.14, "context_bridge"), (0.12, "inverse_path"), (0.08, "lever_recent_log"), (0.06, "target_recent_log"), (0.05, "lever_papers_log"), (0.03, "side_attachment_log")))} as fixed_graph from rows_)"""
FORECAST = f""", fc as (select lever, target, row_number() over (order by fixed_graph desc, lever, target) as place, round(case when count(*) over (partition by target) <= 1 then 0 else (rank() over (partition by target order by fixed_graph) + (count(*) over (partition by target, fixed_graph) - 1) / 2.0 - 1) / (count(*) over (partition by target) - 1) end, 9) as within_target from sc)"""
_LINKS = K.HEAD + K._frame_sql(K.CUTOFF) + f", gs as materialized (select u, v, u_type, v_type, label, round({K._SCORE}, 9) as graph_score from fx{K.CUTOFF})"

QUERIES = {
    "bipartite_snapshot": (snapshot, SNAP + " select * from sc"),
    "bipartite_backtest": (backtest, SNAP + ", lg as (select unnest(['popularity_baseline', 'fixed_graph_heuristic', 'degree_recency_baseline', 'fixed_graph']) as model, unnest([popularity_baseline, fixed_graph_heuristic, degree_recency_baseline, fixed_graph]) as score, label as y from sc)" + K.auc_sql("model", "lg")),
    "bipartite_forecast": (forecasts, SNAP + FORECAST + " select lever, target, place, case when place <= 50 then 'A' when place <= 200 then 'B' else 'rest' end as tier, within_target from fc"),
    "matrix_long": (
        states,
        SNAP + FORECAST + f""", st as (select lever, target, case when first_year <= {CUTOFF} then 'observed' when lever_papers < 3 or target_papers < 3 then 'insufficient' else 'forecast' end as state, first_year, place from lv cross join tg left join tk using (lever, target) left join fc using (lever, target))
select lever, target, state, case when state = 'observed' then first_year end as first_year, case when state = 'forecast' then place end as place from st""",
    ),
    "block_weights": (block_weights, "with n as (select o_custkey, count(*) as n from orders group by 1) select o_orderkey, round((select count(*) from orders) / ((select count(*) from n) * n), 9) as w from orders join n using (o_custkey)"),
    "square_matrix": (
        square,
        _LINKS + ", b as (select * from gs order by graph_score desc, u, v limit 200), nd as (select node from (select unnest([u, v]) as node from b) group by 1 order by count(*) desc, node limit 12), bo as (select u as row, v as col, graph_score from b union all select v, u, graph_score from b) select x.node as row, y.node as col, coalesce(graph_score, 0) as graph_score from nd x cross join nd y left join bo on bo.row = x.node and bo.col = y.node",
    ),
    "select_subgraph": (
        subgraph,
        _LINKS + ", f as (select * from gs order by graph_score desc, u, v limit 120), h as (select node from (select unnest([u, v]) as node, graph_score as s from f) group by 1 order by round(sum(s), 9) desc, node limit 25) select u, v, graph_score from f where u in (select node from h) and v in (select node from h) order by graph_score desc, u, v limit 40",
    ),
    "typed_orientation": (
        typed,
        _LINKS + ", k as (select *, u_type in ('T1', 'T2') and v_type in ('T3', 'T4', 'T5') as s, v_type in ('T1', 'T2') and u_type in ('T3', 'T4', 'T5') as t from gs) select case when s then u else v end as \"left\", case when s then v else u end as \"right\", label, graph_score from k where s or t",
    ),
    "best_per_layer": (
        per_layer,
        _LINKS + ", k as (select u, v, label as y, graph_score, case (u_type in ('T1', 'T2'))::int + (v_type in ('T1', 'T2'))::int when 2 then 'M-M' when 1 then 'M-X' else 'X-X' end as layer from gs) select layer, y, u, v, graph_score, row_number() over (partition by layer, y order by graph_score desc, u, v) as place from k qualify place <= 25",
    ),
    "tile_tops": (
        tiles,
        "with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, round(list_dot_product(embedding::double[], embedding::double[]), 6) as density from embeddings), l as (select min(x) as lx, min(y) as ly from p), t as (select vec_id, density, floor((x - lx) / 0.5)::bigint as tile_x, floor((y - ly) / 0.5)::bigint as tile_y from p, l) select * from t qualify row_number() over (partition by tile_x, tile_y order by density desc, vec_id) = 1",
    ),
}
