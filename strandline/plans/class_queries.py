"""Queries of classifiers over documents and parts, and of typed graphs, communities and themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions.text import first_rule, rewrite
from ..operators import communities as C
from ..operators import linkframe as L
from ..operators import pairs as P
from ..operators import retrieval as R
from ..operators import summaries as S
from ..operators import vectors as N
from ..operators import workflow as W
from ..operators.scratch import Scratch
from ..session import table
from .pair_queries import WITH, evidence, facts, parts

CUES = {"secret": "password|secret|token", "address": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]", "loud": "!!", "long": "(?s).{2000,}", "lines": "\n"}
CASCADE = ((("secret", "address"), (), "private"), (("secret",), ("loud",), "guarded"), (("long", "lines"), (), "prose"), (("loud",), (), "noise"))


def document_classes(s: SparkSession, d: str) -> DataFrame:
    """Scope, tier, weight, points, families, snippets and claims of every document."""
    t = table(s, d, "documents")
    text = F.col("text")
    scope = K.scope(text, CUES, CASCADE, "other")
    review = F.coalesce(text.rlike("[Rr]eview|[Oo]verview"), F.lit(False))
    tier = K.evidence_tier(review, F.coalesce(text.rlike("license|License"), F.lit(False)), scope, F.col("n_chars") > 1000, {"coupled": "private", "core": "prose", "adjacent": "guarded", "cross": "noise"})
    names, primary = K.families(text, ((r"[0-9]{4}", "numbers"), ("https?://", "links"), ("!!", "shouts")))
    weight = K.evidence_weight(tier, F.col("lang"), F.coalesce(text.rlike("token"), F.lit(False)), {"A_direct_evidence_ready": 1.0, "B_direct_needs_evidence_repair": 0.75, "R_review": 0.2}, {"en": 1.0, "de": 0.8})
    quality = K.points([(F.col("n_chars") > 300, 2), (text.rlike("[0-9]"), 1), (text.contains("\n"), 2), (F.col("lang") == "en", 1)])
    return t.select(
        "doc_id", scope.alias("scope"), tier.alias("tier"), F.round(weight, 6).alias("weight"), quality.alias("points"), F.array_join(names, ";").alias("families"), primary.alias("family"),
        F.array_join(K.matched_fields("1", text=text, source=F.col("source"), lang=F.col("lang")), ";").alias("fields"), K.first_evidence("[0-9]+", F.col("source"), text).alias("evidence"),
        K.caveat(F.col("lang"), {"fr": "translated"}, text, (("token", "has tokens"), ("!!", "shouted"))).alias("caveat"), F.md5(K.snippet(text, "[0-9]{3,}", 30, 20)).alias("snippet"), F.size(K.split_claims(text)).alias("claims"),
    )


RULES = (("^(small|large) ", "sized", "size"), ("(steel|tin)$", "metal", "material"), ("blue|red", "coloured", "colour"))


def part_classes(s: SparkSession, d: str) -> DataFrame:
    """Layers, canonical names, phrase tests, rewrites and grades of every part."""
    name, kind = K.canonical(F.col("p_name"), F.col("p_type"), RULES)
    code = K.layer_code(F.substring("p_brand", 7, 1), {"1": "M", "2": "S", "3": "P"})
    other = K.layer_code(F.substring("p_brand", 8, 1), {"1": "M", "2": "S", "3": "P"})
    grade = F.when(F.col("p_size") > 30, "R2_dual_direct_sentence_relations").when(F.col("p_size") > 10, "G1_single_strict_syntax_candidate").otherwise("odd")
    space = F.when(F.col("p_size") % 2 == 0, "R_review").otherwise("G_machine")
    return table(s, d, "part").select(
        "p_partkey", name.alias("name"), kind.alias("kind"), K.layer_pair(code, other, ("M", "S", "P", "O")).alias("layers"), K.role_pair(F.col("p_type"), F.col("p_brand")).alias("roles"), K.grade_class(grade).alias("grade"), K.grade_order(grade, space).alias("grade_order"),
        K.good_phrase(F.col("p_name"), (2, 3), (6, 40), ("blue", "red"), "e").alias("good"), rewrite(F.col("p_name"), (("a", "4"), ("e+", "3"))).alias("rewritten"), first_rule("p_name", (("steel", "hard"), ("small", "small")), "plain").alias("subtype"),
        K.family_match(F.col("p_name"), F.col("p_type"), F.col("p_brand"), {"Brand#11": "a", "Brand#12": "z"}, "Brand#13").alias("family"), K.term_present(F.lower("p_name"), F.lower(F.substring("p_type", 1, 3))).alias("present"), K.short_label(F.col("p_name"), 8).alias("short"),
    )


KINDS = ("ordered", "supplied", "sold")


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A typed graph of customers, parts' brands and suppliers."""
    li = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).where("l_quantity >= 30")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    one = F.lit(1.0).alias("weight")
    edges = C.union_graph([
        li.select(node("customer", "o_custkey").alias("src"), node("brand", "p_brand").alias("dst"), F.lit("ordered").alias("kind"), one),
        li.select(node("supplier", "l_suppkey").alias("src"), node("brand", "p_brand").alias("dst"), F.lit("supplied").alias("kind"), one),
        li.where("l_quantity >= 45").select(node("supplier", "l_suppkey").alias("src"), node("customer", "o_custkey").alias("dst"), F.lit("sold").alias("kind"), one),
    ])
    edges = Scratch(s, "graph").save(edges, "edges")
    nodes = table(s, d, "customer").select(node("customer", "c_custkey").alias("node"), F.lit("customer").alias("type")).unionByName(table(s, d, "part").select(node("brand", "p_brand").alias("node"), F.lit("brand").alias("type")).distinct())
    return nodes, edges


def typed_degrees(s: SparkSession, d: str) -> DataFrame:
    return C.typed_degrees(_graph(s, d)[1], KINDS)


def graph_audit(s: SparkSession, d: str) -> DataFrame:
    """Suppliers are no nodes, so their ends dangle."""
    return W.checks(C.graph_audit(*_graph(s, d), KINDS[:2]))


def layered(s: SparkSession, d: str) -> DataFrame:
    """The graph with a layer of nations: how many nodes and edges of each kind."""
    nodes, edges = _graph(s, d)
    extra = table(s, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("dst"), F.when(F.col("s_acctbal") > 0, "rich").otherwise("poor").alias("relation"))
    n, e = C.add_layer(nodes, edges, extra, {"rich": "located"}, "based")
    return n.groupBy(F.concat(F.lit("node:"), "type").alias("what")).agg(F.count("*").alias("n")).unionByName(e.groupBy(F.concat(F.lit("edge:"), "kind").alias("what")).agg(F.count("*").alias("n")))


def paths(s: SparkSession, d: str) -> DataFrame:
    ev = table(s, d, "lineitem").where("l_quantity >= 48").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("program"), "l_returnflag")
    programs = table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("program"), F.col("p_type").alias("target"))
    return C.evidence_paths(ev, programs, F.when(F.col("l_returnflag") == "R", 0.6).otherwise(1.0))


def projected(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").where("l_quantity >= 40")
    return C.projection(rows, "l_suppkey", "l_partkey")


def backfilled(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") > 20, F.col("p_type")).alias("p_type"), F.when(F.col("p_size") % 3 == 0, F.lit(" ")).otherwise(F.col("p_brand")).alias("p_brand"))
    repair = table(s, d, "part").where("p_size % 2 = 0").select("p_partkey", F.upper("p_type").alias("p_type"), F.col("p_brand"))
    return C.backfill(rows, repair, "p_partkey", ["p_type", "p_brand"])


def _weighted(s: SparkSession, d: str) -> DataFrame:
    return Scratch(s, "weighted").save(P.pair_summary(evidence(s, d, "source")).select("u", "v", F.col("papers").alias("weight")), "edges")


def modularity(s: SparkSession, d: str) -> DataFrame:
    types = facts(s, d).select(F.col("concept_id").alias("node"), F.col("concept_type").alias("part")).distinct()
    return C.modularity(_weighted(s, d), types).withColumn("modularity", F.round("modularity", 9))


def agreement(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select("o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p"))
    return C.adjusted_rand(rows, "o_orderstatus", "p").withColumn("ari", F.round("ari", 9))


def louvain(s: SparkSession, d: str) -> DataFrame:
    """Communities of the source pairs with two papers or more, by steps over tables."""
    return C.spread_louvain(_weighted(s, d).where("weight >= 2"), 0)


def _seeds(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = Scratch(s, "seeds").save(_weighted(s, d), "edges")
    return C.stability(edges, edges.select(F.explode(F.array("u", "v")).alias("node")), (1, 2, 3), range(100))


def community_seeds(s: SparkSession, d: str) -> DataFrame:
    """A hundred seeds at least weights of one to three papers."""
    return _seeds(s, d)[0]


def community_thresholds(s: SparkSession, d: str) -> DataFrame:
    return _seeds(s, d)[1]


def themes(s: SparkSession, d: str) -> DataFrame:
    return N.themes(table(s, d, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 0.15).withColumn("to_medoid", F.round("to_medoid", 6))


def label_svd(s: SparkSession, d: str) -> DataFrame:
    """Each part name's first four coordinates by the SVD of its TF-IDF of character grams; a coordinate's sign is that of its sum over all names."""
    names = table(s, d, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name")).distinct()
    weights = R.gram_weights(names, "name", "name")
    _, rows, _ = N.svd(weights, "name", "gram", "w", 4)
    cs = [f"c{i}" for i in range(4)]
    total = rows.agg(*[F.sum(c).alias(f"s_{c}") for c in cs])
    return rows.join(F.broadcast(total)).select("name", *[F.round(F.col(c) * F.when(F.col(f"s_{c}") < 0, -1).otherwise(1), 6).alias(c) for c in cs])  # one row


def adoption(s: SparkSession, d: str) -> DataFrame:
    """Source concepts that the target lacks by 1995: exposure to those it has, in the source graph."""
    scratch = Scratch(s, "adoption")
    rows = scratch.save(facts(s, d).where("year <= 1995"), "facts")
    active = rows.where("layer = 'target' and concept_type <> 'T3'").select(F.col("concept_id").alias("node")).distinct()
    nodes = rows.where("layer = 'source'").select(F.col("concept_id").alias("node")).distinct()
    edges = P.pair_summary(P.pair_evidence(rows.where("layer = 'source'"))).select("u", "v", F.col("papers").alias("weight"))
    names = rows.select("concept_id").distinct()
    similar = R.gram_neighbours(R.gram_weights(names, "concept_id", "concept_id", 1.0), "concept_id", 0.6, 10).select("a", "b", "cosine")
    out = C.adoption_frame(nodes, scratch.save(edges, "edges"), scratch.save(active, "active"), scratch.save(similar, "similar"))
    return out.select("node", "weighted_degree", "exposure", "active_neighbors", F.round("exposure_share", 9).alias("exposure_share"))


def edge_examples(s: SparkSession, d: str) -> DataFrame:
    return C.first_edge_examples(evidence(s, d, "target"), (1996, 1998))


def layered_years(s: SparkSession, d: str) -> DataFrame:
    return C.layered_years(L.pair_years(Scratch(s, "ly").save(facts(s, d), "facts"), ("source",), ("target",)), 1998)


def merged(s: SparkSession, d: str) -> DataFrame:
    """Pairs after concepts of sizes 1 to 10 of a brand became one; pairs within a merged concept go."""
    to = lambda c: F.when(F.regexp_extract(c, r"\|(\d+)$", 1).cast("int") <= 10, F.concat(F.element_at(F.split(c, r"\|"), 1), F.lit("|low"))).otherwise(F.col(c))
    rows = evidence(s, d, "source").select(to("u").alias("a"), to("v").alias("b"), "year", "paper_id").where("a <> b")
    rows = rows.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "year", "paper_id").repartition(parts(s, d), "u", "v")
    return P.pair_summary(rows).select("u", "v", "first_year", "last_year", "papers")


def lists(s: SparkSession, d: str) -> DataFrame:
    return S.packed_lists(table(s, d, "supplier").withColumn("k", F.col("s_suppkey").cast("string")), "s_nationkey", "k", {"rich": F.col("s_acctbal") > 0, "poor": F.col("s_acctbal") <= 0})


_EDGES = "li as (select * from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_quantity >= 30), e as materialized (select distinct 'customer:' || o_custkey as src, 'brand:' || p_brand as dst, 'ordered' as kind from li union all select distinct 'supplier:' || l_suppkey, 'brand:' || p_brand, 'supplied' from li union all select distinct 'supplier:' || l_suppkey, 'customer:' || o_custkey, 'sold' from li where l_quantity >= 45), nd as (select 'customer:' || c_custkey as node, 'customer' as type from customer union all select distinct 'brand:' || p_brand, 'brand' from part)"
_C = {"secret": "coalesce(regexp_matches(text, 'password|secret|token'), false)", "address": "coalesce(regexp_matches(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]'), false)", "loud": "coalesce(contains(text, '!!'), false)", "long": "coalesce(length(text) >= 2000, false)", "lines": "coalesce(contains(text, chr(10)), false)"}
QUERIES = {
    "document_classes": (
        document_classes,
        f"""with s as (select *, case when {_C['secret']} and {_C['address']} then 'private' when {_C['secret']} and not {_C['loud']} then 'guarded' when {_C['long']} and {_C['lines']} then 'prose' when {_C['loud']} then 'noise' else 'other' end as scope from documents),
t as (select *, case when coalesce(regexp_matches(text, '[Rr]eview|[Oo]verview'), false) then 'R_review' when coalesce(regexp_matches(text, 'license|License'), false) then 'P_coupled_precedent' when scope = 'private' then 'P_coupled_precedent' when scope = 'prose' and n_chars > 1000 then 'A_direct_evidence_ready' when scope = 'prose' then 'B_direct_needs_evidence_repair' when scope = 'guarded' then 'C_adjacent_enabling_evidence' when scope = 'noise' then 'D_cross_domain_inspiration' else 'U_unresolved_or_outside' end as tier,
  list_filter([case when regexp_matches(text, '[0-9]{{4}}') then 'numbers' end, case when regexp_matches(text, 'https?://') then 'links' end, case when contains(text, '!!') then 'shouts' end], lambda x: x is not null) as fam,
  list_filter(list_transform(regexp_split_to_array(text, '[;\\n]+'), lambda p: trim(p)), lambda p: p <> '') as parts, length(regexp_split_to_array(text, '[0-9]{{3,}}')[1]) as pos, regexp_extract(text, '[0-9]{{3,}}') as hit from s)
select doc_id, scope, tier, round(case tier when 'A_direct_evidence_ready' then 1.0::double when 'B_direct_needs_evidence_repair' then 0.75::double when 'R_review' then 0.2::double else 0.35::double end * case lang when 'en' then 1.0::double when 'de' then 0.8::double else 0.5::double end * case when coalesce(contains(text, 'token'), false) then 0.6::double else 1.0::double end, 6) as weight,
  (case when n_chars > 300 then 2 else 0 end + case when regexp_matches(text, '[0-9]') then 1 else 0 end + case when contains(text, chr(10)) then 2 else 0 end + case when lang = 'en' then 1 else 0 end)::int as points, case when len(fam) > 0 then array_to_string(fam, ';') else 'other' end as families, case when len(fam) > 0 then fam[1] else 'other' end as family,
  array_to_string(list_filter([case when contains(text, '1') then 'text' end, case when contains(source, '1') then 'source' end, case when contains(lang, '1') then 'lang' end], lambda x: x is not null), ';') as fields, coalesce(nullif(regexp_extract(coalesce(source, ''), '[0-9]+'), ''), nullif(regexp_extract(coalesce(text, ''), '[0-9]+'), '')) as evidence,
  case when lang = 'fr' then 'translated' when contains(text, 'token') then 'has tokens' when contains(text, '!!') then 'shouted' else '' end as caveat,
  case when hit <> '' then md5(trim(regexp_replace(substr(text, (greatest(pos - 30, 0) + 1)::bigint, (pos - greatest(pos - 30, 0) + length(hit) + 20)::bigint), '\\s+', ' ', 'g'))) end as snippet,
  (case when len(parts) = 0 then 0 else 1 + len(list_filter(parts[2:], lambda p: length(p) >= 40)) end)::int as claims from t""",
    ),
    "part_classes": (
        part_classes,
        """with c as (select *, case substr(p_brand, 7, 1) when '1' then 'M' when '2' then 'S' when '3' then 'P' else 'O' end as x, case substr(p_brand, 8, 1) when '1' then 'M' when '2' then 'S' when '3' then 'P' else 'O' end as y, lower(substr(p_type, 1, 3)) as term, string_split(p_name, ' ') as w from part)
select p_partkey, case when regexp_matches(p_name, '^(small|large) ') then 'sized' when regexp_matches(p_name, '(steel|tin)$') then 'metal' when regexp_matches(p_name, 'blue|red') then 'coloured' else p_name end as name, case when regexp_matches(p_name, '^(small|large) ') then 'size' when regexp_matches(p_name, '(steel|tin)$') then 'material' when regexp_matches(p_name, 'blue|red') then 'colour' else p_type end as kind,
  case when instr('MSPO', x) <= instr('MSPO', y) then x || '-' || y else y || '-' || x end as layers, least(p_type, p_brand) || '+' || greatest(p_type, p_brand) as roles, case when p_size > 30 then 'R2' else 'UNCLASSIFIED' end as grade,
  (case when p_size % 2 = 0 then case when p_size > 30 then 1 else 99 end else case when p_size > 10 and p_size <= 30 then 2 else 99 end end)::int as grade_order, len(w) between 2 and 3 and length(p_name) between 6 and 40 and regexp_matches(p_name, '[a-z]') and w[1] not in ('blue', 'red') and w[-1] not in ('blue', 'red') and contains(p_name, 'e') as good,
  regexp_replace(regexp_replace(p_name, 'a', '4', 'g'), 'e+', '3', 'g') as rewritten, case when contains(p_name, 'steel') then 'hard' when contains(p_name, 'small') then 'small' else 'plain' end as subtype,
  case when p_brand = 'Brand#13' then true when p_brand = 'Brand#11' then contains(p_name, 'a') or contains(p_type, 'a') when p_brand = 'Brand#12' then contains(p_name, 'z') or contains(p_type, 'z') else false end as family, list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), term) as present,
  case when length(p_name) > 8 then rtrim(substr(p_name, 1, 7)) || '…' else p_name end as short from c""",
    ),
    "typed_degrees": (
        typed_degrees,
        f"with {_EDGES}, x as (select src as node, 'out' as way, kind from e union all select dst, 'in', kind from e) select node, count(*) filter (way = 'out' and kind = 'ordered') as out_ordered, count(*) filter (way = 'in' and kind = 'ordered') as in_ordered, count(*) filter (way = 'out' and kind = 'supplied') as out_supplied, count(*) filter (way = 'in' and kind = 'supplied') as in_supplied, count(*) filter (way = 'out' and kind = 'sold') as out_sold, count(*) filter (way = 'in' and kind = 'sold') as in_sold, count(*) as degree from x group by 1",
    ),
    "graph_audit": (
        graph_audit,
        f"with {_EDGES} select 'node_repeated' as \"check\", (select count(*) from (select node from nd group by 1 having count(*) > 1)) as failures union all select 'end_without_node', (select count(*) from (select src from e union select dst from e) x where src not in (select node from nd)) union all select 'loop', (select count(*) from e where src = dst) union all select 'edge_repeated', (select count(*) from (select 1 from e group by src, dst, kind having count(*) > 1)) union all select 'kind_unknown', (select count(*) from e where kind not in ('ordered', 'supplied'))",
    ),
    "prior_art_layer": (
        layered,
        f"with {_EDGES}, x as (select distinct 'supplier:' || s_suppkey as src, 'nation:' || s_nationkey as dst, case when s_acctbal > 0 then 'located' else 'based' end as kind from supplier), m as (select distinct unnest([src, dst]) as node from x) select 'node:' || type as what, count(*) as n from (select * from nd union all select node, 'paper' from m where node not in (select node from nd)) group by 1 union all select 'edge:' || kind, count(*) from (select * from e union all select * from x) group by 1",
    ),
    "evidence_paths": (
        paths,
        "select l_orderkey * 10 + l_linenumber as evidence_id, case when p_type is not null then 'paper:' || l_orderkey || ' --supports--> program:' || l_partkey || ' --acts_on--> target:' || p_type else 'paper:' || l_orderkey end as path, case when l_returnflag = 'R' then 0.6::double else 1.0::double end as weight from lineitem left join (select * from part where p_size > 25) on p_partkey = l_partkey where l_quantity >= 48",
    ),
    "projection_graph": (projected, "with h as (select distinct l_suppkey as i, l_partkey as g from lineitem where l_quantity >= 40) select x.i as a, y.i as b, count(*) as weight from h x join h y on x.g = y.g and x.i < y.i group by all"),
    "metadata_backfill": (
        backfilled,
        "with r as (select p_partkey, case when p_size > 20 then p_type end as p_type, case when p_size % 3 = 0 then ' ' else p_brand end as p_brand from part), f as (select p_partkey, upper(p_type) as t, p_brand as b from part where p_size % 2 = 0) select p_partkey, case when trim(coalesce(r.p_type, '')) = '' then t else r.p_type end as p_type, case when trim(coalesce(r.p_brand, '')) = '' then b else r.p_brand end as p_brand, ((trim(coalesce(r.p_type, '')) = '' and t is not null)::int + (trim(coalesce(r.p_brand, '')) = '' and b is not null)::int)::int as filled from r left join f using (p_partkey)",
    ),
    "partition_modularity": (
        modularity,
        WITH + ", ed as (select u, v, papers as w from sums where layer = 'source'), pt as (select distinct concept_id, concept_type from facts), m as (select ed.*, a.concept_type as pu, b.concept_type as pv from ed join pt a on a.concept_id = u join pt b on b.concept_id = v), k as (select p, sum(w) as k from (select unnest([pu, pv]) as p, w from m) group by 1) select count(*) as edges, round(sum(case when pu = pv then w else 0 end) / sum(w) - (select sum(k * k) from k) / (4 * sum(w) * sum(w)), 9) as modularity from m",
    ),
    "partition_agreement": (
        agreement,
        "with c as (select o_orderstatus as a, substr(o_orderpriority, 1, 1) as b, count(*) as n from orders group by all), x as (select sum(k * (k - 1) / 2) as x from (select sum(n) as k from c group by a)), y as (select sum(k * (k - 1) / 2) as y from (select sum(n) as k from c group by b)), f as (select sum(n)::bigint as n, sum(n * (n - 1) / 2) as s from c) select n, round((s - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 9) as ari from f, x, y",
    ),
    "louvain_partition": (louvain, None),
    "community_seeds": (community_seeds, None),
    "community_thresholds": (community_thresholds, None),
    "agglomerative_themes": (themes, None),
    "label_svd": (label_svd, None),
    "node_adoption": (
        adoption,
        WITH + """, ac as (select distinct concept_id from facts where layer = 'target' and concept_type <> 'T3' and year <= 1995), nd as (select distinct concept_id as node from facts where layer = 'source' and year <= 1995), ed as (select u, v, count(distinct paper_id) as w from src where year <= 1995 group by all), bo as (select u as node, v as o, w from ed union all select v, u, w from ed),
g as (select node, sum(w)::bigint as wd, coalesce(sum(w) filter (o in (select concept_id from ac)), 0)::bigint as ex, count(*) filter (o in (select concept_id from ac)) as an from bo group by 1) select node, coalesce(wd, 0) as weighted_degree, coalesce(ex, 0) as exposure, coalesce(an, 0) as active_neighbors, round(coalesce(ex, 0) / greatest(1, coalesce(wd, 0)), 9) as exposure_share from nd left join g using (node) where node not in (select concept_id from ac)""",
    ),
    "edge_examples": (edge_examples, WITH + "select u, v, count(distinct paper_id) as papers, arg_min(paper_id, year * 1000000000000 + paper_id) as example from tgt where year between 1996 and 1998 group by all"),
    "layered_years": (
        layered_years,
        WITH + ", y as (select u, v, min(year) filter (layer = 'source' and year <= 1998) as s, min(year) filter (layer = 'target' and year <= 1998) as t, count(*) filter (layer <> 'hybrid' and year > 1998) as later from ev group by all) select u, v, least(s, t) as all_first, s as source_first, t as target_first, (t - s)::int as lead, (s is not null or t is not null)::int as past, (s is null and t is null and later > 0)::int as future from y",
    ),
    "merged_pairs": (
        merged,
        WITH + ", m as (select case when string_split(u, '|')[2]::int <= 10 then string_split(u, '|')[1] || '|low' else u end as a, case when string_split(v, '|')[2]::int <= 10 then string_split(v, '|')[1] || '|low' else v end as b, year, paper_id from src) select least(a, b) as u, greatest(a, b) as v, min(year) as first_year, max(year) as last_year, count(distinct paper_id) as papers from m where a <> b group by all",
    ),
    "conditional_lists": (lists, "select s_nationkey, coalesce(string_agg(distinct s_suppkey::varchar, '; ' order by s_suppkey::varchar) filter (s_acctbal > 0), '') as rich, coalesce(string_agg(distinct s_suppkey::varchar, '; ' order by s_suppkey::varchar) filter (s_acctbal <= 0), '') as poor from supplier group by 1"),
}
