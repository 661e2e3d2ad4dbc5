"""Queries of open vocabularies, claims, hits and alias edges over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vocabulary as V
from ..operators.scratch import Scratch
from ..session import table
from .summary_queries import STOP


TEXTS = ("doc_id", "text", (2, 4), STOP)


def vocabulary(s: SparkSession, d: str) -> DataFrame:
    return V.vocabulary(V.phrases(table(s, d, "documents"), *TEXTS), "doc_id", 3, 60, 500).withColumn("place", F.col("place").cast("long"))


def assigned(s: SparkSession, d: str) -> DataFrame:
    """Texts are read twice, for the vocabulary and for who has it, so that their phrases are never written."""
    words = Scratch(s, "phrases").save(vocabulary(s, d).select("phrase", "place"), "vocabulary")
    return V.assign(V.phrase_runs(table(s, d, "documents"), *TEXTS), F.broadcast(words), "doc_id", 10)  # 500 rows


def claim_units(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("text is not null")
    out = V.claim_units(docs, "doc_id", "text", docs.select("doc_id", "lang", "source"))
    return out.select("doc_id", F.col("unit").cast("long").alias("unit"), F.md5("claim").alias("claim"), "unit_id", "lang")


def hits(s: SparkSession, d: str) -> DataFrame:
    return V.pattern_hits(table(s, d, "documents"), "doc_id", ["text", "source"], r"[A-Za-z]+[0-9]+", ["src0", "src1"])


FAMILIES = {"numbers": "[0-9]+", "shouts": "!!", "links": "https?://"}


def family_hits(s: SparkSession, d: str) -> DataFrame:
    return V.family_hits(table(s, d, "documents"), "doc_id", "text", FAMILIES).withColumn("hits", F.col("hits").cast("long"))


def lookup(s: SparkSession, d: str) -> DataFrame:
    """Terms of parts' words: names are concepts, brands and types their aliases."""
    p = table(s, d, "part").select("p_name", "p_brand", "p_type").distinct()
    concepts = p.select(F.col("p_name").alias("label"), F.col("p_name").alias("concept")).distinct()
    alias = p.select(F.concat_ws("-", "p_type", "p_brand").alias("alias"), F.col("p_name").alias("concept")).where("p_brand like 'Brand#1%'")
    manual = s.createDataFrame([("the", "c1"), ("in der", "c2"), ("de la", "c3"), ("of the", "c1"), ("que", "c4")], "term string, concept string")
    merge = s.createDataFrame([("c4", "c3")], "concept string, into string")
    return V.term_lookup(concepts, alias, manual, merge)


def novelty_edges(s: SparkSession, d: str) -> DataFrame:
    """Sources as mapped concepts of documents, with those that their raw text names."""
    docs = Scratch(s, "novelty").save(table(s, d, "documents").where("text is not null").select("doc_id", "text", "source", "lang"), "docs")
    mapped = docs.select("doc_id", F.explode(F.array("source", "lang")).alias("concept")).where("concept is not null")
    return V.augmented_edges(mapped, V.text_concepts(docs, "doc_id", "text", lookup(s, d), 2), "doc_id")


def overlaps(s: SparkSession, d: str) -> DataFrame:
    return V.overlap_audit(table(s, d, "part"), "p_name", "p_type")


ROLES = {"context": (("in", "en", "dans", "im"), 0.1), "action": (("the", "der", "le", "el"), 0.1), "outcome": (("and", "und", "et", "y"), 0.05)}


def role_sentences(s: SparkSession, d: str) -> DataFrame:
    return V.role_sentences(table(s, d, "documents"), "doc_id", "text", ROLES)


_PH = f"""with c as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[.,;:!?()\\[\\]\\n]+'), lambda c: trim(c) <> '')) as clause from documents), w as (select doc_id, regexp_extract_all(clause, '[\\p{{L}}\\p{{N}}]+') as w from c),
g as (select doc_id, unnest(list_concat(list_concat(list_transform(range(1, greatest(len(w), 1)), lambda i: array_to_string(w[i:i+1], ' ')), list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i+2], ' '))), list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i+3], ' ')))) as phrase from w),
ph as materialized (select doc_id, phrase, count(*) as times from g where string_split(phrase, ' ')[1] not in {STOP} and string_split(phrase, ' ')[-1] not in {STOP} group by all),
v0 as (select phrase, count(*) as df, sum(times)::bigint as times from ph group by 1 having count(*) between 3 and 60), v1 as (select *, round(ln(1 + df) * sqrt(len(string_split(phrase, ' '))) / (1 + log10(df)), 9) as score from v0),
vo as materialized (select *, row_number() over (order by score desc, times desc, phrase) as place from v1 qualify place <= 500)"""
_LOOK = """tm as (select p_name as t, p_name as concept from part union all select p_type || '-' || p_brand, p_name from part where p_brand like 'Brand#1%' union all select * from (values ('the', 'c1'), ('in der', 'c2'), ('de la', 'c3'), ('of the', 'c1'), ('que', 'c3')) m(t, c)),
lk as (select distinct trim(regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', ' ', 'g')) as term, concept from tm)"""
QUERIES = {
    "open_vocabulary": (vocabulary, _PH + " select phrase, df, times, score, place from vo"),
    "vocabulary_assignment": (assigned, _PH + " select doc_id, phrase, place from ph join vo using (phrase) qualify row_number() over (partition by doc_id order by place) <= 10"),
    "claim_units": (
        claim_units,
        "with p as (select doc_id, lang, list_filter(list_transform(regexp_split_to_array(text, '[;\\n]+'), lambda p: trim(p)), lambda p: p <> '') as p from documents where text is not null), i as (select doc_id, lang, unnest(range(1, len(p) + 1)) as i, p from p), k as (select doc_id, lang, i, p[i] as piece, sum((i = 1 or length(p[i]) >= 40)::int) over (partition by doc_id order by i rows unbounded preceding) as u from i),"
        " c as (select doc_id, lang, (u - 1)::bigint as unit, string_agg(piece, '; ' order by i) as claim from k group by all) select doc_id, unit, md5(claim) as claim, 'CU_' || substr(sha1(doc_id || chr(31) || unit || chr(31) || lower(trim(regexp_replace(claim, '\\s+', ' ', 'g')))), 1, 12) as unit_id, lang from c",
    ),
    "pattern_hits": (
        hits,
        "with h as (select doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+[0-9]+'), lambda x: x not in ('src0', 'src1')) as t, list_filter(regexp_extract_all(coalesce(source, ''), '[A-Za-z]+[0-9]+'), lambda x: x not in ('src0', 'src1')) as s from documents),"
        " u as (select doc_id, t, s, list_distinct(list_concat(t, s)) as d from h where len(t) + len(s) > 0), x as (select doc_id, unnest(d) as e from u), o as (select doc_id, string_agg(e, '; ' order by lower(e), e) as terms from x group by 1) select doc_id, array_to_string(list_filter([case when len(t) > 0 then 'text' end, case when len(s) > 0 then 'source' end], lambda y: y is not null), '; ') as fields, terms from u join o using (doc_id)",
    ),
    "family_hits": (family_hits, "with h as (select doc_id, coalesce(text, '') as t from documents), x as (select doc_id, 'numbers' as family, len(regexp_extract_all(t, '[0-9]+')) as hits from h union all select doc_id, 'shouts', len(regexp_extract_all(t, '!!')) from h union all select doc_id, 'links', len(regexp_extract_all(t, 'https?://')) from h) select * from x where hits > 0"),
    "term_lookup": (lookup, f"with {_LOOK} select * from lk where term <> ''"),
    "novelty_edges": (
        novelty_edges,
        f"with {_LOOK}, t as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from documents where text is not null), g as (select doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: array_to_string(w[i:i+1], ' ')))) as term from t), fd as (select distinct doc_id, concept from g join lk using (term)),"
        " mp as (select distinct doc_id, unnest([source, lang]) as concept from documents where text is not null), mq as (select * from mp where concept is not null), al as (select * from mq union select * from fd), kn as (select distinct a.concept as u, b.concept as v from mq a join mq b on a.doc_id = b.doc_id and a.concept < b.concept)"
        " select a.concept as u, b.concept as v, count(*) as papers, (a.concept, b.concept) not in (select (u, v) from kn) as fresh from al a join al b on a.doc_id = b.doc_id and a.concept < b.concept group by all",
    ),
    "label_overlaps": (overlaps, None),
    "role_sentences": (role_sentences, None),
}
