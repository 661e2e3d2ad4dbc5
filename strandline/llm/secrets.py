"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Three base kinds are found in every text by pattern: assignments, access keys
and long hex strings.  The method adds a fourth, opaque tokens (20 characters
or more with letters and at least three digits, outside every base span).  The
hash of each candidate's value is counted over the whole corpus by distinct
repositories and owners.  A value is a widely copied example if more than
EXAMPLE_OWNERS owners hold it, or if its owners hold it in more than
EXAMPLE_REPOSITORIES repositories each on average, as a template does; any other
is owner-specific and looks live.  Base spans stay either way; an opaque token is a span only if it looks live.

Positions come from the pieces between matches: a match starts where the
lengths of all pieces and matches before it end, counted in code points.

Cases: a null text is the empty text and has no spans; null repositories and
owners count as one.  Equal rows give equal rows, counted once in ownership
because distinct owners and repositories count, not rows.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import Scratch

# The contract's patterns.  A run of 16 hex digits or more, and a
# key of 18 characters or more, are what is left when shorter matches are dropped.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")
EXAMPLE_OWNERS = 2
EXAMPLE_REPOSITORIES = 25

_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All matches of a pattern, leftmost and without overlap, with their places."""
    gaps, hits, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("stop"), x["value"].alias("value")))).alias("out"))

    return F.aggregate(parts, start, step)["out"]


def _where(test: Column, found: Column) -> Column:
    return F.when(test, found).otherwise(F.array().cast(_SPAN))


def candidates(text: Column) -> tuple[Column, Column]:
    """(base spans, opaque tokens outside them): arrays of start, kind, stop and value."""
    assign = F.filter(_where(text.rlike(ASSIGN), _spans(text, ASSIGN, 0, 2)), lambda x: F.length(x["value"]) >= 12)
    access = _where(text.contains("AKIA"), _spans(text, ACCESS, 1))
    hexes = _where(text.rlike(HEX), _spans(text, HEX, 2))
    base = F.array_sort(F.concat(assign, access, hexes))
    opaque = _where(text.rlike(r"[0-9]") & text.rlike(OPAQUE), _spans(text, OPAQUE, 3))
    return base, F.filter(opaque, lambda x: (F.length(F.regexp_replace(x["value"], "[^0-9]", "")) >= 3) & x["value"].rlike("[A-Za-z]"))


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", text: str = "text", keys: tuple[str, ...] = ("doc_id",), most: int = EXAMPLE_OWNERS, each_most: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """`keys` of every row, text_hash, base and spans (arrays of start, kind, stop, live), n_live and n_copied."""
    scratch = Scratch(docs.sparkSession, "secrets")
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(*[F.col(k) for k in keys], F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("_repository"), whole.alias("_text"))
    base, opaque = candidates(F.col("_text"))
    hashed = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), F.sha2(x["value"], 256).alias("hash")))
    rows = named.select(*keys, "_owner", "_repository", F.xxhash64("_text").alias("text_hash"), base.alias("_base"), opaque.alias("_opaque"))
    rows = rows.withColumn("_opaque", F.filter("_opaque", lambda x: ~F.exists("_base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))))
    rows = scratch.save(rows.select(*keys, "_owner", "_repository", "text_hash", hashed(F.col("_base")).alias("_base"), hashed(F.col("_opaque")).alias("_opaque"), F.monotonically_increasing_id().alias("_row")), "rows")
    each = rows.select("_row", "_owner", "_repository", F.explode(F.concat("_base", "_opaque")).alias("x")).select("_row", "_owner", "_repository", "x.*")
    # one row an owner and repository first, so a value that every row holds is counted from few rows
    held = each.select("hash", "_owner", "_repository").distinct().groupBy("hash").agg(F.count_distinct("_owner").alias("owners"), F.count_distinct("_repository").alias("repositories"))
    judged = each.join(held, "hash").select("_row", F.struct("start", "kind", "stop", ((F.col("owners") <= most) & (F.col("repositories") <= each_most * F.col("owners"))).alias("live")).alias("x"))
    judged = judged.where("x.kind < 3 or x.live").groupBy("_row").agg(F.array_sort(F.collect_list("x")).alias("spans"))
    out = rows.join(judged, "_row", "left")
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,live:boolean>>")
    spans = F.coalesce("spans", none)
    return out.select(*keys, "text_hash", F.filter(spans, lambda x: x["kind"] < 3).alias("base"), spans.alias("spans")).withColumns(
        {"n_live": F.size(F.filter("spans", lambda x: x["live"])), "n_copied": F.size(F.filter("spans", lambda x: ~x["live"]))}
    )


def redact(docs: DataFrame, **how) -> DataFrame:
    """`docs` with every span replaced by its kind and whether it looks live; n_chars follows the text."""
    scratch = Scratch(docs.sparkSession, "redact")
    found = scan(docs, **how).where(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("_spans"))
    found = scratch.save(found, "found").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    if found.count() <= 200_000 and (found.agg(F.sum(F.size("_spans"))).first()[0] or 0) <= 1_000_000:
        found = F.broadcast(found)
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left")
    names = F.array(*[F.lit(k) for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        add = F.concat(F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.when(x["start"] >= acc["at"], F.concat(F.lit("<"), names[x["kind"]], F.when(x["live"], F.lit(":live>")).otherwise(F.lit(":example>")))).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.concat(acc["out"], add).alias("out"))

    done = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    whole = F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    changed = joined.withColumn("text", F.when(F.col("_spans").isNotNull(), whole).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("_spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def op7_secrets(docs: DataFrame) -> DataFrame:
    """Digest of the spans of every whole text; a document is a repository, its source the owner."""
    found = scan(docs.select("doc_id", "text", "source"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"), F.col("n_live").cast("long").alias("n_live"), F.col("n_copied").cast("long").alias("n_copied"))


def _duck_spans(pattern: str, kind: int, value: str = "h", keep: str = "true") -> str:
    p = pattern.replace("'", "''")
    starts = "list_sum(list_transform(g[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(h[1:i-1], lambda q: length(q))), 0)"
    return f"""select rid, (z).s::int as start, {kind} as kind, ((z).s + length((z).h))::int as stop, (z).v as val from (
      select rid, unnest(list_transform(range(1, len(h) + 1), lambda i: {{'s': {starts}, 'h': h[i], 'v': {value}[i]}})) as z from (
        select rid, regexp_split_to_array(t, '{p}') as g, regexp_extract_all(t, '{p}', 0) as h, regexp_extract_all(t, '{p}', {2 if value == 'w' else 0}) as w from d)
      ) where {keep}"""


OP7_SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(source, '') as owner, coalesce(text, '') as t from documents),
base as (
  {_duck_spans(ASSIGN, 0, 'w', 'length((z).v) >= 12')}
  union all {_duck_spans(ACCESS, 1)}
  union all {_duck_spans(HEX, 2)}),
opaque as (select * from ({_duck_spans(OPAQUE, 3)}) o where length(regexp_replace(val, '[^0-9]', '', 'g')) >= 3 and regexp_matches(val, '[A-Za-z]')
  and not exists (select 1 from base b where b.rid = o.rid and b.start < o.stop and o.start < b.stop)),
cand as (select * from base union all select * from opaque),
held as (select val, count(distinct owner) as owners, count(distinct coalesce(doc_id::varchar, '')) as repositories from cand join d using (rid) group by val),
weighed as (select val, owners <= {EXAMPLE_OWNERS} and repositories <= {EXAMPLE_REPOSITORIES} * owners as live from held),
judged as (select c.*, live from cand c join weighed using (val) where kind < 3 or live),
lined as (select rid, kind, live, start, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || start || ':' || stop as line from judged),
agg as (select rid, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
  string_agg(line, ',' order by start, kind) filter (kind < 3) as base_line, string_agg(line, ',' order by start, kind) as spans,
  count(*) filter (live) as n_live, count(*) filter (not live) as n_copied from lined group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base_line, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from d left join agg using (rid)
"""
