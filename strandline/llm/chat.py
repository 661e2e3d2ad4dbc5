"""Chat formatting: multi-party perspective rotation.

For every participant of a dialogue, the dialogue is rendered with that speaker
as `assistant`, all others as `user` with their name, and system turns as they
are; the loss mask covers the speaker's own turns and their end mark.  A
rendering is a run of segments, a row a turn: its text, its place in the whole
rendering (code points) and the masked part.  Putting the segments of a
perspective together in order gives the rendering; `examples` does so.

Places are sums of lengths, first within blocks of turns and then over blocks,
so a dialogue of any length is never gathered in one task.

Cases: rows with a null conversation are dropped; a null role is the speaker
`unknown`; a null text is empty; a null turn comes first.  Repeated rows are
one turn; ties of a turn go by role, then text.  Markup in a text is broken up,
so it cannot open or close a turn.  A dialogue of system turns alone has no
participant and no rendering.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import running_sums

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BLOCK = 256


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def segments(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, perspective, turn, segment, start, stop, mask_start, mask_stop); the mask is null where nothing is learnt."""
    said = turns.where("conv_id is not null").select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), _plain(F.col("text")).alias("text")).distinct()
    # places come from a sorted deal of all turns, so that equal turn numbers do not gather in one task
    said = running_sums(said.withColumn("one", F.lit(1).cast("long")), [F.col(c) for c in ("turn", "role", "text")], {"one": "place"}, ["conv_id"], [F.col("turn"), F.col("role"), F.substring("text", 1, 256)]).drop("one")
    people = said.where("role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    own = F.col("role") == F.col("perspective")
    head = F.when(own, F.lit(f"{OPEN}assistant\n")).when(F.col("role") == "system", F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), F.regexp_replace("role", r"[\s<|>]", "_"), F.lit("\n")))
    each = said.join(people, "conv_id").withColumn("head", head).withColumn("segment", F.concat("head", "text", F.lit(CLOSE)))
    each = each.select("*", F.length("segment").cast("long").alias("size"), F.floor((F.col("place") - 1) / block).alias("block"), own.alias("own"))
    within = Window.partitionBy("conv_id", "perspective", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # totals come from narrow rows: lengths are summed before they are shuffled
    totals = each.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("total")).select("conv_id", "perspective", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = each.withColumn("stop_in", F.sum("size").over(within)).join(totals, ["conv_id", "perspective", "block"])
    stop = F.col("base") + F.col("stop_in")
    return placed.select("conv_id", "perspective", "turn", "role", "segment", (stop - F.col("size")).alias("start"), stop.alias("stop"), F.when(F.col("own"), stop - F.col("size") + F.length("head")).alias("mask_start"), F.when(F.col("own"), stop).alias("mask_stop"))


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, masks) with a whole rendering in a row, for dialogues that fit one."""
    part = segments(turns).groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_stop"))).alias("x"))
    masks = F.transform(F.filter("x", lambda s: s["mask_start"].isNotNull()), lambda s: F.struct(s["mask_start"].alias("start"), s["mask_stop"].alias("stop")))
    return part.select("conv_id", "perspective", F.array_join(F.transform("x", lambda s: s["segment"]), "").alias("text"), masks.alias("masks"))


def op4_chat(turns: DataFrame) -> DataFrame:
    """Every perspective of every conversation."""
    return segments(turns)


OP4_SQL = """
with said as (select distinct conv_id, coalesce(turn, -1)::bigint as turn, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as text from conversations where conv_id is not null),
people as (select distinct conv_id, role as perspective from said where role <> 'system'),
each as (select s.*, perspective, case when role = perspective then '<|im_start|>assistant' || chr(10) when role = 'system' then '<|im_start|>system' || chr(10)
    else '<|im_start|>user name=' || regexp_replace(role, '[\\s<|>]', '_', 'g') || chr(10) end as head from said s join people using (conv_id)),
whole as (select *, head || text || '<|im_end|>' || chr(10) as segment from each),
placed as (select *, length(segment) as size, sum(length(segment)) over (partition by conv_id, perspective order by turn, role, text rows unbounded preceding)::bigint as stop from whole)
select conv_id, perspective, turn, role, segment, stop - size as start, stop, case when role = perspective then stop - size + length(head) end as mask_start,
  case when role = perspective then stop end as mask_stop from placed
"""
