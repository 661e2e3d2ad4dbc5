"""Batches of items whose evidence is sent along once: in order, or by what they share.

Both depend on what came before, so a group (a domain's open items) is one fold.
Packing in order is streamed: a task holds one group's current batch.  Batching by
shared evidence holds one group's index of items by evidence.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def shared_batches(items: Sequence[tuple[int, Mapping[str, int]]], most: int, budget: int, start: int = 0) -> list[tuple[int, int]]:
    """(batch, place within it) of each item, given in order as (own size, sizes of its evidence); see `fold_shared`."""
    codes: dict[str, int] = {}
    begins = np.cumsum([0, *(len(evidence) for _, evidence in items)])
    code = np.array([codes.setdefault(e, len(codes)) for _, evidence in items for e in evidence], np.int32)
    size = np.array([n for _, evidence in items for n in evidence.values()], np.int64)
    batch, place = fold_shared(np.array([own for own, _ in items], np.int64), begins, code, size, most, budget, start)
    return list(zip(batch.tolist(), place.tolist(), strict=True))


def fold_shared(own: np.ndarray, begins: np.ndarray, code: np.ndarray, size: np.ndarray, most: int, budget: int, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Batch of each item and place within it, from own sizes and the codes and sizes of the evidence of item i at begins[i] to begins[i + 1].

    A batch begins with the first item left.  Then the cheapest item joins that shares
    evidence with those in it, counting only evidence not yet pooled, earlier items
    first among equals; with none left that shares, the first item left.  The batch ends when the item
    to join does not fit, or it has `most`.  An item that does not fit an empty batch is an error.

    The queue holds costs that may be too high: when evidence is pooled, the items that have it are
    entered again with what they cost now, and only an entry with the current cost counts.
    Items and evidence are in flat arrays of both directions; an entry is one whole number of cost and item.
    What is taken leaves the lists it is in when they are next read.
    """
    n = len(own)
    item_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(begins))
    by_code = np.argsort(code, kind="stable")
    having = item_of[by_code]  # of each evidence its items in order
    if np.any((np.diff(having) == 0) & (np.diff(code[by_code]) == 0)):
        raise ValueError("evidence of an item has two sizes")
    first_of = np.concatenate([[0], np.cumsum(np.bincount(code))]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    whole = array("q", (own + total[begins[1:]] - total[begins[:-1]]).tobytes())
    begins, first_of = array("q", begins.astype(np.int64).tobytes()), array("q", first_of.tobytes())
    having, at_code, amount = array("i", having.tobytes()), array("i", code.astype(np.int32).tobytes()), array("q", size.astype(np.int64).tobytes())
    until = first_of[1:]  # evidence's items that are still listed
    taken = bytearray(n)
    batches, places = array("i", bytes(4 * n)), array("i", bytes(4 * n))
    first, batch, done = 0, 0, 0
    pop, push = heapq.heappop, heapq.heappush
    wide = max(n, 1)
    while done < n:
        used, place, pooled, queue, cost = start, 0, set(), [], {}
        while done < n and place < most:
            while queue:
                price, at = divmod(queue[0], wide)
                if taken[at] or cost[at] != price:
                    pop(queue)
                else:
                    break
            else:
                while taken[first]:
                    first += 1
                at = first
                price = cost.get(at, whole[at])
            if used + price > budget:
                break
            used += price
            taken[at] = 1
            batches[at], places[at] = batch, place
            place, done = place + 1, done + 1
            changed = set()
            for k in range(begins[at], begins[at + 1]):
                e = at_code[k]
                if e in pooled:
                    continue
                pooled.add(e)
                less, lo, hi = amount[k], first_of[e], until[e]
                left = [i for i in having[lo:hi] if not taken[i]]
                if len(left) < hi - lo:
                    having[lo : lo + len(left)] = array("i", left)
                    until[e] = lo + len(left)
                for i in left:
                    cost[i] = (cost[i] if i in cost else whole[i]) - less
                changed.update(left)
            for i in changed:
                push(queue, cost[i] * wide + i)
        if not place:
            raise ValueError("an item alone exceeds the budget")
        batch += 1
    return np.array(batches, np.int32), np.array(places, np.int32)


def by_shared_evidence(rows: DataFrame, by: str, item: str, own: str, evidence: str, size: str, most: int, budget: int, start: int = 0) -> DataFrame:
    """(by, item, batch, place): rows are one a (by, item, evidence), with the item's own size and the evidence's; items are taken in order of `item`.

    Each choice depends on all before it, so a group is one fold; its rows come to it as flat columns in
    order, and it holds some 40 bytes a row and 40 an item.
    """
    found = F.collect_set(F.when(F.col(evidence).isNotNull(), F.struct(F.col(evidence).alias("e"), F.col(size).cast("long").alias("s"))))
    per = rows.groupBy(by, item).agg(F.max(F.col(own).cast("long")).alias("own"), found.alias("ev"))
    schema = StructType([per.schema[by], per.schema[item], StructField("batch", IntegerType()), StructField("place", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by(item)
        lists = table["ev"].combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        begins = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
        flat = lists.flatten()
        code, amount = pc.struct_field(flat, 0).dictionary_encode().indices.to_numpy().astype(np.int32), pc.struct_field(flat, 1).to_numpy()
        sizes, group, names = table["own"].to_numpy(), table[by][0], table[item].combine_chunks()
        del table, lists, flat
        batch, place = fold_shared(sizes, begins, code, amount, most, budget, start)
        for lo in range(0, len(batch), 1 << 17):
            here = slice(lo, lo + (1 << 17))
            own_names = names[here]
            yield pa.record_batch([pa.repeat(group, len(own_names)), own_names, pa.array(batch[here]), pa.array(place[here])], names=schema.fieldNames())

    return per.groupBy(by).applyInArrow(run, schema)


def in_order(rows: DataFrame, by: str, item: str, evidence: str, size: str, most: int, budget: int) -> DataFrame:
    """(by, item, batch): items in order; a batch ends before the item that would be one too many or take its distinct evidence beyond the budget."""
    pairs = F.array_sort(F.collect_set(F.struct(F.col(evidence).cast("string").alias("e"), F.col(size).cast("long").alias("s"))))
    per = rows.groupBy(by, item).agg(pairs.alias("ev")).repartition(by).sortWithinPartitions(by, item)
    schema = f"{by} {rows.schema[by].dataType.simpleString()}, {item} {rows.schema[item].dataType.simpleString()}, batch int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, batch, held, used, pool = None, 0, 0, 0, set()
        for f in frames:
            out = []
            for g, evidence_of in zip(f[by], f["ev"], strict=True):
                if group is None or g != group[0]:
                    group, batch, held, used, pool = (g,), 0, 0, 0, set()
                more = sum(x["s"] for x in evidence_of if x["e"] not in pool)
                if held and (held >= most or used + more > budget):
                    batch, held, used, pool = batch + 1, 0, 0, set()
                    more = sum(x["s"] for x in evidence_of)
                held, used = held + 1, used + more
                pool.update(x["e"] for x in evidence_of)
                out.append(batch)
            yield pd.DataFrame({by: f[by], item: f[item], "batch": out})

    return per.mapInPandas(run, schema)
