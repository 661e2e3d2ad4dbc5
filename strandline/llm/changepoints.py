"""Penalised change points of many daily series at once.

A series is the sum of a value per day from a key's first to its last day, days
without rows counting zero.  It is cut into segments of at least LEAST days so that
the segments' costs plus PENALTY a cut are smallest, by optimal partitioning over
all starts.  Rows are folded to days before anything is gathered, so a series is as
long as its calendar, however many rows its key has.  Within a task, series are
sorted by length and padded to tensors of at most CELLS days; one sweep over the days
updates all series of a tensor and all starts at once, and the first smallest of
(cost, segments) over the starts is the earliest start among equals.

The cost of n days with sum S and sum of squares Q is n * floor(1000 * ln(V)),
V = 1 + floor((n * Q - S * S) / (n * n)), in exact integers: V does not change when a
constant is taken from every day, so each series is shifted by its first day's value,
and series whose products could leave 63 bits are computed in Python's integers.

Cases: rows whose value or time is null are left out; a key without other rows has no
series; a null key is a key like any other.  Repeated rows count as often as they occur,
zero and negative values as they are.  A series shorter than LEAST days is one segment.
Ties: fewest segments, then earliest starts compared from the last segment backwards.
An empty table gives no rows; extra columns are ignored whatever their names.  A day's sum or
a spread beyond 63 bits is an error.  Time grows with the square of a series' days, memory with
its days.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

LEAST = 14
PENALTY = 40_000
#: Days of a tensor, padding included; a longer series is a tensor of its own.
CELLS = 1 << 15
#: The number of segments takes the low bits of what is minimised.
COUNT_BITS = 20


def daily(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """(key, day, total): the sum of `value` per day of `at`, days since 1970."""
    taken = rows.where(F.col(value).isNotNull() & F.col(at).isNotNull())
    taken = taken.select(F.col(key).alias("key"), F.unix_date(F.to_date(at)).cast("long").alias("day"), F.col(value).cast("long").alias("v"))
    return taken.groupBy("key", "day").agg(F.sum("v").alias("total"))


def series(days: DataFrame) -> DataFrame:
    """One row a key: its days and totals in order of days, and the days of its calendar; sorted by these within a partition."""
    parts = int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: the work on a row is large beside its bytes, so parts are not to be merged by size
    one = days.repartition(parts, "key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("day", "total"))).alias("d"))
    span = F.col("d")[F.size("d") - 1]["day"] - F.col("d")[0]["day"] + 1
    return one.select("key", F.col("d.day").alias("days"), F.col("d.total").alias("totals"), span.alias("n")).sortWithinPartitions("n")


def costs(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, spread) of stretches of n days with sums s and sums of squares q; int64, or Python integers as objects."""
    spread = 1 + (n * q - s * s) // (n * n)
    return n * np.floor(1000 * np.log(spread.astype(np.float64))).astype(np.int64), spread


def partition(x: np.ndarray, length: np.ndarray, least: int = LEAST, penalty: int = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Best cost of every series and the start of the last segment of every prefix.

    x: series by day, padded; column t of the starts is for the first t days.
    """
    rows, most = x.shape
    s, q = (np.zeros((most + 1, rows), x.dtype) for _ in range(2))  # days first, so that the starts of an end are one block
    np.cumsum(x.T, axis=0, out=s[1:])
    np.cumsum((x * x).T, axis=0, out=q[1:])
    score = np.zeros((most + 1, rows), np.int64)
    last = np.zeros((most + 1, rows), np.int32)
    for t in range(1, most + 1):
        # start 0 with any length, as the only segment of a short series; else starts that leave both sides long enough
        begin = np.concatenate([[0], np.arange(least, t - least + 1)])
        n = (t - begin)[:, None].astype(x.dtype)
        cost, _ = costs(n, s[t] - s[begin], q[t] - q[begin])
        total = score[begin] + (cost << COUNT_BITS) + 1
        total[1:] += penalty << COUNT_BITS
        pick = total.argmin(0)  # the first of equals: the earliest start
        last[t] = begin[pick]
        score[t] = total[pick, np.arange(rows)]
    return score[length, np.arange(rows)] >> COUNT_BITS, last


def _tensors(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of series, sorted by length, whose padded days are at most CELLS."""
    at = 0
    while at < len(n):
        end = at + 1
        while end < len(n) and (end + 1 - at) * n[end] <= CELLS:
            end += 1
        yield at, end
        at = end


def _pad(n: np.ndarray, first: np.ndarray, count: np.ndarray, days: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Series shifted by their first day's value, and these values; objects where int64 could overflow."""
    row = np.repeat(np.arange(len(n)), count)
    x = np.zeros((len(n), int(n.max())), np.int64)
    x[row, days - np.repeat(days[first], count)] = totals
    base = totals[first]
    high = np.maximum(np.abs(x.max(1).astype(float) - base), np.abs(x.min(1).astype(float) - base))
    if (n * n * high * high).max() >= 2.0**61:
        x, base = x.astype(object), base.astype(object)
    return x - base[:, None], base


def _segments(n: np.ndarray, x: np.ndarray, base: np.ndarray, day0: np.ndarray, least: int, penalty: int) -> dict[str, np.ndarray]:
    """All segments of a tensor's series, by series and then segment."""
    rows = len(n)
    best, last = partition(x, n, least, penalty)
    found = []
    end, live = n.copy(), np.arange(rows)
    while len(live):  # from the last segment backwards, all series at once
        begin = last[end[live], live].astype(np.int64)
        found.append((live, begin, end[live]))
        end[live] = begin
        live = live[begin > 0]
    row, begin, stop = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((begin, row))
    row, begin, stop = row[order], begin[order], stop[order]
    each = np.bincount(row, minlength=rows)
    s, q = (np.zeros((rows, x.shape[1] + 1), x.dtype) for _ in range(2))
    np.cumsum(x, axis=1, out=s[:, 1:])
    np.cumsum(x * x, axis=1, out=q[:, 1:])
    days = (stop - begin).astype(x.dtype)
    sums = s[row, stop] - s[row, begin]
    cost, spread = costs(days, sums, q[row, stop] - q[row, begin])
    number = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + 1
    return {"row": row, "segment_no": number, "first_day": day0[row] + begin, "n_days": stop - begin, "total": sums + days * base[row], "spread": spread, "cost": cost, "n_segments": each[row], "best_cost": best[row]}


def change_points(rows: DataFrame, key: str = "vendor_id", value: str = "quantity", at: str = "shipped_at", least: int = LEAST, penalty: int = PENALTY) -> DataFrame:
    """One row a segment: the key, segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost."""
    made = ["segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_all = batch.column("n").to_numpy()
            days, totals = batch.column("days"), batch.column("totals")
            for a, b in _tensors(n_all):
                d, t = days.slice(a, b - a), totals.slice(a, b - a)
                count = d.value_lengths().to_numpy().astype(np.int64)
                first = np.cumsum(count) - count
                flat = d.flatten().to_numpy()
                x, base = _pad(n_all[a:b], first, count, flat, t.flatten().to_numpy())
                got = _segments(n_all[a:b], x, base, flat[first], least, penalty)
                keys = batch.column("key").slice(a, b - a).take(pa.array(got["row"]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(got["segment_no"].astype(np.int32)), *(pa.array(got[c].astype(np.int64)) for c in made[1:])], [key, *made])

    table = series(daily(rows, key, value, at))
    kind = table.schema["key"].dataType.simpleString()
    schema = f"`{key}` {kind}, segment_no int, " + ", ".join(f"{c} bigint" for c in made[1:])
    return tv.arrow(table).mapInArrow(run, schema)


def op11_changepoints(lines: DataFrame) -> DataFrame:
    """Segments of every vendor's daily quantities."""
    return change_points(lines)


#: One state a vendor walks over the ends t with the best (cost, segments, start) of every prefix so far.
OP11_SQL = f"""
with recursive days as (
  select vendor_id, cast(shipped_at as date) d, sum(quantity)::hugeint x from sale_lines where quantity is not null and shipped_at is not null group by all
), bounds as (select vendor_id, min(d) lo, max(d) hi from days group by vendor_id
), filled as (
  select b.vendor_id, b.lo, i, coalesce(x, 0) x from bounds b, lateral (select unnest(range(date_diff('day', b.lo, b.hi) + 1)) i) r
  left join days on days.vendor_id is not distinct from b.vendor_id and days.d = b.lo + i::int
), running as (
  select *, sum(x) over w s, sum(x * x) over w q from filled window w as (partition by vendor_id order by i)
), series as materialized (
  select vendor_id, any_value(lo) lo, count(*) n, list_prepend(0::hugeint, list(s::hugeint order by i)) s, list_prepend(0::hugeint, list(q::hugeint order by i)) q from running group by vendor_id
), sweep as (
  select vendor_id, n, s, q, 0::bigint t, [{{'c': 0::bigint, 'k': 0::bigint, 'b': 0::bigint}}] best from series
  union all
  select vendor_id, n, s, q, t + 1, list_append(best, list_min([
    {{'c': best[b + 1].c + if(b > 0, {PENALTY}, 0) + (t + 1 - b) * floor(1000 * ln(1 + ((t + 1 - b) * (q[t + 2] - q[b + 1]) - (s[t + 2] - s[b + 1]) * (s[t + 2] - s[b + 1])) // ((t + 1 - b) * (t + 1 - b))))::bigint,
      'k': best[b + 1].k + 1, 'b': b}} for b in range(0, t + 1) if b = 0 or (b >= {LEAST} and t + 1 - b >= {LEAST})]))
  from sweep where t < n
), cuts as (
  select vendor_id, best, n stop, best[n + 1].b start from sweep where t = n
  union all
  select vendor_id, best, start, best[start + 1].b from cuts where start > 0
), parts as (
  select c.vendor_id, c.start, c.stop - c.start n, s[c.stop + 1] - s[c.start + 1] sums, q[c.stop + 1] - q[c.start + 1] squares, lo, best[series.n + 1].k k, best[series.n + 1].c c
  from cuts c join series on series.vendor_id is not distinct from c.vendor_id
)
select vendor_id, (row_number() over (partition by vendor_id order by start))::int segment_no, date_diff('day', date '1970-01-01', lo) + start first_day, n n_days, sums::bigint total,
  (1 + (n * squares - sums * sums) // (n * n))::bigint spread, n * floor(1000 * ln(1 + (n * squares - sums * sums) // (n * n)))::bigint "cost", k n_segments, c best_cost
from parts
"""
