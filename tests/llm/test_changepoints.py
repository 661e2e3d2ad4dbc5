"""Operator 11 against all segmentations of short series, and odd tables."""

import datetime
import math
import random

import numpy as np
import pytest

from strandline.llm import changepoints

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "vendor_id long, quantity int, shipped_at timestamp_ntz, total string, n int, day string"


def cost(x):
    n, s, q = len(x), sum(x), sum(v * v for v in x)
    return n * math.floor(1000 * math.log(1 + (n * q - s * s) // (n * n)))


def cuts(n, least):
    """All lists of starts whose segments have `least` days or more; a shorter series is one segment."""
    yield [0]
    for first in range(least, n - least + 1):
        for rest in cuts(n - first, least):
            yield [0, *(first + r for r in rest)]


def plain(x, least, penalty):
    n = len(x)

    def rank(starts):
        ends = [*starts[1:], n]
        return sum(cost(x[a:b]) for a, b in zip(starts, ends, strict=True)) + penalty * (len(starts) - 1), len(starts), starts[::-1]

    return min(map(rank, cuts(n, least)))


def frame(spark, table):
    return spark.createDataFrame([(v, q, None if d is None else DAY + datetime.timedelta(days=d, hours=5), "clash", 1, "x") for v, q, d in table], SCHEMA)


@pytest.mark.parametrize("least,penalty,spread", [(2, 300, 3), (3, 4000, 50), (2, 0, 1), (4, 900, 9)])
def test_against_all_segmentations(least, penalty, spread):
    rng = random.Random(least * 7 + spread)
    rows = [[rng.randrange(spread + 1) * rng.choice([1, 1, 9]) for _ in range(rng.randrange(1, 15))] for _ in range(40)]
    n = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), n.max()), np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    best, last = changepoints.partition(x, n, least, penalty)
    for i, r in enumerate(rows):
        want, many, starts = plain(r, least, penalty)
        got, t = [], len(r)
        while t:
            t = int(last[t, i])
            got.append(t)
        assert (best[i], len(got), got) == (want, many, starts), r


def test_query_against_plain_series(spark):
    rng = random.Random(5)
    table, sums = [], {}
    for v in range(12):
        for d in range(rng.randrange(1, 33)):
            for _ in range(rng.choice([0, 1, 2])):
                q = rng.randrange(1, 50) * (20 if d > 15 else 1)
                table.append((v, q, d))
                sums.setdefault(v, {}).setdefault(d, 0)
                sums[v][d] += q
    got = {}
    for r in sorted(changepoints.change_points(frame(spark, table), least=5, penalty=5000).collect(), key=lambda r: (r.vendor_id, r.segment_no)):
        got.setdefault(r.vendor_id, []).append(r)
    assert got.keys() == sums.keys()
    for v, of in sums.items():
        lo, hi = min(of), max(of)
        x = [of.get(d, 0) for d in range(lo, hi + 1)]
        want, many, starts = plain(x, 5, 5000)
        starts = starts[::-1]
        assert [r.first_day for r in got[v]] == [19723 + lo + s for s in starts]
        for r, a, b in zip(got[v], starts, [*starts[1:], len(x)], strict=True):
            n, s, q = b - a, sum(x[a:b]), sum(y * y for y in x[a:b])
            assert (r.n_days, r.total, r.spread, r.cost, r.n_segments, r.best_cost) == (n, s, 1 + (n * q - s * s) // (n * n), cost(x[a:b]), many, want)


def test_odd_tables(spark):
    assert changepoints.op11_changepoints(frame(spark, [])).collect() == []
    assert changepoints.op11_changepoints(frame(spark, [(1, None, 0), (2, 5, None)])).collect() == []
    odd = [(1, 5, 0), (1, 5, 0), (1, None, 3), (None, 7, 2), (None, 7, 40), (2, -4, 1), (3, 0, 0), (3, 9, 300)]
    got = {}
    for r in changepoints.op11_changepoints(frame(spark, odd)).collect():
        got.setdefault(r.vendor_id, []).append(r)
    assert [(r.segment_no, r.n_days, r.total, r.spread, r.cost) for r in got[1]] == [(1, 1, 10, 1, 0)]  # repeated rows count twice
    assert sum(r.n_days for r in got[None]) == 39 and sum(r.total for r in got[None]) == 14
    assert [(r.first_day, r.total) for r in got[2]] == [(19724, -4)]
    assert sum(r.n_days for r in got[3]) == 301 and len({r.best_cost for r in got[3]}) == 1


def test_values_beyond_63_bits():
    """The same cuts, spreads up to rounding, when the values are a million times larger; beside a padded short series."""
    rng = random.Random(1)
    x = np.array([[rng.randrange(100) * (50 if d > 30 else 1) for d in range(60)], [7] * 20 + [0] * 40], np.int64)
    n = np.array([60, 20])
    count = n
    flat = np.concatenate([np.arange(60), np.arange(20)])
    for scale in (1, 10**9):
        totals = np.concatenate([x[0], x[1, :20]]) * scale
        padded, base = changepoints._pad(n, np.array([0, 60]), count, flat, totals)
        assert (padded.dtype == object) == (scale > 1)
        got = changepoints._segments(n, padded, base, np.zeros(2, np.int64), 14, 40_000)
        want = plain([int(v) for v in totals[:60]], 14, 40_000)
        assert int(got["best_cost"][0]) == want[0] and sum(got["row"] == 0) == want[1]
        assert int(got["total"][got["row"] == 1][0]) == 140 * scale


def test_lengths_share_tensors_of_bounded_size():
    n = np.sort(np.array([3, 500, 14, 14, 40_000, 40_001, 9] * 20))
    at = 0
    for a, b in changepoints._tensors(n):
        assert a == at and (b == a + 1 or (b - a) * n[b - 1] <= changepoints.CELLS)
        at = b
    assert at == len(n)
