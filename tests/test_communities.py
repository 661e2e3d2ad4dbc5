"""Louvain over tables against the sequential one."""

import numpy as np

from strandline.operators import communities


def modularity(edges, part):
    m = sum(w for *_, w in edges)
    k = {}
    for u, v, w in edges:
        for x in (u, v):
            k[part[x]] = k.get(part[x], 0) + w
    return sum(w for u, v, w in edges if part[u] == part[v]) / m - sum(x * x for x in k.values()) / (4 * m * m)


def test_spread_louvain_finds_planted_parts_and_matches_the_sequential(spark):
    rng = np.random.default_rng(2)
    of = np.repeat(np.arange(6), 12)
    edges = [(int(i), int(j), float(rng.integers(1, 4))) for i in range(72) for j in range(i + 1, 72) if rng.random() < (0.5 if of[i] == of[j] else 0.03)]
    frame = spark.createDataFrame(edges, "u long, v long, weight double")
    got = {r.node: r.part for r in communities.spread_louvain(frame.repartition(3), 1).collect()}
    u, v, w = map(np.array, zip(*edges, strict=True))
    label = communities.louvain_parts(u, v, w, 72, 1)
    q = modularity(edges, dict(enumerate(label.tolist())))
    assert modularity(edges, got) >= 0.99 * q
    assert all(got[part] == part == min(n for n in got if got[n] == part) for part in set(got.values()))
    assert communities.spread_louvain(frame.where("false"), 1).collect() == []


def test_stability_over_seeds_and_thresholds(spark):
    rng = np.random.default_rng(5)
    edges = [(i, j, float(rng.integers(1, 4) + (i // 5 == j // 5))) for i in range(15) for j in range(i + 1, 15) if rng.random() < (0.9 if i // 5 == j // 5 else 0.15)]
    frame, nodes = spark.createDataFrame(edges, "u long, v long, weight double"), spark.range(17).withColumnRenamed("id", "node")
    table, pairs = communities.stability(frame, nodes, (1, 3), range(4))
    u, v, w = map(np.array, zip(*edges, strict=True))

    def parts(t, seed):
        on = w >= t
        names, codes = np.unique(np.concatenate([u[on], v[on]]), return_inverse=True)
        label = communities.louvain_parts(codes[: on.sum()], codes[on.sum() :], w[on], len(names), seed)
        out = {int(n): -1 - i for i, n in enumerate(range(17))}
        return out | {int(n): int(c) for n, c in zip(names, label, strict=True)}

    def ari(a, b):
        cells = {}
        for n in a:
            cells[a[n], b[n]] = cells.get((a[n], b[n]), 0) + 1
        two = lambda xs: sum(x * (x - 1) / 2 for x in xs)
        size = lambda p: [list(p.values()).count(c) for c in set(p.values())]
        x, y, both, pairs = two(size(a)), two(size(b)), two(cells.values()), len(a) * (len(a) - 1) / 2
        return 1.0 if (x + y) / 2 == x * y / pairs else (both - x * y / pairs) / ((x + y) / 2 - x * y / pairs)

    best = {}
    for r in table.collect():
        runs = [parts(r.threshold, s) for s in range(4)]
        q = [modularity([e for e in edges if e[2] >= r.threshold], p) for p in runs]
        best[r.threshold] = runs[int(np.round(q, 12).argmax())]
        scores = [ari(runs[0], p) for p in runs]
        assert np.allclose((r.modularity_mean, r.modularity_sd, r.ari_mean, r.ari_min), (np.mean(q), np.std(q), np.mean(scores), min(scores)))
        sizes = [list(best[r.threshold].values()).count(c) for c in set(best[r.threshold].values())]
        assert (r.nodes, r.edges, r.parts, r.parts_beyond_one) == (17, sum(e[2] >= r.threshold for e in edges), len(sizes), sum(n > 1 for n in sizes))
    assert [(r.left, r.right, round(r.ari, 9)) for r in pairs.collect()] == [(1.0, 3.0, round(ari(best[1.0], best[3.0]), 9))]
