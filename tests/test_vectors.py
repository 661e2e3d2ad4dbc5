"""Themes by components, tiled densities and SVD against dense versions."""

import numpy as np
import pytest

from strandline.operators import vectors


def plain_linkage(unit, least):
    groups = [[i] for i in range(len(unit))]
    sim = np.round(unit @ unit.T, 12)
    while len(groups) > 1:
        value, i, j = max((sim[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if value < least:
            break
        groups[-i] += groups.pop(-j)
    return {frozenset(g) for g in groups}


def test_average_linkage_is_the_plain_one():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 25):
        for _ in range(8):
            v = rng.normal(size=(n, 3))
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            label = vectors.average_linkage(unit, 0.4)
            assert {frozenset(np.flatnonzero(label == c).tolist()) for c in np.unique(label)} == plain_linkage(unit, 0.4)
            assert all(label[c] == c == np.flatnonzero(label == c).min() for c in np.unique(label))


@pytest.mark.parametrize("block", [4, 1000])
def test_themes_by_components_are_those_of_the_whole(spark, block):
    rng = np.random.default_rng(3)
    groups = {"g": rng.normal(size=(40, 4)), "h": rng.normal(size=(25, 4)), "one": np.array([[1.0, 0, 0, 0]]), None: np.array([[1.0, 1, 0, 0], [1, 1, 0.1, 0]])}
    rows = [(g, i, v.tolist()) for g, m in groups.items() for i, v in enumerate(m)]
    got = {}
    for r in vectors.themes(spark.createDataFrame(rows, "g string, i int, v array<double>"), "g", "i", "v", 0.8, block=block).collect():
        got.setdefault(r.g, {}).setdefault(r.theme, []).append(r)
    for g, m in groups.items():
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
        assert {frozenset(x.i for x in t) for t in got[g].values()} == plain_linkage(unit, 0.8)
        for theme, own in got[g].items():
            ids = sorted(x.i for x in own)
            mean = np.round(np.round(unit[ids] @ unit[ids].T, 9).mean(1), 9)
            assert theme == ids[0] and {x.medoid for x in own} == {ids[int(mean.argmax())]}
    frame = spark.createDataFrame(rows, "g string, i int, v array<double>")
    with pytest.raises(ValueError, match="component"):
        vectors.themes(frame, "g", "i", "v", 0.0, most=5)
    assert vectors.themes(frame.where("false"), "g", "i", "v", 0.8).collect() == []


@pytest.mark.parametrize("block", [7, 1000])
def test_density_is_the_plain_sum(spark, block):
    rng = np.random.default_rng(4)
    p = np.vstack([rng.normal(size=(150, 2)) * [3, 1], np.zeros((30, 2)), [[50, 50], [-1e6, 3]]])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    got = {r.i: r.density for r in vectors.density(spark.createDataFrame(rows, "i int, x double, y double"), "i", "x", "y", 0.3, block=block).collect()}
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    want = np.exp(-d / (2 * 0.09)).sum(1) / (2 * np.pi * 0.09 * len(p))
    assert np.allclose([got[i] for i in range(len(p))], want, atol=1e-9) and len(got) == len(p)
    assert vectors.density(spark.createDataFrame([], "i int, x double, y double"), "i", "x", "y", 0.3).collect() == []


def test_svd_is_the_dense_one(spark):
    rng = np.random.default_rng(5)
    m = (rng.random((60, 25)) < 0.2) * rng.random((60, 25))
    m[:, 0] += 1
    rows = [(f"r{i}", j, float(m[i, j])) for i in range(60) for j in range(25) if m[i, j]]
    value, left, right = vectors.svd(spark.createDataFrame(rows, "r string, c int, w double"), "r", "c", "w", 4, rounds=5, extra=12)
    u, s, vt = np.linalg.svd(m)
    assert np.allclose(value, s[:4], rtol=1e-4)
    v = np.array([[r[f"v{i}"] for i in range(4)] for r in right.orderBy("c").collect()])
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-6) and np.allclose(np.abs(v.T @ vt[:4].T), np.eye(4), atol=3e-2)
    x = {r.r: [r[f"c{i}"] for i in range(4)] for r in left.collect()}
    assert np.allclose([x[f"r{i}"] for i in range(60)], m @ v, atol=1e-6)
    low = spark.createDataFrame([(i, j, float((i + 1) * (j + 1))) for i in range(6) for j in range(5)], "r int, c int, w double")
    value, left, right = vectors.svd(low, "r", "c", "w", 3, rounds=3, extra=2)
    assert value[0] == pytest.approx(np.linalg.norm(np.outer(range(1, 7), range(1, 6)))) and np.allclose(value[1:], 0, atol=1e-5)
