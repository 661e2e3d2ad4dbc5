"""Work over vectors and points whose groups fit no task: themes by mutual merges, tiled densities, truncated SVD."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import running_sums
from .scratch import Scratch

#: Rows of a block of a product, and of one that is looked through for best partners.
BLOCK, SIDE = 1024, 8192
#: The most clusters that are held as a matrix, and the most of a group that one task merges.
FEW, WHOLE = 2048, 16_384


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in vectors])


def _matrix_linkage(mean: np.ndarray, least: float, size: np.ndarray) -> np.ndarray:
    """`average_linkage` by a matrix of all pairs.

    Each row remembers its best partner after it, so a merge looks again only at rows whose partner it touched.
    """
    n = len(mean)
    sim = np.round(mean @ mean.T, 12)
    sim[np.tril_indices(n)] = -np.inf
    size, label, best = size.astype(float), np.arange(n), sim.argmax(1) if n else np.zeros(0, int)
    top = sim[np.arange(n), best] if n else np.zeros(0)
    while n:
        i = int(top.argmax())
        if top[i] < least:
            break
        j = int(best[i])
        row = np.maximum(sim[i], sim[:, i])  # each pair is held once, the other half is -inf
        other = np.maximum(sim[j], sim[:, j])
        merged = (size[i] * row + size[j] * other) / (size[i] + size[j])
        merged[[i, j]] = -np.inf
        sim[j], sim[:, j] = -np.inf, -np.inf
        sim[:i, i], sim[i, i + 1 :] = merged[:i], merged[i + 1 :]
        size[i] += size[j]
        label[label == j] = i
        again = np.flatnonzero((best == i) | (best == j) | (np.arange(n) == i) | (sim[:, i] >= top))
        best[again] = sim[again].argmax(1)
        top[again] = sim[again, best[again]]
        top[j] = -np.inf
    return label


def _nearest(mean: np.ndarray, names: np.ndarray, others: np.ndarray, other_names: np.ndarray, strip: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Place in `others` (in order of their names) and value of each row's largest product with another; ties go to the smaller name."""
    best, top = np.zeros(len(mean), int), np.full(len(mean), -np.inf)
    for a in range(0, len(mean), strip):
        sim = np.round(mean[a : a + strip] @ others.T, 12)
        sim[names[a : a + strip, None] == other_names] = -np.inf
        best[a : a + strip] = sim.argmax(1)
        top[a : a + strip] = sim.max(1)
    return best, top


def average_linkage(mean: np.ndarray, least: float, size: np.ndarray | None = None, few: int = FEW) -> np.ndarray:
    """Clusters of rows: the two whose mean cosine is largest merge while it is `least` or more; ties go to the smaller rows.

    Rows are unit vectors, or means of `size` such vectors.  The mean cosine of two clusters is the
    product of their means, and no merge brings a third cluster nearer than the nearer of the two was.  So two that are each
    other's best merge whatever else does: all such pairs at once give what one merge at a time gives, without a matrix of all pairs.
    Once `few` are left, the matrix is small.
    """
    n = len(mean)
    mean, size = mean.copy(), np.ones(n) if size is None else size.astype(float)
    label, best, top = np.arange(n), np.zeros(n, int), np.zeros(n)
    live = todo = np.arange(n)
    while len(live) > few:
        at, top[todo] = _nearest(mean[todo], todo, mean[live], live)
        best[todo] = live[at]
        live = live[top[live] >= least]
        i = live[(best[best[live]] == live) & (live < best[live])]
        if not len(i):
            if not len(live):
                break
            i = live[[int(top[live].argmax())]]  # a tie by rounding alone
        j = best[i]
        mean[i] = (size[i, None] * mean[i] + size[j, None] * mean[j]) / (size[i] + size[j])[:, None]
        size[i] += size[j]
        to, touched = np.arange(n), np.zeros(n, bool)
        to[j], touched[i], touched[j] = i, True, True
        label = to[label]
        live = live[to[live] == live]
        todo = live[touched[live] | touched[best[live]]]
    to = np.arange(n)
    to[live] = live[_matrix_linkage(mean[live], least, size[live])]
    return to[label]


def nearest_clusters(todo: DataFrame, live: DataFrame, block: int = SIDE) -> DataFrame:
    """(id, top, best): each cluster of `todo` (_g, id, mean) with the one of `live` in its group whose mean is nearest; ties go to the smaller id.

    Both sides are dealt into parts of about `block`, and two parts meet in one task.
    """
    parts = lambda f, name: f.groupBy("_g").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    grid = parts(todo, "_m").join(parts(live, "_n"), "_g")
    tasks = min(4096, grid.agg(F.sum(F.col("_m") * F.col("_n"))).first()[0] or 1)
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = todo.join(grid, "_g").withColumn("_i", place("_m")).withColumn("_j", every("_n")).select("_g", "_i", "_j", "id", "mean").repartition(tasks, "_g", "_i", "_j")
    b = live.join(grid, "_g").withColumn("_j", place("_n")).withColumn("_i", every("_m"))
    b = b.select(F.col("_g").alias("_h"), F.col("_i").alias("_k"), F.col("_j").alias("_l"), F.col("id").alias("other"), F.col("mean").alias("other_mean")).repartition(tasks, "_h", "_k", "_l")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "top": [], "best": []}).astype({"id": "int64", "best": "int64"})
        right = right.sort_values("other")
        names = right["other"].to_numpy()
        best, top = _nearest(_stacked(left["mean"]), left["id"].to_numpy(), _stacked(right["other_mean"]), names)
        return pd.DataFrame({"id": left["id"], "top": top, "best": names[best]})[top > -np.inf]

    met = a.groupBy("_g", "_i", "_j").cogroup(b.groupBy("_h", "_k", "_l")).applyInPandas(meet, "id long, top double, best long")
    return met.groupBy("id").agg(F.min(F.struct((-F.col("top")).alias("t"), "best")).alias("x")).select("id", (-F.col("x.t")).alias("top"), "x.best")


def _merge_round(state: DataFrame, least: float, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(left, done, pairs) after all clusters that are each other's best have merged; those near to none are done."""
    found = nearest_clusters(state.where("todo"), state, block).select(F.col("id").alias("_f"), F.col("top").alias("_t"), F.col("best").alias("_b"))
    fresh = lambda own, new: F.when(F.col("todo"), F.col(new)).otherwise(F.col(own)).alias(own)
    now = scratch.save(state.join(found, F.col("id") == F.col("_f"), "left").select("_g", "id", "n", "mean", fresh("top", "_t"), fresh("best", "_b")), "now")
    near = F.coalesce(F.col("top") >= least, F.lit(False))
    live, done = now.where(near), now.where(~near).select("_g", "id", "n", "mean")
    other = live.select(F.col("id").alias("_f"), F.col("best").alias("_b"))
    pairs = scratch.save(live.join(other, (F.col("best") == F.col("_f")) & (F.col("_b") == F.col("id"))).where("id < best").select(F.col("id").alias("keep"), F.col("best").alias("gone")), "pairs")
    if not pairs.head(1):  # a tie by rounding alone, or nothing is left
        first = live.groupBy("_g").agg(F.min(F.struct((-F.col("top")).alias("t"), F.least("id", "best").alias("keep"), F.greatest("id", "best").alias("gone"))).alias("x"))
        pairs = scratch.save(first.select("x.keep", "x.gone"), "pairs")
    more = pairs.join(live.select(F.col("id").alias("gone"), F.col("n").alias("_n"), F.col("mean").alias("_mean")), "gone").select(F.col("keep").alias("id"), "_n", "_mean")
    touched = pairs.select(F.explode(F.array("keep", "gone")).alias("best"), F.lit(True).alias("_touched"))
    left = live.join(pairs.select(F.col("gone").alias("id")), "id", "left_anti").join(more, "id", "left").join(touched, "best", "left")
    both = F.col("n") + F.col("_n")
    merged = F.col("_n").isNotNull()
    left = left.withColumn("_both", F.zip_with("mean", "_mean", lambda x, y: (x * F.col("n") + y * F.col("_n")) / both))  # before `n` is named anew
    left = left.select("_g", "id", F.when(merged, both).otherwise(F.col("n")).alias("n"), F.when(merged, F.col("_both")).otherwise(F.col("mean")).alias("mean"), "top", "best", (merged | F.col("_touched").isNotNull()).alias("todo"))
    return scratch.save(left, "state"), done, pairs


def themes(rows: DataFrame, by: str, key: str, vector: str, least: float, most: int | None = None, block: int = SIDE, whole: int = WHOLE) -> DataFrame:
    """(by, key, theme, medoid, to_medoid): average-linkage themes within each group; the medoid has the largest mean cosine to its theme.

    Clusters merge while their mean cosine is `least` or more (see `average_linkage`); ties go to the smaller keys.  Equal
    vectors are one cluster from the start.  A group of more than `whole` clusters merges in rounds over tables, in which tasks see
    blocks alone; once it has fewer, a task ends it.  Work grows with the square of a group, memory does not.
    With `most`, a group of more different vectors is refused.
    """
    scratch = Scratch(rows.sparkSession, "themes")
    numbered = running_sums(rows.select(by, key, F.col(vector).cast("array<double>").alias("_v")).withColumn("_one", F.lit(1).cast("long")), [F.col(by), F.col(key)], {"_one": "_id"})
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
    numbered = scratch.save(numbered.withColumn("_len", F.sqrt(dot("_v", "_v"))).select(by, key, "_id", "_len", F.transform("_v", lambda x: x / F.greatest("_len", F.lit(1e-300))).alias("unit")), "numbered")
    groups = numbered.groupBy(F.col(by).alias("_by")).agg(F.min("_id").alias("_g"))
    single = F.col("_len") == 0 if least <= 1 else F.lit(True)  # a null vector is not near to itself
    held = numbered.join(groups, F.col(by).eqNullSafe(F.col("_by"))).drop("_by").withColumn("_own", F.when(single, F.col("_id")).otherwise(-1))
    same = ["_g", "unit", "_own"]
    folded = scratch.save(held.groupBy(*same).agg(F.min("_id").alias("id"), F.count("*").alias("n")), "folded")
    member = scratch.save(held.join(folded.where("n > 1").select(*same, "id"), same, "left").select("_id", F.coalesce("id", "_id").alias("id")), "member")
    state = folded.select("_g", "id", "n", F.col("unit").alias("mean"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("long").alias("best"), F.lit(True).alias("todo"))
    ended, rest, turn = [], [], 0
    while True:
        sizes = state.groupBy("_g").agg(F.count("*").alias("_n"))
        worst = sizes.agg(F.max("_n")).first()[0] or 0
        if most is not None and not turn and worst > most:
            raise ValueError(f"a group or component has {worst} different vectors, more than {most}")
        sized = state.join(sizes, "_g")
        rest.append(sized.where(F.col("_n") <= whole).select("_g", "id", "n", "mean"))
        if worst <= whole:
            break
        state, done, pairs = _merge_round(sized.where(F.col("_n") > whole).drop("_n"), least, block, scratch)
        ended.append(done)
        member = member.join(pairs.withColumnRenamed("gone", "id"), "id", "left").select("_id", F.coalesce("keep", "id").alias("id"))
        turn += 1
        if turn % 6 == 0:
            member = scratch.save(member, "member")
    last = rest[0]
    for f in rest[1:]:
        last = last.unionByName(f)

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("id").reset_index(drop=True)
        mean, n = _stacked(f["mean"]), f["n"].to_numpy()
        label = average_linkage(mean, least, n)
        total, many = np.zeros_like(mean), np.bincount(label, n, len(n)).astype(np.int64)
        np.add.at(total, label, mean * n[:, None])
        own = label == np.arange(len(n))
        return pd.DataFrame({"id": f["id"], "theme": f["id"].to_numpy()[label], "n": many, "mean": [v if o else None for v, o in zip(total / np.maximum(many, 1)[:, None], own, strict=True)]})

    tasks = min(1024, 4 * groups.count() + 1)
    last = scratch.save(last.repartition(tasks, "_g").groupBy("_g").applyInPandas(finish, "id long, theme long, n long, mean array<double>"), "ends")
    final = last.where("id = theme").select("theme", "n", "mean")
    for f in ended:
        final = final.unionByName(f.select(F.col("id").alias("theme"), "n", "mean"))
    of = member.join(last.select("id", "theme"), "id", "left").select("_id", F.coalesce("theme", "id").alias("theme"))
    scored = scratch.save(numbered.join(of, "_id").join(final, "theme").select(by, key, "_id", "unit", "theme", "n", F.round(dot("unit", "mean"), 9).alias("score")), "scored")
    best = scored.groupBy("theme").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("_id").alias("medoid"))).alias("x")).select("theme", "x.medoid")
    named = scored.select(F.col("_id").alias("medoid"), F.col(key).alias("_medoid"), F.col("unit").alias("_unit"))
    best = best.join(named, "medoid").join(scored.select(F.col("_id").alias("theme"), F.col(key).alias("_theme")), "theme").select("theme", "_theme", "_medoid", "_unit")
    near = F.when(F.col("n") == 1, 1.0).otherwise(F.round(dot("unit", "_unit"), 9))
    return scored.join(best, "theme").select(by, key, F.col("_theme").alias("theme"), F.col("_medoid").alias("medoid"), near.alias("to_medoid"))


def density(points: DataFrame, key: str, x: str, y: str, bandwidth: float, tolerance: float = 1e-12, block: int = BLOCK) -> DataFrame:
    """(key, density): a Gaussian kernel density at each point, over all points.

    Space is tiled by the distance at which the kernel falls below `tolerance` of its
    height; a tile's points meet those of the nine tiles around, equal points folded into one with a
    count.  Full tiles are dealt in blocks.  What lies further adds less than `tolerance` a point
    of the kernel's height.  Points with a null coordinate are left out.
    """
    wide = bandwidth * math.sqrt(2 * math.log(1 / tolerance))
    rows = points.select(F.col(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    places = rows.groupBy("x", "y").agg(F.count("*").alias("w")).withColumns({"cx": F.floor(F.col("x") / wide), "cy": F.floor(F.col("y") / wide)})
    places = Scratch(points.sparkSession, "density").save(places, "places")
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    halo = places.withColumn("dx", around).withColumn("dy", around).select((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), F.col("x").alias("px"), F.col("y").alias("py"), "w")
    many = lambda f, name: f.groupBy("cx", "cy").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    grid = many(places, "_an").join(many(halo, "_bn"), ["cx", "cy"])
    deal = lambda f, p, own, other, i, j: f.join(grid, ["cx", "cy"]).withColumn(i, F.pmod(F.xxhash64(*p), F.col(own)).cast("int")).withColumn(j, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    a, b = deal(places, ["x", "y"], "_an", "_bn", "i", "j"), deal(halo, ["px", "py"], "_bn", "_an", "j", "i")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        p, q, w = left[["x", "y"]].to_numpy(), right[["px", "py"]].to_numpy(), right["w"].to_numpy()
        out = np.zeros(len(p))
        for k in range(0, len(p), 256):
            d = ((p[k : k + 256, None, :] - q[None, :, :]) ** 2).sum(2)
            out[k : k + 256] = np.exp(-d / (2 * bandwidth**2)) @ w
        return pd.DataFrame({"x": p[:, 0], "y": p[:, 1], "s": out})

    at = ["cx", "cy", "i", "j"]
    names = [f"{c}_" for c in at]  # own names, since both sides come from one table
    sums = a.select(*at, "x", "y").groupBy(*at).cogroup(b.select(*[F.col(c).alias(f"{c}_") for c in at], "px", "py", "w").groupBy(*names)).applyInPandas(meet, "x double, y double, s double").groupBy("x", "y").agg(F.sum("s").alias("s"))
    n = rows.agg(F.count("*").alias("n"))
    out = rows.join(sums, ["x", "y"]).join(F.broadcast(n))  # one row
    return out.select(key, (F.col("s") / (2 * math.pi * bandwidth**2 * F.col("n"))).alias("density"))


def svd(weights: DataFrame, row: str, column: str, value: str, rank: int, rounds: int = 6, extra: int = 6, seed: str = "27") -> tuple[np.ndarray, DataFrame, DataFrame]:
    """(singular values, rows' coordinates, columns' directions) of a sparse matrix given as (row, column, value), largest first.

    Block power iteration: every round multiplies by the matrix and its transpose, as two
    joins on a key and sums with a map side, and makes the block orthonormal by the inverse root of its
    Gram matrix.  The driver sees matrices of rank + extra columns squared alone.
    Coordinates (row, c0, c1, ...) are left vectors times singular values; directions
    (column, v0, v1, ...) are orthonormal.  Values beyond the matrix's own rank are zero and
    their directions null vectors.
    """
    k = rank + extra
    scratch = Scratch(weights.sparkSession, "svd")
    held = scratch.save(weights.select(F.col(row).alias("r"), F.col(column).alias("c"), F.col(value).cast("double").alias("w")), "matrix")
    names = [f"v{i}" for i in range(k)]
    lot = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(str(i)), F.col("c").cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48) - 0.5
    block = held.select("c").distinct().select("c", *[lot(i).alias(n) for i, n in enumerate(names)])

    def times(block: DataFrame, own: str, other: str) -> DataFrame:
        return held.join(block, own).groupBy(other).agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in names])

    def gram(block: DataFrame) -> np.ndarray:
        got = block.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        out = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                out[i, j] = out[j, i] = got[f"{i}_{j}"] or 0.0
        return out

    def turned(block: DataFrame, key: str, m: np.ndarray, to: Sequence[str]) -> DataFrame:
        return block.select(key, *[sum((float(m[i, j]) * F.col(names[i]) for i in range(k)), F.lit(0.0)).alias(n) for j, n in enumerate(to)])

    def root(g: np.ndarray) -> np.ndarray:
        """A matrix whose product with a block of Gram matrix g is orthonormal; columns without length become zero."""
        value, vector = np.linalg.eigh(g)
        keep = value > max(value.max(), 0) * 1e-14
        return vector * np.where(keep, 1 / np.sqrt(np.where(keep, value, 1)), 0)

    for i in range(rounds):
        block = scratch.save(turned(block, "c", root(gram(block)), names), f"basis{i}")
        left = scratch.save(times(block, "c", "r"), f"left{i}")
        if i + 1 < rounds:
            block = scratch.save(times(left, "r", "c"), f"right{i}")
    value, vector = np.linalg.eigh(gram(left))
    order = np.argsort(-value)[:rank]
    found = np.sqrt(np.maximum(value[order], 0))
    m = vector[:, order]
    rows = turned(left, "r", m, [f"c{i}" for i in range(rank)]).withColumnRenamed("r", row)
    return found, rows, turned(block, "c", m, names[:rank]).withColumnRenamed("c", column)
