"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

Inputs of a text: its hashed words (log counts, scaled to length one), standardised
statistics of its structure, and metadata (buckets of its length in bytes, words
and lines).  The pairwise term is taken by the sum-of-squares identity
    1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2),
so scoring is linear in the number of inputs.  The model has a fixed size
(2^15 words by 9 floats), so it is broadcast.

Cases: null and empty texts have zero words and the statistics of an empty text.
Without training rows every score is 0.  Repeated rows score alike, and equal
scores stay equal; any length.  Keys may have any type; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from . import textvec as tv
from .samples import labelled, remainder, within_bytes

BITS = 15
RANK = 8
STATS = 16
BUCKETS = 24
#: Labelled rows of either class that the fit reads, at most.
SAMPLE = 3000
#: Bytes of inputs that the fit takes to the driver, at most; texts beyond that are left out of the sample.
BYTES = 96 << 20
EPOCHS = 12

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = ~tv.NON_WORD
_ALPHA[48:58] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def inputs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bins, values, row) of the words, statistics of each row, and its metadata buckets."""
    rows = len(offs) - 1
    w = tv.words(buf, offs)
    row = np.repeat(np.arange(rows), w.counts)
    n_words = w.counts.astype(np.float64)
    n_bytes = np.diff(offs).astype(np.float64)
    byte_share = [tv.row_sums(flags[buf].astype(np.int8), offs) / np.maximum(n_bytes, 1) for flags in (_UPPER, _ALPHA, _DIGIT, tv.SPACE)]
    line_of = np.concatenate([[0], np.cumsum(buf == 10)])
    n_lines = (line_of[offs[1:]] - line_of[offs[:-1]]).astype(np.float64)
    punct = tv.row_sums((tv.NON_WORD & ~tv.SPACE)[buf].astype(np.int8), offs) / np.maximum(n_bytes, 1)
    length = (w.end - w.start).astype(np.float64)
    mean_word = tv.row_sums(length, w.ptr) / np.maximum(n_words, 1)
    long_word = tv.row_sums(length > 20, w.ptr) / np.maximum(n_words, 1)
    repeat = np.zeros(len(row))
    if len(row) > 1:
        repeat[1:] = (w.h[1:] == w.h[:-1]) & (row[1:] == row[:-1])
    upper_word = tv.row_sums(_UPPER[buf[np.minimum(w.start + 1, max(len(buf) - 1, 0))]], w.ptr) if len(buf) else np.zeros(rows)
    odd_end = tv.row_sums((tv.NON_WORD & ~tv.SPACE)[buf[w.end - 1]], w.ptr) / np.maximum(n_words, 1) if len(buf) else np.zeros(rows)
    key, count = np.unique((row.astype(np.uint64) << np.uint64(40)) | (w.h >> np.uint64(24)), return_counts=True)
    own = (key >> np.uint64(40)).astype(np.int64)
    bins = ((key & np.uint64((1 << 40) - 1)) >> np.uint64(40 - BITS)).astype(np.int64)
    distinct = np.bincount(own, minlength=rows) / np.maximum(n_words, 1)
    top = np.zeros(rows)
    np.maximum.at(top, own, count)
    grams, gram_row = tv.distinct(*tv.shingles(w, 3))
    fresh = np.bincount(gram_row, minlength=rows) / np.maximum(n_words - 2, 1)
    stats = np.column_stack([*byte_share, punct, mean_word, long_word, tv.row_sums(repeat, w.ptr) / np.maximum(n_words, 1), upper_word / np.maximum(n_words, 1), odd_end, distinct, top / np.maximum(n_words, 1), fresh, np.log1p(n_words), n_lines / np.maximum(n_words, 1), np.log1p(n_bytes)])
    meta = np.column_stack([np.minimum(np.log2(n + 1).astype(np.int64), BUCKETS - 1) + i * BUCKETS for i, n in enumerate((n_bytes, n_words, n_lines))])
    value = np.log1p(count.astype(np.float64))
    norm = np.sqrt(np.bincount(own, value**2, rows))
    return bins, value / np.maximum(norm, 1e-9)[own], own, stats, meta


def rows_of(bins: np.ndarray, value: np.ndarray, own: np.ndarray, stats: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All inputs as (index, value, row), by row; stats are standardised already."""
    rows = len(stats)
    base = 1 << BITS
    index = np.concatenate([bins, np.tile(base + np.arange(STATS), rows), (base + STATS + meta).ravel()])
    values = np.concatenate([value, stats.ravel(), np.full(meta.size, 0.5)])
    row = np.concatenate([own, np.repeat(np.arange(rows), STATS), np.repeat(np.arange(rows), meta.shape[1])])
    order = np.argsort(row, kind="stable")
    return index[order], values[order], row[order]


def raw(index: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(score before the logistic, sum of v x for each row and factor)."""
    at = tv.ptr(row, rows)
    vx = m.factors[index] * value[:, None]
    sums = tv.row_sums(vx, at)
    squares = tv.row_sums(vx * vx, at)
    return m.bias + np.bincount(row, m.linear[index] * value, rows) + 0.5 * (sums**2 - squares).sum(1), sums


def train(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, l2: float = 1e-4, seed: int = 5) -> Model:
    """AdaGrad over minibatches; docs are (bins, values, stats, buckets)."""
    rng = np.random.default_rng(seed)
    stats = np.array([d[2] for d in docs])
    mean, scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    size = (1 << BITS) + STATS + 3 * BUCKETS
    m = Model(float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(size), rng.normal(0, 0.02, (size, RANK)), mean, scale)
    g_lin, g_fac, g_bias = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for part in np.array_split(order, max(1, len(order) // 64)):
            own = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
            std = np.clip((stats[part] - mean) / scale, -5, 5) / 2
            index, value, row = rows_of(np.concatenate([docs[i][0] for i in part]), np.concatenate([docs[i][1] for i in part]), own, std, np.array([docs[i][3] for i in part]))
            z, sums = raw(index, value, row, len(part), m)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            bias = g.sum()
            used, inverse = np.unique(index, return_inverse=True)
            gx = g[row] * value
            lin = np.bincount(inverse, gx, len(used)) + l2 * m.linear[used]
            each = gx[:, None] * (sums[row] - m.factors[index] * value[:, None])
            fac = np.column_stack([np.bincount(inverse, each[:, f], len(used)) for f in range(RANK)]) + l2 * m.factors[used]
            g_lin[used] += lin**2
            g_fac[used] += fac**2
            g_bias += bias**2
            m.linear[used] -= rate * lin / np.sqrt(g_lin[used])
            m.factors[used] -= rate * fac / np.sqrt(g_fac[used])
            m.bias -= rate * bias / g_bias**0.5
    m.linear, m.factors = m.linear.astype(np.float32), m.factors.astype(np.float32)
    return m


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, y = batch.column("key"), batch.column("y")
        for a, b, buf, offs in tv.chunks(batch.column("text")):
            bins, value, own, stats, meta = inputs(buf, offs)
            at = tv.ptr(own, b - a)
            packed = [[x[at[i] : at[i + 1]].tobytes() for i in range(b - a)] for x in (bins.astype(np.uint16), value.astype(np.float32))]
            fixed = [[x[i].tobytes() for i in range(b - a)] for x in (stats, meta)]
            yield pa.RecordBatch.from_arrays([key.slice(a, b - a), y.slice(a, b - a), *(pa.array(x, pa.binary()) for x in (*packed, *fixed))], ["key", "y", "bins", "vals", "stats", "meta"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Fits a sample bounded to `sample` rows of either label and to BYTES of inputs; None without rows."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = labelled(docs, labels, label, sample, text, key)
    rows = scratch.save(tv.arrow(rows.select(F.xxhash64("key").alias("key"), "text", "y")).mapInArrow(_examples, "key long, y int, bins binary, vals binary, stats binary, meta binary"), "examples")
    got = within_bytes(rows, ["bins", "vals"], "key", BYTES).toArrow().sort_by([("key", "ascending"), ("y", "ascending"), ("stats", "ascending")])
    scratch.keep()
    if not got.num_rows:
        return None
    kinds = {"bins": np.uint16, "vals": np.float32, "stats": np.float64, "meta": np.int64}
    columns = [[np.frombuffer(x.as_py(), kind) for x in got[c]] for c, kind in kinds.items()]
    return train([(b.astype(np.int64), v.astype(np.float64), s, m) for b, v, s, m in zip(*columns, strict=True)], got["y"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all of `docs` but one named score by default), and score from 0 to 1."""
    own_columns = [c for c in docs.columns if c != "score" and (keep is None or c in keep)]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if m is not None:
                for a, b, buf, offs in tv.chunks(batch.column(text)):
                    bins, value, own, stats, meta = inputs(buf, offs)
                    std = np.clip((stats - m.mean) / m.scale, -5, 5) / 2
                    z, _ = raw(*rows_of(bins, value, own, std, meta), b - a, m)
                    out[a:b] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own_columns), pa.array(out)], [*own_columns, "score"])
        tv.release()

    return tv.arrow(docs.select(*dict.fromkeys([*own_columns, text]))).mapInArrow(run, docs.select(*own_columns).schema.add("score", "double"))


def op3_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every whole text, learnt from labelled rows that are not held out."""
    model = fit(docs, labels.where(remainder("doc_id", 4) != 2))
    return score(docs, model, keep=["doc_id"]).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
