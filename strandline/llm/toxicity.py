"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct unigrams, bigrams and one-word skip-grams of a
lower-cased text, hashed into 2^20 bins; each has its own learning rate, and L1
keeps most weights at zero.  The model is one float32 array (4 MB at any input
size), so it is broadcast.

Cases: null and empty texts have no feature and score the bias alone.  Without
training rows every score is 0.  Repeated rows score alike; any length.  Keys
may have any type; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from . import textvec as tv
from .samples import labelled, remainder, within_bytes

BITS = 20
#: Labelled rows of either class that the fit reads, at most.
SAMPLE = 6000
#: Bytes of features that the fit takes to the driver, at most; texts beyond that are left out of the sample.
BYTES = 96 << 20
EPOCHS = 10


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, row) of every unigram, bigram and skip-gram, with repeats."""
    w = tv.words(buf, offs, tv.NON_WORD)
    row = np.repeat(np.arange(len(offs) - 1), w.counts)
    shift = np.uint64(64 - bits)
    bins, rows = [w.h >> shift], [row]
    for gap, salt in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        if len(row) > gap:
            same = row[gap:] == row[:-gap]
            h = tv.mix(w.h[:-gap][same] * np.uint64(salt) + w.h[gap:][same])
            bins.append(h >> shift)
            rows.append(row[gap:][same])
    return np.concatenate(bins).astype(np.int64), np.concatenate(rows)


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, y = batch.column("key"), batch.column("y")
        for a, b, buf, offs in tv.chunks(_lower(batch.column("text"))):
            bins, row = features(buf, offs)
            bins, row = tv.distinct(bins.astype(np.uint64), row)
            at = tv.ptr(row, b - a)
            packed = bins.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([key.slice(a, b - a), y.slice(a, b - a), pa.array([packed[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())], ["key", "y", "bins"])


def ftrl(examples: list[tuple[int, np.ndarray]], bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 16.0, l2: float = 0.01, epochs: int = EPOCHS) -> Model:
    """Per-coordinate FTRL-proximal over (label, distinct bins), in the order given; the bias is not regularised."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for y, at in examples:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            b = -zb * alpha / (beta + nb**0.5)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    return Model(weights(z, n).astype(np.float32), float(-zb * alpha / (beta + nb**0.5)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Fits a sample bounded to `sample` rows of either label and to BYTES of features; None without rows."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = labelled(docs, labels, label, sample, text, key)
    rows = scratch.save(tv.arrow(rows.select(F.xxhash64("key").alias("key"), "text", "y")).mapInArrow(_examples, "key long, y int, bins binary"), "examples")
    got = within_bytes(rows, ["bins"], "key", BYTES).toArrow()
    scratch.keep()
    if not got.num_rows:
        return None
    y = got["y"].to_numpy()
    packed = got["bins"]
    order = np.lexsort((np.array([zlib.crc32(x.as_py()) for x in packed]), y, got["key"].to_numpy()))
    return ftrl([(int(y[i]), np.frombuffer(packed[int(i)].as_py(), np.uint32).astype(np.int64)) for i in order])


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all of `docs` but one named score by default), and score from 0 to 1."""
    own = [c for c in docs.columns if c != "score" and (keep is None or c in keep)]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if m is not None:
                for a, b, buf, offs in tv.chunks(_lower(batch.column(text))):
                    bins, row = features(buf, offs)
                    hit = m.weights[bins] != 0
                    bins, row = tv.distinct(bins[hit].astype(np.uint64), row[hit])
                    total = np.bincount(row, m.weights[bins.astype(np.int64)], b - a)
                    out[a:b] = 1 / (1 + np.exp(-np.clip(total + m.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(out)], [*own, "score"])
        tv.release()

    return tv.arrow(docs.select(*dict.fromkeys([*own, text]))).mapInArrow(run, docs.select(*own).schema.add("score", "double"))


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every whole text, learnt from labelled rows that are not held out."""
    model = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    return score(docs, model, keep=["doc_id"]).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
