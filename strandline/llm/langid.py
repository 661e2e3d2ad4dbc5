"""Language identification by interpolated Kneser-Ney character models.

One model of order five per language.  Letters are lower-cased, everything else
becomes one space, and a text is padded with spaces, so each letter has a full
context.  An n-gram is packed into one integer (twelve bits a character; rarer
code points are folded into that range), and the n-grams of all languages lie
in one array sorted by hash, with a column of log probabilities a language.
Where a language has not seen an n-gram, its column holds the interpolated
back-off already, so one probe serves all languages.

Four fifths of all labelled rows are counted, summed within tasks first.  An
n-gram whose share of its language is too small counts as unseen and its mass
goes to the back-off, so that all models together hold GRAMS n-grams of an order
at most, however much text was counted.

The language with the lowest cross-entropy per character wins.  A text is
rejected when it has no letter, or when that cross-entropy lies above the
language's limit, with slack that shrinks with length.  The limit comes from the
other fifth of the rows: halfway from the most that the language's own texts
need (QUANTILE) to the least that texts of the other languages need (FOREIGN)
which would win here if their own language were not learnt.

Cases: a null text, an empty text and one without letters give `und`, score 0
and are rejected.  With no training rows every text gives `und`.  Rows repeat
as often as they come; ties go to the language that sorts first.  Any length.
A language with fewer than ROWS calibration rows takes the limits pooled over
all languages; where there is no calibration row at all, DEFAULT holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from . import textvec as tv
from .samples import remainder

ORDER = 5
BITS = 12
SPACE = 32
MASK = [(1 << (BITS * k)) - 1 for k in range(ORDER + 1)]
#: N-grams of an order that the models of all languages hold together, at most.
GRAMS = 1 << 23
#: Counts that a task holds before it gives some out.
FLUSH = 500_000
QUANTILE, FOREIGN = 0.995, 0.01
ROWS = 20
#: Cross-entropy and slack where nothing could be measured.
DEFAULT = (4.0, 8.0)


def _code(c: str) -> int:
    x = ord(c.lower()[0])
    return x if x < 2048 else 2048 + (x * 2654435761 >> 7) % 2048


@cache
def _codes() -> np.ndarray:
    """Twelve-bit code of each code point up to 0xFFFF: its lower-case letter, or a space."""
    out = np.full(0x10000, SPACE, np.uint16)
    for i in range(0x10000):
        if chr(i).isalpha():
            out[i] = _code(chr(i))
    return out


def letters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, row) of a chunk: padded rows, runs of other characters as one space."""
    lead = (buf & 0xC0) != 0x80
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(lead)])[offs]
    if len(points) != at[-1]:
        raise ValueError("texts are not UTF-8")
    table = _codes()
    big = points > 0xFFFF
    codes = table[np.where(big, 0, points)]
    if big.any():  # beyond the first plane few code points come up, so each is asked by itself
        some, at_some = np.unique(points[big], return_inverse=True)
        codes[big] = np.array([_code(chr(x)) if chr(x).isalpha() else SPACE for x in some.tolist()], np.uint16)[at_some]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE) | (row[1:] != row[:-1])
    return codes[keep], row[keep]


def grams(codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The key of the n-gram that ends at each code; contexts do not cross rows."""
    key = codes.astype(np.int64)
    out = key.copy()
    for k in range(1, ORDER):
        back = np.full(len(key), SPACE, np.int64)
        if len(key) > k:
            same = row[k:] == row[:-k]
            back[k:] = np.where(same, key[:-k], SPACE)
        out |= back << (BITS * k)
    return out


@dataclass
class Model:
    langs: list[str]
    uni: np.ndarray  # log2 P of a code, a column a language
    index: list[tv.Sorted]  # of the n-grams of orders 2 up
    logp: list[np.ndarray]
    context: list[tv.Sorted]
    back: list[np.ndarray]
    limit: np.ndarray  # rejection: cross-entropy above mean + limit / sqrt(length)
    mean: np.ndarray

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log2 P of each n-gram's last character, a column a language."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        left = np.arange(len(keys))
        for n in range(ORDER, 1, -1):
            at = self.index[n - 2].find(keys[left] & MASK[n])
            hit = at >= 0
            out[left[hit]] += self.logp[n - 2][at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            at = self.context[n - 2].find((keys[left] & MASK[n]) >> BITS)
            hit = at >= 0
            out[left[hit]] += self.back[n - 2][at[hit]]
        out[left] += self.uni[keys[left] & MASK[1]]
        return out


#: Of one order: keys in order, their counts, and the counts of their contexts with what is left out.
Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def _kneser_ney(levels: list[Level]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For orders 1 up: keys, discounted share of each, contexts, weight that each context leaves to the lower order."""
    out = []
    for keys, counts, totals in levels:
        if not len(keys):
            out.append((keys, np.zeros(0), keys, np.zeros(0)))
            continue
        context = keys >> BITS
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        total = totals[starts].astype(np.float64)
        n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        share = np.maximum(counts - d, 0) / totals
        left = 1 - np.add.reduceat(share, starts)
        out.append((keys, share, context[starts], np.maximum(left, d / total)))
    return out


def levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Counts of all orders from those of the highest: a shorter n-gram counts the characters that come before it."""
    out = []
    for n in range(ORDER, 0, -1):
        context = keys >> BITS
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        out.append((keys, counts, np.repeat(np.add.reduceat(counts, starts), np.diff(np.append(starts, len(keys))))))
        if n > 1:
            keys, counts = np.unique(keys & MASK[n - 1], return_counts=True)
    return out[::-1]


def train(counts: dict[str, list[Level]]) -> Model:
    """counts: for each language the levels of orders 1 up."""
    langs = sorted(counts)
    per = [_kneser_ney(counts[x]) for x in langs]
    uni = np.zeros((1 << BITS, len(langs)))
    for i, orders in enumerate(per):
        keys, share, _, left = orders[0]
        uni[:, i] = left[0] / (1 << BITS)
        uni[keys, i] += share
    index, logp, context, back = [], [], [], []
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def below(n: int, keys: np.ndarray) -> np.ndarray:
        """Probabilities by order n: what is not held backs off."""
        if n == 1:
            return uni[keys & MASK[1]]
        held, p, contexts, weight = made[n - 2]
        out = np.zeros((len(keys), len(langs)))
        at = np.minimum(np.searchsorted(held, keys), max(len(held) - 1, 0))
        hit = held[at] == keys if len(held) else np.zeros(len(keys), bool)
        out[hit] = p[at[hit]]
        rest = keys[~hit]
        if len(rest):
            w = np.ones((len(rest), len(langs)))
            if len(contexts):
                at = np.minimum(np.searchsorted(contexts, rest >> BITS), len(contexts) - 1)
                same = contexts[at] == rest >> BITS
                w[same] = weight[at[same]]
            out[~hit] = w * below(n - 1, rest & MASK[n - 1])
        return out

    for n in range(2, ORDER + 1):
        keys = np.unique(np.concatenate([o[n - 1][0] for o in per]))
        ctx = np.unique(np.concatenate([o[n - 1][2] for o in per]))
        weight = np.ones((len(ctx), len(langs)))
        p = np.zeros((len(keys), len(langs)))
        for i, o in enumerate(per):
            k, share, c, left = o[n - 1]
            weight[np.searchsorted(ctx, c), i] = left
            p[np.searchsorted(keys, k), i] = share
        if len(keys):
            p += weight[np.searchsorted(ctx, keys >> BITS)] * below(n - 1, keys & MASK[n - 1])
        made.append((keys, p, ctx, weight))
        found, where = tv.Sorted.of(keys), tv.Sorted.of(ctx)
        index.append(found)
        logp.append(np.log2(p[found.order]).astype(np.float32))
        context.append(where)
        back.append(np.log2(np.maximum(weight[where.order], 1e-12)).astype(np.float32))
    return Model(langs, np.log2(uni).astype(np.float32), index, logp, context, back, np.full(len(langs), np.inf), np.zeros(len(langs)))


def entropies(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, scored characters, cross-entropy of each language) of every row."""
    n = len(column)
    many, seen, ce = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, len(model.langs)))
    for a, b, buf, offs in tv.chunks(column):
        codes, row = letters(buf, offs)
        at = tv.ptr(row, b - a)
        many[a:b] = tv.row_sums(codes != SPACE, at)
        seen[a:b] = np.diff(at)
        ce[a:b] = -tv.row_sums(model.score(grams(codes, row)), at) / np.maximum(np.diff(at), 1)[:, None]
    return many, seen, ce


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of distinct keys, summed."""
    k, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[starts], np.add.reduceat(n, starts)


def _count(langs: list[str]):
    """(lang, key, n): how often each n-gram of order five came in each language, summed as far as a task can hold."""

    def out(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            k, n = _sum(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), lang, np.int32)), pa.array(k), pa.array(n)], ["lang", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        many = 0
        for batch in batches:
            own = pc.index_in(batch.column("lang"), pa.array(langs, pa.string())).to_numpy(zero_copy_only=False)
            for a, b, buf, offs in tv.chunks(batch.column("text")):
                codes, row = letters(buf, offs)
                keys = grams(codes, row)
                for lang in np.unique(own[a:b]).tolist():
                    k, n = np.unique(keys[(own[a:b] == lang)[row]], return_counts=True)
                    if len(k):
                        held.setdefault(lang, []).append((k, n.astype(np.int64)))
                        many += len(k)
                if many > 2 * FLUSH:
                    held = {lang: [_sum(parts)] for lang, parts in held.items()}
                    many = sum(len(parts[0][0]) for parts in held.values())
                    if many > FLUSH:
                        yield from out(held)
                        held, many = {}, 0
        yield from out(held)
        tv.release()

    return run


def _counts(rows: DataFrame, langs: list[str], scratch: Scratch, most: int) -> dict[str, list[Level]]:
    """For each language and order the n-grams that are frequent enough, `most` together at most in an order."""
    level = tv.arrow(rows.select("text", "lang")).mapInArrow(_count(langs), "lang int, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    out: dict[str, list[Level]] = {}
    for n in range(ORDER, 0, -1):
        level = scratch.save(level, f"grams{n}")
        totals = {r.lang: r.n for r in level.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        if not totals:
            return {}
        least = F.element_at(F.create_map(*[F.lit(x) for lang, total in totals.items() for x in (lang, total * len(totals) / most)]), F.col("lang"))
        context = F.shiftright("key", BITS).alias("context")
        of_context = level.groupBy("lang", context).agg(F.sum("n").alias("total"))
        kept = level.where(F.col("n") >= least).select("*", context).join(of_context, ["lang", "context"])
        got = kept.select("lang", "key", "n", "total").toArrow()
        lang, *columns = (got[c].to_numpy() for c in ("lang", "key", "n", "total"))
        for i in totals:
            own = np.flatnonzero(lang == i)
            own = own[np.argsort(columns[0][own])]
            out.setdefault(langs[i], []).insert(0, tuple(c[own] for c in columns))
        level = level.groupBy("lang", F.col("key").bitwiseAND(F.lit(MASK[n - 1])).alias("key")).agg(F.count("*").alias("n"))
    return out


def _calibrate(rows: DataFrame, model: Model, scratch: Scratch) -> None:
    """Sets the limits of rejection from texts that were not counted."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            many, seen, ce = entropies(batch.column("text"), m)
            own = np.array([m.langs.index(x) if x in m.langs else -1 for x in batch.column("lang").to_pylist()], np.int32)
            ok = np.flatnonzero((many > 0) & (own >= 0))
            own, ce = own[ok], ce[ok]
            each = np.arange(len(ok))
            least = ce[each, own]
            if len(m.langs) > 1:
                ce[each, own] = np.inf
            other = ce.argmin(1) if len(ok) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[ok]), pa.array(least), pa.array(other.astype(np.int32)), pa.array(ce[each, other])], ["own", "n", "ce", "other", "ce_other"])
        tv.release()

    got = scratch.save(tv.arrow(rows.select("text", "lang")).mapInArrow(run, "own int, n long, ce double, other int, ce_other double"), "calibration")
    middle = {r.own: (r.k, r.m) for r in got.groupBy("own").agg(F.count("*").alias("k"), F.percentile_approx("ce", 0.5, 10_000).alias("m")).collect()}
    enough = {i: m for i, (k, m) in middle.items() if k >= ROWS}
    pooled = sum(k * m for k, m in middle.values()) / max(sum(k for k, _ in middle.values()), 1) if middle else DEFAULT[0]
    model.mean[:] = [enough.get(i, pooled) for i in range(len(model.langs))]
    mean = lambda c: F.element_at(F.array(*[F.lit(float(x)) for x in model.mean]), F.col(c) + 1)
    root = F.sqrt(F.col("n").cast("double"))
    z = got.select("own", "other", ((F.col("ce") - mean("own")) * root).alias("z"), ((F.col("ce_other") - mean("other")) * root).alias("far"))
    near = {r.own: r.z for r in z.groupBy("own").agg(F.percentile_approx("z", QUANTILE, 10_000).alias("z")).collect()}
    far = {r.other: r.z for r in z.where("own <> other").groupBy("other").agg(F.percentile_approx("far", FOREIGN, 10_000).alias("z")).collect()}
    pool = max(near.values(), default=DEFAULT[1])
    for i in range(len(model.langs)):
        low = max(near[i] if i in enough else pool, 1.0)
        model.limit[i] = low + max(far.get(i, low) - low, 0.0) / 2
    held.destroy()


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = GRAMS) -> Model | None:
    """Models of all languages of `rows`; None if there is nothing to learn from."""
    rows = rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).alias("key")).where("text is not null and lang is not null")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    fold = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(5))
    scratch = Scratch(rows.sparkSession, "langid")
    counts = _counts(rows.where(fold != 0), langs, scratch, most)
    model = train(counts) if counts else None
    if model:
        _calibrate(rows.where(fold == 0), model, scratch)
    scratch.keep()
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, only_known: bool = False) -> DataFrame:
    """`docs` (its columns `keep`, all by default) with lang_pred, score (0 to 1), cross_entropy and rejected.

    only_known: rejected rows go, and the columns stay those of `docs`.
    """
    own = [f for f in docs.schema.fields if keep is None or f.name in keep]
    made = ["lang_pred", "score", "cross_entropy", "rejected"]
    kept = [f.name for f in own if only_known or f.name not in made]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            n = batch.num_rows
            best, score, least, out = np.array(["und"] * n, object), np.zeros(n), np.zeros(n), np.ones(n, bool)
            if m is not None and n:
                many, seen, ce = entropies(batch.column(text), m)
                ok = many > 0
                first = ce.argmin(1)
                least = np.where(ok, ce.min(1), 0.0)
                best[ok] = np.array(m.langs, object)[first[ok]]
                w = np.exp2(-(ce - ce.min(1, keepdims=True)) * np.minimum(seen, 32)[:, None])
                score = np.where(ok, 1 / w.sum(1), 0.0)
                out = ~ok | (ce.min(1) > m.mean[first] + m.limit[first] / np.sqrt(np.maximum(seen, 1)))
            if only_known:
                yield batch.select(kept).filter(pa.array(~out))
                continue
            made_columns = [pa.array(best, pa.string()), pa.array(score), pa.array(least), pa.array(out)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made_columns], [*kept, *made])
        tv.release()

    columns = list(dict.fromkeys([*kept, text]))
    schema = docs.select(*kept).schema if kept else docs.select().schema
    if not only_known:
        for name, kind in zip(made, ("string", "double", "double", "boolean"), strict=True):
            schema = schema.add(name, kind)
    return tv.arrow(docs.select(*columns)).mapInArrow(run, schema)


def op1_langid(docs: DataFrame) -> DataFrame:
    """Language of every whole text, learnt from rows that are not held out."""
    held_out = remainder("doc_id", 4) == 2
    model = fit(docs.where(~held_out))
    return predict(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
