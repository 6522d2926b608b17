"""Toxicity: a factorization machine over hashed terms.

A document is the set of its distinct lower-cased words, hashed to 2**BITS
buckets.  Its logit is

    w0 + sum_j w_j + 1/2 sum_f ((sum_j v_jf)**2 - sum_j v_jf**2)

over its buckets j, so a pair of terms (an insult and a group, say) counts
beyond the sum of its parts, also where neither counts alone.  The machine is
fitted in one task on a bounded sample of labelled rows (SAMPLE), in two steps.
First the weights alone are fitted; FTRL-proximal steps keep terms without
evidence at 0, so that a long clean text gathers no noise.  Then the gradients of
all pairs at v = 0 are summed over the rows: a term takes part in the factors if
its weight has left 0, or if the gradient of one of its pairs is beyond chance
and isn't explained by either term alone.  Weights and the factors of those
terms are then fitted together, and the others are left out.  Scoring is one
narrow pass.

Defined cases: a text without words (null, empty) has a margin of at most -1, so
it is never rejected; a
repeated row is scored like any other; a null doc_id is carried; no labelled
rows gives a model that rejects nothing; other columns pass through untouched.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import chunks, words
from .common import labelled

BITS = 18
FACTORS = 8
EPOCHS = 5
#: A term needs this share of the fitted rows (at least 2) to count.
MIN_DF = 3e-4
#: A term leaves 0 when its gradient, summed over a pass of the rows, passes both L1 and so many deviations: chance alone then hardly reaches it, however many rows, passes or terms there are.
L1 = 1.0
SIGMAS = 2.0
#: The same for pairs of terms, of which there are many more.
PAIR_L1 = 12.0
PAIR_SIGMAS = 7.0
#: Weight of recall against precision in the choice of the threshold: clean documents are dearer.
CAUTION = 0.5
#: Terms of one side of a block of pairs.
BLOCK = 1024
#: Labelled rows used for the fit, at most about so many.
SAMPLE = 20_000


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): distinct buckets of each document, in order."""
    out, counts = [], []
    for _, part in chunks(column):
        w = words(part)
        key = np.unique((w.doc.astype(np.uint64) << np.uint64(BITS)) | (w.code >> np.uint64(64 - BITS)))
        counts.append(np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=len(part)))
        out.append((key & np.uint64((1 << BITS) - 1)).astype(np.int32))
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(counts)])


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; 0 for an empty run."""
    c = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return c[offsets[1:]] - c[offsets[:-1]]


def logits(model: dict, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    slot = model["slot"][buckets]
    live = slot >= 0
    off = np.concatenate([[0], np.cumsum(live)])[offsets]
    slot = slot[live]
    w, v = model["w"][slot], model["v"][slot]
    s = _sums(v, off)
    return model["w0"] + _sums(w, off) + 0.5 * (s * s - _sums(v * v, off)).sum(axis=1)


def pairs_beyond_chance(s: np.ndarray, offsets: np.ndarray, rows: np.ndarray, err: np.ndarray, n: int, l1: float = PAIR_L1, sigmas: float = PAIR_SIGMAS) -> np.ndarray:
    """Whether each of n terms is in a pair whose gradient at v = 0, the sum of ``err`` over the rows with both terms, is beyond chance.

    ``s``: the term of each occurrence, -1 for none; ``err``: the error of each of ``rows``.  From a
    pair's gradient goes what either term's own gradient leads one to expect, so
    that a weight not fitted out isn't taken for an interaction.  A term whose
    errors of one sign sum to less than ``l1`` can't be in such a pair.
    """
    at = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), offsets[rows + 1] - offsets[rows])
    keep = s[at] >= 0
    j, doc = s[at][keep], doc[keep]
    over, under = np.bincount(j, np.maximum(err, 0)[doc], n), np.bincount(j, np.maximum(-err, 0)[doc], n)
    possible = np.flatnonzero(np.maximum(over, under) >= l1)
    out = np.zeros(n, bool)
    number = np.full(n, -1)
    number[possible] = np.arange(len(possible))
    keep = number[j] >= 0
    j, doc = number[j][keep], doc[keep]
    order = np.argsort(j, kind="stable")
    j, doc = j[order], doc[order]
    cuts = np.searchsorted(j, np.arange(0, len(possible) + BLOCK, BLOCK))
    square = (err * err).astype(np.float32)
    g1, h1 = np.bincount(j, err[doc], len(possible)), np.bincount(j, square[doc], len(possible))

    def block(k: int) -> np.ndarray:
        x = np.zeros((min(BLOCK, len(possible) - k * BLOCK), len(rows)), np.float32)
        x[j[cuts[k] : cuts[k + 1]] - k * BLOCK, doc[cuts[k] : cuts[k + 1]]] = 1
        return x

    for a in range(-(-len(possible) // BLOCK)):
        xa = block(a)
        by, by2 = xa * err.astype(np.float32), xa * square
        for b in range(a, -(-len(possible) // BLOCK)):
            xb = xa if a == b else block(b)
            g, h = by @ xb.T, by2 @ xb.T
            ra, rb = slice(a * BLOCK, a * BLOCK + len(xa)), slice(b * BLOCK, b * BLOCK + len(xb))
            left = g - h * (g1[ra] / np.maximum(h1[ra], 1e-9))[:, None]
            right = g - h * (g1[rb] / np.maximum(h1[rb], 1e-9))[None, :]
            strong = (np.minimum(np.abs(left), np.abs(right)) > np.maximum(l1, sigmas * np.sqrt(h))) & (left * right > 0)
            out[possible[ra]] |= strong.any(axis=1)
            out[possible[rb]] |= strong.any(axis=0)
    return out


def fit(buckets: np.ndarray, offsets: np.ndarray, y: np.ndarray, held: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, min_df: float = MIN_DF, rate: float = 0.1, l1: float = L1, sigmas: float = SIGMAS) -> dict:
    """The machine of the rows that aren't held; the threshold of best F(CAUTION) on those that are.

    w follows FTRL-proximal, so a term stays at 0 until its summed gradient
    passes the floor, which grows with the passes as chance does when each pass
    repeats it; v follows AdaGrad with a pull to 0.
    """
    rng = np.random.default_rng(1)
    df = np.bincount(buckets, minlength=1 << BITS)
    known = np.flatnonzero(df >= max(2, min_df * len(y)))
    slot = np.full(1 << BITS, -1, np.int32)
    slot[known] = np.arange(len(known))
    n = len(known)
    model = {"slot": slot, "w": np.zeros(n, np.float32), "v": np.zeros((n, factors), np.float32), "w0": -3.0, "threshold": float("inf")}
    if not len(y) or y.min() == y.max():
        return model
    w, v, active = np.zeros(n), np.zeros((n, factors)), np.zeros(n, bool)
    z, nw, gv = np.zeros(n), np.zeros(n), np.full((n, factors), 1.0)
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    w0 = float(np.log(y[train].mean() + 1e-3) - np.log(1 - y[train].mean() + 1e-3))
    s = slot[buckets]

    def scores(j: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """(logits, sums of factors, places of active terms, their bounds) of rows of terms j."""
        on = active[j]
        offv = np.concatenate([[0], np.cumsum(on)])[off]
        vj = v[j[on]]
        sums = _sums(vj, offv)
        return w0 + _sums(w[j], off) + 0.5 * (sums * sums - _sums(vj * vj, offv)).sum(axis=1), sums, on, offv

    n0, passes = 1.0, 0.0

    def epoch() -> None:
        nonlocal w0, n0, passes
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            passes += len(rows) / len(train)
            at = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in rows])
            doc = np.repeat(np.arange(len(rows)), offsets[rows + 1] - offsets[rows])
            keep = s[at] >= 0
            j, doc = s[at][keep], doc[keep]
            off = np.searchsorted(doc, np.arange(len(rows) + 1))
            logit, sums, on, _ = scores(j, off)
            err = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]
            n0 += err.sum() ** 2
            w0 -= rate * float(err.sum() / np.sqrt(n0))
            uniq, inv = np.unique(j, return_inverse=True)
            g = np.bincount(inv, err[doc], len(uniq))
            more = np.sqrt(nw[uniq] + g * g)
            z[uniq] += g - (more - np.sqrt(nw[uniq])) / rate * w[uniq]
            nw[uniq] += g * g
            floor = np.maximum(l1 * passes, sigmas * np.sqrt(passes * nw[uniq]))
            w[uniq] = np.where(np.abs(z[uniq]) <= floor, 0, -(z[uniq] - np.sign(z[uniq]) * floor) / ((1 + more) / rate))
            if on.any():
                jv, dv = j[on], doc[on]
                uv, iv = np.unique(jv, return_inverse=True)
                d = err[dv][:, None] * (sums[dv] - v[jv])
                d = np.stack([np.bincount(iv, d[:, f], len(uv)) for f in range(factors)], axis=1) + 1e-2 * v[uv]
                gv[uv] += d * d
                v[uv] -= rate * d / np.sqrt(gv[uv])

    for _ in range(epochs):
        epoch()
    known_at = np.flatnonzero(s >= 0)
    off = np.concatenate([[0], np.cumsum(s >= 0)])[offsets]
    err = 1 / (1 + np.exp(-np.clip(scores(s[known_at], off)[0], -30, 30))) - y
    active = (w != 0) | pairs_beyond_chance(s, offsets, train, err[train], n)
    v[active] = rng.normal(0, 0.1, (int(active.sum()), factors))
    for _ in range(2 * epochs):
        epoch()
    live = (w != 0) | active
    slot[known] = np.where(live, np.cumsum(live) - 1, -1)
    model |= {"w": w[live].astype(np.float32), "v": v[live].astype(np.float32), "w0": w0}
    test = np.flatnonzero(held) if held.any() and y[held].any() else np.arange(len(y))
    score = logits(model, buckets, offsets)[test]
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[test][order])
    f = hit / (np.arange(1, len(test) + 1) + CAUTION**2 * y[test].sum())  # F of CAUTION, but for a factor
    best = int(np.argmax(f))
    below = score[order[best + 1]] if best + 1 < len(test) else score[order[best]] - 1
    model["threshold"] = float((score[order[best]] + below) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict:
    @F.arrow_udf("binary")
    def featurize(text: pa.Array) -> pa.Array:
        b, o = terms(text)
        return pa.array([b[o[i] : o[i + 1]].tobytes() for i in range(len(text))], pa.binary())

    def run(batches):
        parts = [b.to_pandas() for b in batches]
        t = pd.concat(parts) if parts else pd.DataFrame({"x": [], "y": [], "held": []})
        each = [np.frombuffer(x, np.int32) for x in t["x"]]
        off = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)]).astype(np.int64)
        model = fit(np.concatenate(each) if each else np.zeros(0, np.int32), off, t["y"].to_numpy(np.float64), t["held"].to_numpy(bool))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    got = labelled(docs, labels, "toxic", bound, featurize).repartition(1).sortWithinPartitions("x", "y", "held").mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0), np.zeros(0, bool))


def scorer(spark: SparkSession, model: dict):
    """A column function: text -> logit less threshold, so that above 0 is toxic."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        b, o = terms(text)
        said = logits(shared.value, b, o) - shared.value["threshold"] if np.isfinite(shared.value["threshold"]) else np.full(len(text), -1.0)
        return pa.array(np.where(np.diff(o) > 0, said, np.minimum(said, -1.0)))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, margin, toxic) of every row of ``docs``; toxic is margin > 0."""
    score = scorer(docs.sparkSession, model or train(docs, labels))
    return docs.select("doc_id", score("text").alias("margin")).select("doc_id", "margin", (F.col("margin") > 0).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with its columns."""
    score = scorer(docs.sparkSession, model or train(docs, labels))
    return docs.where(score("text") <= 0)
