"""Quality classifier: random Fourier features over document statistics.

STATS numbers describe a document; standardized, they pass through
cos(x W + b) with Gaussian W, whose inner products approximate a Gaussian
kernel.  Each partition of a bounded labelled sample (SAMPLE) sums its normal
equations Z'Z and Z'y; their total gives the ridge weights, and pool-adjacent-
violators over held-out rows turns ridge scores into probabilities.  Scoring is
one narrow pass.

Defined cases: a null or empty text has all statistics 0 and is scored like any
other row (the fit holds whatever labels say of such texts); repeated rows score
alike; a null doc_id is carried; without labels every row has probability 1 and
is kept; other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import buffers, chunks, plain, words
from .common import cut, labelled

FEATURES = 256
RIDGE = 1e-2
#: Labelled rows used for the fit, at most about so many.
SAMPLE = 40_000
#: A document is rejected when its calibrated probability is below this.
THRESHOLD = 0.5

STATS = (
    "log_words", "word_chars", "upper_share", "digit_share", "punct_share", "symbol_share", "space_share", "distinct_share",
    "top_word_share", "repeat_bigram_share", "log_line_chars", "repeat_line_share", "exclaim_per_word", "hash_per_word",
    "pipe_per_word", "long_word_share", "short_word_share", "sentence_words", "upper_word_share", "brace_per_word",
)


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars.encode())] = 1
    return t


_UPPER, _DIGIT, _SPACE = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(" \t\r\n")
_PUNCT, _SYMBOL = _class(".,;:?!'\"()-"), _class("#$%&*+<=>@[\\]^_`{|}~/")
_TABLE = np.stack([_UPPER, _DIGIT, _SPACE, _PUNCT, _SYMBOL, _class("!"), _class("#$%&*"), _class("|"), _class(".!?"), _class("{}[]<>=;")], axis=1).astype(np.int32)


def _shares(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, largest count of a key) of each document."""
    k = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))
    if not len(k):
        return np.zeros(n), np.zeros(n)
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(new, len(k)))
    d = (k[new] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, d, size)
    return np.bincount(d, minlength=n).astype(float), top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATS for each text."""
    out = [np.zeros((0, len(STATS)))]
    for _, part in chunks(column):
        n = len(part)
        data, bounds = buffers(plain(part))
        size = np.maximum(np.diff(bounds), 1).astype(float)
        run = np.zeros((n, _TABLE.shape[1]))
        full = np.flatnonzero(np.diff(bounds) > 0)
        if len(full):
            for k in range(_TABLE.shape[1]):
                run[full, k] = np.add.reduceat(_TABLE[:, k][data], bounds[full])
        w = words(part)
        m = np.diff(w.first).astype(float)
        per = np.maximum(m, 1)
        length = (w.end - w.start).astype(float)
        total = np.bincount(w.doc, length, n)
        distinct, top = _shares(w.code, w.doc, n)
        same = np.flatnonzero(w.doc[:-1] == w.doc[1:]) if len(w.doc) > 1 else np.zeros(0, np.int64)
        pairs, _ = _shares(w.code[same] * np.uint64(0x9E3779B97F4A7C15) + w.code[same + 1] if len(same) else w.code[:0], w.doc[same] if len(same) else w.doc[:0], n)
        starts = np.unique(np.concatenate([bounds[:-1][np.diff(bounds) > 0], np.flatnonzero(data == 10) + 1]))
        starts = starts[starts < len(data)]
        line_doc = np.searchsorted(bounds, starts, "right") - 1
        lines = np.bincount(line_doc, minlength=n).astype(float)
        cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.code, dtype=np.uint64)])
        at = np.searchsorted(w.start, np.append(starts, len(data)))
        code = cum[at[1:]] - cum[at[:-1]]
        some = at[1:] > at[:-1]
        kinds, _ = _shares(code[some], line_doc[some], n)
        filled = np.bincount(line_doc[some], minlength=n)
        low = np.zeros(len(w.start), bool)
        low[:] = _UPPER[data[w.start]] > 0 if len(w.start) else False
        second = np.minimum(w.start + 1, max(len(data) - 1, 0))
        caps = low & (length > 1) & (_UPPER[data[second]] > 0) if len(w.start) else low
        out.append(np.stack([
            np.log1p(m), total / per, run[:, 0] / size, run[:, 1] / size, run[:, 3] / size, run[:, 4] / size, run[:, 2] / size, distinct / per,
            top / per, 1 - pairs / np.maximum(m - 1, 1) * (m > 1) - (m <= 1), np.log1p(size / np.maximum(lines, 1)), 1 - kinds / np.maximum(filled, 1) - (filled == 0), run[:, 5] / per, run[:, 6] / per,
            run[:, 7] / per, np.bincount(w.doc, length > 12, n) / per, np.bincount(w.doc, length < 4, n) / per, m / np.maximum(run[:, 8], 1), np.bincount(w.doc, caps, n) / per, run[:, 9] / per,
        ], axis=1) * (np.diff(bounds) > 0)[:, None])
    return np.concatenate(out)


def _lift(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    return np.concatenate([np.sqrt(2 / model["w"].shape[1]) * np.cos(z @ model["w"] + model["b"]), np.ones((len(x), 1))], axis=1)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper scores, values) of the non-decreasing step function nearest to y; tied scores are pooled first."""
    u, inv = np.unique(score, return_inverse=True)
    weight = np.bincount(inv).astype(float)
    mean = np.bincount(inv, y) / weight
    stack: list[list[float]] = []
    for s, v, k in zip(u, mean, weight):
        stack.append([s, v, k])
        while len(stack) > 1 and stack[-2][1] >= stack[-1][1]:
            s2, v2, k2 = stack.pop()
            _, v1, k1 = stack.pop()
            stack.append([s2, (v1 * k1 + v2 * k2) / (k1 + k2), k1 + k2])
    return np.array([x[0] for x in stack]), np.array([x[1] for x in stack])


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if model["beta"] is None:
        return np.ones(len(x))
    s = _lift(model, x) @ model["beta"]
    upper, value = model["upper"], model["value"]
    return value[np.minimum(np.searchsorted(upper, s), len(upper) - 1)]


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, features: int = FEATURES) -> dict:
    rng = np.random.default_rng(5)
    k = len(STATS)
    w, b = rng.normal(0, 1 / np.sqrt(k), (k, features)), rng.uniform(0, 2 * np.pi, features)

    @F.arrow_udf("array<double>")
    def describe(text: pa.Array) -> pa.Array:
        return pa.array(list(statistics(text)), pa.list_(pa.float64()))

    rows = cut(labelled(docs, labels, "quality", bound, describe).repartition(4), "quality-sample")
    at = [F.element_at("x", i + 1) for i in range(k)]
    got = rows.agg(F.count("*"), F.min("y"), F.max("y"), F.array(*map(F.avg, at)), F.array(*map(F.stddev_pop, at))).first()
    if not got[0] or got[1] == got[2]:
        return {"beta": None}
    model = {"w": w, "b": b, "mean": np.array(got[3]), "scale": np.maximum(np.array(got[4]), 1e-6)}

    def equations(batches):
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            t = batch.to_pandas()
            z = _lift(model, np.stack(t["x"])) if len(t) else np.zeros((0, features + 1))
            total += z.T @ np.concatenate([z, t["y"].to_numpy(float)[:, None]], axis=1)
        yield pa.RecordBatch.from_pydict({"s": pa.array([total.tobytes()], pa.binary())})

    parts = rows.where("not held").mapInArrow(equations, "s binary").collect()
    total = sum(np.frombuffer(p["s"]).reshape(features + 1, features + 2) for p in parts)
    model["beta"] = np.linalg.solve(total[:, :-1] + RIDGE * np.eye(features + 1), total[:, -1])

    def held(batches):
        for batch in batches:
            t = batch.to_pandas()
            if len(t):
                yield pa.RecordBatch.from_pydict({"s": _lift(model, np.stack(t["x"])) @ model["beta"], "y": t["y"].to_numpy(float)})

    t = rows.where("held").mapInArrow(held, "s double, y double").toPandas()
    if t.empty:
        t = rows.mapInArrow(held, "s double, y double").toPandas()
    model["upper"], model["value"] = isotonic(t["s"].to_numpy(), t["y"].to_numpy())
    return model


def scorer(spark: SparkSession, model: dict):
    """A column function: text -> calibrated probability of good quality."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(predict(shared.value, statistics(text)))

    return score


def quality(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, probability, good) of every row of ``docs``."""
    score = scorer(docs.sparkSession, model or train(docs, labels))
    return docs.select("doc_id", score("text").alias("probability")).select("doc_id", "probability", (F.col("probability") >= THRESHOLD).alias("good"))


def drop_bad(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """The rows of ``docs`` of good quality, with its columns."""
    score = scorer(docs.sparkSession, model or train(docs, labels))
    return docs.where(score("text") >= THRESHOLD)
