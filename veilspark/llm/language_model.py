"""Language-model scoring: a gated recurrent network with class-factored softmax.

Vocabulary: the words of all documents are counted, and the most frequent ones,
by rank, get ids of their own.  The next ones, down to LEAST occurrences (or to
the frequency that LISTED words reach, ties in or out together), share
BUCKETS - 1 hashed ids, and the id UNLISTED stands for all others.  Id i belongs
to class i // CLASS_SIZE, and P(word) = P(class | state) P(id | class, state)
P(word | id): 1 for a word with its own id, the word's share of its bucket's
counts for a listed word, and for any other a bigram model of bytes, which sums
to 1 over all strings.  So each word is scored as that word, and all words' sum
is at most 1; a word seen only once is scored like an unseen one, lest a
document's own words vouch for it.

Training: every document is cut into spans of SPAN words, and every span is used
once.  A hash of its words and place deals it to a partition and to one of
ROUNDS rounds.  Within a span the state is carried from window to window of
WINDOW words, and gradients stop at a window's start (truncated backpropagation,
in numpy, AdaGrad).  In a round all partitions train from the same weights and
the same sums of squared gradients, and both are averaged, weighted by words: by
slices of the weights, first within groups of partitions and then over the
groups, so that no task holds more than about the square root of all and the
driver receives one model.

Scoring: documents of a batch advance side by side, longest first, window by
window; the state of each is carried from its first word to its last, so the
log-likelihood is that of the complete document.

Defined cases: a null or empty text has no words, log-likelihood 0 and a null
perplexity; a null doc_id is carried; repeated rows score alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import ctypes
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import Words, chunks, mix, words
from .common import cut

CLASSES, CLASS_SIZE = 32, 64
VOCABULARY = CLASSES * CLASS_SIZE
BUCKETS = 63
START = VOCABULARY - 1
UNLISTED = START - 1
#: Words, after those with ids of their own, whose counts are kept, at most; and their least count.
LISTED, LEAST = 1 << 21, 2
#: Byte of a word's edges in the model of bytes.
EDGE = 256
EMBED, HIDDEN = 16, 24
WINDOW, SPAN = 32, 128
#: Step sizes of the rounds.
RATES = (0.3, 0.3, 0.2, 0.2)
ROUNDS = len(RATES)
#: Spans that one task trains on, in all rounds together.
TASK_SPANS = 16_384
LANES = 128
SLICES = 16


# vocabulary ------------------------------------------------------------------


def gather(docs: DataFrame) -> DataFrame:
    """(kind, code, n) rows that together count all words (0) and the byte pairs of the distinct words of each chunk (1)."""
    arrow = pa.schema([("kind", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        pairs = np.zeros((EDGE + 1) ** 2, np.int64)
        for batch in batches:
            for _, part in chunks(batch.column(0), 4 << 20):
                w = words(part)
                code, at, n = np.unique(w.code, return_index=True, return_counts=True)
                held.append((code, n))
                pairs += _pairs(w, at)
                size += len(code)
            if size > 2_000_000:
                held = [_merge(held)]
                size = len(held[0][0])
        if held:
            code, n = _merge(held)
            for at in range(0, len(code), 100_000):
                k = len(code[at : at + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(code[at : at + k].view(np.int64)), pa.array(n[at : at + k], pa.int64())], schema=arrow)
            at = np.flatnonzero(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(at), pa.array(pairs[at])], schema=arrow)

    return docs.select("text").mapInArrow(run, "kind int, code bigint, n bigint")


def _pairs(w: Words, at: np.ndarray) -> np.ndarray:
    """Counts of the byte pairs of the words numbered ``at``, edges included, flat."""
    side = EDGE + 1
    inside = np.zeros(len(w.data) + 1, np.int64)
    np.add.at(inside, w.start[at] + 1, 1)
    np.add.at(inside, w.end[at], -1)
    second = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    data = w.data.astype(np.int64)
    keys = [data[second - 1] * side + data[second], EDGE * side + data[w.start[at]], data[w.end[at] - 1] * side + EDGE]
    return np.bincount(np.concatenate(keys), minlength=side * side)


def spans(docs: DataFrame, vocab: dict) -> DataFrame:
    """(ids, roll) of every span of every document; roll is a hash of its words and place."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    arrow = pa.schema([("ids", pa.binary()), ("roll", pa.int64())])

    def run(batches):
        for batch in batches:
            for _, part in chunks(batch.column(0), 4 << 20):
                w = words(part)
                if not len(w.code):
                    continue
                ids = token_ids(w.code, shared.value)
                place = np.arange(len(w.code)) - w.first[w.doc]
                start = np.flatnonzero(place % SPAN == 0)
                roll = mix(np.add.reduceat(w.code, start) + place[start].astype(np.uint64))
                end = np.append(start[1:], len(w.code))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i:j].tobytes() for i, j in zip(start, end)], pa.binary()), pa.array(roll.view(np.int64))], schema=arrow)

    return docs.select("text").mapInArrow(run, "ids binary, roll bigint")


def vocabulary(gathered: DataFrame) -> dict:
    """{"own": (sorted codes, ids) of the most frequent words of all documents, "listed": (sorted codes, log P(word | bucket)) of the next, "bytes": log P(byte | byte before)}."""
    counts = cut(gathered.groupBy("kind", "code").agg(F.sum("n").alias("n")), "counts")
    n_own = VOCABULARY - BUCKETS - 1
    of_words = counts.where("kind = 0").select("code", "n")
    # how many words there are of each frequency: a small table, whatever the corpus
    least, room = None, n_own + LISTED
    for r in sorted(of_words.where(F.col("n") >= LEAST).groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    parts = [of_words.orderBy(F.desc("n"), "code").limit(n_own).toArrow()]
    if least is not None:
        parts.append(of_words.where(F.col("n") >= least).toArrow())
    code, n = (np.concatenate([t[c].to_numpy() for t in parts]) for c in ("code", "n"))
    code = code.view(np.uint64)
    code, at = np.unique(code, return_index=True)
    rank = np.lexsort((code.view(np.int64), -n[at]))
    code, n = code[rank], n[at][rank]
    order = np.argsort(code[:n_own])
    own = code[:n_own][order], np.arange(len(order))[order]
    rest = np.argsort(code[n_own:])
    code, n = code[n_own:][rest], n[n_own:][rest]
    bucket = (code % np.uint64(BUCKETS - 1)).astype(np.int64)
    listed = code, np.log(n / np.bincount(bucket, n, BUCKETS)[bucket]).astype(np.float32)
    pairs = counts.where("kind = 1").select("code", "n").toArrow()
    table = np.full((EDGE + 1) ** 2, 0.5)
    table[pairs["code"].to_numpy()] += pairs["n"].to_numpy()
    table = table.reshape(EDGE + 1, EDGE + 1)
    table[EDGE, EDGE] = 0  # no word is empty
    with np.errstate(divide="ignore"):
        return {"own": own, "listed": listed, "bytes": np.log(table / table.sum(axis=1, keepdims=True))}


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return code, np.bincount(inv, np.concatenate([p[1] for p in parts]), len(code)).astype(np.int64)


def _find(code: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which codes are in the sorted ``known``, where there)."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(1 << 16, bool)
    seen[(known >> np.uint64(48)).astype(np.int64)] = True
    some = np.flatnonzero(seen[(code >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, code[some]), len(known) - 1)
    same = known[at] == code[some]
    return some[same], at[same]


def token_ids(code: np.ndarray, vocab: dict) -> np.ndarray:
    return _identified(code, vocab)[0]


def _identified(code: np.ndarray, vocab: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids, log P(word | id)); the latter is 0 for unlisted words."""
    out, inside = np.full(len(code), UNLISTED, np.int16), np.zeros(len(code))
    which, at = _find(code, vocab["own"][0])
    out[which] = vocab["own"][1][at]
    rest = np.flatnonzero(out == UNLISTED)
    which, at = _find(code[rest], vocab["listed"][0])
    rest = rest[which]
    out[rest] = VOCABULARY - 1 - BUCKETS + (code[rest] % np.uint64(BUCKETS - 1)).astype(np.int16)
    inside[rest] = vocab["listed"][1][at]
    return out, inside


def word_ids(w: Words, vocab: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids, log P(word | id)) of words; of unlisted ones by their bytes."""
    ids, inside = _identified(w.code, vocab)
    rest = np.flatnonzero(ids == UNLISTED)
    if len(rest):
        logs, data = vocab["bytes"], w.data
        steps = np.zeros(len(data))
        steps[1:] = np.cumsum(logs[data[:-1], data[1:]])
        first, last = w.start[rest], w.end[rest] - 1
        inside[rest] = logs[EDGE, data[first]] + steps[last] - steps[first] + logs[data[last], EDGE]
    return ids, inside


def _keep_heap() -> None:
    """Freed arrays stay with the process (glibc): else each window faults its pages in again, a third of the time."""
    try:
        for option, value in ((-3, 32 << 20), (-1, 64 << 20), (-2, 16 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_TOP_PAD
            ctypes.CDLL(None).mallopt(option, value)
    except (AttributeError, OSError):
        pass


# network ---------------------------------------------------------------------

SHAPES = {"e": (VOCABULARY, EMBED), "wx": (EMBED, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wo": (CLASSES, HIDDEN, CLASS_SIZE), "bo": (CLASSES, CLASS_SIZE)}


def initial(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 1 / np.sqrt(s[-2]) if k != "e" else 0.1, s) if len(s) > 1 and k != "bo" else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _step(xp: np.ndarray, h: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, ...]:
    u = h @ wh
    g = _sigmoid(xp[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
    r, z = g[:, :HIDDEN], g[:, HIDDEN:]
    n = np.tanh(xp[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
    return n + z * (h - n), r, z, n, u[:, 2 * HIDDEN :]


def _lse(a: np.ndarray, safe: bool) -> np.ndarray:
    """log(sum(exp(row))); ``safe``: no entry can overflow."""
    if safe:
        return np.log(np.exp(a, out=a) @ np.ones(a.shape[1], np.float32))
    top = a.max(axis=1)
    return top + np.log(np.exp(a - top[:, None]).sum(axis=1))


def log_probs(p: dict, h: np.ndarray, y: np.ndarray, block: int = 16_384) -> np.ndarray:
    """log P(y) at each state of h, in blocks that stay in the cache."""
    safe = _bounded(p)
    out = np.empty(len(y), np.float32)
    for at in range(0, len(y), block):
        hb, yb = h[at : at + block], y[at : at + block]
        c = yb // CLASS_SIZE
        order = np.argsort(c.astype(np.uint8), kind="stable")
        hb, c, inside = hb[order], c[order], (yb % CLASS_SIZE)[order]
        rows = np.arange(len(yb))
        a = hb @ p["wc"] + p["bc"]
        lp = a[rows, c] - _lse(a, safe)
        cuts = np.searchsorted(c, np.arange(CLASSES + 1))
        for k in range(CLASSES):
            i, j = cuts[k], cuts[k + 1]
            if i < j:
                a = hb[i:j] @ p["wo"][k] + p["bo"][k]
                lp[i:j] += a[rows[: j - i], inside[i:j]] - _lse(a, safe)
        out[at + order] = lp
    return out


def score(p: dict, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-likelihood of each document ids[first[i]:first[i+1]]."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    total = np.zeros(len(order))
    table = p["e"] @ p["wx"] + p["b"]
    h = np.zeros((len(order), HIDDEN), np.float32)
    for t0 in range(0, int(size[0]) if len(size) else 0, WINDOW):
        states, targets, lanes = [], [], []
        for t in range(t0, t0 + WINDOW):
            n = int(np.searchsorted(-size, -t, "left"))  # documents with more than t words
            if not n:
                break
            x = ids[begin[:n] + t - 1] if t else np.full(n, START)
            new = _step(table[x], h[:n], p["wh"])[0]
            h[:n] = new
            states.append(new)
            targets.append(ids[begin[:n] + t])
            lanes.append(np.arange(n))
        if states:
            lp = log_probs(p, np.concatenate(states), np.concatenate(targets).astype(np.int64))
            total += np.bincount(np.concatenate(lanes), lp, len(total))
    out = np.zeros(len(order))
    out[order] = total
    return out


def _softmax(a: np.ndarray, safe: bool) -> np.ndarray:
    """exp(row) / sum(exp(row)), in place; ``safe``: no entry can overflow."""
    if not safe:
        a -= a.max(axis=1, keepdims=True)
    np.exp(a, out=a)
    a /= (a @ np.ones(a.shape[1], a.dtype))[:, None]
    return a


def _bounded(p: dict) -> bool:
    """Whether no exponential of a logit can overflow: states are within -1..1."""
    return max(np.abs(p["wc"]).sum(axis=0).max() + np.abs(p["bc"]).max(), np.abs(p["wo"]).sum(axis=1).max() + np.abs(p["bo"]).max()) < 60


def gradients(p: dict, x: np.ndarray, y: np.ndarray, live: np.ndarray, h: np.ndarray, safe: bool = False) -> tuple[dict, np.ndarray, float]:
    """Gradients of the mean loss of a window (steps, lanes), its last state and summed loss."""
    steps, lanes = x.shape
    kind, two = p["e"].dtype, 2 * HIDDEN
    flat_x = x.ravel()
    xp = (p["e"] @ p["wx"] + p["b"])[flat_x].reshape(steps, lanes, 3 * HIDDEN)
    u, g2, n = (np.empty((steps, lanes, k), kind) for k in (3 * HIDDEN, two, HIDDEN))
    states = np.empty((steps + 1, lanes, HIDDEN), kind)
    states[0] = h
    for t in range(steps):
        np.matmul(states[t], p["wh"], out=u[t])
        np.add(xp[t, :, :two], u[t, :, :two], out=g2[t])
        half = g2[t]
        half *= 0.5
        np.tanh(half, out=half)
        half *= 0.5
        half += 0.5
        np.multiply(half[:, :HIDDEN], u[t, :, two:], out=n[t])
        n[t] += xp[t, :, two:]
        np.tanh(n[t], out=n[t])
        np.subtract(states[t], n[t], out=states[t + 1])
        states[t + 1] *= half[:, HIDDEN:]
        states[t + 1] += n[t]
    before, r, z = states[:-1], g2[:, :, :HIDDEN], g2[:, :, HIDDEN:]
    # the softmax of classes and of the words of each, rows in order of class
    flat = np.flatnonzero(live.ravel())
    yy = y.ravel()[flat].astype(np.int64)
    order = np.argsort((yy // CLASS_SIZE).astype(np.uint8), kind="stable")
    flat, yy = flat[order], yy[order]
    c, inside, rows = yy // CLASS_SIZE, yy % CLASS_SIZE, np.arange(len(yy))
    hs = states[1:].reshape(-1, HIDDEN)[flat]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    scale = kind.type(1 / max(1, len(yy)))
    e = _softmax(hs @ p["wc"] + p["bc"], safe)
    loss = -np.log(e[rows, c] + 1e-30).sum()
    e[rows, c] -= 1
    e *= scale
    g["wc"], g["bc"] = hs.T @ e, e.sum(axis=0)
    dh = e @ p["wc"].T
    cuts = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
    for k in range(CLASSES):
        i, j = cuts[k], cuts[k + 1]
        if i < j:
            e = _softmax(hs[i:j] @ p["wo"][k] + p["bo"][k], safe)
            at = rows[: j - i], inside[i:j]
            loss -= np.log(e[at] + 1e-30).sum()
            e[at] -= 1
            e *= scale
            g["wo"][k], g["bo"][k] = hs[i:j].T @ e, np.ones(j - i, kind) @ e
            dh[i:j] += e @ p["wo"][k].T
    out = np.zeros((steps * lanes, HIDDEN), kind)
    out[flat] = dh
    out = out.reshape(steps, lanes, HIDDEN)
    # back through the window
    dxp, du = np.empty_like(xp), np.empty_like(xp)
    carry = np.zeros((lanes, HIDDEN), kind)
    by_n, by_z, by_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), u[:, :, two:] * r * (1 - r)
    back = np.ascontiguousarray(p["wh"].T)
    for t in range(steps - 1, -1, -1):
        d = out[t] + carry
        dn = np.multiply(d, by_n[t], out=dxp[t, :, two:])
        np.multiply(dn, by_r[t], out=du[t, :, :HIDDEN])
        np.multiply(d, by_z[t], out=du[t, :, HIDDEN:two])
        np.multiply(dn, r[t], out=du[t, :, two:])
        d *= z[t]
        d += du[t] @ back
        carry = d
    dxp[:, :, :two] = du[:, :, :two]
    g["wh"] = before.reshape(-1, HIDDEN).T @ du.reshape(-1, 3 * HIDDEN)
    dx = dxp.reshape(-1, 3 * HIDDEN)
    g["b"] = np.ones(len(dx), kind) @ dx
    g["wx"] = p["e"][flat_x].T @ dx
    order = np.argsort(flat_x.astype(np.int16), kind="stable")
    at = flat_x[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    g["e"][at[first]] = np.add.reduceat((dx @ p["wx"].T)[order], first)
    return g, states[-1], float(loss)


def fit_spans(p: dict, spans: list[np.ndarray], rate: float = RATES[0], seed: int = 0, past: dict | None = None) -> tuple[dict, dict, int, float]:
    """One pass of AdaGrad over the spans: (weights, sums of squared gradients, words, mean loss before each update)."""
    p = {k: v.copy() for k, v in p.items()}
    past = {k: v.copy() for k, v in past.items()} if past else {k: np.full_like(v, 1e-5) for k, v in p.items()}
    order = np.random.default_rng(seed).permutation(len(spans))
    seen, loss = 0, 0.0
    for at in range(0, len(order), LANES):
        own = [spans[i] for i in order[at : at + LANES]]
        longest = max(map(len, own))
        y = np.zeros((longest, len(own)), np.int64)
        live = np.zeros((longest, len(own)), bool)
        for j, s in enumerate(own):
            y[: len(s), j], live[: len(s), j] = s, True
        x = np.concatenate([np.full((1, len(own)), START), y[:-1]])
        h = np.zeros((len(own), HIDDEN), np.float32)
        for t in range(0, longest, WINDOW):
            m = live[t : t + WINDOW]
            g, h, lost = gradients(p, x[t : t + WINDOW], y[t : t + WINDOW], m, h, _bounded(p))
            seen, loss = seen + int(m.sum()), loss + lost
            for k, d in g.items():
                past[k] += d * d
                p[k] -= rate * d / np.sqrt(past[k])
    return p, past, seen, loss / max(1, seen)


# Spark -----------------------------------------------------------------------


def _flat(p: dict, past: dict) -> np.ndarray:
    return np.concatenate([d[k].ravel() for d in (p, past) for k in SHAPES])


def _shaped(flat: np.ndarray) -> tuple[dict, dict]:
    sizes = np.cumsum([int(np.prod(s)) for s in SHAPES.values()] * 2)[:-1]
    parts = [x.reshape(s).copy() for x, s in zip(np.split(flat, sizes), [*SHAPES.values()] * 2)]
    return dict(zip(SHAPES, parts)), dict(zip(SHAPES, parts[len(SHAPES) :]))


def _mean(key, t: pd.DataFrame) -> pd.DataFrame:
    """The mean of weights, weighted by words, which are summed."""
    n = t["n"].to_numpy(float)
    total = sum(np.frombuffer(w, np.float32) * (k / n.sum()) for w, k in zip(t["w"], n))
    return pd.DataFrame({"slice": [key[0]], "w": [np.asarray(total, np.float32).tobytes()], "n": [int(n.sum())]})


def train(docs: DataFrame, rates: tuple[float, ...] = RATES) -> dict:
    """{"vocab", "p"}: the model of the corpus."""
    vocab = vocabulary(gather(docs))
    data = cut(spans(docs, vocab), "gathered")
    tasks = max(1, -(-data.count() // TASK_SPANS))
    data = cut(data.repartition(tasks, "roll"), "spans")
    p, past, size = initial(), None, int(tasks**0.5) + 1
    for number, rate in enumerate(rates):
        shared = docs.sparkSession.sparkContext.broadcast((p, past))

        def run(batches, shared=shared, number=number, rate=rate):
            own = [(r, np.frombuffer(s, np.int16)) for b in batches for s, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            if not own:
                return
            _keep_heap()
            own = [s for _, s in sorted(own, key=lambda x: x[0])]
            p, past, seen, _ = fit_spans(shared.value[0], own, rate, number, shared.value[1])
            group = int(np.random.default_rng(len(own[0]) * seen + int(own[0][0])).integers(size))
            for i, part in enumerate(np.array_split(_flat(p, past), SLICES)):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "part": pa.array([group], pa.int32()), "w": pa.array([part.tobytes()], pa.binary()), "n": pa.array([seen], pa.int64())})

        now = data.where(F.pmod(F.shiftright("roll", 7), F.lit(len(rates))) == number)
        each = now.mapInArrow(run, "slice int, part int, w binary, n bigint")
        got = each.groupBy("slice", "part").applyInPandas(_mean, "slice int, w binary, n bigint").groupBy("slice").applyInPandas(_mean, "slice int, w binary, n bigint").collect()
        if got:
            p, past = _shaped(np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(got, key=lambda r: r["slice"])]))
    return {"vocab": vocab, "p": p}


def document_scores(text: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(words, log-likelihood) of each text."""
    ids, inside, counts = [np.zeros(0, np.int16)], [np.zeros(0)], [np.zeros(0, np.int64)]
    for _, part in chunks(text):
        w = words(part)
        each = word_ids(w, model["vocab"])
        ids.append(each[0])
        inside.append(each[1])
        counts.append(np.diff(w.first))
    count = np.concatenate(counts)
    first = np.concatenate([[0], np.cumsum(count)])
    within = np.concatenate([[0], np.cumsum(np.concatenate(inside))])
    return count, score(model["p"], np.concatenate(ids), first) + within[first[1:]] - within[first[:-1]]


def lm_scores(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, n_words, log_likelihood, perplexity) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model or train(docs)))
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_likelihood", pa.float64()), ("perplexity", pa.float64())])

    def run(batches):
        _keep_heap()
        model = pickle.loads(shared.value)
        for batch in batches:
            n, ll = document_scores(batch.column(1), model)
            ppl = np.exp(np.minimum(-ll / np.maximum(n, 1), 700))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(ll), pa.array(ppl, mask=n == 0)], schema=arrow)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, log_likelihood double, perplexity double")
