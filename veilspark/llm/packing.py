"""Best-fit packing: vector best fit under three capacities.

A bin (a training sequence) has room for TOKENS ids, DOCS documents and
ATTENTION units of causal attention, where a piece of n ids costs n(n+1)/2.  A
document longer than the largest piece that fits an empty bin is split into
pieces of that size and a rest.  Pieces, longest first, each go to the open bin
that keeps every constraint and has the largest weighted dot product of demand
and residual (or the smallest residual norm); a new bin opens if none fits.

Only (doc_id, n_tokens) is shuffled.  Pieces are spread by a hash of their id,
start and row over groups of about GROUP, as many as the data need (rows of one
id, or of none, are spread too), and each group is packed by itself.

Defined cases: texts without ids (null, empty) have no piece; a null doc_id is
carried; repeated rows are packed as often as they come, ties are in order of
doc_id; an empty table gives no bins; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import VOCABULARY, tokenizer

TOKENS, DOCS = 4096, 24
ATTENTION = TOKENS * (TOKENS + 1) // 4
WEIGHTS = (1.0, 0.25, 0.5)
GROUP = 6_000

SCHEMA = "pack_group int, bin int, n_tokens bigint, n_docs int, attention bigint, pieces array<struct<doc_id:bigint,start:bigint,length:bigint>>"


def largest_piece(tokens: int = TOKENS, attention: int = ATTENTION) -> int:
    """Most ids that a bin can hold of one document."""
    return max(1, min(tokens, int((np.sqrt(8.0 * attention + 1) - 1) // 2)))


def pack(lengths: np.ndarray, capacity: tuple[int, int, int] = (TOKENS, DOCS, ATTENTION), weights: tuple[float, ...] = WEIGHTS, rule: str = "dot") -> np.ndarray:
    """The bin of each piece; ``lengths`` must not increase."""
    full = np.array(capacity, np.float64)
    scale = np.array(weights) / full / full
    out = np.zeros(len(lengths), np.int64)
    room = np.zeros((1024, 3))
    name = np.zeros(1024, np.int64)
    used = opened = 0
    for k, n in enumerate(lengths):
        need = np.array([n, 1, n * (n + 1) / 2])
        open_ = room[:used]
        fits = (open_ >= need).all(axis=1)
        best = -1
        if rule == "dot":
            score = np.where(fits, open_ @ (need * scale), -1.0)
        else:
            score = np.where(fits, -(((open_ - need) ** 2) @ scale), -np.inf)
        if used and fits.any():
            best = int(np.argmax(score))
        if best < 0:
            if used == len(room):
                room, name = np.concatenate([room, np.zeros_like(room)]), np.concatenate([name, np.zeros_like(name)])
            room[used], name[used] = full, opened
            best, used, opened = used, used + 1, opened + 1
        out[k] = name[best]
        room[best] -= need
        if room[best][0] < 1 or room[best][1] < 1 or room[best][2] < 1:  # full: no piece can join it
            used -= 1
            room[best], name[best] = room[used], name[used]
    return out


def pack_lengths(lengths: DataFrame, capacity: tuple[int, int, int] = (TOKENS, DOCS, ATTENTION), weights: tuple[float, ...] = WEIGHTS, rule: str = "dot", group: int = GROUP) -> DataFrame:
    """Bins (SCHEMA) of a (doc_id, n_tokens) table."""
    most = largest_piece(capacity[0], capacity[2])
    lengths = lengths.where("n_tokens > 0")
    pieces = lengths.select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("row"), F.explode(F.expr(f"sequence(0L, cast(n_tokens - 1 as bigint), {most}L)")).alias("start")).select("doc_id", "row", "start", F.least(F.lit(most).cast("bigint"), F.col("n_tokens") - F.col("start")).alias("length"))
    total = lengths.agg(F.sum(F.ceil(F.col("n_tokens") / most))).first()[0] or 0
    groups = max(1, -(-int(total) // group))

    def run(key, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", na_position="last")
        n = t["length"].to_numpy(np.int64)
        b = pack(n, capacity, weights, rule)
        ids = [None if x is pd.NA else int(x) for x in t["doc_id"].astype("Int64")]
        held: dict[int, list] = {}
        for x, d, s, m in zip(b.tolist(), ids, t["start"].tolist(), n.tolist()):
            held.setdefault(x, []).append({"doc_id": d, "start": s, "length": m})
        rows = [(key[0], x, sum(p["length"] for p in ps), len(ps), sum(p["length"] * (p["length"] + 1) // 2 for p in ps), ps) for x, ps in held.items()]
        return pd.DataFrame(rows, columns=["pack_group", "bin", "n_tokens", "n_docs", "attention", "pieces"])

    spread = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(groups)).cast("int")).drop("row")
    return spread.groupBy("pack_group").applyInPandas(run, SCHEMA)


def token_lengths(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    @F.arrow_udf("bigint")
    def count(text: pa.Array) -> pa.Array:
        return pa.array(tokenizer(path).counts(text))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), count("text").alias("n_tokens"))


def packing(docs: DataFrame, path: str = VOCABULARY, **options) -> DataFrame:
    """Bins that together hold every id of ``docs`` once."""
    return pack_lengths(cut(token_lengths(docs, path), "token-lengths"), **options)
