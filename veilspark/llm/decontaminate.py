"""Benchmark decontamination: a prefix-filtered set join.

An item of m words has n distinct runs of three words (all its words, if
fewer).  Ordered by rarity over the whole corpus, at least one of its first
n - need + 1 runs, its prefix, is in every window that holds need = ceil(SHARE
n) of them, so only prefixes are joined.  Two narrow passes read the texts: the
first counts the items' runs in all documents (partial counts are combined
before the shuffle), the second joins the prefixes and, for each hit at word p,
applies the bounds of length (the document must hold need runs) and position
(the window begins within m words before p) by counting the hits of the item
near p, then verifies the survivors exactly over windows of m words.

Items are joined in blocks of at most BLOCK runs, each a pass by itself, so
what every task holds is bounded however many items there are.

Defined cases: null or empty texts hold nothing, items without words are in no
document; a null doc_id or item_id is carried; repeated rows give a row each,
repeated items too; of equally good windows the first counts; an empty
benchmark removes nothing; other columns pass through ``drop_leaks`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import chunks, shingles, sql_words, words
from .containment import SIZE, References, hits, references, verify

SHARE = 0.7
#: Runs of items joined in one pass: about 64 MB for each Python worker.
BLOCK = 1_000_000


def blocks(benchmark: DataFrame, block: int = BLOCK):
    """References of the items, block by block."""
    ids, texts, held = [], [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"] or "")
        held += texts[-1].count(" ") + 1
        if held >= block:
            yield references(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield references(ids, texts)


def rarity(docs: DataFrame, refs: References) -> np.ndarray:
    """Occurrences of each run of ``refs`` in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches):
        total = np.zeros(len(shared.value.codes), np.int64)
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                total += np.bincount(hits(shared.value, shingles(words(part), SIZE)[0])[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["run", "n"])

    out = np.zeros(len(refs.codes), np.int64)
    for row in docs.select("text").mapInArrow(run, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n")).collect():  # at most BLOCK rows
        out[row["run"]] = row["n"]
    return out


def prefixes(refs: References, count: np.ndarray, share: float = SHARE) -> np.ndarray:
    """Of every (run, reference) pair of ``refs.owner``, whether it is in the reference's prefix."""
    run = np.repeat(np.arange(len(refs.codes)), np.diff(refs.at))
    order = np.lexsort((refs.codes[run], count[run], refs.owner))
    owner = refs.owner[order]
    rank = np.arange(len(order)) - np.searchsorted(owner, owner)
    keep = np.zeros(len(order), bool)
    keep[order] = rank <= (refs.distinct - refs.need(share))[owner]
    return keep


def _leaks(text: pa.Array, refs: References, prefix: np.ndarray, need: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    out = []
    starts = np.array([prefix[a:b].any() for a, b in zip(refs.at[:-1], refs.at[1:])], bool)
    for row, part in chunks(text):
        w = words(part)
        runs = shingles(w, SIZE)
        index = hits(refs, runs[0])
        count = np.diff(w.first)
        candidates: dict[int, set[int]] = {}
        if starts.any() and len(index[0]):
            hit_doc, place = runs[1][index[0]], runs[2][index[0]]
            for k in np.flatnonzero(starts[index[1]]):
                r, d, p = index[1][k], int(hit_doc[k]), place[k]
                for j in range(refs.at[r], refs.at[r + 1]):
                    o = int(refs.owner[j])
                    if not prefix[j] or o in candidates.get(d, ()) or count[d] - SIZE + 1 < need[o] and count[d] >= SIZE:
                        continue
                    m = refs.words[o]
                    a, b = np.searchsorted(hit_doc, [d, d + 1])
                    near = np.abs(place[a:b] - p) < m
                    if near.sum() >= need[o]:
                        candidates.setdefault(d, set()).add(o)
        if candidates:
            out += [(row + d, o, s, n, t) for d, o, s, n, t in verify(refs, w, dict(sorted(candidates.items())), need, runs, index)]
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, first_word, matched, runs) of every document and item that it contains."""
    schema = "doc_id bigint, item_id bigint, first_word bigint, matched bigint, runs bigint"
    arrow = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "first_word", "matched", "runs")])
    out = docs.sparkSession.createDataFrame([], schema)
    for refs in blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast((refs, prefixes(refs, rarity(docs, refs), share), refs.need(share)))

        def run(batches, shared=shared):
            refs, prefix, need = shared.value
            for batch in batches:
                found = _leaks(batch.column(1), refs, prefix, need)
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([refs.ids[f[1]] for f in found], pa.int64()), *[pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4)]], schema=arrow)

        out = out.unionByName(docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema))
    return out


def _clean(shared):
    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        ok = np.ones(len(text), bool)
        ok[[f[0] for f in _leaks(text, *shared.value)]] = False
        return pa.array(ok)

    return clean


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that contain no item, with its columns; a narrow pass for each block of items."""
    for refs in blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast((refs, prefixes(refs, rarity(docs, refs), share), refs.need(share)))

        docs = docs.where(_clean(shared)("text"))
    return docs


_WORDS = f"regexp_extract_all(lower(coalesce(text, '')), '{sql_words()}')"


def containment_sql(docs: str, items: str, item: str, share: float) -> str:
    """DuckDB: every window that begins at a hit is counted; no filter, no index."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM {docs}),
i AS (SELECT row_number() OVER () AS it, {item}, {_WORDS} AS w FROM {items}),
ir AS (SELECT DISTINCT it, {item}, len(w) AS m, unnest(CASE WHEN len(w) >= {SIZE} THEN [array_to_string(w[k:k + {SIZE} - 1], ' ') FOR k IN range(1, len(w) - {SIZE} + 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS run FROM i),
n AS (SELECT it, {item}, any_value(m) AS m, count(*) AS runs FROM ir GROUP BY ALL),
dr AS (SELECT row, doc_id, unnest(range(0, greatest(len(w) - {SIZE} + 1, least(len(w), 1)))) AS p, unnest(CASE WHEN len(w) >= {SIZE} THEN [array_to_string(w[k:k + {SIZE} - 1], ' ') FOR k IN range(1, len(w) - {SIZE} + 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS run FROM d),
h AS (SELECT row, doc_id, it, p, run FROM dr JOIN ir USING (run)),
s AS (SELECT a.row, a.doc_id, a.it, a.p, count(DISTINCT b.run) AS matched FROM h a JOIN n USING (it) JOIN h b ON a.row = b.row AND a.it = b.it AND b.p BETWEEN a.p AND a.p + greatest(n.m - {SIZE}, 0) GROUP BY ALL),
best AS (SELECT row, doc_id, it, max(matched) AS matched, arg_min(p, (-matched, p)) AS first_word FROM s GROUP BY ALL)
SELECT doc_id, {item}, first_word, matched, runs FROM best JOIN n USING (it) WHERE matched >= greatest(1, ceil({share} * runs - 1e-9))
"""


SQL = containment_sql("documents", "benchmark", "item_id", SHARE)
