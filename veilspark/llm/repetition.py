"""Quality rules: repetition from suffix arrays.

Units of a text are its runs of characters that aren't white space, however
long; a character of a script written without spaces is a unit by itself, so
MIN_UNITS counts words there and characters here.  The suffix array of a
document's units is built by prefix doubling over all documents of a chunk at
once, in which only suffixes that still share a prefix are sorted again.
Longest common prefixes come from the ranks of the doubling.  Every LCP
interval of at least MIN_UNITS whose occurrences are preceded by different
units is a maximal repeated substring; the union of the spans of all their
occurrences, as a share of the units' bytes, and the longest repeat, as a share
of the units, are limited.

Defined cases: null and empty texts have no repetition and are kept; a null
doc_id is carried; repeated rows give a row each (repetition is within a
document); a long text is processed whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .codes import _SPACE, _powers, buffers, chunks, mix, plain, solid

MIN_UNITS = 8
MAX_COVERED = 0.3
MAX_LONGEST = 0.2

_BLACK = np.ones(256, bool)
_BLACK[[32, *range(9, 14)]] = False


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, document, bytes) of each unit."""
    data, bounds = buffers(plain(column))
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = solid(data, bounds, _BLACK, (_SPACE,))
    power, inverse = _powers(1 << max(12, int(n).bit_length()))
    h = np.empty(n + 1, np.uint64)
    h[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=h[1:])
    return mix((h[end] - h[start]) * inverse[start]), np.searchsorted(bounds, start, "right") - 1, end - start


def suffixes(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array by document, LCP of each suffix with the one before it).

    Ranks are dense and of whole groups: equal rank at level k means equal first
    2**k units, within one document and not beyond its end.
    """
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((code, doc))
    c, d = code[order], doc[order]
    head = np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # the first place of the group
    stop = np.searchsorted(doc, doc, "right")  # end of the unit's document
    levels = [(np.arange(n), rank.copy())]
    same = ~head
    live = np.flatnonzero(same | np.append(same[1:], False))  # places in groups of several
    step = 1
    while len(live):
        suffix = order[live]
        group = rank[suffix]
        nxt = suffix + step
        second = np.where(nxt < stop[suffix], rank[np.minimum(nxt, n - 1)], -1)
        by = np.lexsort((second, group))
        suffix, group, second = suffix[by], group[by], second[by]
        order[live] = suffix
        # a suffix that ends differs from all others, so -1 never ties
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1]) | (second[1:] < 0)])
        rank[suffix] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        tied = ~new
        keep = tied | np.append(tied[1:], False)
        step *= 2
        place = np.sort(suffix)
        levels.append((place, rank[place]))
        live = live[keep]
    # LCP of neighbours: descend the levels, taking 2**k units where the ranks at level k agree
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    pair = np.flatnonzero(doc[a] == doc[b])
    a, b, total = a[pair], b[pair], np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        place, value = levels[k]
        ok = np.flatnonzero((a < n) & (b < n))
        if k:
            ia, ib = np.searchsorted(place, a[ok]), np.searchsorted(place, b[ok])
            hit = (ia < len(place)) & (ib < len(place))
            ok, ia, ib = ok[hit], ia[hit], ib[hit]
            hit = (place[ia] == a[ok]) & (place[ib] == b[ok])
            ok, ia, ib = ok[hit], ia[hit], ib[hit]
        else:
            ia, ib = a[ok], b[ok]
        go = ok[value[ia] == value[ib]]
        a[go] += 1 << k
        b[go] += 1 << k
        total[go] += 1 << k
    lcp[pair + 1] = total
    return order, lcp


def maximal(order: np.ndarray, lcp: np.ndarray, code: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(document, units, occurrences) of the maximal repeated substrings, from the LCP intervals."""
    out = []
    strong = np.flatnonzero(lcp >= least)
    if not len(strong):
        return out
    previous = np.where((order > 0) & (doc[np.maximum(order - 1, 0)] == doc[order]), code[np.maximum(order - 1, 0)], np.uint64(0))
    cuts = np.flatnonzero(np.diff(strong) > 1) + 1
    for run in np.split(strong, cuts):
        lo, hi = run[0] - 1, run[-1]
        change = np.concatenate([[0], np.cumsum(previous[lo + 1 : hi + 1] != previous[lo:hi])])
        stack: list[tuple[int, int]] = []
        heights = lcp[lo + 1 : hi + 1].tolist()
        for i, h in enumerate([*heights, 0]):
            left = i
            while stack and stack[-1][1] > h:
                left, height = stack.pop()
                if change[i] != change[left] or order[lo + left] == 0 or previous[lo + left] == 0:
                    out.append((int(doc[order[lo]]), height, i - left + 1))
            if h and (not stack or stack[-1][1] < h):
                stack.append((left, h))
    return out


def repetition(column: pa.Array, least: int = MIN_UNITS) -> dict[str, np.ndarray]:
    """units, longest repeat, covered share of bytes and number of maximal repeats of each text."""
    out = {k: [np.zeros(0)] for k in ("units", "longest", "covered", "repeats")}
    for _, part in chunks(column):
        n = len(part)
        code, doc, size = units(part)
        order, lcp = suffixes(code, doc)
        reach = np.zeros(len(code), np.int64)
        if len(code):
            reach[order] = np.maximum(lcp, np.append(lcp[1:], 0))
        reach[reach < least] = 0
        spans = np.flatnonzero(reach)
        mark = np.zeros(len(code) + 1, np.int64)
        np.add.at(mark, spans, 1)
        np.add.at(mark, spans + reach[spans], -1)
        covered = np.cumsum(mark[:-1]) > 0
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, doc[spans], reach[spans])
        out["units"].append(np.bincount(doc, minlength=n))
        out["longest"].append(longest)
        out["covered"].append(np.bincount(doc, size * covered, n) / np.maximum(np.bincount(doc, size, n), 1))
        out["repeats"].append(np.bincount(np.array([d for d, _, _ in maximal(order, lcp, code, doc, least)], np.int64), minlength=n))
    return {k: np.concatenate(v) for k, v in out.items()}


def quality_rules(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """(doc_id, units, longest, covered, repeats, keep) of every row; a narrow pass."""
    arrow = pa.schema([("doc_id", pa.int64()), ("units", pa.int64()), ("longest", pa.int64()), ("covered", pa.float64()), ("repeats", pa.int64()), ("keep", pa.bool_())])

    def run(batches):
        for batch in batches:
            r = repetition(batch.column(1))
            keep = (r["covered"] <= max_covered) & (r["longest"] <= max_longest * np.maximum(r["units"], 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(r["units"].astype(np.int64)), pa.array(r["longest"].astype(np.int64)), pa.array(r["covered"]), pa.array(r["repeats"].astype(np.int64)), pa.array(keep)], schema=arrow)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, units bigint, longest bigint, covered double, repeats bigint, keep boolean")
