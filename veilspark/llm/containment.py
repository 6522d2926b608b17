"""Exact containment of short references in windows of long texts.

A reference of m words has the set S of its runs of SIZE words.  A document
contains it if some window of m words, beginning at an occurrence of a run of S,
holds at least ``need(|S|)`` of the distinct runs of S.  Runs are found by hash
and then compared as text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .codes import Words, shingles, words

SIZE = 3


@dataclass
class References:
    """Runs of all references: sorted distinct codes, and of each the (reference, number in it) pairs."""

    ids: list
    words: np.ndarray
    distinct: np.ndarray
    codes: np.ndarray
    at: np.ndarray
    owner: np.ndarray
    texts: list[str]

    def need(self, share: float) -> np.ndarray:
        return np.array([max(1, math.ceil(share * n - 1e-9)) for n in self.distinct], np.int64)


def references(ids: list, texts: list, size: int = SIZE) -> References:
    """Of the references with at least one word; a null text has none."""
    w = words(pa.array(texts, pa.string()))
    code, doc, first = shingles(w, size)
    count = np.diff(w.first)
    pairs = sorted({(int(c), int(d)): int(f) for c, d, f in zip(code[::-1], doc[::-1], first[::-1])}.items())
    codes, at, owner, runs = [], [], [], []
    for (c, d), f in pairs:
        if not codes or codes[-1] != c:
            codes.append(c)
            at.append(len(owner))
            runs.append(w.text(f, min(f + size, int(w.first[d + 1]))))
        owner.append(d)
    return References(ids, count, np.bincount([d for (_, d), _ in pairs], minlength=len(texts)).astype(np.int64), np.array(codes, np.uint64), np.array([*at, len(owner)], np.int64), np.array(owner, np.int64), runs)


def hits(refs: References, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``codes``, index into ``refs.codes``) of the equal ones."""
    if not len(refs.codes) or not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a bitmap of the low bits first: most codes are of no reference
    bits = max(16, int(len(refs.codes) * 16).bit_length())
    mask = np.uint64((1 << bits) - 1)
    seen = np.zeros(1 << bits, bool)
    seen[(refs.codes & mask).astype(np.int64)] = True
    some = np.flatnonzero(seen[(codes & mask).astype(np.int64)])
    at = np.minimum(np.searchsorted(refs.codes, codes[some]), len(refs.codes) - 1)
    same = refs.codes[at] == codes[some]
    return some[same], at[same]


def verify(refs: References, w: Words, found: dict[int, set[int]], need: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray], index: tuple[np.ndarray, np.ndarray], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(document, reference, first word, runs matched, runs) of the candidates that hold.

    ``found``: candidate references of each document; ``runs``: shingles of
    ``w``; ``index``: their hits.  The best window counts, the first of several.
    """
    code, doc, first = runs
    at, ref = index
    hit_doc = doc[at]
    out = []
    for d, candidates in found.items():
        a, b = np.searchsorted(hit_doc, [d, d + 1])
        begin = int(w.first[d])
        end = int(w.first[d + 1])
        per: dict[int, list[tuple[int, int]]] = {}
        for k in range(a, b):
            r = int(ref[k])
            place = int(first[at[k]])
            if w.text(place, min(place + size, end)) != refs.texts[r]:
                continue
            for o in refs.owner[refs.at[r] : refs.at[r + 1]]:
                if int(o) in candidates:
                    per.setdefault(int(o), []).append((place - begin, r))
        for o, places in sorted(per.items()):
            if len({r for _, r in places}) < need[o]:
                continue
            reach = max(0, int(refs.words[o]) - size)
            best, start, tail, inside = 0, -1, 0, {}
            for head, (p, _) in enumerate(places):
                while tail < len(places) and places[tail][0] <= p + reach:
                    inside[places[tail][1]] = inside.get(places[tail][1], 0) + 1
                    tail += 1
                if len(inside) > best:
                    best, start = len(inside), p
                r = places[head][1]
                inside[r] -= 1
                if not inside[r]:
                    del inside[r]
            if best >= need[o]:
                out.append((d, o, start, best, int(refs.distinct[o])))
    return out
