"""HTML extraction: flat text blocks classified by a decision tree.

A page is cut at every tag that isn't inline; what lies between two cuts is a
block.  A block is described by the word count and the link density (share of
its words inside <a>) of itself and of the blocks before and after it (0 and 0
at the ends).  A decision tree, grown here by Gini impurity on the small
labelled TABLE, says which blocks are content.  Comments and the contents of
head, script, style and similar elements (RAW) are no text.  A page is read in
one pass: a tag that isn't closed by > is text, and where RAW elements end is
looked up in a list made once, so no part is searched again and again.

Defined cases: null or empty html has no blocks and gives an empty text; html
without tags is one block; a head ends at <body> at the latest; of a RAW element
that is closed by /> or never closed only the tag goes; a comment that never
ends hides the rest; broken entities are read leniently; page_id is an integer
or a string of one (another string fails the cast); a null page_id is carried; repeated rows give a row each; a long page is read
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FEATURES = ("words_before", "links_before", "words", "links", "words_after", "links_after")

#: (words before, link density before, words, link density, words after, link density after, content)
TABLE = (
    # menus, link lists, breadcrumbs
    (0, 0, 1, 1, 1, 1, 0), (1, 1, 1, 1, 1, 1, 0), (1, 1, 1, 1, 9, 0, 0), (2, 1, 3, 1, 2, 1, 0), (1, 1, 2, 1, 40, 0, 0), (0, 0, 3, 1, 2, 1, 0),
    (5, 1, 6, 1, 5, 1, 0), (12, 0.9, 15, 0.95, 10, 1, 0), (3, 1, 1, 1, 6, 0, 0), (8, 0.7, 9, 0.8, 12, 0.6, 0), (60, 0, 7, 0.9, 6, 1, 0), (30, 0.1, 4, 1, 4, 1, 0), (0, 0, 12, 0.6, 2, 1, 0),
    # short notices right after a menu, before a short headline: banners and advertisements
    (1, 1, 9, 0, 8, 0, 0), (1, 1, 12, 0, 10, 0, 0), (1, 1, 6, 0, 12, 0, 0), (2, 1, 15, 0, 7, 0, 0), (1, 1, 20, 0, 6, 0, 0), (3, 1, 4, 0, 3, 0, 0), (1, 1, 24, 0, 10, 0, 0), (1, 1, 3, 0, 1, 0, 0), (1, 1, 8, 0, 60, 0, 0), (1, 1, 14, 0, 30, 0, 0),
    (1, 1, 2, 0, 14, 0, 0), (1, 1, 18, 0, 18, 0, 0), (1, 1, 10, 0.2, 9, 0, 0),
    # headlines: short, after a notice or at the top, before text
    (9, 0, 8, 0, 45, 0, 1), (12, 0, 10, 0, 90, 0, 1), (6, 0, 12, 0, 25, 0, 1), (15, 0, 7, 0, 14, 0, 1), (20, 0, 6, 0, 150, 0, 1), (4, 0, 3, 0, 20, 0, 1), (10, 0, 10, 0, 10, 0, 1), (8, 0, 1, 0, 30, 0, 1), (24, 0, 10, 0, 5, 0, 1),
    (0, 0, 8, 0, 50, 0, 1), (0, 0, 4, 0, 15, 0, 1), (3, 0, 9, 0, 2, 0, 1), (14, 0, 8, 0, 8, 0, 1), (18, 0, 2, 0, 4, 0, 1),
    # paragraphs
    (10, 0, 45, 0, 60, 0, 1), (8, 0, 120, 0, 30, 0, 1), (60, 0, 80, 0.05, 70, 0, 1), (40, 0, 25, 0, 100, 0, 1), (90, 0, 200, 0.02, 12, 0, 1), (100, 0, 30, 0, 14, 0, 1), (30, 0, 16, 0, 40, 0, 1), (45, 0, 3, 0, 60, 0, 1),
    (120, 0, 2, 0, 80, 0, 1), (20, 0, 5, 0, 9, 0, 1), (6, 0, 5, 0, 33, 0, 1), (70, 0, 8, 0, 13, 0, 1), (25, 0, 50, 0.15, 20, 0, 1), (0, 0, 60, 0, 0, 0, 1), (0, 0, 300, 0.01, 0, 0, 1), (12, 0, 90, 0, 0, 0, 1), (50, 0, 110, 0, 0, 0, 1),
    (3, 0, 1, 0, 12, 0, 1), (2, 0, 20, 0, 1, 0, 1), (9, 0, 4, 0, 11, 0, 1), (150, 0, 6, 0, 16, 0, 1), (1, 0, 1, 0, 5, 0, 1), (5, 0, 14, 0, 15, 0, 1),
    (1, 1, 70, 0, 40, 0, 1), (1, 1, 150, 0, 90, 0, 1), (2, 1, 55, 0, 9, 0, 1), (1, 1, 40, 0, 0, 0, 1), (0, 0, 5, 0, 0, 0, 1), (0, 0, 20, 0, 0, 0, 1), (0, 0, 1, 0, 0, 0, 1),
    (108, 0, 40, 0, 2, 0, 1), (50, 0, 25, 0, 3, 0, 1), (9, 0, 27, 0, 1, 0, 1), (30, 0, 12, 0, 2, 0, 1), (20, 0, 41, 0, 3, 0, 1), (60, 0, 9, 0, 2, 0, 1), (10, 0, 10, 0, 1, 0, 1), (29, 0, 23, 0, 2, 0, 1), (40, 0, 5, 0, 1, 0, 1), (6, 0, 6, 0, 2, 0, 1),
    # the short last block of a page: copyright and imprint
    (60, 0, 12, 0, 0, 0, 0), (10, 0, 9, 0, 0, 0, 0), (120, 0, 16, 0, 0, 0, 0), (3, 0, 14, 0, 0, 0, 0), (30, 0, 6, 0, 0, 0, 0), (200, 0, 20, 0, 0, 0, 0), (45, 0, 25, 0, 0, 0, 0), (5, 0, 3, 0, 0, 0, 0), (80, 0, 18, 0.3, 0, 0, 0), (1, 1, 8, 0, 0, 0, 0), (20, 0, 2, 0, 0, 0, 0), (1, 0, 10, 0, 0, 0, 0), (2, 0, 12, 0, 0, 0, 0), (8, 0, 10, 0, 0, 0, 0), (1, 0, 16, 0, 0, 0, 0), (2, 0, 8, 0, 0, 0, 0),
)

RAW = frozenset("head script style noscript template textarea title svg".split())
_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>|<[!?][^>]*>")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_SPACE = re.compile(r"\s+")


def blocks(page: str | None) -> list[tuple[str, int, float]]:
    """(text, words, link density) of the blocks of a page that have words."""
    out: list[tuple[str, int, float]] = []
    parts: list[str] = []
    linked = depth = at = 0

    def close() -> None:
        nonlocal parts, linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            n = text.count(" ") + 1
            out.append((text, n, min(1.0, linked / n)))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if depth:
                linked += len(text.split())

    page = page or ""
    limit = page.rfind(">") + 1  # beyond it no tag ends
    ends: dict[str, tuple[list[int], list[int]]] = {}

    def end_of(name: str, start: int) -> int:
        """Where the RAW element ends whose content begins at ``start``; there, if it is never closed."""
        if name not in ends:
            pattern = rf"</{name}(?=[\s/>])[^>]*>" + r"|<(?=body\b)" * (name == "head")
            found = [(m.start(), m.end() if m[0] != "<" else m.start()) for m in re.compile(pattern, re.I).finditer(page, 0, limit)]
            ends[name] = [a for a, _ in found], [b for _, b in found]
        k = bisect_left(ends[name][0], start)
        return ends[name][1][k] if k < len(ends[name][1]) else start

    while m := _TOKEN.search(page, at, limit):
        add(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            at = page.find("-->", at) + 3
            if at < 3:
                at = len(page)
            continue
        name = (m[2] or "").lower()
        if name in RAW and not m[1] and not m[0].endswith("/>"):
            at = end_of(name, at)
        if name and name not in _INLINE:
            close()
            depth = 0 if name not in ("br",) else depth
        elif name == "a":
            depth = 0 if m[1] else 1
    add(page[at:].partition("<!--")[0])
    close()
    return out


def describe(found: list[tuple[str, int, float]]) -> np.ndarray:
    """One row of FEATURES for each block."""
    x = np.zeros((len(found) + 2, 2))
    x[1:-1] = [(n, d) for _, n, d in found] if found else np.zeros((0, 2))
    return np.concatenate([x[:-2], x[1:-1], x[2:]], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A tree: (share of content,) or (feature, threshold, tree of <= threshold, tree of > threshold)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            a, b = y[left], y[~left]
            impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (a, b))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), left)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return (share,)
    _, f, t, left = best
    return (f, t, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


@lru_cache(maxsize=1)
def tree() -> tuple:
    table = np.array(TABLE, float)
    return grow(table[:, :-1], table[:, -1])


def decide(node: tuple, x: np.ndarray) -> np.ndarray:
    """Whether each row is content."""
    if len(node) == 1:
        return np.full(len(x), node[0] >= 0.5)
    out = np.empty(len(x), bool)
    left = x[:, node[0]] <= node[1]
    out[left], out[~left] = decide(node[2], x[left]), decide(node[3], x[~left])
    return out


def extract(pages: list[str | None]) -> list[tuple[str, int, int]]:
    """(content, blocks, blocks of content) of each page; the tree reads all blocks at once."""
    found = [blocks(p) for p in pages]
    x = np.concatenate([np.zeros((0, len(FEATURES))), *map(describe, found)])
    keep = decide(tree(), x)
    out, at = [], 0
    for f in found:
        own = keep[at : at + len(f)]
        at += len(f)
        out.append(("\n".join(t for (t, _, _), k in zip(f, own) if k), len(f), int(own.sum())))
    return out


def extract_html(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_blocks, n_content) of every row; a narrow pass."""
    arrow = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_blocks", pa.int64()), ("n_content", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                got = extract(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([g[k] for g in got], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))]], schema=arrow)

    return pages.selectExpr("cast(page_id as bigint) page_id", "html").mapInArrow(run, "page_id bigint, text string, n_blocks bigint, n_content bigint")
