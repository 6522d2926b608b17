"""Word and shingle codes of Arrow text columns, computed with numpy only.

An Arrow string column is one UTF-8 buffer with offsets, so a batch of
documents is read without making a Python object per word.  A word is a maximal
run of ASCII letters, digits, ``_`` and other characters in lower-cased text that
are no white space or punctuation (SPACES, MARKS); a character of a script
written without spaces (SOLO) is a word by itself.  The code of a word is a
64-bit polynomial hash of its bytes, mixed.  Nulls are read as "".
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is handled by itself, whole.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True

#: Characters outside ASCII, as first and last code points: white space, punctuation, and scripts without spaces.
SPACES = ((0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
MARKS = ((0xA1, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0x200B, 0x200B), (0x2010, 0x2027), (0x2030, 0x205E), (0x2190, 0x2BFF), (0x2E00, 0x2E7F), (0x3001, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
SOLO = ((0xE01, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
_SPACE, _MARK, _SOLO = 1, 2, 3
_KIND = np.zeros(0x200000, np.uint8)
for _k, _ranges in ((_SPACE, SPACES), (_MARK, MARKS), (_SOLO, SOLO)):
    for _a, _b in _ranges:
        _KIND[_a : _b + 1] = _k


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a run of documents, in order.

    code: hash of each word; doc: index of its document; start, end: bytes in
    ``data``; first: index of each document's first word (len docs + 1);
    bounds: byte offsets of the documents in ``data``.
    """

    code: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    bounds: np.ndarray

    def text(self, a: int, b: int) -> str:
        """Words a..b-1 joined by one space."""
        d = self.data
        return b" ".join(d[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b])).decode("utf-8", "replace")


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One LargeString array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a LargeString array, offsets from 0."""
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES):
    """(first row, slice) pairs of about ``size`` bytes that together hold every row."""
    column = plain(column)
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def special(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, width in bytes, kind) of the white space, punctuation and SOLO characters outside ASCII in UTF-8."""
    at = np.flatnonzero((data >= 0xE0) | (data == 0xC2))
    if not len(at):
        return at, at, np.zeros(0, np.uint8)
    lead = data[at].astype(np.int64)
    width = np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, 2))
    at, lead, width = (x[at + width <= len(data)] for x in (at, lead, width))
    point = lead & (0x7F >> width)
    for k in (1, 2, 3):
        more = np.flatnonzero(width > k)
        point[more] = (point[more] << 6) | (data[at[more] + k] & 0x3F)
    kind = _KIND[point]
    some = np.flatnonzero(kind)
    return at[some], width[some], kind[some]


def _mark(out: np.ndarray, at: np.ndarray, width: np.ndarray, value: bool) -> None:
    for k in range(4):
        out[at[width > k] + k] = value


def solid(data: np.ndarray, bounds: np.ndarray, of: np.ndarray, apart: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of maximal runs within ``bounds`` of bytes that ``of`` marks, but for characters of the kinds ``apart``; a SOLO character is a run."""
    n = len(data)
    inside = of[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    at, width, kind = special(data)
    if len(at):
        gone = np.isin(kind, apart)
        _mark(inside, at[gone], width[gone], False)
        alone = kind == _SOLO
        edge[at[alone]] = edge[at[alone] + width[alone]] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def words(column: pa.Array, lower: bool = True) -> Words:
    column = plain(column)
    if lower:
        column = pc.utf8_lower(column)
    data, bounds = buffers(column)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z.astype(np.uint64), z, z, z, np.zeros(len(bounds), np.int64), data, bounds)
    start, end = solid(data, bounds, _WORD, (_SPACE, _MARK))
    size = 1 << max(12, int(n).bit_length())
    power, inverse = _powers(size)
    h = np.empty(n + 1, np.uint64)
    h[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=h[1:])
    code = mix((h[end] - h[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, bounds).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(code, doc, start, end, first, data, bounds)


def sql_ranges(*kinds: tuple[tuple[int, int], ...]) -> str:
    """The ranges of a regular expression's character class."""
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for ranges in kinds for a, b in ranges)


def sql_words() -> str:
    """A regular expression for a word of lower-cased text."""
    apart = sorted((*SPACES, *MARKS, *SOLO))
    rest, at = [], 0x80
    for a, b in apart:
        if a > at:
            rest.append((at, a - 1))
        at = b + 1
    return f"[{sql_ranges(SOLO)}]|[0-9a-z_{sql_ranges((*rest, (at, 0x10FFFF)))}]+"


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, doc, first word) of every run of n words within a document.

    A document of 1 to n-1 words has one shingle of them all; one without words
    has none.
    """
    count = np.diff(w.first)
    m = len(w.code)
    if m >= n:
        code = np.zeros(m - n + 1, np.uint64)
        for i in range(n):
            code += w.code[i : m - n + 1 + i] * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
        at = np.flatnonzero(w.doc[: m - n + 1] == w.doc[n - 1 :])
        code, doc = mix(code[at]), w.doc[at]
    else:
        at, code, doc = (np.zeros(0, t) for t in (np.int64, np.uint64, np.int64))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = []
        for d in short:
            c = np.uint64(0)
            with np.errstate(over="ignore"):
                for i, x in enumerate(w.code[w.first[d] : w.first[d + 1]]):
                    c = c + x * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
            own.append(c)
        code = np.concatenate([code, mix(np.array(own, np.uint64))])
        doc = np.concatenate([doc, short])
        at = np.concatenate([at, w.first[short]])
        order = np.argsort(doc, kind="stable")
        code, doc, at = code[order], doc[order], at[order]
    return code, doc, at
