"""License scans: MinHash bands over overlapping windows, then exact containment.

Templates are a parameter; TEMPLATES are public license notices and short whole
licenses.  For every window length c of LENGTHS, doubled up to the longest
template, texts are cut into windows of c words, each c/4 after the one before;
a template of m words belongs to the least c >= m.  A window that covers a
template has a Jaccard similarity of at least about LEAST with it, and with
BANDS bands of ROWS MinHash values such a pair collides in some band with
probability 1 - (1 - LEAST**ROWS)**BANDS > 0.998.  Templates that collide with
a window of a document are candidates of it, and are verified exactly: some run
of m words must hold at least SHARE of the template's runs of three words.
A template of one or two runs is less alike even to the shortest windows; every
document that has one of its runs is its candidate.

Minima of blocks of c/4 words are computed once and shared by the windows that
overlap them; a narrow pass, nothing is shuffled.

Defined cases: null or empty texts match nothing; texts shorter than a window
are one window; a null doc_id is carried; repeated rows give a row each; of
equally good places the first counts; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .codes import Words, chunks, shingles, words
from .containment import SIZE, References, hits, references, verify
from .decontaminate import _WORDS, containment_sql

SHARE = 0.8
#: The least window lengths; the longest is the first power of two that holds the longest template.
LENGTHS = (8, 16, 32, 64, 128)
BANDS, ROWS, LEAST = 16, 1, 0.35

TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "This project is licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-3-clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-or-later": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-endorse": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved-notice": "All rights reserved.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced without permission",
}

_MULTIPLY = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def collision(jaccard: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that a pair of this similarity shares a band."""
    return 1 - (1 - jaccard**rows) ** bands


def _permuted(code: np.ndarray, k: int) -> np.ndarray:
    return ((code * _MULTIPLY[k]) >> np.uint64(32)).astype(np.uint32)


@lru_cache(maxsize=2)
def _index(share: float, templates: tuple[tuple[str, str], ...]):
    """(references, need, for each length: by MinHash number, flags of the values' high halves and the values' templates)."""
    refs = references([k for k, _ in templates], [v for _, v in templates])
    lengths = [*LENGTHS]
    while len(refs.words) and refs.words.max() > lengths[-1]:
        lengths.append(2 * lengths[-1])
    tables = []
    for c in lengths:
        least = max([0, *(x for x in lengths if x < c)])
        own = np.flatnonzero((refs.words > least) & (refs.words <= c))
        sets = [refs.codes[np.array([o in refs.owner[a:b] for a, b in zip(refs.at[:-1], refs.at[1:])])] for o in own]
        table = []
        for k in range(BANDS * ROWS):
            flags, values = np.zeros(1 << 16, bool), {}
            for s, o in zip(sets, own):
                values.setdefault(int(_permuted(s, k).min()), []).append(int(o))
            flags[[v >> 16 for v in values]] = True
            table.append((flags, values))
        tables.append(table)
    return refs, refs.need(share), tables


def candidates(w: Words, runs: tuple[np.ndarray, np.ndarray, np.ndarray], tables) -> dict[int, set[int]]:
    """Templates that share a band with a window, by document.

    A window's minimum is one of its four blocks' minima, so only windows of
    blocks whose minimum is a template's are looked at.
    """
    code, doc, _ = runs
    out: dict[int, set[int]] = {}
    if not len(code):
        return out
    size = np.bincount(doc, minlength=len(w.first) - 1)
    first = np.concatenate([[0], np.cumsum(size)])
    levels = [np.flatnonzero((np.arange(len(code)) - first[doc]) % (LENGTHS[0] // 4) == 0)]
    owners = [doc[levels[0]]]
    for _ in tables[1:]:
        owner = owners[-1]
        levels.append(np.flatnonzero((np.arange(len(owner)) - np.searchsorted(owner, owner)) % 2 == 0))
        owners.append(owner[levels[-1]])
    for k in range(BANDS * ROWS):
        block = _permuted(code, k)
        for starts, owner, (flags, values) in zip(levels, owners, (t[k] for t in tables)):
            block = np.minimum.reduceat(block, starts)
            if not values:
                continue
            for at in np.flatnonzero(flags[block >> np.uint32(16)]):
                v, d = int(block[at]), int(owner[at])
                if v not in values:
                    continue
                for b in range(max(0, at - 3), at + 1):
                    window = block[b : b + 4][owner[b : b + 4] == d]
                    if owner[b] == d and window.min() == v:
                        out.setdefault(d, set()).update(values[v])
                        break
    return dict(sorted(out.items()))


def scan(text: pa.Array, share: float = SHARE, templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES.items())) -> list[tuple[int, int, int, int, int]]:
    refs, need, tables = _index(share, templates)
    out = []
    for row, part in chunks(text):
        w = words(part)
        runs = shingles(w, SIZE)
        found = candidates(w, runs, tables)
        index = hits(refs, runs[0])
        for at, ref in zip(*index):
            for o in refs.owner[refs.at[ref] : refs.at[ref + 1]]:
                if refs.distinct[o] < LEAST * LENGTHS[0]:
                    found.setdefault(int(runs[1][at]), set()).add(int(o))
        if found:
            out += [(row + d, o, s, n, t) for d, o, s, n, t in verify(refs, w, dict(sorted(found.items())), need, runs, index)]
    return out


def license_scan(docs: DataFrame, share: float = SHARE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, first_word, matched, runs) of every document and template (name: text) that it contains."""
    arrow = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), *[(n, pa.int64()) for n in ("first_word", "matched", "runs")]])
    named = tuple(templates.items())

    def run(batches):
        refs: References = _index(share, named)[0]
        for batch in batches:
            found = scan(batch.column(1), share, named)
            ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([refs.ids[f[1]] for f in found], pa.string()), *[pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4)]], schema=arrow)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, license string, first_word bigint, matched bigint, runs bigint")


_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
SQL = containment_sql("documents", f"(VALUES {_ROWS}) AS t(license, text)", "license", SHARE)
