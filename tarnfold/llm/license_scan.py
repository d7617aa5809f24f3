"""Licence notices in documents: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

A text's word shingles are cut into blocks of w, for w the powers of two; a window is two neighbouring blocks, so any
stretch of up to w shingles lies whole within one. A template of n shingles is sought in the windows of the least
w >= n. A window that holds three quarters of it then has a Jaccard similarity of at least 0.75 / 4.25 = 0.176 with it,
and one of 64 bands of one row collides with a probability above 1 - (1 - 0.176) ** 64 > 0.99999.
Candidates are verified by the exact share of the template's shingles in the window, compared as words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, ship, texts
from .license_texts import TEXTS
from .textnum import LOWER, WORDLIKE, chain, column_bytes, runs, word_hashes

SHINGLE, BANDS, CONTAINED = 5, 64, 0.75
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_RNG = np.random.default_rng(4711)
_A = _RNG.integers(0, 1 << 31, BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS, dtype=np.uint32)

#: Fixed texts: notices and terms of public licences.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    **TEXTS,
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit shingle hashes of all texts and len+1 offsets; a text of fewer words than SHINGLE has none."""
    words, first = word_hashes(data, offsets, WORDLIKE)
    n = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    h = (chain(words, SHINGLE) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum(n)])
    return h[np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(first[:-1], n)], at


def _blocks(at: np.ndarray, w: int) -> np.ndarray:
    """len+1 offsets of each text's blocks of w."""
    return np.concatenate([[0], np.cumsum(-(-np.diff(at) // w))])


def _tuples(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)}


class Templates:
    def __init__(self, texts: dict[str, str]):
        data = [x.encode() for x in texts.values()]
        h, at = _shingles(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64))
        self.names = list(texts)
        self.exact = [_tuples(_WORD.findall(x.lower())) for x in data]
        self.sets = [np.unique(h[a:b]) for a, b in zip(at, at[1:], strict=False)]
        self.width = [1 << max(2, (len(s) - 1).bit_length()) if len(s) else 0 for s in self.sets]
        self.scales = sorted({w for w in self.width if w})
        self.mins = {w: [i for i, x in enumerate(self.width) if x == w] for w in self.scales}
        #: by width and band: the templates' least values, sorted, and whose they are
        self.bands: dict[int, list] = {}
        for w, own in self.mins.items():
            rows = []
            for k in range(BANDS):
                values = np.array([(self.sets[i] * _A[k] + _B[k]).min() for i in own], np.uint32)
                order = np.argsort(values, kind="stable")
                rows.append((values[order], np.array(own)[order]))
            self.bands[w] = rows

    def candidates(self, h: np.ndarray, at: np.ndarray) -> dict[int, set[tuple[int, int]]]:
        """By width: (block, template) where the window of the block and the next one of its text collides in some band."""
        found: dict[int, set[tuple[int, int]]] = {w: set() for w in self.scales}
        if not len(h):
            return found
        full = np.diff(at) > 0
        for k in range(BANDS):
            least, bounds, w = h * _A[k] + _B[k], at, 1
            for scale in self.scales:
                step = scale // w
                own = _blocks(bounds, step)
                n = np.diff(own)
                starts = np.repeat(bounds[:-1], n) + (np.arange(own[-1]) - np.repeat(own[:-1], n)) * step
                least, bounds, w = np.minimum.reduceat(least, starts), own, scale
                window = np.minimum(least, np.append(least[1:], least[-1:]))
                ends = bounds[1:][full] - 1
                window[ends] = least[ends]
                values, owner = self.bands[scale][k]
                lo, hi = np.searchsorted(values, window, "left"), np.searchsorted(values, window, "right")
                for b in np.flatnonzero(hi > lo).tolist():
                    found[scale].update((b, int(owner[x])) for x in range(lo[b], hi[b]))
        return found

    def share(self, i: int, words: list[bytes]) -> float:
        """The share of a template's shingles that these words hold."""
        return len(self.exact[i] & _tuples(words)) / len(self.exact[i])

    def scan(self, h: np.ndarray, at: np.ndarray, words: Callable[[int], list[bytes]]) -> list[tuple[int, int, float, int]]:
        """(text number, template, containment, first shingle of the best window) for templates contained in texts, of which words gives each one's."""
        best: dict[tuple[int, int], tuple] = {}
        for w, met in self.candidates(h, at).items():
            own = _blocks(at, w)
            for b, i in met:
                d = int(np.searchsorted(own, b, "right")) - 1
                lo = int(at[d]) + (b - int(own[d])) * w
                window = h[lo : min(lo + 2 * w, int(at[d + 1]))]
                if np.isin(self.sets[i], window).mean() < CONTAINED:
                    continue
                share = self.share(i, words(d)[lo - int(at[d]) : lo - int(at[d]) + len(window) + SHINGLE - 1])
                if share >= CONTAINED and ((d, i) not in best or (-share, lo) < (-best[d, i][2], best[d, i][3])):
                    best[d, i] = (d, i, share, lo)
        return [(d, i, share, lo - int(at[d])) for d, i, share, lo in best.values()]


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, first_shingle) for each template of which a window of the text holds 0.75 or more.

    Of a text's windows that with the largest share is given, the first of equals. Null, empty and short texts
    hold nothing; a text may be of any length; rows that repeat give rows that repeat; an empty table gives no rows; other
    columns are ignored. Templates are a short list given by the caller; those of fewer than SHINGLE words match nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(shared.value)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in runs(offsets):
                words = cache(lambda d, i=i: _WORD.findall(LOWER[data[offsets[i + d] : offsets[i + d + 1]]].tobytes()))
                rows = t.scan(*_shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), words)
                if rows:
                    d, x, share, lo = zip(*sorted(rows), strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + k for k in d])), pa.array([t.names[k] for k in x]), pa.array(share), pa.array(lo, pa.int32())], ["doc_id", "license", "containment", "first_shingle"])

    return mapped(texts(docs), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, containment double, first_shingle int")
