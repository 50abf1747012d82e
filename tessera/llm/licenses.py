"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column_bytes, hashed_words, small_batches
from tessera.llm.decontam import grams

RUN, WINDOW, BAND, COVERAGE = 3, 3, 16, 0.8
#: Whole texts of the shorter public licenses; of the longer ones the notices that files carry, and one-line forms (fixed values).
TEMPLATES = {
    "0BSD-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0-text": 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT-line": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions whose fingerprint is the (rightmost) least of some window of consecutive ones."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(h[::-1].argmin())]) if len(h) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(1))


def index_templates(templates: dict[str, str]) -> dict:
    """The inverted index: sorted fingerprints with the template and position that each comes from."""
    names, words, rows = sorted(templates), [], []
    for t, name in enumerate(names):
        raw = np.frombuffer(templates[name].encode(), np.uint8)
        h = next(hashed_words(_PLAIN[raw], np.array([0, len(raw)])))[0]
        words.append(h)
        g = min(RUN, len(h))
        prints = grams(h, g)
        rows += [(g, int(prints[p]), t, int(p)) for p in winnow(prints)]
    rows.sort()
    by = {g: [np.array(c, d) for c, d in zip(zip(*[r[1:] for r in rows if r[0] == g], strict=True), (np.uint64, np.int64, np.int64), strict=True)] for g in {r[0] for r in rows}}
    return {"names": names, "words": words, "prints": by}


def banded(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end) of the longest common subsequence of template and text that stays within `band` of the
    diagonal text = template + shift; first and end bound the matched words of text.  Of equal ones the leftmost."""
    width = 2 * band + 1
    cells, lo = np.arange(width), shift - band
    # Cell b of row i stands for text position i + lo + b; beyond the text stands a word that no template has.
    span = np.zeros(len(template) + width, np.uint64)
    inside = np.arange(max(lo, 0), min(lo + len(span), len(text)))
    there = np.zeros(len(span), bool)
    span[inside - lo], there[inside - lo] = text[inside], True
    score, first, last = np.zeros(width + 1, np.int64), np.full(width + 1, -1), np.full(width + 1, -1)
    for i, w in enumerate(template):
        met = (span[i : i + width] == w) & there[i : i + width]
        # The same text position is one cell further in the row before; a match extends the same cell of that row.
        new, nf, nl = score[1:].copy(), first[1:].copy(), last[1:].copy()
        up = met & (score[:-1] + 1 > new)
        at = i + lo + cells
        nf = np.where(up, np.where(score[:-1] == 0, at, first[:-1]), nf)
        nl = np.where(up, at + 1, nl)
        new = np.where(up, score[:-1] + 1, new)
        # Leaving text words out: each cell takes the nearest best one at or before it.
        src = np.maximum.accumulate(np.where(new >= np.maximum.accumulate(new), cells, 0))
        score[:-1], first[:-1], last[:-1] = new[src], nf[src], nl[src]
    best = int(score.argmax())
    return int(score[best]), int(first[best]), int(last[best])


def find(words: np.ndarray, index: dict, coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first, end) of each place that covers enough of a template, best first where they overlap.

    Hits of a template are aligned from left to right; what an earlier place of it has matched is out of reach of the next
    alignment, so copies that follow each other closely each get a place.  A hit is passed over only where it lies in such
    a place, or on a diagonal near one that has just failed with the same words in reach.
    """
    hits = set()
    for g, (prints, who, where) in index["prints"].items():
        if len(words) < g:
            continue
        x = grams(words, g)
        lo = np.searchsorted(prints, x)
        for p in np.flatnonzero(prints[np.minimum(lo, len(prints) - 1)] == x):
            k = int(lo[p])
            while k < len(prints) and prints[k] == x[p]:
                hits.add((int(who[k]), int(p), int(where[k])))
                k += 1
    out, taken, failed = [], {}, {}
    for t, p, w in sorted(hits):
        from_ = taken.get(t, 0)
        if p < from_ or any(abs(p - w - s) <= BAND // 2 for s in failed.get((t, from_), ())):
            continue
        m, a, b = banded(index["words"][t], words[from_:], p - w - from_)
        if m >= coverage * len(index["words"][t]):
            out.append((t, m, a + from_, b + from_))
            taken[t] = b + from_
        else:
            # Only the last few diagonals can be near those of hits that are still to come.
            failed[t, from_] = [*failed.get((t, from_), [])[-8:], p - w]
    kept = []
    for t, m, a, b in sorted(out, key=lambda r: (-r[1], len(index["words"][r[0]]), r[0], r[2])):
        if not any(a < d and c < b for _, _, c, d in kept):
            kept.append((t, m, a, b))
    return sorted(kept, key=lambda r: (r[2], r[0]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, matched, template_words, coverage, start, end) for each place of a text that covers at least
    `coverage` of a template's words, in order.  Words are runs of ASCII letters and digits or other code points, in lower
    case.  start and end are code points.  Null and empty texts have none; very long texts are read whole; of equally good
    places that overlap the shorter template's, then that first by name, stays; equal rows are reported each; an empty
    table gives an empty result; other columns are ignored.  The index holds the given templates only and goes to every
    executor."""
    small_batches(docs.sparkSession)
    index = index_templates(templates)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            lo, hi = int(offsets[0]), int(offsets[-1])
            flat = np.full(len(data), 32, np.uint8)
            flat[lo:hi] = _PLAIN[data[lo:hi]]
            rows, got = [], []
            for k, (h, s, e) in enumerate(hashed_words(flat, offsets)):
                for t, m, a, b in find(h, index, coverage):
                    start = len(data[int(offsets[k]) : s[a]].tobytes().decode())
                    size = len(index["words"][t])
                    rows.append(k)
                    got.append((index["names"][t], m, size, m / size, start, start + len(data[s[a] : e[b - 1]].tobytes().decode())))
            columns = list(zip(*got, strict=True)) if got else [[]] * 6
            types = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "license", "matched", "template_words", "coverage", "start", "end"])

    return plain.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, license string, matched int, template_words int, coverage double, start int, `end` int")
