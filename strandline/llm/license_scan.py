"""License scans by patience alignment of license templates with a text.

Words are runs of letters, digits, dots and hyphens between them, and non-ASCII characters, A-Z lower-cased.
A template's telling words are those outside COMMON. In a text, places of telling words that lie no further
apart than the template is long, or LONG words, form a stretch; stretches whose telling words could not reach the
threshold are dropped, and the others are aligned in a window that the template's length widens on both sides.
A window with words enough for two copies is split first: from left to right, the copy that ends first is taken
and begins as late as it can, copies being template words in order, no further apart than the template is long
and as many as the threshold asks for. So no other choice holds more copies that do not overlap. Each is
aligned in the words that its neighbours leave to it. Words of a copy of a long template may lie at any distance.

Patience alignment: words that occur once in the window and once in the template are anchors; the longest
increasing subsequence of the anchors in both orders is kept, and the gaps between kept anchors are aligned in
the same way. A gap without an anchor is matched word by word from both of its ends, and what is left of it by
a longest common subsequence. Coverage is the share of the template's words that are matched, and from
THRESHOLD on the stretch or the copy is a find.

Null and empty texts have no finds; a text has a row for every find, with the template that has most words there; repeated rows are
scanned each; extra columns are not read. A map without shuffle; templates are a short list of parameters."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from strandline.llm.common import chunks

THRESHOLD = 0.8
#: Templates of more words are long: their stretches end at gaps of so many words, not of their own length.
LONG = 40

#: Short public license notices. Fixed values.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC0-1.0": "To the extent possible under law, all copyright and related rights have been waived",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
}

_PERMIT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_KEEP = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_SHOW = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."

#: Whole public license texts, and the notices that long licenses ask for. Fixed values.
TEXTS = {
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-text": " ".join((_PERMIT, _KEEP, _SHOW, _AS_IS)),
    "BSD-3-text": " ".join((_PERMIT, _KEEP, _SHOW, _ENDORSE, _AS_IS)),
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0-header": _GNU.format("General Public License", 2),
    "GPL-3.0-header": _GNU.format("General Public License", 3),
    "LGPL-3.0-header": _GNU.format("Lesser General Public License", 3),
    "AGPL-3.0-header": _GNU.format("Affero General Public License", 3),
}

TEMPLATES = NOTICES | TEXTS

#: Words that tell nothing of a license, though one may hold them.
COMMON = frozenset("a all an and any anyone are as at be being but by can copy do event except except express following for form free from had have if in including into is it its kind laws limited list make may means more must name names new no not obtain of on one or other our out over own particular person provided public purpose required see should so source such terms that the their this to under unless use used useful version was way we which will with without work writing you your".split())

_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+(?:[.-][a-z0-9\x80-\U0010ffff]+)*")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        tops[k : k + 1], at[k : k + 1] = [v], [i]
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists."""
    above, took = [0] * (len(b) + 1), []
    for x in a:
        row, from_ = [0], bytearray(len(b) + 1)  # 1: the pair, 2: without x, 0: without b's word
        for j, y in enumerate(b):
            pair = x == y
            from_[j + 1] = 1 if pair else 2 if above[j + 1] >= row[j] else 0
            row.append(above[j] + 1 if pair else max(above[j + 1], row[j]))
        took.append(from_)
        above = row
    out, i, j = [], len(a), len(b)
    while i and j:
        step = took[i - 1][j]
        if step == 1:
            out.append((i - 1, j - 1))
        i, j = i - (step > 0), j - (step < 2)
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b) of the patience alignment, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        once_a: dict[str, int] = {}
        once_b: dict[str, int] = {}
        for once, words, lo, hi in ((once_a, a, a0, a1), (once_b, b, b0, b1)):
            for i in range(lo, hi):
                once[words[i]] = -1 if words[i] in once else i
        anchors = sorted((i, once_b[w]) for w, i in once_a.items() if i >= 0 and once_b.get(w, -1) >= 0)
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        if kept:
            out += kept
            ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 < a1 and b0 < b1:
            out += [(a0 + i, b0 + j) for i, j in common(a[a0:a1], b[b0:b1])]
    return sorted(out)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words_of(text)
        self.telling = {w for w in self.words if w not in COMMON} or set(self.words)
        self.common = sum(w not in self.telling for w in self.words)
        self.places: dict[str, list[int]] = {}
        for j, w in enumerate(self.words):
            self.places.setdefault(w, []).append(j)

    def reaches(self, told: list[str], threshold: float) -> bool:
        """Whether a text with these telling words could cover so much: each counts as often as both sides have it."""
        count = Counter(told)
        return sum(min(c, len(self.places[w])) for w, c in count.items()) + self.common >= threshold * len(self.words)


def copies(words: list[str], t: Template, need: int) -> list[tuple[int, int]]:
    """(first word, last word) of as many copies of `need` words as fit without overlap, each as short as it can be."""
    n = len(t.words)
    if n > LONG:
        return long_copies(words, t, need)
    # for each of the last n words, the template's word it is matched with, and a number of matches: the latest start
    starts = np.full((n, n, need + 1), -1, np.int64)
    out = []
    for i, w in enumerate(words):
        new = np.full((n, need + 1), -1, np.int64)
        for j in t.places.get(w, ()):
            new[j, 1] = i
            if j:
                new[j, 2:] = starts[:, :j, 1:-1].max((0, 1))
        starts[i % n] = new
        if (first := int(new[:, need].max())) >= 0:
            out.append((first, i))
            starts[:] = -1
    return out


def long_copies(words: list[str], t: Template, need: int) -> list[tuple[int, int]]:
    """copies() of a long template, with words of a copy at any distance: no window of states is kept."""
    best = np.full((len(t.words), need + 1), -1, np.int64)  # by the template's last matched word and a number of matches
    out = []
    for i, w in enumerate(words):
        for j in reversed(t.places.get(w, ())):  # so that a word is matched once
            best[j, 1] = i
            if j:
                np.maximum(best[j, 2:], best[:j, 1:-1].max(0), out=best[j, 2:])
        if w in t.places and (first := int(best[t.places[w], need].max())) >= 0:
            out.append((first, i))
            best[:] = -1
    return out


def finds(words: list[str], t: Template, threshold: float) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(start, pairs from there on) of every find of a template in a stretch's window."""
    n = len(t.words)
    need = max(1, math.ceil(threshold * n))
    split = copies(words, t, need) if sum(w in t.places for w in words) >= 2 * need else []
    if len(split) < 2:  # also words that lie further apart than those of copies()
        pairs = align(words, t.words)
        if len(pairs) >= threshold * n:
            yield 0, pairs
            return
        split = split or copies(words, t, need)
    done = 0
    for (first, last), (end, _) in zip(split, [*split[1:], (len(words), 0)]):
        lo = max(done, first - n)
        pairs = align(words[lo : min(end, last + n + 1)], t.words)
        if len(pairs) < need:  # anchors among the words around it or out of order
            lo, pairs = first, common(words[first : last + 1], t.words)
        yield lo, pairs
        done = lo + pairs[-1][0] + 1


def scan(text: str, templates: list[Template], threshold: float = THRESHOLD) -> list[tuple[str, float, int, int, int]]:
    """(name, coverage, matched words, first word, last word) of every find in a text."""
    words = words_of(text)
    have, out = set(words), []
    for t in templates:
        if t.common + sum(len(t.places[w]) for w in t.telling & have) < threshold * len(t.words):
            continue
        places = [i for i, w in enumerate(words) if w in t.telling]
        n = len(t.words)
        k = 0
        while k < len(places):
            m = k + 1
            while m < len(places) and places[m] - places[m - 1] <= min(n, LONG):
                m += 1
            if t.reaches([words[i] for i in places[k:m]], threshold):
                lo, hi = max(0, places[k] - n), min(len(words), places[m - 1] + n + 1)
                for at, pairs in finds(words[lo:hi], t, threshold):
                    out.append((t.name, len(pairs) / n, len(pairs), lo + at + pairs[0][0], lo + at + pairs[-1][0]))
            k = m
    return settled(out)


def settled(finds: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    """Finds in order of their places. Where they overlap, the one with most words is kept: the better coverage on a
    tie, then fewer foreign words, then the name. Kept ones do not overlap, so only the one before a find's end matters."""
    begins: list[int] = []
    kept: list[tuple[str, float, int, int, int]] = []
    for x in sorted(finds, key=lambda x: (-x[2], -x[1], x[4] - x[3], x[0], x[3])):
        k = bisect_right(begins, x[4])  # the kept finds before k begin no later than x ends
        if not k or kept[k - 1][4] < x[3]:
            begins.insert(k, x[3])
            kept.insert(k, x)
    return kept


SCHEMA = "doc_id long, license string, coverage double, matched_words int, first_word int, last_word int"


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(doc_id, license, coverage, matched_words, first_word, last_word), a row for every find."""
    given = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(k, v) for k, v in given.items() if words_of(v)]
        # a find holds a telling word of its template: texts without any are passed by
        some = "(?i)" + "|".join(sorted({re.escape(w) for t in known for w in t.telling}))
        for batch in batches:
            for part in chunks(batch, text):
                texts = part.column(1)
                hit = pc.fill_null(pc.match_substring_regex(texts, some), False)
                ids, out = part.column(0).filter(hit).to_pylist(), []
                for doc_id, value in zip(ids, texts.filter(hit).to_pylist()):
                    out += [(doc_id, *x) for x in scan(value, known, threshold)]
                if out:
                    kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "license", "coverage", "matched_words", "first_word", "last_word"])

    return docs.select("doc_id", text).mapInArrow(run, SCHEMA)
