"""Licence scans: Dice coefficient over word bigrams against licence templates.

Units of a text are its lines, its blocks (lines between blank ones) and the
whole text.  A unit is normalised to words (letters and digits, dotted numbers
kept together, lower case).  With threshold t, the Dice coefficient of bigram
sets of sizes a and b can reach t only if a <= b * (2 - t) / t and the reverse,
and only if they share a * t / (2 - t) bigrams at least.  A unit meets templates
through an index of their bigrams; those outside these bounds are not compared,
and what is left is compared exactly.

Notices in the middle of a line or across lines and blocks are found by windows
over the words of the whole text: from a word pair of a template to a later one,
of at most the template's size times (2 - t) / t.  Of windows that overlap the
best one counts, and one that lies within a matching unit is no match of its own.

Of templates whose coefficients agree to two places the one counts of which
fewest bigrams are missing, so a notice is not taken for a kin with more in common
by chance.  Templates are short notices, whole short licences and, in the folder
licences, the legal texts of the Apache, GNU, Mozilla and CC0 licences.

One pass over the rows, no shuffle; the templates are the only thing sent to
the executors and their number does not depend on the data.  A text is read as a
whole; its words take some twenty times its size while it is.

Defined results: null and empty texts have no licence; a unit of one word has
no bigram and matches nothing; of templates equal in all this the first
licence id wins, of units the first in the text, lines before blocks before
the whole text before windows; equal rows get equal results each; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import chunks, small_batches

THRESHOLD = 0.8

#: Licence ids and the names that notices give them.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL-3.0"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL-2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}
NOTICES = (
    "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under {}",
    "This work is licensed under the {}", "This software is distributed under the terms of the {}", "Available under the {}",
)
#: Longer notices and opening paragraphs, in their usual wording.
TEXTS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}

_GNU = """This {what} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{mark} either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_NO_NAMES = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Whole short licences, and the notices of the other GNU licences.
WHOLE = (
    ("AGPL-3.0", _GNU.format(what="program", stop=":", name="Affero General Public License", mark=",", version="3")),
    ("LGPL-2.1", _GNU.format(what="library", stop=";", name="Lesser General Public License", mark=";", version="2.1")),
    ("LGPL-3.0", _GNU.format(what="library", stop=":", name="Lesser General Public License", mark=",", version="3")),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _NO_NAMES + _BSD_END),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("ISC", TEXTS["ISC"] + """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", TEXTS["MIT"] + """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
)

_WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W\d_]+|[^\W_]+")
_BLOCK = re.compile(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)+")


def templates() -> list[tuple[str, str]]:
    """(licence id, text) of all templates."""
    short = [(key, n.format(name)) for key, names in NAMES.items() for name in names for n in NOTICES]
    legal = [(f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licences").glob("*.txt"))]
    return short + [(key, f"SPDX-License-Identifier: {key}") for key in NAMES] + list(TEXTS.items()) + list(WHOLE) + legal


def words_of(text: str) -> list[str]:
    return [m.group().lower() for m in _WORD.finditer(text)]


def bigrams(text: str) -> set[tuple[str, str]]:
    words = words_of(text)
    return set(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, known: list[tuple[str, str]], threshold: float):
        lengths: dict[frozenset, int] = {}
        found = []
        for key, text in known:
            if grams := frozenset(bigrams(text)):
                lengths[grams] = max(lengths.get(grams, 0), len(words_of(text)) - 1)
                found.append((key, grams))
        self.known = sorted(set(found), key=lambda x: (x[0], len(x[1]), sorted(x[1])))
        self.threshold, self.wide = threshold, (2 - threshold) / threshold
        #: Templates of each bigram.
        self.by: dict[tuple[str, str], list[int]] = {}
        for i, (_, grams) in enumerate(self.known):
            for g in grams:
                self.by.setdefault(g, []).append(i)
        #: Bigrams of a window of each template at most, and those in common at least.
        self.longest = [int(lengths[g] * self.wide) for _, g in self.known]
        self.common = [len(g) / self.wide for _, g in self.known]
        self.least = min(self.common, default=0)

    def best(self, grams: list[tuple[str, str]]) -> tuple[float, str] | None:
        """The coefficient and licence of the best template of those that reach the threshold."""
        by = self.by
        seen = {g for g in grams if g in by}
        if not seen or len(seen) < self.least:
            return None
        met = Counter(i for g in seen for i in by[g])
        close = [(i, n) for i, n in met.items() if n >= self.common[i]]
        if not close:
            return None
        size, found = len(set(grams)), []
        for i, common in close:
            key, own = self.known[i]
            if len(own) <= size * self.wide and size <= len(own) * self.wide and (dice := 2 * common / (len(own) + size)) >= self.threshold:
                found.append((-round(dice, 2), len(own) - common, -dice, key))
        return (-min(found)[2], min(found)[3]) if found else None

    def scan(self, text: str) -> list[tuple[float, str, int, int]]:
        """(coefficient, licence, start, end) of all units that match: lines, blocks of lines, the whole text, windows."""
        spans, words = [], []
        for m in _WORD.finditer(text):
            spans.append(m.span())
            words.append(m.group().lower())
        grams = list(zip(words, words[1:], strict=False))
        if not any(g in self.by for g in grams):
            return []
        units, at = [], 0
        for line in text.split("\n"):
            units.append((at, at + len(line)))
            at += len(line) + 1
        if len(units) > 1:
            units += [m.span() for m in _BLOCK.finditer(text)]
            units.append((0, len(text)))
        found, starts = [], [s for s, _ in spans]
        for s, e in dict.fromkeys(units):
            first, last = bisect_left(starts, s), bisect_left(starts, e) - 1
            if last > first and (b := self.best(grams[first:last])):
                found.append((*b, s, e))
        apart = [w for w in self.windows(spans, grams) if not any(s <= w[2] and w[3] <= e for _, _, s, e in found)]
        return found + apart

    def windows(self, spans: list[tuple[int, int]], grams: list[tuple[str, str]]) -> list[tuple[float, str, int, int]]:
        """The best windows over the words of the whole text, none of which overlap, in order."""
        by = self.by
        seen = {g for g in grams if g in by}
        kinds = Counter(i for g in seen for i in by[g])
        near = [i for i, n in kinds.items() if n >= self.common[i]]
        if not near:
            return []
        before, last = np.full(len(grams), -1), {}
        for at, g in enumerate(grams):
            before[at] = last.get(g, -1)
            last[g] = at
        all_found = []
        for i in near:
            key, own = self.known[i]
            there = np.fromiter((g in own for g in grams), bool, len(grams))
            hits = np.flatnonzero(there)
            reach = np.searchsorted(hits, hits + self.longest[i] - 1, side="right")
            for k in np.flatnonzero(reach - np.arange(len(hits)) >= self.common[i]).tolist():
                first, end = int(hits[k]), int(hits[reach[k] - 1]) + 1
                new = before[first:end] < first  # a bigram counts once in a window
                both, size = np.cumsum(new & there[first:end]), np.cumsum(new)
                ends = hits[k : reach[k]] - first
                dice = 2 * both[ends] / (len(own) + size[ends])
                top = len(dice) - 1 - int(np.argmax(dice[::-1]))  # of equal ones the last
                if dice[top] >= self.threshold:
                    all_found.append((-round(float(dice[top]), 2), len(own) - int(both[ends[top]]), -float(dice[top]), -len(own), key, first, first + int(ends[top])))
        taken, kept = [], []
        for _, _, dice, _, key, first, end in sorted(all_found):
            # Word pairs first to end hold the words first to end + 1.
            at = bisect_right(taken, (first, end))
            if (at == 0 or taken[at - 1][1] + 1 < first) and (at == len(taken) or end + 1 < taken[at][0]):
                taken.insert(at, (first, end))
                kept.append((-dice, key, spans[first][0], spans[end + 1][1]))
        return sorted(kept, key=lambda x: x[2])


def licenses(docs: DataFrame, threshold: float = THRESHOLD, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row: doc_id, n_units (that match), licenses (their distinct ids, sorted), license, dice, start and end of the best unit."""
    known = templates() if known is None else known
    schema = "doc_id long, n_units long, licenses array<string>, license string, dice double, start long, end long"

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, threshold)
        for batch in chunks(batches, 1):
            out = []
            for text in batch.column(1).to_pylist():
                found = scanner.scan(text) if text else []
                top = min(found, key=lambda x: -x[0], default=(None,) * 4)
                out.append((len(found), sorted({x[1] for x in found}), top[1], top[0], top[2], top[3]))
            columns = [list(x) for x in zip(*out, strict=True)]
            kinds = [pa.int64(), pa.list_(pa.string()), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_units", "licenses", "license", "dice", "start", "end"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(each, schema)
