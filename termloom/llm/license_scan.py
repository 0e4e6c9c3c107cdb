"""Operator 1, license scans: winnowed fingerprints pick candidates, banded alignment measures them.

Template words (lower-case letters and digits) are fingerprinted: hashes of GRAM consecutive words, of
which winnowing keeps the least of every WINNOW. An inverted index maps a fingerprint to (template,
position). The templates are a parameter; their index is bounded by MAX_TEMPLATE_WORDS, checked, and sent
to the tasks. Equal fingerprints of a document vote for (template, diagonal); a template with enough votes
near a diagonal is a candidate there. Its words are aligned with the document's inside bands of
BAND diagonals to either side of its candidates, chained in order, and the matched words give coverage
(share of the template) and the span in the document. Nothing is shuffled.

Defined cases: null and empty texts match nothing; of overlapping matches of one template the one that
covers more is kept, the earlier of equals; repeated rows are scanned each by itself; empty tables give
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession

from termloom.llm.common import table

GRAM, WINNOW, BAND = 3, 4, 8
COVERAGE = 0.6
#: Share of a template's fingerprints that must meet near one diagonal (one at least).
VOTES = 0.1
MAX_TEMPLATE_WORDS = 200_000
_WORD = re.compile(r"[^\W_]+")

#: License texts, parts of them that stand alone, and notices by name: fixed values.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "All rights reserved": "All rights reserved.",
    "MIT line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause conditions": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
    "BSD-2-Clause conditions": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "BSD warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "ISC permission": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "ISC warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Variants of one text: of their overlapping matches the one with the fewest words left over stays.
SIBLINGS = [{"BSD-2-Clause", "BSD-3-Clause"}, {"BSD-2-Clause conditions", "BSD-3-Clause conditions"}, {"GPL-3.0", "LGPL-3.0", "AGPL-3.0"}]


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in _WORD.finditer(text)]


def fingerprints(words: list[str]) -> list[tuple[int, int]]:
    """(hash, position) of the grams that winnowing keeps; a text below one gram is one itself."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return [(hash_of(words), 0)] if words else []
    grams = [hash_of(words[i : i + GRAM]) for i in range(n)]
    out, last = [], -1
    for i in range(max(1, n - WINNOW + 1)):
        window = grams[i : i + WINNOW]
        least = min(window)
        at = i + max(k for k, g in enumerate(window) if g == least)
        if at != last:
            out.append((least, at))
            last = at
    return out


def hash_of(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words))


class Index:
    """Templates' words, the inverted index of their fingerprints, and the words that can begin one."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {name: [w for w, _, _ in words_of(text.lower())] for name, text in templates.items()}
        if sum(map(len, self.words.values())) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
        self.posting: dict[int, list[tuple[str, int]]] = defaultdict(list)
        self.first: set[str] = set()
        self.lengths = sorted({min(len(words), GRAM) for words in self.words.values()})
        self.votes: dict[str, int] = {}
        for name, words in self.words.items():
            marks = fingerprints(words)
            self.votes[name] = max(1, round(VOTES * len(marks)))
            for h, at in marks:
                self.posting[h].append((name, at))
                self.first.add(words[at])

    def hits(self, words: list[str]) -> Iterator[tuple[str, int, int]]:
        """(template, its position, the document's) of equal fingerprints.

        Grams that start with a word that starts no fingerprint can't be in the index; the others are
        looked up at every position, which finds whatever winnowing the document as well would find.
        """
        first, posting = self.first, self.posting
        for at in [i for i, w in enumerate(words) if w in first]:
            for k in self.lengths:
                for name, place in posting.get(hash_of(words[at : at + k]), ()):
                    if min(len(self.words[name]), GRAM) == k:
                        yield name, place, at


def aligned(template: list[str], words: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last + 1 in the document) of the best alignment within the band.

    A longest common subsequence between template[i] and words[i + diagonal - band .. + band]; of equal
    ones the shortest stretch of the document that comes first.
    """
    width = 2 * band + 1
    best = [(0, 0, 0)] * width  # (matched, -first, -last) at document offset i + diagonal + (d - band)
    for i, word in enumerate(template):
        new = [(0, 0, 0)] * width
        for d in range(width):
            j = i + diagonal + d - band
            up = best[d + 1] if d + 1 < width else (0, 0, 0)  # template word skipped
            left = new[d - 1] if d else (0, 0, 0)  # document word skipped
            found = max(up, left)
            if 0 <= j < len(words) and words[j] == word:
                m, first, _ = best[d]
                found = max(found, (m + 1, first if m else -j, -(j + 1)))
            new[d] = found
        best = new
    matched, first, last = max(best)
    return matched, -first, -last


def chained(pairs: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(matched words, first, last + 1 in the document) of the longest chain of pairs (template's place,
    document's) that rises in both; of equal ones the shortest stretch of the document that comes first."""
    places = {j: k for k, j in enumerate(sorted({j for _, j in pairs}), 1)}
    tree = [(0, 0)] * (len(places) + 1)  # prefix maxima of (matched, first) by the document's place
    best = (0, 0, 0)
    for i, j in sorted(pairs, key=lambda p: (p[0], -p[1])):  # a template word can't follow itself
        k, found = places[j] - 1, (0, 0)
        while k > 0:
            found = max(found, tree[k])
            k &= k - 1
        here = (found[0] + 1, found[1] if found[0] else j)
        best = max(best, (here[0], here[1] - j, -j))
        k = places[j]
        while k < len(tree):
            tree[k] = max(tree[k], here)
            k += k & -k
    matched, width, last = best
    return matched, width - last, 1 - last


def matches(template: list[str], words: list[str], cells: list[int], coverage: float) -> list[tuple[int, int, int]]:
    """(matched words, first, last + 1) of disjoint stretches that cover enough of the template.

    The pairs of equal words near all candidate diagonals are chained, so a passage inserted in a licence
    (of up to as many words as the template has) or left out of it doesn't break it.
    """
    n, out = len(template), []
    if len(cells) == 1:
        found = aligned(template, words, cells[0] * BAND + BAND // 2)
        return [found] if found[0] >= coverage * n else []
    pairs = set()
    for cell in cells:
        low = cell * BAND + BAND // 2 - BAND
        for i, word in enumerate(template):
            for j in range(max(0, i + low), min(len(words), i + low + 2 * BAND + 1)):
                if words[j] == word:
                    pairs.add((i, j))
    groups: list[list[tuple[int, int]]] = []
    for i, j in sorted(pairs, key=lambda p: p[1]):
        if not groups or j - groups[-1][-1][1] > n + 1:
            groups.append([])
        groups[-1].append((i, j))
    while groups:
        group = groups.pop()
        if len(group) < coverage * n:
            continue
        matched, first, last = chained(group)
        if matched >= coverage * n:
            out.append((matched, first, last))
            groups += [[p for p in group if p[1] < first], [p for p in group if p[1] >= last]]
    return out


def scan(text: str, index: Index, coverage: float = COVERAGE) -> list[tuple[str, int, int, float, int, int]]:
    """(template, matched words, its words, coverage, start, end) in the text, code points, in order."""
    found = words_of(text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text))
    words = [w for w, _, _ in found]
    votes: Counter = Counter((name, (at - place) // BAND) for name, place, at in index.hits(words))
    cells: dict[str, list[int]] = defaultdict(list)
    for (name, cell), n in sorted(votes.items()):
        if n + votes.get((name, cell - 1), 0) + votes.get((name, cell + 1), 0) >= index.votes[name]:
            cells[name].append(cell)
    spans = [(name, *m) for name, own in cells.items() for m in matches(index.words[name], words, own, coverage)]
    left_over = lambda m: (len(index.words[m[0]]) - m[1]) + (m[3] - m[2] - m[1])
    out = []
    for m in spans:
        name, matched, first, last = m
        family = next((f for f in SIBLINGS if name in f), set())
        if not any(o[0] in family and o[0] != name and o[2] < last and o[3] > first and (left_over(o), o[0]) < (left_over(m), name) for o in spans):
            n = len(index.words[name])
            out.append((name, matched, n, matched / n, found[first][1], found[last - 1][2]))
    return sorted(out, key=lambda m: (m[4], m[5], m[0]))


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, template, matched, template_words, coverage, span_start, span_end (code points); a row per match."""
    index = Index(TEMPLATES if templates is None else templates)
    columns = ["doc_id", "template", "matched", "template_words", "coverage", "span_start", "span_end"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *m) for k, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True) if text for m in scan(text, index, coverage)]
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, template string, matched long, template_words long, coverage double, span_start long, span_end long")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
