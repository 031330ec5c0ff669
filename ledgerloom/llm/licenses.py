"""License notices in texts: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are split into words and their word triplets winnowed into an inverted index; of short ones it holds all word
pairs, as an edited word leaves them no triplet. A text's triplets and pairs are looked up there; hits of one template
whose diagonals (place in the text less place in the template) lie near each other are one candidate. A banded alignment around such a diagonal, in which words may differ, be missing or be added, gives the words
matched, their share of the template, and the span of characters between the first and the last match.

Words are runs of letters, digits and dots inside, in lower case. Null and empty texts hold no notice; very long ones are
scanned whole. Each match is reported once; of overlapping ones of different templates, the one with more words matched
stays (ties: first name). Repeated rows are rows of their own; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WordCache, lean

# Notices and bodies as their licenses word them.
TEMPLATES = {
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES",),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
}

#: Long templates are indexed by winnowed triplets of words; those under SHORT words by all their pairs, of which HITS must
#: lie near one diagonal: 0.8 of n words in order keep n - 1 - 2 * (0.2 * n) of n - 1 pairs, 2 at least from 5 words on.
WINDOW, BAND, SHORT, HITS = 2, 3, 16, 2
_WORD = re.compile(r"\w+(?:\.\w+)*")


def words(text: str) -> list[str]:
    return [m.group().lower() for m in _WORD.finditer(text)]


def winnow(grams: list[int], window: int = WINDOW) -> list[int]:
    """Places of the least gram (the last of equals) of every window of neighbours."""
    out: list[int] = []
    for i in range(max(1, len(grams) - window + 1)):
        part = grams[i : i + window]
        if part:
            at = i + max(k for k, g in enumerate(part) if g == min(part))
            if not out or out[-1] != at:
                out.append(at)
    return out


class Index:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.vocabulary: dict[str, int] = {}
        self.templates: list[tuple[str, list[int]]] = []
        for name in sorted(templates):
            for text in templates[name]:
                self.templates.append((name, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]))
        self.base = len(self.vocabulary) + 1
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, ids) in enumerate(self.templates):
            short = len(ids) < SHORT
            grams = [self._gram(ids[i : i + (2 if short else 3)]) for i in range(len(ids) - (1 if short else 2))]
            for at in range(len(grams)) if short else winnow([g * 0x9E3779B97F4A7C15 % (1 << 64) for g in grams]):
                hits[grams[at]].append((t, at))
        self.grams = np.array(sorted(hits), np.int64)
        #: postings of each gram, in its order: template and place there
        self.edges = np.cumsum([0, *(len(hits[g]) for g in self.grams.tolist())])
        self.postings = np.array([x for g in self.grams.tolist() for x in hits[g]], np.int64).reshape(-1, 2)
        self.short = np.array([len(ids) < SHORT for _, ids in self.templates], bool)
        self.codes = WordCache(lambda w: [self.vocabulary.get(x, 0) for x in words(w)])

    def _gram(self, ids):
        """A pair or triplet of words as a number; that of a pair has no word, 0, before it."""
        a, b, c = [0, *ids] if len(ids) == 2 else ids
        return (a * self.base + b) * self.base + c

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal) where a template may be, in order; those within BAND of another are one."""
        found = []
        for size in (2, 3):
            if len(ids) < size:
                continue
            known = np.flatnonzero(np.logical_and.reduce([ids[k : len(ids) - size + 1 + k] > 0 for k in range(size)]))
            gram = self._gram([ids[known + k] for k in range(size)])
            row = np.searchsorted(self.grams, gram)
            hit = np.flatnonzero((row < len(self.grams)) & (self.grams[np.minimum(row, len(self.grams) - 1)] == gram)) if len(self.grams) else row[:0]
            first, n = self.edges[row[hit]], self.edges[row[hit] + 1] - self.edges[row[hit]]
            which = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
            found.append(np.stack([self.postings[which, 0], np.repeat(known[hit], n) - self.postings[which, 1]], 1))
        if not found or not sum(map(len, found)):
            return []
        both = np.concatenate(found)
        t, d = both[np.lexsort((both[:, 1], both[:, 0]))].T
        near = (t[1:] == t[:-1]) & (d[1:] - d[:-1] <= BAND)
        group = np.concatenate([[0], np.cumsum(~near)])
        size = np.bincount(group)
        start = np.flatnonzero(np.concatenate([[True], ~near]))
        real = np.flatnonzero((size >= HITS) | ~self.short[t[start]])
        out = []
        for k in real.tolist():  # a chain of near diagonals may be longer than a band: one candidate each BAND of it
            own, last = d[start[k] : start[k] + size[k]].tolist(), None
            for x in own:
                if last is None or x - last > BAND:
                    out.append((int(t[start[k]]), x))
                    last = x
        return out

    def align(self, text_ids: list[int], template: list[int], diagonal: int) -> tuple[int, int, int]:
        """(words matched, first and last matched place in the text) of the best path within BAND of the diagonal."""
        lo = max(0, diagonal - BAND)
        segment = text_ids[lo : max(lo, diagonal + len(template) + BAND)]
        best: dict[int, tuple[int, int, int]] = {}  # column in the text -> (matched, first, last), of the row before
        for i, word in enumerate(template):
            row: dict[int, tuple[int, int, int]] = {}
            left = (0, -1, -1)
            for j in range(max(0, i + diagonal - lo - BAND), min(len(segment), i + diagonal - lo + BAND + 1)):
                found = max(best.get(j, (0, -1, -1)), left, key=lambda x: (x[0], x[1], -x[2]))
                if segment[j] == word:
                    n, first, _ = best.get(j - 1, (0, -1, -1))
                    hit = (n + 1, lo + j if first < 0 else first, lo + j)
                    if hit[0] > found[0] or hit[0] == found[0] and hit[1] > found[1]:
                        found = hit
                row[j] = left = found
            best = best | row
        return max(best.values(), key=lambda x: (x[0], x[1], -x[2]), default=(0, -1, -1))

    def scan(self, text: str | None, least: float = 0.8) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, words matched, first character, character after the last) in order of place."""
        codes = self.codes
        ids = np.array([i for w in text.split() for i in codes[w]] if text else [], np.int64)  # words never span white space
        near = self.candidates(ids)
        if not near:
            return []
        found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        listed = ids.tolist()
        matches = []
        for t, d in near:
            name, template = self.templates[t]
            n, first, end = self.align(listed, template, d)
            if n >= least * len(template):
                matches.append((n / len(template), n, name, first, end))
        chosen: list[tuple] = []
        for cover, n, name, first, end in sorted(matches, key=lambda x: (-x[1], -x[0], x[2], x[3])):
            if all(end < a or first > b for _, _, _, a, b in chosen):
                chosen.append((cover, n, name, first, end))
        return [(name, cover, n, found[first][0], found[end][1]) for cover, n, name, first, end in sorted(chosen, key=lambda x: x[3])]


SCANNED = "doc_id bigint, n_licenses int, licenses array<string>, matches array<struct<license: string, coverage: double, words: int, start: bigint, end: bigint>>"
_MATCH = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("words", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """One row per document: its distinct licenses in order of name, and every match."""

    def look(batches):
        index = Index(templates)
        for batch in batches:
            found = [index.scan(t, least) for t in batch.column(1).to_pylist()]
            names = [sorted({m[0] for m in f}) for f in found]
            keys = ("license", "coverage", "words", "start", "end")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, names), pa.int32()), pa.array(names, pa.list_(pa.string())), pa.array([[dict(zip(keys, m, strict=True)) for m in f] for f in found], pa.list_(_MATCH))],
                names=["doc_id", "n_licenses", "licenses", "matches"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(look), SCANNED)
