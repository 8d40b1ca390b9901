"""License scans with a generalised suffix automaton over licence tokens.

The automaton holds every run of words of the templates and phrases below.  A
text streams through it: at each word it yields the length of the longest run
that ends there and occurs in a template (matching statistics).  Phrases are
read off the suffix links.  Long maximal runs of a template are chained in
order into a span.  A span counts if the chain covers COVERED or more of the
template's words, and if one run holds the words that set the template apart.
Of spans that overlap, the one with the most covered words gives its label:
related licences share most of their words.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import appended

#: Runs shorter than this many words don't enter a chain; share of a template that a chain must cover; words skipped at most between runs.
RUN, COVERED, GAP = 4, 0.7, 40

# The phrases whose places count, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"
_GNU = "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU_END = " is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{}/4.0/"
_CC_SHORT = "licensed under a Creative Commons Attribution{} 4.0 International License"
# Texts and notices of public licences, with their labels and the words that one run must hold ("" if any may).
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        + _AS_IS
        + ", INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "copy modify merge publish",
    ),
    ("mit", "released under the MIT license", "under the mit license"),
    ("mit", "licensed under the MIT license", "under the mit license"),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache license version 2"),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache license version 2",
    ),
    ("bsd-2-clause", _BSD + _BSD_1 + _BSD_2 + _BSD_END, ""),
    ("bsd-3-clause", _BSD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_END, "endorse or promote products derived"),
    ("bsd", _BSD + _BSD_1, ""),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "for any purpose with or without fee",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "for any purpose with or without fee"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License " + _GNU.format(2), "either version 2 of the license"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License " + _GNU.format(3), "either version 3 of the license"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License " + _GNU.format(2) + " This program" + _GNU_END.format("General Public License"), "either version 2 of the license"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License " + _GNU.format(3) + " This program" + _GNU_END.format("General Public License"), "either version 3 of the license"),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + _GNU.format("2.1"), "gnu lesser general public license"),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + _GNU.format(3), "either version 3 of the license"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License " + _GNU.format(3), "gnu affero general public license"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License " + _GNU.format(3) + " This program" + _GNU_END.format("Affero General Public License"), "gnu affero general public license"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "mozilla public license v 2"),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        "",
    ),
    (
        "boost-1",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, "
        "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software.",
        "use reproduce display distribute execute",
    ),
    ("boost-1", "Distributed under the Boost Software License, Version 1.0", "boost software license"),
    *(
        (f"cc-{kind}", form.format(name, kind), f"attribution{name} 4 0 international")
        for form in (_CC, _CC_SHORT)
        for name, kind in (("", "by"), ("-ShareAlike", "by-sa"), ("-NonCommercial", "by-nc"), ("-NoDerivatives", "by-nd"), ("-NonCommercial-ShareAlike", "by-nc-sa"), ("-NonCommercial-NoDerivatives", "by-nc-nd"))
    ),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "has waived all copyright"),
)

#: A-Z to a-z and every other ASCII character but digits and letters to a blank.
TABLE = bytes(32 if i < 0x30 or 0x3A <= i <= 0x40 or 0x5B <= i <= 0x60 or 0x7B <= i <= 0x7F else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: runs of ASCII letters, digits and whatever is beyond ASCII; A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


@dataclass
class Automaton:
    """A generalised suffix automaton over word numbers, with phrases and places of templates at its states."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: per state, the (template, end) places of its runs; per state, the phrases (number, words) that end in its runs
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])
    phrases: list[list[tuple[int, int]]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    #: per state of RUN words or more, the shortest suffix of RUN words or more that has a state: all who hold RUN words are among its places
    base: list[int] = field(default_factory=list)
    #: per template, the first and last place of the words that set it apart, wherever they stand in it
    apart: list[list[tuple[int, int]]] = field(default_factory=list)

    def add(self, words: list[bytes], apart: list[bytes] | None = None) -> None:
        """Insert a template: a new word sequence that starts at the root."""
        template, last = len(self.sizes), 0
        self.sizes.append(len(words))
        self.apart.append([(i, i + len(apart) - 1) for i in range(len(words)) if words[i : i + len(apart)] == apart] if apart else [])
        for i, w in enumerate(words):
            last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
            self.ends[last].append((template, i))

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.length) - 1

    def _extend(self, last: int, w: int) -> int:
        if w in self.step[last]:
            q = self.step[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def finish(self, phrases: list[list[bytes]]) -> Automaton:
        """Hand places and phrases on along the suffix links."""
        rising = sorted(range(len(self.length)), key=self.length.__getitem__)
        for s in reversed(rising[1:]):
            self.ends[self.link[s]] = list(dict.fromkeys([*self.ends[self.link[s]], *self.ends[s]]))
        own: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(phrases):
            s = 0
            for w in words:
                s = self.step[s][self.vocabulary[w]]
            own.setdefault(s, []).append((k, len(words)))
        self.base = list(range(len(self.length)))
        for s in rising[1:]:
            if self.length[self.link[s]] >= RUN:
                self.base[s] = self.base[self.link[s]]
        self.phrases = [[] for _ in self.length]
        for s in rising[1:]:
            self.phrases[s] = [*own.get(s, []), *self.phrases[self.link[s]]]
        return self

    def statistics(self, ids: list[int], start: int):
        """(position, matched words, state) for each of `ids`, all in the vocabulary, the first at `start`."""
        s, n = 0, 0
        for i, w in enumerate(ids, start):
            while s and w not in self.step[s]:
                s = self.link[s]
                n = self.length[s]
            s = self.step[s].get(w, 0)
            n = n + 1 if s else 0
            yield i, n, s


@functools.cache
def automaton() -> Automaton:
    """The automaton of all templates and phrases."""
    a = Automaton()
    for _, text, apart in TEMPLATES:
        a.add(words_of(text), words_of(apart))
    for text in PHRASES:
        a.add(words_of(text))
    return a.finish([words_of(p) for p in PHRASES])


@dataclass
class Scan:
    """n_words; places (start, phrase) of phrases; spans (template, first, last word, covered share)."""

    n_words: int
    places: list[tuple[int, int]]
    spans: list[tuple[int, int, int, float]]


def scan(text: str | None) -> Scan:
    """Scan one whole text; null counts as empty."""
    a, words = automaton(), words_of(text)
    ids = list(map(a.vocabulary.get, words))
    known = np.fromiter((w is not None for w in ids), bool, len(ids))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]])))
    shortest = min(RUN, *(len(words_of(p)) for p in PHRASES))
    places, runs = [], {}
    for first, after in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if after - first < shortest:
            continue
        for i, n, s in a.statistics(ids[first:after], first):
            for phrase, size in a.phrases[s]:
                if size <= n:
                    places.append((i - size + 1, phrase))
            if n >= RUN:
                for template, end in a.ends[a.base[s]]:
                    if template < len(TEMPLATES):  # a run goes on, or one begins that had RUN words before it was seen
                        found = runs.setdefault(template, {}).setdefault(end - i, [])
                        if found and found[-1][1] == i - 1:
                            found[-1] = (found[-1][0], i)
                        else:
                            found.append((i - RUN + 1, i))
    runs = {t: [(x, y, x + d, y + d) for d, found in by.items() for x, y in found] for t, by in runs.items()}
    spans = [(t, *chain) for t, found in sorted(runs.items()) for chain in chains(found, a.sizes[t], a.apart[t])]
    return Scan(len(words), places, _best(spans, a.sizes))


def _best(spans: list[tuple[int, int, int, float]], sizes: list[int]) -> list[tuple[int, int, int, float]]:
    """Spans that overlap none with more covered words (of equal ones: a greater share, then the earlier template), in text order."""
    out = []
    for t, x, y, c in sorted(spans, key=lambda m: (-round(m[3] * sizes[m[0]]), -m[3], m[0], m[1])):
        if all(y < u or v < x for _, u, v, _ in out):
            out.append((t, x, y, c))
    return sorted(out, key=lambda m: (m[1], m[0]))


def chains(runs: list[tuple[int, int, int, int]], size: int, apart: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """Of a template's runs (first, last word in the text; first, last in the template): (first, last, covered share) of the best chain in each stretch of runs no further apart than a chain may reach."""
    out, stretch = [], []
    for run in [*sorted(runs), None]:
        if stretch and (run is None or run[0] - max(r[1] for r in stretch[-8:]) > GAP + size):
            if chain := chained(stretch, size, apart):
                out.append(chain)
            stretch = []
        if run:
            stretch.append(run)
    return out


def chained(runs: list[tuple[int, int, int, int]], size: int, apart: list[tuple[int, int]]) -> tuple[int, int, float] | None:
    """The chain of `runs` that covers most of a template, if it covers enough, a run of it holding the words `apart`."""
    best: list[tuple[int, int, bool]] = []  # words covered, first word in the text, whether the words apart are held
    for k, (x, y, p, q) in enumerate(runs):
        own = not apart or any(p <= i and j <= q for i, j in apart)
        entry = (q - p + 1, x, own)
        for j in range(k - 1, -1, -1):
            if x - runs[j][1] > GAP + size:
                break
            overlap = max(0, runs[j][1] - x + 1, runs[j][3] - p + 1)
            if runs[j][0] < x and runs[j][2] < p and x - runs[j][1] <= GAP and overlap < q - p + 1:
                held = own or best[j][2]
                if (held, best[j][0] + q - p + 1 - overlap) > (entry[2], entry[0]):
                    entry = (best[j][0] + q - p + 1 - overlap, best[j][1], held)
        best.append(entry)
    ends = [(c, -x, y) for (c, x, held), (_, y, _, _) in zip(best, runs, strict=True) if held]
    covered, first, last = max(ends, default=(0, 0, 0))
    return (-first, last, covered / size) if covered >= COVERED * size and covered else None


def scans(df: DataFrame, text: str) -> DataFrame:
    """`df` with n_words, places array<(start, label)> and spans array<(label, first, last, covered)>, in words from 0.

    Null and empty texts have no word and nothing found.  Repeated rows are
    kept; columns named like the new ones are replaced.
    """
    labels = list(PHRASES.values())
    place, span = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        got = [scan(t) for t in b.column(text).to_pylist()]
        return [
            pa.array([g.n_words for g in got], pa.int64()),
            pa.array([[{"start": s, "label": labels[p]} for s, p in g.places] for g in got], place),
            pa.array([[{"label": TEMPLATES[t][0], "first": x, "last": y, "covered": c} for t, x, y, c in g.spans] for g in got], span),
        ]

    return appended(df, text, {"n_words": "long", "places": "array<struct<start:bigint,label:string>>", "spans": "array<struct<label:string,first:bigint,last:bigint,covered:double>>"}, work)


def digest(found: DataFrame) -> DataFrame:
    """`found` with n_base, first_word, last_word, base_labels, labels and score in place of places and spans."""
    starts, base = F.col("places.start"), F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("spans.label"))))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max("spans.covered"), F.lit(0.0))))
    return found.select(
        *(c for c in found.columns if c not in ("places", "spans")),
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        score.alias("score"),
    )
