"""Licence scanning with a generalised suffix automaton of licence texts.

The automaton holds every run of words of every template and phrase. A file's
words are streamed through it, which gives at each word the length of the longest
run ending there that some template has (matching statistics). Phrases are read
off the states; maximal matches of at least MIN_MATCH words are chained, template
by template, into spans in template order. A chain's coverage is the share of the
template's words that it covers, words of the file between its matches counting as
words not covered. It gives the template's label from MIN_COVER on, if it covers the
words that decide between licences (numbers of versions and KINDS) and no other word
of KINDS stands between its matches: a notice of another version or kind is no match.

The automaton's size follows the templates alone. Word pairs that no template has
cannot lie inside a match, so only runs of known pairs are streamed; nothing else
is skipped, and whole texts are read, however long.

Defined results: a null or empty text has no words, no labels and score 0; labels
are distinct and sorted; copies get equal answers; an empty table gives no rows;
further columns are ignored. The score is the largest share of a template (or
phrase) that one chain covers.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .workspace import bounded_batches

MIN_MATCH = 4
MIN_COVER = 0.6
MAX_GAP = 12
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,coverage:double>>"

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices by which licences are granted, with SPDX names.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
]

# Words that tell kinds of a licence apart, and the public kinds and versions of one family.
KINDS = frozenset("nc sa nd noncommercial sharealike noderivatives noderivs lesser affero".split())
CC_KINDS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
for kind, name in CC_KINDS.items():
    for version, scope in CC_VERSIONS.items():
        TEMPLATES += [(f"cc-{kind}-{version}", f"CC {kind.upper()} {version}"), (f"cc-{kind}-{version}", f"Creative Commons {name} {version} {scope}"), (f"cc-{kind}-{version}", f"licensed under a Creative Commons {name} {version} {scope} License")]
for name, label, versions in (("GNU General Public License", "gpl", ("2", "3")), ("GNU Lesser General Public License", "lgpl", ("2.1", "3")), ("GNU Affero General Public License", "agpl", ("3",))):
    for version in versions:
        full = version if "." in version else f"{version}.0"
        TEMPLATES += [(f"{label}-{full}", f"{name}, version {version}"), (f"{label}-{full}", f"{name} v{version}"), (f"{label}-{full}", f"licensed under the {name}, version {version}")]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split_words(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


class Automaton:
    """A generalised suffix automaton of word sequences, each with a label."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrases = [(split_words(p), label) for p, label in phrases.items()]
        self.templates = [(split_words(t), label) for label, t in templates]
        if any(len(words) < 2 for words, _ in self.phrases + self.templates):
            raise ValueError("phrases and templates have two words at least")
        vocabulary = sorted({w for words, _ in self.phrases + self.templates for w in words})
        self.code = {w: i for i, w in enumerate(vocabulary)}
        # For each template, where its deciding words stand, and the numbers of kinds that it is not.
        self.decide = [[[i for i, x in enumerate(words) if x == w] for w in sorted({w for w in words if w.isdigit() or w in KINDS or re.fullmatch("v[0-9]+", w)})] for words, _ in self.templates]
        self.others = [{self.code[w] for w in KINDS - set(words) if w in self.code} for words, _ in self.templates]
        joined = [w.encode() for w in vocabulary]
        offsets = np.concatenate(([0], np.cumsum([len(w) for w in joined])))
        self.hashes = tb.piece_hash(np.frombuffer(b"".join(joined), np.uint8), offsets[:-1], offsets[1:])
        self.order = np.argsort(self.hashes)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [[self.code[w] for w in words] for words, _ in self.phrases + self.templates]
        for s in sequences:
            last = 0
            for c in s:
                last = self._extend(last, c)
        self.pair = np.zeros((len(vocabulary), len(vocabulary)), dtype=bool)
        self.ends: list[dict[int, int]] = [{} for _ in self.next]  # state: template, position of the first word after it
        self.says: list[list[int]] = [[] for _ in self.next]  # state: phrases that end there
        for k, s in enumerate(sequences):
            self.pair[s[:-1], s[1:]] = True
            state = 0
            for i, c in enumerate(s):
                state = self.next[state][c]
                at = state
                while at > 0 and k >= len(self.phrases) and k - len(self.phrases) not in self.ends[at]:
                    self.ends[at][k - len(self.phrases)] = i + 1
                    at = self.link[at]
        for k in range(len(self.phrases)):
            state = 0
            for c in sequences[k]:
                state = self.next[state][c]
            self.says[state].append(k)
        for state in sorted(range(1, len(self.next)), key=lambda x: self.length[x]):
            self.says[state] += self.says[self.link[state]]

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, c, known)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        """Part of q's runs, those of length up to length[p] + 1, as a state of their own."""
        copy = self._state(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, or -1 where no template has it."""
        ranked = self.hashes[self.order]
        at = np.minimum(np.searchsorted(ranked, hashes), len(ranked) - 1)
        return np.where(ranked[at] == hashes, self.order[at], -1)

    def statistics(self, run: list[int]):
        """For each word: the length of the longest known run that ends there, and its state."""
        state = length = 0
        for c in run:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            yield length, state


def read_text(automaton: Automaton, runs: list[tuple[int, list[int]]], token: np.ndarray, min_match: int, min_cover: float, max_gap: int):
    """Phrase places (start, phrase) and template spans (label, first word, last word, coverage) of one text. token: the numbers of its words."""
    places, matches = [], {}
    for start, run in runs:
        seen = list(automaton.statistics(run))
        for i, (length, state) in enumerate(seen):
            for k in automaton.says[state]:
                places.append((start + i + 1 - len(automaton.phrases[k][0]), k))
            if length >= min_match or length == len(run):
                if i + 1 == len(seen) or seen[i + 1][0] <= length:
                    for t, end in automaton.ends[state].items():
                        if length >= min(min_match, len(automaton.templates[t][0])):
                            matches.setdefault(t, []).append((start + i + 1 - length, start + i + 1, end - length, end))
    spans = []
    for t, found in matches.items():
        size, chain = len(automaton.templates[t][0]), []
        for m in [*found, None]:
            if chain and (m is None or m[0] - chain[-1][1] > max_gap or m[3] <= chain[-1][3]):
                covered = np.zeros(size, dtype=bool)
                between, at = [], chain[0][0]
                for x in chain:
                    covered[x[2] : x[3]] = True
                    between += token[at : x[0]].tolist()
                    at = max(at, x[1])
                if all(covered[where].any() for where in automaton.decide[t]) and automaton.others[t].isdisjoint(between):
                    spans.append((automaton.templates[t][1], chain[0][0], chain[-1][1] - 1, float(covered.sum() / (size + len(between)))))
                chain = []
            if m is not None:
                chain.append(m)
    return places, [s for s in spans if s[3] >= min_cover], max([s[3] for s in spans], default=0.0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER, max_gap: int = MAX_GAP) -> DataFrame:
    """One row for each document, as in RESULT."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates))

    def each(batches):
        automaton = sent.value
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(1))
            out = []
            for i, j in tb.chunks(offsets):
                hashes, first = tb.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tb.ALNUM)
                token = automaton.tokens(hashes)
                joined = np.zeros(len(token) + 1, dtype=bool)  # word and the one before it are a known pair
                if len(token):
                    joined[1:-1] = (token[:-1] >= 0) & (token[1:] >= 0) & automaton.pair[token[:-1], token[1:]]
                joined[first] = False
                begin = np.flatnonzero(~joined[:-1] & joined[1:])
                end = np.flatnonzero(joined[:-1] & ~joined[1:]) + 1
                owner = np.searchsorted(first, begin, side="right") - 1
                runs: dict[int, list] = {}
                for d, a, b in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True):
                    runs.setdefault(d, []).append((a - int(first[d]), token[a:b].tolist()))
                for d in range(j - i):
                    places, spans, cover = read_text(automaton, runs[d], token[first[d] : first[d + 1]], min_match, min_cover, max_gap) if d in runs else ([], [], 0.0)
                    base = sorted({automaton.phrases[k][1] for _, k in places})
                    at = [p for p, _ in places]
                    out.append((int(first[d + 1] - first[d]), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *(s[0] for s in spans)})), 1.0 if places else cover, [dict(zip(("label", "first_word", "last_word", "coverage"), s, strict=True)) for s in sorted(spans, key=lambda s: (s[1], s[0]))]))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, RESULT)
