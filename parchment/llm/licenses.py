"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every substring of every template. Streaming a file's words
through it gives matching statistics: at each word, the longest template
substring that ends there. Maximal matches are chained, template by template,
into spans; a span that covers enough of its template gives a label. The base
phrases are strings of the same automaton: a phrase ends at a word when its
state is on the suffix path of the current match.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

# Phrases that the scan always counts, and the labels they stand for.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Whole texts of short licences, notice wording of long ones.
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
        " following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided as is, without warranty of any"
        " kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable"
        " for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above"
        " copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in"
        " the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
        " from this software without specific prior written permission. This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to,"
        " the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special,"
        " exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of"
        " liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        " The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for"
        " any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising"
        " out of or in connection with the use or performance of this software.",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to"
        " use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be"
        " misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."
        " 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)

MIN_MATCH = 3  # words of a match that may join a chain
MAX_GAP = 12  # words between two matches of a chain, in the file or the template
MIN_COVER = 0.6  # part of a template, or of FULL words of a longer one, that gives a label
FULL = 20

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"

#: Bytes that make words, A-Z lowered; all others part them.
_TABLE = bytes((b + 32) if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ") if text else []


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, strings: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]  # state: string -> last position of one occurrence there
        for k, words in enumerate(strings):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, self.number.setdefault(w, len(self.number) + 1))
                self.ends[last].setdefault(k, at)
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):  # an occurrence counts for all suffixes
            if self.link[v] > 0:
                for k, at in self.ends[v].items():
                    self.ends[self.link[v]].setdefault(k, at)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _part(self, p: int, q: int, c: int) -> int:
        """The state of p's longest word followed by c, split off q if q also holds longer words."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._part(last, self.next[last][c], c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._part(p, self.next[p][c], c)
        return new

    def state_of(self, words: list[bytes]) -> int:
        v = 0
        for w in words:
            v = self.next[v][self.number[w]]
        return v


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.templates = [words_nonempty(t) for _, t in templates]
        self.template_labels = [label for label, _ in templates]
        phrase_words = [words_nonempty(p) for p, _ in phrases]
        self.sam = Automaton(self.templates + phrase_words)
        own = {self.sam.state_of(w): (len(w), label) for w, (_, label) in zip(phrase_words, phrases)}
        self.phrases_at: list[tuple[tuple[int, str], ...]] = []
        for v in range(len(self.sam.next)):
            found, u = [], v
            while u > 0:
                if u in own:
                    found.append(own[u])
                u = self.sam.link[u]
            self.phrases_at.append(tuple(found))

    def scan(self, text: str | None) -> tuple:
        words = [w for w in words_of(text or "") if w]
        nxt, link, length, phrases_at = self.sam.next, self.sam.link, self.sam.length, self.phrases_at
        base: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []  # end (exclusive), length, state
        v = size = 0
        previous = -2
        for i, c in [(i, c) for i, c in enumerate(map(self.sam.number.get, words)) if c]:
            if i != previous + 1 and v:
                if size >= MIN_MATCH:
                    matches.append((previous + 1, size, v))
                v = size = 0
            previous = i
            if c not in nxt[v]:
                if size >= MIN_MATCH:
                    matches.append((i, size, v))
                while v and c not in nxt[v]:
                    v = link[v]
                size = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                size += 1
                for n, label in phrases_at[v]:
                    if size >= n:
                        base.append((i - n + 1, label))
            else:
                v = size = 0
        if size >= MIN_MATCH:
            matches.append((previous + 1, size, v))
        spans = self._chains(matches)
        starts = [at for at, _ in base]
        base_labels = sorted({label for _, label in base})
        labels = sorted({*base_labels, *(label for label, *_ in spans)})
        score = 1.0 if base else max((s[3] for s in spans), default=0.0)
        said = ",".join(f"{label}:{start}:{end}" for label, start, end, _ in spans)
        return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), score, said

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans (label, first word, end, cover) of chains that cover enough of a template."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, v in matches:
            for k, at in self.sam.ends[v].items():
                if k < len(self.templates):
                    by_template.setdefault(k, []).append((end - size, end, at - size + 1))
        found = []
        for k, own in by_template.items():
            need = min(len(self.templates[k]), FULL)
            start, end, t_end, cover = None, 0, 0, 0

            def close():
                if start is not None and cover >= MIN_COVER * need:
                    found.append((self.template_labels[k], start, end, min(1.0, cover / need)))

            for a, b, t in sorted(own):
                new = b - max(a, end)  # neighbouring matches may overlap
                if start is not None and a - end <= MAX_GAP and -MAX_GAP <= t - t_end <= MAX_GAP and b > end:
                    cover += new
                else:
                    close()
                    start, cover = a, b - a
                end, t_end = b, t + (b - a)
            close()
        return sorted(set(found), key=lambda s: (s[1], s[2], s[0]))


def words_nonempty(text: str) -> list[bytes]:
    return [w for w in words_of(text) if w]


_scanner: dict[str, Scanner] = {}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans lists label:first word:end word of covered template spans, the end exclusive.

    Defined cases: a null or empty text has no words, no labels and score 0;
    repeated rows each get their row; an empty table gives no rows; columns
    beyond doc_id and text are not read. Whole texts are streamed, one at a time.
    """

    @F.pandas_udf(SCHEMA)
    def scan(texts: pd.Series) -> pd.DataFrame:
        if "own" not in _scanner:
            _scanner["own"] = Scanner()
        rows = [_scanner["own"].scan(t) for t in texts]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    text_batches(docs.sparkSession)
    return docs.select("doc_id", scan("text").alias("r")).select("doc_id", "r.*")
