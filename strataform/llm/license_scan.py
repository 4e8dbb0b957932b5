"""License scans with a generalised suffix automaton (operator 10).

The token sequences of licence templates (phrases of a licence's name among them) go into one suffix
automaton. A text's words are streamed through it, which yields matching statistics: at each word, how
many of the last words stand in a template just so. Phrases are found where a match ends in one; long
maximal matches are chained, in the order of text and template, into the spans that a template covers.
A template covered widely enough adds its label and its spans. A span ends where the text is too far from the
next match, or where it goes back in a template that is covered widely enough already (the next notice begins).

Defined results: a null or empty text has no words, no labels (empty strings), null places, no spans and score 0.
Rows are judged each on its own, so ties, repeated rows and empty tables need no rule; of chains that cover
equally much the one that ends first counts. Other columns of the input pass through, except that names of the result
win. Very long texts are streamed whole; what a chain can follow is only what ended within the gap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from strataform.llm import words as W
from strataform.llm.store import steps, text_buffers

WORD = np.ones(256, bool)
WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices and texts of public licences; a label is the name up to a slash.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "cc-by": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of
        this license, visit http://creativecommons.org/licenses/by/4.0/""",
    "mit/text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "bsd/text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior
        written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS
        OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    "isc/text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such,
        and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from
        any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
        author or authors of this software dedicate any and all copyright interest in the software to the public domain.
        We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
        We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
        this software under copyright law.""",
}


@dataclass(frozen=True)
class ScanRules:
    """``min_match``: words of a maximal match that may join a chain; ``max_gap``: the most words of the text between
    two chained matches; ``min_cover``: the share of a template that a chain covers to add its label."""

    min_match: int = 4
    max_gap: int = 16
    min_cover: float = 0.5
    phrases: dict = field(default_factory=lambda: dict(PHRASES))
    templates: dict = field(default_factory=lambda: dict(TEMPLATES))


def split(text: str) -> list[bytes]:
    """The words of a template, as of a text."""
    raw = W.LOWER[np.frombuffer(text.encode(), np.uint8)]
    s, e, _ = W.spans(WORD[raw], np.array([0, len(raw)]))
    return [raw[a:b].tobytes() for a, b in zip(s, e, strict=True)]


class Automaton:
    """Suffix automaton of several token sequences, with where each state's strings end in each sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.long = [-1], [0]
        self._met: list[dict[int, set[int]]] = [{}]
        ends = self._met
        for which, seq in enumerate(sequences):
            last = 0
            for at, token in enumerate(seq):
                last = self._extend(last, token)
                ends[last].setdefault(which, set()).add(at + 1)
        for v in sorted(range(1, len(self.long)), key=self.long.__getitem__, reverse=True):
            for which, at in ends[v].items():
                ends[self.link[v]].setdefault(which, set()).update(at)
        #: Of each state, by sequence, all places where its strings end, ascending.
        self.ends: list[dict[int, list[int]]] = [{which: sorted(at) for which, at in of.items()} for of in ends]

    def _state(self, long: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.long.append(long)
        self.link.append(link)
        self._met.append({})
        return len(self.long) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """The state for the longest string of ``p`` and ``token``, parted from ``q`` if that holds longer ones."""
        if self.long[q] == self.long[p] + 1:
            return q
        clone = self._state(self.long[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token, self.next[last][token])
        new = self._state(self.long[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, token, self.next[p][token])
        return new


class Scanner:
    """Compiled once per Python worker from the rules."""

    def __init__(self, rules: ScanRules):
        self.rules = rules
        named = [*((label, split(p), True) for p, label in rules.phrases.items()), *((name.split("/")[0], split(t), False) for name, t in rules.templates.items())]
        vocab = sorted({w for _, seq, _ in named for w in seq})
        flat = np.frombuffer(b"".join(vocab), np.uint8)
        cut = np.cumsum([0, *map(len, vocab)])
        hashed = W.hashes(flat, cut[:-1], cut[1:])
        self.order = np.argsort(hashed)
        self.known = hashed[self.order]
        ids = {w: i + 1 for i, w in enumerate(vocab)}
        self.labels = [label for label, _, _ in named]
        self.sizes = [len(seq) for _, seq, _ in named]
        self.is_phrase = [flag for _, _, flag in named]
        #: Runs of template words that are shorter hold neither a phrase nor a match to chain.
        self.least = min([rules.min_match, *(len(seq) for _, seq, flag in named if flag)])
        self.sam = Automaton([[ids[w] for w in seq] for _, seq, _ in named])
        # phrases that end in each state: their own state is reached from it by suffix links
        sam = self.sam
        self.phrases: list[tuple[tuple[int, int], ...]] = [()] * len(sam.long)
        own: dict[int, list[tuple[int, int]]] = {}
        for which, (_, seq, flag) in enumerate(named):
            if flag:
                v = 0
                for w in seq:
                    v = sam.next[v][ids[w]]
                own.setdefault(v, []).append((len(seq), which))
        for v in sorted(range(1, len(sam.long)), key=sam.long.__getitem__):
            self.phrases[v] = (*self.phrases[sam.link[v]], *own.get(v, ()))

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """Template word numbers from 1 for word hashes, 0 for other words."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.order[at] + 1, 0)

    def run(self, tokens: list[int], begin: int, places: list, matches: list) -> None:
        """Matching statistics over one run of template words; ``begin``: the place of its first word."""
        nxt, link, long, phrases, ends, least = self.sam.next, self.sam.link, self.sam.long, self.phrases, self.sam.ends, self.rules.min_match
        v = n = 0
        for i, token in enumerate(tokens):
            w = nxt[v].get(token)
            if w is None:
                if n >= least:
                    matches.append((begin + i - n, n, ends[v]))
                while v and w is None:
                    v = link[v]
                    w = nxt[v].get(token)
                n = long[v]
            if w is None:
                v = n = 0
                continue
            v, n = w, n + 1
            for size, which in phrases[v]:
                if size <= n:
                    places.append((begin + i - size + 1, which))
        if n >= least:
            matches.append((begin + len(tokens) - n, n, ends[v]))

    def chains(self, matches: list) -> tuple[dict[int, int], list[tuple[int, int, int, int]]]:
        """The most words of each template that a chain covers, and the spans (start, end, template, cover).

        ``matches`` (start, words, ends by template) ascend by start and by end. A match follows another if it ends later
        in the template and begins within the gap; words that both hold, in text or template, count once.
        """
        found: dict[int, list[tuple[int, int, int]]] = {}
        for start, n, ends in matches:
            for which, at in ends.items():
                if not self.is_phrase[which]:
                    found.setdefault(which, []).extend((start, n, end) for end in at)
        best, spans = {}, []
        for which, of in found.items():
            need = self.rules.min_cover * self.sizes[which]
            every: list[tuple[int, int, int, int]] = []  # all chains that a match may follow: text end, template end, cover, start
            fresh: list[tuple[int, int, int, int]] = []  # those since the last span
            top = last = (0, 0, 0, 0)
            for start, n, end in of:
                if last[2] >= need and start >= last[0] and (start > last[0] + self.rules.max_gap or end <= last[1]):
                    spans.append((last[3], last[0], which, last[2]))
                    fresh, last = [], (0, 0, 0, 0)
                every, longest = self._follow(every, start, n, end)
                fresh, newest = self._follow(fresh, start, n, end)
                top, last = max(top, longest, key=lambda c: c[2]), max(last, newest, key=lambda c: c[2])
            if last[2] >= need:
                spans.append((last[3], last[0], which, last[2]))
            best[which] = top[2]
        return best, sorted(spans)

    def _follow(self, chains: list[tuple[int, int, int, int]], start: int, n: int, end: int) -> tuple[list[tuple[int, int, int, int]], tuple[int, int, int, int]]:
        """The chains still within the gap of a match, with its own longest one, and that one."""
        near = [c for c in chains if start - c[0] <= self.rules.max_gap]
        longest = (start + n, end, n, start)
        for text_end, template_end, cover, begin in near:
            lap = max(0, text_end - start, template_end - (end - n))
            if template_end < end and lap < n and cover + n - lap > longest[2]:
                longest = (start + n, end, cover + n - lap, begin)
        near.append(longest)
        return near, longest


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
SCHEMA = [StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()), StructField("last_word", LongType()), StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType())]
SPAN = StructType([StructField("label", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("cover", DoubleType())])
SCHEMA.append(StructField("spans", ArrayType(SPAN)))
ARROW = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))]


def scan(texts: pa.Array, scanner: Scanner) -> list[list]:
    """The result's columns for an arrow string array; spans are in words, their ends exclusive, cover as a share."""
    buf, ofs, n = text_buffers(texts)
    buf = W.LOWER[buf]
    s, e, first = W.spans(WORD[buf], ofs)
    ids = scanner.tokens(W.hashes(buf, s, e))
    rs, re, _ = W.spans(ids > 0, first)
    wide = re - rs >= scanner.least
    rs, re = rs[wide], re[wide]
    own = np.searchsorted(first, rs, side="right") - 1
    cols: list[list] = [np.diff(first).tolist(), [0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n, [[] for _ in range(n)]]
    k = 0
    while k < len(rs):
        d, places, matches = int(own[k]), [], []
        while k < len(rs) and own[k] == d:
            scanner.run(ids[rs[k] : re[k]].tolist(), int(rs[k] - first[d]), places, matches)
            k += 1
        found, score = {scanner.labels[w] for _, w in places}, 1.0 if places else 0.0
        more = set(found)
        best, spans = scanner.chains(matches)
        for which, cover in best.items():
            share = min(1.0, cover / scanner.sizes[which])
            score = max(score, share)
            if share >= scanner.rules.min_cover:
                more.add(scanner.labels[which])
        cols[7][d] = [(scanner.labels[which], a, b, min(1.0, cover / scanner.sizes[which])) for a, b, which, cover in spans]
        if places:
            at = [p for p, _ in places]
            cols[1][d], cols[2][d], cols[3][d] = len(at), min(at), max(at)
        cols[4][d], cols[5][d], cols[6][d] = ",".join(sorted(found)), ",".join(sorted(more)), score
    return cols


def license_scan(docs: DataFrame, rules: ScanRules = ScanRules(), text: str = "text") -> DataFrame:
    """``docs`` with the scan's columns: one narrow pass."""
    src = docs.select([c for c in docs.columns if c not in COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in steps(batches, text):
            cols = scan(b.column(b.schema.get_field_index(text)), scanner)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, ARROW, strict=True))], names=[*b.schema.names, *COLUMNS])

    return src.mapInArrow(run, StructType([*src.schema.fields, *SCHEMA]))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and how many spans templates cover."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text").withColumn("spans", F.size("spans"))
