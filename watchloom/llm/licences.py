"""Licence notices and headers in text, word for word or edited.

Templates are cut into words; hashes of ``GRAM`` consecutive words are winnowed (of each ``WINDOW`` of
them, the least is kept) into an inverted index from fingerprint to (template, place). Of templates under
``SHORT`` words an edit may leave no gram that is kept; those are indexed by single words instead, as many of
their rarest ones as a match may lack, and one. A text's grams and words probe the index; hits of a template on neighbouring diagonals are one candidate, and a banded
alignment of the template with the text around it gives the words matched in order and the span.
A candidate counts if it covers ``COVERAGE`` of the template. Of overlapping candidates the one with
most matched words stays.

The index is that of the templates, whose number is fixed; texts meet it where they lie, without a
shuffle. Defined results: null and empty texts have no rows; spans are code points, end exclusive;
words are runs of letters and digits, compared in lower case; of overlapping matches with equally many
words the one with more coverage, then the earlier, then the first by name stays; very long texts are
searched whole; repeated rows repeat; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

GRAM = 3
WINDOW = 2
COVERAGE = 0.8
#: From this many words on, COVERAGE leaves a run of GRAM + 1 words, of whose grams winnowing keeps one.
SHORT = 8
WORD = re.compile(r"[^\W_]+")

#: Notices and headers as their licences give them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "ARR": "All rights reserved.",
    "MIT-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "BSD-3-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "LGPL-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


@dataclass(frozen=True)
class Match:
    template: str
    coverage: float
    matched: int
    start: int
    end: int


def split(text: str) -> list[str]:
    return WORD.findall(text.lower())


def winnow(hashes: list[int], window: int) -> list[int]:
    """Places of the least hash of each window, of equals the last."""
    if len(hashes) <= window:
        return [max(range(len(hashes)), key=lambda i: (-hashes[i], i))] if hashes else []
    return sorted({max(range(k, k + window), key=lambda i: (-hashes[i], i)) for k in range(len(hashes) - window + 1)})


class Index:
    """The templates' inverted index."""

    def __init__(self, templates: dict[str, str] | None = None, gram: int = GRAM, window: int = WINDOW):
        self.names = sorted(templates or TEMPLATES)
        words = [split((templates or TEMPLATES)[n]) for n in self.names]
        self.ids = {w: i for i, w in enumerate(sorted({x for ws in words for x in ws}))}
        self.words = [np.array([self.ids[x] for x in ws]) for ws in words]
        self.gram, self.base = gram, len(self.ids) + 1
        uses = np.bincount(np.concatenate([np.unique(w) for w in self.words]), minlength=len(self.ids))
        spelt = {i: w for w, i in self.ids.items()}
        self.single: dict[int, list[tuple[int, int]]] = {}
        posts: dict[int, list[tuple[int, int]]] = {}
        for t, ws in enumerate(self.words):
            if len(ws) < SHORT:
                lack = len(ws) - int(np.ceil(COVERAGE * len(ws) - 1e-9))
                rare = sorted(set(ws.tolist()), key=lambda i: (uses[i], -len(spelt[i]), i))
                picked, have = set(), 0
                while have <= lack:  # a word that a template repeats counts as often
                    picked.add(rare.pop(0))
                    have = sum(x in picked for x in ws.tolist())
                for at, x in enumerate(ws.tolist()):
                    if x in picked:
                        self.single.setdefault(x, []).append((t, at))
                continue
            codes = self.codes(ws)
            for at in winnow([self.mixed(int(c)) for c in codes], window):
                posts.setdefault(int(codes[at]), []).append((t, at))
        self.keys = np.array(sorted(posts), np.int64)
        self.posts = [posts[int(k)] for k in self.keys]

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A number for each gram; grams with a word that no template has get -1."""
        n = len(ids) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code, ok = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(self.gram):
            part = ids[k : k + n]
            code = code * self.base + part
            ok &= part >= 0
        return np.where(ok, code, -1)

    @staticmethod
    def mixed(code: int) -> int:
        return (code * 0x9E3779B97F4A7C15 ^ code >> 7) & 0xFFFFFFFFFFFFFFFF

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first diagonal, last diagonal) of clusters of hits."""
        codes = self.codes(ids)
        at = np.flatnonzero(np.isin(codes, self.keys))
        hits: dict[int, list[int]] = {}
        for p in at:
            for t, k in self.posts[int(np.searchsorted(self.keys, codes[p]))]:
                hits.setdefault(t, []).append(int(p) - k)
        for p in np.flatnonzero(np.isin(ids, list(self.single))):
            for t, k in self.single[int(ids[p])]:
                hits.setdefault(t, []).append(int(p) - k)
        out = []
        for t, diagonals in hits.items():
            diagonals.sort()
            a = b = diagonals[0]
            for d in diagonals[1:]:
                if d - b > self.band(t):
                    out.append((t, a, b))
                    a = d
                b = d
            out.append((t, a, b))
        return out

    def band(self, t: int) -> int:
        return 2 + len(self.words[t]) // 8

    def find(self, text: str | None, coverage: float = COVERAGE) -> list[Match]:
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):  # a few capitals become two characters; they are left as they are
            low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
        get = self.ids.get
        ids = np.array([get(w, -1) for w in WORD.findall(low)], np.int64)
        found = self.candidates(ids)
        if not found:
            return []
        spans, out = [m.span() for m in WORD.finditer(low)], []
        for t, a, b in found:
            matched, first, last = align(self.words[t], ids, a - self.band(t), b + self.band(t))
            if matched >= coverage * len(self.words[t]) - 1e-9:
                out.append(Match(self.names[t], matched / len(self.words[t]), matched, spans[first][0], spans[last][1]))
        out.sort(key=lambda m: (-m.matched, -m.coverage, m.start, m.template))
        kept: list[Match] = []
        for m in out:
            if all(m.end <= k.start or k.end <= m.start for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m.start)


def align(template: np.ndarray, ids: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first, last word of the text) of the best alignment whose diagonals lie within
    ``low`` and ``high``: a match scores 2, a mismatch or a gap -1; the text's ends are free."""
    width, n = high - low + 1, len(template)
    score = np.zeros(width)
    matched, start = np.zeros(width, np.int64), np.full(width, -1)
    last = np.full(width, -1)
    best = (0.0, 0, -1, -1)
    for i in range(n):
        # cell k is template word i against text word i + low + k
        at = i + low + np.arange(width)
        inside = (at >= 0) & (at < len(ids))
        equal = inside & (ids[np.clip(at, 0, max(0, len(ids) - 1))] == template[i])
        new = score + np.where(equal, 2.0, -1.0)  # along the diagonal
        m, s, e = matched + equal, np.where(equal & (start < 0), at, start), np.where(equal, at, last)
        up = np.append(score[1:] - 1.0, -np.inf)  # a template word without a text word
        better = up > new
        new, m = np.where(better, up, new), np.where(better, np.append(matched[1:], 0), m)
        s, e = np.where(better, np.append(start[1:], -1), s), np.where(better, np.append(last[1:], -1), e)
        for k in range(1, width):  # a text word without a template word
            if new[k - 1] - 1.0 > new[k]:
                new[k], m[k], s[k], e[k] = new[k - 1] - 1.0, m[k - 1], s[k - 1], e[k - 1]
        score, matched, start, last = new, m, s, e
    k = int(np.argmax(score * 1024 + matched))
    best = (float(score[k]), int(matched[k]), int(start[k]), int(last[k]))
    return best[1:] if best[2] >= 0 else (0, 0, 0)


@lru_cache(1)
def default_index() -> Index:
    return Index()


SCHEMA = "doc_id long, template string, coverage double, matched long, start long, end long"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = default_index()
    for batch in batches:
        rows = [(i, m.template, m.coverage, m.matched, m.start, m.end) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in index.find(t)]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per notice found: doc_id, template, coverage, matched words, span."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_run, SCHEMA)
