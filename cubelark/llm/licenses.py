"""License scans: MinHash bands over overlapping windows, then exact containment.

Templates are grouped by length.  For each length class every text is read in
windows of W shingles that overlap by half, and W is chosen so that the longest
run that counts as an occurrence of a template of the class (`longest_run`) has at
most W / 2 + 1 shingles, so it lies whole in some window.  For each band of one
MinHash value a table holds the templates' values in order; a window is looked up
in the tables of all BANDS bands and retrieves the templates that it collides with.
`miss_bound` gives the probability that an occurrence with the least containment
collides nowhere; templates for which it exceeds MISS are refused.  Candidates
are checked on their words: the share of the template's five-word shingles that
the window holds must be CONTAINMENT at least.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, shingles

CONTAINMENT = 0.8
BANDS = 96
MISS = 1e-3
#: Shingles in the windows of the smallest class; each further class has twice as many.
LEAST_WINDOW = 8

#: Fixed: notices of well-known public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-sa-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License",
    "mit-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}

_MATCHES = "doc_id long, license string, start long, end long, containment double"


def longest_run(template_shingles: int) -> int:
    """Shingles of the longest run that counts as an occurrence.

    Words put between the template's lengthen the run.  Where even one lost shingle is too many
    there is no room for any.
    """
    if math.floor(template_shingles * (1 - CONTAINMENT) + 1e-9) == 0:
        return template_shingles
    return math.ceil(template_shingles / CONTAINMENT) + shingles.WORDS


def miss_bound(template_shingles: int, window: int, bands: int = BANDS) -> float:
    """Highest probability that a window with CONTAINMENT of the template collides in no band."""
    shared = math.ceil(CONTAINMENT * template_shingles)
    jaccard = shared / (window + template_shingles - shared)
    return (1 - jaccard) ** bands


class Scanner:
    """Templates by window size, and for each size the band tables: the templates' values in each band, in order, and whose they are."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS):
        self.factors = shingles.multipliers(bands, 17)
        self.windows: dict[int, list[tuple[str, set[tuple[str, ...]]]]] = {}
        values: dict[int, list[np.ndarray]] = {}
        for name, text in templates.items():
            words = shingles.WORD.findall(text.lower())
            if len(words) < shingles.WORDS:
                raise ValueError(f"template {name!r} has fewer than {shingles.WORDS} words")
            window = LEAST_WINDOW
            while window // 2 + 1 < longest_run(len(words) - shingles.WORDS + 1):
                window *= 2
            own = _shingles(words)
            if miss_bound(len(own), window, bands) > MISS:
                raise ValueError(f"template {name!r}: {bands} bands are too few for windows of {window} shingles")
            hashes, _ = shingles.shingle_hashes([text])
            self.windows.setdefault(window, []).append((name, own))
            values.setdefault(window, []).append(self._values(hashes).min(axis=1))
        self.tables = {}
        for window, rows in values.items():
            own = np.stack(rows, axis=1)
            order = np.argsort(own, axis=1, kind="stable")
            self.tables[window] = np.take_along_axis(own, order, axis=1), order

    def _values(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((hashes[None, :] * self.factors[:, None]) >> np.uint64(32)).astype(np.uint32)

    def scan(self, texts: list[str]) -> list[tuple[int, str, int, int, float]]:
        """(number of the text, license, start, end, containment) of all matches, in code points."""
        hashes, offsets = shingles.shingle_hashes(texts)
        if not len(hashes):
            return []
        step = LEAST_WINDOW // 2
        counts = -(-np.diff(offsets) // step)  # blocks of each text
        blocks = np.repeat(offsets[:-1], counts) + step * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        candidates: set[tuple[int, int, int, int]] = set()  # text, window size, first word, template
        low = np.empty((len(self.factors), len(blocks)), dtype=np.uint32)
        with np.errstate(over="ignore"):
            for b, factor in enumerate(self.factors):
                low[b] = np.minimum.reduceat(((hashes * factor) >> np.uint64(32)).astype(np.uint32), blocks)
        owner = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(blocks)) - np.repeat(np.cumsum(counts) - counts, counts)
        for window in sorted(k for k in range(LEAST_WINDOW, 1 + max(self.windows)) if k & (k - 1) == 0):
            pair = np.zeros(len(owner), dtype=bool)
            pair[:-1] = owner[1:] == owner[:-1]
            joined = low.copy()
            joined[:, :-1] = np.where(pair[:-1], np.minimum(low[:, :-1], low[:, 1:]), low[:, :-1])
            for i, t in self._collisions(window, joined):
                candidates.add((int(owner[i]), window, int(place[i]) * window // 2, t))
            keep = place % 2 == 0  # blocks of twice the size
            low, owner, place = joined[:, keep], owner[keep], place[keep] // 2
        return self._verified(texts, candidates)

    def _collisions(self, window: int, joined: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, template) for each entry of a band's table that the window's value in the band finds."""
        if window not in self.tables:
            return
        for values, templates, own in zip(*self.tables[window], joined, strict=True):
            first = np.searchsorted(values, own)
            for i in np.flatnonzero(values[np.minimum(first, len(values) - 1)] == own):
                for t in templates[first[i] : np.searchsorted(values, own[i], "right")]:
                    yield int(i), int(t)

    def _verified(self, texts: list[str], candidates: set[tuple[int, int, int, int]]) -> list[tuple[int, str, int, int, float]]:
        found: dict[tuple[int, str], list[tuple[int, int, float]]] = {}
        at, words = -1, []
        for text, window, first, t in sorted(candidates):
            if text != at:
                at, words = text, _words(texts[text])
            name, template = self.windows[window][t]
            # the blocks count shingles, and a shingle reaches WORDS - 1 words further
            part = words[first : first + window + shingles.WORDS - 1]
            hits = [i for i in range(len(part) - shingles.WORDS + 1) if tuple(w for w, _, _ in part[i : i + shingles.WORDS]) in template]
            share = len({tuple(w for w, _, _ in part[i : i + shingles.WORDS]) for i in hits}) / len(template)
            if share >= CONTAINMENT:
                found.setdefault((text, name), []).append((part[hits[0]][1], part[hits[-1] + shingles.WORDS - 1][2], round(share, 6)))
        out = []
        for (text, name), spans in found.items():
            kept: list[tuple[int, int, float]] = []
            for span in sorted(spans, key=lambda s: (-s[2], s[1] - s[0], s[0])):  # the best of overlapping ones
                if all(span[1] <= a or b <= span[0] for a, b, _ in kept):
                    kept.append(span)
            out += [(text, name, *span) for span in sorted(kept)]
        return sorted(out)


def _words(text: str) -> list[tuple[str, int, int]]:
    lower = text.lower()
    if len(lower) == len(text):
        return [(m[0], m.start(), m.end()) for m in shingles.WORD.finditer(lower)]
    # a few letters grow when lower-cased; map each lower-case position back to its letter
    origin = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    origin += [len(text)] * max(0, len(lower) + 1 - len(origin))
    return [(m[0], origin[m.start()], origin[m.end() - 1] + 1) for m in shingles.WORD.finditer(lower)]


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + shingles.WORDS]) for i in range(len(words) - shingles.WORDS + 1)}


def find_licenses(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per occurrence: doc_id, license, start, end (code points), containment.

    Of overlapping windows with the same license the best one is reported.  Null
    or empty texts match nothing; rows that repeat report their matches again.
    """
    templates = TEMPLATES if templates is None else templates

    def make():
        scanner = Scanner(templates)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[i], *rest) for i, *rest in scanner.scan(batch.column("text").to_pylist())]
            if not rows:
                return None
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in _MATCHES.split(", ")])

        return work

    return common.map_arrow(common.documents(df, id_col, text_col), make, _MATCHES)
