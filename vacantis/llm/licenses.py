"""License scan: templates found in texts by patience alignment.

Words are cut at white space and punctuation and lower-cased (A-Z).  A template
can only cover a text that holds enough of its words, which one set lookup per
text decides; where it does, every stretch of ``ROOM`` times the template's
length that holds enough of its words is aligned.  Alignment anchors on words
that occur once in the stretch and once in the template, keeps the longest
increasing run of anchors, and treats the gaps between them alike; a gap
without anchors falls back to the longest common subsequence.  Coverage is the
share of the template's words that are aligned.  A stretch that reaches
``COVERAGE`` is reported with its place, and the search goes on behind it, so a
text may hold many notices; every stretch that can reach it is tried.  In
``notices`` the words that tell licences apart (name, version, conditions) must
be aligned, words that tell of another licence must not stand in the stretch,
and where stretches overlap the best template stays.

Defined results: null and empty texts hold no notice; null ids and repeated rows
are scanned like others; long texts are scanned whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, prepared, utf8

COVERAGE, ROOM = 0.8, 1.5

# Public licence notices, (id, kind, text).
TEMPLATES = (
    ("MIT", "permissive",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("ISC", "permissive",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
     "the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "permissive",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
     "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
     "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
     "disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Apache-2.0", "permissive",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
     "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
     "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
     "either express or implied."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "copyleft",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
     "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", "copyleft",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
     "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "copyleft", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "copyleft", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "copyleft", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "copyleft", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "attribution", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "sharealike", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "sharealike", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "noncommercial",
     "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "noncommercial", "Licensed under CC BY-NC-SA 4.0."),
    ("proprietary", "proprietary", "All rights reserved."),
)
#: Further families, versions and ways to name a second licence.
MORE_TEMPLATES = (
    ("BSD-3-Clause", "permissive",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
     "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
     "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
     "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor "
     "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "copyleft",
     "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
     "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "copyleft",
     "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
     "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "copyleft",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
     "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "copyleft",
     "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
     "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("CC0-1.0", "public domain",
     "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "public domain",
     "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
     "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "permissive",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
     "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
     "applications, and to alter it and redistribute it freely."),
    ("EPL-2.0", "copyleft",
     "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
     "https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "permissive", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "permissive",
     "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
     "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and "
     "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so."),
    ("MIT", "permissive", "or the MIT License."),
    ("MIT", "permissive", "and the MIT License."),
    ("Apache-2.0", "permissive", "or the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "and the Apache License, Version 2.0."),
)
#: Licences by their short names, for the tag that source files carry.
SHORT_NAMES = (
    ("MIT", "permissive"), ("Apache-2.0", "permissive"), ("BSD-2-Clause", "permissive"), ("BSD-3-Clause", "permissive"), ("ISC", "permissive"), ("Zlib", "permissive"),
    ("BSL-1.0", "permissive"), ("CC0-1.0", "public domain"), ("Unlicense", "public domain"), ("GPL-2.0", "copyleft"), ("GPL-3.0", "copyleft"), ("LGPL-2.1", "copyleft"),
    ("LGPL-3.0", "copyleft"), ("AGPL-3.0", "copyleft"), ("MPL-2.0", "copyleft"), ("EPL-2.0", "copyleft"), ("CC-BY-4.0", "attribution"), ("CC-BY-SA-4.0", "sharealike"),
    ("CC-BY-NC-4.0", "noncommercial"), ("CC-BY-NC-SA-4.0", "noncommercial"),
)
#: Words that take back what stands behind them.
NEGATIONS = frozenset("not never no neither nor without isn aren unless".split())
#: Words that tell licences apart (every Creative Commons 4.0 licence asks for attribution): those a template has must be aligned, others must not stand in its stretch.
MARKS = frozenset(("mit apache gnu general lesser affero mozilla mpl creative commons noncommercial sharealike noderivatives noderivs "
                   "cc by nc sa nd 1 2 3 4 5").split())
#: Of a template longer than this, only these: its own body tells it apart from others.
LONG, LONG_MARKS = 20, frozenset("apache gnu lesser affero mozilla".split())
# End of fixed values.

#: A tag has to be there word for word: the notices and one tag for every short name.
TAG = "SPDX-License-Identifier: "
EVERY_TEMPLATE = TEMPLATES + MORE_TEMPLATES + tuple((name, kind, TAG + name) for name, kind in SHORT_NAMES)

_BREAK = bytes(32 if c < 127 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BREAK).split()


def _common(a: list, b: list, i: int, j: int) -> list[tuple[int, int]]:
    """Longest common subsequence of a gap without anchors."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    same = np.array([[x == y for y in b] for x in a], bool).reshape(len(a), len(b))
    for x in range(len(a) - 1, -1, -1):
        for y in range(len(b) - 1, -1, -1):
            best[x, y] = best[x + 1, y + 1] + 1 if same[x, y] else max(best[x + 1, y], best[x, y + 1])
    out, x, y = [], 0, 0
    while x < len(a) and y < len(b):
        if same[x, y]:
            out.append((i + x, j + y))
            x, y = x + 1, y + 1
        elif best[x + 1, y] >= best[x, y + 1]:
            x += 1
        else:
            y += 1
    return out


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), both increasing."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        in_a, in_b = Counter(a[i:i2]), Counter(b[j:j2])
        where = {w: y for y, w in enumerate(b[j:j2], j) if in_b[w] == 1}
        anchors = [(x, where[w]) for x, w in enumerate(a[i:i2], i) if in_a[w] == 1 and w in where]
        if not anchors:
            out += _common(a[i:i2], b[j:j2], i, j)
            continue
        ends, last, back = [], [], []  # longest increasing run of places in b
        for n, (_, y) in enumerate(anchors):
            p = bisect_left(ends, y)
            back.append(last[p - 1] if p else -1)
            ends[p:p + 1], last[p:p + 1] = [y], [n]
        n, run = last[-1], []
        while n >= 0:
            run.append(anchors[n])
            n = back[n]
        run.reverse()
        out += run
        for (x, y), (x2, y2) in zip([(i - 1, j - 1), *run], [*run, (i2, j2)]):
            todo.append((x + 1, x2, y + 1, y2))
    return sorted(out)


class Scanner:
    def __init__(self, templates=EVERY_TEMPLATE, coverage: float = COVERAGE, room: float = ROOM, marks: frozenset = frozenset()):
        self.marks = frozenset(m.encode() for m in marks)
        self.long_marks = self.marks & {m.encode() for m in LONG_MARKS}
        self.templates = [(name, kind, words_of(text.encode())) for name, kind, text in templates]
        self.counts = [Counter(w) for _, _, w in self.templates]
        self.tag = words_of(TAG.encode())
        self.needed = [len(w) if w[:3] == self.tag else int(np.ceil(coverage * len(w) - 1e-9)) for _, _, w in self.templates]
        self.known = frozenset(w for _, _, words in self.templates for w in words)
        self.room = room

    def __call__(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(template, first word, words in the stretch, aligned words) of every notice."""
        words = words_of(text)
        here = self.known.intersection(words)
        out = []
        for t, (own, needed) in enumerate(zip(self.counts, self.needed)):
            if sum(n for w, n in own.items() if w in here) >= needed:
                out += [(t, *hit) for hit in self._places(words, self.templates[t][2], own, needed)]
        return out

    def _own(self, template, stretch, pairs) -> bool:
        """Whether the words that tell the licence are aligned and no others stand between; a version stands behind its word."""
        if template[:3] == self.tag:
            return pairs[-1][1] + 1 == len(template)
        marks = self.marks if len(template) <= LONG else self.long_marks
        if not marks:
            return True
        aligned, places = {i for i, _ in pairs}, {j for _, j in pairs}
        versions = {i for i, w in enumerate(template) if i and self.marks and template[i - 1] in (b"version", b"v") and w.isdigit()}
        if any((w in marks or i in versions) and i not in aligned for i, w in enumerate(template)):
            return False
        return not any(w in marks and j not in places for j, w in enumerate(stretch[:pairs[-1][1] + 1]))

    def best(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """Notices of which no two overlap: where some do, the one with most aligned words, then the highest coverage, stays.

        A short one that one of the two words before it takes back is none.
        """
        out, taken, found = [], [], self(text)
        if found:
            words = words_of(text)
            found = [h for h in found if len(self.templates[h[0]][2]) > LONG
                     or not NEGATIONS.intersection(w.decode(errors="replace") for w in words[max(0, h[1] - 2):h[1]])]
        for hit in sorted(found, key=lambda h: (-h[3], len(self.templates[h[0]][2]), h[0], h[1])):
            k = bisect_left(taken, (hit[1], 0))
            if (k == len(taken) or taken[k][0] >= hit[1] + hit[2]) and (not k or taken[k - 1][1] <= hit[1]):
                taken.insert(k, (hit[1], hit[1] + hit[2]))
                out.append(hit)
        return sorted(out)

    def _places(self, words, template, own, needed):
        size = max(len(template), int(self.room * len(template)))
        spots = np.array([i for i, w in enumerate(words) if w in own])
        if len(spots) < needed:
            return
        upto = np.searchsorted(spots, spots + size)  # of the template's words, those within reach of each
        at = 0
        for n, (begin, last) in enumerate(zip(spots.tolist(), upto.tolist())):
            if begin < at or last - n < needed:
                continue
            stretch = words[begin:begin + size]
            if sum((Counter(stretch) & own).values()) < needed:
                continue
            pairs = patience(template, stretch)
            if len(pairs) >= needed and pairs[0][1] == 0 and self._own(template, stretch, pairs):  # else it begins at a later word, which is tried in turn
                yield begin, pairs[-1][1] + 1, len(pairs)
                at = begin + pairs[-1][1] + 1


def notices(docs: DataFrame, templates=EVERY_TEMPLATE, coverage: float = COVERAGE, room: float = ROOM,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per notice: doc_id, license, kind, template (its number), start, n_words, n_aligned, coverage."""
    prepared(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scan = Scanner(templates, coverage, room, MARKS)
        sizes = [len(w) for _, _, w in scan.templates]
        for batch in batches:
            found = [(k, *hit) for k, t in enumerate(utf8(batch.column(1))) for hit in scan.best(t)]
            if found:
                row, which, start, n, aligned = zip(*found)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).take(pa.array(row, pa.int64())), "license": pa.array([templates[t][0] for t in which]),
                    "kind": pa.array([templates[t][1] for t in which]), "template": pa.array(which, pa.int32()),
                    "start": pa.array(start, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_aligned": pa.array(aligned, pa.int64()),
                    "coverage": pa.array([a / sizes[t] for t, a in zip(which, aligned)], pa.float64())})

    return only(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, license string, kind string, template int, start long, n_words long, n_aligned long, coverage double")
