"""License scanning by patience alignment of texts with license templates.

Words that occur once in both a stretch of text and a template are anchors; the longest increasing run of them is kept
and the gaps between are aligned the same way. The aligned share of a template's words is its coverage. A stretch is
looked at only if enough of the template's words are in it for the wanted coverage, which drops nothing: a template can
miss at most the rest of its words, so one of any larger choice of its words must be there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read

#: Whole texts of licenses, from the first granting word on; years and holders stand before them.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
        IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
        source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
        software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
        USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
        "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
        is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
        disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR
        ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
#: What the three-clause text has before its disclaimer, and what the zero-clause one lacks.
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"
TEXTS = {k: " ".join(t.split()) for k, t in TEXTS.items()}
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE IS", _THIRD + "THIS SOFTWARE IS", 1)
TEXTS["0BSD"] = TEXTS["ISC"].replace(_NOTICE, "")
#: Notices by which a work says its license, whose text is elsewhere.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": ["Released under the MIT License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
}
_GPL = " ".join(TEMPLATES["GPL-3.0"][1].split())
_CC = {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: The names by which statements of any wording tell a license; all of their words must align.
NAMED = {
    "Apache-2.0": ["Apache License 2.0", "Apache 2.0", "Apache License, Version 2"], "MIT": ["MIT License"], "MPL-2.0": ["Mozilla Public License 2.0", "MPL 2.0"], "ISC": ["ISC License"], "Unlicense": ["The Unlicense"],
    "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD"], "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD"], "CC0-1.0": ["CC0", "Creative Commons Zero"], "All-rights-reserved": ["All rights reserved."],
    "EPL-2.0": ["Eclipse Public License 2.0", "EPL 2.0"], "CDDL-1.0": ["Common Development and Distribution License 1.0", "CDDL 1.0"], "BSL-1.0": ["Boost Software License 1.0"], "Zlib": ["zlib License"], "0BSD": ["Zero-Clause BSD", "0BSD"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1", "LGPL 2.1", "LGPLv2.1"],
    **{f"{short}-{v}.0": [f"GNU {kind}General Public License version {v}", f"GNU {kind}General Public License v{v}", f"{short} version {v}", f"{short}-{v}", f"{short}v{v}"] for short, kind, v in (("GPL", "", 2), ("GPL", "", 3), ("LGPL", "Lesser ", 3), ("AGPL", "Affero ", 3))},
    **{f"CC-{k}-4.0": [f"CC {k} 4.0", f"Creative Commons {name} 4.0"] for k, name in _CC.items()},
}
for _name, _kind, _version in (("GPL-2.0", "", 2), ("LGPL-3.0", "Lesser ", 3), ("AGPL-3.0", "Affero ", 3)):
    TEMPLATES[_name] = [_GPL.replace("GNU General", f"GNU {_kind}General").replace("version 3", f"version {_version}")]
for _name, _texts in NAMED.items():
    TEMPLATES[_name] = [*TEMPLATES.get(_name, []), *_texts]
#: Words that tell licenses apart: those of a template must align, and others may not stand in its place.
KINDS = {"lesser", "affero", "endorse", "nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "noderivs"}
COVERAGE = 0.85
#: What counts as one place: at most this many words for each of the template's, so half of them may be inserted ones.
STRETCH = 1.5
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first numbers, whose second numbers increase (patience sorting)."""
    tops, piles, back = [], [], []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        if at == len(tops):
            tops.append(b), piles.append(i)
        else:
            tops[at], piles[at] = b, i
        back.append(piles[at - 1] if at else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment: pairs of positions of equal words, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        spot = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(i, spot[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in spot])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, coverage: float, whole: bool = False, stretch: float = STRETCH):
        self.name, self.words, self.whole = name, words(text), whole
        self.counts = Counter(self.words)
        self.need = -int(-coverage * len(self.words) // 1)  # words that must align
        self.width = int(stretch * len(self.words)) + 1
        self.barred = KINDS - self.counts.keys()
        self.must = KINDS & self.counts.keys() | {w for w in self.counts if w.isdecimal()}
        rare = sorted(self.counts, key=lambda w: (w == "by", -len(w), w))  # long words are rare in other texts
        spare, self.keys = len(self.words) - self.need, set()
        for w in rare:
            self.keys.add(w)
            spare -= self.counts[w]
            if spare < 0:
                break

    def stretches(self, text: list[str]) -> Iterator[tuple[int, int]]:
        """Ranges of text in which some window of `width` words holds enough of the template's words."""
        window: deque[tuple[int, str]] = deque()
        inside: Counter = Counter()
        have, start, end = 0, -1, -1
        for i, w in enumerate(text):
            if w not in self.counts:
                continue
            while window and window[0][0] <= i - self.width:
                old = window.popleft()[1]
                inside[old] -= 1
                have -= inside[old] < self.counts[old]
            window.append((i, w))
            have += inside[w] < self.counts[w]
            inside[w] += 1
            if have >= self.need:
                if start >= 0 and window[0][0] > end:
                    yield start, end + 1
                    start = -1
                start, end = (window[0][0] if start < 0 else start), i
        if start >= 0:
            yield start, end + 1

    def tells(self, text: list[str], at: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether the words that tell this license from others align, and no such word of another stands between."""
        place = text[at + pairs[0][0] : at + pairs[-1][0] + 1]
        return self.must <= {self.words[j] for _, j in pairs} and self.barred.isdisjoint(place)

    def find(self, text: list[str]) -> Iterator[tuple[int, float, int, int]]:
        """(aligned words, coverage, first word, word behind) of each place that covers enough.

        A range of several windows may hold the license more than once, when its words are not unique there; so it is
        aligned from each word of the template that could begin it, and of the windows that overlap the first that
        suffices the one with most aligned words is taken.
        """
        for a, b in self.stretches(text):
            at, stop, best = a, b, None
            while at < stop:
                pairs = align(text[at : min(b, at + self.width)], self.words) if text[at] in self.counts else []
                if len(pairs) >= self.need and (best is None or len(pairs) > best[0]) and self.tells(text, at, pairs):
                    if best is None:
                        stop = min(b, at + pairs[-1][0] + 1)
                    best = (len(pairs), len(pairs) / len(self.words), at + pairs[0][0], at + pairs[-1][0] + 1)
                at += 1
                if best and (at == stop or best[0] == len(self.words)):
                    yield best
                    at, stop, best = best[3], b, None


class Scanner:
    def __init__(self, templates: dict[str, list[str]] | None = None, coverage: float = COVERAGE, texts: dict[str, str] | None = None, stretch: float = STRETCH):
        self.templates = [Template(k, t, coverage, stretch=stretch) for k, notices in (TEMPLATES if templates is None else templates).items() for t in notices]
        self.templates += [Template(k, t, coverage, True, stretch) for k, t in (TEXTS if texts is None else texts).items()]
        self.keys = set().union(*(t.keys for t in self.templates))

    def scan(self, text: str | None) -> list[tuple[str, bool, float, int, int]]:
        """(license, whole text or notice, coverage, first word, word behind), in the order of places; each place has its best cover only."""
        w = words(text)
        present = self.keys.intersection(w)
        if not present:
            return []
        found = sorted((-aligned, -cover, start, t.name, t.whole, stop) for t in self.templates if t.keys & present for aligned, cover, start, stop in t.find(w))
        starts: list[int] = []
        out: list[tuple[str, bool, float, int, int]] = []  # in the order of starts
        for _, cover, start, name, whole, stop in found:
            at = bisect_left(starts, start)
            if (at and out[at - 1][4] > start) or (at < len(out) and starts[at] < stop):
                continue
            starts.insert(at, start), out.insert(at, (name, whole, -cover, start, stop))
        return out


def read_texts(spark: SparkSession, folder: str) -> dict[str, str]:
    """More whole texts: one file for each license, named by it; they go to every task, so a library of licenses and not of documents."""
    rows = spark.read.text(folder, wholetext=True).select("value", F.input_file_name().alias("f")).collect()
    return {unquote(r["f"].rsplit("/", 1)[1]).removesuffix(".txt"): r["value"] for r in rows}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, coverage: float = COVERAGE, texts: dict[str, str] | None = None, stretch: float = STRETCH) -> DataFrame:
    """One row per input row: id, n_found, licenses (distinct names, sorted and comma-joined), texts (those whose whole text is there), coverage (the largest, 0 if none), places.

    templates are notices, texts whole licenses; both default to the ones above. A place has `coverage` of the template's
    words in order, at most `stretch` words for each of them, and all words that tell licenses apart. places are
    (license, whole, coverage, start, stop) with positions in words. Null and empty texts have none. Where places overlap
    the one with most covered words stays, then the larger coverage, the earlier one, the first by name. Rows are
    independent; extra columns are not read and an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, coverage, texts, stretch)
        for b in batches:
            found = [scanner.scan(t) for t in b["text"]]
            yield pd.DataFrame({
                "id": b["id"], "n_found": [len(f) for f in found], "licenses": [",".join(sorted({x[0] for x in f})) for f in found],
                "texts": [",".join(sorted({x[0] for x in f if x[1]})) for f in found], "coverage": [max((x[2] for x in f), default=0.0) for f in found],
                "places": [[dict(zip(("license", "whole", "coverage", "start", "stop"), x, strict=True)) for x in f] for f in found],
            })

    schema = f"id {dict(docs.dtypes)[id_col]}, n_found long, licenses string, texts string, coverage double, places array<struct<license: string, whole: boolean, coverage: double, start: long, stop: long>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema).withColumnRenamed("id", id_col)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("places")
