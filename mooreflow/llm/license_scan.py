"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Each template is a set of word shingles. For each template size, windows of that many shingles slide
over a document, one at each shingle; a window's MinHash signature is cut into bands, and a window
that shares a band with a template is a candidate. With BANDS bands of two values a window with
similarity s is found with probability 1 - (1 - s**2)**BANDS: 0.9998 at s = 0.64, the least that a
window can have that holds CONTAINED of a template. Candidates are confirmed by the share of the
template's shingles in the window and its margins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from mooreflow.llm.common import grams, hash_words, mix, steps, with_row

_LAST = np.uint32(0xFFFFFFFF)

SHINGLE, CONTAINED = 5, 0.8
BANDS = 16
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEEDS = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

_AS_IS_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS '
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AS_IS_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER '
    "OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TERMS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
    "other materials provided with the distribution."
)
_GNU_NO_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"

# Short notices, standard paragraphs and short whole texts of public licenses. Texts too long to
# be known by one paragraph are a parameter of `scan`.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": ("Released under the MIT License.", _MIT_GRANT, f"{_MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS_MIT}"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL": (f"{_GNU_NO_WARRANTY} GNU General Public License for more details.",),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        f"{_GNU_NO_WARRANTY.replace('program', 'library')} GNU Lesser General Public License for more details.",
    ),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",),
    "BSD": (_BSD_GRANT,),
    "BSD-2-Clause": (f"{_BSD_GRANT} {_BSD_TERMS} {_AS_IS_BSD}",),
    "BSD-3-Clause": (f"{_BSD_GRANT} {_BSD_TERMS} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS_BSD}",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative "
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else []


def values(s: np.ndarray, i: int) -> np.ndarray:
    return ((s ^ _SEEDS[i]) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype(np.uint32)


class Templates:
    """Shingle sets by number, and by size the templates of that size with their signatures."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.names, self.sets = [], []
        self.by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for name, texts in templates.items():
            for text in texts:
                s = np.unique(grams(hash_words(words_of(text)), SHINGLE))
                if len(s):
                    self.by_size.setdefault(len(s), []).append((len(self.sets), np.array([values(s, i).min() for i in range(2 * BANDS)])))
                    self.names.append(name)
                    self.sets.append(s)
        self.longest = max(self.by_size, default=0)


def candidates(s: np.ndarray, valid: np.ndarray, t: Templates) -> set[tuple[int, int]]:
    """(start, template) of the windows that share a band with a template of their size. A window's
    minimum is that of two overlapping stretches whose length is a power of two."""
    found: set[tuple[int, int]] = set()
    sizes = sorted(t.by_size)
    for band in range(BANDS):
        x, y = (np.where(valid, values(s, 2 * band + r), _LAST) for r in (0, 1))
        power = 0
        for size in sizes:
            while 2 << power <= size:
                x, y = (np.minimum(m[: len(m) - (1 << power)], m[1 << power :]) for m in (x, y))
                power += 1
            more = size - (1 << power)
            window = np.minimum(x[: len(x) - more], x[more:]) if more else x
            for n, signature in t.by_size[size]:
                at = np.flatnonzero(window == signature[2 * band])
                if len(at):
                    at = at[np.minimum(y[at], y[at + more]) == signature[2 * band + 1]]
                    found.update((i, n) for i in at.tolist())
    return found


def _found(shared, contained: float):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t: Templates = shared.value
        gap = [b""] * (t.longest + SHINGLE)  # after each text, so that its last windows may run over
        for batch in batches:
            texts = [x if isinstance(x, str) else None for x in batch["text"]]
            for i, j in steps(texts, 1_000_000):
                words = [words_of(x) for x in texts[i:j]]
                counts = np.array([len(w) for w in words], np.int64)
                s = grams(hash_words([w for own in words for w in (*own, *gap)]), SHINGLE)
                first = np.cumsum(counts + len(gap)) - counts - len(gap)
                who = np.repeat(np.arange(len(counts)), counts + len(gap))[: len(s)]
                end = first + np.maximum(counts - SHINGLE + 1, 0)  # of each text's shingles
                valid = np.arange(len(s)) < end[who]
                hits: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
                for start, n in candidates(s, valid, t) if t.longest else ():
                    d, size = int(who[start]), len(t.sets[n])
                    margin = max(1, size // 8)
                    a, b = max(first[d], start - margin), min(end[d], start + size + margin)
                    share = float(np.isin(t.sets[n], s[a:b]).mean())
                    if share >= contained:
                        at = np.flatnonzero(np.isin(s[a:b], t.sets[n]))
                        hits.setdefault((d, n), []).append((int(a + at[0] - first[d]), int(a + at[-1] + SHINGLE - first[d]), share))
                out = []
                for (d, n), own in sorted(hits.items()):
                    spans: list[list] = []
                    for x, y, share in sorted(set(own)):
                        if spans and x < spans[-1][1]:
                            spans[-1] = [spans[-1][0], max(spans[-1][1], y), max(spans[-1][2], share)]
                        else:
                            spans.append([x, y, share])
                    out += [(int(batch["row"].iloc[i + d]), batch["doc_id"].iloc[i + d], t.names[n], n, x, y, share) for x, y, share in spans]
                frame = pd.DataFrame(out, columns=["row", "doc_id", "license", "template", "first_word", "end_word", "contained"])
                yield frame.astype({"doc_id": "Int64"})

    return found


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """One row per passage: row, doc_id, license, template (its number), first_word, end_word (of the
    document's words, exclusive), contained (share of the template's shingles).

    Passages of one template that overlap are one; rows that repeat, or have no id, each give their
    passages; an empty table gives an empty result. A null or empty text has none; a template of fewer
    words than a shingle is never found. Whole texts are read in one pass, without a shuffle; the
    templates are a parameter and travel with the code.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES))
    src = with_row(docs, id_col, text_col)
    return src.mapInPandas(_found(shared, contained), "row long, doc_id long, license string, template int, first_word long, end_word long, contained double")
