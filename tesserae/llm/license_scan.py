"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

A template is a passage of words, from a one-line notice to a whole license. Texts and templates are
read as five-word shingles. For a template of m shingles a window has w of them: a power of two of
at most m / 2, and 2 where m is under 20. Templates have their windows at every place; texts are cut
into blocks of w / 2 shingles, and each two neighbouring blocks are one of its windows, so any copy
holds windows that some window of the template is aligned with. All windows of a text are looked
up; a window with one band in common with a template's makes that a candidate.

A match has at least 0.8 of the template's shingles. Then

- where m is under 20, the at most m / 5 shingles that are missing leave a run of three or more
  (all of them, where m is under 5), so a window of two, or of one where m < 4, is wholly the
  template's: its MinHash is equal whatever it is, and one band of one row retrieves it;
- otherwise some window of the copy has at least that share of its aligned window, a similarity of
  0.8 / 1.2 = 2/3 for sets of like size, and 32 bands of 2 rows miss fewer than one in 10^8 of these.

A candidate is verified on the words themselves: a window of m shingles slides over the places that
the candidates point to, and the shingles of the template that it has, with repeats, are counted up
and down as it goes, so verifying takes time in proportion to the places and not to their squares.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tesserae.llm.decontam import words_of
from tesserae.llm.text import alone, blocks, ddl, map_arrow, with_columns

#: Names and public texts of licenses: one-line notices, the standard notices of longer licenses, and short licenses whole. Fixed values.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)


def shingles(words: list[bytes], k: int = 5) -> list[bytes]:
    """All runs of k words in order; of fewer words the whole, of none nothing."""
    if not words:
        return []
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]


def hashes_of(words: list[bytes], k: int = 5) -> np.ndarray:
    """A 32-bit hash of each shingle, from one hash a word."""
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(max(1, len(words) - k + 1), np.uint64)
    for j in range(min(k, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[j : j + len(out)]
    out ^= out >> np.uint64(29)
    return ((out * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


class Scanner:
    """Templates by the bands of their windows; ``tables``: for each window length the sorted keys of bands and the templates of each."""

    def __init__(self, templates: list[tuple[str, str]], k: int = 5, least: float = 0.8, bands: int = 32, rows: int = 2):
        self.k, self.least, self.bands, self.rows = k, least, bands, rows
        draw = np.random.default_rng(2)
        self.mix = draw.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = draw.integers(0, 1 << 32, bands * rows, np.uint32)
        self.names = [n for n, _ in templates]
        self.words = [words_of(t) for _, t in templates]
        self.runs = [shingles(w, k) for w in self.words]
        self.counts = [Counter(s) for s in self.runs]
        self.window = [self._window(len(s)) for s in self.runs]
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for t, (words, w) in enumerate(zip(self.words, self.window, strict=True)):
            if words:
                keys = self._keys(hashes_of(words, k), w, 1)
                found[w].append((keys.reshape(-1), np.full(keys.size, t)))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for w, parts in sorted(found.items()):
            pairs = np.unique(np.array([np.concatenate([x for x, _ in parts]), np.concatenate([t for _, t in parts]).astype(np.uint64)]), axis=1)
            keys, first = np.unique(pairs[0], return_index=True)
            few = np.zeros(1 << 20, bool)  # whether any key begins with these bits
            few[keys >> np.uint64(44)] = True
            self.tables[w] = keys, np.r_[first, len(pairs[0])], pairs[1].astype(np.int64), few

    @staticmethod
    def _window(m: int) -> int:
        return 1 if m < 4 else 2 if m < 20 else 1 << ((m // 2).bit_length() - 1)

    def _lows(self, hashes: np.ndarray, block: int, only: int) -> np.ndarray:
        """The least value of each of the first ``only`` hash functions over blocks of as many shingles; the last may be short."""
        n = -(-len(hashes) // block)
        whole = np.r_[hashes, np.full(n * block - len(hashes), hashes[-1])].reshape(n, block)  # a shingle twice changes no minimum
        low = whole[:, :1] * self.mix[:only] + self.shift[:only]
        for j in range(1, block):
            np.minimum(low, whole[:, j : j + 1] * self.mix[:only] + self.shift[:only], out=low)
        return low

    def _keys(self, hashes: np.ndarray, w: int, step: int, lows: np.ndarray | None = None) -> np.ndarray:
        """[window, band] keys of the windows of w shingles that begin at every ``step``-th; a text shorter than that is one window."""
        exact = w < 8  # one band of one row
        rows = 1 if exact else self.bands * self.rows
        low = self._lows(hashes, step, rows) if lows is None else lows[:, :rows]
        have = step
        while have < w and len(low) > 1:
            low = np.minimum(low[:-(have // step)], low[have // step :]) if len(low) > have // step else low.min(0, keepdims=True)
            have *= 2
        low = low.astype(np.uint64)
        if exact:
            return low * np.uint64(0x9E3779B97F4A7C15) + np.uint64(w)
        low = low.reshape(len(low), self.bands, self.rows)
        key = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), low.shape[:2]).copy()
        for r in range(self.rows):
            key = (key ^ low[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        return key

    def candidates(self, words: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """For each template that a window of the text retrieves, the windows [from, to) of shingles."""
        hashes = hashes_of(words, self.k)
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        low, have = None, 0
        for w, (keys, first, of, few) in self.tables.items():
            step = max(1, w // 2)
            if w >= 8:  # blocks of a longer window are pairs of those of a shorter one
                low, have = (self._lows(hashes, step, self.bands * self.rows), step) if low is None else (low, have)
                while have < step:
                    odd = low[len(low) & ~1 :]
                    low = np.concatenate([np.minimum(low[: len(low) & ~1 : 2], low[1::2]), odd])
                    have *= 2
            mine = self._keys(hashes, w, step, low if w >= 8 else None)
            near = np.nonzero(few[mine >> np.uint64(44)])
            at = np.searchsorted(keys, mine[near])
            at[at == len(keys)] = 0
            hit = keys[at] == mine[near]
            for row, k in set(zip(near[0][hit].tolist(), at[hit].tolist(), strict=True)):
                for t in of[first[k] : first[k + 1]].tolist():
                    out[t].append((row * step, row * step + w))
        return out

    def scan(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, containment) of each match; of those of a template that overlap the best, then the first."""
        if not words or not self.tables:
            return []
        out: list[tuple[int, int, int, float]] = []
        for t, windows in self.candidates(words).items():
            best: list[tuple[int, int, int, float]] = []
            for m in sorted(self._verified(t, windows, words), key=lambda m: (-m[3], m[1])):
                if not any(m[1] < o[2] and o[1] < m[2] for o in best):
                    best.append(m)
            out += best
        return sorted(out, key=lambda m: (m[1], m[0]))

    def _verified(self, t: int, windows: list[tuple[int, int]], words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """Of each stretch of places that candidates point to the windows of the template's length with enough of its shingles."""
        want, m = self.counts[t], len(self.runs[t])
        n = max(1, len(words) - self.k + 1)
        stretches: list[list[int]] = []
        for lo, hi in sorted(set(windows)):
            a, b = max(0, lo - m + 1), min(n - 1, hi)  # first and last place where a copy may begin
            if stretches and a <= stretches[-1][1] + 1:
                stretches[-1][1] = max(b, stretches[-1][1])
            else:
                stretches.append([a, b])
        found = []
        for a, b in stretches:
            part = [x if (x := b" ".join(words[i : i + self.k])) in want else None for i in range(a, min(n, b + m))]
            have: Counter = Counter()
            common = 0
            for i in range(len(part) + 1):
                if i >= m or i == len(part):
                    # the window of m shingles (of all there are, if fewer) that ends before i
                    at = max(0, i - m)
                    if common >= self.least * m:
                        found.append((t, a + at, a + at + len(self.words[t]), common / m))
                if i == len(part):
                    break
                if i >= m and (old := part[i - m]) is not None:
                    common -= have[old] <= want[old]
                    have[old] -= 1
                if (new := part[i]) is not None:
                    have[new] += 1
                    common += have[new] <= want[new]
        return found


_SCANNERS: dict[tuple, Scanner] = {}


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = 5, least: float = 0.8, bands: int = 32, rows: int = 2) -> DataFrame:
    """docs with n_matches, licenses (distinct names, sorted) and matches (name, word span, containment) added; columns of these names are replaced.

    A match is a window as long as a template with at least ``least`` of its k-word shingles; of
    matches of one template that overlap the best counts, of equal ones the first; different
    templates may match at one place, and a name counts once. A template of fewer than k words is one
    shingle and matches a text of just these words; one without words matches nothing. Null and empty
    texts match nothing; a text of any length is read whole; repeated rows get equal results; an
    empty table gives an empty one. templates are the caller's (name, text) rows and go to executors
    with the code: thousands of whole licenses are a few megabytes.
    """
    base = docs.drop("n_matches", "licenses", "matches")
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))
    given = (tuple(templates), k, least, bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(_SCANNERS)
        if given not in _SCANNERS:
            _SCANNERS[given] = Scanner(list(given[0]), *given[1:])
        s = _SCANNERS[given]
        for batch in batches:
            for b in blocks(batch):
                found = [s.scan(words_of(t)) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
                rows_ = [[{"name": s.names[t], "start": a, "end": e, "containment": c} for t, a, e, c in f] for f in found]
                yield with_columns(b, n_matches=pa.array(map(len, rows_), pa.int64()), licenses=pa.array([sorted({m["name"] for m in r}) for r in rows_], pa.list_(pa.string())), matches=pa.array(rows_, kind))

    return map_arrow(base, run, f"{ddl(base)}, n_matches long, licenses array<string>, matches array<struct<name:string,start:long,end:long,containment:double>>")
