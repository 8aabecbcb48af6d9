"""Licence scans: Dice coefficients over word bigrams between stretches of a text and licence templates.

Texts and templates are normalised (ASCII letters in lower case, other ASCII signs but letters and digits to
spaces). A stretch begins and ends at any word. With threshold t and template size m (in bigrams), a stretch of a
bigrams can only match if t / (2 - t) * m <= a <= (2 - t) / t * m, and must share at least
t / (2 - t) * m bigrams with the template; so one of any m - that + 1 chosen bigrams must occur. Whole buffers are tested
for those chosen (rarest) bigrams first, and only texts that hold one are looked at, near these places. A stretch
never gains by beginning or ending with a bigram that the template lacks, so only shared bigrams are tried as ends.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import pick, shingles, text_chunks, word_hashes, word_spans

THRESHOLD = 0.8

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_LUT = np.frombuffer(_TABLE, np.uint8)

# The texts of the licences and of the notices that stand for them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published
by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. You should have received a copy of
the GNU {kind} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} General Public
License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later
version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more details. You
should have received a copy of the GNU {kind} General Public License along with this library; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE,
TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES
OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""


def default_templates() -> list[tuple[str, str]]:
    """(licence, text): whole texts of short licences, standard headers, and one-line notices made by rule. The whole
    legal texts of long licences (GPL, LGPL, AGPL, Apache, MPL, CC) are not among them; pass templates for these."""
    found = [
        ("MIT", _MIT), ("ISC", _ISC), ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"), ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
        ("Zlib", _ZLIB), ("Apache-2.0", _APACHE), ("MPL-2.0", _MPL), ("Unlicense", _UNLICENSE),
        ("BSL-1.0", _BOOST), ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
        ("LGPL-2.1", _LGPL.format(kind="Lesser", version="2.1")), ("LGPL-2.0", _LGPL.format(kind="Library", version="2")),
    ]
    for kind, short in (("General Public License", "GPL"), ("Lesser General Public License", "LGPL"), ("Affero General Public License", "AGPL")):
        for version in ("2", "3") if short == "GPL" else ("3",):
            found.append((f"{short}-{version}.0", _GPL.format(kind=kind, version=version)))
            for subject in ("This work", "This program", "This software"):
                found.append((f"{short}-{version}.0", f"{subject} is licensed under the GNU {kind}, version {version}."))
    for name, said in (("MIT", "the MIT License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("BSD-3-Clause", "the BSD 3-Clause License"), ("BSD-2-Clause", "the BSD 2-Clause License"), ("MPL-2.0", "the Mozilla Public License, Version 2.0"), ("ISC", "the ISC License")):
        found += [(name, f"{verb} under {said}.") for verb in ("Released", "Licensed", "Distributed")]
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("3.0", "4.0"):
            found.append((f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}."))
            found.append((f"CC-{kind}-{version}", f"This work is licensed under CC {kind} {version}."))
    return found


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def bigrams(words: Sequence[bytes]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    """2 * shared / total over the two multisets; 0 for two empty ones."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Scanner:
    """Templates by size, their chosen bigrams, and the scan of one text."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float = THRESHOLD):
        self.threshold, self.low = threshold, threshold / (2 - threshold)
        self.templates = []
        chosen: set[tuple[bytes, bytes]] = set()
        for name, text in templates:
            grams = bigrams(words_of(text.encode()))
            if not grams:
                raise ValueError(f"the template of {name} has fewer than two words")
            size = grams.total()
            spare = size - math.ceil(self.low * size - 1e-9) + 1
            probes, held = set(), 0
            for gram in sorted(grams, key=lambda g: (-len(g[0]) - len(g[1]), g)):  # long words are rare
                if held >= spare:
                    break
                probes.add(gram)
                held += grams[gram]
            chosen |= probes
            self.templates.append((name, grams, size, probes))
        self.grams = {g for _, grams, _, _ in self.templates for g in grams}
        raw = [b" ".join(g) for g in sorted(chosen)]
        self.probes = np.unique([self._hash(x)[0] for x in raw]).astype(np.uint64)
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(self.probes >> np.uint64(48)).astype(np.int64)] = True

    @staticmethod
    def _hash(text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]))
        return shingles(word_hashes(data, starts, ends), 2, 2)

    def rows_to_scan(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Rows of a chunk that hold a chosen bigram."""
        plain = _LUT[data]
        starts, ends, bounds = word_spans(plain, borders)
        grams = shingles(word_hashes(plain, starts, ends), 2, 2)
        at = np.flatnonzero(self.coarse[(grams >> np.uint64(48)).astype(np.int64)])
        at = at[np.isin(grams[at], self.probes)]
        rows = np.searchsorted(bounds, at, side="right") - 1
        return np.unique(rows[at + 1 < bounds[rows + 1]])

    def scan(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first word, words) of the best matches that don't overlap, in order of place.

        Every template and first word has its best end (the nearest of equal ones); of these stretches the one with the
        highest Dice comes first (ties: the earlier, the shorter, then by name), and the others where they overlap none.
        """
        words = words_of(text)
        place: dict[tuple[bytes, bytes], list[int]] = {}
        for i, pair in enumerate(zip(words, words[1:])):
            if pair in self.grams:
                place.setdefault(pair, []).append(i)
        found = []
        for name, grams, size, probes in self.templates:
            hits = sorted(i for pair in probes for i in place.get(pair, ()))
            if hits:
                found += [(-dice_, first, n, name) for dice_, first, n in self._stretches(place, grams, size, np.array(hits))]
        kept: list[tuple[int, int, str, float]] = []  # by place; they don't overlap
        for score, first, n, name in sorted(found):
            at = bisect_left(kept, (first,))
            if (at == len(kept) or first + n <= kept[at][0]) and (at == 0 or kept[at - 1][0] + kept[at - 1][1] <= first):
                insort(kept, (first, n, name, -score))
        return [(name, score, first, n) for first, n, name, score in kept]

    def _stretches(self, place: dict[tuple[bytes, bytes], list[int]], grams: Counter, size: int, hits: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(Dice, first word, words) of the best stretch from each place that can begin a match of one template."""
        most, least = int(size / self.low + 1e-9), self.low * size - 1e-9
        own = [(i, g, k, cap) for g, (pair, cap) in enumerate(grams.items()) for k, i in enumerate(place.get(pair, ()))]
        at, gram, nth, cap = (np.array(x) for x in zip(*sorted(own)))
        near = np.searchsorted(hits, at - most), np.searchsorted(hits, at + most, side="right")
        near = near[0] < near[1]  # a match holds a chosen bigram
        at, gram, nth, cap = at[near], gram[near], nth[near], cap[near]
        ahead = np.searchsorted(at, at + most)
        for s in np.flatnonzero(ahead - np.arange(len(at)) >= least).tolist():
            e = ahead[s]
            before = np.full(len(grams), -1)
            window, number = gram[s:e], nth[s:e]
            before[window[::-1]] = number[::-1]  # the first copy of each bigram from here on
            shared = np.cumsum(number - before[window] < cap[s:e])
            n = at[s:e] - at[s] + 1
            ok = (n >= least) & (2 * shared >= self.threshold * (n + size))
            if ok.any():
                score = np.where(ok, 2 * shared / (n + size), 0)
                best = int(score.argmax())
                yield float(score[best]), int(at[s]), int(n[best]) + 1


MATCHES = "matches array<struct<license:string,dice:double,first_word:int,words:int>>"


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, matches) of every document: the licence stretches of its whole text, possibly none.

    Stretches begin and end at any word. Every template and first word has its best end; of overlapping stretches the one
    with the highest Dice stays (ties: the earlier, the shorter, then by name). Null and empty texts have none; repeated rows stay; no shuffle; other columns are not read.
    """
    chosen = list(templates or default_templates())
    kinds = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_word", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, threshold)
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, _, data, borders in text_chunks(batch.column(1)):
                for r in scanner.rows_to_scan(data, borders):
                    matches = scanner.scan(data[borders[r] : borders[r + 1]].tobytes())
                    found[first + r] = [dict(zip(("license", "dice", "first_word", "words"), m)) for m in matches]
            yield pa.record_batch([batch.column(0), pa.array(found, kinds)], names=[id_col, "matches"])

    named = pick(docs, id_col, text_col)
    kind = named.schema[id_col].dataType.simpleString()
    return named.mapInArrow(run, f"`{id_col}` {kind}, {MATCHES}")


def license_report(docs: DataFrame) -> DataFrame:
    """One row for each document: (doc_id, n_matches, licenses, best_license, best_dice).

    ``licenses`` holds the different names in order, joined by commas; the best match is the one with the highest
    Dice (ties: the earlier). Texts without a match, null ones among them, have 0 matches, '' and nulls. Repeated rows stay;
    an empty table gives no rows.
    """
    found = scan_licenses(docs)
    ranked = F.array_sort(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["first_word"].alias("w"), m["license"].alias("l"))))
    best = F.try_element_at(ranked, F.lit(1))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), names.alias("licenses"), best["l"].alias("best_license"), (-best["d"]).alias("best_dice"))
