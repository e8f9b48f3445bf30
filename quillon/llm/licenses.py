"""Licence scans: Dice coefficient over word bigrams of normalised text, templates pruned by size.

Normalised text is words alone, so comment signs, line breaks and punctuation do not matter: a notice that is wrapped over
lines or stands inside other prose is found. A unit starts where a bigram of a template stands, and has as many words as the
template, or those up to the text's end. With Dice at least t, a unit of a bigrams and a template of b share at least
t (a + b) / 2: templates too large for the words that are left, and units with fewer bigrams of the template than that, are
not looked at. What is left is counted exactly, as bags. Of units that overlap only the one most like its template counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import flat, gram_hash, span_hash, steps, tidy

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_NOTICE_KEPT = ", provided that the above copyright notice and this permission notice appear in all copies."

# Names, and the texts of these licences or the notices by which works state them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    # whole licences and whole notices
    ("MIT", _MIT_GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MIT-0", _MIT_GRANT + ". " + _AS_IS),
    ("BSD-2-Clause", " ".join([_BSD_HEAD, _BSD_TWO, _BSD_END])),
    ("BSD-3-Clause", " ".join([_BSD_HEAD, _BSD_TWO, _BSD_THREE, _BSD_END])),
    ("ISC", _ISC_GRANT + _NOTICE_KEPT + " " + _ISC_END),
    ("0BSD", _ISC_GRANT + ". " + _ISC_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", _GNU.format("General Public License", "2") + " " + _GNU_END.format("General Public License")),
    ("GPL-3.0", _GNU.format("General Public License", "3") + " " + _GNU_END.format("General Public License")),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3") + " " + _GNU_END.format("Lesser General Public License")),
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3") + " " + _GNU_END.format("Affero General Public License")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]


def normalise(text: str) -> list[str]:
    """Words of a text: lower case, letters and digits of ASCII and everything beyond ASCII."""
    return re.sub(r"[^a-z0-9\u0080-\U0010ffff]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> Counter:
    """Bag of neighbouring pairs."""
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    """Twice what two bags share over what they hold; 0 for two empty ones."""
    size = a.total() + b.total()
    return 2 * (a & b).total() / size if size else 0.0


def _word_hashes(blob: bytes) -> np.ndarray:
    """Hashes of words that single spaces part."""
    data = np.frombuffer(blob, np.uint8)
    gaps = np.flatnonzero(data == 32)
    return span_hash(data, np.append(0, gaps + 1), np.append(gaps, len(data)))


class Matcher:
    """Templates with the hashes of their bigrams."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float) -> None:
        self.names, self.threshold = [n for n, _ in templates], threshold
        grams = [gram_hash(_word_hashes(" ".join(normalise(t)).encode()), 2) for _, t in templates]
        self.size = [len(g) for g in grams]
        self.bags = [Counter(g.tolist()) for g in grams]
        self.every = np.unique(np.concatenate(grams))
        self.has = [np.isin(self.every, g) for g in grams]

    def units(self, words: np.ndarray) -> list[tuple[float, int, int, int]]:
        """(Dice, template, first word, words) of every unit of a text's word hashes that reaches the threshold; the text has two words at least."""
        pair, n, t = gram_hash(words, 2), len(words) - 1, self.threshold
        where = np.minimum(np.searchsorted(self.every, pair), len(self.every) - 1)
        at = np.flatnonzero(self.every[where] == pair)
        found: list[tuple[float, int, int, int]] = []
        if not len(at):
            return found
        known = where[at]
        for i, b in enumerate(self.size):
            mine = at[self.has[i][known]]
            if 2 * len(mine) < t * b:
                continue
            a = np.minimum(b, n - mine)  # bigrams of the unit that starts at each
            hits = np.searchsorted(mine, mine + a) - np.arange(len(mine))
            for s, size in zip(*(x[2 * hits >= t * (a + b)].tolist() for x in (mine, a)), strict=True):
                got, bag = Counter(pair[s : s + size].tolist()), self.bags[i]
                score = 2 * sum(min(c, bag[g]) for g, c in got.items() if g in bag) / (size + b)
                if score >= t:
                    found.append((score, i, s, size + 1))
        return found

    def best(self, units: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int, int]]:
        """Units that no other one which overlaps them precedes: higher Dice, more words, lesser name, earlier start, earlier template."""
        rank = sorted(range(len(units)), key=lambda u: (-units[u][0], -units[u][3], self.names[units[u][1]], units[u][2], units[u][1]))
        place = {u: r for r, u in enumerate(rank)}
        by_start = sorted(range(len(units)), key=lambda u: units[u][2])
        out = set(by_start)
        for x, u in enumerate(by_start):
            end = units[u][2] + units[u][3]
            for v in by_start[x + 1 :]:
                if units[v][2] >= end:
                    break
                out.discard(u if place[v] < place[u] else v)
        return [units[u] for u in by_start if u in out]


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, license, units long, score double) of every document and each licence that a unit of it states.

    units: how many units are like a template of that licence, of units that overlap only the first by Dice, words, name,
    start and template; score: their greatest Dice coefficient. Null and empty texts and texts without a match have no row;
    repeated rows are matched each on its own; an empty table gives an empty one.
    """
    pairs = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(pairs, threshold)
        least = min(2 * threshold / (2 * (2 - threshold)) * b for b in matcher.size)  # bigrams of the smallest unit that can match any
        for batch in batches:
            for b in steps(batch, text):
                data, off = flat(pc.utf8_lower(pc.fill_null(b.column(text), "")))
                keep = (data >= 0x80) | ((data >= ord("a")) & (data <= ord("z"))) | ((data >= ord("0")) & (data <= ord("9")))
                edge = np.zeros(len(data) + 1, bool)
                edge[off] = True
                start = np.flatnonzero(keep & (edge[:-1] | ~np.concatenate([[False], keep[:-1]])))
                stop = np.flatnonzero(keep & (edge[1:] | ~np.concatenate([keep[1:], [False]]))) + 1
                words = span_hash(data, start, stop)
                first = np.searchsorted(start, off)
                hit = np.concatenate([[0], np.cumsum(np.isin(gram_hash(words, 2), matcher.every))]) if len(words) > 1 else np.zeros(1, np.int64)
                last = np.maximum(first[1:] - 1, first[:-1])
                likely = np.flatnonzero(hit[np.minimum(last, len(hit) - 1)] - hit[np.minimum(first[:-1], len(hit) - 1)] >= max(least * threshold, 1))
                tally: dict[tuple[int, str], list[float]] = {}
                for i in likely.tolist():
                    for score, template, _, _ in matcher.best(matcher.units(words[first[i] : first[i + 1]])):
                        tally.setdefault((i, matcher.names[template]), []).append(score)
                yield pa.RecordBatch.from_arrays(
                    [b.column(key).take(pa.array([i for i, _ in tally], pa.int64())), pa.array([n for _, n in tally], pa.string()), pa.array([len(v) for v in tally.values()], pa.int64()), pa.array([max(v) for v in tally.values()], pa.float64())],
                    names=[key, "license", "units", "score"],
                )

    return docs.select(key, text).mapInArrow(tidy(run), f"{key} {docs.schema[key].dataType.simpleString()}, license string, units long, score double")
