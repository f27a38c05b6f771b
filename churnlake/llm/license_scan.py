"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are cut into words (letters and digits, lower case). Hashes of short runs of words are
winnowed: the least of each window is kept, so any shared passage of run and window length shares
a fingerprint. An inverted index of the templates' fingerprints gives, for each one found in a
text, the templates and the diagonals of their word grids. Each candidate diagonal is then aligned
within a band of words on either side, and matches with enough of the template's words are reported
with their place in code points. Overlapping matches give way to the one of more matched words.

Null and empty texts have no matches; neither has any text without templates. Equally many matched
words are settled by place, then by coverage, then by template name. A very long text is cut nowhere:
its words and fingerprints are arrays. Repeated rows are scanned alike. Extra columns pass through
unless they bear the name of a result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from churnlake.llm import scan

RUN = 3                 # words of a fingerprint
WINNOW = 2              # fingerprints of which the least is kept
BAND = 6                # words by which an alignment may shift
COVERAGE = 0.7          # least share of a template's words
SHORT = RUN + WINNOW - 1  # templates with fewer words keep all their fingerprints

# Texts of short licences, and openings, usual notices and headers of long ones, by their common names.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "mit-notice": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "mit-disclaimer": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "bsd-2-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED "
        "BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "bsd-condition-2": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."),
    "bsd-condition-3": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission."),
    "bsd-notice": "Released under the BSD License.",
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE "
        "AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN "
        "NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT "
        "OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
        "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions "
        "must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed "
        "or altered from any source distribution."),
    "unlicense-opening": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."),
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "gpl-disclaimer": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "mpl-2.0-name": "Mozilla Public License Version 2.0",
    "mpl-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nc-nd-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "cc0-1.0-notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
}

_WORD = re.compile(r"[^\W_]+")
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
# Second bytes after C2 that stand for no letter or number: no-break space, quotation and other signs.
LATIN_SIGN = np.zeros(256, bool)
LATIN_SIGN[[c for c in range(0xA0, 0xC0) if not chr(c).isalnum()]] = True


def _hashed(words: list[str]) -> np.ndarray:
    """A hash per word, the same as :func:`_text_words` gives."""
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return scan.hashes(data, ends - np.diff(np.concatenate([[0], ends])), ends, scan.LOWER)


def _text_words(part: scan.Part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and hash of each run of letters and digits.

    Bytes of other scripts count as letters, but for the signs of Latin 1 and general punctuation (U+2000 to U+203F).
    """
    inside = ~SEPARATOR[part.data]
    n = len(inside)
    sign = np.flatnonzero((part.data[:-1] == 0xC2) & LATIN_SIGN[part.data[1:]])
    inside[sign] = inside[sign + 1] = False
    mark = np.flatnonzero((part.data[:-2] == 0xE2) & (part.data[1:-1] == 0x80))
    inside[mark] = inside[mark + 1] = inside[mark + 2] = False
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = part.bounds[:-1][part.bounds[:-1] < n]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, part.owner(starts), scan.hashes(part.data, starts, ends, scan.LOWER)


def _winnowed(prints: np.ndarray, short: bool) -> np.ndarray:
    """Numbers of the kept fingerprints: the least of each window, the last of equal ones."""
    if short or len(prints) <= WINNOW:
        return np.arange(len(prints))
    kept = set()
    for i in range(len(prints) - WINNOW + 1):
        window = prints[i:i + WINNOW]
        kept.add(i + WINNOW - 1 - int(np.argmin(window[::-1])))
    return np.array(sorted(kept))


class Index:
    """Inverted index from fingerprint to ``(template, word number)``."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words: list[list[int]] = []
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, name in enumerate(self.names):
            hashed = _hashed(_WORD.findall(templates[name]))
            self.words.append(hashed.tolist())
            at, prints = scan.windows(hashed, np.zeros(len(hashed), np.int64), min(RUN, max(1, len(hashed))))
            for k in _winnowed(prints, len(hashed) <= SHORT):
                postings[int(prints[k])].append((t, int(at[k])))
        self.postings = dict(postings)
        self.keys = np.array(sorted(self.postings), np.uint64)


def aligned(template: list[int], text: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """``(matched words, first, last + 1)`` of the best alignment of the template in the text.

    A longest common subsequence in the cells whose shift from the diagonal is within the band;
    the first and last matched word of the text bound the span. Of equally long ones the one of the
    shortest span counts, so that a word before a repeated notice does not draw it into the last one,
    then the earliest.
    """
    width = 2 * band + 1
    zero = (0, 0, 0)  # matched words, first word, last word + 1
    row: list[tuple[int, int, int]] = [zero] * width
    best, span = zero, 0
    for i, w in enumerate(template):
        new: list[tuple[int, int, int]] = [zero] * width
        for b in range(width):
            j = i + diagonal + b - band
            top = row[b + 1] if b + 1 < width else zero
            if b and new[b - 1][:2] > top[:2]:
                top = new[b - 1]
            if 0 <= j < len(text) and text[j] == w:
                m, first, _ = row[b]
                if (m + 1, first if m else j) > top[:2]:
                    top = (m + 1, first if m else j, j + 1)
            new[b] = top
        row = new
        for cell in row:
            if cell[0] > best[0] or cell[0] == best[0] and cell[2] - cell[1] < span:
                best, span = cell, cell[2] - cell[1]
    return best


MATCH = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64())])
MATCH_DDL = "array<struct<license:string,coverage:double,start:bigint,end:bigint,matched:bigint>>"


def _scan_part(part: scan.Part, index: Index, coverage: float) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(part))]
    starts, ends, owner, hashed = _text_words(part)
    hits: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
    at, prints = scan.windows(hashed, owner, RUN)
    if not len(at) or not len(index.keys):
        return out
    for k in np.flatnonzero(np.isin(prints, index.keys)):
        for t, place in index.postings[int(prints[k])]:
            hits[int(owner[at[k]])].add((t, int(at[k]), int(at[k]) - place))
    for d, found in hits.items():
        lo = int(np.searchsorted(owner, d))
        hi = int(np.searchsorted(owner, d, "right"))
        text = hashed[lo:hi].tolist()
        matches = []
        current = -1
        for t, place, diagonal in sorted(found):
            if t != current:
                # Alignments of this template that reach the place, and the text without those that matched.
                current, seen, rest = t, [], text
            place, diagonal = place - lo, diagonal - lo
            seen = [x for x in seen if x[1] > place]
            if any(first <= place and abs(diagonal - other) <= BAND for first, _, other in seen):
                continue  # the same alignment, shifted within the band
            template = index.words[t]
            tried = [aligned(template, text, diagonal)]
            if rest is not text and not tried[0][1] <= place < tried[0][2]:
                tried.append(aligned(template, rest, diagonal))  # the best of the band was an earlier match
            for m, first, end in tried:
                seen.append((first, end, diagonal))
                if m >= coverage * len(template):
                    matches.append((-m, first, -m / len(template), index.names[t], end))
                    if rest is text:
                        rest = list(text)
                    rest[first:end] = [None] * (end - first)
        taken: list[tuple[int, int]] = []
        base = int(part.bounds[d])
        for m, first, share, name, end in sorted(matches):
            k = bisect_left(taken, (first, end))
            if (k and taken[k - 1][1] > first) or (k < len(taken) and taken[k][0] < end):
                continue
            taken.insert(k, (first, end))
            s, e = int(starts[lo + first]), int(ends[lo + end - 1])
            before = int(scan.LEAD[part.data[base:s]].sum())
            out[d].append({"license": name, "coverage": -share, "start": before, "end": before + int(scan.LEAD[part.data[s:e]].sum()), "matched": -m})
        out[d].sort(key=lambda x: x["start"])
    return out


def matches(text: str | Column, templates: dict[str, str], coverage: float = COVERAGE) -> Column:
    index = Index(templates)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([m for p in scan.parts(texts) for m in _scan_part(p, index, coverage)], pa.list_(MATCH))

    return arrow_udf(run, MATCH_DDL)(text)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with ``licenses``: the matches of each text, by place. Nothing is shuffled."""
    chosen = TEMPLATES if templates is None else templates
    return docs.withColumn("licenses", F.coalesce(matches("text", chosen, coverage), F.array().cast(MATCH_DDL)))
