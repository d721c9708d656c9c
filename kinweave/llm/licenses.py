"""Licence notices in documents by conditional compression.

Candidate blocks are the stretches of a text, across line breaks, that follow a notice's wording from a word that speaks
of licences and one beside it on; and of what is left the lines and then the sentences with such words. A block is compressed alone and with each notice as a zstandard raw dictionary, and the notices are
ranked by how much smaller that makes it. They are confirmed by their wording: the words that the block and the notice
do not share, on either side, are counted exactly, and a notice that differs has a word that no other licence has. Only
notices whose length leaves room for so few differing words are tried, which drops none that could be confirmed.

Defined results: a null or empty text has no blocks; equal texts have equal results; ties between notices go to the
larger reduction, then to the first name; rows are neither dropped nor merged. Whole texts are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_columns

_VERBS = ["Licensed", "Released", "Distributed", "Available", "Published", "This work is licensed", "This program is distributed"]
_CC = "https://creativecommons.org/licenses"
_ASIS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
#: Names of public licences, by SPDX id, as short notices give them.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0"],
    "MIT": ["the MIT License"],
    "MPL-2.0": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License, version 2.0"],
}
#: Their longer notices.
TEXTS = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": [f"This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit {_CC}/by/4.0/"],
    "CC-BY-NC-4.0": [f"This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit {_CC}/by-nc/4.0/"],
    "CC-BY-SA-4.0": [f"This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit {_CC}/by-sa/4.0/"],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_ASIS}',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
}
TEMPLATES = {name: [*(f"{verb} under {n}." for n in NAMES[name] for verb in _VERBS), *TEXTS[name]] for name in NAMES}
TRIGGER = re.compile(r"licen[sc]e|copyright|\(c\) ?[12][0-9]{3}|SPDX|permission\s+is\s+hereby|redistribution\s+and\s+use|all\s+rights\s+reserved|source\s+code\s+form", re.I)
#: Least reduction of size, share of the longer side's words that may differ, remembered blocks.
LEAST_GAIN, MOST_DIFFERENT, KNOWN_BLOCKS = 0.1, 0.25, 20_000
#: Words that a stretch inside other text shares with a notice at least, and words that may be skipped at a time.
LEAST_WORDS, SKIP = 4, 3
_LINE, _SENTENCE = re.compile(r"\n"), re.compile(r"[.!?;][\"')\]]*\s+")
_GAPS = sorted((p + q, p, q) for p in range(SKIP + 1) for q in range(SKIP + 1) if p + q)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
Span = tuple[int, int]


def words_of(s: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(s)]


def differing(block: list[str], notice: list[str]) -> int:
    """Words of either side outside the common stretches of both."""
    return len(block) + len(notice) - 2 * sum(m.size for m in SequenceMatcher(None, block, notice, autojunk=False).get_matching_blocks())


def reach(text: list[str], notice: list[str]) -> tuple[int, int, int]:
    """(words of the text, shared, differing) of the best common run from the first words on, over gaps of up to SKIP
    words on either side."""
    x = y = shared = apart = 0
    best = (0, 0, 0)
    while x < len(text) and y < len(notice):
        if text[x] == notice[y]:
            x, y, shared = x + 1, y + 1, shared + 1
            if shared - apart >= best[1] - best[2]:
                best = (x, shared, apart)
            continue
        for n, p, q in _GAPS:
            if text[x + p : x + p + 2] == notice[y + q : y + q + 2] != []:
                x, y, apart = x + p, y + q, apart + n
                break
        else:
            break
    return best


def parts(text: str, span: Span, at: re.Pattern) -> Iterator[Span]:
    """The parts of a span between matches of a pattern; a sentence keeps its end."""
    first = span[0]
    for m in at.finditer(text, *span):
        end = m.end() if at is _SENTENCE else m.start()
        yield first, end
        first = m.end()
    yield first, span[1]


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        import zstandard

        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.alone = zstandard.ZstdCompressor(level=9)
        #: (number of words, licence, words, compressor with the notice as dictionary) by number of words.
        self.notices: list[tuple[int, str, list[str], zstandard.ZstdCompressor]] = []
        for name in sorted(templates):
            for notice in templates[name]:
                words = words_of(notice)
                self.notices.append((len(words), name, words, zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(notice.encode(), dict_type=raw))))
        self.notices.sort(key=lambda x: x[0])
        self.lengths = [n[0] for n in self.notices]
        every = {name: {w for t in templates[name] for w in words_of(t)} for name in templates}
        #: Words that only one of the licences has.
        self.own = {n: frozenset(every[n]).difference(*(every[m] for m in every if m != n)) for n in every}
        #: Where two neighbouring words stand in the notices.
        self.pairs: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for i, (_, _, words, _) in enumerate(self.notices):
            for j, pair in enumerate(zip(words, words[1:], strict=False)):
                self.pairs.setdefault(pair, []).append((i, j))
        self.known: dict[str, tuple[str, int, float] | None] = {}

    def scan(self, block: str) -> tuple[str, int, float] | None:
        """(licence, differing words, reduction) of a block, or None."""
        if block in self.known:
            return self.known[block]
        n_words, best = sum(1 for _ in _WORD.finditer(block)), None
        a, b = bisect_left(self.lengths, (1 - MOST_DIFFERENT) * n_words), bisect_right(self.lengths, n_words / (1 - MOST_DIFFERENT))
        if n_words and a < b:
            words, raw = words_of(block), block.encode()
            size, have, found = len(self.alone.compress(raw)), set(words), []
            ranked = sorted(((1 - len(x[3].compress(raw)) / size, x[1], x[2]) for x in self.notices[a:b]), key=lambda x: (-x[0], x[1]))
            for gain, name, notice in ranked:
                if gain < LEAST_GAIN:
                    break
                n = differing(words, notice)
                if n == 0 or (n <= MOST_DIFFERENT * max(len(words), len(notice)) and self.own[name] & have):
                    found.append((n, -gain, name))
            best = (min(found)[2], min(found)[0], -min(found)[1]) if found else None
        if len(self.known) >= KNOWN_BLOCKS:
            self.known.clear()
        if n_words <= 2 * self.lengths[-1]:
            self.known[block] = best
        return best

    def whole(self, text: str, zones: list[Span], at: re.Pattern, found: list[tuple]) -> list[Span]:
        """Adds the parts of zones that are notices to found; gives the zones between them."""
        left = []
        for zone in zones:
            first = zone[0]
            for a, b in parts(text, zone, at) if TRIGGER.search(text, *zone) else ():
                if TRIGGER.search(text, a, b):
                    own = text[a:b].strip()
                    if hit := self.scan(own):
                        start = a + text[a:b].index(own)
                        found.append((start, start + len(own), *hit))
                        left.append((first, a))
                        first = b
            left.append((first, zone[1]))
        return left

    def stretches(self, text: str, zone: Span) -> list[tuple]:
        """The notices inside other words: round each word that speaks of licences the best stretch of a notice."""
        spans = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text, *zone)]
        words, starts = [w for _, _, w in spans], [a for a, _, _ in spans]
        found, done = [], 0
        for m in TRIGGER.finditer(text, *zone):
            i = max(0, bisect_right(starts, m.start()) - 1)
            if i < done or not words:
                continue
            spots = {*self.pairs.get((*words[i : i + 2],), ()), *((k, j + 1) for k, j in self.pairs.get((*words[max(0, i - 1) : i + 1],), ()) if i)}
            options = set()
            for k, j in spots:
                size, name, t, _ = self.notices[k]
                right = reach(words[i + 1 : i + 1 + 2 * size], t[j + 1 :])
                left = reach(words[max(done, i - 2 * size) : i][::-1], t[:j][::-1])
                a, b, shared, apart = i - left[0], i + 1 + right[0], left[1] + 1 + right[1], left[2] + right[2]
                if shared >= LEAST_WORDS and apart <= MOST_DIFFERENT * (b - a) and (self.own[name] & set(words[a:b]) or shared == size):
                    options.add((a, b))
            # the most words of a notice, less the differing ones
            best = max(((b - a - 2 * hit[1], a, b, hit) for a, b in options if (hit := self.scan(text[spans[a][0] : spans[b - 1][1]]))), default=None)
            if best:
                found.append((spans[best[1]][0], spans[best[2] - 1][1], *best[3]))
                done = best[2]
        return found

    def found(self, text: str) -> tuple[int, list[tuple]]:
        """The number of lines that speak of licences, and (start, end, licence, differing words, reduction) of all
        notices of a whole text, in order."""
        if not TRIGGER.search(text):
            return 0, []
        found = self.stretches(text, (0, len(text)))
        cuts = [0, *(x for f in found for x in f[:2]), len(text)]
        zones = list(zip(cuts[::2], cuts[1::2], strict=True))
        for at in (_LINE, _SENTENCE):
            zones = self.whole(text, zones, at, found)
        return sum(bool(TRIGGER.search(text, a, b)) for a, b in parts(text, (0, len(text)), _LINE)), sorted(found)


FIELDS = [("n_blocks", "long"), ("licenses", "string"), ("n_exact", "long"), ("n_near", "long"), ("notices", "string")]


def scan(df: DataFrame, templates: dict[str, list[str]] | None = None, text: str = "text") -> DataFrame:
    """df with n_blocks (lines that speak of licences), licenses (confirmed, sorted, comma-joined), n_exact and n_near
    (confirmed notices without and with differing words), and notices (licence:start:end:differing words in order,
    comma-joined; code points, ends exclusive). templates: the notices of each licence."""
    chosen = templates or TEMPLATES

    def make() -> Callable[[pa.Array], dict]:
        scanner = Scanner(chosen)

        def work(texts: pa.Array) -> dict:
            out: dict[str, list] = {n: [] for n, _ in FIELDS}
            for t in texts.to_pylist():
                n, got = scanner.found(t or "")
                exact = Counter(x[3] == 0 for x in got)
                row = (n, ",".join(sorted({x[2] for x in got})), exact[True], exact[False], ",".join(f"{x[2]}:{x[0]}:{x[1]}:{x[3]}" for x in got))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            return {n: pa.array(v, pa.string() if kind == "string" else pa.int64()) for (n, kind), v in zip(FIELDS, out.values(), strict=True)}

        return work

    return with_columns(df, FIELDS, make, text)
