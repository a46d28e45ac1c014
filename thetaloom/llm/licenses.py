"""License notices in texts, by patience alignment with templates.

Words that are unique in both the text's passage and the template are anchors; the longest increasing subsequence of their
places keeps those in order, and the gaps between them are aligned in the same way. Coverage is the share of words that
found a partner, of the template's or of the passage's, whichever has more: missing and added words both lower it.

Coverage alone doesn't tell licenses apart, whose notices differ in a word. So a template's naming words (the license's name,
its qualifiers, its version) must all have a partner, and the passage must have no other naming word, and no further word
between a name and what follows it in the template. Where notices overlap, the one with most words stays: a whole text goes before its
first sentence.

Passages worth aligning are stretches with all names of a template; of a template without names, stretches with as many of its
longer words as any passage of enough coverage has.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from thetaloom.llm.decontaminate import words_of
from thetaloom.llm.ragged import flat, slices

COVERAGE = 0.8
ANCHOR_LETTERS = 4
"""Words of as many bytes and more show where a template may stand."""

#: Words that name a license, and those that tell apart the licenses of a name, beside one-digit versions.
NAMES = {"apache": [], "bsd": [], "cc": ["by", "nc", "nd", "sa"], "gnu": ["affero", "lesser"], "isc": [], "mit": [], "mozilla": []}

#: The parts and versions of the CC licenses.
CC_PARTS = ["BY", "BY-NC", "BY-NC-ND", "BY-NC-SA", "BY-ND", "BY-SA"]
CC_VERSIONS = ["2.0", "2.5", "3.0", "4.0"]

GNU_NOTICE = "This work is licensed under the GNU {} License, version {}."
GNU_HEADER = (
    "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the "
    "Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
GNU = {
    "AGPL-3.0": ("program", "Affero General Public", "3"),
    "GPL-2.0": ("program", "General Public", "2"),
    "GPL-3.0": ("program", "General Public", "3"),
    "LGPL-2.1": ("library", "Lesser General Public", "2.1"),
    "LGPL-3.0": ("program", "Lesser General Public", "3"),
}

#: Sentences of short licenses.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
MIT_REST = (
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
    '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
    "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
    "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
    "USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_COPIES = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution."
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission."
)
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD": BSD_GRANT,
    "BSD-2-Clause": " ".join([BSD_GRANT, BSD_COPIES, BSD_DISCLAIMER]),
    "BSD-3-Clause": " ".join([BSD_GRANT, BSD_COPIES, BSD_NAMES, BSD_DISCLAIMER]),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": MIT_GRANT,
    "MIT-text": f"{MIT_GRANT}, {MIT_REST}",
    **{name: GNU_NOTICE.format(license, version) for name, (_, license, version) in GNU.items()},
    **{f"{name}-header": GNU_HEADER.format(what, license, version) for name, (what, license, version) in GNU.items()},
    **{f"CC-{parts}-{version}": f"Licensed under CC {parts} {version}." for parts in CC_PARTS for version in CC_VERSIONS},
}

FOUND = "array<struct<license: string, first_word: bigint, end_word: bigint, coverage: double>>"


def increasing(values: list[int]) -> list[int]:
    """The indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for at, value in enumerate(values):
        place = bisect_left(tails, value)
        before[at] = ends[place - 1] if place else -1
        if place == len(tails):
            tails.append(value)
            ends.append(at)
        else:
            tails[place], ends[place] = value, at
    out = []
    at = ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def aligned(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both: equal ends of a gap first, then anchors and the gaps between."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        there: dict = {}
        for at in range(c, d):
            there[template[at]] = at if template[at] not in there else -1
        here: dict = {}
        for at in range(a, b):
            if there.get(text[at], -1) >= 0:
                here[text[at]] = at if text[at] not in here else -1
        anchors = sorted((at, there[word]) for word, at in here.items() if at >= 0)
        kept = [anchors[i] for i in increasing([y for _, y in anchors])]
        pairs.extend(kept)
        if kept:
            edges = [(a - 1, c - 1), *kept, (b, d)]
            gaps.extend((x + 1, p, y + 1, q) for (x, y), (p, q) in zip(edges, edges[1:], strict=False))
    return sorted(pairs)


def needed(counts: list[int], missing: int) -> int:
    """How many of a template's distinct words, which it has ``counts`` times, are there at least when at most ``missing``
    words lack a partner."""
    total, lost = 0, 0
    for count in sorted(counts):
        total += count
        lost += total <= missing
    return len(counts) - lost


def _hashes(texts: list[str]) -> tuple[list[list[int]], list[list[bool]]]:
    """The hashes of each text's words, and which words are long."""
    data, offsets = flat(pa.array(texts, pa.string()))
    starts, ends, firsts, hashes = words_of(data, offsets)
    long = (ends - starts >= ANCHOR_LETTERS).tolist()
    each = hashes.tolist()
    bounds = list(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True))
    return [each[a:b] for a, b in bounds], [long[a:b] for a, b in bounds]


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in templates]
        self.words, long = _hashes([text for _, text in templates])
        ((*digits,), (*names,), *qualifiers), _ = _hashes([" ".join("0123456789"), " ".join(NAMES), *[" ".join(own) for own in NAMES.values()]])
        own_of = dict(zip(names, qualifiers, strict=True))
        #: Per template: its names; the words that may stand in a passage only with a partner; those that it must have.
        self.leads = [own_of.keys() & set(words) for words in self.words]
        self.telling = [{*names, *digits, *(q for lead in leads for q in own_of[lead])} if leads else set() for leads in self.leads]
        self.must = [[at for at, word in enumerate(words) if word in telling] for words, telling in zip(self.words, self.telling, strict=True)]
        self.naming = np.array(sorted({*names, *digits, *(q for own in qualifiers for q in own)}), np.uint64)
        #: The distinct words of each template, and how many of them, naming words among them, a notice has at least.
        self.distinct = [set(words) for words in self.words]
        self.at_least = []
        #: The words that show a template, and how many of them any passage of enough coverage has: its names; without names the
        #: longer words, or all where such a passage can do without the longer ones.
        self.signs, self.need = [], []
        for words, leads, is_long in zip(self.words, self.leads, long, strict=True):
            size = len(words)
            most = next((n for n in range(size, -1, -1) if size and (size - n) / size >= COVERAGE), 0)
            self.at_least.append(needed(list(Counter(words).values()), most))
            if leads:
                self.signs.append(set(leads))
                self.need.append(len(leads))
                continue
            own = Counter(w for w, x in zip(words, is_long, strict=True) if x)
            if not needed(list(own.values()), most):
                own = Counter(words)
            self.signs.append(set(own))
            self.need.append(needed(list(own.values()), most))
        self.all_signs = np.array(sorted(set().union(*self.signs)) if self.signs else [], np.uint64)

    def fits(self, which: int, passage: list[int], pairs: list[tuple[int, int]]) -> float:
        """The coverage of an alignment, 0 where the naming words say another license."""
        template = self.words[which]
        if not pairs:
            return 0.0
        first, end = pairs[0][0], pairs[-1][0] + 1
        coverage = len(pairs) / max(len(template), end - first)
        if coverage < COVERAGE or not self.leads[which]:
            return coverage
        partner = dict(pairs)
        theirs = set(partner.values())
        if any(at not in theirs for at in self.must[which]):
            return 0.0
        for at in range(first, end):
            if at in partner:
                continue
            between = passage[at - 1] in self.leads[which] and partner.get(at - 1, len(template)) + 1 in theirs
            if between or passage[at] in self.telling[which]:
                return 0.0
        return coverage

    def _best(self, which: int, words: np.ndarray, done: int, place: int) -> tuple[int, int, int, float] | None:
        """The best notice whose sign stands at ``place``: its aligned words, first word, end and coverage. A passage as long
        as the template is tried for each place the sign has there, then a longer one with words between."""
        template, sign = self.words[which], int(words[place])
        reach = len(template)
        around = self.distinct[which].intersection(words[max(done, place - reach) : place + reach + reach // 2].tolist())
        if len(around) < self.at_least[which] or any(template[at] not in around for at in self.must[which]):
            return None
        begins = [place - at for at, word in enumerate(template) if word == sign]
        windows = [(begin, begin + reach) for begin in begins]
        windows.append((place - reach, place + reach + reach // 2))
        best = None
        for low, high in windows:
            low, high = max(done, low), min(len(words), high)
            passage = words[low:high].tolist()
            pairs = aligned(passage, template)
            coverage = self.fits(which, passage, pairs)
            if coverage >= COVERAGE and (best is None or (len(pairs), coverage) > (best[0], best[3])):
                best = (len(pairs), low + pairs[0][0], low + pairs[-1][0] + 1, coverage)
            if best is not None and best[0] == reach == best[2] - best[1]:
                break
        return best

    def found(self, words: np.ndarray, signs: np.ndarray) -> list[tuple[str, int, int, float]]:
        """The notices in a text; ``signs`` are the places of any template's signs."""
        out = []
        at_words = list(zip(signs.tolist(), words[signs].tolist(), strict=True))
        present = {word for _, word in at_words}
        telling = set(np.intersect1d(words, self.naming).tolist())
        for which, (name, template, own, need) in enumerate(zip(self.names, self.words, self.signs, self.need, strict=True)):
            if len(own & present) < need or not template or any(template[at] not in telling for at in self.must[which]):
                continue
            near = [(at, word) for at, word in at_words if word in own]
            reach, done, before, until, inside = len(template), 0, 0, 0, Counter()
            for first, _ in near:
                # The signs around this one, as far as a passage reaches.
                while until < len(near) and near[until][0] < first + reach + reach // 2:
                    inside[near[until][1]] += 1
                    until += 1
                while near[before][0] < first - reach:
                    inside[near[before][1]] -= 1
                    if not inside[near[before][1]]:
                        del inside[near[before][1]]
                    before += 1
                if first < done or len(inside) < need:
                    continue
                best = self._best(which, words, done, first)
                if best is not None:
                    out.append((best[0], name, *best[1:]))
                    done = best[2]
        # Where notices overlap, the one with most words stays, then the better covered. Those kept so far are in order.
        kept: list[tuple[int, int, str, float]] = []
        for _, name, start, end, coverage in sorted(out, key=lambda x: (-x[0], -x[4], x[1], x[2])):
            at = bisect_left(kept, (start,))
            if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
                kept.insert(at, (start, end, name, coverage))
        return [(name, start, end, coverage) for start, end, name, coverage in kept]


@lru_cache(maxsize=2)
def _templates(templates: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(templates)


def scanned(texts: pa.Array, templates: Templates) -> pa.Array:
    data, offsets = flat(texts)
    out = []
    for low, high in slices(offsets):
        _, _, firsts, hashes = words_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        known = templates.all_signs
        place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        signs = np.flatnonzero(known[place] == hashes) if len(known) else np.zeros(0, np.int64)
        bounds = np.searchsorted(signs, firsts)
        for row in range(high - low):
            mine = signs[bounds[row] : bounds[row + 1]] - firsts[row]
            found = templates.found(hashes[firsts[row] : firsts[row + 1]], mine) if len(mine) else ()
            out.append([{"license": n, "first_word": a, "end_word": b, "coverage": c} for n, a, b, c in found])
    kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())]))
    return pa.array(out, kind)


def licenses(text: Column, templates: dict[str, str] = TEMPLATES) -> Column:
    """The notices in a text, by place: license, its words (end exclusive) and coverage. Words are ASCII letters without
    case, digits and all other characters beyond ASCII. Null and empty texts have none; notices that repeat are all
    listed; of notices that overlap the one with most words is, of ties the better covered, then the first by name and place.
    Repeated rows each have theirs, an empty table has no rows, other columns play no part, and long texts are read whole."""
    fixed = tuple(sorted(templates.items()))

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        return scanned(texts, _templates(fixed))

    return scan(text)
