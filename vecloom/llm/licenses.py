"""License scans by patience alignment with templates.

Candidate windows come first, by a condition that every match meets: enough of
the template's words within twice its length.  A window and the template are
then aligned: words that occur once in both are anchors, the longest increasing
subsequence of anchors stays, and the gaps between anchors are aligned in the
same way.  Coverage is the share of the template's words that found a partner.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from vecloom.llm.common import pick

#: A template counts as found from this coverage on.
COVERAGE = 0.8
_WORD = re.compile(r"[\w.+-]*\w")
_LONG = 4_000_000
#: Words of a block of a very long text.
_BLOCK = 500_000

# Notices and grants as their publishers word them (public texts).
_GNU = (
    "This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT/line": "Released under the MIT License.",
    "MIT/grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSL-1.0/grant": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
    ),
    "ISC/grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Zlib/grant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."
    ),
    "BSD/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause/clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "Unlicense/grant": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/notice": _GNU.format(thing="program", name="General Public License", version="3"),
    "GPL-2.0/notice": _GNU.format(thing="program", name="General Public License", version="2"),
    "LGPL-3.0/notice": _GNU.format(thing="library", name="Lesser General Public License", version="3"),
    "LGPL-2.1/notice": _GNU.format(thing="library", name="Lesser General Public License", version="2.1"),
    "AGPL-3.0/notice": _GNU.format(thing="program", name="Affero General Public License", version="3"),
    "LGPL-3.0/line": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1/line": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0/line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MIT OR Apache-2.0/line": "Dual licensed under MIT or Apache-2.0.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0/line": "Licensed under CC BY 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}
# Identifiers of licenses as machine-readable lines name them.
IDENTIFIERS = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later "
    "GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
).split()
# An identifier is two words with the name before it; within an expression of several it stands two words on.
TEMPLATES |= {f"{name}/spdx": f"SPDX-License-Identifier: {name}" for name in IDENTIFIERS}
#: Words that tell a license from its likes: a match needs all of the first, aligned, and none of the second within it.
TELLING = {
    "Apache-2.0/line": ("apache 2.0", ""), "Apache-2.0/notice": ("apache 2.0", ""), "MIT/line": ("mit", ""), "BSL-1.0/grant": ("organization", ""), "MPL-2.0/notice": ("mozilla 2.0", ""),
    "GPL-3.0/line": ("general 3", "lesser library affero 2"), "GPL-2.0/line": ("general 2", "lesser library affero 3"),
    "GPL-3.0/notice": ("general 3", "lesser affero 2 2.1"), "GPL-2.0/notice": ("general 2", "lesser affero 3 2.1"),
    "LGPL-3.0/notice": ("lesser 3", "2.1 2"), "LGPL-2.1/notice": ("lesser 2.1", "3"), "AGPL-3.0/notice": ("affero 3", ""),
    "LGPL-3.0/line": ("lesser 3", "affero 2 2.1"), "LGPL-2.1/line": ("lesser 2.1", "affero 3"), "AGPL-3.0/line": ("affero 3", "lesser"), "MIT OR Apache-2.0/line": ("mit apache-2.0", ""),
    "CC-BY-NC-4.0/line": ("by-nc 4.0", ""), "CC-BY-SA-4.0/line": ("by-sa 4.0", ""), "CC-BY-4.0/line": ("cc by 4.0", ""),
    "CC-BY-4.0/notice": ("attribution 4.0", ""), "CC-BY-SA-4.0/notice": ("attribution-sharealike 4.0", ""), "CC-BY-NC-4.0/notice": ("attribution-noncommercial 4.0", ""),
}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def patience(a: list[str], b: list[str], a0: int = 0, a1: int | None = None, b0: int = 0, b1: int | None = None) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both: the patience alignment of a[a0:a1] and b[b0:b1]."""
    a1, b1 = len(a) if a1 is None else a1, len(b) if b1 is None else b1
    out: list[tuple[int, int]] = []
    stack = [(a0, a1, b0, b1)]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        # Equal ends need no anchor.
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1)}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and in_b[a[i]] == 1]
        if not anchors:
            continue
        # Patience piles: the top of each, and the card on the pile before it.
        tops: list[int] = []
        top_at: list[int] = []
        before = [-1] * len(anchors)
        for n, (_, j) in enumerate(anchors):
            pile = bisect.bisect_left(tops, j)
            before[n] = top_at[pile - 1] if pile else -1
            tops[pile : pile + 1], top_at[pile : pile + 1] = [j], [n]
        n, chain = top_at[-1], []
        while n >= 0:
            chain.append(anchors[n])
            n = before[n]
        i0, j0 = a0, b0
        for i, j in [*reversed(chain), (a1, b1)]:
            stack.append((i0, i, j0, j))
            if i < a1:
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


@dataclass
class Scanner:
    """Finds the templates (name -> text) in texts."""

    templates: dict[str, str]
    coverage: float = COVERAGE
    telling: dict[str, tuple[str, str]] | None = None

    def __post_init__(self):
        telling = TELLING if self.telling is None else self.telling
        self.needed = {k: set(telling.get(k, ("", ""))[0].split()) for k in self.templates}
        self.barred = {k: set(telling.get(k, ("", ""))[1].split()) for k in self.templates}
        self.words = {k: words_of(v) for k, v in self.templates.items()}
        self.words = {k: v for k, v in self.words.items() if v}
        self.sets = {k: set(v) for k, v in self.words.items()}
        self.vocabulary = set().union(*self.sets.values()) if self.sets else set()

    def find(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(name, first word, last word, coverage) of each template in the whole text, in the order of the text.

        Matches of one template don't overlap.  A very long text is read in
        blocks that overlap by more than the longest match.
        """
        if not text:
            return []
        if len(text) <= _LONG:
            return sorted(self._find(words_of(text)), key=lambda x: (x[1], x[2], x[0]))
        overlap = 2 * max(map(len, self.words.values()), default=0)
        out: list[tuple[str, int, int, float]] = []
        stream, block, base = (m.group() for m in _WORD.finditer(text.lower())), [], 0
        while True:
            fresh = list(itertools.islice(stream, _BLOCK))
            block += fresh
            # What begins in the overlap is found again with all that follows it.
            cut = max(0, len(block) - overlap) if fresh else len(block)
            for name, i, j, c in self._find(block):
                if i < cut and all(name != n or base + i > b or base + j < a for n, a, b, _ in out):
                    out.append((name, base + i, base + j, c))
            if not fresh:
                break
            block, base = block[cut:], base + cut
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def _find(self, words: list[str]) -> list[tuple[str, int, int, float]]:
        known, out = self.vocabulary.intersection(words), []
        for name, template in self.words.items():
            m, own = len(template), self.sets[name]
            missing = int(m * (1 - self.coverage) + 1e-9)
            if len(known & own) < len(own) - missing or not self.needed[name] <= known:
                continue
            # Stretches in which each word belongs to a window of 2 m words that holds enough of the template's.
            places, at, spans = [i for i, w in enumerate(words) if w in own], 0, []
            for n, i in enumerate(places):
                while places[at] <= i - 2 * m:
                    at += 1
                if n - at + 1 >= m - missing:
                    if spans and places[at] <= spans[-1][1]:
                        spans[-1][1] = i
                    else:
                        spans.append([places[at], i])
            for first, last in spans:
                out += self._align(name, words, first, last, missing)
        return out

    def _tells(self, name: str, words: list[str], i: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether the words that tell the license apart are aligned, and those of its likes are not within the match."""
        if not self.needed[name] <= {self.words[name][b] for _, b in pairs}:
            return False
        return self.barred[name].isdisjoint(words[i + pairs[0][0] : i + pairs[-1][0] + 1])

    def _align(self, name: str, words: list[str], first: int, last: int, missing: int) -> list[tuple[str, int, int, float]]:
        """Matches within a stretch of text; of those that overlap, the one of most coverage, then the shortest, then the first."""
        template, out = self.words[name], []
        m, starts, i = len(template), set(template[: missing + 1]), first

        def best_from(i: int) -> tuple[float, int, int, int] | None:
            found = []
            for length in (m + missing, 2 * m):
                pairs = patience(words[i : min(i + length, last + 1)], template)
                if len(pairs) >= m * self.coverage and self._tells(name, words, i, pairs):
                    found.append((-len(pairs) / m, pairs[-1][0] - pairs[0][0], i + pairs[0][0], i + pairs[-1][0]))
            return min(found, default=None)

        while i <= last:
            hit = best_from(i) if words[i] in starts else None
            if hit:
                others = (best_from(j) for j in range(i + 1, hit[3] + 1) if words[j] in starts)
                hit = min([hit, *(h for h in others if h and h[2] <= hit[3])])
                out.append((name, hit[2], hit[3], -hit[0]))
                i = hit[3]
            i += 1
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """id, n_matches, licenses, matches for each row.

    ``matches`` is an array of (name, first_word, last_word, coverage) in the
    order of the text, ``licenses`` the distinct names in order.  Both are empty
    for null and empty texts and for texts without a match.  Of matches of one
    template that overlap, that of most coverage counts, then the shortest, then
    the first; very long texts are read whole.  Repeated rows get equal answers;
    other columns are not read, whatever their names.  An empty table gives an
    empty result.  Templates of one's own have no telling words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES, coverage))
    rows = pick(docs, id=id_col, text=text_col)
    kind = pa.list_(pa.struct([("name", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            found = [own.find(t.as_py()) for t in b.column(1)]
            named = [[{"name": n, "first_word": i, "last_word": j, "coverage": c} for n, i, j, c in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([sorted({x[0] for x in f}) for f in found], pa.list_(pa.string())), pa.array(named, kind)],
                names=[id_col, "n_matches", "licenses", "matches"],
            )

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_matches long, licenses array<string>, matches array<struct<name: string, first_word: bigint, last_word: bigint, coverage: double>>")
