"""License statements found by patience alignment of known templates with whole texts.

Words that occur once in a stretch of text and once in the template are anchors. The longest run of
anchors that ascend in both is kept, and the gaps between them are aligned the same way, where words that
were repeated before may be unique. The share of the template's words that end up aligned is
its coverage.

A template is aligned only where it can be covered: a stretch of text must hold enough of its words. This
bound is exact, so nothing that reaches the coverage is passed over for it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.common import as_bytes

#: Share of a template's words that must be aligned.
COVERAGE = 0.8
#: Words that may stand between a template's words, as a share of its length.
SLACK = 0.5

#: Publicly known license statements.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit-line": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

#: Words are runs of digits, ASCII letters (lower-cased) and all above ASCII.
_WORD = bytes(
    b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()


def ascending(places: list[int]) -> list[int]:
    """Positions of a longest strictly ascending subsequence, by piles and links back."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for i, place in enumerate(places):
        pile = bisect_left(tops, place)
        if pile == len(tops):
            tops.append(place)
            last.append(i)
        else:
            tops[pile], last[pile] = place, i
        back.append(last[pile - 1] if pile else -1)
    out: list[int] = []
    at = last[-1] if last else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs of places in text and template that hold the same word, ascending in both."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1 and there.get(w) == 1}
        anchors = [(place[w], j) for j, w in enumerate(template[c:d], c) if w in place]
        kept = [anchors[i] for i in ascending([i for i, _ in anchors])]
        if not kept:
            continue
        found += kept
        for (i, j), (k, m) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)]):
            gaps.append((i + 1, k, j + 1, m))
    return sorted(found)


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    first_word: int
    last_word: int


class Scanner:
    """Templates prepared for scanning."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = {n: words_of(t.encode()) for n, t in sorted(templates.items())}
        self.counts = {n: Counter(w) for n, w in self.templates.items() if w}

    def scan(self, text: bytes | None) -> list[Match]:
        """Statements in a whole text, in order; of overlapping ones the longest, then the best covered."""
        words = words_of(text)
        held = set(words)
        found: list[tuple[float, int, str, int, int]] = []
        for name, counts in self.counts.items():
            size = len(self.templates[name])
            needed = int(np.ceil(self.coverage * size - 1e-9))
            if sum(n for w, n in counts.items() if w in held) >= needed:
                found += self._scan(words, name, needed)
        out: list[Match] = []
        taken: list[tuple[int, int]] = []
        for coverage, matched, name, first, last in sorted(found, key=lambda f: (-f[1], -f[0], f[2], f[3])):
            if all(last < a or first > b for a, b in taken):
                taken.append((first, last))
                out.append(Match(name, coverage, first, last))
        return sorted(out, key=lambda m: m.first_word)

    def _scan(self, words: list[bytes], name: str, needed: int):
        """Stretches where enough of the template's words stand close together, aligned one by one."""
        template, counts = self.templates[name], self.counts[name]
        reach = len(template) + int(np.ceil(len(template) * SLACK))
        places = np.flatnonzero(np.fromiter((w in counts for w in words), bool, len(words)))
        if len(places) < needed:
            return
        dense = np.flatnonzero(places[needed - 1 :] - places[: len(places) - needed + 1] < reach)
        starts = places[dense].tolist()
        at = 0
        while at < len(starts):
            best, n = self._best(words, template, starts, at, reach, needed)
            if not best:
                at += n
                continue
            first, last = best[0][0], best[-1][0]
            yield len(best) / len(template), len(best), name, first, last
            at = bisect_left(starts, last + 1)

    @staticmethod
    def _best(words, template, starts, at, reach, needed):
        """The best alignment of a stretch that starts here or soon after, and how many starts were tried.

        Words that stray before a statement may be taken for its first ones, so later starts compete; the
        one with most pairs wins, then the shortest, then the first.
        """
        best, key, tried = [], (0, 0), 0
        for start in starts[at:]:
            if tried and (not best or start > starts[at] + reach // 2):
                break
            tried += 1
            pairs = [(start + i, j) for i, j in align(words[start : start + reach], template)]
            if len(pairs) >= needed and (len(pairs), pairs[0][0] - pairs[-1][0]) > key:
                best, key = pairs, (len(pairs), pairs[0][0] - pairs[-1][0])
        return best, tried


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_statements, licenses, statements: a row for every row of ``docs``.

    licenses are the distinct names, sorted; statements holds license, coverage, first_word and last_word
    (places among the text's words), in order. A null or empty text has none. Null and repeated ids
    keep a row each; other columns are not read; an empty table gives an empty result.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage)
    kind = dict(docs.dtypes)["doc_id"]
    schema = (
        f"doc_id {kind}, n_statements long, licenses array<string>, "
        "statements array<struct<license: string, coverage: double, first_word: long, last_word: long>>"
    )
    item = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def run(batches):
        for batch in batches:
            found = [scanner.scan(t) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(len, found), pa.int64()),
                    pa.array([sorted({m.license for m in f}) for f in found], pa.list_(pa.string())),
                    pa.array([[vars(m) for m in f] for f in found], pa.list_(item)),
                ],
                names=["doc_id", "n_statements", "licenses", "statements"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)
