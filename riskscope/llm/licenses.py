"""License scans (operator 1): normalised text is compared with licence
templates by Dice coefficient over word bigrams.

Units of a document are its lines, its paragraphs (runs of lines between blank
ones), the whole text, and runs of adjacent pieces: lines cut after sentences.
Comment markers and blank lines hold no words, so a run crosses
them, and a licence is a unit wherever it stands in a document.  Templates are
short notices and the full texts in ``license_texts``.

For sets of sizes a and b the coefficient is at most
2 min(a, b) / (a + b), so for a threshold t only templates with
a t / (2 - t) <= b <= a (2 - t) / t can match: templates are sorted by size and
the others are never compared.  Bigrams count as often as they occur, so the
word count alone rules out most units.  A unit that matches shares at least
b t / (2 - t) bigrams with the template; where the whole text shares fewer, no
unit of it can match, which settles most documents at once.

Of the runs that start at one piece the best for a template is taken, of those
that overlap the best.  A run is not counted where a matching unit with as many
common bigrams overlaps it and that unit's template has half of its bigrams; nor
for a template that is part of a longer one of another licence, half of whose
rest stands around the run: that is the longer licence, changed too much.

Per document: the best licence and its score, the number of matching units, and
all licences found.  Ties go to the licence that comes first by name.

Nulls, empty texts and texts of one word have no bigrams and match nothing.
Repeated rows give a row each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskscope.llm.common import keyed_text

THRESHOLD = 0.8

_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
          "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
          "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
          "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
          "conditions: The above copyright notice and this permission notice shall be included in all copies or "
          "substantial portions of the Software.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.")

# Fixed values: (licence, text) templates, short notices and short full texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", _GRANT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_OTHER = re.compile(rb"[^a-z0-9\x80-\xff]+")
_BLANK = re.compile(r"\n[ \t\r\f\v]*\n")
_PIECE = re.compile(r"(?:[^\n.!?]|[.!?](?![ \t\r\n]))*+[^\n]?\n?")


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """(licence, text) of the files in ``license_texts``, read on the driver."""
    return tuple((path.name.removesuffix(".txt").removesuffix(".notice"), path.read_text(encoding="utf-8"))
                 for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def normalised(text: str) -> list[bytes]:
    """Words of the lower-cased text: runs of letters, digits and non-ASCII
    characters; everything else separates."""
    return _OTHER.sub(b" ", text.lower().encode()).split()


class Templates:
    """Templates sorted by their number of bigrams, and who has which bigram."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float = THRESHOLD):
        self.threshold, self.ratio = threshold, threshold / (2 - threshold)
        rows = sorted((len(w) - 1, name, w) for name, text in templates if len(w := normalised(text)) > 1)
        self.sizes, self.names = [r[0] for r in rows], [r[1] for r in rows]
        self.counts = [Counter(zip(w, w[1:])) for _, _, w in rows]
        self.parts: dict[int, list[int]] = {}
        self.times: dict[int, np.ndarray] = {}
        self.having: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
        for k, own in enumerate(self.counts):
            for pair, n in own.items():
                self.having.setdefault(pair, []).append((k, n))
        self.number = {pair: i for i, pair in enumerate(self.having)}

    def possible(self, words: list[bytes]) -> list[int]:
        """Templates that some run of the words could match."""
        most: Counter[int] = Counter()
        for pair in self.having.keys() & set(zip(words, words[1:])):
            for k, m in self.having[pair]:
                most[k] += m
        return [k for k, c in most.items() if c >= self.sizes[k] * self.ratio - 1e-9]

    def matches(self, words: list[bytes]) -> list[tuple[float, int]]:
        """(score, template) of the templates that reach the threshold."""
        size = len(words) - 1
        lo = bisect_left(self.sizes, size * self.ratio - 1e-9)
        hi = bisect_right(self.sizes, size / self.ratio + 1e-9)
        if size < 1 or lo >= hi:
            return []
        common: Counter[int] = Counter()
        for pair, n in Counter(zip(words, words[1:])).items():
            for k, m in self.having.get(pair, ()):
                if lo <= k < hi:
                    common[k] += min(n, m)
        return [(2 * c / (size + self.sizes[k]), k) for k, c in common.items()
                if 2 * c >= self.threshold * (size + self.sizes[k])]

    def numbered(self, words: list[bytes]) -> np.ndarray:
        """The number of each bigram among those of the templates, else -1."""
        return np.array([self.number.get(pair, -1) for pair in zip(words, words[1:])], np.int64)

    def _fresh_from(self, k: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a bigram is template k's, and the least start from which it
        counts: template k's share of it (say m times) is used up from any start
        at or before its m-th last occurrence."""
        if k not in self.times:
            own = np.zeros(len(self.number) + 1, np.int64)  # the last is for -1
            own[[self.number[pair] for pair in self.counts[k]]] = list(self.counts[k].values())
            self.times[k] = own
        m = self.times[k][pairs]
        order = np.argsort(pairs, kind="stable")
        same, back = pairs[order], np.arange(len(order)) - m[order]
        start = np.full(len(order), len(order) + 1)
        used = (back >= 0) & (same[back.clip(0)] == same)
        start[order] = np.where(used, order[back.clip(0)] + 1, 0)
        return m > 0, np.where(m > 0, start, len(order) + 1)

    def runs(self, k: int, pairs: np.ndarray, at: list[int]) -> list[tuple[int, int, int]]:
        """(common bigrams, start, end) of the runs of pieces that match template
        k: the best from each start, and of those that overlap the best.  ``pairs``
        are the bigrams of the text by number, ``at`` holds the place of each
        piece's first word, and the number of words."""
        b = self.sizes[k]
        own, fresh = self._fresh_from(k, pairs)
        known, places = [0, *np.cumsum(own).tolist()], np.array(at)
        longest, found, top = int(b / self.ratio + 1e-9), [], (0.0, 0)
        for piece, start in enumerate(at[:-1]):
            last = min(start + longest, len(pairs))
            # The best run does not start with a piece that has nothing in common.
            if known[last] - known[start] < b * self.ratio - 1e-9 or \
                    known[min(at[piece + 1], len(pairs))] == known[start]:
                continue
            # Nor does one count that begins within a run it cannot beat.
            reach = min(known[last] - known[start], b)
            if start < top[1] and 2 * reach / (reach + b) <= top[0]:
                continue
            sizes = places[piece + 1:bisect_right(at, last + 1)] - start - 1
            if not len(sizes):
                continue
            common = np.concatenate(([0], np.cumsum(fresh[start:last] <= start)))[sizes]
            scores = 2 * common / (sizes + b)
            best = len(scores) - 1 - int(scores[::-1].argmax())  # the longest of equals
            score, n, end = float(scores[best]), int(common[best]), start + 1 + int(sizes[best])
            if n and 2 * n >= self.threshold * (end - start - 1 + b):
                found.append((score, n, start, end))
                if start >= top[1] or score > top[0]:
                    top = score, end
        out: list[tuple[int, int, int]] = []
        taken: list[tuple[int, int]] = []  # in order, and apart
        for _, common, start, end in sorted(found, key=lambda r: (-r[0], -r[1], r[2])):
            place = bisect_left(taken, (start, end))
            if (place == 0 or taken[place - 1][1] <= start) and (place == len(taken) or end <= taken[place][0]):
                taken.insert(place, (start, end))
                out.append((common, start, end))
        return out

    def _longer(self, k: int) -> list[int]:
        """Templates of other licences that hold nearly all of template k."""
        if k not in self.parts:
            self.parts[k] = [j for j in range(k + 1, len(self.sizes)) if self.names[j] != self.names[k] and
                             sum((self.counts[k] & self.counts[j]).values()) >= 0.9 * self.sizes[k]]
        return self.parts[k]

    def _is_part(self, k: int, words: list[bytes], start: int, end: int) -> bool:
        """Whether the run is rather a piece of a longer template."""
        def common(t: int, a: int, b: int) -> int:
            return sum((self.counts[t] & Counter(zip(words[a:b], words[a + 1:b]))).values())

        return any((more := self.sizes[j] - self.sizes[k]) and
                   2 * (common(j, max(0, start - more), end + more) - common(k, start, end)) >= more
                   for j in self._longer(k))

    def found(self, text: str) -> list[list[tuple[float, str]]]:
        """(score, licence) of the matching templates, per matching unit."""
        words = normalised(text)
        possible = self.possible(words)
        if not possible:
            return []
        seen = {unit: m for unit in units(text) if (m := self.matches(normalised(unit)))}
        found = list(seen.values())
        # Pieces end at white space, so their words are those of the text.
        pieces = [m[0] for m in _PIECE.finditer(text)]
        starts = [0, *accumulate(map(len, pieces))]
        before = [0, *accumulate(len(normalised(p)) for p in pieces)]
        pairs, at = self.numbered(words), sorted(set(before))
        runs = sorted(((c, s, e) for k in possible for c, s, e in self.runs(k, pairs, at)),
                      key=lambda r: (-r[0], r[2] - r[1], r[1]))
        if not runs:
            return found
        # What matches already: (common bigrams, start, end, templates), by words.
        taken = [(round(max(s * (e - b + self.sizes[k] - 1) / 2 for s, k in seen[unit])), b, e, {k for _, k in seen[unit]})
                 for unit, b, e in _places(text, starts, before) if unit in seen]
        whole: set[tuple[bytes, ...]] = set()
        spans = {(b, e) for _, b, e, _ in taken}
        for common, start, end in runs:
            if (start, end) in spans:
                continue
            pairs = list(zip(words[start:end], words[start + 1:end]))
            if any(b < end and start < e and n >= common and
                   any(2 * sum(pair in self.counts[k] for pair in pairs) >= len(pairs) for k in ks)
                   for n, b, e, ks in taken):
                continue
            m = [(score, k) for score, k in self.matches(words[start:end]) if not self._is_part(k, words, start, end)]
            taken.append((common, start, end, {k for _, k in m}))
            if m and (key := tuple(words[start:end])) not in whole:
                whole.add(key)
                found.append(m)
        return [[(score, self.names[k]) for score, k in m] for m in found]


def units(text: str) -> set[str]:
    """Distinct lines and paragraphs, and the whole text."""
    return {*text.split("\n"), *_BLANK.split(text), text}


def _places(text: str, starts: list[int], before: list[int]) -> Iterator[tuple[str, int, int]]:
    """(unit, first word, end) of every line, every paragraph and the whole
    text, from the places of the pieces and the words before each."""
    for pattern in (re.compile("\n"), _BLANK):
        at = 0
        for m in [*pattern.finditer(text), None]:
            end = m.start() if m else len(text)
            yield text[at:end], before[bisect_left(starts, at)], before[bisect_left(starts, end)]
            at = m.end() if m else end
    yield text, 0, before[-1]


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, score, n_matches, licenses per document; by default with
    the notices and the full texts."""
    templates = (*TEMPLATES, *full_texts()) if templates is None else templates
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("score", pa.float64()),
                        ("n_matches", pa.int64()), ("licenses", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                hits = known.found(text or "")
                best = min((h for m in hits for h in m), key=lambda h: (-h[0], h[1]), default=None)
                names = sorted({name for m in hits for _, name in m})
                for column, v in zip(out, (best and best[1], best and best[0], len(hits), ",".join(names))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in
                                                                 zip(out, list(schema)[1:]))], schema=schema)

    return keyed_text(docs).mapInArrow(run, "doc_id long, license string, score double, n_matches long, licenses string")
