"""License scan: winnowed fingerprints pick candidates, banded alignment confirms and measures them.

Templates and texts are words of letters and digits (ASCII case folded). Every run of k words is hashed; of
each ``window`` neighbouring hashes of a template the least is its fingerprint, kept in an inverted index
(hash -> template, position). The index is as large as the templates, not the corpus, and is broadcast. All
of a text's k-word hashes are looked up, so any stretch of k + window - 1 template words raises a candidate.

Hits of a template whose expected starts drift by at most ``band`` words (for short templates half their
words, so that a copy never reaches into the same words of the next) are a run. A run's region is as long as
the template and the band on both sides. It is dropped if it doesn't hold enough of the template's words for
``coverage`` in any order, piece by piece (so nothing that could match is), and else aligned in a band around the run's
starts: matched words over template words is its coverage, and its first and last matched words bound its
span. Runs that didn't match alone are joined, in order, over insertions of up to the template's length or
``stretch`` words, and aligned in a band as wide as that. Runs of more hits come first; what a match covers
is taken, and later runs of its template are aligned in what is left beside it. Each text is scanned alone and
whole: no shuffle, nothing gathered.

The templates are the files of license_texts (whole licenses, as published) and the notices below.

Defined results: null, empty and unmatched texts give no rows; repeated rows give their matches each; a
null id stays null; of equally long matches of a run the later start, then the earlier end counts; spans of
different templates may overlap; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import bounded_batches, opened, shipped, tidy
from quillspark.llm.textarrays import chunks, shingles, span_hashes, text_bytes, word_spans

# Notices of public licenses.
NOTICES = {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def templates() -> dict[str, str]:
    """The notices and, by their files' names, the licenses of license_texts."""
    return NOTICES | {p.stem: p.read_text("utf-8") for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash (the last of equals) of each window; of all hashes if they are fewer."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(rows)) + window - 1 - rows.argmin(axis=1))


ONE, LAST = 1 << 42, (1 << 21) - 1  # a packed alignment: matched words, first place, LAST minus last place


def align(template: np.ndarray, region: np.ndarray, width: int) -> tuple[int, int, int]:
    """(matched words, first and last matched place in region) of the best alignment.

    Template word i may match the places from i to i + width - 1. Of alignments with equally many matches
    the one starting last, then ending first, wins.
    """
    before = np.zeros(width, np.int64)
    for i, word in enumerate(template):
        now = np.append(before[1:], before[-1])  # template word i stays unmatched
        at = np.flatnonzero(region[i : i + width] == word)
        if len(at):
            own = before[at]  # at places before place i + at
            own = np.where(own >= ONE, (own >> 21) << 21, (i + at) << 21) + ONE + (LAST - i - at)
            now[at] = np.maximum(now[at], own)
            now = np.maximum.accumulate(now)
        before = now
    best = int(before.max())
    return best >> 42, best >> 21 & LAST, LAST - (best & LAST)


class Index:
    def __init__(self, templates: dict[str, str], k: int, window: int):
        self.k, self.names = k, sorted(templates)
        self.words: list[np.ndarray] = []
        postings = []
        for t, name in enumerate(self.names):
            buffer, starts, ends, first = word_spans([templates[name].encode()], letters=True)
            own = span_hashes(buffer, starts, ends)
            self.words.append(own)
            grams, _ = shingles(own, first, k)
            postings += [(int(grams[p]), t, int(p)) for p in winnow(grams, window)]
        postings.sort()
        self.hash = np.array([h for h, _, _ in postings], np.uint64)
        self.template = [t for _, t, _ in postings]
        self.place = [p for _, _, p in postings]

    def candidates(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hash, grams)
        at[at == len(self.hash)] = 0
        return np.flatnonzero(self.hash[at] == grams) if len(self.hash) else np.zeros(0, np.int64)


class _Run:
    """Hits of one template in its order: the first and last (place in the text, place in the template)."""

    def __init__(self, place: int, own: int):
        self.first = self.last = (place, own)
        self.low = self.high = place - own  # where the template would start
        self.hits = 1

    def add(self, last: tuple[int, int], low: int, high: int, hits: int) -> None:
        self.last, self.low, self.high, self.hits = last, min(self.low, low), max(self.high, high), self.hits + hits


def runs_of(hits: list[tuple[int, int]], band: int, size: int) -> list[_Run]:
    """Runs of a template's hits (sorted), each hit in the run with the least drift that it can go on."""
    found: list[_Run] = []
    open_runs: dict[int, list[_Run]] = defaultdict(list)  # by the last hit's start, in steps of band + 1
    for p, q in hits:
        start, best = p - q, None
        for key in range(start // (band + 1) - 1, start // (band + 1) + 2):
            some = open_runs.get(key)
            if not some:
                continue
            some[:] = [r for r in some if p - r.last[0] <= size + band]
            for r in some:
                drift = abs(start - (r.last[0] - r.last[1]))
                if r.last[0] < p and drift <= band and (best is None or drift < best[0]):
                    best = drift, key, r
        if best is None:
            run = _Run(p, q)
            found.append(run)
        else:
            run = best[2]
            open_runs[best[1]].remove(run)
            run.add((p, q), start, start, 1)
        open_runs[start // (band + 1)].append(run)
    return found


def joined(runs: list[_Run], reach: int) -> list[_Run]:
    """Runs (in order) that go on one another over up to ``reach`` inserted words, as one; others are left out."""
    chains: list[_Run] = []
    grown: set[int] = set()
    for r in runs:
        for c in reversed(chains):
            gap, own = r.first[0] - c.last[0], r.first[1] - c.last[1]
            if gap > 0 and own > 0 and gap - own <= reach:
                c.add(r.last, r.low, r.high, r.hits)
                grown.add(id(c))
                break
        else:
            c = _Run(*r.first)
            c.add(r.last, r.low, r.high, r.hits - 1)
            chains.append(c)
    return [c for c in chains if id(c) in grown]


class Scanner:
    """Matches of one template in one text's words."""

    def __init__(self, template: np.ndarray, own: np.ndarray, k: int, band: int, coverage: float, memo: dict, name: int):
        self.template, self.own, self.k, self.memo, self.name = template, own, k, memo, name
        self.band = min(band, len(template) // 2)
        self.need = max(1, int(np.ceil(coverage * len(template) - 1e-9)))
        self.taken: list[tuple[int, int]] = []

    def match(self, run: _Run) -> tuple[int, int, int] | None:
        """(matched, first, last) in the run's region beside what is taken."""
        size, start = len(self.template), run.low - self.band
        width = run.high + self.band - start + 1
        lo, hi = max(0, start), min(len(self.own), start + size + width - 1)
        for a, b in self.taken:
            if b < run.last[0] + self.k - 1:
                lo = max(lo, b + 1)
            elif a > run.first[0]:
                hi = min(hi, a)
        if hi - lo < self.need:
            return None
        held = self.own[lo:hi]
        if np.isin(self.template, held).sum() < self.need or np.isin(held, self.template).sum() < self.need:
            return None
        region = np.zeros(size + width - 1, np.uint64)
        region[lo - start : hi - start] = held
        pieces = range(0, size, 64)  # a piece's words can only match inside its own part of the band
        if size > 128 and sum(np.isin(self.template[i : i + 64], region[i : i + 63 + width]).sum() for i in pieces) < self.need:
            return None
        key = (self.name, width, region.tobytes())
        if key not in self.memo:
            if len(self.memo) > 5_000:
                self.memo.clear()
            self.memo[key] = align(self.template, region, width)
        n, first, last = self.memo[key]
        return (n, start + first, start + last) if n >= self.need else None

    def covered(self, run: _Run) -> bool:
        return any(a <= run.first[0] and run.last[0] + self.k - 1 <= b for a, b in self.taken)

    def settle(self, runs: list[_Run]) -> list[tuple[int, int, int]]:
        """Matches of runs, those of more hits and then the earlier first; each beside what is taken before it."""
        found = []
        for r in sorted(runs, key=lambda r: (-r.hits, r.first)):
            while not self.covered(r) and (m := self.match(r)):
                self.taken.append(m[1:])
                found.append(m)
        return found

    def scan(self, hits: list[tuple[int, int]], stretch: int) -> list[tuple[int, int, int]]:
        if len(self.own) < self.need:
            return []
        runs = runs_of(hits, self.band, len(self.template))
        found = self.settle(runs)
        left = [r for r in runs if not any(x <= r.last[0] + self.k - 1 and r.first[0] <= y for x, y in self.taken)]
        chains = joined(left, max(stretch, len(self.template))) if len(left) > 1 else []
        return found + self.settle(chains)


def scan_text(index: Index, own: np.ndarray, hits: list[int], grams: np.ndarray, band: int, coverage: float, stretch: int, memo: dict) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, last word) of one text's matches. hits: places of known hashes."""
    places: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p in hits:
        at = int(np.searchsorted(index.hash, grams[p]))
        while at < len(index.hash) and index.hash[at] == grams[p]:
            places[index.template[at]].append((p, index.place[at]))
            at += 1
    found = []
    for t, own_hits in places.items():
        found += [(t, *m) for m in Scanner(index.words[t], own, index.k, band, coverage, memo, t).scan(own_hits, stretch)]
    return sorted(found, key=lambda m: (m[2], m[0]))


def scan(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", known: dict[str, str] | None = None, k: int = 3, window: int = 2, band: int = 8, coverage: float = 0.8, stretch: int = 64) -> DataFrame:
    """Per match: doc_id, template, matched, template_words, coverage, start_char, end_char, matched_text.

    known: name -> text of each template (default: templates()). start_char and end_char count code points;
    end_char is exclusive.
    """
    bounded_batches(documents.sparkSession)
    bc = shipped(documents.sparkSession, Index(templates() if known is None else known, k, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = opened(bc), {}
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), text_bytes(batch.column(1)), []
            for i, j in chunks(texts):
                buffer, starts, ends, first = word_spans(texts[i:j], letters=True)
                hashes = span_hashes(buffer, starts, ends)
                grams, limits = shingles(hashes, first, k)
                hits = index.candidates(grams)
                owner = np.searchsorted(limits, hits, side="right") - 1
                begin = np.cumsum([0, *(len(b) + 1 for b in texts[i:j])])
                for x in np.unique(owner):
                    lo, hi = limits[x], limits[x + 1]
                    own = hashes[first[x] : first[x + 1]]
                    for t, n, a, b in scan_text(index, own, (hits[owner == x] - lo).tolist(), grams[lo:hi], band, coverage, stretch, memo):
                        s, e = int(starts[first[x] + a] - begin[x]), int(ends[first[x] + b] - begin[x])
                        body = texts[i + x]
                        at = len(body[:s].decode("utf-8", "replace"))
                        span = body[s:e].decode("utf-8", "replace")
                        rows.append((ids[i + x], index.names[t], n, len(index.words[t]), n / len(index.words[t]), at, at + len(span), span))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "template", "matched", "template_words", "coverage", "start_char", "end_char", "matched_text"])

    return documents.select(F.col(doc_id).cast("long"), text).mapInArrow(tidy(run), "doc_id bigint, template string, matched bigint, template_words bigint, coverage double, start_char bigint, end_char bigint, matched_text string")
