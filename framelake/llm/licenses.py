"""License scans by patience alignment of templates with texts."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.license_texts import TEXTS
from framelake.llm.words import NOT_WORD, slices, split, word_hashes

#: Notices, headers and permissions of common public licenses (fixed values), and the whole texts of short ones.
TEMPLATES = TEXTS | {
    "mit-notice": "Released under the MIT License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
}
COVERAGE = 0.8
#: Words without any template word that end a region of the text.
MAX_GAP = 6
#: Words of the text, for each of the template's, within which regions are chained.
SPREAD = 3
SCHEMA = "doc_id long, license string, coverage double, matched long, start_word long, end_word long"


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting."""
    tops, places, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = places[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            places.append(i)
        else:
            tops[k], places[k] = v, i
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal words: equal ends, then anchors that are unique on both sides, then the gaps alike."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        ca, cb = Counter(a[i0:i1]), Counter(b[j0:j1])
        at = {b[j]: j for j in range(j0, j1) if cb[b[j]] == 1}
        pairs = [(i, at[a[i]]) for i in range(i0, i1) if ca[a[i]] == 1 and a[i] in at]
        anchors = [pairs[k] for k in longest_increasing([j for _, j in pairs])]
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(i0 - 1, j0 - 1), *anchors], [*anchors, (i1, j1)], strict=True):
            todo.append((p + 1, r, q + 1, s))
    return sorted(out)


def lcs_rows(places: dict[int, int], width: int, words: list[int]) -> list[int]:
    """Bit-parallel longest common subsequences of a template with a growing text: after each word, clear bits are matches.

    places: bits of each word's places in the template."""
    rows, v, full = [], (1 << width) - 1, (1 << width) - 1
    for w in words:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def lcs(template: list[int], places: dict[int, int], words: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of a longest common subsequence."""
    rows, out, i = lcs_rows(places, len(template), words), [], len(template)
    for j in range(len(words) - 1, -1, -1):
        # the lowest prefix of the template with the same length leaves only words that match here
        mask = (1 << i) - 1
        here = i - (rows[j] & mask).bit_count()
        before = i - ((rows[j - 1] if j else mask) & mask).bit_count()
        if here == before:
            continue
        while i and not (rows[j] >> (i - 1)) & 1 == 0:
            i -= 1
        out.append((i - 1, j))
        i -= 1
    return out[::-1]


class Scanner:
    """Regions of texts where a template's words stand closely, chains of regions, and their alignments."""

    def __init__(self, templates: dict[str, str], coverage: float, max_gap: int):
        self.coverage, self.max_gap, self.names, words = coverage, max_gap, list(templates), []
        for _, raw, off in slices(pa.array(list(templates.values()), pa.string())):
            starts, ends, woff = split(raw, off, NOT_WORD)
            h = word_hashes(raw, starts, ends)
            words += [h[woff[i] : woff[i + 1]] for i in range(len(off) - 1)]
        self.vocab, at = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_inverse=True)
        self.templates = np.split(at, np.cumsum([len(w) for w in words])[:-1]) if words else []
        self.holds = np.zeros((len(words), len(self.vocab)), bool)
        for k, t in enumerate(self.templates):
            self.holds[k, t] = True
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.vocab & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def scan(self, hashes: np.ndarray, woff: np.ndarray):
        """(text, template, matched, first word, end word) of the alignments that cover enough of a template."""
        near = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
        if not len(near):
            return
        at = np.minimum(np.searchsorted(self.vocab, hashes[near]), len(self.vocab) - 1)
        ok = self.vocab[at] == hashes[near]
        place, sym = near[ok], at[ok]
        doc = np.searchsorted(woff, place, "right") - 1
        for k, template in enumerate(self.templates):
            mine = self.holds[k, sym]
            p, s, d = place[mine], sym[mine], doc[mine]
            if len(p) == 0:
                continue
            new = np.ones(len(p), bool)
            new[1:] = (d[1:] != d[:-1]) | (p[1:] - p[:-1] > self.max_gap)
            region = np.cumsum(new) - 1
            need = int(np.ceil(self.coverage * len(template)))
            # different words: a region that covers the template has this many at least
            kinds = len(np.unique(template)) - (len(template) - need)
            seen = np.unique(region * len(self.vocab) + s) // len(self.vocab)
            enough = (np.bincount(region) >= need) & (np.bincount(seen, minlength=region[-1] + 1) >= kinds)
            bounds = np.append(np.flatnonzero(new), len(p))
            found = []
            for r in np.flatnonzero(enough):
                todo = [(int(bounds[r]), int(bounds[r + 1]))]
                while todo:
                    lo, hi = todo.pop()
                    if hi - lo < need:
                        continue
                    pairs = patience(template.tolist(), s[lo:hi].tolist())
                    if len(pairs) >= need:  # other copies may stand on either side
                        first, last = lo + min(j for _, j in pairs), lo + max(j for _, j in pairs)
                        found.append((-len(pairs), first, last))
                        todo += [(last + 1, hi), (lo, first)]
                    elif hi - lo > 3 * len(template) // 2:  # several copies leave no unique words: overlapping halves have fewer
                        half, reach = (lo + hi) // 2, (3 * len(template) // 2 + 1) // 2
                        todo += [(half - reach, hi), (lo, half + reach)] if hi - lo > 4 * reach else [
                            (lo + (hi - lo) // 3, hi), (lo, hi - (hi - lo) // 3),
                        ]
            found += self._chains(template, need, kinds, p, s, d, found)
            taken = np.zeros(len(p), bool)
            for n, first, last in sorted(set(found), key=lambda x: (x[0], x[2] - x[1], x)):  # of results that overlap, the fullest and shortest
                if not taken[first : last + 1].any():
                    taken[first : last + 1] = True
                    start = int(woff[d[first]])
                    yield int(d[first]), k, -n, int(p[first]) - start, int(p[last]) - start + 1

    def _chains(self, template: np.ndarray, need: int, kinds: int, p: np.ndarray, s: np.ndarray, d: np.ndarray, found: list) -> list:
        """Alignments across regions: windows of SPREAD words for each of the template's that end at each place.

        Complete copies are left out, and no window goes across one. A window is aligned unless it has too few of the
        template's words, or the longest common subsequence of a window before it shows that it can't have enough."""
        whole = np.zeros(len(p) + 1, np.int64)
        for n, first, last in found:
            if -n == len(template):
                whole[first] += 1
                whole[last + 1] -= 1
        left = np.flatnonzero(np.cumsum(whole[:-1]) == 0)
        if len(left) < need:
            return []
        span = SPREAD * len(template)
        sym = s[left]
        apart = np.concatenate(([0], np.cumsum((d[left][1:] != d[left][:-1]) | (np.diff(left) > 1))))
        place = p[left] + apart * span
        lo = np.searchsorted(place, place - span + 1)
        order = np.lexsort((np.arange(len(sym)), sym))
        again = np.full(len(sym), len(sym))
        same = sym[order][1:] == sym[order][:-1]
        again[order[:-1][same]] = order[1:][same]
        # a place counts as its word's last one until the word comes again or the window leaves it
        ends = np.minimum(again, np.searchsorted(place, place + span - 1, "right"))
        at = np.arange(len(sym))
        different = at + 1 - np.cumsum(np.bincount(ends, minlength=len(sym) + 1)[: len(sym)])
        ok = np.zeros(len(self.vocab), bool)
        ok[template[need - 1 :]] = True
        able = np.flatnonzero((different >= kinds) & (at - lo + 1 >= need) & ok[sym])
        words, places, back, out, next_ = template.tolist(), {}, {}, [], 0
        for i, w in enumerate(words):
            places[w] = places.get(w, 0) | 1 << i
            back[w] = back.get(w, 0) | 1 << (len(words) - 1 - i)
        for r in able.tolist():
            if r < next_:
                continue
            text = sym[lo[r] : r + 1].tolist()
            most = len(words) - lcs_rows(places, len(words), text)[-1].bit_count()
            if most < need:
                next_ = r + need - most
                continue
            pairs = patience(words, text)
            if len(pairs) == most:
                out.append((-most, int(left[lo[r] + pairs[0][1]]), int(left[lo[r] + pairs[-1][1]])))
            # words that are not unique hide a fuller alignment, or draw in words before it: the one that begins last
            pairs = lcs(words[::-1], back, text[::-1])
            out.append((-most, int(left[r - pairs[-1][1]]), int(left[r - pairs[0][1]])))
        return out


def _task(templates: dict[str, str], coverage: float, max_gap: int):
    def task(batches):
        scanner = Scanner(templates, coverage, max_gap)
        sizes = [len(t) for t in scanner.templates]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for a, raw, off in slices(batch.column(1)):
                starts, ends, woff = split(raw, off, NOT_WORD)
                for d, k, n, first, end in scanner.scan(word_hashes(raw, starts, ends), woff):
                    rows.append((ids[a + d], scanner.names[k], n / sizes[k], n, first, end))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return task


def license_hits(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, max_gap: int = MAX_GAP) -> DataFrame:
    """doc_id, license, coverage, matched (template words), start_word and end_word of each alignment found in docs.

    docs: doc_id, text, others ignored. Words are runs of ASCII letters and digits and of non-ASCII characters, capitals
    folded. A region is a part of a text with no more than `max_gap` - 1 words between two words of the template; regions
    within SPREAD words for each of the template's are aligned as one as well. An alignment is reported where the aligned
    words are at least the `coverage` share of the template; of those that overlap, the fullest. Null and empty texts have no
    regions; repeated rows give repeated results; a text may have several licenses, and one several times.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return df.mapInArrow(_task(dict(templates or TEMPLATES), coverage, max_gap), SCHEMA)
