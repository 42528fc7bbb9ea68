"""License scans by conditional compression.

A text is read as words, whatever lines, comment marks and white space lie between. Around each cue (a license, a
copyright or a warranty is named) lies a candidate block of words, wide enough for the longest wording; a cue that a
block's middle covers needs none of its own. A block is compressed alone and with every template as a zstandard raw
dictionary, and the templates that save most bytes are aligned with it. Each place where such a template's wording is
found is a row: the words of the template that the place lacks, and those it adds, version numbers aside. The words that
tell licenses apart must all be there, none of another license of the family be added, and a version that the license's
name has must not be another one. What is confirmed is cut out, and the rest of the block is ranked again until nothing
more is confirmed, so several wordings of a block are all found. A cue outside all such places is a row of its own, not
confirmed, with the template that comes nearest among those that save most on its line.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Wordings of public licenses, and the words that make a block a candidate.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "LGPL": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Released under the BSD License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",),
    "ARR": ("All rights reserved.",),
}
# Short identifiers, as they stand behind `SPDX-License-Identifier:`.
IDENTIFIERS = {"Apache-2.0": "Apache-2.0", "MIT": "MIT", "BSD": "BSD-3-Clause", "GPL": "GPL-3.0", "LGPL": "LGPL-3.0", "AGPL": "AGPL-3.0", "MPL-2.0": "MPL-2.0", "CC-BY": "CC-BY-4.0", "CC-BY-SA": "CC-BY-SA-4.0", "CC-BY-NC": "CC-BY-NC-4.0", "ISC": "ISC", "Zlib": "Zlib", "Unlicense": "Unlicense", "EPL-2.0": "EPL-2.0"}
TEMPLATES = {name: wordings + ((f"SPDX-License-Identifier: {IDENTIFIERS[name]}",) if name in IDENTIFIERS else ()) for name, wordings in TEMPLATES.items()}
CUE = re.compile(r"licen[sc]|copyright|©|all\W+rights\W+reserved|permission\W+is\W+hereby|redistribut|warrant|\bSPDX\b|public\W+domain|creative\W+commons|\bCC\W+BY", re.I)
WORD = re.compile(r"[^\W\d_]+")
MARKS = re.compile(r"\s*\n[\s#*/;%!>|-]*|\s+")
# Words that may not be missing; words that tell another license of the family when added.
TELLING = frozenset("apache mit bsd mozilla gnu general lesser affero creative commons cc by nc sa attribution noncommercial sharealike spdx gpl lgpl agpl mpl isc zlib unlicense unencumbered eclipse epl".split())
RIVALS = {
    "GPL": frozenset("lesser library affero".split()),
    "CC": frozenset("nc noncommercial commercial sa sharealike alike nd noderivatives noderivs derivatives derivs".split()),
}
RIVALS |= {"LGPL": RIVALS["GPL"] - {"lesser"}, "AGPL": RIVALS["GPL"] - {"affero"}}
VERSION = re.compile(r"\bv(?:ersion)?\b\W*(\d+(?:\.\d+)*)", re.I)
#: Words after a place that still belong to the license's name: -ND, NonCommercial-NoDerivatives.
TRAILING = re.compile(r"(?:[ \t]*-\s*|[ \t]+)([^\W\d_]+)")
#: Words on either side of a cue that templates are ranked for, beside the whole block.
SCALES = (5, 16)
FOUND = "doc_id long, block long, license string, saved double, missing int, added int, confirmed boolean, wording string"


class Scanner:
    def __init__(self, level: int, top: int, near: float):
        import zstandard

        self.top, self.near = top, near
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.templates = []
        for name, wordings in TEMPLATES.items():
            for wording in wordings:
                book = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.templates.append((name, WORD.findall(wording.lower()), zstandard.ZstdCompressor(level=level, dict_data=book, write_content_size=False)))
        self.longest = max(len(wording) for _, wording, _ in self.templates)
        self.codes = {w: i for i, w in enumerate(sorted({w for _, wording, _ in self.templates for w in wording}))}
        self.seen: dict[str, tuple] = {}
        self.ranks: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def saved(self, text: str, i: int) -> float:
        raw = text.encode(errors="replace")
        return 1 - len(self.templates[i][2].compress(raw)) / len(self.plain.compress(raw))

    def nearest(self, text: str) -> tuple:
        """(license, share of bytes saved, missing words, added words) of the best template for a text without a wording."""
        ranked = sorted(((self.saved(text, i), -i) for i in range(len(self.templates))), reverse=True)
        words, best = WORD.findall(text.lower()), None
        for share, i in ranked[: self.top]:
            name, wording, _ = self.templates[-i]
            same = sum(m.size for m in SequenceMatcher(None, wording, words, autojunk=False).get_matching_blocks())
            found = (len(wording) - same, len(words) - same, -share, name)
            best = min(best, found) if best else found
        missing, added, share, name = best
        return name, round(-share, 4), missing, added

    def same_license(self, k: int, missing: list[int], text: str, begin: int, end: int) -> bool:
        """Whether a place names the template's own license, by the words and versions in it and right behind it."""
        name, wording, _ = self.templates[k]
        if any(wording[i] in TELLING for i in missing):
            return False
        inside, at = set(WORD.findall(text[begin:end].lower())), end
        for _ in range(4):
            if not (more := TRAILING.match(text, at)):
                break
            inside.add(more[1].lower())
            at = more.end()
        if inside & (RIVALS.get("CC" if name.startswith("CC-") else name, frozenset()) - set(wording)):
            return False
        versions = VERSION.findall(text[begin : end + 16]) if name.endswith("-2.0") else []
        return all(v in ("2", "2.0") for v in versions[:1])

    def places(self, words: list[str], wording: list[str]) -> list[tuple[int, int, list[int]]]:
        """(begin, end, places in the wording that are missing) where the words hold a wording, none overlapping.

        The alignment costs 1 for a missing word and `near` for one added inside; at most `near` of the words may be
        missing, and no more be added than the wording has."""
        m, n, most = len(wording), len(words), self.near * len(wording)
        lack, add = 10_000, max(1, int(10_000 * self.near))
        row = np.array([self.codes.get(w, -1) for w in words], np.int32)
        steps, same = add * np.arange(n + 1, dtype=np.int32), [row == self.codes[w] for w in wording]
        cost = np.zeros((m + 1, n + 1), np.int32)
        for i in range(1, m + 1):
            cost[i] = cost[i - 1] + lack
            cost[i, 1:] = np.where(same[i - 1], np.minimum(cost[i, 1:], cost[i - 1, :-1]), cost[i, 1:])
            if i < m:
                cost[i] = np.minimum.accumulate(cost[i] - steps) + steps
        last = cost[m]
        ends = np.flatnonzero((last[1:] < last[:-1]) & (last[1:] <= lack * most + add * m)) + 1
        out = []
        for end in sorted(ends.tolist(), key=lambda j: (last[j], j)):
            if any(b < end <= e for b, e, _ in out):
                continue
            i, j, begin, missing = m, end, end, []
            while i:
                if j and same[i - 1][j - 1] and cost[i, j] == cost[i - 1, j - 1]:
                    i, j = i - 1, j - 1
                    begin = j
                elif cost[i, j] == cost[i - 1, j] + lack:
                    i -= 1
                    missing.append(i)
                else:
                    j -= 1
            added = end - begin - m + len(missing)
            if len(missing) <= most and added <= m and all(end <= b or e <= begin for b, e, _ in out):
                out.append((begin, end, missing))
        return out

    def ranked(self, block: str) -> tuple[int, ...]:
        """The templates that save most bytes of a block, the best first; those that save none are none."""
        if (known := self.ranks.get(block)) is None:
            raw = block.encode(errors="replace")
            alone = len(self.plain.compress(raw))
            saved = sorted((len(t[2].compress(raw)) - alone, k) for k, t in enumerate(self.templates))
            known = tuple(k for less, k in saved[: self.top] if less < 0)
            if len(self.ranks) > 20_000 or self.size > 5_000_000:
                self.ranks.clear()
                self.seen.clear()
                self.size = 0
            self.ranks[block] = known
            self.size += len(block)
        return known

    def wordings(self, text: str, spans: list[tuple[int, int]], words: list[str], cues: list[int]) -> list[tuple[int, int, int, int, int]]:
        """(begin, end, template, missing, added) of the wordings in a block's words, none overlapping.

        Templates are ranked for the whole block, and for a few words around each cue, as filler drowns a short wording."""
        out: list[tuple[int, int, int, int, int]] = []
        while True:
            edges = [0, *(x for hit in sorted(out) for x in hit[:2]), len(words)]
            free = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
            found = set()
            blocks = [" ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in free)]
            for at in cues:
                for a, b in free:
                    if a <= at < b:
                        blocks += [text[spans[max(a, at - n)][0] : spans[min(b, at + n + 1) - 1][1]] for n in SCALES]
            for k in dict.fromkeys(k for block in blocks for k in self.ranked(block)):
                name, wording, _ = self.templates[k]
                for a, b in free:
                    held = set(words[a:b])
                    if sum(w not in held for w in wording) > self.near * len(wording):
                        continue
                    for begin, end, missing in self.places(words[a:b], wording):
                        if self.same_license(k, missing, text, spans[a + begin][0], spans[a + end - 1][1]):
                            found.add((len(missing), end - begin - len(wording) + len(missing), -len(wording), a + begin, a + end, k))
            new = []
            for missing, added, _, begin, end, k in sorted(found):
                if all(end <= b or e <= begin for b, e, *_ in new):
                    new.append((begin, end, k, missing, added))
            if not new:
                return sorted(out)
            out += new

    def __call__(self, text: str) -> list[tuple]:
        spans = [m.span() for m in WORD.finditer(text)]
        starts, stops = [a for a, _ in spans], [b for _, b in spans]
        words = [text[a:b].lower() for a, b in spans]
        lines = [m.start() for m in re.finditer("\n", text)]
        cues = [(m.start(), bisect_right(stops, m.start())) for m in CUE.finditer(text)]
        reach, out, covered, middle = 2 * self.longest, [], [], -1
        marks = [at for _, at in cues]
        for at in marks:
            if at <= middle:
                continue
            # a wording has at most twice its template's words, so one around a cue of the middle lies in the block
            middle = at + reach
            first, last = max(0, at - reach), min(len(words), middle + reach)
            for begin, end, k, missing, added in self.wordings(text, spans[first:last], words[first:last], [x - first for x in sorted(set(marks[bisect_left(marks, first) : bisect_left(marks, last)]))]):
                a, b = starts[first + begin], stops[first + end - 1]
                if any(a < e and s < b for s, e in covered[-64:]):
                    continue  # the block before has found it
                wording = MARKS.sub(" ", text[a:b])
                covered.append((a, b))
                out.append((bisect_left(lines, a), self.templates[k][0], round(self.saved(wording, k), 4), missing, added, True, wording))
        merged, done = [], -1
        for a, b in sorted(covered):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        covered = merged
        for cue, at in cues:
            k = bisect_right(covered, (cue, len(text)))
            if cue < done or k and cue < covered[k - 1][1]:
                continue
            # the cue's line, as far as it lies within a template's length and outside of the wordings found
            number = bisect_left(lines, cue)
            a = max(lines[number - 1] + 1 if number else 0, starts[max(0, at - self.longest)] if starts else 0, covered[k - 1][1] if k else 0)
            done = min(lines[number] if number < len(lines) else len(text), stops[at + self.longest] if at + self.longest < len(stops) else len(text), covered[k][0] if k < len(covered) else len(text))
            key = text[min(a, cue) : done].strip()
            if key not in self.seen:
                if len(self.seen) > 50_000 or self.size > 5_000_000:
                    self.ranks.clear()
                    self.seen.clear()
                    self.size = 0
                self.seen[key] = self.nearest(key)
                self.size += len(key)
            out.append((number, *self.seen[key], False, key))
        return sorted(out, key=lambda hit: hit[0])


def licenses(docs: DataFrame, level: int = 3, top: int = 6, near: float = 0.2) -> DataFrame:
    """One row a wording or candidate: doc_id, block (its first line's number from 0), license, saved, missing, added, confirmed, wording.

    `saved` is the share of compressed bytes that the template saves; missing and added count words of the exact
    difference to it; confirmed means that at most `near` of the template's words are missing, none that tells its license
    from others, and no more added inside than it has, none that tells another license. Wordings may be wrapped or share a line. Null and empty texts have no rows, nor has an empty table;
    repeated rows repeat theirs; further columns are ignored. Only the `top` templates that save most are aligned."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(level, top, near)
        for rows in slices(batches, "text", 8_000_000):
            found = [(doc_id, *hit) for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()) if text and CUE.search(text) for hit in scanner(text)]
            types = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            names = [c.split()[0] for c in FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, FOUND)
