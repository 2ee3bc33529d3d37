"""Operator 10, licence scan by conditional compression.

Overlapping windows of bounded size surround the licence cues, over line ends; a notice with a cue lies whole in the
window that has the cue. Templates of which too many words are missing from a window can't be in it; all others are
confirmed by exact wording: the least number of word insertions, deletions and replacements that turn some span of the
window into the template, at most a fifth of its words and none of those that say which licence it is (name, version,
BY, NC, ND, SA). The window is compressed by zstandard alone and with each of
these templates as raw-content dictionary; the share saved is given and orders equals, but drops none. Spans don't
overlap; those with more words of their template come first.

Defined cases: null and empty texts and texts without a cue have no row; equal spans with equal reductions go to the template
listed first; a licence that occurs twice gives two rows; rows that repeat give repeated results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .common import arrow_map, id_text

#: Fixed values: (licence, wording) of public licence notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 license."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
CUE = re.compile(r"licen[sc]e|permission|redistribut|copyright|public[\W_]+domain|creative[\W_]+commons", re.I)
#: A hyphen at a line's end joins the word to the next line's, whatever comment leader that has.
WORD = re.compile(r"[^\W_]+(?:(?:[.'/]|-(?:[ \t\r]*\n[^\w\n]*)?)[^\W_]+)*")
BREAK = re.compile(r"\s*\n[^\w\n]*")
TOLERANCE = 0.2
#: Words that say which licence it is. Where a wording has such a phrase, a span must have it word for word, with
#: nothing in between. Licences that aren't listed: the parts of their name.
IDENTIFYING = {
    "Apache-2.0": ("Apache", "2.0"),
    "MIT": ("MIT", "this permission notice"),
    "GPL-3.0": ("GNU General Public License", "3"),
    "GPL-2.0": ("GNU General Public License", "2"),
    "BSD": ("source and binary forms",),
    "MPL-2.0": ("Mozilla Public License", "2.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "CC0-1.0": ("CC0",),
    "Unlicense": ("unencumbered", "public domain"),
}
NUMBER = re.compile(r"v?(\d+)(?:\.0)*")
#: More than any number of differences: the price of what a span must not have.
NEVER = 1 << 30


def normal(word: str) -> str:
    """A word as it is compared: in lower case, without a line break inside; v2.0 is 2, and licence is license."""
    word = BREAK.sub("", word.lower())
    number = NUMBER.fullmatch(word)
    return number.group(1) if number else word.replace("licence", "license")


def identifying(words: list[str], phrases: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of a wording: whether it must be there, and whether nothing may come between it and the next."""
    exact, joined = np.zeros(len(words), bool), np.zeros(len(words), bool)
    for p in phrases:
        own = [normal(w) for w in WORD.findall(p)]
        for i in range(len(words) - len(own) + 1):
            if own and words[i : i + len(own)] == own:
                exact[i : i + len(own)], joined[i : i + len(own) - 1] = True, True
    return exact, joined


def windows(text: str, reach: int) -> Iterator[tuple[int, list[tuple[int, int, str, bool]], int]]:
    """(first, words, last) of overlapping windows, words being (start, end, word, whether it has a cue).

    first is the number of the first word, last that of the window's last own cue. Own cues are at most ``reach`` words
    apart, and a window has ``reach`` more words to
    either side: 3 * reach + 1 at most, however dense the cues are.
    """
    cues = CUE.finditer(text)
    cue, base, held, open_ = next(cues, None), 0, [], []

    def cut() -> tuple[int, list, int]:
        last = max(c for c in open_ if c <= open_[0] + reach)
        at = max(base, open_[0] - reach)
        del open_[: sum(c <= last for c in open_)]
        return at, held[at - base : last + reach + 1 - base], last

    if cue is None:
        return
    for i, m in enumerate(WORD.finditer(text)):
        has = False
        while cue is not None and cue.start() < m.end():
            has, cue = True, next(cues, None)
        held.append((m.start(), m.end(), normal(m.group()), has))
        if has:
            open_.append(i)
        while open_ and i >= open_[0] + 2 * reach:
            yield cut()
        if cue is None and not open_:
            return
        if len(held) > 8 * reach:
            keep = max(base, (open_[0] if open_ else i + 1) - reach)
            del held[: keep - base]
            base = keep
    while open_:
        yield cut()


def best_span(words: np.ndarray, wanted: np.ndarray, exact: np.ndarray | None = None, joined: np.ndarray | None = None) -> tuple[int, int, int]:
    """(differences, first, last + 1) of the span of words that is nearest to wanted; the leftmost shortest of equals.

    Words of -1 are taken: no span goes over them. Wanted words that are exact can't differ, and after joined ones
    nothing is inserted.
    """
    n = words.size
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    each = np.where(words == -1, NEVER, 1)
    steps, along = np.arange(n + 1), np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))
    for i, w in enumerate(wanted):
        must = exact is not None and exact[i]
        up, diag = cost + (NEVER if must else 1), cost[:-1] + np.where(words == w, 0, NEVER if must else each)
        new, origin = up.copy(), start.copy()
        better = diag <= up[1:]
        new[1:][better], origin[1:][better] = diag[better], start[:-1][better]
        if joined is not None and joined[i]:
            cost, start = new, origin
            continue
        shifted = new - along  # insertions run to the right
        low = np.minimum.accumulate(shifted)
        at = np.maximum.accumulate(np.where(shifted == low, steps, 0))
        cost, start = low + along, origin[at]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        self.words = [[normal(w) for w in WORD.findall(t)] for _, t in templates]
        self.marks = [identifying(w, IDENTIFYING.get(n, tuple(n.split("-")))) for n, w in zip(self.names, self.words, strict=True)]
        self.most = [int(TOLERANCE * len(w)) for w in self.words]
        #: No span that is confirmed has more words.
        self.reach = max((len(w) + n for w, n in zip(self.words, self.most, strict=True)), default=0)
        self.plain = zstandard.ZstdCompressor(level=3)
        self.given = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in templates]

    def possible(self, have: set[str]) -> list[int]:
        """Templates of which no more words are missing than may differ, and no identifying one."""
        out = []
        for k, words in enumerate(self.words):
            gone = [i for i, w in enumerate(words) if w not in have]
            if words and len(gone) <= self.most[k] and not self.marks[k][0][gone].any():
                out.append(k)
        return out

    def ranked(self, block: str, which: list[int]) -> list[tuple[float, int]]:
        """(share of the compressed size saved, template) of these templates, best first."""
        raw = " ".join(block.lower().split()).encode("utf-8", "replace")
        alone = len(self.plain.compress(raw))
        return sorted(((1 - len(self.given[k].compress(raw)) / alone, k) for k in which), key=lambda x: (-x[0], x[1]))

    def spans(self, k: int, words: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(differences, first, last + 1) of the spans confirmed for a template, nearest first; words of None are taken."""
        ids = {w: i for i, w in enumerate(dict.fromkeys(self.words[k]))}
        wanted = np.array([ids[w] for w in self.words[k]])
        own = np.array([-1 if w is None else ids.get(w, -2) for w in words])
        while (own >= 0).sum() >= wanted.size - self.most[k]:
            n, a, b = best_span(own, wanted, *self.marks[k])
            if n > self.most[k]:
                return
            yield n, a, b
            own[a:b] = -1

    def scan(self, text: str) -> list[tuple]:
        """(licence, start, length, differences, template words, saved)."""
        found, taken = [], set()
        for base, held, last in windows(text, self.reach):
            while True:
                words = [None if base + i in taken else x[2] for i, x in enumerate(held)]
                which = self.possible(set(words))
                some = []
                for saved, k in self.ranked(text[held[0][0] : held[-1][1]], which) if which else []:
                    for n, a, b in self.spans(k, words):
                        # a span whose cues are all of later words may go on behind this window, which isn't its own
                        cues = [base + i for i in range(a, b) if held[i][3]]
                        if not cues or cues[0] <= last:
                            some.append((len(self.words[k]) - n, n, saved, k, a, b))
                if not some:
                    break
                for _, n, saved, k, a, b in sorted(some, key=lambda x: (-x[0], x[1], -x[2], x[3], x[4])):
                    if taken.isdisjoint(range(base + a, base + b)):
                        taken.update(range(base + a, base + b))
                        found.append((self.names[k], held[a][0], held[b - 1][1] - held[a][0], n, len(self.words[k]), saved))
        return sorted(found, key=lambda x: x[1])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row for each notice found: doc_id, license, start, length, differences, template_words, saved."""
    names = ("license", "start", "length", "differences", "template_words", "saved")

    def make():
        s = Scanner(templates)

        def f(x):
            got = [(i, *r) for i, t in zip(x["doc_id"], x["text"], strict=True) for r in s.scan(t)]
            return dict(zip(("doc_id", *names), map(list, zip(*got, strict=True)), strict=True)) if got else dict.fromkeys(("doc_id", *names), [])

        return f

    return arrow_map(id_text(docs, id_col, text_col), make, "doc_id long, license string, start long, length long, differences long, template_words long, saved double")
