"""Licence notices in page text: Dice coefficient over word bigrams with known templates."""

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

MIN_DICE = 0.8

# Notices as their licences word them, with the licence's SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]

NO_WORD = re.compile(r"[\W_]+")
LINE_END = re.compile(r"\r\n?|\n")


def licensed_pages(page_text: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
                   min_dice: float = MIN_DICE, inside: bool = False) -> DataFrame:
    """(doc_id, page_idx, license_id, n_places, best_dice) for each licence a row of page_text has a notice
    of.

    Each line of a page is a passage, and so is each block of lines without a blank one between them, and
    the whole text. Passages and templates, (license_id, text), are compared in lower case and by words of
    letters and digits alone: twice the bigrams they share over the bigrams of both, repeats included. Only
    templates whose size allows min_dice (above 0) are looked at. A passage counts once for a licence. Texts
    of less than two words match nothing; pages without notices, null and empty texts give no rows. Rows
    that repeat a page are scanned each. Other columns are ignored.

    With `inside`, notices within longer passages and across lines count too: stretches of the text's words, of
    whatever length and line, that start and end with a bigram of the template and are near enough to it; from
    each word the nearest. Those that share words with a passage counted for the licence belong to it, and its
    coefficient stands for them. Of the others, those with most shared bigrams and then the best coefficient are
    places, and what shares words with a place belongs to it.
    """
    if not 0 < min_dice <= 1:
        raise ValueError("min_dice must be above 0 and at most 1")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_dice)
        for batch in batches:
            rows = [(doc, page, *found) for doc, page, text in
                    zip(*(batch[c].to_pylist() for c in ("doc_id", "page_idx", "text")), strict=True)
                    for found in scanner.notices(text, inside)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                    (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.float64()))],
                ["doc_id", "page_idx", "license_id", "n_places", "best_dice"])

    return page_text.select("doc_id", "page_idx", "text").mapInArrow(
        scan, "doc_id long, page_idx int, license_id string, n_places long, best_dice double")


def normal_words(text: str) -> str:
    """Lower-case words of letters and digits with one space between."""
    return NO_WORD.sub(" ", text.lower()).strip()


class Scanner:
    """Bigrams of all templates, and the templates each is in."""

    def __init__(self, templates: list[tuple[str, str]], min_dice: float):
        self.min_dice = min_dice
        self.names, self.sizes = [], []
        self.bigrams: dict[tuple[str, str], dict[int, int]] = {}
        for name, text in templates:
            counts = Counter(pairwise(normal_words(text).split()))
            if counts:
                for bigram, n in counts.items():
                    self.bigrams.setdefault(bigram, {})[len(self.names)] = n
                self.names.append(name)
                self.sizes.append(counts.total())
        self.least = min(self.sizes, default=0) * min_dice / (2 - min_dice)
        self.most = max(self.sizes, default=0) * (2 - min_dice) / min_dice

    def notices(self, text: str | None, inside: bool = False) -> list[tuple[str, int, float]]:
        """(licence, places, best coefficient) of each licence found."""
        places, best = Counter(), {}
        spans: dict[str, list[tuple[int, int]]] = {}
        for start, passage in passages(text or ""):
            for name, dice in self.matches(passage).items():
                places[name] += 1
                best[name] = max(best.get(name, 0.0), dice)
                spans.setdefault(name, []).append((start, start + passage.count(" ") + 1))
        for name, new, dice in self.inner_places(text or "", spans) if inside else ():
            places[name] += new
            best[name] = max(best.get(name, 0.0), dice)
        return [(name, places[name], best[name]) for name in sorted(best)]

    def inner_places(self, text: str, spans: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[str, bool, float]]:
        """(licence, whether it is a new place, coefficient) of stretches apart from the spans of the licence's passages."""
        words = normal_words(text).split()
        known: dict[int, list[tuple[int, tuple[str, str]]]] = {}
        for at, bigram in enumerate(pairwise(words)):
            for template in self.bigrams.get(bigram, ()):
                known.setdefault(template, []).append((at, bigram))
        found: dict[str, list[tuple[int, float, int, int]]] = {}
        for template, there in known.items():
            for stretch in self.stretches(template, there):
                found.setdefault(self.names[template], []).append(stretch)
        for name, stretches in found.items():
            held = bytearray(len(words))  # 1: in a passage, 2: in a place
            for start, end in spans.get(name, ()):
                held[start:end] = b"\1" * (end - start)
            for _, dice, start, end in sorted(stretches, key=lambda s: (-s[0], -s[1], s[2])):
                if held.find(1, start, end) < 0:
                    new = held.find(2, start, end) < 0
                    if new:
                        held[start:end] = b"\2" * (end - start)
                    yield name, new, dice

    def stretches(self, template: int, there: list[tuple[int, tuple[str, str]]]) -> Iterator[tuple[int, float, int, int]]:
        """(shared bigrams, coefficient, first word, end) of the stretch from each bigram of a template that is
        nearest to it, if near enough."""
        size, known = self.sizes[template], self.bigrams
        least, most = size * self.min_dice / (2 - self.min_dice) - 1e-9, size * (2 - self.min_dice) / self.min_dice
        ahead: Counter[tuple[str, str]] = Counter()
        shared = end = 0  # what the longest stretch from here shares with the template
        for i, (start, first) in enumerate(there):
            while end < len(there) and there[end][0] < start + most:
                bigram = there[end][1]
                ahead[bigram] += 1
                shared += ahead[bigram] <= known[bigram][template]
                end += 1
            if shared >= least:
                seen: Counter[tuple[str, str]] = Counter()
                own, best = 0, (0.0, 0, 0)
                for at, bigram in there[i:end]:
                    seen[bigram] += 1
                    own += seen[bigram] <= known[bigram][template]
                    best = max(best, (2 * own / (at - start + 1 + size), own, at + 2))
                if best[0] >= self.min_dice:
                    yield best[1], best[0], start, best[2]
            shared -= ahead[first] <= known[first][template]
            ahead[first] -= 1

    def matches(self, passage: str) -> dict[str, float]:
        """Best coefficient for each licence of which a template is near enough."""
        size = passage.count(" ")
        if not passage or not self.least <= size <= self.most:
            return {}
        known = [b for b in pairwise(passage.split(" ")) if b in self.bigrams]
        if 2 * len(known) < self.min_dice * (size + min(self.sizes)):
            return {}
        shared: Counter[int] = Counter()
        for bigram, n in Counter(known).items():
            for template, there in self.bigrams[bigram].items():
                if self.fits(size, self.sizes[template]):
                    shared[template] += min(n, there)
        found: dict[str, float] = {}
        for template, n in shared.items():
            dice = 2 * n / (size + self.sizes[template])
            if dice >= self.min_dice:
                name = self.names[template]
                found[name] = max(found.get(name, 0.0), dice)
        return found

    def fits(self, size: int, other: int) -> bool:
        """Whether the coefficient can be large enough if all bigrams of the smaller are shared."""
        return 2 * min(size, other) >= self.min_dice * (size + other)


def passages(text: str) -> Iterator[tuple[int, str]]:
    """Normalised lines, blocks of several lines, and the whole text if it has several lines with words; before each
    the number of its first word in the text."""
    lines, first = [], 0
    for line in map(normal_words, LINE_END.split(text)):
        lines.append((first, line))
        first += line.count(" ") + 1 if line else 0
    yield from ((at, line) for at, line in lines if line)
    blocks, block = [], []
    for at, line in [*lines, (first, "")]:
        if line:
            block.append((at, line))
        elif block:
            blocks.append(block)
            block = []
    yield from ((b[0][0], " ".join(line for _, line in b)) for b in blocks if len(b) > 1)
    if len(blocks) > 1:
        yield 0, " ".join(line for _, line in lines if line)
