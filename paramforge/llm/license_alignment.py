"""Licence scan by patience alignment.

Text and template are word lists. Words that occur exactly once in both are
anchors; the longest increasing subsequence of their places is kept, and
each gap between kept anchors is aligned in the same way, down to gaps
without an anchor, whose equal words at both ends are still matched. The
coverage of a template is the share of its words that are aligned.

A text may hold a notice many times and anywhere, so the whole text is first
cut into places: runs of template words with at most ``max_gap`` other words
between them, cut again where the place in the template falls back (the next
copy begins). Places only seed: those that hold three template words in a
row are joined, over any distance, as long as their places in the template
do not fall back, and aligned as one stretch. A place or stretch whose words
cannot reach the coverage even without regard to order is not aligned; this
is exact. Templates are a parameter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Short notices and openings of public licence texts.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}


@dataclass(frozen=True)
class Params:
    coverage: float = 0.8
    max_gap: int = 8  # other words inside a place; places are joined over any gap


EDGES = re.compile(r"^\W+|\W+$")


def normal(word: str) -> str:
    """Lower case, without punctuation at the ends."""
    word = word.lower()
    return word if word.isalnum() else EDGES.sub("", word)


def word_list(text: str | None) -> list[str]:
    return [w for x in re.findall(r"[^ \t-\r]+", text or "") if (w := normal(x))]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of (text place, template place), sorted by text
    place, whose template places increase (patience piles)."""
    tops: list[int] = []
    pile: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        before.append(pile[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            pile.append(k)
        else:
            tops[at], pile[at] = b, k
    out, k = [], pile[-1] if pile else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b), both increasing; gaps wait on a stack."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = increasing([(i, place[a[i]]) for i in range(a0, a1) if a[i] in place and in_a[a[i]] == 1])
        if not anchors:
            continue
        out.extend(anchors)
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            gaps.append((i + 1, k, j + 1, m))
    return sorted(out)


def places(words: list[str], hits: list[int], template: list[str], max_gap: int) -> Iterator[tuple[int, int]]:
    """[start, end) of the runs of template words, one for each copy."""
    once = {w: k for k, w in enumerate(template) if template.count(w) == 1}
    half = len(template) / 2
    start = last = None
    far = -1
    for at in hits:
        k = once.get(words[at])
        if start is not None and (at - last > max_gap + 1 or (k is not None and far - k > half)):
            yield start, last + 1
            start = None
        if start is None:
            start, far = at, -1
        if k is not None:
            far = max(far, k)
        last = at
    if start is not None:
        yield start, last + 1


def copies(words: list[str], seeds: list[tuple[int, int]], template: list[str]) -> Iterator[list[tuple[int, int]]]:
    """The seeds of one copy each: a copy ends where the template falls back."""
    once = {w: k for k, w in enumerate(template) if template.count(w) == 1}
    group, far = [], -1
    for start, end in seeds:
        at = [once[w] for w in words[start:end] if w in once]
        if group and at and far - at[0] > len(template) / 2:
            yield group
            group, far = [], -1
        group.append((start, end))
        far = max([far, *at])
    if group:
        yield group


class Scanner:
    def __init__(self, templates: dict[str, str], p: Params):
        self.p = p
        self.templates = [(name, w, Counter(w), set(w)) for name, text in sorted(templates.items()) if (w := word_list(text))]
        self.vocabulary = set().union(*(s for *_, s in self.templates)) if self.templates else set()
        self.normal: dict[bytes, str] = {}

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, aligned words, start word, end word) of every
        place that reaches the coverage, in order of start, then template."""
        raw = (text or "").encode("utf-8", "surrogatepass").split()
        if len(self.normal) > 500_000:
            self.normal.clear()
        known, words = self.normal, []
        for x in raw:
            w = known.get(x)
            if w is None:
                w = normal(x.decode("utf-8", "surrogatepass"))
                w = known[x] = w if w in self.vocabulary else ("\0" if w else "")
            words.append(w)
        words = [w for w in words if w]  # a run of punctuation is no word
        hits = [i for i, w in enumerate(words) if w != "\0"]
        found = []
        present = set(words)
        for name, template, count, vocabulary in self.templates:
            need = self.p.coverage * len(template) - 1e-9
            if sum(n for w, n in count.items() if w in present) < need:
                continue
            found.extend((name, len(got) / len(template), len(got), got[0][0], got[-1][0] + 1) for got in self.notices(words, [i for i in hits if words[i] in vocabulary], template, count, need))
        return sorted(found, key=lambda f: (f[3], f[0]))

    def notices(self, words: list[str], hits: list[int], template: list[str], count: Counter, need: float) -> Iterator[list[tuple[int, int]]]:
        """The alignments, (place in words, place in template), that reach the need."""

        def aligned(start: int, end: int) -> list[tuple[int, int]]:
            return [(start + i, j) for i, j in align(words[start:end], template)]

        def can(start: int, end: int) -> bool:
            return sum((Counter(words[start:end]) & count).values()) >= need

        def joined(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
            start, end = seeds[0][0], seeds[-1][1]
            if len(seeds) < 2 or not can(start, end):
                return []
            return max(increasing([x for s in seeds for x in aligned(*s)]), aligned(start, end), key=len)

        threes = set(zip(template, template[1:], template[2:]))  # noqa: B905
        whole, seeds = {}, []
        for start, end in places(words, hits, template, self.p.max_gap):
            if can(start, end) and len(got := aligned(start, end)) >= need:
                whole[start, end] = got
            if (start, end) in whole or any(tuple(words[i : i + 3]) in threes for i in range(start, end - 2)):
                seeds.append((start, end))
        left: list[tuple[int, int]] = []  # seeds of successive copies that did not reach it
        for group in [*copies(words, seeds, template), []]:
            own = [whole[s] for s in group if s in whole]
            if len(own) < 2 and len(got := joined(group) if group else []) >= need:
                own = [max([got, *own], key=len)]
            if group and not own:
                left += group
                continue
            # words inside a gap can look like the next copy
            if left and len(got := joined(left)) >= need:
                yield got
            left = []
            yield from own


def licences(docs: DataFrame, templates: dict[str, str] | None = None, params: Params = Params()) -> DataFrame:
    """doc_id, licence, coverage, start_word, end_word, n_found, found for
    every row of ``docs`` (doc_id, text).

    ``found`` lists all places; the other columns are those of the best
    (highest coverage, then longest, then first) or null. Word numbers do
    not count runs of punctuation. A null or empty text has no licence.
    """
    given = TEMPLATES if templates is None else templates
    kind = "array<struct<licence string, coverage double, aligned int, start_word int, end_word int>>"
    item = pa.struct([("licence", pa.string()), ("coverage", pa.float64()), ("aligned", pa.int32()), ("start_word", pa.int32()), ("end_word", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, params)
        names = ["licence", "coverage", "aligned", "start_word", "end_word"]
        for batch in batches:
            rows = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            best = [max(r, key=lambda f: (f[1], f[2], -f[3])) if r else (None,) * 5 for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array([b[3] for b in best], pa.int32()), pa.array([b[4] for b in best], pa.int32()),
                    pa.array([len(r) for r in rows], pa.int32()), pa.array([[dict(zip(names, f, strict=True)) for f in r] for r in rows], pa.list_(item)),
                ],
                ["doc_id", "licence", "coverage", "start_word", "end_word", "n_found", "found"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, licence string, coverage double, start_word int, end_word int, n_found int, found {kind}")
