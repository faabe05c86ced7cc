"""License scan by a generalised suffix automaton of licence tokens.

All templates (short phrases and notices) go into one suffix automaton over word numbers. A
text's words are streamed through it, which gives matching statistics: the length of the
longest template part that ends at each word. Runs of matches are chained while they follow
each other closely; a chain's matches, laid over their template, cover spans of it. A template
is found where a chain covers at least COVER of it, or all of it if it has under SHORT words, as a few of its words
are said elsewhere too. Where templates of different labels are found in overlapping places (licences quote
each other's wording), the one with the most covered words holds. Phrases are templates of their own: a
state knows the phrases that its strings end with, which gives every place of a phrase.

Only words that begin a word pair of some template can take part in a match of two words or more, so
the automaton is stepped over those runs alone; it would be at its root elsewhere.

Defined cases: null and empty texts have 0 words, no place, empty labels and score 0; very long
texts are streamed whole; repeated rows and null doc_ids give a row each; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import LETTERS, Words, row_groups, table, text_buffers

#: Phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Openings of public licence notices, with their labels.
NOTICES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("mit", "Released under the MIT License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("bsl", "Distributed under the Boost Software License, Version 1.0."),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]
#: A chain's matches are at most GAP words apart and at least LEAST words long; it must cover this share of a template of SHORT words or more.
GAP, LEAST, COVER, SHORT = 8, 3, 0.6, 20


class Automaton:
    """Generalised suffix automaton over sequences of numbers."""

    def __init__(self, sequences: list[list[int]], marked: list[int]):
        """marked: indices of sequences whose every place is to be reported."""
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.where: list[dict[int, int]] = [{}]  # sequence -> an end of this state's strings in it
        self.size = [len(s) for s in sequences]
        for k, s in enumerate(sequences):
            last = 0
            for x in s:
                last = self._extend(last, x)
            state = 0
            for end, x in enumerate(s, 1):
                state = self.next[state][x]
                at = state
                while at > 0 and k not in self.where[at]:
                    self.where[at][k] = end
                    at = self.link[at]
        self.ends: list[list[int]] = [[] for _ in self.link]
        own: dict[int, list[int]] = {}
        for k in marked:
            state = 0
            for x in sequences[k]:
                state = self.next[state][x]
            own.setdefault(state, []).append(k)
        for state in sorted(range(1, len(self.link)), key=self.len.__getitem__):
            self.ends[state] = self.ends[self.link[state]] + own.get(state, [])

    def _new(self, length: int, link: int, follow: dict) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.len.append(length)
        self.where.append({})
        return len(self.len) - 1

    def _split(self, p: int, x: int, q: int) -> int:
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.where[clone] = dict(self.where[q])
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            q = self.next[last][x]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, x, q)
        new, p = self._new(self.len[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, x, q)
        return new

    def stream(self, xs):
        """(state, length) after each number: the longest part of a sequence that ends there."""
        state = length = 0
        for x in xs:
            while state and x not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if x in self.next[state]:
                state = self.next[state][x]
                length += 1
            yield state, length


def chained(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Chains of one template's matches (end in the text, begin and end in the template), as begin and end in the text, and covered words."""
    out: list[tuple[int, int, int]] = []
    spans: list[tuple[int, int]] = []
    first = last = None

    def close():
        covered = reach = 0
        for s, t in sorted(spans):
            covered += max(0, t - max(s, reach))
            reach = max(reach, t)
        out.append((first, last, covered))

    for end, x, y in matches:
        begin = end - (y - x)
        if spans and begin - last > GAP:
            close()
            spans, first = [], None
        first = begin if first is None else min(first, begin)
        spans.append((x, y))
        last = end
    if spans:
        close()
    return out


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES):
        texts = [*phrases, *(t for _, t in notices)]
        self.labels = [*phrases.values(), *(k for k, _ in notices)]
        self.phrases = len(phrases)
        data, offsets = text_buffers(pa.array(texts))
        w = Words(data, offsets, LETTERS)
        self.vocabulary = np.unique(w.hash)
        ids = np.searchsorted(self.vocabulary, w.hash)
        sequences = [ids[w.first[r] : w.first[r + 1]].tolist() for r in range(len(texts))]
        self.sizes = [len(s) for s in sequences]
        self.least = [n if n < SHORT else COVER * n for n in self.sizes]
        if min(self.sizes) < 2:
            raise ValueError("a phrase or notice needs two words at least")
        self.pairs = np.unique([a * len(self.vocabulary) + b for s in sequences for a, b in zip(s, s[1:], strict=False)])
        self.automaton = Automaton(sequences, list(range(self.phrases)))

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """For each text: n_words, n_base, first_word, last_word, base_labels, labels, score."""
        for lo, hi in row_groups(offsets):
            w = Words(data, offsets[lo : hi + 1], LETTERS)
            n = len(self.vocabulary)
            ids = np.minimum(np.searchsorted(self.vocabulary, w.hash), n - 1)
            ids = np.where(self.vocabulary[ids] == w.hash, ids, -1)
            pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * n + ids[1:], -1)
            known = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
            inner = w.first[1:-1]
            known[inner[(inner > 0) & (inner <= len(known))] - 1] = False  # pairs never cross texts
            edge = np.diff(np.concatenate(([0], known.astype(np.int8), [0])))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1  # runs of words [begin, end)
            owner = np.searchsorted(w.first, begin, "right") - 1
            runs: dict[int, list[tuple[int, list[int]]]] = {}
            for r, b, e in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True):
                runs.setdefault(r, []).append((b - int(w.first[r]), ids[b:e].tolist()))
            for r in range(hi - lo):
                yield (int(w.first[r + 1] - w.first[r]), *self.found(runs.get(r, [])))

    def found(self, runs: list[tuple[int, list[int]]]) -> tuple:
        places, base, labels, best = [], set(), set(), 0.0
        matches: dict[int, list[tuple[int, int, int]]] = {}  # template -> (end in text, begin and end in it)
        a = self.automaton
        for at, xs in runs:
            steps = list(a.stream(xs))
            for i, (state, length) in enumerate(steps):
                for k in a.ends[state]:
                    if self.sizes[k] <= length:
                        places.append(at + i + 1 - self.sizes[k])
                        base.add(self.labels[k])
                if length >= LEAST and (i + 1 == len(steps) or steps[i + 1][1] <= length):  # maximal
                    for k, end in a.where[state].items():
                        matches.setdefault(k, []).append((at + i + 1, end - length, end))
        chains: list[tuple[int, int, int, str]] = []  # covered words, begin and end in the text, label
        for k, found in matches.items():
            if k < self.phrases:
                continue
            for begin, end, covered in chained(found):
                if covered >= self.least[k]:
                    chains.append((covered, begin, end, self.labels[k]))
                if covered == self.sizes[k] or self.sizes[k] >= SHORT:
                    best = max(best, covered / self.sizes[k])
        chains.sort(key=lambda c: (-c[0], c[1:]))
        held: list[tuple[int, int, str]] = []
        for _, begin, end, label in chains:
            if all(label == other or end <= b or e <= begin for b, e, other in held):
                held.append((begin, end, label))
                labels.add(label)
        return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else best


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    def run(batches):
        scanner = Scanner(phrases, notices)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = list(scanner.scan(*text_buffers(batch.column(1))))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
