"""License scans with a generalised suffix automaton over the words of license templates.

The automaton holds every run of consecutive words of every template. A file is streamed through it word by word: its state is the
longest run that ends at the word and stands in some template (the matching statistics). Runs of at least `least_run` words are
anchors; anchors of the same template that stand in the same order in file and template, with at most `gap` words between, are
chained, and a chain that covers at least `cover` of the template's words labels the file with its license. Fixed phrases are found
apart, as consecutive words, and always keep their labels.

The templates are a parameter and small (hundreds of words), so the automaton is built in each worker; files are mapped in place, no
shuffle, and memory is one file's words.

Defined results: a null or empty text has no words and score 0; rows with equal or null doc_id are scanned each on its own; an empty
table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.common import slices

#: Phrases whose words, standing consecutively, name a license (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Public license notices (fixed values): (label, text).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]
#: A-Z lowered; bytes that are neither digit, letter nor part of a non-ASCII character become blanks.
_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """Every run of consecutive words of several sequences; each state remembers where one of its runs ends in each template."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((t, place))
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[s]] |= self.ends[s]

    def _new(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state of exactly p's longest run and the word: what p leads to, or a copy of it cut to that length."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, word)
        return state

    def longest(self, sequence: list[bytes], at: int):
        """From word `at` on, (place, state, length) of the longest run ending at each word, until none does."""
        state, n = 0, 0
        for i in range(at, len(sequence)):
            while state and sequence[i] not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if sequence[i] not in self.next[state]:
                return
            state, n = self.next[state][sequence[i]], n + 1
            yield i, state, n


class Scanner:
    def __init__(self, templates=None, phrases=None, least_run: int = 3, gap: int = 8, cover: float = 0.6):
        templates, phrases = templates or TEMPLATES, phrases or PHRASES
        self.labels = [label for label, _ in templates]
        self.sizes = [len(words(t)) for _, t in templates]
        self.automaton = SuffixAutomaton([words(t) for _, t in templates])
        self.known = self.automaton.next[0].keys()
        self.base = [(words(p), label) for p, label in phrases.items()]
        self.firsts = {p[0] for p, _ in self.base}
        self.least_run, self.gap, self.cover = least_run, gap, cover

    def anchors(self, text: list[bytes], starts: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, state) of runs that cannot be longer to either side, of `least_run` words or more."""
        out, done = [], -1
        for at in starts:
            if at <= done:
                continue
            run, i = None, at
            for i, state, n in self.automaton.longest(text, at):  # noqa: B007
                if run and n <= run[1] - run[0]:  # the run before this word could not be prolonged
                    if run[1] - run[0] >= self.least_run:
                        out.append(run)
                run = (i + 1 - n, i + 1, state)
            if run and run[1] - run[0] >= self.least_run:
                out.append(run)
            done = i
        return out

    def chains(self, anchors: list[tuple[int, int, int]]) -> dict[int, tuple[float, int, int]]:
        """Best chain for each template: (share of its words covered, start, end in the file)."""
        open_: dict[int, list[tuple[int, int, int, int]]] = {}
        best: dict[int, tuple[float, int, int]] = {}
        for lo, hi, state in anchors:
            for t, last in self.automaton.ends[state]:
                n = hi - lo
                first = last + 1 - n
                covered, start = n, lo
                alive = [c for c in open_.get(t, []) if lo - c[1] <= self.gap]
                for c_cov, c_hi, c_last, c_start in alive:
                    fresh = n - max(0, c_hi - lo, c_last + 1 - first)
                    if c_last < last and fresh > 0 and first - c_last - 1 <= self.gap and c_cov + fresh > covered:
                        covered, start = c_cov + fresh, c_start
                open_[t] = [*alive, (covered, hi, last, start)]
                best[t] = max(best.get(t, (0.0, 0, 0)), (min(1.0, covered / self.sizes[t]), start, hi))
        return best

    def scan(self, text: str) -> dict:
        """n_words, base places (start, label), spans {template: (share, start, end)}, labels and score of a text."""
        seq = words(text)
        known, firsts = self.known, self.firsts
        starts = [i for i, w in enumerate(seq) if w in known or w in firsts]
        base = [(i, label) for i in starts if seq[i] in firsts for phrase, label in self.base if seq[i : i + len(phrase)] == phrase]
        spans = {t: c for t, c in self.chains(self.anchors(seq, starts)).items() if c[0] >= self.cover} if len(starts) >= self.least_run else {}
        found = {label for _, label in base}
        score = max([1.0 if base else 0.0, *(c[0] for c in spans.values())])
        return {"n_words": len(seq), "base": base, "spans": spans, "base_labels": sorted(found), "labels": sorted(found | {self.labels[t] for t in spans}), "score": score}



def scan(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row; options as for Scanner."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]

    def run(batches):
        scanner = Scanner(**options)
        for b in slices(batches):
            rows = []
            for t in b.column("text").to_pylist():
                r = scanner.scan(t or "")
                starts = [i for i, _ in r["base"]]
                spans = ",".join(f"{scanner.labels[t]}:{lo}-{hi}" for t, (_, lo, hi) in sorted(r["spans"].items(), key=lambda x: (x[1][1], x[0])))
                rows.append((r["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(r["base_labels"]), ",".join(r["labels"]), r["score"], spans))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *fields])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
