"""Licence passages by a generalised suffix automaton of template words.

All templates (full notices, one-line statements, short phrases) are put into one suffix automaton over words. A text is
streamed through it: at each word the automaton knows the longest run of words, ending there, that stands in some
template (the matching statistics). Runs that cannot be extended are the matches of a template; matches that follow each
other in text and template, with small gaps, are chained, and a chain that covers enough of its template is a span.
Phrases count wherever they stand whole.

The templates are a fixed public list, so the automaton has a bounded size and travels with the code; texts are not moved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.llm import words


class Template(NamedTuple):
    label: str
    text: str
    #: A phrase counts at every place where it stands whole; a template counts by the share that chains cover.
    phrase: bool = False


# Phrases and labels of the base columns.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)

# Public licence notices as their licences give them.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("mit", "Released under the MIT License"),
)

#: Words that a match has at least.
LEAST_MATCH = 3
#: Words that may lie between two matches of a chain, in the text and in the template.
MOST_GAP = 12
#: Share of a template that a chain has to cover.
LEAST_SHARE = 0.6

_SPAN = "struct<label:string,phrase:boolean,first:long,end:long,share:double>"


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    lower = words.LOWER[data]
    starts, ends, bounds = words.cut(lower, offsets, words.ALNUM)
    return lower, starts, ends, bounds


class Automaton:
    """States of the generalised suffix automaton, with the template places of every state."""

    def __init__(self, templates: Sequence[Template], least: int = LEAST_MATCH):
        self.templates, self.least = tuple(templates), least
        texts = [np.frombuffer(t.text.encode(), np.uint8) for t in self.templates]
        self.words: list[list[bytes]] = []
        for raw in texts:
            lower, starts, ends, _ = _cut(raw, np.array([0, len(raw)]))
            self.words.append([lower[s:e].tobytes() for s, e in zip(starts, ends)])
        if any(len(w) < 2 for w in self.words):
            raise ValueError("a template has two words at least")
        self.code = {w: k for k, w in enumerate(dict.fromkeys(w for ws in self.words for w in ws))}
        self.coded = [[self.code[w] for w in ws] for ws in self.words]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        places: list[set[tuple[int, int]]] = [set()]
        for t, coded in enumerate(self.coded):
            last = 0
            for k, c in enumerate(coded):
                last = self._extend(last, c, places)
                places[last].add((t, k))
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            places[self.link[s]] |= places[s]
        self._places = places
        whole = {}
        for t, coded in enumerate(self.coded):
            if self.templates[t].phrase:
                s = 0
                for c in coded:
                    s = self.next[s][c]
                whole.setdefault(s, []).append(t)
        #: Phrases that end in a state or in one of its suffixes, with their lengths.
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for s in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.phrases[s] = self.phrases[self.link[s]] + [(t, len(self.coded[t])) for t in whole.get(s, [])]

    def _extend(self, last: int, c: int, places: list) -> int:
        def state(length: int, follow: dict, link: int) -> int:
            self.next.append(follow)
            self.length.append(length)
            self.link.append(link)
            places.append(set())
            return len(self.link) - 1

        def split(p: int, q: int) -> int:
            clone = state(self.length[p] + 1, dict(self.next[q]), self.link[q])
            self.link[q] = clone
            while p >= 0 and self.next[p].get(c) == q:
                self.next[p][c] = clone
                p = self.link[p]
            return clone

        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else split(last, q)
        new, p = state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else split(p, q)
        return new

    @cached_property
    def reach(self) -> list[list[tuple[int, int, int]]]:
        """Per state (template, place of the last word, words that agree at least), for places that agree in ``least`` words or more."""
        out = []
        for s in range(len(self.link)):
            best: dict[tuple[int, int], int] = {}
            while s > 0 and self.length[s] >= self.least:
                for place in self._places[s]:
                    if not self.templates[place[0]].phrase:
                        best.setdefault(place, self.length[s])
                s = self.link[s]
            out.append([(t, k, n) for (t, k), n in best.items()])
        return out

    @cached_property
    def pairs(self) -> np.ndarray:
        """Sorted hashes of the word pairs of all templates: a match of two words or more consists of such pairs."""
        out = []
        for ws in self.words:
            raw = np.frombuffer(b" ".join(ws), np.uint8)
            _, starts, ends, _ = _cut(raw, np.array([0, len(raw)]))
            out.append(words.rolling_hashes(words.hashes(raw, starts, ends), 2))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)

    def statistics(self, coded: Sequence[int]) -> Iterator[tuple[int, int]]:
        """State and matched length after each word."""
        state = length = 0
        for c in coded:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if (q := self.next[state].get(c)) is not None:
                state, length = q, length + 1
            yield state, length

    def matches(self, coded: Sequence[int], at: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """(phrase, first word) of whole phrases, and (template, first word, place in it, words) of matches that cannot be extended; ``at`` is the first word's number."""
        phrases, found = [], []
        for i, (state, length) in enumerate(self.statistics(coded)):
            phrases += [(t, at + i - n + 1) for t, n in self.phrases[state] if n <= length]
            if length < self.least:
                continue
            follow = coded[i + 1] if i + 1 < len(coded) else -1
            for t, k, n in self.reach[state]:
                if k + 1 == len(self.coded[t]) or self.coded[t][k + 1] != follow:
                    n = min(n, length)
                    found.append((t, at + i - n + 1, k - n + 1, n))
        return phrases, found


def chains(found: list[tuple[int, int, int, int]], size: int, gap: int = MOST_GAP) -> list[tuple[int, int, int]]:
    """(first word, end, covered words) of disjoint chains of one template's matches, the best covering first."""
    found = sorted(set(found), key=lambda m: (m[1], m[2]))
    best: list[tuple[int, int]] = []  # covered words, first word
    low = 0
    for i, (_, doc, place, n) in enumerate(found):
        covered, first = n, doc
        while found[low][1] + size + gap < doc:
            low += 1
        for j in range(low, i):
            _, doc_j, place_j, n_j = found[j]
            over = max(0, doc_j + n_j - doc, place_j + n_j - place)
            if doc_j < doc and place_j < place and over < n and doc - doc_j - n_j <= gap and place - place_j - n_j <= gap:
                if best[j][0] + n - over > covered:
                    covered, first = best[j][0] + n - over, best[j][1]
        best.append((covered, first))
    taken: list[tuple[int, int, int]] = []
    spans = sorted(((c, -f, doc + n) for (c, f), (_, doc, _, n) in zip(best, found)), reverse=True)
    ends: dict[int, int] = {}
    for covered, minus, end in spans:
        first = -minus
        blocks = range(first // size, (end - 1) // size + 1)
        if not any(f < end and first < e for b in blocks for f, e in ends.get(b, [])):
            for b in blocks:
                ends.setdefault(b, []).append((first, end))
            taken.append((first, end, covered))
    return taken


def scan(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES), least: int = LEAST_MATCH, gap: int = MOST_GAP, share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, n_words and ``spans`` (label, phrase, first word, end, share of the template) of every document.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters, numbered from 0. Spans are in order of
    their first word. Null and empty texts have no words and no spans; null ids and repeated rows are kept as they are;
    further columns are left out; an empty table gives an empty table. Without templates there are no spans.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    automaton = Automaton(templates, least)
    n_templates = len(automaton.templates)

    def spans_of(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, runs: list[tuple[int, int]]) -> list[dict]:
        out, found = [], [[] for _ in range(n_templates)]
        for low, high in runs:
            coded = [automaton.code.get(text[s:e].tobytes(), -1) for s, e in zip(starts[low:high], ends[low:high])]
            phrases, matched = automaton.matches(coded, low)
            for t, first in phrases:
                out.append({"label": automaton.templates[t].label, "phrase": True, "first": first, "end": first + len(automaton.coded[t]), "share": 1.0})
            for m in matched:
                found[m[0]].append(m)
        for t, matched in enumerate(found):
            size = len(automaton.coded[t])
            for first, end, covered in chains(matched, size, gap) if matched else []:
                if covered >= share * size:
                    out.append({"label": automaton.templates[t].label, "phrase": False, "first": first, "end": end, "share": covered / size})
        return sorted(out, key=lambda s: (s["first"], s["end"], s["label"], s["phrase"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.flat(batch.column("text"))
            for low, high in words.slices(offsets):
                text, starts, ends, bounds = _cut(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                two = words.rolling_hashes(words.hashes(text, starts, ends), 2)
                known = np.zeros(len(starts), bool)
                known[: len(two)] = np.isin(two, automaton.pairs)
                inner = bounds[1:-1]
                known[inner[inner > 0] - 1] = False  # pairs across documents
                first, end = words.runs_of(known)
                of = np.searchsorted(bounds, first, "right") - 1
                edges = np.searchsorted(of, np.arange(high - low + 1))
                spans = []
                for d in range(high - low):
                    a, b = int(bounds[d]), int(bounds[d + 1])
                    runs = [(int(first[r]) - a, int(end[r]) + 1 - a) for r in range(edges[d], edges[d + 1])]
                    spans.append(spans_of(text, starts[a:b], ends[a:b], runs) if runs else [])
                kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
                yield pa.record_batch([batch.column("doc_id").slice(low, high - low), pa.array(np.diff(bounds), pa.int64()), pa.array(spans, kind)], ["doc_id", "n_words", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, spans array<{_SPAN}>")


def digest(scanned: DataFrame) -> DataFrame:
    """One row a document: places of the phrases, their first and last, labels of phrases and of all spans, and the largest share of a template."""
    base = F.filter("spans", lambda s: s["phrase"])
    at = F.transform(base, lambda s: s["first"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
