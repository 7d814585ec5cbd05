"""Licence scans by a generalised suffix automaton of licence tokens.

The automaton holds all word sequences of the templates and base phrases. A file's words
stream through it: at each word it gives the matching statistic, the longest run of
words ending there that occurs in any template. Long matches of one template that lie
near each other and in order are chained to a span; the share of the template that the
chain covers says whether the licence is present. Base phrases are found at every place,
from the state alone: a phrase ends where its own state lies on the state's suffix path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import small_batches, table

# Base phrases of the contract, and the words of common licence notices.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("all-rights-reserved", "all rights reserved"),
)
LEAST_MATCH, COVER, GAP = 3, 0.75, 8  # words of a match; share of a template; words between matches
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    """Words of the text, A-Z lower-cased, as UTF-8."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Automaton:
    """A generalised suffix automaton over word numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[tuple[int, int]] = [(-1, 0)]  # a template and where in it the state ends first
        for t, words in enumerate(sequences):
            last = 0
            for k, w in enumerate(words):
                last = self._extend(last, w, (t, k))

    def _add(self, size: int, link: int, step: dict[int, int], end: tuple[int, int]) -> int:
        self.next.append(step)
        self.link.append(link)
        self.size.append(size)
        self.ends.append(end)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._add(self.size[p] + 1, self.link[q], dict(self.next[q]), self.ends[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int, end: tuple[int, int]) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
        new = self._add(self.size[last] + 1, 0, {}, end)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        return new

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The state and matching statistic after one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.size[state]
        if (to := self.next[state].get(w)) is None:
            return 0, 0
        return to, length + 1

    def state_of(self, words: list[int]) -> int:
        state = 0
        for w in words:
            state = self.next[state][w]
        return state


@dataclass
class Found:
    n_words: int
    places: list[tuple[int, str]]  # start and label of each base phrase
    spans: list[tuple[int, int, str, float]]  # first word, last word, label, share of the template

    def labels(self) -> tuple[str, str]:
        base = {label for _, label in self.places}
        return ",".join(sorted(base)), ",".join(sorted(base | {s[2] for s in self.spans if s[3] >= COVER}))

    def score(self) -> float:
        """1 where a base phrase stands; else the best share that a chain covers."""
        return 1.0 if self.places else max((s[3] for s in self.spans), default=0.0)


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE):
        self.number: dict[bytes, int] = {}
        sequences = [[self.number.setdefault(w, len(self.number)) for w in words_of(t)] for t in [*(t for _, t in templates), *base]]
        self.templates = [(label, len(s)) for (label, _), s in zip(templates, sequences, strict=False)]
        self.sequences = [tuple(s) for s in sequences]
        self.automaton = a = Automaton(sequences)
        own = {a.state_of(s): (len(s), label) for s, label in zip(sequences[len(templates) :], base.values(), strict=True)}
        self.phrases: list[tuple[tuple[int, str], ...]] = []
        for v in range(len(a.next)):
            found, u = [], v
            while u > 0:
                if u in own:
                    found.append(own[u])
                u = a.link[u]
            self.phrases.append(tuple(found))
        # where in which templates each run of LEAST_MATCH words stands
        self.seeds: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for t in range(len(templates)):
            for k in range(len(sequences[t]) - LEAST_MATCH + 1):
                self.seeds.setdefault(self.sequences[t][k : k + LEAST_MATCH], []).append((t, k))

    def scan(self, text: str) -> Found:
        words = words_of(text)
        ids = list(map(self.number.get, words))
        places: list[tuple[int, str]] = []
        chains: list[list[int]] = []  # open chains: template, first word, last word, next place in template, covered
        spans: list[tuple[int, int, str, float]] = []
        at, n = 0, len(ids)
        step, phrases = self.automaton.step, self.phrases
        for at, end in self._runs(ids):
            state = length = 0
            matches: list[tuple[int, int]] = []
            for i in range(at, end):
                before = length
                state, length = step(state, length, ids[i])
                if before >= LEAST_MATCH and length <= before:
                    matches.append((i - before, i))
                for size, label in phrases[state]:
                    if length >= size:
                        places.append((i - size + 1, label))
            if length >= LEAST_MATCH:
                matches.append((end - length, end))
            for first, last in matches:
                self._chain(chains, spans, ids, first, last)
        spans += [self._span(c) for c in chains]
        return Found(n, places, spans)

    @staticmethod
    def _runs(ids: list) -> Iterator[tuple[int, int]]:
        """Runs of LEAST_MATCH licence words or more; other words can't match."""
        at, n = 0, len(ids)
        start = None
        for at in range(n + 1):
            if at < n and ids[at] is not None:
                if start is None:
                    start = at
            elif start is not None:
                if at - start >= LEAST_MATCH:
                    yield start, at
                start = None

    def _chain(self, chains: list, spans: list, ids: list, first: int, last: int) -> None:
        """Puts the match of words [first, last) on the chains of the templates that hold it."""
        spans += [self._span(c) for c in chains if first - c[2] > GAP]
        chains[:] = [c for c in chains if first - c[2] <= GAP]
        run = tuple(ids[first:last])
        for t, k in self.seeds.get(run[:LEAST_MATCH], ()):
            if self.sequences[t][k : k + len(run)] != run:
                continue
            for c in chains:
                if c[0] == t and c[3] <= k and c[2] <= first:
                    c[2], c[3], c[4] = last, k + len(run), c[4] + len(run)
                    break
            else:
                chains.append([t, first, last, k + len(run), len(run)])

    def _span(self, c: list[int]) -> tuple[int, int, str, float]:
        label, size = self.templates[c[0]]
        return c[1], c[2] - 1, label, min(1.0, c[4] / size)


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,last:long,label:string,cover:double>>"


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """keep and the columns of RESULT for each whole text; null counts as empty."""

    def results(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner = Scanner(templates, base)
        for b in batches:
            rows = []
            for text in b.column(b.num_columns - 1).to_pylist():
                f = scanner.scan(text or "")
                starts = [s for s, _ in f.places]
                rows.append((f.n_words, len(starts), min(starts, default=None), max(starts, default=None), *f.labels(), f.score(), [dict(zip(("first", "last", "label", "cover"), s, strict=True)) for s in sorted(f.spans) if s[3] >= COVER]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("cover", pa.float64())]))]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            if rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*b.schema.names[:-1], *names])

    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(results, f"{kept}, {RESULT}")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), ["doc_id"]).drop("spans")
