"""Licence scans: matching statistics of texts against a generalised suffix automaton of licence notices.

All notices go, word by word, into one suffix automaton. A text streams through it once: after each word the automaton
knows the longest stretch ending there that stands in some notice. Stretches that cannot be lengthened and are long
enough are anchors; anchors that follow one another both in the text and in a notice are chained, and a chain that
covers enough of the notice is a licence span. The short phrases of the contract are notices too, found by the same
statistics: a phrase ends where its state is a suffix of the current one. Documents are scanned in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, alnum_words, quoted, read_table

#: The contract's phrases with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Published licence notices, with the label that each stands for.
NOTICES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ),
    ("lgpl-3", "Licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "Licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Words of an anchor, words that a chain may skip on either side, share of a notice that a chain must cover.
ANCHOR = 3
GAP = 6
COVER = 0.7


@dataclass(frozen=True)
class Span:
    """Words ``first`` to ``last`` of the text carry ``label``, with this share of the notice covered."""

    first: int
    last: int
    label: str
    cover: float


class Licences:
    """The automaton of all notices and phrases, and the scan of one text."""

    def __init__(self, notices=NOTICES, phrases=PHRASES) -> None:
        self.vocabulary: dict[bytes, int] = {}
        number = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in alnum_words(text.encode())]
        self.notices = [(label, number(text)) for label, text in notices]
        self.phrases = [(label, number(text)) for text, label in phrases]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        #: For each state: where its stretch ends, as (notice, word).
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, words in enumerate([w for _, w in self.notices] + [w for _, w in self.phrases]):
            at = 0
            for i, w in enumerate(words):
                at = self._extend(at, w)
                if k < len(self.notices):
                    self.ends[at].append((k, i))
        order = sorted(range(1, len(self.link)), key=lambda v: -self.longest[v])
        for v in order:
            self.ends[self.link[v]].extend(self.ends[v])
        #: For each state: the phrases that end with it, as (phrase, words), those of its suffixes included.
        self.closing: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for k, (_, words) in enumerate(self.phrases):
            at = 0
            for w in words:
                at = self.next[at][w]
            self.closing[at].append((k, len(words)))
        for v in reversed(order):
            self.closing[v] = self.closing[v] + self.closing[self.link[v]]

    def _state(self, longest: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.longest.append(longest)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, above: int, w: int, at: int) -> int:
        """A copy of ``at`` for the shorter stretches that reach it over ``w`` from ``above`` and its suffixes."""
        twin = self._state(self.longest[above] + 1)
        self.next[twin] = dict(self.next[at])
        self.link[twin] = self.link[at]
        self.link[at] = twin
        while above >= 0 and self.next[above].get(w) == at:
            self.next[above][w] = twin
            above = self.link[above]
        return twin

    def _extend(self, last: int, w: int) -> int:
        """The state of the current notice's stretch after ``w``; ``last`` is the state before it."""
        if w in self.next[last]:
            at = self.next[last][w]
            return at if self.longest[at] == self.longest[last] + 1 else self._split(last, w, at)
        new, v = self._state(self.longest[last] + 1), last
        while v >= 0 and w not in self.next[v]:
            self.next[v][w] = new
            v = self.link[v]
        if v < 0:
            self.link[new] = 0
        else:
            at = self.next[v][w]
            self.link[new] = at if self.longest[at] == self.longest[v] + 1 else self._split(v, w, at)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest stretch in any notice that ends at each word; words below 0 are in none."""
        at = size = 0
        for w in words:
            if w < 0:
                at = size = 0
            else:
                while at and w not in self.next[at]:
                    at = self.link[at]
                    size = self.longest[at]
                if w in self.next[at]:
                    at, size = self.next[at][w], size + 1
                else:
                    size = 0
            yield at, size

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[Span]]:
        """Number of words; places of phrases as (first word, phrase); licence spans in order of their first word."""
        words = alnum_words(text)
        n = len(words)
        if n < ANCHOR:
            return n, [], []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, n)
        # A stretch breaks at a word of no notice, so only runs of notice words can hold an anchor or a phrase.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
        begin, stop = edge[::2], edge[1::2]
        long = stop - begin >= ANCHOR
        places: list[tuple[int, int]] = []
        anchors: list[tuple[int, int, int]] = []
        for lo, hi in zip(begin[long].tolist(), stop[long].tolist()):
            before = (0, 0)
            for i, now in enumerate(self.statistics(ids[lo:hi].tolist()), lo):
                at, size = now
                if size >= ANCHOR:
                    places += [(i - length + 1, k) for k, length in self.closing[at] if length <= size]
                if before[1] >= ANCHOR and size != before[1] + 1:
                    anchors.append((i - 1, *before))
                before = now
            if before[1] >= ANCHOR:
                anchors.append((hi - 1, *before))
        return n, places, self._chains(anchors)

    def _chains(self, anchors: list[tuple[int, int, int]]) -> list[Span]:
        """Chains per notice, greedily from left to right; overlapping spans of one label merge."""
        open_: dict[int, list[int]] = {}
        spans: list[Span] = []

        def close(k: int) -> None:
            first, last, _, covered = open_.pop(k)
            share = covered / len(self.notices[k][1])
            if share >= COVER:
                spans.append(Span(first, last, self.notices[k][0], min(1.0, share)))

        for end, state, size in anchors:
            first = end - size + 1
            for k in [k for k, c in open_.items() if first - c[1] > GAP + 1]:
                close(k)
            for k, ends in self._by_notice(state).items():
                chain = open_.get(k)
                if chain:
                    # The next place in the notice after the chain's, overlapping it or within the gap.
                    nearest = [e for e in ends if e > chain[2] and e - size - chain[2] <= GAP and first > chain[0]]
                    if nearest:
                        e = min(nearest)
                        fresh = min(size, end - chain[1], e - chain[2])
                        open_[k] = [chain[0], end, e, chain[3] + max(0, fresh)]
                        continue
                    if size <= chain[3]:
                        continue
                    close(k)
                open_[k] = [first, end, min(ends), size]
        for k in list(open_):
            close(k)
        return self._merged(spans)

    def _by_notice(self, state: int) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for k, i in self.ends[state]:
            out.setdefault(k, []).append(i)
        return out

    @staticmethod
    def _merged(spans: list[Span]) -> list[Span]:
        out: list[Span] = []
        for s in sorted(spans, key=lambda s: (s.label, s.first, s.last)):
            if out and out[-1].label == s.label and s.first <= out[-1].last:
                o = out.pop()
                s = Span(o.first, max(o.last, s.last), s.label, max(o.cover, s.cover))
            out.append(s)
        return sorted(out, key=lambda s: (s.first, s.last, s.label))


_SCAN = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "score double, spans array<struct<first:long,last:long,label:string,cover:double>>"
)


def scan_column(notices=NOTICES, phrases=PHRASES):
    """Arrow function of a binary text column: words, phrase places, labels, best cover and licence spans."""

    @F.arrow_udf(_SCAN)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Licences(notices, phrases)
        span = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("cover", pa.float64())])
        whole = pa.int64()
        kind = pa.struct(
            [("n_words", whole), ("n_base", whole), ("first_word", whole), ("last_word", whole), ("base_labels", pa.list_(pa.string())),
             ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("spans", pa.list_(span))]
        )
        for batch in texts:
            rows = []
            for at in range(0, len(batch), SLICE_ROWS):
                for text in batch.slice(at, SLICE_ROWS).to_pylist():
                    n, places, spans = known.scan(text)
                    starts = [p for p, _ in places]
                    base = sorted({known.phrases[k][0] for _, k in places})
                    rows.append({
                        "n_words": n, "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                        "base_labels": base, "labels": sorted({*base, *(s.label for s in spans)}),
                        "score": max((s.cover for s in spans), default=COVER if base else 0.0), "spans": [vars(s) for s in spans],
                    })
            yield pa.array(rows, kind)

    return scan


def scanned(docs: DataFrame, text_col: str = "text", out: str = "__licence") -> DataFrame:
    """``docs`` with ``out``: the scan of each row's whole text. A null text has no words; rows are independent."""
    return docs.withColumn(out, scan_column()(F.col(quoted(text_col)).cast("binary")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: phrase places and licence labels of every document."""
    x = F.col("__licence")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scanned(docs).select(
        "doc_id", x["n_words"].alias("n_words"), x["n_base"].alias("n_base"), x["first_word"].alias("first_word"), x["last_word"].alias("last_word"),
        F.array_join(x["base_labels"], ",").alias("base_labels"), F.array_join(x["labels"], ",").alias("labels"), x["score"].alias("score"),
    )
