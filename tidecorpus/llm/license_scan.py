"""Licence scan with a generalised suffix automaton of licence words.

The automaton holds every template (a licence notice or phrase) as a sequence
of words. A document's words stream through it once; at each word the matching
statistic is the length of the longest run of words, ending there, that occurs
in any template. Maximal runs of at least ``min_run`` words are laid on the
templates that contain them, and so is each whole template inside a longer run of
another; they are chained in order (later in the text and later in the
template, at most two template lengths on) by dynamic programming, so that a stray
run never hides a chain that covers more; a template is found where a chain covers
at least ``coverage`` of its words, and its spans don't overlap. Text words between two
runs of a chain count against it (twice for short notices), and a chain must hold the
template's numbers and variant words (NC, SA, Lesser, ...) and step over no other variant
word, so a licence earns no label of its sisters. Of overlapping spans of several labels
whole notices stay, else the best covered. Base phrases are short templates that must match whole; their ends
are marked on the automaton's states, so all places are found in the same pass.

``score`` is the largest share of a template's words that one such chain covers, less
its stray words (1 where a base phrase stands).

Words are runs of digits, a to z and characters beyond ASCII after lower-casing
A to Z only. Null text is the empty text: no words, no labels, score 0.
Repeated rows give equal rows. Memory is that of the templates and one text.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, null_safe_text, worker_cached

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = str.maketrans(UPPER, LOWER)
# The phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices of public licences.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "lgpl-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3"],
    "lgpl-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1"],
    "agpl-3.0": ["This work is licensed under the GNU Affero General Public License, version 3"],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa-4.0": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nc-nd-4.0": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
# Words that tell one licence of a family from another, beside numbers.
VARIANTS = frozenset("nc nd sa noncommercial noderivatives noderivs sharealike lesser library affero".split())
MIN_RUN = 2
COVERAGE = 0.8
SHORT = 20  # of a notice with fewer words a stray word counts twice


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWERED))


class Automaton:
    """Generalised suffix automaton over word sequences, with the places of each state in the templates."""

    def __init__(self, sequences: list[list[str]]):
        self.sequences = sequences
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for t, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w, ends)
                ends[last].add((t, i))
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            ends[self.link[s]] |= ends[s]
        ends[0] = set()
        self.ends = [sorted(x) for x in ends]

    def _new(self, length, link, edges, ends):
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        ends.append(set())
        return len(self.len) - 1

    def _split(self, p: int, q: int, w: str, ends) -> int:
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: str, ends) -> int:
        if w in self.next[last]:  # the prefix stands in an earlier sequence
            q = self.next[last][w]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, w, ends)
        cur = self._new(self.len[last] + 1, 0, {}, ends)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, w, ends)
        return cur


class Scanner:
    """Automaton of base phrases and templates, with what is asked of a text."""

    def __init__(self, base: dict[str, str], templates: dict[str, list[str]], min_run: int, coverage: float):
        self.base = [(words_of(p), label) for p, label in base.items()]
        self.names, seqs = [], [p for p, _ in self.base]
        for name, notices in templates.items():
            for notice in notices:
                self.names.append(name)
                seqs.append(words_of(notice))
        self.auto = Automaton(seqs)
        self.min_run, self.coverage = min_run, coverage
        a, n = self.auto, len(self.base)
        # phrases that end at a state: their words are a suffix of the state's
        self.phrases = [[t for t, i in a.ends[s] if t < n and i == len(a.sequences[t]) - 1] for s in range(len(a.len))]
        self.known = set().union(*a.next) if a.next else set()
        self.wholes: dict[int, list[tuple[int, int]]] = {}  # whole templates that end at a state or its suffix links, as states are met

    def _long(self, s: int, length: int) -> list[int]:
        """Base phrases that end here. A state's phrase is as long as some string of the state or of its suffix links."""
        out = []
        while s > 0:
            out += [t for t in self.phrases[s] if self.auto.len[self.auto.link[s]] < len(self.auto.sequences[t]) <= min(length, self.auto.len[s])]
            s = self.auto.link[s]
            length = min(length, self.auto.len[s])
        return out

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans); a span is
        (label, first word, last word, covered share)."""
        words = words_of(text)
        a = self.auto
        edges, link, length_of, phrases = a.next, a.link, a.len, self.phrases
        known = self.known
        places, laid = [], {}
        s = length = 0
        root = edges[0]
        for i, w in enumerate(words):
            if w not in known:
                if length >= self.min_run:
                    self._lay(i - 1, s, length, True, laid)
                s = length = 0
                continue
            if w in edges[s]:
                s = edges[s][w]
                length += 1
            else:
                if length >= self.min_run:
                    self._lay(i - 1, s, length, True, laid)
                while s and w not in edges[s]:
                    s = link[s]
                    length = length_of[s]
                if w in edges[s]:
                    s = edges[s][w]
                    length += 1
                else:
                    s = length = 0
            if length >= self.min_run:
                self._lay(i, s, length, False, laid)
            if length > 1 or root.get(w):
                for t in self._long(s, length):
                    places.append((i - len(a.sequences[t]) + 1, t))
        if length >= self.min_run:
            self._lay(len(words) - 1, s, length, True, laid)
        spans, best = self._chains(laid, words)
        base = sorted({self.base[t][1] for _, t in places})
        labels = sorted(set(base) | {x[0] for x in spans})
        starts = [p for p, _ in places]
        return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), 1.0 if places else best, spans)

    def _lay(self, last: int, s: int, length: int, ended: bool, laid: dict[int, list[tuple[int, int, int]]]) -> None:
        """Add to their templates, as (last word, last template word, words): the run at word ``last`` where it
        has ended, or else the whole templates that end there, though a longer run of another goes on. Parts
        of a template inside such a run are not its own: CC BY-NC holds all words of CC BY."""
        a, n = self.auto, len(self.base)
        if ended:
            for t, end in a.ends[s]:
                if t >= n and length < len(a.sequences[t]):
                    laid.setdefault(t, []).append((last, end, length))
            return
        top = s
        if top not in self.wholes:
            found = []
            while s > 0:
                found += [(t, len(a.sequences[t])) for t, end in a.ends[s] if t >= n and end + 1 == len(a.sequences[t]) and a.len[a.link[s]] < end + 1 <= a.len[s]]
                s = a.link[s]
            self.wholes[top] = found
        for t, size in self.wholes[top]:
            if self.min_run <= size <= length:
                laid.setdefault(t, []).append((last, size - 1, size))

    def _chains(self, laid: dict[int, list[tuple[int, int, int]]], words: list[str]) -> tuple[list[tuple[str, int, int, float]], float]:
        """Per template, the chains of runs that cover most; those that cover enough are spans. Of spans of
        several labels that overlap, the whole notices stay, and of the others the one that covers most."""
        n = len(self.base)
        spans, best = [], 0.0
        for t, matches in laid.items():
            total = len(self.auto.sequences[t])
            todo = [matches]
            while todo:
                chains = self._best(matches := todo.pop(), 2 * total)
                taken, lost = [], False
                for covered, first, last, runs in chains:
                    if covered / total < self.coverage:
                        best = max(best, covered / total * self._own(t, runs(), words)[0])
                        break
                    fits, stray = self._own(t, runs(), words)
                    best = max(best, max(0.0, covered - stray) / total * fits)
                    if not fits or (covered - stray * (2 if total < SHORT else 1)) / total < self.coverage:
                        continue
                    k = bisect(taken, (first, last))
                    if (k and taken[k - 1][1] >= first) or (k < len(taken) and taken[k][0] <= last):
                        lost = True
                        continue
                    taken.insert(k, (first, last))
                    spans.append((self.names[t - n], first, last, round(covered / total, 6), covered == total and not stray, covered))
                if lost:  # what lies between the chains taken may hold chains of its own
                    rest: dict[int, list] = {}
                    for m in matches:
                        k = bisect(taken, (m[0], m[0]))
                        if not (k and taken[k - 1][1] > m[0] - m[2]) and not (k < len(taken) and taken[k][0] <= m[0]):
                            rest.setdefault(k, []).append(m)
                    todo += rest.values()
        kept: list[tuple] = [x for x in spans if x[4]]
        for x in sorted((x for x in spans if not x[4]), key=lambda x: (-x[3], -x[5], x[1], x[0])):
            if not any(y[0] != x[0] and y[1] <= x[2] and x[1] <= y[2] for y in kept):
                kept.append(x)
        return sorted((x[:4] for x in kept), key=lambda x: (x[1], x[2], x[0])), best

    def _own(self, t: int, runs: list[tuple[int, int, int]], words: list[str]) -> tuple[int, int]:
        """(1 if the chain holds the template's numbers and variant words and no other variant word, else 0;
        text words between the chain's runs)."""
        seq = self.auto.sequences[t]
        held, stray, reach, fits = set(), 0, None, 1
        for last, end, size in runs:
            held.update(range(end - size + 1, end + 1))
            if reach is not None:
                between = words[reach + 1 : last - size + 1]
                stray += len(between)
                fits &= not any(w in VARIANTS for w in between)
            reach = last
        return int(fits and all(i in held for i, w in enumerate(seq) if w in VARIANTS or w.isdigit())), stray

    @staticmethod
    def _best(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
        """(covered words, first word, last word, its runs when called) of the best chain that ends at each match, best and then
        shortest first. A chain goes on to a match that ends later in text and template and starts at most
        ``gap`` words on; words that both hold count once."""
        matches = sorted(matches)
        ends: list[tuple[int, int, int]] = []  # (covered words, first word, match before)
        for k, (last, end, size) in enumerate(matches):
            start, at = last - size + 1, end - size + 1
            found = (size, start, -1)
            for j in range(k - 1, -1, -1):
                last_j, end_j, _ = matches[j]
                if start - last_j > gap:
                    break
                if last_j < last and end_j < end:
                    covered, first, _b = ends[j]
                    found = max(found, (covered + size - max(0, last_j - start + 1, end_j - at + 1), first, j))
            ends.append(found)

        def runs(k: int) -> list:
            out = []
            while k >= 0:
                out.append(matches[k])
                k = ends[k][2]
            return out[::-1]

        order = sorted(range(len(matches)), key=lambda k: (-ends[k][0], matches[k][0] - ends[k][1], ends[k][1]))
        return [(ends[k][0], ends[k][1], matches[k][0], partial(runs, k)) for k in order]


FIELDS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,covered:double>>"


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, min_run: int = MIN_RUN, coverage: float = COVERAGE) -> DataFrame:
    """Per document: counts and places of base phrases, labels, score and the covered template spans."""
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    key = ("license", repr((sorted(base.items()), sorted(templates.items()), min_run, coverage)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = worker_cached(key, lambda: Scanner(base, templates, min_run, coverage))
        names = [f.split()[0] for f in FIELDS.split(", ")[:9]]
        for b in batches:
            rows = [scanner.scan(t) for t in b["text"]]
            out = pd.DataFrame({"doc_id": b["doc_id"].astype("Int64")})
            for k, name in enumerate(names[1:8]):
                column = [r[k] for r in rows]
                out[name] = pd.array(column, dtype="Int64") if k < 4 else column
            out["spans"] = [[dict(label=x[0], first=x[1], last=x[2], covered=x[3]) for x in r[7]] for r in rows]
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_safe_text("text").alias("text")).mapInPandas(run, FIELDS)


def oracle_base_sql() -> str:
    """DuckDB SQL of the base columns, for tests: phrases stand between spaces of the joined words."""
    pad = "' ' || array_to_string(w, ' ') || ' '"
    places = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM x) WHERE array_to_string(w[i + 1 : i + {len(p.split())}], ' ') = '{p}'" for p, label in BASE.items())
    return f"""WITH x AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
m AS (SELECT * FROM x WHERE regexp_matches({pad}, ' ({"|".join(BASE)}) ')), p AS ({places.replace("FROM x)", "FROM m)")})
SELECT x.doc_id, len(w)::BIGINT AS n_words, count(i)::BIGINT AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM x LEFT JOIN p USING (doc_id) GROUP BY x.doc_id, w"""
