"""License scans by template markup.

A template is a line of words with three marks: ``[[ ... ]]`` is optional, ``{{n}}`` stands for
up to ``n`` words of any kind (a name, a year), ``(( a | b ))`` for one of several wordings.
A template compiles to a nondeterministic automaton over words; a text is accepted where the
mandatory wording stands exactly, word for word. Base phrases are found beside it.

Defined cases: null text is the empty text (no word, score 0); repeated rows are scanned each
on their own; a very long text takes memory in proportion to its words; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, map_arrow, pick, whole_text

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_BSD_TWO = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"

#: The wording of public licenses and of the notices that refer to them.
TEMPLATES = (
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software " + _WARRANTY),
    ("MIT-notice", "[[(( released | distributed | licensed | available ))]] under the [[terms of the]] mit license"),
    ("Apache-2.0", "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license [[you may obtain a copy of the license at {{8}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis]]"),
    ("Apache-2.0-notice", "(( released | distributed | licensed | available )) under the [[terms of the]] apache license [[version]] 2 0"),
    ("GPL", "this (( program | library | software )) is free software you can redistribute it and or modify it under the terms of the gnu general public license [[as published by the free software foundation]] [[either]] version (( 2 | 3 )) of the license [[or at your option any later version]]"),
    ("GPL-notice", "(( released | distributed | licensed | available )) under the [[terms of the]] gnu general public license [[[[(( version | v ))]] (( 2 | 3 | v2 | v3 ))]] [[or [[any]] later [[version]]]]"),
    ("CC-notice", "(( released | distributed | licensed | available )) under [[a | the]] (( cc | creative commons )) (( by | attribution | zero | 0 )) [[nc | noncommercial]] [[nd | noderivatives]] [[sa | sharealike]] [[(( 1 | 2 | 3 | 4 )) 0]] [[international]] [[license]]"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD-3-Clause", _BSD_TWO + " [[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission [[" + _BSD_END + "]]"),
    ("BSD-2-Clause", _BSD_TWO + " " + _BSD_END),
    ("SPDX-tag", "spdx license identifier {{1}}"),
)


class Automaton:
    """States are numbers; ``on[s]`` maps a word to next states, ``free[s]`` are moves without a word, ``any_[s]`` moves on every word."""

    def __init__(self, template: str):
        self.on: list[dict[bytes, set[int]]] = []
        self.free: list[set[int]] = []
        self.any_: list[set[int]] = []
        marks = re.findall(r"\[\[|\]\]|\(\(|\)\)|\||\{\{\d+\}\}|[^\s\[\]()|{}]+", template)
        self.start = self._state()
        self.accept, at = self._branches(marks, 0, self.start, None)
        if at != len(marks):
            raise ValueError(f"unbalanced mark in {template!r}")
        self.opening = self._closed({self.start})
        if self.accept in self.opening:
            raise ValueError("a template needs a mandatory word")
        self.first = {w for s in self.opening for w in self.on[s]}

    def _state(self) -> int:
        self.on.append({})
        self.free.append(set())
        self.any_.append(set())
        return len(self.on) - 1

    def _branches(self, marks: list[str], at: int, start: int, closing: str | None) -> tuple[int, int]:
        end, here = self._state(), start
        while at < len(marks) and marks[at] != closing:
            mark = marks[at]
            if mark == "|":
                self.free[here].add(end)
                here = start
                at += 1
            elif mark in ("[[", "(("):
                inner = self._state()
                self.free[here].add(inner)
                after, at = self._branches(marks, at + 1, inner, "]]" if mark == "[[" else "))")
                if at >= len(marks):
                    raise ValueError("a mark is not closed")
                at += 1
                if mark == "[[":
                    self.free[here].add(after)
                here = after
            elif mark.startswith("{{"):
                after = self._state()
                for _ in range(int(mark[2:-2])):
                    self.free[here].add(after)
                    step = self._state()
                    self.any_[here].add(step)
                    here = step
                self.free[here].add(after)
                here = after
                at += 1
            else:
                step = self._state()
                self.on[here].setdefault(mark.encode(), set()).add(step)
                here = step
                at += 1
        self.free[here].add(end)
        return end, at

    def _closed(self, states: set[int]) -> set[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def match(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest accepted stretch that starts at ``at``."""
        states, end = self.opening, None
        while states and at < len(words):
            states = {t for s in states for t in (*self.on[s].get(words[at], ()), *self.any_[s])}
            if states:
                states = self._closed(states)
                at += 1
                if self.accept in states:
                    end = at
        return end


def scan_text(text: bytes, automata: list[tuple[str, Automaton]], phrases: list[tuple[list[bytes], str]]) -> tuple:
    words = WORDS(text.lower())  # of bytes, lower() changes A-Z only
    wanted = {p[0] for p, _ in phrases} | {w for _, a in automata for w in a.first}
    places: list[int] = []
    base: set[str] = set()
    own: set[str] = set()
    if not wanted.isdisjoint(words):
        for i, w in enumerate(words):
            if w in wanted:
                for phrase, label in phrases:
                    if w == phrase[0] and words[i : i + len(phrase)] == phrase:
                        places.append(i)
                        base.add(label)
                for label, automaton in automata:
                    if w in automaton.first and label not in own and automaton.match(words, i) is not None:
                        own.add(label)
    score = 1.0 if own else 0.5 if base else 0.0
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score


def scan(df: DataFrame, templates=TEMPLATES, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every document.

    ``score`` is 1 where a template accepts, 0.5 where only a base phrase stands, else 0.
    """
    rows = pick(df, id=id_col, text=text_col).withColumn("text", whole_text(F.col("text")))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def start():
        automata = [(label, Automaton(t)) for label, t in templates]
        wanted = [(p.encode().split(), label) for p, label in phrases]

        def step(batch: pa.RecordBatch):
            found = list(zip(*(scan_text(t, automata, wanted) for t in as_bytes(batch, "text"))))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), *(pa.array(c, k) for c, k in zip(found, kinds))], names=names)

        return step

    return map_arrow(rows, schema, start)
