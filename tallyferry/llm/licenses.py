"""License scan by template matching: mandatory wording, optional and replaceable regions, as token automata.

A template is text with two marks: [[ ... ]] may be left out, and {{n}} stands for any 0 to n words. It is compiled into
an automaton over words (a state set, advanced word by word), which accepts where the mandatory wording stands exactly.
Documents without a template's longest mandatory word are passed over by a hash of their words. Besides, the three base
phrases are counted wherever their words stand one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyferry.llm.arrays import ALNUM, Words, pieces

#: Phrase and label; fixed values.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label and wording of public licenses and of their usual notices; fixed values.
TEMPLATES = (
    ("mit-notice", "[[this {{3}} is]] released under the [[terms of the]] MIT License"),
    ("mit-notice", "licensed under the [[terms of the]] MIT License"),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of {{4}} and associated documentation "
        "files {{6}} to deal in {{4}} without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of {{4}} and to permit persons to whom {{4}} is "
        "furnished to do so, subject to the following conditions",
    ),
    ("apache-2.0", "licensed under the Apache License [[Version]] 2.0 [[the License you may not use this file except in "
                   "compliance with the License]]"),
    ("gpl-3.0", "licensed under the [[terms of the]] GNU General Public License [[as published by the Free Software "
                "Foundation]] [[either]] version 3 [[of the License]] [[or {{4}} any later version]]"),
    (
        "gpl-text",
        "is free software you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation either version {{1}} of the License or {{4}} any later version",
    ),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("cc-by-nc-4.0", "licensed under [[a Creative Commons Attribution NonCommercial {{3}} License]] CC BY-NC 4.0"),
)
_MARK = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Automaton:
    """States 0 .. last; `words[s]` leads to s + 1, `skips[s]` are free moves, `wild` states take any word."""

    label: str
    words: dict[int, str] = field(default_factory=dict)
    wild: set[int] = field(default_factory=set)
    skips: dict[int, set[int]] = field(default_factory=dict)
    last: int = 0
    anchor: str = ""

    @classmethod
    def compiled(cls, label: str, template: str) -> Automaton:
        out, open_, mandatory = cls(label), [], []
        for mark in _MARK.findall(template.lower()):
            here = out.last
            if mark == "[[":
                open_.append(here)
            elif mark == "]]":
                out.skips.setdefault(open_.pop(), set()).add(here)
            elif mark.startswith("{{"):
                for k in range(int(mark[2:-2])):
                    out.wild.add(here + k)
                out.last = here + int(mark[2:-2])
                for k in range(here, out.last):
                    out.skips.setdefault(k, set()).add(out.last)
            else:
                out.words[here] = mark
                out.last += 1
                if not open_:
                    mandatory.append(mark)
        if open_ or not mandatory:
            raise ValueError(f"template of {label}: a region is not closed, or nothing is mandatory")
        out.anchor = max(mandatory, key=len)
        return out

    def _closed(self, states: set[int]) -> set[int]:
        due, seen = list(states), set(states)
        while due:
            for to in self.skips.get(due.pop(), ()):
                if to not in seen:
                    seen.add(to)
                    due.append(to)
        return seen

    def first_words(self) -> set[str]:
        return {self.words[s] for s in self._closed({0}) if s in self.words}

    def match(self, words: list[str], at: int) -> int | None:
        """The end of the longest accepted run of words from `at`, or None."""
        states, end = self._closed({0}), None
        for k in range(at, len(words)):
            states = {s + 1 for s in states if s in self.wild or self.words.get(s) == words[k]}
            if not states:
                break
            states = self._closed(states)
            if self.last in states:
                end = k + 1
        return end


def find_templates(automata: list[Automaton], words: list[str]) -> list[tuple[str, int, int]]:
    """(label, first word, word behind the last) of every accepted place; within a template places do not overlap."""
    present, out = set(words), []
    for automaton in automata:
        if automaton.anchor not in present:
            continue
        first, behind = automaton.first_words(), 0
        for k, word in enumerate(words):
            if k >= behind and word in first and (end := automaton.match(words, k)):
                out.append((automaton.label, k, end))
                behind = end
    return sorted(set(out))


def _hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return Words(data, np.array([0, len(data)])).hash[0]


def license_scan(docs: DataFrame, text_col: str = "text", templates: tuple = TEMPLATES, base: tuple = BASE) -> DataFrame:
    """All columns of `docs`, and: _n_words, _base (array of struct: label, word), _matches (array of struct: label,
    begin, end, in words), _score: 1 where a template is accepted, 0.5 where only a base phrase stands, else 0.

    Null counts as empty. Runs where the rows are.
    """
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    match_type = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton.compiled(label, text) for label, text in templates]
        anchors = np.unique([_hash(a.anchor) for a in automata] + [_hash(p.split()[-1]) for p, _ in base])
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            matches: list[list] = [[] for _ in range(batch.num_rows)]
            for at, _, data, bounds in pieces(batch.column(batch.schema.names.index(text_col))):
                words = Words(data, bounds, ALNUM)
                n_words[at : at + len(words.count)] = words.count
                for k in np.unique(words.owner()[np.isin(words.hash, anchors)]).tolist():
                    span = range(words.first[k], words.first[k + 1])
                    own_words = [bytes(words.low[words.start[i] : words.end[i]]).decode("utf-8", "replace") for i in span]
                    for phrase, label in base:
                        parts = phrase.split()
                        found[at + k] += [
                            {"label": label, "word": i} for i, w in enumerate(own_words)
                            if w == parts[0] and own_words[i : i + len(parts)] == parts
                        ]
                    matches[at + k] = [{"label": a, "begin": b, "end": e} for a, b, e in find_templates(automata, own_words)]
            score = [1.0 if m else 0.5 if b else 0.0 for b, m in zip(found, matches, strict=True)]
            arrays = [*batch.columns, pa.array(n_words), pa.array(found, base_type), pa.array(matches, match_type), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "_n_words", "_base", "_matches", "_score"])

    return docs.mapInArrow(
        task,
        f"{own}, _n_words long, _base array<struct<label: string, word: long>>, "
        "_matches array<struct<label: string, begin: long, end: long>>, _score double",
    )
