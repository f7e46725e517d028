"""License scans: template markup compiled to token automata.

A template is licence wording with two kinds of markup:

    <<optional>> words <</optional>>   words that may be absent
    <<any N>>                          up to N words of any kind (names, years)

Everything else is mandatory and has to stand word for word, after A-Z are
lowered and runs of other ASCII characters are taken as gaps. A template is
compiled once, to a nondeterministic automaton over words; it is entered only
where one of the words that can start it stands next to a word that it must
contain, so the cost follows the licence wording in a text and not its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from surveyq.llm.common import ALNUM, Words, tuned, with_text_batches, word_hash, words_of

_MARK = re.compile(r"(<<optional>>|<</optional>>|<<any \d+>>)")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ANY = -1

#: The phrases that count as base references, with their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Short wording of public licences, with the parts that notices vary.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "<<optional>>the<</optional>> mit license copyright <<optional>>c<</optional>> <<any 12>> permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license <<optional>>version<</optional>> 2 <<optional>>0<</optional>>"),
    ("apache-2", "you may not use this file except in compliance with the license <<optional>>you may obtain a copy of the license at<</optional>> <<any 8>> apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under <<optional>>a<</optional>> <<optional>>creative commons<</optional>> cc by nc <<optional>>4 0<</optional>>"),
    ("cc-by-nc", "creative commons attribution noncommercial <<optional>>4 0<</optional>> <<optional>>international<</optional>> license"),
    ("cc-by", "creative commons attribution <<optional>>4 0<</optional>> <<optional>>international<</optional>> license"),
    ("cc-by-sa", "creative commons attribution sharealike <<optional>>4 0<</optional>> <<optional>>international<</optional>> license"),
    ("gpl-3", "<<optional>>this work is<</optional>> licensed under the gnu general public license version 3"),
    ("gpl-2", "<<optional>>this work is<</optional>> licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "subject to the terms of the mozilla public license <<optional>>v<</optional>> 2 0"),
    ("all-rights-reserved", "all rights reserved"),
    ("all-rights-reserved", "copyright <<optional>>c<</optional>> <<any 6>> all rights reserved"),
)


@dataclass
class Automaton:
    """States 0..n; edges[s] maps a word hash (or _ANY) to next states; `final` accepts."""

    label: str
    base: bool
    edges: list[dict[int, set[int]]]
    skips: list[set[int]]
    final: int
    starts: set[int] = field(default_factory=set)
    anchor: int = 0

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def match(self, hashes: list[int], at: int, stop: int) -> int:
        """The end of the longest accepted run of words from `at`, or -1."""
        states, end, i = self.closure({0}), -1, at
        while True:
            if self.final in states:
                end = i
            if i >= stop or not states:
                return end
            moved: set[int] = set()
            for s in states:
                moved |= self.edges[s].get(hashes[i], set()) | self.edges[s].get(_ANY, set())
            states, i = self.closure(moved), i + 1

    @property
    def length(self) -> int:
        return len(self.edges)


def compile_template(label: str, markup: str, base: bool = False) -> Automaton:
    """An automaton of a template; ValueError if its marks don't nest or it has no mandatory word."""
    edges: list[dict[int, set[int]]] = [{}]
    skips: list[set[int]] = [set()]
    opened: list[int] = []
    mandatory: list[str] = []

    def state() -> int:
        edges.append({})
        skips.append(set())
        return len(edges) - 1

    for part in _MARK.split(markup):
        now = len(edges) - 1
        if part == "<<optional>>":
            opened.append(now)
        elif part == "<</optional>>":
            if not opened:
                raise ValueError(f"unopened optional part: {markup}")
            skips[opened.pop()].add(now)
        elif part.startswith("<<any "):
            for _ in range(int(part[6:-2])):
                a, b = len(edges) - 1, state()
                edges[a].setdefault(_ANY, set()).add(b)
                skips[a].add(b)
        else:
            for word in _WORD.findall(part.lower()):
                a, b = len(edges) - 1, state()
                edges[a].setdefault(word_hash(word), set()).add(b)
                if not opened:
                    mandatory.append(word)
    if opened or not mandatory:
        raise ValueError(f"bad template: {markup}")
    out = Automaton(label, base, edges, skips, len(edges) - 1)
    for s in out.closure({0}):
        out.starts |= set(edges[s])
    # the longest mandatory word is the one that ordinary prose holds least often
    out.anchor = word_hash(max(mandatory, key=len))
    return out


def _every(templates, base: bool) -> list[Automaton]:
    return [compile_template(label, markup, base) for label, markup in templates]


@dataclass
class Found:
    label: str
    base: bool
    text: int
    start: int
    end: int


def find(words: Words, automata: list[Automaton]) -> Iterator[Found]:
    """All accepted runs; start and end count words from the start of their text."""
    anchors = np.array(sorted({a.anchor for a in automata}), np.uint64)
    where = np.flatnonzero(np.isin(words.hash, anchors)) if len(words.hash) else np.zeros(0, np.int64)
    if not len(where):
        return
    of_text = np.searchsorted(words.first, where, "right") - 1
    for t in np.unique(of_text):
        lo, hi = int(words.first[t]), int(words.first[t + 1])
        hashes = words.hash[lo:hi].tolist()
        here = {}
        for p in where[of_text == t].tolist():
            here.setdefault(hashes[p - lo], []).append(p - lo)
        for a in automata:
            tried: set[int] = set()
            for p in here.get(a.anchor, ()):
                for s in range(max(0, p - a.length), p + 1):
                    if s in tried or not (hashes[s] in a.starts or _ANY in a.starts):
                        continue
                    tried.add(s)
                    if (end := a.match(hashes, s, hi - lo)) > s:
                        yield Found(a.label, a.base, int(t), s, end)


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES
) -> DataFrame:
    """License references in every text, one row per row of docs.

    Returns id, n_words, n_base (places of base phrases), first_word and
    last_word (smallest and largest start of those, null without any),
    base_labels, labels (distinct, sorted, comma-joined), score (1 if a whole
    template is accepted, 0.5 if only a base phrase stands there, else 0) and
    matched_words (words inside accepted runs).

    Null and empty texts have no words and no labels; a null id is kept; equal
    rows give equal results; other columns are not read; an empty table gives
    none. A text of any length is scanned whole.
    """
    automata = _every(base, True) + _every(templates, False)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in with_text_batches(batches, "text"):
            words = words_of(texts, ALNUM)
            rows = [
                {"n_base": 0, "first_word": None, "last_word": None, "base_labels": set(), "labels": set(), "score": 0.0, "spans": []}
                for _ in range(len(texts))
            ]
            for f in find(words, automata):
                r = rows[f.text]
                r["labels"].add(f.label)
                r["spans"].append((f.start, f.end))
                if f.base:
                    r["n_base"] += 1
                    r["base_labels"].add(f.label)
                    r["first_word"] = f.start if r["first_word"] is None else min(r["first_word"], f.start)
                    r["last_word"] = f.start if r["last_word"] is None else max(r["last_word"], f.start)
                    r["score"] = max(r["score"], 0.5)
                else:
                    r["score"] = 1.0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(words.first), pa.int64()),
                    *(pa.array([r[k] for r in rows], pa.int64()) for k in ("n_base", "first_word", "last_word")),
                    *(pa.array([",".join(sorted(r[k])) for r in rows], pa.string()) for k in ("base_labels", "labels")),
                    pa.array([r["score"] for r in rows], pa.float64()),
                    pa.array([len(set().union(*(range(a, b) for a, b in r["spans"]))) for r in rows], pa.int64()),
                ],
                [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matched_words"],
            )

    kind = dict(docs.dtypes)[id_col]
    tuned(docs.sparkSession)
    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(
        scan,
        f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, matched_words long",
    )
