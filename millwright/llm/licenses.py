"""License scans: licence templates compiled into one token automaton, which accepts texts that have their mandatory wording exactly.

A template is wording with markup: ``<<opt>> ... <</opt>>`` may be missing, ``<<any a b c>>`` is one of the words, and ``<<var name 1-20>>`` stands for 1 to 20
words of any kind. Everything else is mandatory. Wording is compared by words: A-Z are lower-cased, and a word is a run of ASCII letters, digits and characters beyond ASCII,
so layout and punctuation don't count. All templates are compiled into one automaton without empty moves. It starts at each word with which some template may begin,
and a start lives as long as the longest template at most, so time is linear in the text. Of the places that a template accepts the leftmost
and of these the longest is taken, then the next one behind it; templates are searched apart from each other.

Kinds, by what they prove: ``text`` (the licence itself), ``notice`` (the notice that its authors ask for), ``reference`` (a sentence or a tag that names it)
and ``phrase`` (its name alone). The score of a document is the weight of its strongest kind, 0 without any.

Edge cases: null and empty texts have no words, and so no labels; texts without a licence have empty labels and null places; very long texts are
scanned as a whole; phrases that overlap are all counted; repeated rows and null ids stay as they are; an empty table gives an empty one; other columns are ignored. A template with
unbalanced markup, or that could begin with any word or be empty, raises.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import Batcher, narrow, rows

KINDS = {"text": 1.0, "notice": 0.9, "reference": 0.6, "phrase": 0.3}
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(/?)(\w+)([^<>]*)>>")


class Template(NamedTuple):
    name: str
    label: str
    kind: str
    markup: str


# The phrases of the base rule.
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

# Standard wordings of licences and their notices.
_HOLDER = "<<opt>>copyright <<opt>>c<</opt>> <<var holder 1-20>><</opt>> <<opt>>all rights reserved<</opt>>"
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_TEXTS = {
    "mit": f"""<<opt>><<opt>>the<</opt>> mit license <<opt>>mit<</opt>><</opt>> {_HOLDER} permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of
        the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software {_AS_IS} in no event shall <<var holder 1-12>> be liable for any claim damages or
        other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "isc": f"""<<opt>>isc license<</opt>> {_HOLDER} permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
        notice and this permission notice appear in all copies the software is provided as is and <<var holder 1-12>> disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness""",
    "bsd-2-clause": f"""{_HOLDER} redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<</opt>> redistributions
        of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice
        this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by""",
    "bsd-3-clause": f"""{_HOLDER} redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<</opt>> redistributions
        of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice
        this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<opt>>3<</opt>> neither the name of <<var holder 1-20>> nor the names
        of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted
        to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions""",
}
_NOTICES = {
    "apache-2.0": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
        <<opt>>http<</opt>> <<opt>>https<</opt>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an
        as is basis without warranties or conditions of any kind either express or implied""",
    "mpl-2.0": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at""",
} | {
    f"{name}-{version}.0": f"""this <<any program library>> is free software you can redistribute it and or modify it under the terms of the gnu {words} general public license as published by the free
        software foundation either version {version} of the license or <<opt>>at your option<</opt>> any later version"""
    for name, words in (("gpl", ""), ("lgpl", "lesser"), ("agpl", "affero")) for version in (2, 3)
}

# References are made of how a licence may be named and how a sentence or a tag may lead there.
_UNDER = "<<any licensed released distributed published available provided>> under <<opt>>the terms of<</opt>> <<opt>><<any the a an>><</opt>>"
_TAG = "spdx license identifier"
_NAMED = {
    "mit": "<<any mit x11>> license",
    "isc": "isc license",
    "apache-2.0": "apache <<opt>>software<</opt>> license <<opt>>version<</opt>> 2 0",
    "mpl-2.0": "mozilla public license <<opt>><<any version v>><</opt>> 2 0",
    **{f"bsd-{n}-clause": f"<<opt>>new<</opt>> <<opt>>{word}<</opt>> <<any bsd>> {n} clause license" for n, word in ((2, "simplified"), (3, "modified"))},
    **{f"{name}-{v}.0": f"gnu {words} general public license <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> <<any version v>> {v}" for name, words in (("gpl", ""), ("lgpl", "lesser"), ("agpl", "affero")) for v in (2, 3)},
    **{f"cc-{kind}-{v}.0": f"cc {kind.replace('-', ' ')} {v} 0 <<opt>><<any international unported>><</opt>> <<opt>>license<</opt>>" for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in (3, 4)},
}

TEMPLATES = (
    *(Template(f"{n} text", n, "text", m) for n, m in _TEXTS.items()),
    *(Template(f"{n} notice", n, "notice", m) for n, m in _NOTICES.items()),
    *(Template(f"{n} reference", n, "reference", f"{_UNDER} {m}") for n, m in _NAMED.items()),
    *(Template(f"{n} tag", n, "reference", f"{_TAG} {re.sub('[^a-z0-9]+', ' ', n)}") for n in _NAMED),
    *(Template(f"{n} phrase", n, "phrase", m) for n, m in PHRASES.items()),
)


def tokens(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


class Part(NamedTuple):
    """A piece of a template: ``word``, ``any`` (of words), ``var`` (of words any) or ``opt`` (of parts)."""

    kind: str
    words: tuple[bytes, ...] = ()
    parts: tuple[Part, ...] = ()
    least: int = 1
    most: int = 1


def parsed(markup: str) -> tuple[Part, ...]:
    """The pieces of a template in order."""
    stack: list[list[Part]] = [[]]
    at = 0
    for m in _MARK.finditer(markup):
        stack[-1] += [Part("word", (w,)) for w in tokens(markup[at : m.start()])]
        at = m.end()
        closing, kind, rest = m.groups()
        if kind == "opt" and not closing:
            stack.append([])
        elif kind == "opt" and len(stack) > 1:
            stack[-2].append(Part("opt", parts=tuple(stack.pop())))
        elif kind == "any" and not closing and tokens(rest):
            stack[-1].append(Part("any", tuple(tokens(rest))))
        elif kind == "var" and not closing and (bounds := re.search(r"(\d+)-(\d+)\s*$", rest)) and int(bounds[1]) <= int(bounds[2]):
            stack[-1].append(Part("var", least=int(bounds[1]), most=int(bounds[2])))
        else:
            raise ValueError(f"{m[0]!r} is no markup, or stands alone")
    if len(stack) > 1 or "<<" in _MARK.sub("", markup):
        raise ValueError("a template's markup is not balanced")
    return (*stack[0], *(Part("word", (w,)) for w in tokens(markup[at:])))


class Automaton:
    """All templates in one automaton. A state is where a template stands between two words; ``moves`` and ``wild`` lead from a state, by a word and by any, to others."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = templates
        self.moves: list[dict[bytes, set[int]]] = []
        self.wild: list[set[int]] = []
        self.empty: list[set[int]] = []
        self.accepts: dict[int, int] = {}
        self.first: dict[bytes, tuple[int, ...]] = {}
        starts = []
        for at, t in enumerate(templates):
            start = self._state()
            end = self._follow(start, parsed(t.markup))
            self.accepts[end] = at
            starts.append(start)
        closed = [self._closure(s) for s in range(len(self.moves))]
        # Without empty moves: a state does what all states do that it reaches by them.
        self.step = [{w: tuple(sorted(set().union(*(closed[x] for x in self._by(closed[s], w))))) for w in set().union(*(self.moves[x].keys() for x in closed[s]))} for s in range(len(self.moves))]
        self.other = [tuple(sorted(set().union(*(closed[y] for x in closed[s] for y in self.wild[x])))) for s in range(len(self.moves))]
        self.ends = {s: self.accepts[s] for s in self.accepts}
        for start, t in zip(starts, templates, strict=True):
            if self.other[start] or any(x in self.ends for x in closed[start]):
                raise ValueError(f"{t.name}: a template begins with a word of its own")
        for start in starts:
            for w, states in self.step[start].items():
                self.first[w] = tuple(sorted({*self.first.get(w, ()), *states}))

    def _state(self) -> int:
        self.moves.append({})
        self.wild.append(set())
        self.empty.append(set())
        return len(self.moves) - 1

    def _follow(self, state: int, parts: Sequence[Part]) -> int:
        for p in parts:
            if p.kind == "opt":
                end = self._follow(state, p.parts)
                after = self._state()
                self.empty[end].add(after)
                self.empty[state].add(after)
            elif p.kind == "var":
                after = self._state()
                for n in range(p.most + 1):
                    if n >= p.least:
                        self.empty[state].add(after)
                    if n < p.most:
                        self.wild[state].add(new := self._state())
                        state = new
            else:
                after = self._state()
                for w in p.words:
                    self.moves[state].setdefault(w, set()).add(after)
            state = after
        return state

    def _closure(self, state: int) -> set[int]:
        found, left = {state}, [state]
        while left:
            new = self.empty[left.pop()] - found
            found |= new
            left += new
        return found

    def _by(self, states: set[int], word: bytes) -> set[int]:
        """Where a word leads; a word that a template wants may also be any word of a region that is replaced."""
        return set().union(*(self.moves[x].get(word, set()) | self.wild[x] for x in states))

    def longest(self, words: list[bytes], start: int) -> dict[int, int]:
        """For each template that accepts words from ``start`` on: how many at most."""
        states, found, at = self.first.get(words[start], ()), {}, start + 1
        while states:
            for s in states:
                if s in self.ends:
                    found[self.ends[s]] = at - start
            if at == len(words):
                break
            w = words[at]
            at += 1
            states = self.step[states[0]].get(w, self.other[states[0]]) if len(states) == 1 else tuple({x for s in states for x in self.step[s].get(w, self.other[s])})
        return found

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(template, first word, number of words), by first word."""
        free = [0] * len(self.templates)
        for at, w in enumerate(words):
            if w in self.first:
                for t, n in sorted(self.longest(words, at).items()):
                    if at >= free[t] or self.templates[t].kind == "phrase":
                        free[t] = at + n
                        yield t, at, n


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, found`` for each document: an array of (template, label, kind, first_word, n_words)."""
    automaton = Automaton(templates)
    one = pa.struct([("template", pa.string()), ("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("found", pa.list_(one))])

    def each(batches):
        out = Batcher(schema)
        for i, text in rows(batches):
            words = tokens(text)
            found = [dict(zip(one.names, (*templates[t][:3], at, n), strict=True)) for t, at, n in automaton.find(words)]
            if out.add((i, len(words), found), 100 * len(found)):
                yield out.take()
        yield out.take()

    return narrow(docs, id_col, text_col).mapInArrow(each, "doc_id long, n_words long, found array<struct<template:string,label:string,kind:string,first_word:long,n_words:long>>")


def digest(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The result of ``op11_licenses``: the number of words, the places of phrases, the labels of phrases and of all templates, and the score; then the templates found."""
    places = F.filter("found", lambda x: x["kind"] == "phrase")
    listed = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")
    weight = lambda x: F.coalesce(*(F.when(x["kind"] == k, F.lit(w)) for k, w in KINDS.items()))
    starts = F.transform(places, lambda x: x["first_word"])
    return scan(docs, templates, id_col, text_col).select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(places).alias("base_labels"), listed(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", weight)), F.lit(0.0)).alias("score"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["template"]))), ",").alias("templates"),
    )
