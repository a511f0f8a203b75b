"""License texts found by template markup.

A template is the wording of a license with regions marked in it: `<<beginOptional>> ... <<endOptional>>` may be left out, and
`<<var;name=...;max=N>>` stands for up to N words of any kind. It is compiled into an automaton over words. A text has the
template's label if somewhere in it the mandatory words stand exactly as they are, in order, with nothing between them but what
the regions allow. Case, punctuation, line breaks and comment signs do not count.

One Aho-Corasick scan over a text finds the first mandatory words of every template, and the phrases; the automata are only run
from there, so a text without a license costs one scan. Runs are as long as a template at most.

Regions at either end of a template decide nothing and are cut off. A null or empty text has no words and no labels, and a
score of 0. Repeated rows are rows of their own, a null id is carried, extra columns do not matter, whole texts of any length
are read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from folioworks.llm import common
from folioworks.llm.resample import plain
from folioworks.shipping import ship_by_value

# Phrases that name a license, and the wording of licenses.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("mit", """<<beginOptional>>MIT License<<endOptional>> <<var;name=copyright;max=60>>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;name=holder;max=20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """<<beginOptional>>ISC License<<endOptional>> <<var;name=copyright;max=60>>
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND <<var;name=author;max=20>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=holder;max=20>> BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """<<var;name=copyright;max=60>> Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: <<var;name=bullet;max=1>> Redistributions of source code must retain
the above copyright notice, this list of conditions and the following disclaimer. <<var;name=bullet;max=1>> Redistributions in
binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. <<beginOptional>><<var;name=bullet;max=1>> Neither the name of
<<var;name=organization;max=30>> may be used to endorse or promote products derived from this software without specific prior
written permission.<<endOptional>> THIS SOFTWARE IS PROVIDED BY <<var;name=holder;max=20>> "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""),
    ("apache-2.0", """<<var;name=copyright;max=60>> Licensed under the Apache License, Version 2.0
<<beginOptional>>(the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http<<beginOptional>>s<<endOptional>>://www.apache.org/licenses/LICENSE-2.0<<endOptional>>"""),
    ("gpl-notice", """This program is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under
the terms of the GNU General Public License as published by the Free Software Foundation<<beginOptional>>, either<<endOptional>>
version <<var;name=version;max=3>> of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>"""),
    ("gpl", "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU <<beginOptional>>Lesser<<endOptional>> General Public License"),
    ("mit", "<<beginOptional>>is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("mit", "licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC <<var;name=version;max=2>>"),
    ("cc-by", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution <<var;name=version;max=2>> <<beginOptional>>International<<endOptional>> License"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http<<beginOptional>>s<<endOptional>>://mozilla.org/MPL/2.0/"""),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Printed quotes, dashes, dots and signs that count as punctuation, as blanks do.
PRINTED = "‘’“”–—…• ©«»"

#: Words that a run must begin with, at most.
ANCHOR = 6
_MARK = re.compile(r"<<(beginOptional|endOptional|var)((?:;\w+=\w+)*)>>")
_PRINTED = str.maketrans(dict.fromkeys(PRINTED, " "))


def parsed(markup: str) -> list:
    """A template as nested steps: ("word", w), ("any", max) and ("maybe", steps)."""
    levels, at = [[]], 0
    for m in [*_MARK.finditer(markup), None]:
        levels[-1] += [("word", w) for w in plain(markup[at : m.start() if m else None].translate(_PRINTED)).split()]
        if m is None:
            break
        at = m.end()
        if m[1] == "beginOptional":
            levels.append([])
        elif m[1] == "endOptional":
            if len(levels) < 2:
                raise ValueError("an optional region ends that did not begin")
            inner = levels.pop()
            levels[-1].append(("maybe", inner))
        else:
            levels[-1].append(("any", int(dict(p.split("=") for p in m[2][1:].split(";")).get("max", 20))))
    if len(levels) > 1:
        raise ValueError("an optional region does not end")
    return levels[0]


@dataclass
class Automaton:
    """States 0, 1, ...: what word leads on, whether any word does, what is reached without a word; mandatory words read so far."""

    label: str
    anchor: str = ""
    words: list[dict[str, int]] = field(default_factory=list)
    any_word: list[int | None] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    last: int = 0

    def _state(self, depth: int) -> int:
        self.words.append({})
        self.any_word.append(None)
        self.free.append(set())
        self.depth.append(depth)
        return len(self.words) - 1

    def _add(self, steps: list, at: int, mandatory: bool) -> int:
        for kind, value in steps:
            if kind == "word":
                to = self._state(self.depth[at] + mandatory)
                self.words[at][value] = to
            elif kind == "any":
                to = self._state(self.depth[at])
                self.free[at].add(to)
                for _ in range(value):
                    nxt = self._state(self.depth[at])
                    self.any_word[at] = nxt
                    self.free[nxt].add(to)
                    at = nxt
            else:
                end = self._add(value, at, False)  # nothing else leads on from this state
                to = self._state(self.depth[at])
                self.free[end].add(to)
                self.free[at].add(to)
            at = to
        return at

    def reach(self, states: set[int]) -> set[int]:
        out, open_ = set(states), list(states)
        while open_:
            for s in self.free[open_.pop()] - out:
                out.add(s)
                open_.append(s)
        return out

    def run(self, words: Sequence[str], start: int) -> tuple[bool, float]:
        """Whether the template is read from `start`, and what part of its mandatory words was."""
        now, most = self.reach({0}), 0
        for i in range(start, len(words)):
            w = words[i]
            step = {self.words[s][w] for s in now if w in self.words[s]} | {self.any_word[s] for s in now if self.any_word[s] is not None}
            if not step:
                break
            now = self.reach(step)
            most = max(most, max(self.depth[s] for s in now))
            if self.last in now:
                return True, 1.0
        return False, most / self.depth[self.last]


def compiled(label: str, markup: str) -> Automaton:
    """The automaton of a template, its outer regions cut off; the mandatory words at its beginning are its anchor."""
    steps = parsed(markup)
    while steps and steps[0][0] != "word":
        steps = steps[1:]
    while steps and steps[-1][0] != "word":
        steps = steps[:-1]
    if not steps:
        raise ValueError(f"the template {label} has no mandatory words")
    first = next((i for i, s in enumerate(steps) if s[0] != "word"), len(steps))
    out = Automaton(label, " ".join(s[1] for s in steps[: min(first, ANCHOR)]))
    out.last = out._add(steps, out._state(0), True)
    return out


class Scanner:
    """All phrases and templates, found in one pass over a text."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]]):
        import ahocorasick

        self.automata = [compiled(*t) for t in templates]
        wanted: dict[str, tuple[list[str], list[Automaton]]] = {}
        for phrase, label in phrases:
            wanted.setdefault(f" {phrase} ", ([], []))[0].append(label)
        for a in self.automata:
            wanted.setdefault(f" {a.anchor} ", ([], []))[1].append(a)
        self.index = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for key, (labels, automata) in wanted.items():
            self.index.add_word(key, (len(key), labels, automata))
        if len(self.index):
            self.index.make_automaton()

    def _hits(self, text: str):
        """(first word's number, labels, automata) of every key, by its end in the text."""
        at = number = 0
        hits = [(end - size + 1, labels, automata) for end, (size, labels, automata) in self.index.iter(text)] if len(self.index) else []
        for start, labels, automata in sorted(hits, key=lambda h: h[0]):
            number += text.count(" ", at, start)
            at = start
            yield number, labels, automata

    def read(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, all labels, score."""
        raw = text or ""
        own = plain(raw)
        base, places, labels, score = set(), [], set(), 0.0
        starts = []
        for number, named, automata in self._hits(own):
            places += [number] * len(named)
            base.update(named)
            starts += [(number, a) for a in automata]
        words = own.split()
        bare = raw if raw.isascii() else raw.translate(_PRINTED) if any(c in raw for c in PRINTED) else raw
        if bare is not raw:  # printed signs stick to words: the templates are looked for without them
            other = plain(bare)
            starts, read = [(number, a) for number, _, automata in self._hits(other) for a in automata], other.split()
        else:
            read = words
        for number, a in starts:
            if a.label in labels and score == 1.0:
                continue
            whole, part = a.run(read, number)
            score = max(score, part)
            if whole:
                labels.add(a.label)
        if base:
            score = max(score, 0.5)
        return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(base | labels), score


def scan(
    docs: DataFrame, keep: Sequence[str], templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, text: str = "text"
) -> DataFrame:
    """`keep`, n_words, n_base (places of a phrase), first_word and last_word of them, base_labels, labels (arrays) and score.

    The score is 1 where a template was read whole; else the largest part of one template's mandatory words that was read
    before the text left it, and 0.5 at least where a phrase names a license.
    """
    templates, phrases = tuple(templates), tuple(phrases)
    Scanner(templates, phrases)  # bad markup shows before any job

    def find(texts):
        state = common.worker_state()
        if state.get("licenses_key") != (templates, phrases):
            state["licenses_key"], state["licenses"] = (templates, phrases), Scanner(templates, phrases)
        rows = [state["licenses"].read(t) for t in texts]
        cols = list(zip(*rows)) if rows else [()] * 7
        longs, names = pa.int64(), pa.list_(pa.string())
        return [pa.array(c, t) for c, t in zip(cols, (longs, longs, longs, longs, names, names, pa.float64()))]

    fields = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "array<string>"), ("labels", "array<string>"), ("score", "double")]
    return common.map_texts(docs, find, fields, keep, text)


ship_by_value(__name__)
