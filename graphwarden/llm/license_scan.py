"""Licence scan: which licence phrases and licence texts stand in a document, and where.

The words of all templates and phrases are put into one generalised suffix automaton. A text is streamed
through it word by word, which gives for each place the longest run of words ending there that some
template has (its matching statistics). A phrase stands where the automaton's state holds it whole. Runs
of LONGEST_GAP words apart at most that follow each other in a template are chained, and a chain that
covers enough of its template is a span of it: so wrapped, commented or slightly edited licences are found.

The automaton grows with the templates alone and is broadcast (templates are a parameter, some 1,500
words here); a document's state is one number, the open chains and the spans found.

A null text counts as empty, and a text without words has no span and a score of 0. Rows are judged one
by one, so repeated rows give equal rows. Of spans that overlap the one covering more words stays, then
the one that starts first, then the one with the lesser label. Columns other than doc_id and text are left
out, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwarden.llm.textbatch import id_text

#: Words of lower-cased UTF-8: digits, letters and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of public licences and of the notices that refer to them.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal
        in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of
        the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
        express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out
        of or in connection with the software or the use or other dealings in the software""",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the
        license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing
        permissions and limitations under the license""",
    ],
    "gpl": [
        "licensed under the gnu general public license version",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
        software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful
        but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for
        more details you should have received a copy of the gnu general public license along with this program""",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version",
        """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free
        software foundation either version 2 1 of the license or at your option any later version""",
    ],
    "mpl-2.0": [
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain
        one at http mozilla org mpl 2 0""",
    ],
    "isc": [
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
        notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this
        software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or
        consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
        action arising out of or in connection with the use or performance of this software""",
    ],
    "bsd-2-clause": [
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form
        must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with
        the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited
        to the implied warranties of merchantability and fitness for a particular purpose are disclaimed""",
    ],
    "bsd-3-clause": [
        """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission""",
    ],
    "zlib": [
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use
        of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute
        it freely subject to the following restrictions""",
    ],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc-by-nc": ["licensed under cc by nc", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
}

#: Words that a run must have to take part in a chain, and words between two runs of one chain at most.
LONG, LONGEST_GAP = 4, 12
#: A chain is a span if it covers this share of its template, or so many words of it.
SHARE, PASSAGE = 0.8, 30


class Automaton:
    """A generalised suffix automaton of word sequences, with the phrases and the template places that each state stands for."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: dict[int, list[tuple[int, int]]] = {}
        self.labels, self.sizes = [], []
        for label, texts in templates.items():
            for text in texts:
                words = WORD.findall(text.lower().encode())
                for k, state in enumerate(self._add(words)):
                    own.setdefault(state, []).append((len(self.sizes), k + 1))
                self.labels.append(label)
                self.sizes.append(len(words))
        held: dict[int, list[tuple[int, str]]] = {}
        for phrase, label in phrases.items():
            words = WORD.findall(phrase.lower().encode())
            # the state of a phrase may be split while others are added, so it is looked up at the end
            self._add(words)
        for phrase, label in phrases.items():
            words, state = WORD.findall(phrase.lower().encode()), 0
            for w in words:
                state = self.next[state][w]
            held.setdefault(state, []).append((len(words), label))
        # the states of template places likewise: prefixes of a sequence never change their state, but its ancestors do
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: phrases that end where a state is reached with so many words matched; a suffix link leads to the shorter ones
        self.phrases: list[tuple] = [()] * len(self.link)
        for v in by_length:
            self.phrases[v] = (*held.get(v, ()), *self.phrases[self.link[v]])
        places: list[set] = [set() for _ in self.link]
        for v in reversed(by_length):
            if self.length[v] >= LONG:
                places[v].update(own.get(v, ()))
                places[self.link[v]].update(places[v])
        #: (template, words up to the end) wherever a state's words stand in a template
        self.places = [tuple(sorted(x)) if n >= LONG else () for x, n in zip(places, self.length, strict=True)]

    def _add(self, words: list[bytes]) -> list[int]:
        """Put a sequence in; the states of its prefixes."""
        last, states = 0, []
        for w in words:
            last = self._extend(last, w)
            states.append(last)
        return states

    def _extend(self, last: int, w: bytes) -> int:
        at = self.next[last].get(w)
        if at is not None:
            return at if self.length[at] == self.length[last] + 1 else self._split(last, w, at)
        new = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: bytes, q: int) -> int:
        """Part the shorter words of q, which p reaches by w, from its longer ones."""
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def stream(self, words):
        """(words read, phrases found as (start, label), spans as (start, end, label, share)) of a stream of words."""
        step, link, length, phrases, places = self.next, self.link, self.length, self.phrases, self.places
        first = step[0]
        state = matched = 0
        i, found, chains = -1, [], Chains(self)
        for i, match in enumerate(words):
            w = match.group()
            if not state:
                state = first.get(w, 0)
                if not state:
                    continue
                matched = 1
            else:
                to = step[state].get(w)
                if to is None:
                    if matched >= LONG:
                        chains.add(i, matched, places[state])
                    while to is None and state:
                        state = link[state]
                        to = step[state].get(w)
                    matched = length[state]
                if to is None:
                    matched = 0
                    continue
                state, matched = to, matched + 1
            for size, label in phrases[state]:
                if size <= matched:
                    found.append((i + 1 - size, label))
        if matched >= LONG:
            chains.add(i + 1, matched, places[state])
        return i + 1, found, chains.finish()


class Chains:
    """Runs of template words chained as they come; what can grow no more leaves."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        #: template: open chains [start, end, end in the template, words covered, whether a longer chain has it]
        self.open: dict[int, list[list]] = {}
        self.done: list[tuple[int, int, int, int]] = []  # (words covered, start, end, template)

    def add(self, end: int, size: int, places) -> None:
        for template, at in places:
            chains = self._settle(template, end - size)
            best, gain = None, size
            for chain in chains:
                over = max(chain[1] - (end - size), chain[2] - (at - size), 0)
                ahead = at - size - chain[2]
                if over < size and ahead <= LONGEST_GAP and chain[3] + size - over > gain and chain[1] < end and chain[2] < at:
                    best, gain = chain, chain[3] + size - over
            chains.append([end - size if best is None else best[0], end, at, gain, False])
            if best is not None:
                best[4] = True

    def _settle(self, template: int, start: int) -> list[list]:
        """The template's chains that a run from start may still continue; the others are judged."""
        chains = self.open.setdefault(template, [])
        if chains and min(c[1] for c in chains) + LONGEST_GAP < start:
            for chain in chains:
                if chain[1] + LONGEST_GAP < start:
                    self._judge(template, chain)
            chains[:] = [c for c in chains if c[1] + LONGEST_GAP >= start]
        return chains

    def _judge(self, template: int, chain: list) -> None:
        if not chain[4] and (chain[3] >= PASSAGE or chain[3] >= SHARE * self.automaton.sizes[template]):
            self.done.append((chain[3], chain[0], chain[1], template))

    def finish(self) -> list[tuple[int, int, str, float]]:
        for template, chains in self.open.items():
            for chain in chains:
                self._judge(template, chain)
        automaton, out = self.automaton, []
        for covered, start, end, template in sorted(self.done, key=lambda x: (-x[0], x[1], automaton.labels[x[3]], x[3])):
            k = bisect(out, (start, end))
            if (k == 0 or out[k - 1][1] <= start) and (k == len(out) or out[k][0] >= end):
                out.insert(k, (start, end, automaton.labels[template], min(covered / automaton.sizes[template], 1.0)))
        return out


SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType(), False) for c in ("n_words", "n_base")), *(T.StructField(c, T.LongType()) for c in ("first_word", "last_word"))]
    + [*(T.StructField(c, T.StringType(), False) for c in ("base_labels", "labels")), T.StructField("score", T.DoubleType(), False), T.StructField("spans", T.StringType(), False)]
)


def judge(automaton: Automaton, text: bytes) -> tuple:
    """The columns of a text but its doc_id. score: the greatest share of a template that one span covers, and 1 where a base phrase stands."""
    n, base, spans = automaton.stream(WORD.finditer(text.lower()))
    starts = [s for s, _ in base]
    base_labels = {x for _, x in base}
    labels = base_labels | {x for _, _, x, _ in spans}
    score = max([share for *_, share in spans] + [1.0 if base else 0.0])
    told = ",".join(f"{label}:{s}:{e}" for s, e, label, _ in spans)
    return n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, told


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Words, base phrases, labels, score and template spans (label:first word:end, end exclusive) of every whole text; one row each, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(phrases, templates))

    def run(batches):
        automaton = shared.value
        for batch in batches:
            rows = [(doc_id.as_py(), *judge(automaton, text.as_py() or b"")) for doc_id, text in zip(batch.column(0), batch.column(1), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(),) * 5 + (pa.string(),) * 2 + (pa.float64(), pa.string()), strict=True)], names=SCHEMA.names)

    return id_text(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)
