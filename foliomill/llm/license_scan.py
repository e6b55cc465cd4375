"""License scans by template-markup matching.

A template is a line of words with markup: ``[[ ... ]]`` is optional, ``{n}`` is a replaceable region of
one to n words, ``{n:pattern}`` one whose words each match a pattern without spaces and braces. It is compiled into a token automaton, whose accepted texts hold every mandatory word in
order. Automata run from each place where a text has one of a template's first words; the longest
acceptance counts. Words are ASCII letters and digits (A-Z lower-cased) and all other non-ASCII bytes.

Base labels are plain phrases, found at every place where their words stand consecutively. Templates
add labels of their own: short notices (``-notice``) and whole licence texts or headers (``-text``). The score is the share of a text's
words that lie in an accepted phrase or template.

Defined cases: null counts as empty text: no words, no labels, score 0; ties and repeated rows each get
a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .words import as_bytes, chunks

#: Fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
AS_IS = "this software is provided by {12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {12} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
BSD_HEAD = "redistribution and use [[of this software]] in source and binary forms with or without modification are permitted [[subject to the limitations in the disclaimer below]] provided that the following conditions are met [[{1}]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[{1}]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
#: Short notices, and whole texts of licences: what must be said, what may be, and what names stand for.
TEMPLATES = {
    "apache-notice": "licensed under [[the terms of]] the apache license version {2:[0-9]+}",
    "cc-by-notice": "licensed under [[a]] [[the]] [[creative commons]] cc by [[nc]] [[sa]] [[nd]] {2:[0-9]+}",
    "gpl-notice": "licensed under the [[terms of the]] gnu [[lesser]] [[affero]] general public license [[as published by the free software foundation]] version {1:v?[0-9]+}",
    "mit-notice": "[[released]] [[licensed]] [[distributed]] under the [[terms of the]] mit license",
    "spdx-notice": "spdx license identifier {3}",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {8} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-2-clause-text": f"{BSD_HEAD} {AS_IS}",
    "bsd-3-clause-text": f"{BSD_HEAD} [[{{1}}]] neither the name of {{12}} nor the names of {{4}} contributors may be used to endorse or promote products derived from this software without specific prior written permission {AS_IS}",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {4} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {4} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "boost-text": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "zlib-text": "[[this software]] [[is]] provided as is without any express or implied warranty in no event will {4} be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[{1:[0-9]+}]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[{1:[0-9]+}]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[{1:[0-9]+}]] this notice may not be removed or altered from any source distribution",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    "mpl-header-text": "this source code form is subject to the terms of the mozilla public license v {2:[0-9]+} if a copy of the mpl was not distributed with this file you can obtain one at {8}",
    "apache-header-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {8} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-header-text": "free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation [[either]] version {1:v?[0-9]+} of the license [[or at your option any later version]] {6} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu [[lesser]] [[affero]] general public license for more details",
}
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Automaton:
    """States are places between tokens; each has word edges, wildcard edges and empty edges."""

    def __init__(self, template: str):
        self.word: list[dict[bytes, int]] = [{}]
        self.any: list[list[tuple[int, re.Pattern | None]]] = [[]]
        self.skip: list[list[int]] = [[]]
        state, opened = 0, []
        for token in re.findall(r"\[\[|\]\]|\{\d+(?::[^\s{}]+)?\}|[^\s\[\]{}]+", template):
            if token == "[[":
                opened.append(state)
            elif token == "]]":
                self.skip[opened.pop()].append(state)
            elif token[0] == "{":
                ends, (most, _, pattern) = [], token[1:-1].partition(":")
                for _ in range(int(most)):
                    new = self._new()
                    self.any[state].append((new, re.compile(pattern.encode()) if pattern else None))
                    state = new
                    ends.append(new)
                for e in ends[:-1]:
                    self.skip[e].append(state)
            else:
                new = self._new()
                self.word[state][token.encode()] = new
                state = new
        self.final = state
        self.firsts = {w for s in self._closure({0}) for w in self.word[s]}

    def _new(self) -> int:
        for x in (self.word, self.any, self.skip):
            x.append(type(x[0])())
        return len(self.word) - 1

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def longest(self, words: list[bytes], start: int) -> int:
        """Words of the longest acceptance that begins at start; 0 if there is none."""
        states, best, i = self._closure({0}), 0, start
        while states and i < len(words):
            w = words[i]
            states = self._closure({self.word[s][w] for s in states if w in self.word[s]} | {t for s in states for t, p in self.any[s] if p is None or p.fullmatch(w)})
            i += 1
            if self.final in states:
                best = i - start
        return best


@functools.cache
def _compiled() -> tuple[dict[str, Automaton], re.Pattern, dict[str, Automaton]]:
    phrases = {p: Automaton(p) for p in PHRASES}
    templates = {k: Automaton(t) for k, t in TEMPLATES.items()}
    firsts = sorted({w for a in [*phrases.values(), *templates.values()] for w in a.firsts})
    return phrases, re.compile(rb"(?<![a-z0-9\x80-\xff])(?:" + b"|".join(firsts) + rb")(?![a-z0-9\x80-\xff])"), templates


def scan_text(low: bytes, word_starts: np.ndarray, candidates: list[int]) -> dict:
    """Result for one lower-cased text whose words begin at word_starts; candidates are starts of first words."""
    phrases, _, templates = _compiled()
    words = re.findall(rb"[a-z0-9\x80-\xff]+", low)
    places, base, more = [], set(), set()
    cover = np.zeros(len(words), bool)
    for i in np.searchsorted(word_starts, candidates).tolist():
        for p, a in phrases.items():
            if words[i] in a.firsts and (n := a.longest(words, i)):
                places.append(i)
                base.add(PHRASES[p])
                cover[i : i + n] = True
        for k, a in templates.items():
            if words[i] in a.firsts and (n := a.longest(words, i)):
                more.add(k)
                cover[i : i + n] = True
    return {"n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | more)), "score": float(cover.mean()) if len(words) else 0.0}


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
EMPTY = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0}


def scan_batch(texts: list[bytes]) -> list[dict]:
    """Result for each text."""
    out, pattern = [], _compiled()[1]
    for lo, hi in chunks(texts):
        joined = (b"\n".join(texts[lo:hi]) + b"\n").lower()
        word = WORD[np.frombuffer(joined, np.uint8)]
        starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo) + 1)])
        edge = np.searchsorted(starts, first)
        found: dict[int, list[int]] = {}
        hits = np.fromiter((m.start() for m in pattern.finditer(joined)), np.int64)
        for at, doc in zip(hits.tolist(), (np.searchsorted(first, hits, "right") - 1).tolist(), strict=True):
            found.setdefault(doc, []).append(at - int(first[doc]))
        for d in range(hi - lo):
            r = EMPTY
            if d in found:
                r = scan_text(joined[first[d] : first[d + 1]], starts[edge[d] : edge[d + 1]] - first[d], found[d])
            out.append({"n_words": int(edge[d + 1] - edge[d]), **r})
    return out


def _scan(batches):
    for b in batches:
        rows = pa.array(scan_batch(as_bytes(b.column(1))), pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), *rows.flatten()], ["doc_id", *[f.name for f in rows.type]])


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id and the scan's result for every row."""
    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(_scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
