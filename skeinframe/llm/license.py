"""License scans with token automata compiled from template markup.

A template is mandatory words with marked regions:
  <<beginOptional>> ... <<endOptional>>   may be left out; regions nest
  <<var;match=M-N>>                       replaceable: any M to N words
  <<alt;A|B>>                             one of these words
compile_template() turns it into a nondeterministic automaton over words. A text is
accepted at a place if its words from there on are the mandatory ones, exactly.
Templates are whole license texts, the notices that stand for long ones, and short
references. Automata start only at pairs of words that can begin a template, which are
found with numpy for whole batches; no row is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.llm import _common

# Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Wordings of licenses, notices and references, with the label each stands for.
MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software"
BSD_GRANT = "redistribution and use <<beginOptional>> of this software <<endOptional>> in source and binary forms with or without modification are permitted"
TEMPLATES = (
    # whole texts
    (f"{MIT_GRANT} and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>> including the next paragraph <<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;match=1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    ("permission to use copy modify and <<alt;or|distribute>> <<beginOptional>> distribute <<endOptional>> this software for any purpose with or without fee is hereby granted <<beginOptional>> provided that the above copyright notice and this permission notice appear in all copies <<endOptional>> the software is provided as is and <<var;match=1-8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;match=1-8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "isc"),
    (f"{BSD_GRANT} provided that the following conditions are met <<beginOptional>> <<alt;1|a>> <<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>> <<alt;2|b>> <<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>> <<beginOptional>> <<alt;3|c>> <<endOptional>> neither the name of <<var;match=1-12>> nor the names of <<alt;its|the>> <<beginOptional>> copyright holders and <<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission <<endOptional>> this software is provided by <<var;match=1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;match=1-14>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "bsd"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<beginOptional>> 1 <<endOptional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<beginOptional>> 2 <<endOptional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<beginOptional>> 3 <<endOptional>> this notice may not be removed or altered from any source distribution", "zlib"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law", "unlicense"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following", "boost"),
    # notices that stand for a license
    ("licensed under the apache license version 2 0 the license you may not use this <<alt;file|work|software>> except in compliance with the license you may obtain a copy of the license at <<var;match=1-10>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache-2"),
    ("apache license version 2 0 january 2004 <<beginOptional>> http www apache org licenses <<endOptional>> terms and conditions for use reproduction and distribution", "apache-2"),
    ("this <<alt;program|library|file>> is free software <<beginOptional>> you can <<endOptional>> <<beginOptional>> redistribute it and or modify it under the terms of <<endOptional>> the gnu <<beginOptional>> <<alt;lesser|library|affero>> <<endOptional>> general public license as published by the free software foundation either version 3 of the license or <<beginOptional>> at your option <<endOptional>> any later version", "gpl-3"),
    ("this <<alt;program|library|file>> is free software <<beginOptional>> you can <<endOptional>> <<beginOptional>> redistribute it and or modify it under the terms of <<endOptional>> the gnu <<beginOptional>> <<alt;lesser|library>> <<endOptional>> general public license as published by the free software foundation either version 2 <<beginOptional>> <<alt;0|1>> <<endOptional>> of the license or <<beginOptional>> at your option <<endOptional>> any later version", "gpl-2"),
    ("gnu <<beginOptional>> <<alt;lesser|affero>> <<endOptional>> general public license version 3 <<var;match=2-3>> copyright <<var;match=1-6>> free software foundation inc", "gpl-3"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2"),
    # parts and references
    (f"{MIT_GRANT} <<var;match=0-6>> to deal in the software without restriction", "mit"),
    ("<<alt;released|licensed|distributed|available>> under the <<beginOptional>> terms of the <<endOptional>> mit license", "mit"),
    ("licensed under the apache license <<beginOptional>> version <<endOptional>> <<alt;2|v2>>", "apache-2"),
    ("licensed under the gnu <<beginOptional>> <<alt;lesser|affero>> <<endOptional>> general public license <<beginOptional>> as published by the free software foundation <<beginOptional>> either <<endOptional>> <<endOptional>> version 3", "gpl-3"),
    ("licensed under the gnu <<beginOptional>> lesser <<endOptional>> general public license <<beginOptional>> as published by the free software foundation <<beginOptional>> either <<endOptional>> <<endOptional>> version 2", "gpl-2"),
    (BSD_GRANT, "bsd"),
    ("<<alt;released|licensed|distributed|available>> under the <<beginOptional>> <<alt;2|3>> clause <<endOptional>> bsd <<beginOptional>> <<alt;2|3>> clause <<endOptional>> license", "bsd"),
    ("subject to the terms of the mozilla public license <<beginOptional>> v <<endOptional>> <<beginOptional>> version <<endOptional>> 2", "mpl-2"),
    ("licensed under <<beginOptional>> <<alt;a|the>> <<endOptional>> <<alt;cc|creative>> <<beginOptional>> commons <<endOptional>> <<alt;by|attribution>> <<alt;nc|noncommercial>> <<beginOptional>> <<alt;sa|sharealike|nd>> <<endOptional>> <<beginOptional>> <<var;match=0-2>> license <<endOptional>>", "cc-by-nc"),
    ("licensed under <<beginOptional>> <<alt;a|the>> <<endOptional>> <<alt;cc|creative>> <<beginOptional>> commons <<endOptional>> <<alt;by|attribution>> <<alt;sa|sharealike>>", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)

_PART = re.compile(r"<<(.*?)>>|([^\s<>]+)")
ANY = 0


class Automaton:
    """moves[state]: (word hash, or ANY, next state); state 0 is first; a run that reaches `final` accepts."""

    def __init__(self, markup: str):
        skips: list[list[int]] = [[]]
        moves: list[list[tuple[int, int]]] = [[]]

        def new() -> int:
            skips.append([])
            moves.append([])
            return len(moves) - 1

        at, opened = 0, []
        for mark, word in _PART.findall(markup):
            kind, _, rest = mark.partition(";")
            if kind == "beginOptional":
                opened.append(at)
            elif kind == "endOptional":
                begin, at_end = opened.pop(), at
                at = new()
                skips[begin].append(at)
                skips[at_end].append(at)
            elif kind == "var":
                least, most = map(int, rest.removeprefix("match=").split("-"))
                end = new()
                for n in range(most + 1):
                    if n >= least:
                        skips[at].append(end)
                    if n < most:
                        after = new()
                        moves[at].append((ANY, after))
                        at = after
                at = end
            else:
                after = new()
                moves[at] += [(_common.word_hash(w), after) for w in (rest.split("|") if kind == "alt" else [word])]
                at = after
        if opened:
            raise ValueError(f"an optional region isn't closed: {markup}")
        self.final = at
        self.moves = moves
        self.reach = [self._closure(s, skips) for s in range(len(moves))]

    @staticmethod
    def _closure(state: int, skips: list[list[int]]) -> frozenset[int]:
        seen, stack = {state}, [state]
        while stack:
            for t in skips[stack.pop()]:
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        return frozenset(seen)

    def pairs(self) -> set[tuple[int, int]]:
        """The first two words of its texts; the second is ANY where it may be any, or missing."""
        out = set()
        for word, state in (m for s in self.reach[0] for m in self.moves[s]):
            nexts = {w for s in self.reach[state] for w, _ in self.moves[s]}
            out |= {(word, ANY)} if ANY in nexts or self.final in self.reach[state] else {(word, w) for w in nexts}
        return out

    def accepts(self, words: list[int]) -> bool:
        """Whether a prefix of words is one of the template's texts."""
        states = self.reach[0]
        for w in words:
            if self.final in states:
                return True
            states = frozenset(t for s in states for v, n in self.moves[s] if v in (w, ANY) for t in self.reach[n])
            if not states:
                return False
        return self.final in states

    def longest(self) -> int:
        """An upper bound of the words that a run reads."""
        return len(self.moves)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _common.mix(first + second * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=8)
def compiled(base: tuple, templates: tuple) -> tuple[list[tuple[Automaton, str, bool]], np.ndarray, dict[int, list[int]], int]:
    """Automata with label and base flag; the keys of pairs of words that begin one, in order; the automata by such key; words that the longest run reads."""
    automata = [(Automaton(markup), label, i < len(base)) for i, (markup, label) in enumerate((*base, *templates))]
    by_pair: dict[int, list[int]] = {}
    for i, (automaton, _, _) in enumerate(automata):
        pairs = automaton.pairs()
        if automaton.final in automaton.reach[0] or any(w == ANY for w, _ in pairs):
            raise ValueError("a template must begin with a mandatory word")
        for key in pair_keys(*(np.array(x, np.uint64) for x in zip(*pairs, strict=True))).tolist():
            by_pair.setdefault(key, []).append(i)
    return automata, np.array(sorted(by_pair), np.uint64), by_pair, max(a.longest() for a, _, _ in automata)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE, templates: tuple = TEMPLATES) -> DataFrame:
    """A row per document: the id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Places count words from 0. labels holds those of all accepted templates, base phrases among them. score is 1 if a full
    template is accepted, 0.5 if base phrases alone are, else 0.
    Cases: a null text is an empty one: no words, empty labels; any id, null or repeated, is passed on; an empty table
    gives no rows; other columns are ignored.
    """
    _common.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, begins, by_pair, longest = compiled(base, templates)
        for batch in batches:
            for i, j, buf, off in _common.text_chunks(batch.column(1)):
                low = _common.lowered(buf)
                start, end, first = _common.word_bounds(low, off)
                words = _common.byte_spans(low).hash(start, end)
                starts_at: dict[int, list[int]] = {}
                for keys in (pair_keys(words[:-1], words[1:]), pair_keys(words, np.full(len(words), ANY, np.uint64))):
                    at = np.minimum(np.searchsorted(begins, keys), len(begins) - 1)
                    for place in np.flatnonzero(begins[at] == keys).tolist():
                        starts_at.setdefault(place, []).extend(by_pair[int(keys[place])])
                places = np.array(sorted(starts_at), np.int64)
                owner = np.searchsorted(first, places, "right") - 1
                n = j - i
                count, found, labels, full = [0] * n, [None] * n, [set() for _ in range(n)], [False] * n
                base_labels = [set() for _ in range(n)]
                for place, text in zip(places.tolist(), owner.tolist(), strict=True):
                    ahead = words[place : min(place + longest, int(first[text + 1]))].tolist()
                    for k in starts_at[place]:
                        automaton, label, is_base = automata[k]
                        if automaton.accepts(ahead):
                            labels[text].add(label)
                            if is_base:
                                base_labels[text].add(label)
                                count[text] += 1
                                where = place - int(first[text])
                                found[text] = (found[text][0] if found[text] else where, where)
                            else:
                                full[text] = True
                score = [1.0 if f else 0.5 if b else 0.0 for f, b in zip(full, base_labels, strict=True)]
                joined = [pa.array([",".join(sorted(x)) for x in sets], pa.string()) for sets in (base_labels, labels)]
                ends = [pa.array([f and f[e] for f in found], pa.int64()) for e in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(np.diff(first)), pa.array(count, pa.int64()), *ends, *joined, pa.array(score, pa.float64())], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = f"id {kind.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(scanned, schema).withColumnRenamed("id", id_col)
