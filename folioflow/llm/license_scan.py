"""License notices found with template markup.

A template is wording with regions: ``<<beginOptional>> ... <<endOptional>>`` may be left
out, ``<<var;max=N>>`` stands for 0 to N arbitrary words (names, years). All other words are
mandatory and must match exactly, in order, with nothing between. Each template compiles to
a token automaton. Its anchor, the longest stretch of mandatory words, is looked for in all
words of a chunk at once; the automaton then runs from each hit, forwards over what follows
the anchor and backwards over what precedes it, and takes the longest match.

Base phrases are plain word sequences, counted at every place.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm._labels import Batches
from folioflow.llm._text import NOT_ALNUM, Words, chunks

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Wording of well-known notices, then of whole licenses and file headers, with markup; (label, template).
TEMPLATES = (
    ("mit", "<<beginOptional>>copyright <<var;max=8>><<endOptional>> permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under <<beginOptional>>the terms of<<endOptional>> the mit license"),
    ("apache-2", "licensed under the apache license version 2 <<beginOptional>>0<<endOptional>> <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>"),
    ("gpl-2", "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> 2 <<beginOptional>>or any later version<<endOptional>>"),
    ("gpl-3", "<<beginOptional>>this <<var;max=3>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> 3 <<beginOptional>>or any later version<<endOptional>>"),
    ("lgpl-3", "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu lesser general public license <<beginOptional>>version<<endOptional>> 3"),
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc <<beginOptional>>4 0<<endOptional>>"),
    ("cc-by-sa", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by sa <<beginOptional>>4 0<<endOptional>>"),
    ("cc-by", "licensed under <<beginOptional>>a<<endOptional>> creative commons attribution <<beginOptional>>4 0<<endOptional>> <<beginOptional>>international<<endOptional>> license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "<<beginOptional>>copyright <<var;max=8>> all rights reserved<<endOptional>> redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "<<beginOptional>><<beginOptional>>the<<endOptional>> mit license<<endOptional>> <<beginOptional>>copyright <<var;max=8>><<endOptional>> permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-2", "<<beginOptional>>copyright <<var;max=8>> <<beginOptional>>all rights reserved<<endOptional>><<endOptional>> redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by <<var;max=6>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;max=6>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-3", "<<beginOptional>>copyright <<var;max=8>> <<beginOptional>>all rights reserved<<endOptional>><<endOptional>> redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>>3<<endOptional>> neither the name of <<var;max=6>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by <<var;max=6>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;max=6>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "<<beginOptional>>isc license<<endOptional>> <<beginOptional>>copyright <<var;max=8>><<endOptional>> permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "<<beginOptional>>copyright <<var;max=8>><<endOptional>> this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<beginOptional>>1<<endOptional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<beginOptional>>2<<endOptional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<beginOptional>>3<<endOptional>> this notice may not be removed or altered from any source distribution"),
    ("apache-2", "<<beginOptional>>copyright <<var;max=8>><<endOptional>> licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version <<beginOptional>>this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details<<endOptional>>"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)

Step = tuple[str, int]


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), NOT_ALNUM, lower=True).hashes()


class Automaton:
    """Steps ("word", hash), ("any", _) and ("skip", target) with an anchor of plain words."""

    def __init__(self, label: str, template: str):
        self.label = label
        parts = re.findall(r"<<[^>]*>>|[^<]+", template)
        steps: list[Step] = []
        opened: list[int] = []
        for part in parts:
            if part == "<<beginOptional>>":
                opened.append(len(steps))
                steps.append(("skip", -1))
            elif part == "<<endOptional>>":
                steps[opened[-1]] = ("skip", len(steps))
                opened.pop()
            elif part.startswith("<<var"):
                most = int(re.search(r"max=(\d+)", part)[1])
                end = len(steps) + 2 * most
                for _ in range(most):
                    steps += [("skip", end), ("any", 0)]
            else:
                steps += [("word", int(h)) for h in word_hashes(part)]
        # The longest run of words outside all optional regions.
        depth, cover = np.zeros(len(steps) + 1, int), 0
        for i, (kind, to) in enumerate(steps):
            if kind == "skip":
                depth[i] += 1
                depth[to] -= 1
        plain = [kind == "word" and d == 0 for (kind, _), d in zip(steps, np.cumsum(depth))]
        best = (0, 0)
        for i, ok in enumerate(plain):
            cover = cover + 1 if ok else 0
            best = max(best, (cover, i + 1))
        size, end = best
        self.anchor = np.array([h for _, h in steps[end - size : end]], np.uint64)
        self.after = [(kind, to - end if kind == "skip" else to) for kind, to in steps[end:]]
        head = steps[: end - size]
        # The same steps from right to left: a skip then leads over its region from the other side.
        turned: list[list[Step]] = [[s] if s[0] != "skip" else [] for s in head]
        skips = {i: to for i, (kind, to) in enumerate(head) if kind == "skip"}
        order: list[tuple[str, int, int]] = []
        for i in range(len(head), -1, -1):
            order += [("skip", i, a) for a, to in skips.items() if to == i]
            if i and turned[i - 1]:
                order.append((*turned[i - 1][0], -1))
            elif i:
                order.append(("mark", i - 1, -1))
        place = {a: n for n, (kind, a, _) in enumerate(order) if kind == "mark"}
        self.before: list[Step] = [("skip", place[a]) if kind == "skip" else ("skip", n + 1) if kind == "mark" else (kind, h) for n, (kind, h, a) in enumerate(order)]
        self.mandatory = sum(plain)

    @staticmethod
    def run(steps: list[Step], words: np.ndarray) -> int:
        """Most words from the front of ``words`` that end the automaton, or -1."""

        def closed(states: set[int]) -> set[int]:
            todo, done = list(states), set(states)
            while todo:
                s = todo.pop()
                if s < len(steps) and steps[s][0] == "skip":
                    for t in (s + 1, steps[s][1]):
                        if t not in done:
                            done.add(t)
                            todo.append(t)
            return done

        states = closed({0})
        best = 0 if len(steps) in states else -1
        for n, w in enumerate(words.tolist(), 1):
            states = closed({s + 1 for s in states if s < len(steps) and (steps[s][0] == "any" or steps[s] == ("word", w))})
            if not states:
                break
            if len(steps) in states:
                best = n
        return best

    def matches(self, h: np.ndarray, doc: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, start, end) in words of the chunk."""
        out = []
        for at in places(h, doc, self.anchor).tolist():
            d = doc[at]
            end = at + len(self.anchor)
            more = self.run(self.after, h[end : min(first[d + 1], end + len(self.after))])
            less = self.run(self.before, h[max(first[d], at - len(self.before)) : at][::-1])
            if more >= 0 and less >= 0:
                out.append((int(d), at - less, end + more))
        return out


def places(h: np.ndarray, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Positions where the words of ``phrase`` stand consecutively in one document."""
    n = len(h) - len(phrase) + 1
    if n <= 0 or not len(phrase):
        return np.empty(0, np.int64)
    # The rarest looking word first: usually nothing is left to compare after it.
    at = np.flatnonzero(h[len(phrase) - 1 :][:n] == phrase[-1])
    for j in range(len(phrase) - 1):
        at = at[h[at + j] == phrase[j]]
    return at[doc[at] == doc[at + len(phrase) - 1]] if len(at) else at


def _scan(batches: Batches) -> Batches:
    phrases = [(word_hashes(p), label) for p, label in PHRASES.items()]
    automata = [Automaton(label, t) for label, t in TEMPLATES]
    for rows, data, offsets in chunks(batches):
        w = Words(data, offsets, NOT_ALNUM, lower=True)
        h, doc, n = w.hashes(), w.doc, rows.num_rows
        count = np.zeros(n, np.int64)
        low, high = np.full(n, 2**62), np.full(n, -1)
        base: list[set[str]] = [set() for _ in range(n)]
        found: list[list[dict]] = [[] for _ in range(n)]
        strongest = np.zeros(n, np.int64)
        for phrase, label in phrases:
            at = places(h, doc, phrase)
            d = doc[at]
            np.add.at(count, d, 1)
            np.minimum.at(low, d, at - w.first[d])
            np.maximum.at(high, d, at - w.first[d])
            np.maximum.at(strongest, d, len(phrase))
            for x in np.unique(d).tolist():
                base[x].add(label)
        for a in automata:
            for d, s, e in a.matches(h, doc, w.first):
                found[d].append({"label": a.label, "start": s - int(w.first[d]), "end": e - int(w.first[d])})
                strongest[d] = max(strongest[d], a.mandatory)
        none = count == 0
        yield pa.record_batch({
            "doc_id": rows.column("doc_id"), "n_words": pa.array(w.count.astype(np.int64)), "n_base": pa.array(count), "first_word": pa.array(low, mask=none), "last_word": pa.array(high, mask=none),
            "base_labels": pa.array([sorted(b) for b in base], pa.list_(pa.string())), "matches": pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
            "score": pa.array(1 - 0.85 ** strongest.astype(float)),
        })


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, matches, score) per row.

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. The base
    columns count the places of the phrases, with the smallest and largest start (words from
    0, null if there is none). ``matches`` lists template matches as word spans [start, end).
    ``score`` is 1 - 0.85 ** (most mandatory words that matched), 0 without a match. Null and
    empty texts have no words. Repeated rows repeat, null ids are kept, extra columns are
    ignored, and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, matches array<struct<label:string,start:long,end:long>>, score double")
