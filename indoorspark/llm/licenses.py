"""License scans (operator 9): generalised suffix automaton of licence tokens."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from indoorspark.llm.common import table
from indoorspark.llm.words import text_groups

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Public licences whole (their permission, conditions and disclaimer), or the notice that a longer one asks files to carry.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
    "lgpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details you should have received a copy of the gnu lesser general public license along with this program if not see https www gnu org licenses",
    "agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details you should have received a copy of the gnu affero general public license along with this program if not see https www gnu org licenses",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "reserved": "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
}
# Licences by the names that one-line notices give them.
NAMES = {
    "mit": ("mit license", "mit"),
    "apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0"),
    "bsd": ("bsd license", "bsd 2 clause license", "bsd 3 clause license", "bsd 2 clause", "bsd 3 clause"),
    "gpl-2.0": ("gnu general public license version 2", "gnu general public license v2", "gpl 2 0 only", "gpl 2 0 or later"),
    "gpl-3.0": ("gnu general public license version 3", "gnu general public license v3", "gpl 3 0 only", "gpl 3 0 or later"),
    "lgpl": ("gnu lesser general public license", "lgpl 2 1 only", "lgpl 3 0 only"),
    "agpl": ("gnu affero general public license", "agpl 3 0 only"),
    "mpl-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "isc": ("isc license",),
    "cc-by": ("cc by 4 0", "creative commons attribution 4 0"),
    "cc-by-sa": ("cc by sa 4 0", "cc by sa 3 0", "creative commons attribution sharealike 4 0"),
    "cc-by-nc": ("cc by nc 4 0", "cc by nc 3 0", "creative commons attribution noncommercial 4 0"),
    "cc-by-nc-sa": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0"),
    "cc-by-nd": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0"),
    "cc0": ("cc0 1 0", "cc0 1 0 universal"),
}
LEADS = ("released under", "licensed under", "distributed under", "published under", "available under", "covered by")


def notices() -> list[tuple[str, str]]:
    """(label, words) of one-line notices: each lead, with and without the article, before each name; and SPDX lines."""
    return [(k, f"{lead} {name}") for k, names in NAMES.items() for name in names for lead in (*LEADS, *(f"{x} the" for x in LEADS), *(f"{x} a" for x in LEADS), "spdx license identifier")]


#: Bytes that separate words become spaces, A-Z become a-z; bytes from 128 on belong to words.
TABLE = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if 65 <= b < 91 else b for b in range(256))


class Automaton:
    """Generalised suffix automaton over word ids; state 0 is the root."""

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[dict[int, int]] = [{}]
        for t, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                ends += [{} for _ in range(len(self.step) - len(ends))]
                ends[last].setdefault(t, i + 1)
        places: list[dict[int, set[int]]] = [{t: {e} for t, e in found.items()} for found in ends]
        # What ends in a state ends in its suffixes too: pass the ends up, longest states first.
        for s in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            for t, found in places[s].items():
                places[self.link[s]].setdefault(t, set()).update(found)
        #: By state and sequence, all places where the state's strings end, and the first of them.
        self.places = [{t: sorted(found) for t, found in of.items()} for of in places]
        self.ends = [{t: found[0] for t, found in of.items()} for of in self.places]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the shorter strings that reach it from p by c."""
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def matches(self, ids: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, state) of each longest match of `least` words or more that the next word doesn't extend."""
        state = n = 0
        step, link, length = self.step, self.link, self.length
        for i, c in enumerate(ids):
            if c >= 0 and (to := step[state].get(c)) is not None:
                state, n = to, n + 1
                continue
            if n >= least:
                yield i - n, i, state
            if c < 0:
                state = n = 0
                continue
            while state and c not in step[state]:
                state = link[state]
                n = length[state]
            if (to := step[state].get(c)) is not None:
                state, n = to, n + 1
        if n >= least:
            yield len(ids) - n, len(ids), state


class Scanner:
    """Labels of a text by templates, one-line notices and phrases. least: words of a match that counts; gap: words between
    chained matches; share: covered part of a template (of its words) that gives its label. A notice must be there whole."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: int = 4, gap: int = 40, share: float = 0.5):
        every = [(k, words, share) for k, words in templates.items()] + [(k, words, 1.0) for k, words in notices()]
        self.names, self.shares, self.least, self.gap = [k for k, _, _ in every], [x for _, _, x in every], least, gap
        self.whole = len(templates)
        self.ids: dict[bytes, int] = {}
        seqs = [[self.ids.setdefault(w.encode(), len(self.ids)) for w in words.split()] for _, words, _ in every]
        self.sizes = [len(s) for s in seqs]
        self.phrases = [([self.ids.setdefault(w.encode(), len(self.ids)) for w in p.split()], label) for p, label in phrases.items()]
        self.automaton = Automaton(seqs)

    def spans(self, ids: list[int]) -> list[tuple[int, int, int, float]]:
        """(number of the template, first word, word after the last, covered share of the template): chains of long matches in the
        template's order. A match goes on with the chain within `gap` words that covers most and that it can follow at one of its
        places, or begins one of its own: a clause that stands twice in a template breaks no chain."""
        open_, done = defaultdict(list), []
        for start, end, state in self.automaton.matches(ids, self.least):
            n = end - start
            for t, places in self.automaton.places[state].items():
                near = [c for c in open_[t] if start - c[1] <= self.gap]
                done += [(t, c) for c in open_[t] if start - c[1] > self.gap]
                fits = [(-c[3], k, e) for k, c in enumerate(near) if (e := next((e for e in places if e - n >= c[2] - self.least), None))]
                if fits:
                    _, k, e = min(fits)
                    first, _, to, words = near.pop(k)
                    near.append((first, end, max(e, to), words + max(0, min(n, e - to))))
                else:
                    near.append((start, end, places[0], n))
                open_[t] = near
        done += [(t, c) for t, chains in open_.items() for c in chains]
        return sorted((t, c[0], c[1], min(1.0, c[3] / self.sizes[t])) for t, c in done)

    def best(self, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Of templates whose spans share words (licences repeat each other's clauses) the one that covers most words, then the one
        covered most, then the first; a notice has no rival. Only spans that give their label are asked for."""
        given = [s for s in spans if s[3] >= self.shares[s[0]]]
        kept = []
        for s in sorted((s for s in given if s[0] < self.whole), key=lambda s: (-round(s[3] * self.sizes[s[0]]), -s[3], s[0], s[1])):
            if all(s[2] <= k[1] or k[2] <= s[1] for k in kept):
                kept.append(s)
        return sorted([*kept, *(s for s in given if s[0] >= self.whole)])

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = text.translate(TABLE).split()
        get = self.ids.get
        ids = [get(w, -1) for w in words]
        places, base = defaultdict(int), set()
        for phrase, label in self.phrases:
            at, head, k = -1, phrase[0], len(phrase)
            while True:
                try:
                    at = ids.index(head, at + 1)
                except ValueError:
                    break
                if ids[at : at + k] == phrase:
                    places[at] += 1
                    base.add(label)
        found = self.spans(ids)
        labels = base | {self.names[t] for t, *_ in self.best(found)}
        score = max([1.0 if base else 0.0, *(share for *_, share in found)])
        return len(words), sum(places.values()), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_rows(docs: DataFrame, **settings) -> DataFrame:
    """One row per document. Null or empty text: no words, empty labels, null places, score 0.

    Repeated rows give repeated results; other columns are ignored; an empty table gives no rows. Texts of any length are
    read whole. Of equally good matches of a template the first counts.
    The automaton (some thousand states, whatever the input) is built once in each task.
    """

    def run(batches):
        scanner = Scanner(**settings)
        for batch, texts in ((b.slice(at, len(texts)), texts) for b in batches for at, texts in text_groups(b.column(1))):
            rows = [scanner.scan(t.encode()) for t in texts]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_rows(table(spark, sf_dir, "documents"))
