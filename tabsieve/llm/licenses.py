"""License scans by template-markup matching.

A template is wording with markup: ``[[...]]`` may be left out (and may nest), ``{{low-high}}`` stands
for any ``low`` to ``high`` words.  A template is compiled to an automaton over words; a text has the
template's label where the automaton accepts a run of its words, that is, where all mandatory wording
stands word for word and only optional regions are missing.

The automaton is kept as sets of positions (the literals and free words of the template, in order): the
positions that may come first, those that may follow each, and those that may come last.  It is run
from every word that can begin a template, and each step looks at one word, so a text is read once per
match attempt and never copied.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve._ship import ship_by_value
from tabsieve.llm.common import texts, with_struct

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # on UTF-8: every byte of a non-ASCII letter is from 80 on
_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)-(\d+)\}\}|[^\s\[\]{}]+")


@dataclass
class Automaton:
    """Positions of one template: ``word`` is None for a free word."""

    label: str
    base: bool
    words: list[bytes | None] = field(default_factory=list)
    first: set[int] = field(default_factory=set)
    last: set[int] = field(default_factory=set)
    follow: dict[int, set[int]] = field(default_factory=dict)

    def matches(self, text: list[bytes], at: int) -> int:
        """Length of the longest run that is accepted from word ``at``; 0 if none is."""
        now, longest, k = self.first, 0, at
        while now and k < len(text):
            here = {p for p in now if self.words[p] is None or self.words[p] == text[k]}
            k += 1
            if here & self.last:
                longest = k - at
            now = set().union(*(self.follow[p] for p in here)) if here else here
        return longest


def compile_template(label: str, template: str, base: bool = False) -> Automaton:
    """Compile one template.  It must begin with a word (a match is looked for at that word), and its
    optional regions must be closed."""
    out = Automaton(label, base)
    ends: set[int] = set()  # positions the next one may follow
    may_start = True  # nothing mandatory so far
    open_regions: list[tuple[set[int], bool]] = []

    def add(word: bytes | None) -> None:
        nonlocal ends, may_start
        p = len(out.words)
        out.words.append(word)
        out.follow[p] = set()
        for e in ends:
            out.follow[e].add(p)
        if may_start:
            out.first.add(p)
        ends, may_start = {p}, False

    for mark in _MARK.finditer(template):
        if mark.group() == "[[":
            open_regions.append((set(ends), may_start))
        elif mark.group() == "]]":
            before, started = open_regions.pop()
            ends, may_start = ends | before, may_start or started
        elif mark.group(1) is not None:
            low, high = int(mark.group(1)), int(mark.group(2))
            for k in range(high):
                before, started = set(ends), may_start
                add(None)
                if k >= low:
                    ends, may_start = ends | before, may_start or started
        else:
            add(mark.group().encode())
    out.last = ends
    if open_regions or may_start or any(out.words[p] is None for p in out.first):
        raise ValueError(f"template {label!r} must close its regions and begin with a word")
    return out


#: fixed values: the phrases that are always looked for, with their labels
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: fixed values: wording of common licenses and notices (lower case, without punctuation)
TEMPLATES = [
    ("apache-2.0", "licensed under the [[terms of the]] apache [[software]] license [[version]] 2 0"),
    ("apache-2.0", "you may not use this {{1-3}} except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "under the [[terms of the]] mit [[x11]] license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the {{1-3}} to deal in the {{1-3}} without restriction"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("bsd", "under the [[{{1-2}}]] bsd [[{{1-2}}]] license"),
    ("gpl-3.0", "licensed under the [[terms of the]] gnu general public license [[as published by the free software "
                "foundation]] [[either]] version 3"),
    ("gpl-2.0", "licensed under the [[terms of the]] gnu general public license [[as published by the free software "
                "foundation]] [[either]] version 2"),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation [[either]] version 3"),
    ("lgpl", "gnu lesser general public license [[version {{1-2}}]]"),
    ("agpl", "gnu affero general public license [[version {{1-2}}]]"),
    ("mpl-2.0", "subject to the terms of the mozilla public license [[v]] [[version]] 2 0"),
    ("epl-2.0", "eclipse public license [[v]] [[version]] 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "cc0 1 0 [[universal]]"),
    ("cc-by-4.0", "under [[a]] cc by 4 0"),
    ("cc-by-sa-4.0", "under [[a]] cc by sa 4 0"),
    ("cc-by-nc-4.0", "under [[a]] cc by nc 4 0"),
    ("cc-by-nd-4.0", "under [[a]] cc by nd 4 0"),
    ("creative-commons", "creative commons attribution [[noncommercial]] [[sharealike]] [[noderivatives]] {{0-3}} license"),
    ("copyright", "copyright [[c]] {{1-1}} [[by]] {{1-6}} all rights reserved"),
    ("bsl-1.0", "boost software license [[version]] 1 0"),
]

_MIT_GRANT = ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
              "documentation files the {{1-3}} to deal in the {{1-3}} without restriction including without limitation the "
              "rights to use copy modify merge publish distribute sublicense and or sell copies of the {{1-3}} and to permit "
              "persons to whom the {{1-3}} is furnished to do so ")
_MIT_DISCLAIMER = ("the {{1-3}} is provided as is without warranty of any kind express or implied including but not limited to the "
                   "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{1-10}} "
                   "be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
                   "arising from out of or in connection with the {{1-3}} or the use or other dealings in the {{1-3}}")
_ISC_GRANT = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted "
_ISC_NOTICE = "provided that the above copyright notice and this permission notice appear in all copies "
_ISC_DISCLAIMER = ("the software is provided as is and {{1-10}} disclaims all warranties with regard to this software including all "
                   "implied warranties of merchantability and fitness in no event shall {{1-10}} be liable for any special direct "
                   "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
                   "whether in an action of contract negligence or other tortious action arising out of or in connection "
                   "with the use or performance of this software")
_BSD_CONDITIONS = ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
                   "following conditions are met [[1]] redistributions of source code must retain the above copyright notice "
                   "this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce "
                   "the above copyright notice this list of conditions and the following disclaimer in the documentation and "
                   "or other materials provided with the distribution ")
_BSD_NAMES = ("[[3]] neither the name of {{1-12}} nor the names of {{1-4}} contributors may be used to endorse or promote products "
              "derived from this software without specific prior written permission ")
_BSD_DISCLAIMER = ("this software is provided by {{1-12}} as is and any express or implied warranties including but not limited to "
                   "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event "
                   "shall {{1-12}} be liable for any direct indirect incidental special exemplary or consequential damages "
                   "including but not limited to procurement of substitute goods or services loss of use data or profits or "
                   "business interruption however caused and on any theory of liability whether in contract strict liability "
                   "or tort including negligence or otherwise arising in any way out of the use of this software even if "
                   "advised of the possibility of such damage")

#: fixed values: the whole wording of short public licenses and notices.  Clause numbers and named holders are the
#: regions that may be left out or replaced; every other word must stand
BODIES = [
    ("mit-text", _MIT_GRANT + "subject to the following conditions the above copyright notice and this permission notice [[including "
     "the next paragraph]] shall be included in all copies or substantial portions of the {{1-3}} " + _MIT_DISCLAIMER),
    ("mit-0-text", _MIT_GRANT + _MIT_DISCLAIMER),
    ("isc-text", _ISC_GRANT + _ISC_NOTICE + _ISC_DISCLAIMER),
    ("0bsd-text", _ISC_GRANT + _ISC_DISCLAIMER),
    ("bsd-2-clause-text", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("bsd-3-clause-text", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    ("zlib-text", "this software is provided as is without any express or implied warranty in no event will {{1-10}} be held liable "
     "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
     "purpose including commercial applications and to alter it and redistribute it freely subject to the following "
     "restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the "
     "original software if you use this software in a product an acknowledgment in the product documentation would be "
     "appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be "
     "misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0-text", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
     "accompanying documentation covered by this license the software to use reproduce display distribute execute and "
     "transmit the software and to prepare derivative works of the software and to permit third parties to whom the "
     "software is furnished to do so all subject to the following the copyright notices in the software and this entire "
     "statement including the above license grant this restriction and the following disclaimer must be included in all "
     "copies of the software in whole or in part and all derivative works of the software unless such copies or derivative "
     "works are solely in the form of machine executable object code generated by a source language processor the software "
     "is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
     "merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders "
     "or anyone distributing the software be liable for any damages or other liability whether in contract tort or "
     "otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
     "use compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
     "commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors "
     "of this software dedicate any and all copyright interest in the software to the public domain we make this dedication "
     "for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to "
     "be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
     + _MIT_DISCLAIMER + " [[for more information please refer to [[http]] [[https]] unlicense org]]"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this {{1-3}} except in compliance "
     "with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 unless "
     "required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
     "basis without warranties or conditions of any kind either express or implied see the license for the specific language "
     "governing permissions and limitations under the license"),
]

#: fixed values: identifiers that an SPDX line may name
SPDX = ["Apache-2.0", "MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "MPL-2.0",
        "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0"]


def spdx_template(identifier: str) -> tuple[str, str]:
    words = _WORD.findall(identifier.lower().encode())
    return "spdx:" + identifier, "spdx license identifier " + b" ".join(words).decode()


def automata(templates: list[tuple[str, str]] | None = None) -> list[Automaton]:
    return ([compile_template(label, t, True) for label, t in BASE]
            + [compile_template(label, t) for label, t in
               (TEMPLATES + BODIES + [spdx_template(i) for i in SPDX] if templates is None else templates)])


def scan(text: str | None, starts: dict[bytes, list[Automaton]]) -> tuple[int, list[tuple[int, int, Automaton]]]:
    """``(number of words, accepted runs)`` of a text; a run is (first word, length, automaton)."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    runs = []
    for at in [k for k, w in enumerate(words) if w in starts]:
        for automaton in starts[words[at]]:
            length = automaton.matches(words, at)
            if length:
                runs.append((at, length, automaton))
    return len(words), runs


def _scanner(compiled: list[Automaton]):
    @F.arrow_udf("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
                 "labels array<string>, score double, runs array<struct<start:long,length:long,label:string>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        starts: dict[bytes, list[Automaton]] = {}
        for automaton in compiled:
            for word in sorted({automaton.words[p] for p in automaton.first}):
                starts.setdefault(word, []).append(automaton)
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("label", pa.string())])
        types = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(run)]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "runs"]
        for batch in batches:
            out = []
            for text in texts(batch):
                count, runs = scan(text, starts)
                places = [at for at, _, a in runs if a.base]
                covered, end = 0, 0
                for at, length, _ in sorted(runs, key=lambda r: (r[0], -r[1])):
                    covered += max(0, at + length - max(at, end))
                    end = max(end, at + length)
                out.append((count, len(places), min(places, default=None), max(places, default=None),
                            sorted({a.label for _, _, a in runs if a.base}), sorted({a.label for _, _, a in runs}),
                            covered / count if count else 0.0,
                            [{"start": at, "length": n, "label": a.label} for at, n, a in runs]))
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    return find


def detect(df: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] | None = None,
           into: str = "__license") -> DataFrame:
    """Add struct ``into``; ``templates`` (label and markup) replaces the given ones (``TEMPLATES``, ``BODIES``: whole license
    texts, and the lines of ``SPDX``).  The fields are ``n_words``; ``n_base``, ``first_word`` and ``last_word`` (number, smallest and largest start of the
    fixed phrases' places; null without any); ``base_labels`` and ``labels`` (distinct, sorted); ``score`` (the
    share of words inside accepted runs); ``runs``.  A null, empty or wordless text has no words, no labels
    and score 0.  Other columns, repeated rows and empty tables pass unchanged."""
    return with_struct(df, _scanner(automata(templates)), [F.col(text_col)], into)


ship_by_value(__name__)
