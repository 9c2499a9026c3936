import itertools
import random
import re

import pytest

from tabsieve.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def base(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words))
             if words[k:k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in found}))


def test_query_equals_plain_phrase_search(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_license_templates"](spark, "/root/testdata/sf0.01").collect()}
    hits = 0
    for r in docs.select("doc_id", "text").collect():
        row = got[r["doc_id"]]
        assert tuple(row[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == base(r["text"])
        assert set(filter(None, row["base_labels"].split(","))) <= set(filter(None, row["labels"].split(",")))
        if "Apache License, Version 2.0" in (r["text"] or ""):
            assert "apache-2.0" in row["labels"]
        if "Released under the MIT License" in (r["text"] or ""):
            assert "mit" in row["labels"].split(",")
        hits += bool(row["labels"])
        assert 0 <= row["score"] <= 1 and (row["score"] > 0) == bool(row["labels"])
    assert hits > 10


def expansions(template):
    """Every word list that a template stands for; free words are None."""
    tokens = re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", template)

    def parse(at):
        out = [[]]
        while at < len(tokens) and tokens[at] != "]]":
            t = tokens[at]
            if t == "[[":
                inner, at = parse(at + 1)
                choices = inner + [[]]
            elif t.startswith("{{"):
                low, high = map(int, re.findall(r"\d+", t))
                choices = [[None] * k for k in range(low, high + 1)]
            else:
                choices = [[t]]
            out = [a + b for a, b in itertools.product(out, choices)]
            at += 1
        return out, at
    return parse(0)[0]


@pytest.mark.parametrize("template", ["a b", "a [[b]] c", "a [[b [[c]] d]] e", "a {{0-2}} b", "a {{1-3}} [[b]]", "[[a]] b [[c]]",
                                      "a [[{{1-2}} b]] {{0-1}} c", "a [[b]] [[c]] [[d]]"])
def test_automaton_accepts_exactly_the_expansions(template):
    automaton = licenses.compile_template("t", template)
    every = expansions(template)
    rng = random.Random(template)
    for _ in range(600):
        text = [rng.choice("abcdex") for _ in range(rng.randrange(1, 8))]
        want = max((len(e) for e in every if e and len(e) <= len(text) and all(w in (None, t) for w, t in zip(e, text))), default=0)
        assert automaton.matches([t.encode() for t in text], 0) == want


def test_mandatory_wording_must_be_exact():
    starts = {}
    for a in licenses.automata():
        for p in a.first:
            starts.setdefault(a.words[p], []).append(a)
    labels = lambda text: sorted({a.label for _, _, a in licenses.scan(text, starts)[1]})
    assert labels("Licensed under the terms of the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("Licensed under the Apache Licence, Version 2.0.") == []
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by", "cc-by-nc-4.0"]
    assert labels("Copyright (c) 2020 by Some Person. All Rights Reserved") == ["copyright", "reserved"]
    for bad in ("[[a", "{{0-2}} a", "[[a]]"):
        with pytest.raises(ValueError):
            licenses.compile_template("t", bad)


def as_pattern(template):
    """The template as a regular expression over words that each end with a space."""
    out = []
    for t in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", template):
        span = re.fullmatch(r"\{\{(\d+)-(\d+)\}\}", t)
        out.append("(?:" if t == "[[" else ")?" if t == "]]" else r"(?:\S+ ){%s,%s}" % span.groups() if span else re.escape(t) + " ")
    return re.compile("".join(out))


def one_expansion(template, rng):
    """Words of a text that the template stands for, with regions left out or filled at random."""
    out, skipping = [], 0
    for t in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", template):
        if t == "[[":
            skipping += bool(skipping) or rng.random() < 0.5
        elif t == "]]":
            skipping -= bool(skipping)
        elif not skipping:
            span = re.fullmatch(r"\{\{(\d+)-(\d+)\}\}", t)
            out += [rng.choice(["acme", "be", "the", "software"]) for _ in range(rng.randint(*map(int, span.groups())))] if span else [t]
    return out


@pytest.mark.parametrize("label, template", licenses.BODIES, ids=[n for n, _ in licenses.BODIES])
def test_whole_texts_are_accepted_as_the_pattern_says(label, template):
    automaton, pattern, rng = licenses.compile_template(label, template), as_pattern(template), random.Random(label)
    accepted = 0
    for k in range(60):
        words = one_expansion(template, rng)
        if k % 3 == 1:  # one word changed, left out or put in
            at = rng.randrange(len(words))
            words[at:at + 1] = rng.choice([[], ["other"], [words[at], "other"]])
        words += ["and", "more"]
        want = max((m for m in range(1, len(words) + 1) if pattern.fullmatch(" ".join(words[:m]) + " ")), default=0)
        assert automaton.matches([w.encode() for w in words], 0) == want
        accepted += want > 0
    assert 40 <= accepted < 60


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_license_files_in_documents(spark):
    held = MIT.replace("THE\nAUTHORS OR COPYRIGHT HOLDERS", "ACME INC")
    rows = [(1, "intro\n\n" + MIT + "\nend"), (2, "\n".join("# " + line for line in held.split("\n"))),
            (3, MIT.replace("sublicense", "license")), (4, MIT[:MIT.index("OUT OF")]),
            (5, "SPDX-License-Identifier: GPL-2.0-or-later"), (6, "Boost Software License, Version 1.0"), (7, None)]
    got = {r["doc_id"]: r["__license"]["labels"] for r in licenses.detect(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "mit-text" in got[1] and "mit-text" in got[2]
    assert got[3] == [] or "mit-text" not in got[3]
    assert got[4] == ["mit"]  # the grant's first words alone
    assert got[5] == ["spdx:GPL-2.0-or-later"] and got[6] == ["bsl-1.0"] and got[7] == []


def test_awkward_rows(awkward, empty):
    rows = licenses.detect(awkward, into="kept").collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert tuple(r["kept"][c] for c in ("n_words", "n_base", "first_word", "last_word")) == base(r["text"])[:4]
    assert licenses.detect(empty).collect() == []
