import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tabsieve.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


@pytest.mark.parametrize("letters", ["0123456789.@+- ()aB_%é\n", "12.@-a+ 4111", "1.", "a@.", "+1 -()"])
def test_base_spans_equal_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(8000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(50)))
        assert pii.base_spans(text) == base(text), text


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "@" * 20_000, "1." * 50_000, "+1" + " " * 100_000, "a.b" * 50_000 + "@"):
        pii.base_spans(text)


def test_segmentation_is_the_best_of_all():
    """Against every way to place segments, on short windows with random weights."""
    rng = np.random.default_rng(1)
    for text in ("call 555 12 now", "a@b.c 1", "1 2 3", "+1 (2) 3-4"):
        for _ in range(10):
            weights = rng.normal(0, 1, (len(pii.FEATURES), len(pii.KINDS)))
            for tokens in pii.windows(text):
                starts, ends, matrix = pii.span_features(text, tokens, 0, len(tokens))
                scores = (matrix @ weights).max(axis=1)
                best = 0.0
                every = list(zip(starts.tolist(), ends.tolist(), scores.tolist()))
                for size in range(1, 4):
                    for chosen in itertools.combinations(every, size):
                        ordered = sorted(chosen)
                        if all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:])):
                            best = max(best, sum(c[2] for c in chosen))
                index = {(tokens[s][0], tokens[e - 1][1]): v for s, e, v in every}
                got = sum(index[a, b] for a, _, b in pii.segment(text, tokens, weights))
                assert got >= best - 1e-6


def by_whole_lines(text, weights):
    """The spans of ``find_spans`` with one window per line."""
    base, more, at = pii.base_spans(text), [], 0
    for line in text.split("\n"):
        tokens = [(at + m.start(), at + m.end()) for m in pii._TOKEN.finditer(line)]
        more += [s for s in pii.segment(text, tokens, weights) if not any(a < s[2] and s[0] < b for a, _, b in base)]
        at += len(line) + 1
    return base, sorted(base + more)


@pytest.mark.parametrize("gap", [0, 1, 14, 15, 16, 17, 18, 19, 30, 31, 32, 33, 34, 47, 48, 49, 64])
def test_windows_change_no_span(gap, weights):
    """Gaps between triggers around every length at which windows are cut."""
    rng = np.random.default_rng(gap)
    fields = [np.round(w * 64) / 64 for w in (weights, *(rng.normal(0, 1, weights.shape) for _ in range(4)))]  # exact sums
    for between in (" ".join(["word"] * gap), " ".join("x" * 300 for _ in range(gap)), ". " * gap, " " * 2000 + "word " * gap):
        for tail in ("(212) 555-0100", "jane.doe42 at host dot org", "jdoe42@host.org now", "j [at] 4"):
            text = f"see 7 {between} {tail} and {between} 12 {between}\n{between} 3 {tail}"
            for field in fields:
                assert pii.find_spans(text, field) == by_whole_lines(text, field)


def test_windows_keep_every_token_in_reach():
    for gap in range(70):
        text = "7 " + "word " * gap + "9 end"
        seen = [t for tokens in pii.windows(text) for t in tokens]
        assert len(seen) == len(set(seen))
        for tokens in pii.windows(text):
            for k, (a, b) in enumerate(tokens):
                if text[a:b] == "9":
                    assert k >= min(gap + 1, pii.MAX_TOKENS - 1)


def test_probabilities_equal_enumeration():
    """Forward-backward against the sum over all segmentations."""
    rng = np.random.default_rng(2)
    starts, ends = np.array([0, 0, 1, 2]), np.array([1, 2, 3, 3])
    scores = rng.normal(0, 1, (4, 2))
    total, marginal = 0.0, np.zeros((4, 2))
    for size in range(4):
        for chosen in itertools.combinations(range(4), size):
            order = sorted(chosen, key=lambda k: starts[k])
            if any(ends[a] > starts[b] for a, b in zip(order, order[1:])):
                continue
            for kinds in itertools.product(range(2), repeat=size):
                value = np.exp(sum(scores[k, y] for k, y in zip(chosen, kinds)))
                total += value
                for k, y in zip(chosen, kinds):
                    marginal[k, y] += value
    log_total, probability = pii._expected(3, starts, ends, scores)
    assert np.isclose(log_total, np.log(total)) and np.allclose(probability, marginal / total)


@pytest.fixture(scope="module")
def weights(docs):
    return pii.fit(docs)


def test_finds_forms_the_patterns_do_not(weights):
    found = {}
    for text in ("call (724) 555-7058 now", "call 724-555-7058 now", "card 4111.1111.1111.1111 ok", "+1 (269) 555-3296 4524132264652876"):
        found[text] = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find_spans(text, weights)[1]]
    assert [k for k, _ in found["call (724) 555-7058 now"]] == ["phone"]
    assert [k for k, _ in found["call 724-555-7058 now"]] == ["phone"]
    assert ("card", "4524132264652876") in found["+1 (269) 555-3296 4524132264652876"]
    for clean in ("Licensed under the Apache License, Version 2.0.", "in 1999 there were 300 and 20 of 4", "the and of"):
        assert pii.find_spans(clean, weights)[1] == []


def test_query_equals_patterns(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_semi_markov_pii"](spark, "/root/testdata/sf0.01").collect()}
    for r in docs.select("doc_id", "text").collect():
        spans = base(r["text"] or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        row = got[r["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert set(joined.split(",")) <= set(row["spans"].split(",")) or not joined


def test_awkward_rows(awkward, empty, weights):
    rows = pii.redact(awkward, weights)
    assert rows.columns == awkward.columns
    before, after = awkward.collect(), rows.collect()
    assert [r["text"] for r in after[:-1]] == [r["text"] for r in before[:-1]]
    assert after[-1]["text"] == "mail <EMAIL> or <PHONE> é ü 日本"
    assert pii.redact(empty, weights).collect() == []
    assert pii.find_spans("a 1 b 2", pii.fit(empty))[1] == []
