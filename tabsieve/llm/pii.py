"""Personal data: fixed patterns plus a semi-Markov conditional random field.

The patterns ("base") give emails, IP addresses, card and phone numbers that hold by form alone.  The
field finds further spans.  It scores whole candidate segments of at most ``MAX_TOKENS`` tokens with
features of the entire span (digit groups, separators, checksum, neighbours); a dynamic program over
token positions picks the segmentation with the best total score, deciding boundaries and kinds
together.  A token outside every segment scores 0 and a segment must hold a digit or an at sign, so
tokens further than ``MAX_TOKENS`` from any of those cannot be part of one.  The text is cut into
windows only where the reach of two such tokens cannot meet, so that changes no result.  Segments do
not run over a line break.

The weights maximise the conditional likelihood of the base spans, and of rewritten copies of them in
forms the patterns do not accept, on windows of a bounded sample of rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve._ship import ship_by_value
from tabsieve.llm.common import bounded_batches, texts, with_struct

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
#: rows read for fitting (in expectation) and windows kept of them: the bounded sample
FIT_ROWS, FIT_WINDOWS = 20_000, 400
_BLOCK = 2048  # token positions whose spans are scored at a time

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # every run, so no digit is tried twice
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at  # the run of local characters before the sign, not before the last match's end
        while start > done:
            low = max(done, start - 256)
            found = _LOCAL_END.search(text, low, start).start()
            if found == start:
                break
            start = found
            if found > low:
                break
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run.end() - run.start() < 7:
            continue
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):  # four groups at a time, leftmost first
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield at, end
            at = end + 1


def _by_digits(pattern: re.Pattern, text: str, low: int, high: int, check=None) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if low <= len(digits) <= high and (check is None or check(digits)):
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, by start and then kind; linear in the text."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _TRIGGER.search(text):
        spans += [(a, 1, b) for a, b in _ips(text)]
        spans += [(a, 2, b) for a, b in _by_digits(_CARD, text, 12, 19, luhn)]
        spans += [(a, 3, b) for a, b in _by_digits(_PHONE, text, 9, 15)] if "+" in text else []
    return sorted(spans)


# ---------------------------------------------------------------- windows and whole-span features

def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token offsets around digits and at signs, cut at line breaks and where no segment can reach."""
    at, high = 0, -1
    while True:
        first = _TRIGGER.search(text, at)
        if first is None:
            return
        low = text.rfind("\n", at, first.start()) + 1 or at
        if high <= first.start():  # each line's end is looked up once
            high = text.find("\n", first.start())
            high = len(text) if high < 0 else high
        # the tokens of this line from just before the trigger to where the next one is out of reach; looking back
        # stops at as many tokens as a segment can reach (the first found may be the rest of a longer one)
        back, near = 40 * MAX_TOKENS, []
        while True:
            begin = max(low, first.start() - back)
            near = [m.span() for m in _TOKEN.finditer(text, begin, first.start())]
            if begin == low or len(near) > MAX_TOKENS:
                break
            back *= 2
        tokens = near[-MAX_TOKENS:]
        last = 0  # tokens since the last trigger
        end = high
        for m in _TOKEN.finditer(text, first.start(), high):
            tokens.append(m.span())
            last = 0 if _TRIGGER.match(m.group()) else last + 1
            if last >= 2 * MAX_TOKENS:  # half of these for this window, half for a next one
                break
        if last > MAX_TOKENS:
            del tokens[MAX_TOKENS - last:]
            if last >= 2 * MAX_TOKENS:
                end = tokens[-1][1]
        yield tokens
        at = end


_SCALARS = ("digits", "dots", "dashes", "spaces", "open", "close", "plus", "ats", "letters", "other")


def _token_counts(text: str, tokens: list[tuple[int, int]]) -> np.ndarray:
    """Per token, counts of character classes; white space counts for the token after it."""
    rows = np.zeros((len(tokens), len(_SCALARS)), np.int64)
    for k, (a, b) in enumerate(tokens):
        c = text[a]
        if "0" <= c <= "9":
            rows[k, 0] = b - a
        elif c.isalpha():
            rows[k, 8] = b - a
        else:
            rows[k, {".": 1, "-": 2, "(": 4, ")": 5, "+": 6, "@": 7}.get(c, 9)] = 1
        rows[k, 3] = a - tokens[k - 1][1] if k else 0
    return rows


FEATURES = (["bias"] + [f"digits{k}" for k in range(7)] + ["groups1", "groups2", "groups3", "groups4", "groups5"]
            + ["dots0", "dots1", "dots2", "dots3", "dots4", "dashes0", "dashes1", "dashes2"]
            + ["parens", "paren_open", "plus_first", "plus_inside", "at_once", "at_many", "letters_none", "letters_some",
               "other", "spaces0", "spaces1", "spaces2", "luhn", "octets", "glued_left", "glued_right", "ends_alnum",
               "starts_alnum", "length1", "length_mid", "length_long", "at_word", "tail_word", "phone_groups"])


def span_features(text: str, tokens: list[tuple[int, int]], low: int, high: int):
    """``(starts, ends, matrix)`` for the segments that begin at token ``low`` to ``high - 1``."""
    n = len(tokens)
    stop = min(n, high + MAX_TOKENS)
    rows = _token_counts(text, tokens[low:stop])
    total = np.vstack([np.zeros((1, rows.shape[1]), np.int64), np.cumsum(rows, axis=0)])
    starts = np.repeat(np.arange(low, high), MAX_TOKENS)
    ends = starts + np.tile(np.arange(1, MAX_TOKENS + 1), high - low)
    fits = ends <= n
    starts, ends = starts[fits], ends[fits]
    counts = total[ends - low] - total[starts - low]
    holds = (counts[:, 0] > 0) | (counts[:, 7] > 0)
    starts, ends, counts = starts[holds], ends[holds], counts[holds]
    counts[:, 3] -= rows[starts - low, 3]  # the space before the first token is outside
    d, dots, dashes, spaces, opened, closed, plus, ats, letters, other = counts.T
    groups = np.concatenate([[0], np.cumsum(rows[:, 0] > 0)])
    g = groups[ends - low] - groups[starts - low]
    first = np.array([text[tokens[s][0]] for s in starts], dtype="U1") if len(starts) else np.empty(0, "U1")
    final = np.array([text[tokens[e - 1][1] - 1] for e in ends], dtype="U1") if len(starts) else np.empty(0, "U1")
    left = np.array([tokens[s][0] > 0 and not text[tokens[s][0] - 1].isspace() for s in starts], bool)
    right = np.array([tokens[e - 1][1] < len(text) and text[tokens[e - 1][1]].isalnum() for e in ends], bool)
    is_luhn, octets, phone_like = (np.zeros(len(starts), bool) for _ in range(3))
    at_word, tail_word = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    for k in np.flatnonzero((letters == 0) & (ats == 0)).tolist():
        if 12 <= d[k] <= 19 and not dots[k]:
            is_luhn[k] = luhn(_NOT_DIGIT.sub("", text[tokens[starts[k]][0]:tokens[ends[k] - 1][1]]))
        elif g[k] == 4 and 4 <= d[k] <= 12 and dots[k] == 3 and ends[k] - starts[k] == 7:
            octets[k] = all(_octet(text[a:b]) for a, b in tokens[starts[k]:ends[k]] if "0" <= text[a] <= "9")
        if 9 <= d[k] <= 15 and 3 <= g[k] <= 4:
            sizes = [b - a for a, b in tokens[starts[k]:ends[k]] if "0" <= text[a] <= "9"]
            phone_like[k] = sizes[-3:] == [3, 3, 4]
    for k in np.flatnonzero((letters > 0) & (spaces >= 2) & (ends - starts >= 3)).tolist():
        words = [text[a:b].lower() for a, b in tokens[starts[k] + 1:ends[k] - 1]]
        at_word[k] = "at" in words and "dot" in words[words.index("at"):]
    tail_word[:] = np.array([len(text[slice(*tokens[e - 1])]) >= 2 and text[tokens[e - 1][0]].isalpha() for e in ends], bool)
    alnum_first = np.array([c.isalnum() for c in first], bool)
    size = ends - starts
    columns = [np.ones(len(starts), bool), d == 0, (d > 0) & (d < 4), (d > 3) & (d < 9), (d > 8) & (d < 12),
               (d > 11) & (d < 16), (d > 15) & (d < 20), d > 19, g <= 1, g == 2, g == 3, g == 4, g > 4,
               dots == 0, dots == 1, dots == 2, dots == 3, dots > 3, dashes == 0, dashes == 1, dashes > 1,
               (opened == 1) & (closed == 1), opened != closed, first == "+", (plus > 0) & (first != "+"), ats == 1, ats > 1,
               letters == 0, letters > 0, other > 0, spaces == 0, spaces == 1, spaces > 1, is_luhn, octets, left, right,
               np.array([c.isalnum() for c in final], bool), alnum_first, size == 1, (size > 1) & (size < 9), size > 8,
               at_word, tail_word, phone_like]
    return starts, ends, np.stack(columns, axis=1).astype(np.float32) if len(starts) else np.zeros((0, len(FEATURES)), np.float32)


def segment(text: str, tokens: list[tuple[int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's spans: bounded-entity dynamic programming from left to right."""
    n = len(tokens)
    best = np.full(n + 1, -np.inf)
    best[0] = 0.0
    back: list = [None] * (n + 1)
    for low in range(0, n, _BLOCK):
        high = min(n, low + _BLOCK)
        starts, ends, matrix = span_features(text, tokens, low, high)
        scores = matrix @ weights
        kind = scores.argmax(axis=1) if len(starts) else np.empty(0, int)
        top = scores[np.arange(len(starts)), kind] if len(starts) else np.empty(0)
        useful = np.flatnonzero(top > 0)  # a segment below 0 is never better than leaving its tokens out
        bounds = np.searchsorted(starts[useful], np.arange(low, high + 1))
        for s in range(low, high):
            if best[s] >= best[s + 1]:
                best[s + 1], back[s + 1] = best[s], None
            for k in useful[bounds[s - low]:bounds[s - low + 1]].tolist():
                if best[s] + top[k] > best[ends[k]]:
                    best[ends[k]], back[ends[k]] = best[s] + top[k], (s, int(kind[k]))
    spans, at = [], n
    while at > 0:
        if back[at] is None:
            at -= 1
        else:
            s, k = back[at]
            spans.append((tokens[s][0], k, tokens[at - 1][1]))
            at = s
    return spans[::-1]


def find_spans(text: str, weights: np.ndarray) -> tuple[list, list]:
    """``(base, all)`` spans: the patterns', and with them the field's that touch none of those."""
    base = base_spans(text)
    more = []
    if _TRIGGER.search(text):
        # furthest end of the base spans up to each start: a later start may lie inside an earlier span
        starts, reach = [s for s, _, _ in base], np.maximum.accumulate([e for _, _, e in base]) if base else []
        for tokens in windows(text):
            for start, kind, end in segment(text, tokens, weights):
                before = bisect_right(starts, end - 1)  # base spans that start inside or before
                if not before or reach[before - 1] <= start:
                    more.append((start, kind, end))
    return base, sorted(base + more)


# ---------------------------------------------------------------- fitting

def _variants(text: str, base: list[tuple[int, int, int]], salt: int):
    """The window's text with each base span rewritten into a form that the patterns do not accept."""
    out, at, spans = [], 0, []
    for start, kind, end in base:
        if start < at:
            continue
        span = text[start:end]
        if kind == 0:
            span = span.replace("@", (" at ", " (at) ", " [at] ")[salt % 3]).replace(".", (" dot ", ".", " [dot] ")[salt % 3])
        elif kind == 3:
            span = re.sub(r"^\+[0-9]+[ .-]*", "", span)
            span = span.replace(" ", ("-", " ", ".")[salt % 3]) if salt % 2 else span
        elif kind == 2:
            span = ".".join(span[k:k + 4] for k in range(0, len(span), 4)) if span.isdigit() else span
        out += [text[at:start], span]
        begin = sum(map(len, out[:-1]))
        spans.append((begin, kind, begin + len(span)))
        at = end
    return "".join(out) + text[at:], spans


def _examples(contexts: list[str]):
    """Per window: its segments' features, their ends, and the gold segments as indices."""
    for salt, context in enumerate(contexts):
        base = base_spans(context)
        for text, gold in ((context, base), _variants(context, base, salt)) if base else ((context, base),):
            for tokens in windows(text):
                starts, ends, matrix = span_features(text, tokens, 0, len(tokens))
                at = {(tokens[s][0], tokens[e - 1][1]): k for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist()))}
                yield len(tokens), starts, ends, matrix, [(at[a, b], k) for a, k, b in gold if (a, b) in at]


def _log_sum(values: np.ndarray) -> float:
    top = values.max()
    return top + np.log(np.exp(values - top).sum())


def _expected(count: int, starts, ends, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log of the sum over all segmentations, and each (segment, kind)'s probability (forward-backward)."""
    flat = np.logaddexp.reduce(scores, axis=1)
    by_end = [[] for _ in range(count + 1)]
    by_start = [[] for _ in range(count + 1)]
    for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        by_end[e].append(k)
        by_start[s].append(k)
    ahead, behind = np.zeros(count + 1), np.zeros(count + 1)
    for e in range(1, count + 1):
        k = by_end[e]
        ahead[e] = _log_sum(np.append(ahead[starts[k]] + flat[k], ahead[e - 1]))
    for s in range(count - 1, -1, -1):
        k = by_start[s]
        behind[s] = _log_sum(np.append(behind[ends[k]] + flat[k], behind[s + 1]))
    return ahead[count], np.exp(ahead[starts][:, None] + scores + behind[ends][:, None] - ahead[count])


def train(contexts: list[str], steps: int = 25, ridge: float = 1e-3) -> np.ndarray:
    """Weights (features x kinds) by gradient ascent with per-weight steps on the conditional likelihood.
    Without any example the weights are such that no span is added."""
    examples = [x for x in _examples(contexts) if len(x[1])]
    weights = np.zeros((len(FEATURES), len(KINDS)))
    weights[0] = -4.0
    if not any(gold for *_, gold in examples):
        return weights * 1e3
    squares = np.full_like(weights, 1e-6)
    for _ in range(steps):
        gradient = -ridge * len(examples) * weights
        for count, starts, ends, matrix, gold in examples:
            _, probability = _expected(count, starts, ends, matrix @ weights)
            target = -probability
            for k, kind in gold:
                target[k, kind] += 1.0
            gradient += matrix.T @ target
        squares += gradient**2
        weights += 0.8 * gradient / np.sqrt(squares)
    return weights


def fit(df: DataFrame, text_col: str = "text", key_col: str = "doc_id", rows: int = FIT_ROWS,
        kept: int = FIT_WINDOWS) -> np.ndarray:
    """Weights learned from at most ``kept`` lines of about ``rows`` rows of ``df``, both taken by a hash (of
    ``key_col`` and of the line), so the same table gives the same weights however it is partitioned."""
    source = df.select(F.col(text_col).alias("text"), F.col(key_col).alias("key")).where("text is not null")
    have = source.count()
    if not have:
        return train([])
    chance = min(1.0, rows / have)
    taken = source.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30)) < int(chance * (1 << 30)) + 1).select("text")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in texts(batch.column(0)):
                for tokens in windows(text):
                    if len(tokens) <= 8 * MAX_TOKENS:
                        found.append(text[tokens[0][0]:tokens[-1][1]])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["line"])

    found = (taken.mapInArrow(lines, "line string").dropDuplicates(["line"])
             .orderBy(F.xxhash64("line"), "line").limit(kept).collect())
    return train([r["line"] for r in found])


def _finder(weights: np.ndarray):
    @F.arrow_udf("base array<struct<start:long,kind:int,stop:long>>, found array<struct<start:long,kind:int,stop:long>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
        for batch in batches:
            both = [find_spans(text or "", weights) for text in texts(batch)]
            as_rows = [pa.array([[{"start": a, "kind": k, "stop": b} for a, k, b in x[side]] for x in both], span)
                       for side in (0, 1)]
            yield pa.StructArray.from_arrays(as_rows, names=["base", "found"])
    return find


def detect(df: DataFrame, weights: np.ndarray, text_col: str = "text", into: str = "__pii") -> DataFrame:
    """Add struct ``into`` with ``base`` and ``found``: arrays of (start, kind, stop) in code points, ``kind`` an
    index into ``KINDS``, by start and then kind; ``found`` is the base spans and the field's further
    ones.  A null or empty text has none.  Other columns, repeated rows and empty tables pass unchanged."""
    return with_struct(df, _finder(weights), [F.col(text_col)], into)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span as its kind in angle brackets; overlapping spans become one mark."""
    parts, at = [], 0
    for start, kind, stop in spans:
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, stop)
    return "".join(parts) + text[at:]


def _redactor(weights: np.ndarray):
    @F.arrow_udf("string")
    def redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([t if t is None else masked(t, find_spans(t, weights)[1]) for t in texts(batch)], pa.string())
    return redacted


def redact(df: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``df`` with every span found in ``text_col`` replaced by its kind in angle brackets; overlapping spans
    become one mark.  A null text stays null; the columns are those of ``df``."""
    return bounded_batches(df).withColumn(text_col, _redactor(weights).asNondeterministic()(F.col(text_col)))


ship_by_value(__name__)
