"""Language ID by mixture inference.

Each letter of a text gives one n-gram: the letter with its two neighbours, everything that is not a
letter read as a space, hashed to one of ``BUCKETS`` buckets.  A language is a smoothed distribution
over buckets.  A text is a mixture of languages, its log-likelihood
``sum_b c_b log(sum_l share_l P_l(b))``; expectation-maximisation finds the shares for a given set of
languages, and the set is grown from the best single language as long as the best further language
raises the likelihood by more than ``PENALTY * log(n-grams)``.

The likelihood is concave in the shares, so its gradient bounds what a further language can gain.
Languages whose bound is below the penalty are left out without running the algorithm; this is exact
and settles most texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve._ship import ship_by_value
from tabsieve.llm.common import texts, with_struct

BUCKETS = 1 << 16
#: log-likelihood a further language has to gain, per log of the number of n-grams (neighbouring
#: n-grams overlap, so this is several times the usual half)
PENALTY = 3.0
SMOOTHING = 0.5
#: rows a language is learned from, in expectation; the one bounded sample here (fitting only)
FIT_ROWS = 4000
_CHUNK = 1_000_000
UNDETERMINED = "und"


def letter_bits() -> bytes:
    """One bit per code point: whether it is a letter.  Built on the driver and shipped with the tasks."""
    flags = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool)
    return np.packbits(flags).tobytes()


def ngram_counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(buckets, counts)`` of a whole text, a chunk of code points at a time."""
    total = None
    for at in range(0, max(1, len(text)), _CHUNK):
        lead = text[at - 1] if at else " "
        tail = text[at + _CHUNK:at + _CHUNK + 1] or " "
        code = np.frombuffer((lead + text[at:at + _CHUNK] + tail).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[code]
        code = np.where(is_letter, code, np.uint32(32))
        if at or len(text) > _CHUNK:  # the chunk's own letters only, so none is counted twice
            is_letter = is_letter.copy()
        hashed = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77)
                  + code[2:] * np.uint32(0xC2B2AE3D))
        hashed = ((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        buckets, counts = np.unique(hashed[is_letter[1:-1]].astype(np.uint16), return_counts=True)
        if len(text) <= _CHUNK:
            return buckets, counts
        total = np.zeros(BUCKETS, np.int64) if total is None else total
        total[buckets] += counts
    found = np.flatnonzero(total)
    return found.astype(np.uint16), total[found]


def em_shares(counts: np.ndarray, likelihood: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Shares of the rows of ``likelihood`` (languages x buckets seen) and the log-likelihood reached."""
    total = counts.sum()
    shares = np.full(len(likelihood), 1.0 / len(likelihood)) if start is None else start
    before = -np.inf
    for _ in range(200):
        mix = shares @ likelihood
        now = float(counts @ np.log(mix))
        if now - before < 1e-2:
            break
        before = now
        shares = shares * (likelihood @ (counts / mix)) / total
    return shares, now


def mixture(counts: np.ndarray, likelihood: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The selected languages (row numbers) and their shares."""
    total = float(counts.sum())
    penalty = PENALTY * np.log(total + 1)
    single = np.log(likelihood) @ counts
    chosen, shares = [int(np.argmax(single))], np.ones(1)
    best = float(single[chosen[0]])
    while len(chosen) < len(likelihood):
        mix = shares @ likelihood[chosen]
        bound = likelihood @ (counts / mix) - total  # what each language can gain at most
        found = None
        for row in np.argsort(-bound, kind="stable"):
            if bound[row] <= penalty:
                break
            if row in chosen:
                continue
            tried, reached = em_shares(counts, likelihood[[*chosen, int(row)]], np.append(shares * 0.9, 0.1))
            if reached - best > penalty and (found is None or reached > found[2]):
                found = int(row), tried, reached
        if found is None:
            break
        chosen, shares, best = [*chosen, found[0]], found[1], found[2]
    return chosen, shares


class LanguageModel:
    """``languages`` and their bucket probabilities (languages x ``BUCKETS``)."""

    def __init__(self, languages: list[str], probabilities: np.ndarray):
        self.languages, self.probabilities = languages, probabilities.astype(np.float32)


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None,
        rows_per_language: int = FIT_ROWS) -> LanguageModel:
    """Learn every non-null language of ``df`` from about ``rows_per_language`` of its rows, taken by a hash
    of ``key`` (the text if not given).  Rows without language or text teach nothing.  The driver
    receives bucket counts only (languages x buckets at most).  No usable row gives a model without
    languages, which predicts ``und``."""
    key = F.col(text_col) if key is None else key
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                       (F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)).alias("at"))
    have = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not have:
        return LanguageModel([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[x for k, v in have.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_language / v)))])
    taken = rows.where(F.col("at") < share[F.col("lang")]).select("lang", "text")
    packed = letter_bits()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                buckets, counts = ngram_counts(text, letters)
                totals.setdefault(lang, np.zeros(BUCKETS, np.int64))[buckets] += counts
        for lang, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()),
                                              pa.array(total[seen], pa.int64())], names=["lang", "bucket", "c"])

    counted = (taken.mapInArrow(count, "lang string, bucket int, c long")
               .groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toPandas())
    languages = sorted(have)
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    np.add.at(table, (np.searchsorted(languages, counted["lang"].to_numpy(str)), counted["bucket"].to_numpy()),
              counted["c"].to_numpy())
    return LanguageModel(languages, table / table.sum(axis=1, keepdims=True))


def _predictor(model: LanguageModel):
    languages, probabilities, packed = model.languages, model.probabilities, letter_bits()

    @F.arrow_udf("lang_pred string, score double, languages string, n_letters long")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        by_bucket = np.ascontiguousarray(probabilities.T)  # a text's buckets are whole rows
        for batch in batches:
            out: list[tuple] = []
            for text in texts(batch):
                buckets, counts = ngram_counts(text or "", letters)
                total = int(counts.sum())
                if not total or not languages:
                    out.append((UNDETERMINED, 0.0, "", total))
                    continue
                chosen, shares = mixture(counts.astype(np.float64), by_bucket[buckets].T.astype(np.float64))
                order = sorted(zip(-shares, chosen))
                out.append((languages[order[0][1]], float(min(1.0, -order[0][0])),
                            ",".join(f"{languages[k]}:{-s:.3f}" for s, k in order), total))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.StructArray.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()),
                 pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())],
                names=["lang_pred", "score", "languages", "n_letters"])
    return predict


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", into: str = "__lang") -> DataFrame:
    """Add struct ``into``: ``lang_pred`` (largest share; ties go to the language chosen first by the
    model's order), ``score`` (that share, 0 to 1), ``languages`` (the mixture, largest first, as
    ``lang:share``) and ``n_letters``.  Reads nothing but the whole text.  A null text or one without a
    letter is ``und`` with score 0 and an empty mixture.  Other columns pass unchanged; repeated rows are
    judged alike; an empty table stays empty."""
    return with_struct(df, _predictor(model), [F.col(text_col)], into)


ship_by_value(__name__)
