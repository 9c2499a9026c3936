"""Quality rules: fixed text statistics, and a logistic regression on hashed n-grams.

Features are frequencies of single words, of pairs of neighbouring words and of windows of ``CHARS`` code points, hashed
to ``BUCKETS`` buckets (words and pairs share one half, windows have the other).  The regression is fitted on a bounded, hash-chosen sample of labelled rows and its score calibrated (Platt's sigmoid) on the part
of the sample that it was not fitted on.  Texts are scored in Arrow batches and compared with a fixed
probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve._ship import ship_by_value
from tabsieve.llm.common import texts, with_struct
from tabsieve.llm.neardup import _mixed, _odd_constants

BUCKETS = 1 << 17
CHARS = 4
#: labelled rows the regression is fitted and calibrated on at most; a fifth of them calibrates
FIT_ROWS = 3000
#: a text is kept from this calibrated probability of good quality on
KEEP_FROM = 0.5
_SCALE = 40.0
_CHUNK = 1 << 20
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def statistics(text: str, words: list[bytes], hashed: np.ndarray) -> tuple[int, int, int, int, int]:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` of a whole text."""
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    repeats = 0
    if len(words) > 3:
        a, b, c = _odd_constants(17, 3, np.uint64)
        windows = _mixed(hashed[:-2] * a + hashed[1:-1] * b + hashed[2:] * c)
        _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = counts[which] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k:len(words) - 2 + k] |= again
        repeats = int(covered.sum())
    return (len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)),
            len(lines) - len(set(lines)), repeats)


def buckets_of(text: str, hashed: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Buckets with the value each occurrence adds: words, pairs of neighbouring words, then code-point n-grams a
    chunk at a time."""
    if len(hashed):
        yield (hashed >> np.uint64(64 - 16)).astype(np.int64), _SCALE / len(hashed)
    if len(hashed) > 1:
        a, b = _odd_constants(23, 2, np.uint64)
        pairs = _mixed(hashed[:-1] * a + hashed[1:] * b)
        yield (pairs >> np.uint64(64 - 16)).astype(np.int64), _SCALE / len(pairs)
    count = len(text) - CHARS + 1
    for at in range(0, max(0, count), _CHUNK):
        code = np.frombuffer(text[at:at + _CHUNK + CHARS - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        total = np.zeros(len(code) - CHARS + 1, np.uint32)
        for k, factor in enumerate(_odd_constants(19, CHARS, np.uint32)):
            total = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + code[k:k + len(total)] * factor
        total = (total ^ (total >> np.uint32(13))) * np.uint32(0x297A2D39)
        yield (total >> np.uint32(16)).astype(np.int64) + BUCKETS // 2, _SCALE / count


class QualityModel:
    """Regression weights with the sigmoid that turns its score into a probability."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights.astype(np.float32), slope, offset

    def probability(self, text: str, hashed: np.ndarray) -> float:
        score = sum((float(self.weights[b].sum()) * v for b, v in buckets_of(text, hashed)), 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * score + self.offset, -35, 35))))


def _regression(labels: np.ndarray, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, steps: int = 120) -> np.ndarray:
    """Logistic regression by full gradients with per-weight steps; classes weigh the same."""
    weights, squares, offset = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 0.0
    each = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    for _ in range(steps):
        margin = offset + np.bincount(rows, values * weights[columns], len(labels))
        wrong = each * (labels - 1 / (1 + np.exp(-np.clip(margin, -35, 35))))
        gradient = np.bincount(columns, values * wrong[rows], BUCKETS) - 1e-6 * weights
        squares += gradient**2
        weights += 0.05 * gradient / np.sqrt(squares)
        offset += wrong.sum()
    return weights


def _sigmoid_fit(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's calibration by Newton steps, with his smoothed targets."""
    good, bad = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    centre, spread = scores.mean(), scores.std() or 1.0
    x = np.stack([(scores - centre) / spread, np.ones(len(scores))], axis=1)
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (target - p) - 1e-4 * at)
        at += np.clip(step, -2, 2)
    return at[0] / spread, at[1] - at[0] * centre / spread


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        rows: int = FIT_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled ids, chosen by a hash of the id.  An id labelled more than once counts
    as good from a mean of one half on; labels without id or value and ids without text teach nothing.
    With fewer than two examples of a class the model calls every text good with probability 1."""
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(rows))
    found = (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
             .join(F.broadcast(chosen), "id"))  # at most ``rows`` rows

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, values = [], []
            for text in texts(batch.column("text")):
                total = np.zeros(BUCKETS)
                for b, v in buckets_of(text, word_hashes(text.encode("utf-8", "surrogatepass").split())):
                    total += np.bincount(b, minlength=BUCKETS) * v
                columns.append(np.flatnonzero(total).astype(np.int32))
                values.append(total[columns[-1]].astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("label").cast(pa.int32()),
                                              pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                                             names=["id", "label", "b", "v"])

    sample = (found.mapInArrow(featured, "id long, label int, b array<int>, v array<float>")
              .dropDuplicates(["id"]).toArrow().sort_by("id"))
    labelled = sample["label"].to_numpy().astype(float)
    if min(labelled.sum(), (1 - labelled).sum()) < 2:
        return QualityModel(np.zeros(BUCKETS), 0.0, 35.0)
    sizes = sample["b"].combine_chunks().value_lengths().to_numpy()
    row = np.repeat(np.arange(len(labelled)), sizes)
    column, value = (sample[c].combine_chunks().flatten().to_numpy() for c in ("b", "v"))
    held = np.arange(len(labelled)) % 5 == 0
    if min(labelled[~held].sum(), (1 - labelled[~held]).sum(), labelled[held].sum(), (1 - labelled[held]).sum()) < 1:
        held[:] = False  # too few to set some apart
    learn = ~held[row]
    renumbered = np.cumsum(~held) - 1
    weights = _regression(labelled[~held], renumbered[row[learn]], column[learn], value[learn])
    scores = np.bincount(row, value * weights[column], len(labelled))
    apart = held if held.any() else ~held
    return QualityModel(weights, *_sigmoid_fit(scores[apart], labelled[apart]))


def _judge(model: QualityModel):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @F.arrow_udf(", ".join(f"{n} long" for n in names) + ", quality double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in texts(batch):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                hashed = word_hashes(words)
                out.append((*statistics(text or "", words, hashed), model.probability(text or "", hashed)))
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns[:5]]
                                             + [pa.array(columns[5], pa.float64())], names=[*names, "quality"])
    return judge


def assess(df: DataFrame, model: QualityModel, text_col: str = "text", keep_from: float = KEEP_FROM,
           into: str = "__quality") -> DataFrame:
    """Add struct ``into`` with the statistics, ``quality`` (calibrated probability), ``base_failed`` (under 50 words, or
    more than half of the words in repeated three-word windows) and ``kept`` (not failed, and ``quality``
    at least ``keep_from``).  A null text counts as empty: no words, so it fails.  Other columns, repeated
    rows and empty tables pass unchanged."""
    found = with_struct(df, _judge(model), [F.col(text_col)], into)
    failed = F.expr(f"{into}.n_words < 50 or 100 * {into}.n_repeat_words > 50 * {into}.n_words")
    return found.withColumn(into, F.struct(f"{into}.*", failed.alias("base_failed"),
                                           (~failed & (F.col(f"{into}.quality") >= keep_from)).alias("kept")))


ship_by_value(__name__)
