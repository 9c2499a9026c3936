import math

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tabsieve.llm import quality


def brute(text):
    text = text or ""
    blank = " \t\n\x0b\x0c\r"
    words, now = [], ""
    for c in text + " ":
        if c in blank:
            words += [now] if now else []
            now = ""
        else:
            now += c
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(blank):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics_equal_brute_force(spark, docs, awkward):
    model = quality.QualityModel(np.zeros(quality.BUCKETS), 0.0, 35.0)
    texts = docs.where(F.length("text") < 4000).select("text").limit(250).unionByName(
        awkward.where("coalesce(length(text), 0) < 2000").select("text"))
    for r in quality.assess(texts, model).collect():
        q = r["__quality"]
        want = brute(r["text"])
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert q["base_failed"] == failed and q["kept"] == (not failed)


def test_held_out_accuracy_and_calibration(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learn, held = (labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 0),
                   labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 0))
    model = quality.fit(docs, learn)
    found = (quality.assess(docs, model).join(held.where("quality is not null").withColumnRenamed("quality", "label"), "doc_id")
             .select("label", "__quality.*").where("not base_failed"))
    right, rows = found.agg(F.avg((F.col("kept") == (F.col("label") == 1)).cast("int")), F.count("*")).first()
    assert rows > 60 and right >= 0.95


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (8, 0), (9, 0), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")
    model = quality.fit(awkward, labels)
    assert quality.assess(awkward, model).count() == awkward.count()
    assert quality.assess(empty, model).collect() == []
    unlabelled = quality.fit(awkward, labels.limit(0))
    rows = quality.assess(awkward, unlabelled, into="kept").collect()
    assert all(r["kept"]["kept"] != r["kept"]["base_failed"] and r["kept"]["quality"] > 0.99 for r in rows)


def test_long_texts_are_chunked_without_change(monkeypatch):
    text = "the and of été 語り " * 300
    hashed = quality.word_hashes(text.encode().split())
    model = quality.QualityModel(np.random.default_rng(1).normal(0, 1, quality.BUCKETS), 1.0, 0.0)
    whole = model.probability(text, hashed)
    monkeypatch.setattr(quality, "_CHUNK", 100)
    assert abs(model.probability(text, hashed) - whole) < 1e-5


def plain_features(text):
    """Bucket -> value by integers, one n-gram at a time."""
    wide, narrow = 1 << 64, 1 << 32
    out = {}

    def add(grams, bucket):
        for g in grams:
            b = bucket(g)
            out[b] = out.get(b, 0.0) + 40.0 / len(grams)

    hashes = [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in quality_words(text)]
    a, b = (int(c) for c in quality._odd_constants(23, 2, np.uint64))
    add(hashes, lambda h: h >> 48)
    add(list(zip(hashes, hashes[1:])),
        lambda p: int(quality._mixed(np.array([(p[0] * a + p[1] * b) % wide], np.uint64))[0]) >> 48)

    def window(gram):
        total = 0
        for c, factor in zip(gram, quality._odd_constants(19, quality.CHARS, np.uint32)):
            total = ((total ^ (total >> 15)) * 0x2C1B3C6D + ord(c) * int(factor)) % narrow
        return (((total ^ (total >> 13)) * 0x297A2D39) % narrow >> 16) + quality.BUCKETS // 2

    add([text[k:k + quality.CHARS] for k in range(len(text) - quality.CHARS + 1)], window)
    return out


def quality_words(text):
    for blank in "\t\n\x0b\x0c\r":
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def test_whole_prediction_equals_a_plain_one(spark, docs, awkward):
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    texts = docs.where(F.length("text") < 3000).select("text").limit(200).unionByName(
        awkward.where("coalesce(length(text), 0) < 2000").select("text"))
    verdicts = set()
    for r in quality.assess(texts, model).collect():
        score = sum(float(model.weights[b]) * v for b, v in plain_features(r["text"] or "").items())
        want = 1 / (1 + math.exp(-max(-35, min(35, model.slope * score + model.offset))))
        got = r["__quality"]
        assert abs(got["quality"] - want) < 1e-4
        if abs(want - quality.KEEP_FROM) > 1e-4:
            assert got["kept"] == (not got["base_failed"] and want >= quality.KEEP_FROM)
        verdicts.add(got["kept"])
    assert verdicts == {True, False}


def test_word_order_and_ideographs_are_features():
    of = lambda text: set(np.concatenate(
        [b for b, _ in quality.buckets_of(text, quality.word_hashes(text.encode().split()))][:2]).tolist())
    assert of("one two three") != of("three two one")
    windows = [b for b, _ in quality.buckets_of("日本語文字", quality.word_hashes(["日本語文字".encode()]))][-1]
    assert len(windows) == 2  # five code points: two windows of four
