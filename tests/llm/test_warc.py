import base64
import gzip
import hashlib
import os

from pyspark.sql import functions as F

from tabsieve.llm import warc


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records_come_back_and_index_selects(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(warc, "SLICE", 4_000)
    monkeypatch.setattr(warc, "GAP", 500)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    index, folder = warc.write_archives(pages, "page_id", "url", "html")
    assert index.count() == pages.count() and index.select("archive").distinct().count() > 1
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for chosen in (index, index.where("id % 7 = 0"), index.where("id = 3"), index.limit(0)):
        rows = warc.read_records(chosen, folder).collect()
        assert len(rows) == chosen.count()
        for r in rows:
            assert bytes(r["payload"]) == html[r["id"]].encode() and r["intact"] and r["digest"] == sha(bytes(r["payload"]))
    # every archive is an ordinary gzip file of WARC records
    path = folder.removeprefix("file://")
    for name in os.listdir(path):
        with gzip.open(f"{path}/{name}") as f:
            assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_equal_payloads_and_awkward_rows(spark):
    rows = [(1, "http://a/1", "same", "x"), (5, "http://a/5", "same", "x"), (5, "http://a/5", "same", "x"), (3, None, "same", None),
            (None, "http://a/n", "same", "x"), (7, "http://a/\n7é", "other é 日本", "x"), (8, "u", None, "x"), (9, "u", "", "x"),
            (10, "u", "z" * 200_000, "x"), (None, None, None, None), (11, "u", "\r\n\r\nWARC/1.1\r\n", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    index, folder = warc.write_archives(df, "page_id", "url", "html")
    got = sorted(((r["id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["digest"], r["intact"])
                  for r in warc.read_records(index, folder).collect()), key=str)
    same, none = sha(b"same"), sha(b"")
    want = [(1, "revisit", 5, 4, same), (5, "response", None, 4, same), (5, "response", None, 4, same), (3, "revisit", 5, 4, same),
            (None, "revisit", 5, 4, same), (7, "response", None, len("other é 日本".encode()), sha("other é 日本".encode())),
            (8, "revisit", 9, 0, none), (9, "response", None, 0, none), (10, "response", None, 200_000, sha(b"z" * 200_000)),
            (None, "revisit", 9, 0, none), (11, "response", None, 14, sha(b"\r\n\r\nWARC/1.1\r\n"))]
    assert got == sorted((w + (True,) for w in want), key=str)
    index, folder = warc.write_archives(df.limit(0), "page_id", "url", "html")
    assert warc.read_records(index, folder).collect() == []


def test_small_payloads_may_stay_responses(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abcdef"), (4, "abcdef")], "id long, p string")
    marked = warc.with_revisits(df.withColumn("p", F.col("p").cast("binary")), "id", "p", smallest=3)
    assert {r["id"]: r["refers_to"] for r in marked.collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_a_task_reads_a_slice_with_adaptive_execution(spark, monkeypatch):
    """Index rows are few bytes, and say nothing of what a task has to read."""
    monkeypatch.setattr(warc, "SLICE", 10_000)
    monkeypatch.setattr(warc, "ARCHIVE_ROWS", 30)
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.lit("u").alias("url"),
                                    F.concat(F.col("id").cast("string"), *[F.sha2((F.col("id") * 100 + k).cast("string"), 512) for k in range(10)]).alias("html"))
    index, folder = warc.write_archives(pages.coalesce(1), "page_id", "url", "html")
    assert index.groupBy("archive").count().agg(F.max("count")).first()[0] == 30  # closed by rows as well
    slices = index.select("archive", F.floor(F.col("offset") / 10_000)).distinct().count()
    assert slices >= 8 and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    read = warc.read_records(index, folder)
    assert read.rdd.getNumPartitions() == slices and read.where("intact").count() == 100


def test_hot_digest_is_salted(spark, monkeypatch):
    """With no broadcast a digest's pages meet its one index row in many partitions, with equal results."""
    rows = [(k, "u", "hot" if k % 3 else f"p{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, u string, p string").withColumn("p", F.col("p").cast("binary")).repartition(6)
    want = sorted(map(tuple, warc.with_revisits(df, "id", "p").select("id", "record_type", "refers_to").collect()))
    monkeypatch.setattr("tabsieve.llm.common.BROADCAST_ROWS", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = warc.with_revisits(df, "id", "p")
        assert "__salt" in salted._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, salted.select("id", "record_type", "refers_to").collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_folder_uris():
    assert warc._folder_uri("file:/a/b") == "file:///a/b" == warc._folder_uri("/a/b") == warc._folder_uri("file:///a/b")
    assert warc._folder_uri("hdfs://n/a") == "hdfs://n/a"
