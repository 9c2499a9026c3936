"""CSV source round trip (A1-A3), report sink (A4) and the streaming use of row-level operators."""

import os
import re
import subprocess
import sys
import tempfile

from conftest import ROOT
from pyspark.sql import functions as F

from tabsieve.operators import cleaning, freq
from tabsieve.sources.csv import preview, read_csv, shape
from tabsieve.sources.reports import save_category_audit
from tabsieve.streaming.cleaning_stream import apply_steps, read_parquet_stream, write_parquet_stream


def test_csv_pandas_semantics(spark):
    folder = tempfile.mkdtemp(prefix="tabsieve-csv-", dir="/tmp")
    path = os.path.join(folder, "t.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(',a,b,,flag\n0,NA,"q ""in"" q",1,True\n1,2,"line\nbreak",x,FALSE\n2,3.5,plain,,\n')
    df = read_csv(spark, path)
    assert df.columns == ["a", "b", "flag"]
    assert dict(df.dtypes)["flag"] == "boolean"
    rows = df.orderBy("b").collect()
    assert shape(df) == (3, 3)
    assert dict(df.dtypes)["a"] == "double"
    assert {r.b for r in rows} == {'q "in" q', "line\nbreak", "plain"}
    assert sorted([r.a for r in rows], key=lambda v: (v is None, v)) == [2.0, 3.5, None]
    assert preview(df, 1, ["b"]).count() == 1


def test_csv_splits_files_without_line_breaks_in_fields(spark, tmp_path):
    """Of three files only the one with such a field is read whole; odd names and stray quotes do no harm."""
    folder = tmp_path / "in put"
    folder.mkdir()
    plain = "a,b\n" + "".join(f'{k},"x ""{k}"" y"\n' for k in range(40_000))
    (folder / "plain [1].csv").write_text(plain)
    (folder / "broken %41*.csv").write_text('a,b\n1,"one\ntwo\r\nthree"\n2,"""quoted"""\n')
    (folder / "stray.csv").write_text('a,b\n3,5" pipe\n4,z\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        df = read_csv(spark, str(folder))
        parts = {(r["f"], r["p"]) for r in df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("f"), F.spark_partition_id().alias("p"))
                 .distinct().collect()}
        rows = df.where("a < 5 AND b NOT LIKE 'x %'").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert df.count() == 40_004 and dict(df.dtypes)["a"] == "bigint"
    assert sorted((r["a"], r["b"]) for r in rows) == [(1, "one\ntwo\r\nthree"), (2, '"quoted"'), (3, '5" pipe'), (4, "z")]
    assert len([f for f, _ in parts if "plain" in f]) > 2 and len([f for f, _ in parts if "broken" in f]) == 1


def test_report_sink(spark):
    df = spark.createDataFrame([("a<b",), ("x",), ("x",)], "c string")
    out = save_category_audit(freq.category_summary(df, ["c"]), freq.category_table(df, ["c"]),
                              tempfile.mkdtemp(prefix="tabsieve-report-", dir="/tmp") + "/r")
    html = spark.read.text(out + "/html").collect()
    assert any("a&lt;b" in r.value for r in html)
    assert spark.read.parquet(out + "/tables").count() == 2


def test_report_of_many_files_reads_in_order(spark, tmp_path):
    """A document of several files has its lines in the order of one."""
    from tabsieve.sources.reports import read_report
    df = spark.createDataFrame([(f"v{k % 900}", f"w{k % 7}") for k in range(3000)], "c string, d string")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    found = []
    for k, adaptive in enumerate(("true", "false")):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            out = save_category_audit(freq.category_summary(df, ["c", "d"]), freq.category_table(df, ["c", "d"]), str(tmp_path / str(k)))
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", old)
        found.append([r["line"] for r in read_report(spark, out).orderBy("line_number").collect()])
        assert [r["line_number"] for r in read_report(spark, out).orderBy("line_number").collect()] == list(range(len(found[0])))
    assert found[0] == found[1] and len(found[0]) == 2 + 2 + 1 + 2 * 2 + 907 + 1
    assert len([f for f in os.listdir(tmp_path / "1" / "report") if f.endswith(".txt")]) > 1


def test_stream_equals_batch(spark):
    from pyspark.sql import types as T
    src = "/root/testdata/sf0.01"
    batch = spark.read.parquet(f"{src}/labels.parquet")
    steps = [lambda d: d.withColumn("flag", F.when(F.col("quality") == 1, "Sí").otherwise("no")),
             lambda d: cleaning.encode_binary(d, "flag"),
             lambda d: cleaning.range_filter(d, {"toxic": (None, 0)}),
             lambda d: d.withColumn("tag", F.when(F.col("quality") == 1, "Bueno_Á").otherwise("malo")),
             lambda d: cleaning.apply_semantic_mapping(d, "tag", {"good": ["bueno a"]})]
    stream = apply_steps(read_parquet_stream(spark, src, batch.schema, "labels.parquet"), steps)
    out = tempfile.mkdtemp(prefix="tabsieve-stream-", dir="/tmp") + "/o"
    q = write_parquet_stream(stream, out, checkpoint=out + "_ckpt")
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    expected = apply_steps(batch, steps)
    assert got.count() == expected.count()
    assert got.exceptAll(expected.select(*got.columns)).count() == 0


def test_stream_default_checkpoint_survives_a_restart(spark, tmp_path):
    """Two processes: the second finds the first one's checkpoint and appends only what is new."""
    script = """
import sys
from pyspark.sql import SparkSession
from tabsieve.streaming.cleaning_stream import read_parquet_stream, stream_checkpoint, write_parquet_stream
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", sys.argv[3]).getOrCreate())
stream = read_parquet_stream(spark, sys.argv[1], spark.read.parquet(sys.argv[1]).schema)
write_parquet_stream(stream, sys.argv[2]).awaitTermination(120)
print("CHECKPOINT", stream_checkpoint(spark, sys.argv[2]), spark.read.parquet(sys.argv[2]).count())
"""
    source, out, shared = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "shared")
    found = []
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
        done = subprocess.run([sys.executable, "-c", script, source, out, shared], capture_output=True, text=True,
                              timeout=200, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT, "PYTHONHASHSEED": str(k + 1)})
        found.append(re.search("CHECKPOINT (.*) (.*)", done.stdout).groups())
    assert found[0][0] == found[1][0] and found[0][0].startswith(shared)
    assert [int(n) for _, n in found] == [10, 20]
