"""Category audit report sink (A4).

Tables are written as data (Parquet, partitioned by feature) and the HTML fragments are built as
column expressions (values escaped with ``replace`` of ``& < > "``) and written with the text sink,
one folder per feature, ranks in order inside each file.  ``report/`` is the readable document: the
summary first, then per feature (in the summary's order) a heading and its table.  Page styling is not
reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsieve.session import checkpoint_dir


def html_escape(c: Column) -> Column:
    out = F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;"))
    for raw, esc in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return out


def _cell(c: Column) -> Column:
    return F.concat(F.lit("<td>"), F.coalesce(html_escape(c), F.lit("")), F.lit("</td>"))


def _line(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _heads(*names: str) -> str:
    return "<table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"


def report_lines(summary: DataFrame, table: DataFrame) -> DataFrame:
    """``section, feature_at, rank, line``: the document's lines with their order."""
    spark = summary.sparkSession
    order = summary.select("feature", "unique_categories", F.row_number().over(  # one row per feature
        Window.orderBy(F.desc("unique_categories"), F.asc("feature"))).alias("feature_at"))
    fixed = spark.createDataFrame([(0, 0, "<!DOCTYPE html><html><head><meta charset='utf-8'></head><body><h1>Categories</h1>"),
                                   (0, 1, _heads("feature", "unique_categories")), (2, 0, "</table>"), (4, 0, "</body></html>")],
                                  "section int, rank long, line string").withColumn("feature_at", F.lit(0))
    rows = order.select(F.lit(1).alias("section"), "feature_at", F.lit(0).cast("long").alias("rank"), _line(
        "<tr>", _cell(F.col("feature")), _cell(F.col("unique_categories")), "</tr>").alias("line"))
    begin = order.select(F.lit(3).alias("section"), "feature_at", F.lit(-1).cast("long").alias("rank"), _line(
        "<h2>", html_escape(F.col("feature")), "</h2>", _heads("rank", "category", "count", "percentage")).alias("line"))
    end = order.select(F.lit(3).alias("section"), "feature_at", F.lit(2**62).alias("rank"), F.lit("</table>").alias("line"))
    body = table.join(order.select("feature", "feature_at"), "feature").select(
        F.lit(3).alias("section"), "feature_at", "rank", _line("<tr>", *[_cell(F.col(c)) for c in (
            "rank", "category", "count", "percentage")], "</tr>").alias("line"))
    return fixed.unionByName(rows).unionByName(begin).unionByName(body).unionByName(end)


def save_category_audit(summary: DataFrame, table: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write ``summary`` (feature, unique_categories) and ``table`` (feature, rank, category, count,
    percentage) under ``path``: ``summary/`` and ``tables/`` as Parquet, ``html/feature=<f>/`` as
    ``<tr>`` rows, ``report/`` as one document: sorted files whose names are in the order of their lines, as many as the
    session's shuffle makes of its size.  Both tables are computed once.  Returns ``path``."""
    base = path.rstrip("/")
    checkpoint_dir(table.sparkSession)
    summary, table = summary.checkpoint(), table.checkpoint()
    summary.write.mode(mode).parquet(f"{base}/summary")
    (table.repartitionByRange("feature", "rank").sortWithinPartitions("feature", "rank")
          .write.mode(mode).partitionBy("feature").parquet(f"{base}/tables"))
    rows = table.select("feature", "rank", F.concat(
        F.lit("<tr>"), _cell(F.col("rank")), _cell(F.col("category")), _cell(F.col("count")),
        _cell(F.col("percentage")), F.lit("</tr>")).alias("value"))
    (rows.repartitionByRange("feature", "rank").sortWithinPartitions("feature", "rank")
         .select("feature", "value").write.mode(mode).partitionBy("feature").text(f"{base}/html"))
    (report_lines(summary, table).orderBy("section", "feature_at", "rank")
     .select(F.col("line").alias("value")).write.mode(mode).text(f"{base}/report"))
    return base


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """``line_number, line`` of the document under ``path``: its files' lines, numbered on from file to file."""
    files = (spark.read.text(f"{path.rstrip('/')}/report", wholetext=True)
             .select(F.col("_metadata.file_name").alias("file"), F.split(F.regexp_replace("value", "\\n$", ""), "\n").alias("lines")).where("lines[0] <> '' OR size(lines) > 1"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = files.select("file", F.size("lines").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return (files.join(F.broadcast(starts.select("file", "start")), "file").select("start", F.posexplode("lines").alias("at", "line"))
            .select((F.col("start") + F.col("at")).cast("long").alias("line_number"), "line"))
