"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit per dimension (positive or not), cut into chunks of ``CHUNK`` bits.  The index
holds every distinct code under each of its chunks.  A search looks up, chunk by chunk, the values
within a radius ``s`` of the query's chunk.  A code at distance ``d`` has a chunk at distance ``d / m`` or
less (``m`` chunks), so after radius ``s`` every code up to distance ``m * (s + 1) - 1`` has been met and
verified; the radius grows until the k-th verified distance is within that, for each query by itself.

Rows with one code are one index entry that keeps the smallest ``k + 1`` ids (one more than can be asked
for, as a query is not its own neighbour); queries with one code are searched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.session import checkpoint_dir

CHUNK = 16


def chunks_of(vector: Column, chunks: int) -> Column:
    """The code as an array of ``CHUNK``-bit integers; a missing or null element is a zero bit."""
    def bit(j: int, i: int) -> Column:
        return F.when(F.get(vector, F.lit(j * CHUNK + i)) > 0, 1 << i).otherwise(0)
    return F.array(*[sum((bit(j, i) for i in range(1, CHUNK)), bit(j, 0)) for j in range(chunks)])


def _distance(a: str, b: str, chunks: int) -> Column:
    each = [F.bit_count(F.col(a)[j].bitwiseXOR(F.col(b)[j])) for j in range(chunks)]
    return sum(each[1:], each[0])


def _masks(radius: int) -> Column:
    """All chunk values with ``radius`` bits set, as a constant array."""
    return F.expr("array(" + ", ".join(str(x) for x in range(1 << CHUNK) if x.bit_count() == radius) + ")")


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest ids per query code, ties by id (a bounded list: partial limits run before the shuffle)."""
    order = Window.partitionBy("code").orderBy("distance", "id")
    return found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep).drop("__n")


def top_k(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, neighbor_id, distance)``: for each row of ``df`` where ``queries`` holds, the ``k`` other rows
    with the smallest Hamming distance, ties by the smaller id.

    Rows with a null id or vector are neither searched nor found; an empty vector is a code of zero bits.
    Rows repeated under one id count once per code.  Fewer than ``k`` other rows give fewer neighbours; an
    empty table gives none.  Exact: every query ends with all codes up to its k-th distance verified, if need
    be by radius ``CHUNK``, which meets every code."""
    checkpoint_dir(df.sparkSession)
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    bits = rows.agg(F.max(F.size(vector_col))).first()[0] or 0
    m = max(1, -(-bits // CHUNK))
    coded = rows.select(F.col(id_col).cast("long").alias("id"), chunks_of(F.col(vector_col), m).alias("code"),
                        F.coalesce(queries, F.lit(False)).alias("asks")).checkpoint()
    # distinct codes with their smallest ids; a hot code is cut to k + 1 ids before the shuffle
    smallest = Window.partitionBy("code").orderBy("id")
    entries = (coded.select("id", "code").withColumn("__n", F.dense_rank().over(smallest)).where(F.col("__n") <= k + 1)
               .groupBy("code").agg(F.collect_set("id").alias("ids")))
    index = entries.select("code", "ids", F.posexplode("code").alias("j", "value")).checkpoint()
    asked = coded.where("asks").select("code").distinct().checkpoint()
    left, best, radius = asked, None, 0
    while left.take(1):
        probes = (left.select("code", F.posexplode("code").alias("j", "value"))
                  .withColumn("value", F.explode(F.transform(_masks(radius), lambda x: F.col("value").bitwiseXOR(x)))))
        met = (probes.join(index.select(F.col("code").alias("entry"), "ids", "j", "value"), ["j", "value"])
               .select("code", "entry", "ids").dropDuplicates(["code", "entry"])
               .select("code", _distance("code", "entry", m).alias("distance"), F.explode("ids").alias("id")))
        if best is not None:
            met = met.unionByName(best).distinct()
        best = _best(met, k + 1).checkpoint()
        covered = m * (radius + 1) - 1
        done = (best.where(F.col("distance") <= covered).groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(f"n > {k}"))
        radius += 1
        if radius > CHUNK:
            break
        left = left.join(done, "code", "left_anti").checkpoint()
    ask = coded.where("asks").select(F.col("id").alias("query_id"), "code").distinct()
    if best is None:
        best = coded.limit(0).select("code", F.lit(0).alias("distance"), "id")
    near = ask.join(best, "code").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "code").orderBy("distance", "id"))
    return (near.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("neighbor_id"), "distance"))
