"""Connected components by alternating large-star and small-star.

Each half-step is a grouped minimum, pre-aggregated before its shuffle, and an equi-join of the edges to it.  Nodes that hold
more than ``1 / HEAVY`` of the edges are at most ``2 * HEAVY``; their minima are broadcast, so a hub's edges stay where
they are, and no node of the shuffled rest can be hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.common import looked_up
from tabsieve.session import checkpoint_dir

HEAVY = 50_000


def _with_low(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    if total < HEAVY:  # every node is heavy
        return edges.join(F.broadcast(low), "u").select("u", "v", "low")
    return looked_up(edges, "u", low, F.col("degree") * HEAVY > total).select("u", "v", "low")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every strictly larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("degree")).withColumn("low", F.least("u", "low"))
    return _with_low(both.where("v > u"), low, total).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them (edges run from larger to smaller)."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("degree"))
    moved = _with_low(edges, low, total).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that is not itself the smallest of its component.

    ``component`` is the smallest node reachable; nodes that appear in no row are their own component.
    Self-loops, repeated and reversed edges and edges with a NULL end are allowed (the last are
    dropped).  Runs until a whole round changes nothing (no limit on rounds); every round is cut with a
    reliable ``checkpoint()``, and only a count and a checksum come back to the driver."""
    checkpoint_dir(edges.sparkSession)
    current = (edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
               .where(F.col(src).isNotNull() & F.col(dst).isNotNull()).where("u <> v").distinct().checkpoint())
    state = None
    total = current.count()
    while True:
        larger = _large_star(current, total).checkpoint()  # read again by the next half-step
        current = _small_star(larger, total).checkpoint()
        before, state = state, _state(current)
        total = state[0]
        if state == before or not total:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
