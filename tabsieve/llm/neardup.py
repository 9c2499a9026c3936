"""MinHash near-duplicates: universal hash minima, banding, signature verification, an exact check on
full shingle sets, and connected components by alternating large-star and small-star.

Words are ASCII-lower-cased runs of non-whitespace; a text's set is its distinct 5-word shingles, and a
text with fewer words has its whole sequence as the one shingle.

How links stay complete without all pairs.  Texts with equal words are one node.  In a band bucket of
two nodes the one pair is checked.  In a larger bucket every node is first checked against one leader;
then only pairs of nodes that are *still in different components* are checked, and only if three exact
bounds allow a link: the set sizes, the numbers of shingles that no other bucketed text has, and a map
of which hash cells a set occupies.  A shingle of the first kind (``u`` of them) lies outside every
intersection, so with ``a = n - u`` ``|x & y| <= min(a_x, a_y)`` and ``|x | y| >= u_x + u_y +
max(a_x, a_y)``.  A cell that x occupies and y does not holds a shingle of x that y has not, so
``|x & y| <= n_x - (cells of x without y)``.  A pair inside one component cannot change a component, so
leaving it out loses nothing.

With 240 minima in 40 bands of 6, a pair at similarity 0.85 misses every band with probability 6e-9,
and at 0.8 with 5e-6; the signature estimate is only used to drop pairs more than five standard
deviations below the threshold, and every link is confirmed on full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve._ship import ship_by_value
from tabsieve.llm.common import materialise, texts, with_struct
from tabsieve.llm.components import connected_components

SHINGLE_WORDS = 5
BANDS, ROWS = 40, 6
MINIMA = BANDS * ROWS
#: how far below the threshold the signature estimate may be (over 5 standard deviations at 0.8)
ESTIMATE_MARGIN = 0.14
CELL_WORDS = 16  # 64-bit words of the map of occupied hash cells
_BLOCK = 1024  # shingles hashed at a time: the minima's working set stays in cache for any length


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd_constants(seed: int, count: int, dtype) -> np.ndarray:
    values = np.random.default_rng(seed).integers(0, 2**63, count, dtype=np.uint64)
    return values.astype(dtype) | dtype(1)


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower case, split on space and tab to carriage return (what ``bytes`` methods do)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    factors = _odd_constants(7, size, np.uint64)
    count = len(words) - size + 1
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total += hashed[k:k + count] * factors[k]
    return np.unique(_mixed(total))


def occupied_cells(shingles: np.ndarray) -> np.ndarray:
    """A bit per hash cell that holds a shingle, as ``CELL_WORDS`` words."""
    flags = np.zeros(64 * CELL_WORDS, bool)
    flags[(shingles % np.uint64(64 * CELL_WORDS)).astype(np.int64)] = True
    return np.packbits(flags).view(np.int64)


def minima_of(shingles: np.ndarray) -> np.ndarray:
    """``MINIMA`` minima of the universal hashes ``a * x + b`` over the set, a block at a time."""
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    a, b = _odd_constants(11, MINIMA, np.uint32)[:, None], _odd_constants(13, MINIMA, np.uint32)[:, None]
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), _BLOCK):
        np.minimum(low, (a * folded[None, at:at + _BLOCK] + b).min(axis=1), out=low)
    return low


def band_keys(minima: np.ndarray) -> np.ndarray:
    rows = minima.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        total = _mixed(total + rows[:, k])
    return total.view(np.int64)


def _sketcher(size: int):
    @F.arrow_udf("digest binary, n long, keys array<long>, sig binary")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            digests, counts, keys, sigs = [], [], [], []
            for text in texts(batch):
                words = words_of(text)
                found = shingle_set(words, size)
                counts.append(len(found))
                if not words:
                    digests.append(None), keys.append(None), sigs.append(None)
                    continue
                low = minima_of(found)
                digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                keys.append(band_keys(low))
                sigs.append((low & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
            yield pa.StructArray.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(counts, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["digest", "n", "keys", "sig"])
    return sketch


def _set_maker(size: int):
    @F.arrow_udf("shingles binary, cells array<long>")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingle_set(words_of(t), size) for t in texts(batch)]
            yield pa.StructArray.from_arrays(
                [pa.array([x.tobytes() for x in sets], pa.binary()),
                 pa.array([occupied_cells(x) for x in sets], pa.list_(pa.int64()))], names=["shingles", "cells"])
    return make


@F.arrow_udf(T.DoubleType())
def estimated(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of equal minima of two signatures."""
    return pa.array([float((np.frombuffer(x.as_py(), np.uint16) == np.frombuffer(y.as_py(), np.uint16)).mean())
                     for x, y in zip(a, b)], pa.float64())


@F.arrow_udf(T.LongType())
def shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """Size of the intersection of two sorted shingle sets."""
    out = []
    for x, y in zip(a, b):
        left, right = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
        both = np.sort(np.concatenate([left, right]), kind="stable")
        out.append(int((both[1:] == both[:-1]).sum()))
    return pa.array(out, pa.int64())


def _linked(percent: int, inter, n_a, n_b):
    return 100 * inter >= percent * (n_a + n_b - inter)


def _sizes_allow(percent: int):
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _bound_allows(percent: int):
    """The pair's best possible similarity given the shingles that only one text has."""
    inter = F.least(F.expr("n_a - u_a"), F.expr("n_b - u_b"))
    union = F.col("u_a") + F.col("u_b") + F.greatest(F.expr("n_a - u_a"), F.expr("n_b - u_b"))
    return _sizes_allow(percent) & (100 * inter >= percent * union)


def _cells_allow(percent: int):
    """The pair's best possible similarity given the hash cells that only one of the sets occupies."""
    def alone(x: str, y: str):
        words = [F.bit_count(F.col(f"cells_{x}")[k].bitwiseAND(F.bitwise_not(F.col(f"cells_{y}")[k])))
                 for k in range(CELL_WORDS)]
        return sum(words[1:], words[0])
    inter = F.least(F.col("n_a") - alone("a", "b"), F.col("n_b") - alone("b", "a"))
    return _linked(percent, inter, F.col("n_a"), F.col("n_b"))


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links: signature estimate first, then the full sets."""
    for side in "ab":
        pairs = pairs.join(sigs.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}")), side)
    likely = (pairs.withColumn("__est", estimated.asNondeterministic()("sig_a", "sig_b"))
              .where(F.col("__est") >= percent / 100 - ESTIMATE_MARGIN).select("a", "b"))
    for side in "ab":
        likely = likely.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"),
                                         F.col("shingles").alias(f"s_{side}")), side)
    return (likely.withColumn("__i", shared.asNondeterministic()("s_a", "s_b"))
            .where(_linked(percent, F.col("__i"), F.col("n_a"), F.col("n_b")))
            .select(F.col("a").alias("src"), F.col("b").alias("dst")))


#: rows of one side of a sub-bucket that a task compares with the other side's
_MEETING = 256


def _met(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components (``part``) of one bucket (``key``) that may pass ``_bound_allows``.

    With ``c = n - u`` and ``c_a >= c_b`` the bound is ``100 * c_b >= percent * (u_a + u_b + c_a)``.  So ``c_b`` lies within
    ``percent`` of ``c_a``, in its class of ``log c`` or the one below, and ``u_b <= 100 * c_a / percent - c_a - u_a``, in one
    of the classes by bits up to that bound's.  Buckets are cut by both classes, which loses no pair: texts that share much but not
    enough are in none that another of them asks for.  What is left of a bucket is dealt over salts."""
    partitions = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = math.log(100.0 / percent) * 1.0001 if percent < 100 else 1e-9
    bits = lambda u: F.when(u > 0, F.length(F.bin(u))).otherwise(0)
    rows = materialise(open_.withColumn("c", F.expr("n - u")).withColumn("cc", F.floor(F.log("c") / F.lit(width)))
                       .select("key", "cc", bits(F.col("u")).alias("ub"), (F.col("part") == F.col("largest")).alias("main"),
                               "c", "n", "u", "part", "node", "cells"), "neardup-open")
    cut = ["key", "cc", "ub", "main"]
    shares = rows.groupBy(*cut).agg(F.ceil(F.count(F.lit(1)) / F.lit(_MEETING)).cast("int").alias("salts")).checkpoint()
    room = F.expr(f"(100 * c) div {percent} - c - u")
    asks = (rows.withColumn("room", room).where("room >= 0")
            .withColumn("cc", F.explode(F.array(F.col("cc"), F.col("cc") - 1)))
            .withColumn("ub", F.explode(F.sequence(F.lit(0), bits(F.col("room")).cast("int"))))
            .withColumn("main", F.explode(F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
            .join(shares, cut).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))))
    held = rows.join(shares, cut).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    # few bytes but many comparisons: a fixed number of partitions, which are not merged by size
    sides = [side.repartition(partitions, *cut, "salt")
             .select(*cut, "salt", *[F.col(x).alias(f"{x}_{s}") for x in ("n", "u", "c", "part", "cells")], F.col("node").alias(s))
             for s, side in (("a", asks), ("b", held))]
    return (sides[0].join(sides[1], [*cut, "salt"])
            .where("part_a <> part_b AND (c_a > c_b OR (c_a = c_b AND a > b))"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
                    size: int = SHINGLE_WORDS) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row per input row.

    ``component_id`` is the smallest id reachable over links (similarity ``>= percent`` / 100 on full
    sets), ``kept`` is true for that id.  Null, empty and blank texts have no shingle, link with
    nothing and are kept.  Rows with one id are one document: each is returned, all with that id's
    component.  A row without id cannot name a component: it gets the smallest id among texts equal or
    linked to its own, or NULL (and is then kept).  An empty table gives an empty result; columns other
    than the two named are ignored."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = materialise(with_struct(rows, _sketcher(size), [F.col("text")])
                           .select("id", "__r.*"), "neardup-sketch")

    # texts with equal words are one node, named by their smallest id
    nodes = (sketches.where("digest is not null and id is not null")
             .groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"))).checkpoint()
    named = sketches.where("digest is not null").select("id", "digest", "keys", "sig")
    bands = (named.select("id", "digest", "keys").join(nodes, "digest").where("id = node").dropDuplicates(["digest"])
             .select("node", "n", F.explode("keys").alias("key")))
    stats = bands.groupBy("key").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    bucketed = materialise(bands.join(stats, "key"), "neardup-buckets")

    members = bucketed.select("node").distinct()
    sigs = (named.select("digest", "sig").join(nodes.join(members, "node"), "digest")
            .dropDuplicates(["digest"]).select("node", "sig"))
    text_of = (rows.where("id is not null").join(members, rows.id == members.node, "left_semi"))
    sets = materialise(with_struct(text_of, _set_maker(size), [F.col("text")])
                       .select(F.col("id").alias("node"), "__r.*")
                       .withColumn("n", F.expr("length(shingles) div 8")).where("n > 0")
                       .dropDuplicates(["node", "shingles"]), "neardup-sets")
    sigs = materialise(sigs, "neardup-signatures")

    # buckets of two: their one pair
    two = (bucketed.where("cnt = 2").groupBy("key")
           .agg(F.min(F.struct("node", "n")).alias("x"), F.max(F.struct("node", "n")).alias("y"))
           .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"),
                   F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
           .where("a <> b").where(_sizes_allow(percent)).select("a", "b"))

    # larger buckets: shingles that no other of their texts has, then one leader with the fewest
    crowded = bucketed.where("cnt > 2")
    lone = (sets.join(crowded.select("node").distinct(), "node", "left_semi")
            .select("node", F.explode(_unpacked("shingles")).alias("h"))
            .groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
            .groupBy("node").agg(F.count(F.lit(1)).alias("u")))
    crowd = materialise(crowded.select("key", "node", "n")
                        .join(lone, "node", "left").na.fill(0, ["u"])
                        # a text with too many shingles of its own links with no other text of its buckets
                        .where(100 * F.expr("n - u") >= percent * F.col("n")), "neardup-crowd")
    lead = crowd.groupBy("key").agg(F.min(F.struct(F.expr("u / n").alias("f"), "node", "n", "u")).alias("l"))
    star = (crowd.join(lead, "key")
            .select(F.col("l.node").alias("a"), F.col("node").alias("b"), F.col("l.n").alias("n_a"),
                    F.col("n").alias("n_b"), F.col("l.u").alias("u_a"), F.col("u").alias("u_b"))
            .where("a <> b").where(_bound_allows(percent))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    tested = two.unionByName(star).distinct().checkpoint()
    links = _confirmed(tested, sigs, sets, percent).checkpoint()
    parts = connected_components(links)

    # what is still apart inside a larger bucket
    placed = (crowd.join(parts, "node", "left")
              .withColumn("part", F.coalesce("component", "node")).drop("component"))
    mixed = (placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"))
             .groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", "part")).alias("most"))
             .where("parts > 1").select("key", F.col("most.part").alias("largest")))
    open_ = (placed.join(mixed, "key").join(sets.select("node", F.col("n").alias("n_set"), "cells"), "node")
             .where("n = n_set"))
    apart = (_met(open_, percent).where(_bound_allows(percent)).where(_cells_allow(percent))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
    links = links.unionByName(_confirmed(apart, sigs, sets, percent)).checkpoint()

    named_parts = (nodes.join(connected_components(links), "node", "left")
                   .select("digest", F.coalesce("component", "node").alias("part")))
    out = sketches.select("id", "n", "digest").join(named_parts, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.coalesce("part", "id").alias("component_id"),
                      F.coalesce(F.col("id") == F.coalesce("part", "id"), F.col("part").isNull()).alias("kept"))


def _unpacked(column: str):
    """A packed shingle set as an array of longs."""
    return unpack.asNondeterministic()(F.col(column))


@F.arrow_udf(T.ArrayType(T.LongType()))
def unpack(packed: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(x.as_py(), np.int64) for x in packed], pa.list_(pa.int64()))


ship_by_value(__name__)
