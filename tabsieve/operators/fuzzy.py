"""Near-duplicate category values.

Input is the frequency table of each feature (distinct values, after a partial/final aggregation),
never the raw rows.

Candidate pairs are exact.  difflib's matched characters form a common subsequence, so a ratio
``2M / (la + lb) >= t`` leaves at most ``d = floor((1 - t)(la + lb))`` characters of the two strings unmatched.

* ``t >= 0.75``: the shorter string is cut into ``d + 1`` segments.  Each unmatched character spoils one
  segment at most, so one segment stands in the longer string, moved by no more than the characters
  dropped and added before it.  Segments and substrings meet in an equi-join on (feature, length, d,
  segment number, segment).
* below that, segments get too short to select.  Strings are sets of tokens ``char#occurrence`` ordered by
  rarity.  Two strings that have ``o`` tokens in common share ``s`` of the first ``l - o + s`` of each.  For two lengths
  up to ``SHORT``, ``o`` is known, and ``s`` is taken as large as ``SIGNATURES`` subsets a value allow (all of ``o`` for
  common lengths of up to ten): the subsets of ``s`` tokens meet in an equi-join on (feature, both lengths, subset).  A pair
  with a longer string must share ``SHARED`` single tokens.

The pairs are then tested for character overlap on token arrays, and only what passes is scored, once,
by difflib.

J1's sequential greedy loop equals the lexicographically-first maximal independent set of the
directed graph ``earlier -> later`` (edge when ``ratio(leader, other) >= t``).  It is computed in
rounds over the edge table: a node with a leader predecessor becomes a member, a node whose
predecessors are all members becomes a leader; every round decides at least the lowest undecided
node, so the rounds end by themselves.  Each round's status table is cut with a reliable
``checkpoint()``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.labels import LIST_SEPARATOR
from tabsieve.functions.missing import py_strip
from tabsieve.functions.similarity import scored_at_least
from tabsieve.functions.text import normalize_category, normalize_text
from tabsieve.operators.freq import as_text, long_values
from tabsieve.operators.ordering import ordered_positions
from tabsieve.session import checkpoint_dir

_EPS = 1e-9
SEGMENT_FROM = 0.75
SHARED = 3
#: longest value whose pairs are found by token subsets, and the most subsets a value has for one partner length
SHORT = 20
SIGNATURES = 256


def vocabulary(df: DataFrame, columns: Sequence[str], normalizer, strip: bool = False) -> DataFrame:
    """``feature, rank, category, count, norm, len`` of the non-null values of ``columns``;
    rank 1..k by count desc, category asc (skew-safe ordering, materialised once)."""
    values = long_values(df, columns).where(F.col("category").isNotNull())
    if strip:
        values = values.withColumn("category", py_strip(F.col("category")))
    freq = (values.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("count"))
                  .withColumn("norm", normalizer(F.col("category"))))
    # the normaliser runs inside the materialised ranking, not again for every later use
    ranked = ordered_positions(freq, ["feature"], [F.desc("count"), F.asc("category")], pos_col="rank")
    return ranked.select("feature", F.col("rank").cast("long").alias("rank"), "category",
                         F.col("count").cast("long").alias("count"), "norm"
                         ).withColumn("len", F.length("norm"))


def _tokens(norm: Column) -> Column:
    """``char#occurrence`` for every character: two strings' arrays intersect in as many tokens as they have
    characters in common."""
    chars = F.regexp_extract_all(norm, F.lit("(?s)(.)"), 1)
    return F.transform(chars, lambda c, i: F.concat(c, F.lit("#"), F.size(F.filter(
        F.slice(chars, 1, i + 1), lambda x: x == c)).cast("string")))


def _least_partner(length: Column, threshold: float) -> Column:
    """Length of the shortest partner that can reach ``threshold``; also the least overlap with any partner."""
    return F.ceil(length.cast("double") * F.lit(threshold / (2.0 - threshold)) - F.lit(_EPS)).cast("int")


def _unmatched(la: Column, lb: Column, threshold: float) -> Column:
    return F.floor((la + lb).cast("double") * F.lit(1.0 - threshold) + F.lit(_EPS)).cast("int")


def _segment_pairs(vocab: DataFrame, threshold: float) -> DataFrame:
    v = vocab.where(F.col("len") > 0).select("feature", "rank", "norm", "len")
    begin = F.floor(F.col("k") * F.col("la") / (F.col("d") + 1)).cast("int")
    width = F.floor((F.col("k") + 1) * F.col("la") / (F.col("d") + 1)).cast("int") - begin
    longest = F.floor(F.col("len").cast("double") * F.lit((2.0 - threshold) / threshold) + F.lit(_EPS)).cast("int")
    cut = (v.withColumn("la", F.col("len"))
            .withColumn("d", F.explode(F.array_distinct(F.transform(
                F.sequence(F.col("len"), longest), lambda lb: _unmatched(F.col("len"), lb, threshold)))))
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("d"))))
            .select("feature", F.col("rank").alias("ra"), "la", "d", "k", F.substring("norm", begin + 1, width).alias("seg")))
    spare = F.col("len") - F.col("la")
    first = F.greatest(F.lit(0), F.col("begin") - F.floor((F.col("d") - spare) / 2).cast("int"))
    last = F.least(F.col("len") - F.col("width"), F.col("begin") + F.floor((F.col("d") + spare) / 2).cast("int"))
    parts = (v.withColumn("la", F.explode(F.sequence(_least_partner(F.col("len"), threshold), F.col("len"))))
              .withColumn("d", _unmatched(F.col("la"), F.col("len"), threshold))
              .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("d"))))
              .withColumn("begin", begin).withColumn("width", width).withColumn("first", first).withColumn("last", last)
              .where("first <= last").withColumn("at", F.explode(F.sequence(F.col("first"), F.col("last"))))
              .select("feature", F.col("rank").alias("rb"), F.col("len").alias("lb"), "la", "d", "k",
                      F.substring("norm", F.col("at") + 1, F.col("width")).alias("seg")).distinct())
    met = cut.join(parts, ["feature", "la", "d", "k", "seg"]).where("la < lb or ra < rb").where("ra <> rb")
    return met.select("feature", F.least("ra", "rb").alias("r1"), F.greatest("ra", "rb").alias("r2")).distinct()


def _empty_pairs(vocab: DataFrame) -> DataFrame:
    empties = vocab.where(F.col("len") == 0).select("feature", F.col("rank").alias("rb"))
    first_empty = empties.groupBy("feature").agg(F.min("rb").alias("ra"))  # the first stands for all pairs of them
    return (first_empty.join(empties, "feature").where("ra < rb")
            .select("feature", F.col("ra").alias("r1"), F.col("rb").alias("r2")))


def subset_sizes(threshold: float) -> list[tuple[int, int, int, int]]:
    """``(small, big, overlap, s)`` for every two lengths up to ``SHORT`` whose strings can reach ``threshold``: the
    tokens they must have in common, and the size of the subsets of them that are looked for."""
    out = []
    for small in range(1, SHORT + 1):
        for big in range(small, SHORT + 1):
            overlap = math.ceil((small + big) * threshold / 2 - _EPS)
            if overlap <= small:
                out.append((small, big, overlap, max(s for s in range(1, overlap + 1)
                                                     if s == 1 or math.comb(big - overlap + s, s) <= SIGNATURES)))
    return out


def _by_rarity(vocab: DataFrame) -> DataFrame:
    tokens = vocab.select("feature", "rank", "len", F.explode(_tokens(F.col("norm"))).alias("tok"))
    return tokens.join(tokens.groupBy("feature", "tok").agg(F.count(F.lit(1)).alias("_df")), ["feature", "tok"])


def _subset_pairs(vocab: DataFrame, threshold: float) -> DataFrame:
    """Pairs of values of 1 to ``SHORT`` characters."""
    ordered = (_by_rarity(vocab.where(F.col("len").between(1, SHORT))).groupBy("feature", "rank", "len")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("_df", "tok"))), lambda x: x["tok"]).alias("toks")))
    rows = [(own, *sizes) for sizes in subset_sizes(threshold) for own in sorted(set(sizes[:2]))]
    sizes = vocab.sparkSession.createDataFrame(rows, "len int, small int, big int, overlap int, s int")  # at most SHORT^2 rows
    subsets = ("filter(aggregate(slice(toks, 1, len - overlap + s), array(cast(array() as array<string>)), (acc, x) -> "
               "concat(acc, transform(filter(acc, q -> size(q) < s), q -> concat(q, array(x))))), q -> size(q) = s)")
    # equal hashes of unequal subsets only add a candidate
    signed = (ordered.join(F.broadcast(sizes), "len").withColumn("sig", F.explode(F.expr(subsets)))
              .select("feature", "rank", "len", "small", "big", F.xxhash64("sig").alias("sig")))
    a = signed.where("len = small").select("feature", "small", "big", "sig", F.col("rank").alias("ra"))
    b = signed.where("len = big").select("feature", "small", "big", "sig", F.col("rank").alias("rb"))
    return (a.join(b, ["feature", "small", "big", "sig"]).where("ra < rb or (small < big and ra <> rb)")
             .select("feature", F.least("ra", "rb").alias("r1"), F.greatest("ra", "rb").alias("r2")).distinct())


def _prefix_pairs(vocab: DataFrame, threshold: float) -> DataFrame:
    """Pairs of which at least one value has more than ``SHORT`` characters."""
    tokens = _by_rarity(vocab.where(F.col("len") >= _least_partner(F.lit(SHORT + 1), threshold)))
    order = Window.partitionBy("feature", "rank").orderBy("_df", "tok")
    length = F.col("len") - _least_partner(F.col("len"), threshold) + SHARED
    prefix = (tokens.withColumn("_i", F.row_number().over(order))
                    .where(F.col("_i") <= F.greatest(length, F.lit(1))).select("feature", "rank", "len", "tok"))
    a = prefix.select("feature", "tok", F.col("rank").alias("r1"), F.col("len").alias("l1"))
    b = prefix.select("feature", "tok", F.col("rank").alias("r2"), F.col("len").alias("l2"))
    both = F.col("l1") + F.col("l2")
    overlap = F.ceil(both.cast("double") * F.lit(threshold / 2.0) - F.lit(_EPS))
    return (a.join(b, ["feature", "tok"]).where("r1 < r2").where(F.greatest("l1", "l2") > SHORT)
             .where(2.0 * F.least("l1", "l2") >= F.lit(threshold) * both - F.lit(_EPS))
             .groupBy("feature", "r1", "r2", "l1", "l2").agg(F.count(F.lit(1)).alias("_shared"))
             .where(F.col("_shared") >= F.greatest(F.lit(1), F.least(F.lit(SHARED), overlap))).select("feature", "r1", "r2"))


def candidate_pairs(vocab: DataFrame, threshold: float) -> DataFrame:
    """``feature, r1, r2`` (r1 < r2) for every pair that can have ratio >= threshold in either
    direction (the bounds are symmetric).  Values with an empty normal form equal only each other."""
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]; t <= 0 would make every pair a candidate")
    found = (_segment_pairs(vocab, threshold) if threshold >= SEGMENT_FROM
             else _subset_pairs(vocab, threshold).unionByName(_prefix_pairs(vocab, threshold)))
    return found.unionByName(_empty_pairs(vocab))


def scored_edges(vocab: DataFrame, threshold: float, earlier_first: bool) -> DataFrame:
    """``feature, r1, r2, score, rounded`` with ``score >= threshold``; ``earlier_first`` scores
    ``ratio(norm[r1], norm[r2])`` (J1), otherwise ``ratio(norm[r2], norm[r1])`` (J2)."""
    sides = [vocab.select("feature", F.col("rank").alias(f"r{k}"), F.col("norm").alias(f"n{k}"), F.col("len").alias(f"l{k}"),
                          _tokens(F.col("norm")).alias(f"t{k}")) for k in (1, 2)]
    p = candidate_pairs(vocab, threshold).join(sides[0], ["feature", "r1"]).join(sides[1], ["feature", "r2"])
    p = p.where(2.0 * F.size(F.array_intersect("t1", "t2")) >= F.lit(threshold) * (F.col("l1") + F.col("l2")) - F.lit(_EPS))
    first, second = ("n1", "n2") if earlier_first else ("n2", "n1")
    return (p.withColumn("_s", scored_at_least(F.col(first), F.col(second), threshold))
             .select("feature", "r1", "r2", "_s.score", "_s.rounded").where(F.col("score").isNotNull()))


def greedy_leaders(edges: DataFrame) -> DataFrame:
    """``feature, rank, leader`` for every node that has an incoming edge or is a leader with an
    out-edge: the group leader of each node under the sequential greedy rule (leaders map to
    themselves)."""
    spark = edges.sparkSession
    checkpoint_dir(spark)
    e = edges.select("feature", "r1", "r2").checkpoint(eager=True)
    nodes = (e.select("feature", F.col("r1").alias("rank")).union(e.select("feature", F.col("r2").alias("rank")))
              .distinct())
    status = nodes.withColumn("st", F.lit("U")).checkpoint(eager=True)
    while True:  # every round decides at least the lowest undecided node
        und = status.where(F.col("st") == "U").select("feature", F.col("rank").alias("r2"))
        if und.isEmpty():
            break
        src = status.select("feature", F.col("rank").alias("r1"), F.col("st").alias("src_st"))
        preds = (e.join(und, ["feature", "r2"]).join(src, ["feature", "r1"])
                  .groupBy("feature", "r2").agg(
                      F.max(F.col("src_st") == "L").alias("_has_leader"),
                      F.min(F.col("src_st") == "M").alias("_all_members")))
        decided_now = (und.join(preds, ["feature", "r2"], "left")
                          .select("feature", F.col("r2").alias("rank"),
                                  F.when(F.col("_has_leader"), F.lit("M"))
                                   .when(F.col("_all_members").isNull() | F.col("_all_members"), F.lit("L"))
                                   .otherwise(F.lit("U")).alias("_new")))
        status = (status.join(decided_now, ["feature", "rank"], "left")
                        .select("feature", "rank", F.coalesce("_new", "st").alias("st"))
                        .checkpoint(eager=True))
    leaders = status.where(F.col("st") == "L").select("feature", F.col("rank").alias("r1"))
    members = (e.join(leaders, ["feature", "r1"])
                .join(status.where(F.col("st") == "M").select("feature", F.col("rank").alias("r2")), ["feature", "r2"])
                .groupBy("feature", "r2").agg(F.min("r1").alias("leader"))
                .select("feature", F.col("r2").alias("rank"), "leader"))
    led = members.select("feature", F.col("leader").alias("rank"), "leader").distinct()
    return members.unionByName(led)


_GROUP_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()), T.StructField("similar_values", T.StringType()),
    T.StructField("normalized_values", T.StringType()), T.StructField("total_count", T.LongType()),
    T.StructField("n_values_grouped", T.LongType())])


def semantic_repetitions(df: DataFrame, columns: Sequence[str], similarity_threshold: float = 0.7) -> DataFrame:
    """Groups (of two or more) of near-identical values per feature.

    ``feature, similar_values`` (leader first, then rank order, ``" | "``), ``normalized_values``
    (sorted distinct I1 forms), ``total_count, n_values_grouped``; by feature, total desc.  Returns an
    empty frame of that schema when there is no group."""
    vocab = vocabulary(df, columns, normalize_category)
    edges = scored_edges(vocab, similarity_threshold, earlier_first=True)
    groups = greedy_leaders(edges)
    rows = groups.join(vocab, ["feature", "rank"])
    out = rows.groupBy("feature", "leader").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "category"))),
                                 lambda x: x["category"]), LIST_SEPARATOR).alias("similar_values"),
        F.array_join(F.array_sort(F.collect_set("norm")), LIST_SEPARATOR).alias("normalized_values"),
        F.sum("count").cast("long").alias("total_count"),
        F.count(F.lit(1)).cast("long").alias("n_values_grouped"))
    return (out.select(*[f.name for f in _GROUP_SCHEMA.fields])
               .orderBy("feature", F.desc("total_count"), "similar_values"))


def suggest_category_mapping(df: DataFrame, column: str, threshold: float = 0.85) -> DataFrame:
    """For each (stripped, non-null) category the best match among *more frequent* ones,
    scoring ``ratio(norm(category), norm(candidate))`` with the I2 normaliser.  Best = highest score
    ``>= threshold``, ties to the most frequent candidate.  ``original_category, original_count,
    suggested_category, suggested_count, similarity`` (3 dp), ``action`` (``map``/``keep``)."""
    vocab = vocabulary(df, [column], normalize_text, strip=True)
    edges = scored_edges(vocab, threshold, earlier_first=False)
    best = (edges.groupBy("feature", F.col("r2").alias("rank"))
                 .agg(F.max_by(F.struct(F.col("r1").alias("cand"), "rounded"),
                               F.struct(F.col("score"), -F.col("r1"))).alias("_best")))
    cand = vocab.select("feature", F.col("rank").alias("_cand"), F.col("category").alias("_cat2"),
                        F.col("count").alias("_cnt2"))
    out = (vocab.join(best, ["feature", "rank"], "left")
                .withColumn("_cand", F.col("_best.cand"))
                .join(cand, ["feature", "_cand"], "left"))
    mapped = F.col("_best").isNotNull()
    return out.select(
        F.col("category").alias("original_category"),
        F.col("count").alias("original_count"),
        F.when(mapped, F.col("_cat2")).otherwise(F.col("category")).alias("suggested_category"),
        F.when(mapped, F.col("_cnt2")).otherwise(F.col("count")).alias("suggested_count"),
        F.when(mapped, F.col("_best.rounded")).otherwise(F.lit(1.0)).alias("similarity"),
        F.when(mapped, F.lit("map")).otherwise(F.lit("keep")).alias("action"),
        F.col("rank").alias("_rank")).orderBy("_rank").drop("_rank")


def mapped_only(mapping: DataFrame) -> DataFrame:
    """C4: the suggestions whose action is ``map``."""
    return mapping.where(F.col("action") == "map")


def admissible_lengths(length: int, threshold: float) -> tuple[int, int]:
    """Partner lengths that can reach ``threshold`` against a string of ``length`` (for tests)."""
    lo = math.ceil(length * threshold / (2 - threshold) - _EPS)
    hi = math.floor(length * (2 - threshold) / threshold + _EPS)
    return lo, hi
