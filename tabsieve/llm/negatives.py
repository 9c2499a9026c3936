"""Hard negatives mined from packed R-trees.

Rows are packed by sort, tile and recurse: Spark cuts the table into slabs of one coordinate and runs of the next, so each
partition is a tile; inside it the rows are tiled by further coordinates down to pages of ``PAGE`` rows.  ``FAN`` pages make an
inner node, and pages and nodes have minimum bounding boxes.  A box bounds each coordinate's product with an anchor's from both
sides, and their sums bound every score in the box.

An anchor opens the nodes of a tree in the order of their upper bounds.  It leaves out boxes outside all its score windows or
strictly below the k-th score it has (an equal score may win by its id), and ends when the next node is.  Anchors open nodes
in step, so each opened node is one matrix product for all anchors that are at it.

Every anchor has to meet every tree, so anchors are broadcast in blocks of bounded size, and a tree's best few go to the
anchor's final ranking.  Scores are exact: products are taken in double precision below 2^53, in 64-bit integers above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve._ship import ship_by_value
from tabsieve.llm.common import bounded_batches, materialise, scratch_path

PAGE, FAN, TREE_ROWS = 32, 16, 8192
#: a component beyond this (after ``floor(256 * x)``) could push a score out of 64 bits
LARGEST = 1 << 26
#: anchors a broadcast (and bytes of their vectors), anchors that open nodes together
BLOCK, BLOCK_BYTES, STEP = 8192, 16 << 20, 256
_LOWEST = np.iinfo(np.int64).min


def _tile(vectors: np.ndarray, order: np.ndarray, axes: list[int], pages: int) -> Iterator[np.ndarray]:
    """Sort-tile-recurse: ``order`` cut into slabs along the first axis, each tiled along the others, last into pages."""
    if pages <= 1 or not axes:
        yield order
        return
    slabs = max(2, round(pages ** (1 / len(axes)))) if len(axes) > 1 else pages
    order = order[np.argsort(vectors[order, axes[0]], kind="stable")]
    per = -(-pages // slabs)
    for at in range(0, len(order), per * PAGE):
        part = order[at:at + per * PAGE]
        yield from _tile(vectors, part, axes[1:], -(-len(part) // PAGE))


def _pack(size: int, axes: list[int]):
    """Trees of a partition's rows: ids, labels and vectors in page order."""
    def tree(rows: pa.Table) -> pa.RecordBatch:
        vectors = _matrix(rows["v"].combine_chunks(), size)
        order = np.concatenate(list(_tile(vectors, np.arange(len(rows)), axes, -(-len(rows) // PAGE))))
        raw = [rows["id"].to_numpy()[order], rows["label"].to_numpy()[order], vectors[order].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in raw], ["ids", "labels", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= 2 * TREE_ROWS:
                yield tree(pa.Table.from_batches(held))
                held = []
        if any(len(b) for b in held):
            yield tree(pa.Table.from_batches(held))
    return run


def _matrix(lists: pa.ListArray, size: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(lists), size))
    lengths = np.diff(lists.offsets.to_numpy())
    out[np.arange(size) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


class Tree:
    """A packed tree: nodes of ``FAN`` pages of ``PAGE`` rows."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, size: int) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.int32).reshape(len(self.ids), size).astype(np.float64)
        starts = np.arange(0, len(self.ids), PAGE)
        self.low, self.high = np.minimum.reduceat(self.vectors, starts), np.maximum.reduceat(self.vectors, starts)
        nodes = np.arange(0, len(starts), FAN)
        self.node_low, self.node_high = np.minimum.reduceat(self.low, nodes), np.maximum.reduceat(self.high, nodes)
        self.largest = np.abs(self.vectors).max(initial=0.0)


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """``a @ b.T`` as integers; ``exact`` if doubles hold every sum."""
    return (a @ b.T if exact else a.astype(np.int64) @ b.astype(np.int64).T).astype(np.int64)


def _bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor and box, the sums of the least and of the greatest products of each coordinate."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return (_products(up, low, exact) + _products(down, high, exact), _products(up, high, exact) + _products(down, low, exact))


class Found:
    """The best ``keep`` rows so far of every search: (anchor, window) pairs."""

    def __init__(self, searches: int, keep: int) -> None:
        self.keep, self.rows = keep, np.zeros((0, 3), np.int64)  # search, score, id
        self.kth = np.full(searches, _LOWEST, np.int64)

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([search, score, ids], 1)])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        self.rows = rows[place < self.keep]
        full = rows[place == self.keep - 1]
        self.kth[full[:, 0]] = full[:, 1]


def search(tree: Tree, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, least: np.ndarray, most: np.ndarray, same: bool,
           keep: int) -> np.ndarray:
    """``(search, score, id)`` of the best ``keep`` rows of ``tree`` for every search.  Anchor ``a`` has the searches ``a * W`` to
    ``a * W + W - 1`` with the score windows ``least[a]`` to ``most[a]``, over the other rows of its label or over those of others."""
    windows = least.shape[1]
    found = Found(least.size, keep)
    exact = float(np.abs(anchors).max(initial=0.0)) * tree.largest * anchors.shape[1] < 2.0**52
    lower, upper = _bounds(anchors, tree.node_low, tree.node_high, exact)
    queue = np.argsort(-upper, axis=1, kind="stable")
    left = np.arange(len(anchors))
    for turn in range(queue.shape[1]):
        floor = np.maximum(least, found.kth.reshape(least.shape))
        node = queue[left, turn]
        top = upper[left, node]
        goes_on = ((top[:, None] >= floor[left]) & (least[left] <= most[left])).any(1)  # later nodes reach no higher
        left, node = left[goes_on], node[goes_on]
        if not len(left):
            break
        inside = (lower[left, node][:, None] <= most[left]).any(1)
        new: list[tuple[np.ndarray, ...]] = []
        for g in np.unique(node[inside]):
            at = left[inside & (node == g)]
            pages = np.arange(g * FAN, min((g + 1) * FAN, len(tree.low)))
            page_low, page_high = _bounds(anchors[at], tree.low[pages], tree.high[pages], exact)
            wanted = ((page_high[:, :, None] >= floor[at][:, None, :]) & (page_low[:, :, None] <= most[at][:, None, :])).any(2)
            for j in np.flatnonzero(wanted.any(0)):
                rows = slice(pages[j] * PAGE, (pages[j] + 1) * PAGE)
                who = at[wanted[:, j]]
                score = _products(anchors[who], tree.vectors[rows], exact)
                fits = (tree.labels[rows] == labels[who][:, None]) == same
                fits &= tree.ids[rows] != ids[who][:, None]
                for w in range(windows):
                    x, y = np.nonzero(fits & (score >= floor[who, w][:, None]) & (score <= most[who, w][:, None]))
                    if len(x):
                        new.append((who[x] * windows + w, score[x, y], tree.ids[rows][y]))
        if new:
            found.add(*(np.concatenate(part) for part in zip(*new)))
    return found.rows


def _search(block, same: bool, keep: int, size: int):
    """``(search, score, id)`` rows of every tree for the broadcast anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, anchors, least, most = block.value
        for batch in batches:
            for row in range(len(batch)):
                tree = Tree(*(batch[c][row].as_buffer() for c in ("ids", "labels", "vectors")), size)
                for at in range(0, len(ids), STEP):
                    part = slice(at, at + STEP)
                    rows = search(tree, ids[part], labels[part], anchors[part].astype(np.float64), least[part], most[part], same, keep)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0] + at * least.shape[1]), pa.array(rows[:, 1]), pa.array(rows[:, 2])],
                                                         ["search", "score", "id"])
    return run


def _best(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("search").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _usable(df: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``(id, label, v)`` with integer components, one row per id."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.transform(vector, lambda x: F.floor(x * 256.0).cast("int"))
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x * 256.0) < LARGEST, F.lit(False)))  # false for null, NaN and infinite
    rows = (df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("x"),
                      F.when(F.coalesce(fine, F.lit(False)), whole).alias("v"))
            .where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _packed(rows: DataFrame, count: int, size: int) -> DataFrame:
    """Trees over the tiles of the two most spread coordinates; further ones tile inside."""
    spread = rows.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.var_pop("x").alias("s")).orderBy(F.desc("s"), "j").limit(8).collect()
    axes = [r["j"] for r in spread]
    trees = max(1, -(-count // TREE_ROWS))
    if len(axes) > 1:
        slabs = max(1, round(trees**0.5))
        cuts = rows.agg(F.percentile_approx(F.get("v", F.lit(axes[0])), [k / slabs for k in range(1, slabs)])).first()[0] if slabs > 1 else []
        slab = sum((F.when(F.coalesce(F.get("v", F.lit(axes[0])), F.lit(0)) > c, 1).otherwise(0) for c in cuts), F.lit(0))
        keys = [slab, F.coalesce(F.get("v", F.lit(axes[1])), F.lit(0)), F.col("id")]
    else:
        keys = [F.col("id")]
    tiles = bounded_batches(rows.repartitionByRange(trees, *keys))
    return materialise(tiles.mapInArrow(_pack(size, axes[2:] or axes), "ids binary, labels binary, vectors binary"), "negatives-trees")


def hard_negatives(df: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5,
                   negatives: int = 3, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become ``floor(256 * x)``, a score is the integer inner product with the anchor; higher scores come first, ties by the
    smaller id.  An anchor's positives are its first ``positives`` other rows of its label.  For each, the first ``negatives``
    rows of other labels with ``window[0] * positive <= 100 * negative <= window[1] * positive`` come back, fewer if
    there are fewer: a positive of negative score has none.

    Rows with a null id, label or vector, or a null, non-finite or out of range (``LARGEST``) component take no part.  Of rows with one
    id the one with the smallest label and vector counts.  Shorter vectors end in zeros, an empty one scores 0.  ``label`` must
    be an integer; ``anchors`` may use any column (null: no anchor).  Other columns are not read.  An empty table gives none."""
    spark = df.sparkSession
    asked = df.where(F.coalesce(anchors, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.lit(True).alias("asks")).distinct()
    rows = materialise(_usable(df, id_col, vector_col, label).join(asked, "id", "left"), "negatives-rows")
    count, size, number = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("asks")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    size = max(size, 1)
    trees = _packed(rows.select("id", "label", "v"), count, size)
    per = max(1, min(BLOCK, BLOCK_BYTES // (4 * size)))
    blocks = -(-number // per)
    which = F.pmod(F.xxhash64("id"), F.lit(max(blocks, 1)))
    path = scratch_path(spark, "negatives-found")
    for k in range(blocks):
        mine = rows.where(F.col("asks") & (which == k)).select("id", "label", "v").toArrow()
        if not len(mine):
            continue
        ids, labels = mine["id"].to_numpy(), mine["label"].to_numpy()
        vectors = _matrix(mine["v"].combine_chunks(), size).astype(np.int32)
        wide = np.full((len(ids), 1), _LOWEST), np.full((len(ids), 1), np.iinfo(np.int64).max)
        block = spark.sparkContext.broadcast((ids, labels, vectors, *wide))
        near = bounded_batches(trees).mapInArrow(_search(block, True, positives, size), "search long, score long, id long")
        best = _best(near, positives).toArrow().to_pandas()  # at most this many a broadcast anchor
        least, most = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)  # empty windows
        positive = np.zeros((2, len(ids), positives), np.int64)
        at = best["search"].to_numpy(), best["rank"].to_numpy() - 1
        score = best["score"].to_numpy()
        least[at], most[at] = [-(-window[0] * int(s) // 100) for s in score], [window[1] * int(s) // 100 for s in score]
        positive[0][at], positive[1][at] = best["id"].to_numpy(), score
        again = spark.sparkContext.broadcast((ids, labels, vectors, least, most))
        hard = bounded_batches(trees).mapInArrow(_search(again, False, negatives, size), "search long, score long, id long")
        named = spark.createDataFrame(pa.table({"search": np.arange(least.size), "anchor_id": np.repeat(ids, positives),
                                                "positive_id": positive[0].ravel(), "positive_score": positive[1].ravel()}))
        (_best(hard, negatives).join(F.broadcast(named), "search")
         .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
         .write.mode("append").parquet(path))
    if not blocks:
        return spark.createDataFrame([], out)
    return spark.read.schema(out).parquet(path)


ship_by_value(__name__)
