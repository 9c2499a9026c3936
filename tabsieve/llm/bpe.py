"""Byte-level BPE with the rank files of public tokenizers.

Merging one piece: a segment tree over byte positions holds, at each leaf, the rank of the pair that
starts there (or "none"), and at each inner node the leftmost minimum of its range.  The root names the
next merge; a merge changes the pairs of the merged position and of its live left neighbour and removes
the right part, so it makes three point updates of logarithmic cost.  A piece of n bytes takes
``O(n log n)`` time and ``O(n)`` memory, also when a piece is a whole very long text.

Short pieces of similar length are merged together, one numpy row each; long ones use the same tree in
plain lists.  Every distinct piece is merged once per task while it stays in a bounded table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve._ship import ship_by_value
from tabsieve.llm.common import bounded_batches, texts, with_struct

NONE = np.int64(2**62)
#: distinct pieces kept per Python worker (about 50 MB); the table is emptied when full
KEPT_PIECES = 200_000
#: rows merged together hold at most this many tree leaves (the working set stays in cache)
_LEAVES = 1 << 16
#: wider pieces are merged one at a time: a numpy call per merge would cost more than the merge
_ALONE = 1 << 10
#: characters encoded, and ids decoded, at a time (one text at least); results leave the worker as often
_TEXT_CHARS = 1_000_000
_IDS = 500_000


class Vocabulary:
    """Ranks of a byte-level BPE file (one ``base64 rank`` pair per line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = tokens

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair; ``NONE`` where the vocabulary has no such token or a side is -1."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_ranks[at], NONE)


def _merged_alone(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """Merge one long piece; the same tree as ``_merged`` with plain lists."""
    ranks, tokens = vocabulary.ranks, vocabulary.tokens
    count = len(piece)
    width = 1 << (count - 1).bit_length()
    ids = vocabulary.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, count + 1)), list(range(-1, count - 1))
    none = int(NONE)

    def value(position: int) -> int:
        nxt = after[position]
        if nxt >= count:
            return none
        rank = ranks.get(tokens[ids[position]] + tokens[ids[nxt]])
        return none if rank is None else rank * width + position

    tree = [none] * (2 * width)
    for position in range(count):
        tree[width + position] = value(position)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(position: int, new: int) -> None:
        node = width + position
        tree[node] = new
        while node > 1:
            node >>= 1
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:  # nothing changes further up
                return
            tree[node] = low

    while tree[1] < none:
        rank, at = divmod(tree[1], width)
        gone = after[at]
        ids[at], ids[gone] = rank, -1
        after[at] = after[gone]
        if after[at] < count:
            before[after[at]] = at
        update(gone, none)
        update(at, value(at))
        if before[at] >= 0:
            update(before[at], value(before[at]))
    return [i for i in ids if i >= 0]


def _merged(pieces: list[bytes], vocabulary: Vocabulary, width: int) -> list[list[int]]:
    """Merge pieces of at most ``width`` bytes (a power of two), one segment tree row each."""
    rows = len(pieces)
    ids = np.full((rows, width), -1, np.int64)
    for r, piece in enumerate(pieces):
        ids[r, :len(piece)] = vocabulary.byte_ids[np.frombuffer(piece, np.uint8)]
    lengths = np.array([len(p) for p in pieces])
    after = np.tile(np.arange(1, width + 1), (rows, 1))  # next live position; width means none
    after[after >= lengths[:, None]] = width
    before = np.tile(np.arange(-1, width - 1), (rows, 1))
    ranks = np.full((rows, width), NONE)
    ranks[:, :-1] = vocabulary.pair_rank(ids[:, :-1], ids[:, 1:])
    # a node holds rank * width + position, so the smallest is the leftmost minimum
    tree = np.full((rows, 2 * width), NONE)
    tree[:, width:] = np.where(ranks < NONE, ranks * width + np.arange(width), NONE)
    level = width
    while level > 1:
        tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level //= 2
    live = np.flatnonzero(tree[:, 1] < NONE)

    def update(row, position, value):
        node = position + width
        tree[row, node] = value
        while node[0] > 1:  # all leaves are at one depth
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def pair_value(row, position):
        """The leaf of a pair: the part at ``position`` with the next live part."""
        nxt = after[row, position]
        has = nxt < width
        rank = vocabulary.pair_rank(ids[row, position], np.where(has, ids[row, np.minimum(nxt, width - 1)], -1))
        return np.where(rank < NONE, rank * width + position, NONE)

    while len(live):
        top = tree[live, 1]
        at, rank = top % width, top // width
        gone = after[live, at]
        follow = after[live, gone]
        ids[live, at], ids[live, gone] = rank, -1
        after[live, at] = follow
        linked = follow < width
        before[live[linked], follow[linked]] = at[linked]
        update(live, gone, np.full(len(live), NONE))
        update(live, at, pair_value(live, at))
        left = before[live, at]
        has_left = left >= 0
        if has_left.any():
            row, position = live[has_left], left[has_left]
            update(row, position, pair_value(row, position))
        live = live[tree[live, 1] < NONE]
    kept = ids >= 0
    flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of each piece: the piece's own id where the vocabulary has it, else its merges."""
    out: list = [None] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        own = vocabulary.ranks.get(piece)
        if own is not None:
            out[k] = [own]
        elif len(piece) > _ALONE:
            out[k] = _merged_alone(piece, vocabulary)
        elif piece:
            by_width.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(k)
        else:
            out[k] = []
    for width, members in by_width.items():
        step = max(1, _LEAVES // width)
        for at in range(0, len(members), step):
            chosen = members[at:at + step]
            for k, ids in zip(chosen, _merged([pieces[k] for k in chosen], vocabulary, width)):
                out[k] = ids
    return out


def _groups(column: pa.Array):
    """Consecutive texts of a batch, a bounded number of characters at a time (one text at least)."""
    group, chars = [], 0
    for text in texts(column):
        group.append(text or "")
        chars += len(group[-1])
        if chars >= _TEXT_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


class _Encoder:
    """Encodes texts with a bounded table of the pieces met before."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # piece to its packed ids

    def __call__(self, group: list[str]) -> pa.ListArray:
        found = [self.split(text) for text in group]
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        new = list({p for pieces in found for p in pieces if p not in self.known})
        coded = encode_pieces([p.encode("utf-8", "surrogatepass") for p in new], self.vocabulary)
        self.known.update((p, np.array(ids, np.int32).tobytes()) for p, ids in zip(new, coded))
        packed = [b"".join(map(self.known.__getitem__, pieces)) for pieces in found]
        offsets = np.zeros(len(packed) + 1, np.int32)
        np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _decoded(ids: pa.ListArray, table: pa.Array) -> Iterator[pa.Array]:
    """The bytes of each row's ids, a bounded number of ids at a time."""
    ends = ids.offsets.to_numpy()
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + _IDS, "right")) - 1)
        part = pa.array(ends[at:to + 1] - ends[at])
        parts = pa.ListArray.from_arrays(part, table.take(ids.slice(at, to - at).flatten()))
        yield pc.binary_join(parts, pa.scalar(b"", pa.binary())).cast(pa.binary())
        at = to


def _encode_udf(vocabulary: Vocabulary, pattern: str):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _Encoder(vocabulary, pattern)
        for batch in batches:
            yield from map(encoder, _groups(batch))
    return run


def _decode_udf(vocabulary: Vocabulary):
    tokens = vocabulary.tokens

    @F.arrow_udf(T.BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pa.array(tokens, pa.binary())
        for batch in batches:
            yield from _decoded(batch, table)
    return run


def _both_udf(vocabulary: Vocabulary, pattern: str):
    @F.arrow_udf("ids array<int>, decoded binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, table = _Encoder(vocabulary, pattern), pa.array(vocabulary.tokens, pa.binary())
        for batch in batches:
            for group in _groups(batch):
                ids = encoder(group)
                decoded = pa.concat_arrays(list(_decoded(ids, table)))
                yield pa.StructArray.from_arrays([ids, decoded], names=["ids", "decoded"])
    return run


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """Add ``into`` (array of int): the ids of the whole text by the rank file at ``path``, each match of
    ``pattern`` on its own, without special tokens.  A null or empty text has no ids (an empty array).
    A column already named ``into`` is replaced; other columns, repeated rows and empty tables pass
    unchanged.  ``path`` is read on the driver; executors get the parsed table."""
    udf = _encode_udf(Vocabulary(path), pattern).asNondeterministic()
    return bounded_batches(df).withColumn(into, udf(F.col(text_col)))


def decode(df: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into`` (binary): the bytes of the ids.  A null id array decodes to no bytes; an id outside
    the vocabulary is an error, never skipped."""
    udf = _decode_udf(Vocabulary(path)).asNondeterministic()
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    return bounded_batches(df).withColumn(into, udf(ids))


def encode_and_decode(df: DataFrame, path: str, pattern: str, text_col: str = "text", into: str = "__bpe") -> DataFrame:
    """Add struct ``into`` with ``ids`` and ``decoded`` (the bytes that the ids stand for): ``encode`` and then
    ``decode`` in one Python worker per task, with the same results."""
    return with_struct(df, _both_udf(Vocabulary(path), pattern), [F.col(text_col)], into)


ship_by_value(__name__)
