"""Words of whole texts as Arrow arrays: cut, lower-cased and numbered without a Python string per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabsieve._ship import ship_by_value


def strings(column) -> pa.Array:
    """A batch's text column as plain strings, null as empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def _cut(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real), parent.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in order, and for each the number of its text."""
    return _cut(pc.ascii_split_whitespace(pc.ascii_lower(strings(texts))))


def piece_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words between spaces and tabs of the pieces between ``.,;:!?`` and line ends, A-Z lower-cased; for each word the
    number of its piece, and for each piece the number of its text."""
    lists = pc.split_pattern_regex(pc.ascii_lower(strings(texts)), "[.,;:!?\x0a-\x0d]")
    pieces, of_text = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    words, piece = _cut(pc.ascii_split_whitespace(pieces))  # no line end is left: blanks are spaces and tabs
    return words, piece, of_text


def numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words and, for each word, its number among them."""
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


ship_by_value(__name__)
