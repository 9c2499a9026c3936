import random

import public_tokenizers
import pytest
import regex
import tiktoken

from tabsieve.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_pieces_equal_the_library(vocabulary, library):
    rng = random.Random(3)
    letters = "abcdefghijklmnop éüñ日本語 \n\t0123!?"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["a" * 5000, "ab" * 3000, "é" * 1500, " " * 4000, "the" * 700, "", "<|endoftext|>"]
    split = regex.compile(public_tokenizers.PATTERN).findall
    for text in texts:
        pieces = [p.encode() for p in split(text)]
        assert [i for ids in bpe.encode_pieces(pieces, vocabulary) for i in ids] == library.encode_ordinary(text)


def test_both_trees_merge_alike(vocabulary):
    rng = random.Random(4)
    for size in (2, 3, 17, 64, 65, 300):
        piece = bytes(rng.choice(b"aenrst ") for _ in range(size))
        width = 1 << (size - 1).bit_length()
        assert bpe._merged([piece, piece[:1]], vocabulary, width) == [bpe._merged_alone(piece, vocabulary),
                                                                     [int(vocabulary.byte_ids[piece[0]])]]


def test_round_trip_of_the_table(spark, docs, library):
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text"), PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(coded) == docs.count()
    both = bpe.encode_and_decode(docs.select("doc_id", "text"), PATH, public_tokenizers.PATTERN).select("doc_id", "__bpe.*").collect()
    assert [(r["doc_id"], r["ids"], r["decoded"]) for r in both] == [(r["doc_id"], r["ids"], r["decoded"]) for r in coded]
    for r in coded:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "").encode()


def test_awkward_rows(spark, awkward, empty, library):
    coded = bpe.decode(bpe.encode(awkward, PATH, public_tokenizers.PATTERN), PATH, into="kept").collect()
    assert [r["ids"] for r in coded] == [library.encode_ordinary(r["text"] or "") for r in coded]
    assert all(bytes(r["kept"]) == (r["text"] or "").encode() for r in coded)
    assert bpe.encode(empty, PATH, public_tokenizers.PATTERN).collect() == []
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode(nothing, PATH).collect()] == [b"", b""]
