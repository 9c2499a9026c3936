import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "component_id string, weight string, kept string, ids string, __id2 string")  # clashing names


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    words = ["the", "and", "of", "ing", "tion", "here", "that", "was", "ered", "onth"]
    base = [rng.choice(words) + rng.choice(words) for _ in range(60)]
    prose = " ".join(base)
    near = " ".join(base[:59] + ["changed"])
    long = " ".join(rng.choice(words) + rng.choice(words) for _ in range(30_000))
    texts = [(1, prose), (2, prose), (2, prose), (3, near), (4, prose.upper()), (5, ""), (6, None), (7, " \t\n "), (8, "short one"),
             (9, "short one"), (None, prose), (None, None), (None, "nobody has this text at all anywhere else"), (10, long),
             (11, "x" * 50_000), (12, "1234 +!?"), (13, "mail a.b@c.example.org or +1 (724) 555-7058 é ü 日本")]
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t),
             "c", "w", None, "i", "x") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
