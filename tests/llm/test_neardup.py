import random

from tabsieve.llm.components import connected_components
from tabsieve.llm.neardup import near_duplicates, shingle_set, words_of


def union_find(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def exact_shingles(text, size=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}


def brute(rows, percent):
    sets = [(i, exact_shingles(t)) for i, t in rows]
    links = [(i, i) for i, _ in sets]
    for k, (a, x) in enumerate(sets):
        links += [(a, b) for b, y in sets[k + 1:] if x and 100 * len(x & y) >= percent * len(x | y)]
    return union_find(links), {i: len(s) for i, s in sets}


def test_a_hub_is_not_shuffled_by_its_node(spark, monkeypatch):
    """Hubs' minima are broadcast, all others are joined by node; both ways give the same components."""
    from tabsieve.llm import components
    edges = [(k, 0 if k % 3 else 1) for k in range(10, 4000)] + [(5000 + k, 5001 + k) for k in range(40)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = union_find(edges)
    for heavy in (10_000, 50, 0):
        monkeypatch.setattr(components, "HEAVY", heavy)
        found = {r["node"]: r["component"] for r in connected_components(df).collect()}
        assert found == {k: v for k, v in want.items() if k != v}


def boilerplate(spark, n):
    """Texts of 200 words in common and 24 of their own: none is a link at 0.85, all share their buckets."""
    rng = random.Random(2)
    common = [f"c{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(common[:100] + [f"o{i}x{k}" for k in range(12)] + common[100:] + [f"o{i}y{k}" for k in range(12)])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


def test_boilerplate_emits_no_pairs(spark, monkeypatch):
    from tabsieve.llm import neardup
    met = []
    plain = neardup._met
    monkeypatch.setattr(neardup, "_met", lambda *a: met.append(plain(*a).checkpoint()) or met[-1])
    out = near_duplicates(boilerplate(spark, 600), percent=85)
    assert out.where("kept").count() == 600 and met[0].count() == 0


def test_crowded_buckets_lose_no_link(spark):
    """Shared text with own parts of every length, so that links, near misses and hopeless pairs share their buckets."""
    rng = random.Random(4)
    common = [f"c{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join(common[:60 - rng.choice([0, 0, 3, 9, 20])] + [f"o{i}x{k}" for k in range(rng.choice([0, 1, 2, 4, 7, 12, 20]))])) for i in range(260)]
    for percent in (80, 85):
        component, sizes = brute(rows, percent)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == component


def test_components_of_chains_hubs_and_random_edges(spark):
    rng = random.Random(1)
    chain = [(k + 1, k) for k in range(100, 160)]
    hub = [(500, k) for k in range(501, 700)]
    loose = [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    edges = chain + hub + loose + [(7, 7), (None, 3), (3, None), (101, 100)]
    found = {r["node"]: r["component"] for r in
             connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = union_find([e for e in edges if None not in e])
    assert found == {k: v for k, v in want.items() if k != v}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_groups_equal_brute_force(spark):
    """Copies, light and heavy edits of shared bases, and a group that links only through its lightest text."""
    rng = random.Random(2)
    rows, at = [], 0
    for size in (8, 30, 120):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for edits in [0, 0, 1, 1, 2, 3, 4, 5, 6] * 4:
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(size)] = f"z{rng.randrange(10_000)}"
            rows.append((at, " ".join(words) if at % 3 else " ".join(words).upper()))
            at += 1
    rng.shuffle(rows)
    want, sizes = brute(rows, 80)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_awkward_rows(spark, awkward, empty):
    got = near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    of = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert of[1] == of[2] == of[3] == of[4] == 1 and of[8] == of[9] == 8
    assert all(of[k] == k for k in (5, 6, 7, 10, 11))
    nameless = sorted(((r["component_id"], r["kept"]) for r in got if r["doc_id"] is None), key=str)
    assert nameless == [(1, False), (None, True), (None, True)]
    assert near_duplicates(empty).collect() == []


def test_words_and_sets():
    assert words_of("AÉ b \x0bC") == ["aÉ b".encode(), b"c"]
    text = " ".join(f"w{k % 97}" for k in range(5000))
    assert len(shingle_set(words_of(text))) == len(exact_shingles(text)) == 97
