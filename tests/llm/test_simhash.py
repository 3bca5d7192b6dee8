import random

import numpy as np
import pytest
import xxhash

from transecta.llm import simhash
from transecta.llm.components import components


def brute_fingerprint(text, k=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed=42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(numbers):
    parent = {x: x for x in numbers}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(sorted(numbers), np.int64)
    for x in a:
        for y in a[np.bitwise_count((a ^ x).view(np.uint64)) <= 3]:
            r, s = find(int(x)), find(int(y))
            parent[max(r, s)] = min(r, s)
    return {x: find(x) for x in numbers}


def test_fingerprints_equal_brute_force(odd_texts):
    for t in odd_texts:
        got = simhash.fingerprint(t or "") & (1 << 64) - 1
        assert got == brute_fingerprint(t or "")


def clusters(seed, n):
    """Numbers in tight clusters and chains, and far from each other."""
    rng, out = random.Random(seed), set()
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            out.add(x - (1 << 64) if x >> 63 else x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    return out


@pytest.mark.parametrize("hot", [1024, 2, 0])
def test_links_connect_what_brute_force_connects(spark, hot):
    numbers = clusters(hot, 40)
    edges = simhash.links(spark.createDataFrame([(x,) for x in numbers], "fp long"), hot)
    rows = edges.collect()
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 3 for r in rows)
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {x: roots.get(x, x) for x in numbers} == brute_roots(numbers)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 30)] + [(7, 7), (300, 299), (299, 300)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(101, 161)}, **{i: 1 for i in range(2, 30)}, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups_and_one_of_each(spark, make_prose, odd_docs, no_docs):
    rng = random.Random(2)
    text = make_prose(rng, 2000)
    near = text.replace(" the ", " a ", 1)
    docs = spark.createDataFrame([(9, text, 1), (4, text, 2), (6, near, 3), (8, make_prose(rng, 300), 4), (1, "", 5), (2, None, 6), (3, " \n", 7)], "doc_id long, text string, component_id long")
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r["component_id"] for i, r in rows.items()} == {9: 4, 4: 4, 6: 4, 8: 8, 1: 1, 2: 1, 3: 1}
    assert rows[1]["fp"] == 0
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.keep_one(docs).collect()) == [(1, 5), (4, 2), (8, 4)]
    kept = simhash.keep_one(odd_docs).collect()
    ids = [r["doc_id"] for r in kept]
    assert len(ids) == len(set(ids)) and None in ids and kept[0].asDict().keys() == set(odd_docs.columns)
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.keep_one(no_docs).collect() == []


def five_word_similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("options", [{}, {"hot": 1}])
def test_near_copies_at_four_fifths_are_one_group(spark, make_prose, options):
    rng, rows, gone = random.Random(21), [], set()
    for i in range(60):
        words = make_prose(rng, 300).split()
        other = list(words)
        for at in range(20, 300, 60 if i % 2 else 25):
            other[at] = f"changed{at}"
        a, b = " ".join(words), " ".join(other)
        rows += [(2 * i, a), (2 * i + 1, b)]
        if five_word_similarity(a, b) >= 0.8:
            gone.add(2 * i + 1)
    assert len(gone) == 30
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert {r["doc_id"] for r in kept} == {i for i, _ in rows} - gone


@pytest.mark.parametrize("hot", [64, 1])
def test_groups_of_many_near_copies_are_what_all_pairs_connect(spark, make_prose, hot):
    """Copies that drift from one text until the first and last have little in common, beside copies of its neighbours."""
    rng, texts = random.Random(31), []
    for _ in range(3):
        words = make_prose(rng, 200).split()
        for step in range(90):
            words = list(words)
            words[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
            if step % 3 == 0:
                texts.append(" ".join(words))
            spread = list(words)
            for _ in range(3):
                spread[rng.randrange(200)] = f"own{rng.randrange(10**6)}"
            texts.append(" ".join(spread))
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(196)} for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs, hot=hot).collect()}
    assert kept == {root(i) for i in range(len(texts))} and len(kept) < len(texts) / 3


def test_sets_in_common_are_counted():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, n).astype(np.uint32)) for n in (0, 1, 5, 20, 40, 0)]
    found = simhash.shared_counts([x.tobytes() for x in sets], [x.tobytes() for x in sets[1:]])
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets]
    assert simhash.shared_counts([], []).shape == (0, 0) and simhash.shared_counts([sets[3].tobytes()], [b""]).tolist() == [[0]]


def test_clashing_columns_maps_and_repeated_rows(spark, make_prose):
    rng = random.Random(23)
    one, two = make_prose(rng, 100), make_prose(rng, 100)
    rows = [(1, one, 5, {"a": 1}, 6, "x"), (1, one, 4, {"a": 2}, 7, "y"), (2, two, 3, None, 8, "z"), (3, one, 3, {}, 8, None), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id_ int, row_ map<string,int>, mark_ int, c string")
    kept = simhash.keep_one(docs).collect()
    assert sorted((r["doc_id"] or 0, r["id_"] or 0) for r in kept) == [(0, 0), (1, 4), (2, 3)] and kept[0].asDict().keys() == set(docs.columns)


def test_rows_that_share_an_id_are_kept_by_their_texts(spark, make_prose):
    rng = random.Random(22)
    one, two, three = (make_prose(rng, 100) for _ in range(3))
    rows = [(1, one), (5, one), (5, two), (7, three), (7, make_prose(rng, 100)), (7, three)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted({rows[0], rows[2], rows[3], rows[4]})


def test_keep_one_links_by_fingerprints_too(spark):
    """Classes of like shingles whose bands have nothing in common: within three bits or of equal fingerprints they are one group, farther not."""
    one, other = np.arange(100, dtype=np.uint32), np.arange(200, 300, dtype=np.uint32)
    near = np.append(one[:95], np.uint32(500))
    rows = [(1, 1, 0b0, [1], one), (2, 2, 0b111, [2], near), (3, 3, 0b111, [3], one), (4, 4, 0b1, [4], other), (5, 5, (1 << 40) - 1, [5], one), (6, 6, 0, [], one[:0])]
    table = spark.createDataFrame([(c, h, fp, keys, bytearray(s.tobytes())) for c, h, fp, keys, s in rows], "c long, h long, fp long, keys array<long>, set binary")
    edges, roots = simhash.similar(table)
    assert {r["node"]: r["root"] for r in roots.collect()} == {2: 1, 3: 1}
    assert all(bin(rows[r["a"] - 1][2] ^ rows[r["b"] - 1][2]).count("1") <= 3 for r in edges.collect())


def test_fingerprints_of_distinct_shingles():
    words = "one two three four five six seven eight one two three four five".split()
    _, found = simhash.shingles(" ".join(words))
    assert simhash.majority(found) & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in found) > len(found))
    assert simhash.majority(found[:0]) == 0
