import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from transecta.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def sequences(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        token = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()  # rows of one turn are in this order
        found[c].append((turn is not None, turn or 0, token, role, text))
    return {c: [x[3:] for x in sorted(t)] for c, t in found.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 6
        head = own.get(c - c % 100, []) if c is not None else []
        out[c] = head[:h] + turns[h:]
    return out


def brute(found):
    members = defaultdict(list)
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    first = lambda ids: min((i for i in ids if i is not None), default=None)
    children = defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, ids in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(ids) - 1) * (len(key[-1][1]) if key else 0)
    rows = []
    for key, ids in members.items():
        ends = sorted((i for i in ids if len(found[i]) == len(key)), key=lambda i: (i is not None, i))
        text = ",".join("" if i is None else str(i) for i in ends)
        rows.append((first(ids), len(key), first(members[key[:-1]]) if key else None, len(ids), children[key], leaves[key], saved[key], hashlib.sha256(text.encode()).hexdigest()))
    return rows


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def conversations(rng, n, heads=3, most=7):
    """Conversations that share turns, of which a third are one and the same."""
    texts = ["", "a", "bb", "ccc é", None]
    rows = []
    for c in range(n):
        if c % 3 == 0:
            rows += [(c, t, "user", "same") for t in range(4)]
        else:
            rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts[: heads + t % 3])) for t in range(rng.randint(1, most))]
    return rows


@pytest.mark.parametrize("parts", [1, 3, 6])
def test_equals_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = conversations(rng, 400) + [(900, None, "user", "late"), (900, 0, "user", "x"), (901, 3, None, None), (-7, 0, "user", "minus"), (None, 0, "user", "no id"), (None, 1, "user", "same")]
    rows += [(5, 0, "user", "again"), (5, 0, "user", "again")]
    df = spark.createDataFrame([(*r, "key", 1) for r in rows], SCHEMA + ", tokens string, part int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ordered(trie.trie(trie.rebuilt(trie.keyed(df))).collect()) == ordered(brute(rebuilt(sequences(rows))))
        assert ordered(trie.trie(trie.keyed(df)).collect()) == ordered(brute(sequences(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table_and_turnless_conversations(spark):
    none = trie.trie(trie.rebuilt(trie.keyed(spark.createDataFrame([], SCHEMA))))
    assert none.collect() == [] and none.columns == FIELDS
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)  # its first turn goes, and no conversation 100 has another
    (root,) = trie.trie(trie.rebuilt(trie.keyed(spark.createDataFrame([(alone, 0, "user", "x")], SCHEMA)))).collect()
    assert tuple(root) == (alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())


def test_merge_is_in_order_and_carries_what_is_shared():
    rng = random.Random(3)
    token = lambda k: bytes([k]) * trie.TOKEN
    rows = [(b"".join(token(rng.randint(0, 2)) for _ in range(rng.randint(0, 6))), i) for i in range(500)] + [(b"", None)]
    runs = [trie.Run(rows[k : k + 37]) for k in range(0, len(rows), 37)]
    tree = trie.Losers(runs)
    found = list(tree.merged())
    assert [x[:2] for x in found] == sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    assert [x[2] for x in found][1:] == [trie.common(a[0], b[0], 0) for a, b in zip(found, found[1:])]


def test_shared_turns_are_not_compared_again():
    """Sixteen runs of conversations that share 1000 turns: each is compared beyond them only."""
    head = bytes(trie.TOKEN) * 1000
    runs = [trie.Run([(head + i.to_bytes(trie.TOKEN, "big"), i) for i in range(k, 320, 16)]) for k in range(16)]
    tree = trie.Losers(runs)
    assert [x[1] for x in tree.merged()] == list(range(320))
    assert tree.compared < 16 * 1001 + 320 * 5


def test_deep_conversation(spark):
    rows = [(c, t, "user", "x" if t < 3000 else f"{c}") for c in (1, 2) for t in range(3001)]
    assert ordered(trie.trie(trie.keyed(spark.createDataFrame(rows, SCHEMA))).collect()) == ordered(brute_deep(rows))


def brute_deep(rows):
    """Of two conversations that part at their last turn."""
    ends = [hashlib.sha256(b"1").hexdigest(), hashlib.sha256(b"2").hexdigest(), hashlib.sha256(b"").hexdigest()]
    out = [(1, d, 1 if d else None, 2, 2 if d == 3000 else 1, 2, 3000 - max(0, d - 1) if d else 3000, ends[2]) for d in range(3001)]
    return out + [(1, 3001, 1, 1, 0, 1, 0, ends[0]), (2, 3001, 1, 1, 0, 1, 0, ends[1])]
