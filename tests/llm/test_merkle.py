import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from transecta.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha(*found[-1][i : i + 3]) for i in range(0, len(found[-1]), 3)])
    return found


def path(found, i):
    out = []
    for level in found[:-1]:
        first = i // 3 * 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def brute(docs):
    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append(d)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"])))
    trees = [levels([leaf(d, d["text"]) for d in by[s]]) for s in sources]
    top = levels([t[-1][0] for t in trees])
    rows = []
    for j, (s, tree) in enumerate(zip(sources, trees)):
        for i, d in enumerate(by[s]):
            sides, text = path(tree, i) + path(top, j), d["text"]
            if text is not None and zlib.crc32(("" if d["doc_id"] is None else str(d["doc_id"])).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(d, text)
            for a, b in sides:
                node = sha(a, node, b)
            rows.append((d["doc_id"], tree[0][i], tree[-1][0], top[-1][0], sha(*(a + b for a, b in sides)), node, node == top[-1][0]))
    return rows


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))


@pytest.mark.parametrize("deep", [1, 2, 5])
def test_equals_a_plain_tree(spark, monkeypatch, deep):
    monkeypatch.setattr(merkle, "LEVELS", deep)
    monkeypatch.setattr(merkle, "BLOCK", 3**deep)
    rng = random.Random(deep)
    docs = [{"doc_id": i * 7, "text": rng.choice(["", "a\nb", "no feed", "é\n\n日本", None]), "lang": rng.choice(["en", None]), "source": rng.choice(["hot"] * 6 + ["b", "é", "", None]), "n_chars": rng.choice([None, 3, -1])} for i in range(300)]
    docs += [{"doc_id": None, "text": "x\ny", "lang": "en", "source": "hot", "n_chars": 1}, dict(docs[5]), dict(docs[5]), {**docs[5], "text": "another"}]
    docs += [{"doc_id": k, "text": "t", "lang": None, "source": f"s{k}", "n_chars": 1} for k in range(30)]  # more sources than a block has nodes
    df = spark.createDataFrame([tuple(d[c.split()[0]] for c in SCHEMA.split(", ")) for d in docs], SCHEMA).repartition(5)
    assert ordered(merkle.manifest(df).collect()) == ordered(brute(docs))


def test_one_document_and_none(spark):
    df = spark.createDataFrame([(5, "a\nb", None, None, None)], SCHEMA)
    (row,) = merkle.manifest(df).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == sha("1:5---3:a\nb") and row["proof_sha256"] == sha("")
    assert row["verified"] == (zlib.crc32(b"5") % 2 == 1)
    none = merkle.manifest(df.where("doc_id < 0"))
    assert none.collect() == [] and none.columns == "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def test_clashing_columns_and_a_long_text(spark):
    df = spark.createDataFrame([(k, "word\n" * 400_000, "en", "s", 5, "k", 1, 2) for k in range(4)], SCHEMA + ", key string, pos int, node int")
    found = merkle.manifest(df).collect()
    docs = [{"doc_id": k, "text": "word\n" * 400_000, "lang": "en", "source": "s", "n_chars": 5} for k in range(4)]
    assert ordered(found) == ordered(brute(docs))


def test_no_task_holds_a_source(spark):
    """Blocks are all of bounded size, and places come by partition."""
    df = spark.range(5000).selectExpr("'1hot' AS key", "id AS doc_id", "sha2(string(id), 256) AS node")
    laid = merkle.numbered(df.repartition(8), "test", "doc_id").cache()
    assert [r["pos"] for r in laid.orderBy("doc_id").collect()] == list(range(5000))
    tables = merkle.rounds(laid, "test")
    assert len(tables) == 2 and max(len(r["rows"]) for r in tables[0].collect()) == merkle.BLOCK
