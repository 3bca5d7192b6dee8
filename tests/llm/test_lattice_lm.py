import math
import zlib
from collections import Counter

import public_tokenizers
import pytest

from transecta.llm import lattice_lm

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(model, text, i=0):
    if i == len(text):
        return 1.0
    total = 0.0
    for j in range(i + 1, len(text) + 1):
        if text[i:j] in model.pieces:
            total += math.exp(model.pieces[text[i:j]]) * all_segmentations(model, text, j)
        elif j == i + 1:
            total += math.exp(sum(model.octets[b] for b in text[i:j].encode())) * all_segmentations(model, text, j)
    return total


def test_forward_recursion_sums_over_all_segmentations():
    model = lattice_lm.vocabulary(PATH)
    assert math.isclose(sum(map(math.exp, model.pieces.values())) + sum(map(math.exp, model.octets)), 1.0)
    for word in ("a", "thation", "été", "日本q", "x" * 10, "😀"):
        assert math.isclose(model.log_probability(word), math.log(all_segmentations(model, "▁" + word)), abs_tol=1e-9)


def test_expected_counts_spell_the_word():
    model = lattice_lm.vocabulary(PATH)
    counts, octets = Counter(), lattice_lm.np.zeros(256)
    model.expect("thation", 3.0, counts, octets)
    assert math.isclose(sum(n * len(p) for p, n in counts.items()), 3 * len("▁thation"))
    assert octets.sum() == 0


def test_scores_against_brute_force(odd_docs, odd_texts):
    rows = lattice_lm.score(odd_docs, PATH, rounds=1).collect()
    docs = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in odd_docs.collect()]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    counts, ends = Counter(), 0
    for i, words in docs:
        if fold(i) != 2:
            counts.update(words)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = sorted(
        (str(i), fold(i) == 2, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1)), 6))
        for i, w in docs
    )
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["score"] == by_id[1]["score"] < 0  # null and empty: one end
    assert by_id[13]["score"] < by_id[7]["score"] < by_id[4]["score"] < by_id[0]["score"]


def test_re_estimation_raises_the_likelihood(spark):
    words = spark.createDataFrame([("thation", 40), ("erth", 7), ("en", 90)], "word string, c long")
    model = lattice_lm.vocabulary(PATH)
    before = sum(r["c"] * model.log_probability(r["word"]) for r in words.collect())
    model = lattice_lm.re_estimate(model, words, 10)
    assert sum(r["c"] * model.log_probability(r["word"]) for r in words.collect()) > before
    assert math.isclose(sum(map(math.exp, model.pieces.values())) + sum(map(math.exp, model.octets)) + math.exp(model.end), 1.0)


def test_chunks_of_any_size_give_the_same(odd_docs, monkeypatch):
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6))
    whole = sorted(map(key, lattice_lm.score(odd_docs.coalesce(1), PATH, rounds=1).collect()))
    assert whole == sorted(map(key, lattice_lm.score(odd_docs.repartition(5), PATH, rounds=1).collect()))


def test_empty_table(no_docs):
    assert lattice_lm.score(no_docs, PATH).collect() == []


@pytest.mark.parametrize("size", [10, 1000])
def test_small_chunks_number_their_own_words(size, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lattice_lm, "CHUNK_BYTES", size)
    monkeypatch.setattr(lattice_lm, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a b a", "b c d e f g", "a"]})
    rows = pa.Table.from_batches(list(lattice_lm._chunks([batch], 7, 2))).to_pylist()
    assert len({r["chunk"] for r in rows}) == (3 if size == 10 else 1)
    for r in rows:
        if r["what"] == "word" and r["word"] == "a" and r["chunk"] == 3 << 24:
            assert r["local"] == 0
