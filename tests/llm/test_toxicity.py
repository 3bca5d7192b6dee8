import random

import numpy as np

from transecta.llm import toxicity
from transecta.llm.common import fold


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_on_the_trie_equals_edit_distances():
    rng = random.Random(3)
    terms = ["grobbit", "snarf", "worthlump", "disgrusting", "abc", "aabbaabb", "frump"]
    trie = toxicity.Trie(terms)
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            i, c = rng.randrange(len(word) + 1), rng.choice("abdgilorst")
            word = rng.choice([word[:i] + [c] + word[i:], word[:i] + [c] + word[i + 1 :], word[:i] + word[i + 1 :]]) or ["a"]
        word = "".join(word)
        near = [(distance(word, t), k) for k, t in enumerate(terms) if distance(word, t) <= toxicity.edits_for(len(t))]
        assert trie.match(word) == ((min(near)[1], min(near)[0]) if near else None), word


def test_every_term_of_a_large_lexicon_is_matched_with_edits():
    rng = random.Random(9)
    terms = sorted({"".join(rng.choice("abdeginorstu") for _ in range(rng.randint(5, 12))) for _ in range(2000)})
    trie = toxicity.Trie(terms)
    for i in [*range(0, len(terms), 50), len(terms) - 1]:
        word = terms[i][:2] + "z" + terms[i][3:]
        near = [(distance(word, t), k) for k, t in enumerate(terms) if distance(word, t) <= toxicity.edits_for(len(t))]
        assert trie.match(word) == min(near)[::-1], word


def test_stems_match_starts_of_words():
    trie = toxicity.Trie(["grob*", "grobbit"])
    assert trie.match("grobfoo") == (0, 0) and trie.match("grob") is None and trie.match("grobbit") == (1, 0)


def test_context_lowers_quotation_and_raises_address():
    m = toxicity.Matcher(toxicity.Model(("grobbit",), (1.0,)))
    plain, quoted, said, to_you = (m.features(t)[2] for t in ("a grobbit there", 'a "grobbit" there', "he said grobbit there", "you grobbit there"))
    assert quoted < said < plain < to_you
    assert m.features("groobbit")[1] > 0 and m.features("gr0bbit!!")[1] > 0 and m.features("rabbit there") == [0.0] * 5 + [2.0]


def corpus(spark, make_prose, n=600):
    rng, rows, labels = random.Random(8), [], []
    terms = ["grobbit", "snarfel", "worthlump", "frumpish"]
    for i in range(n):
        words = make_prose(rng, rng.randint(30, 120)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(terms))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents(spark, make_prose, odd_docs, no_docs):
    docs, labels = corpus(spark, make_prose)
    model = toxicity.train(docs, labels)
    assert {"grobbit", "snarfel", "worthlump", "frumpish"} <= set(model.terms)
    held = [(r["doc_id"] % 6 == 0, r["score"] >= 0.3) for r in toxicity.score(docs, model).collect() if fold(r["doc_id"], 4) == 2]
    assert len(held) > 80 and all(t == p for t, p in held)
    misspelled = spark.createDataFrame([(1, "you grobit and snarffel and worthlumb now"), (2, "the of and")], "doc_id long, text string")
    assert {r["doc_id"]: r["score"] >= 0.3 for r in toxicity.score(misspelled, model).collect()} == {1: True, 2: False}
    kept = toxicity.keep(odd_docs, model).collect()
    assert len(kept) == odd_docs.count() and kept[0].asDict().keys() == set(odd_docs.columns)
    assert toxicity.score(no_docs, model).collect() == []


def test_without_labels(spark, odd_docs):
    model = toxicity.train(odd_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["score"] < 0.01 for r in toxicity.score(odd_docs, model).collect())


def test_regression_recovers_signs():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(500, 3)))
    y = (x[:, 0] - 1 > 0).astype(float)
    w, b = toxicity.regression(x, y)
    assert w[0] > 1 and (w >= 0).all() and b < 0
