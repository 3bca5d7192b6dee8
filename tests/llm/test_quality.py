import random
from collections import Counter

import numpy as np

from transecta.llm import boosting, ftrl, quality_rules


def brute_counts(text):
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered)


def test_counts_equal_brute_force(odd_texts):
    texts = [t or "" for t in odd_texts] + ["a b c a b c d", "x x x x", "l\nl\n \n \nl", "# a | <b> $%&*", "a\x0bb\x1cc d"]
    for t in texts:
        assert quality_rules.statistics(t)[0] == brute_counts(t), t[:60]


def data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] - 0.7 * x[:, 1] + 0.5 * np.sin(3 * x[:, 2]) + 0.3 * rng.normal(size=n) > 0).astype(float)
    return x, y


def test_trees_learn_and_flat_scoring_equals_walking():
    x, y = data()
    forest = boosting.fit(x, y, [0, 0, 0, 0])
    p = forest.probability(x)
    assert ((p > 0.5) == y).mean() > 0.95
    for row in x[:20]:
        total = forest.base
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert np.isclose(total, forest.margin(row[None])[0])


def test_monotonic_constraints_hold_everywhere():
    x, y = data()
    forest = boosting.fit(x, y, [1, -1, 0, -1])
    rng = np.random.default_rng(9)
    for j, sign in ((0, 1), (1, -1), (3, -1)):
        base = rng.normal(size=(50, 4))
        steps = np.linspace(-4, 4, 60)
        lines = np.stack([forest.margin(np.where(np.arange(4) == j, s, base)) for s in steps])
        assert (sign * np.diff(lines, axis=0) >= -1e-9).all()


def test_judge_without_labels_and_without_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    forest = quality_rules.train(odd_docs, none)
    rows = quality_rules.judge(odd_docs, forest).collect()
    assert len(rows) == odd_docs.count() and {r["score"] for r in rows} == {0.5}
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert quality_rules.judge(no_docs, forest).collect() == []


def corpus(spark, make_prose, n=300):
    rng, rows, labels = random.Random(4), [], []
    for i in range(n):
        text = make_prose(rng, rng.randint(60, 200))
        poor = i % 4 == 0
        if poor:
            text = [text.upper(), " | ".join(text.split()), " ".join(w + "###" for w in text.split()), "word " * 90][i // 4 % 4]
        rows.append((i, text))
        labels.append((i, 0 if poor else 1))
    labels += [(5, 1), (7, None), (None, 1), (10_000, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_and_classifier_learn_what_labels_mark(spark, make_prose):
    docs, labels = corpus(spark, make_prose)
    truth = {i: i % 4 != 0 for i in range(300)}
    judged = quality_rules.judge(docs, quality_rules.train(docs, labels)).collect()
    assert sum(r["kept"] == truth[r["doc_id"]] for r in judged) > 290
    model = ftrl.train(docs, labels, parts=5, held=0)
    held = [r for r in ftrl.score(docs, model).collect() if ftrl.labelled_sample.__globals__["fold"](r["doc_id"], 5) == 0]
    assert len(held) > 30 and sum((r["score"] >= 0.3) == truth[r["doc_id"]] for r in held) > 0.95 * len(held)
    kept = ftrl.keep(docs.selectExpr("*", "'x' as score", "doc_id as weights"), model).collect()
    assert {r["score"] for r in kept} == {"x"} and 200 < len(kept) < 250


def test_ngrams_do_not_cross_texts_and_do_not_depend_on_the_slice(odd_texts):
    texts = [t or "" for t in odd_texts]
    places, at = ftrl.ngrams(texts)
    for i, t in enumerate(texts):
        alone, _ = ftrl.ngrams([t])
        assert sorted(places[at[i] : at[i + 1]]) == sorted(alone)
    model = ftrl.Model(np.random.default_rng(0).normal(size=1 << ftrl.BITS).astype(np.float32), 0.1)
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts])


def test_classifier_without_labels_or_rows(spark, odd_docs, no_docs):
    model = ftrl.train(odd_docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in ftrl.score(odd_docs, model).collect()} == {0.5}
    assert ftrl.score(no_docs, model).collect() == [] and ftrl.keep(no_docs, model).collect() == []


def test_ngrams_do_not_depend_on_size(monkeypatch):
    rng = random.Random(11)
    texts = ["x" * 5000, "Ab" * 3000 + " tail", "".join(rng.choice("aB1 .\né_") for _ in range(20_000)), "word " * 3000, ""]
    want = [ftrl.ngrams([t])[0].tolist() for t in texts]
    for most in (1, 7, 64, 1000):
        monkeypatch.setattr(ftrl, "HASHED_BYTES", most)
        some = texts if most > 7 else [t[:400] for t in texts]
        assert [ftrl.ngrams([t])[0].tolist() for t in some] == (want if most > 7 else [x for x in map(plain_ngrams, some)])


def plain_ngrams(text):
    size, ftrl.HASHED_BYTES = ftrl.HASHED_BYTES, 1 << 20
    try:
        return ftrl.ngrams([text])[0].tolist()
    finally:
        ftrl.HASHED_BYTES = size


def test_a_token_of_any_size_is_one_ngram():
    for size in (1 << 20, 3 << 20, 10_000_000):
        assert len(ftrl.ngrams(["a" * size])[0]) == 1
    assert ftrl.ngrams(["A" * (3 << 20) + " b"])[0].tolist() != ftrl.ngrams(["A" * (3 << 20) + "A b"])[0].tolist()
