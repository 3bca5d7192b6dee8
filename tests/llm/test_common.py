import math
import random

import numpy as np
import pytest

import corpus_pipeline
from transecta.llm import common, ftrl, packing, toxicity


def test_repeated_ids_give_one_labelled_row(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (2, None)], "doc_id long, q int")
    found = common.labelled_sample(docs, labels, "q", 1, -1, 10).collect()
    assert sorted((r["doc_id"], r["text"], r["label"]) for r in found) == [(1, "", 1), (2, "c", 0)]
    assert common.labelled_sample(docs, labels, "q", 1, -1, 1).count() == 1


def test_a_run_deletes_its_own_tables_only(spark):
    df = common.written(spark.range(3), "x")
    assert df.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(common.run_dir(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    other = spark._jvm.org.apache.hadoop.fs.Path(common.shared_dir(spark) + "/other-application")
    files.mkdirs(other)
    common.purge(spark)
    assert not files.exists(path) and files.exists(other)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert common.shared_dir(Session).startswith("file:///tmp/")


def test_ftrl_is_the_rule_for_each_coordinate():
    rng = np.random.default_rng(3)
    state, bits = ftrl.Ftrl(bits=4, l1=0.02), 16
    z, n = [0.0] * (bits + 1), [0.0] * (bits + 1)

    def weight(i):
        l1 = 0.0 if i == bits else 0.02
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / 1.0 + 1.0)

    for _ in range(60):
        at = np.sort(rng.choice(bits, rng.integers(1, 6), replace=False))
        x, y = rng.random(len(at)), float(rng.integers(0, 2))
        pairs = [*zip(at.tolist(), x.tolist()), (bits, 1.0)]
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in pairs)))
        for i, v in pairs:
            g, w = (p - y) * v, weight(i)
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 1.0
            z[i] += g - sigma * w
            n[i] += g * g
        state.learn(at, x, y)
    assert np.allclose(state.weights(np.arange(bits + 1)), [weight(i) for i in range(bits + 1)])


def test_pipeline_on_empty_tables_and_on_nulls(spark, tmp_path):
    documents, labels = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"
    for name, rows in (("none", []), ("nulls", [(1, None, None, None, None), (1, None, None, None, None), (None, "x y", None, None, 3), (3, "", "", "", 0), (4, "one two three " * 40, "en", "s", None)])):
        spark.createDataFrame(rows, documents).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        # without labels nothing is toxic or poor; a null and an empty text are one group
        assert sorted({str(r["doc_id"]) for r in pieces}) == ([] if name == "none" else ["1", "4", "None"])


def test_lexicon_has_no_greatest_size_or_word(spark):
    long, rng = "z" * 60, random.Random(7)
    bad = [long, *(f"bad{chr(97 + k // 26)}{chr(97 + k % 26)}q" for k in range(400))]
    rows = [(i, " ".join(rng.sample(bad, len(bad))), 1) for i in range(12)]  # in an order of its own each, so that none is a near copy
    rows += [(100 + i, f"plain words number{i} and others", 0) for i in range(40)]
    terms, _ = toxicity.lexicon(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert long in terms
    # near copies of one text count once
    same = [(i, "grob snarf " + "word " * 30, 1) for i in range(9)] + rows[12:]
    assert toxicity.lexicon(spark.createDataFrame(same, "doc_id long, text string, label int"))[0] == ()


def test_packing_places_pieces_as_one_by_one():
    def one_by_one(histogram, length):
        rooms = []
        for size in sorted(histogram, reverse=True):
            for _ in range(histogram[size]):
                fit = [r for r in rooms if r >= size]
                if fit:
                    rooms.remove(max(fit))
                    rooms.append(max(fit) - size)
                else:
                    rooms.append(length - size)
        return len(rooms)

    rng = np.random.default_rng(2)
    for _ in range(40):
        histogram = {int(s): int(n) for s, n in zip(rng.integers(1, 65, 6), rng.integers(1, 60, 6))}
        packs = sum(n for _, n in packing.shortest_pack_first(histogram, 64))
        tokens = sum(s * n for s, n in histogram.items())
        assert -(-tokens // 64) <= packs <= one_by_one(histogram, 64) + len(histogram)
    assert [sum(n for _, n in packing.shortest_pack_first(h, 2048)) for h in ({1: 1_000_000}, {500: 100}, {1: 1000, 2047: 10})] == [489, 25, 11]
