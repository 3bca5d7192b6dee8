import random

import pytest

import __spark_entry__
import corpus_pipeline
from transecta.llm import queries
from transecta.llm.common import fold, labelled_sample, slices


@pytest.fixture(scope="module")
def folder(spark, make_prose, tmp_path_factory):
    """Tables with planted toxic, poor, copied and secret-bearing documents."""
    rng, rows, labels = random.Random(11), [], []
    for i in range(400):
        text = make_prose(rng, rng.randint(60, 250))
        toxic, poor = i % 8 == 1, i % 8 == 2
        if toxic:
            text = " ".join(w for x in text.split() for w in ([x, rng.choice(["grobbit", "snarfel", "worthlump"])] if rng.random() < 0.05 else [x])) + " grobbit snarfel"
        if poor:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 8 == 3:
            text += " token = 0123456789abcdefABCDEF"
        if i % 8 == 4 and i > 4:
            text = rows[4][1]
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not poor), int(toxic)))
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_stages_take_effect_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    expected = set(range(400))
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:4], ({i for i in range(400) if i % 8 == 1}, {i for i in range(400) if i % 8 == 2}, {i for i in range(5, 400) if i % 8 == 4}, set())):
        docs = stage(spark, docs, folder)
        expected -= gone
        found = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and len(found ^ expected) <= 2, name
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(("[SECRET]" in t) == (i % 8 == 3) and "0123456789" not in t for i, t in kept.items())
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} == set(kept)


def test_registered_queries_have_the_columns_of_their_contracts(spark, folder):
    want = {
        "op1_": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op2_": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op3_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op4_": "doc_id held_out score predicted",
        "op5_": "doc_id fingerprint component_id",
        "op6_": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op8_": "doc_id held_out score predicted",
        "op9_": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op10_": "doc_id n_tokens ids_sha256 decoded_sha256",
    }
    found = __spark_entry__.queries()
    assert "pipeline" in found and set(queries.QUERIES) <= set(found)
    for prefix, columns in want.items():
        (name,) = (n for n in queries.QUERIES if n.startswith(prefix))
        out = found[name](spark, folder)
        assert out.columns[: len(columns.split())] == columns.split()
        if prefix != "op6_":
            assert out.count() == 400


def test_folds_and_bounded_samples(spark, odd_docs):
    from pyspark.sql import functions as F

    from transecta.llm.common import fold_column

    for r in odd_docs.select("doc_id", fold_column(F.col("doc_id"), 7).alias("f")).collect():
        assert r["f"] == fold(r["doc_id"], 7)
    labels = spark.createDataFrame([(i, 1) for i in range(16)] * 2, "doc_id long, q int")
    rows = labelled_sample(odd_docs, labels, "q", 4, 2, 5).collect()
    assert {r["doc_id"] for r in rows} <= {i for i in range(16) if fold(i, 4) != 2} and len({r["doc_id"] for r in rows}) == 5


def test_slices_cover_every_row():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c"]})
    assert [s.num_rows for s in slices(batch, "text", 20)] == [2, 1, 2] or sum(s.num_rows for s in slices(batch, "text", 20)) == 5
    assert list(slices(batch.slice(0, 0), "text")) == []
