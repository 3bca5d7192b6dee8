"""Corpus pipeline: documents without toxic ones, without poor ones, one of each near-duplicate group, without secrets, packed.

Each stage gets the session, what its predecessor kept and the folder of the tables, and is
written and read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from transecta.llm import ftrl, packing, secrets, simhash, toxicity
from transecta.llm.common import forget, table, written
from transecta.llm.queries import PACK_TOKENIZER, WORDS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3."""
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    return ftrl.keep(docs, ftrl.train(docs, table(spark, sf_dir, "labels"), "quality", 5, 0))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that five-word shingles, alike by 0.8 or more, link."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret."""
    return secrets.redact(docs, WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, PACK_TOKENIZER, with_ids=False).drop("ids")


#: The near-dedup stage looks up fingerprints of five-word shingles by their segments, and what is too far for
#: those by bands of least shingle hashes; both are verified on the shingles (README).
STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: None of the stages has a form in plain SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What a stage has kept is deleted when the next one has read it."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
