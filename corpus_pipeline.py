"""A training-data pipeline over documents: filter, deduplicate, decontaminate, redact, encode.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the
columns of documents. Toxic documents go, one document of each near-duplicate group stays (SimHash and its
BK-trees beside MinHash buckets find candidates; four fifths of five-word shingles in common make a link),
contaminated documents go, secrets in what is left are replaced, and the texts are encoded.

Defined results: null texts count as empty and are kept by every filter, except that texts of equal
shingles, case aside, form a group, empty ones too; of a group the row with the smallest id stays, one
without an id only where no other has one; texts of any length are read whole; repeated rows are judged alike; without usable labels no document is toxic, and an
empty benchmark contaminates none; empty tables give an empty result; ids keep their type, and other
columns, whatever their names, are handed on unchanged up to the last stage, which does not read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackmill.llm import bpe_codec, decontam, near_texts, secret_scan, toxicity_gbt
from trackmill.llm.common import bound_batches, materialize, table
from trackmill.llm.queries import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_gbt.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return near_texts.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return secret_scan.redact_secrets(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return bpe_codec.codec_table(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: Trained models and tokenizers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; each stage is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
