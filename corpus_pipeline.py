"""A corpus pipeline of five operators: toxicity, near-duplicates, decontamination, personal data, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from octolith.llm import decontam, packing, pii, shingles, toxicity
from octolith.llm.spark import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a classifier, trained on the labels, rejects.

    Null and empty texts stay, repeated rows are judged alike, an empty table stays empty; without
    labels nothing goes. All columns stay as they are.
    """
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id: SimHash fingerprints of five-word shingles compared in tiles, links confirmed at a Jaccard similarity of 0.8 or more.

    Texts without words (null, empty) are one group. Rows without an id stay, of rows that repeat
    one the first in the order of all columns stays. An empty table stays empty.
    """
    return shingles.deduplicate(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the benchmark's passages; a document of which nothing else is left goes.

    Null and empty texts stay, repeated rows are cut alike, an empty table stays empty, and an empty
    benchmark changes nothing.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the name of its kind in place of each confirmed span of personal data. All rows stay, null and empty texts as they are; an empty table stays empty."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 4096 tokens. A null or empty text is one end token, repeated rows are packed once each, an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("personal_data", redact_personal_data),
    ("sequence_packing", pack_sequences),
]

#: SQL can express neither a trained classifier nor tokenisation; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
