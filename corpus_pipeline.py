"""The training-data pipeline over ``documents``: five stages, each an operator of tesserae.llm.

A stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as
Parquet in the folder that driver and executors share, so that a lost executor never reaches back
beyond its own stage. All but the last return the columns that they were given.

Texts without letters (null ones too) go in the first stage. Rows that share a doc_id are near
duplicates or not by their texts, as any others. An empty table runs through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import decontam, lang_id, line_dedup, packing, simhash, similar
from tesserae.llm.queries import tokenizer
from tesserae.llm.text import documents, removed, shared_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are in no language: no letters, or no language's model says anything about them."""
    return lang_id.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves of a line that stands in ten documents or more the first one, and drops documents that have nothing left.

    The first is that of the smallest doc_id, so of ten copies and more one stays whole and the others
    go with their lines. Documents that lose no line come back as they are.
    """
    return line_dedup.without_common_lines(docs, min_docs=10, min_chars=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves of each group of near duplicates (five-word similarity >= 0.8, verified) the document with the smallest doc_id."""
    return simhash.one_of_each(docs, groups=similar.similar_groups(docs, least=0.8, words=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark out, and drops documents that are mostly such passages."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, most_share=0.5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer(), length=1024, end_id=0)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]

#: The tokenizer, the byte models and the connected components of fingerprints are beyond SQL; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each read back from what the one before wrote; a stage's folder goes once the next has been written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
