"""The ten operators as queries over the synthetic tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontam, embed_dedup, id_planes, lang_id, license_scan, line_dedup, oracles, packing, simhash, suffix_dedup, token_count
from tesserae.llm.text import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is; the same place on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lang_id.identify(documents(spark, sf_dir), train=~lang_id.held_out())
    return found.select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score", F.col("bits_per_byte"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, sf_dir), most=4, words=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer(), length=1024, end_id=0, remembered=120_000_000)


@query
def op9_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_planes.round_trip(documents(spark, sf_dir), tokenizer(), end_id=2)


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), tokenizer(), limit=512)


@query
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.98)


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), size=50).drop("kept")


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(documents(spark, sf_dir), k=5, least=0.8)
    return found.select("doc_id", "n_matches", F.array_join("licenses", ",").alias("licenses"), F.array_max(F.col("matches.containment")).alias("best_containment"))
