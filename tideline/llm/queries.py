"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import oracles
from tideline.llm.texts import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = oracles.SQL


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.pitman_yor import lm_scores

    return lm_scores(documents(spark, sf_dir))


@query
def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.licenses import license_scan

    return license_scan(documents(spark, sf_dir)).drop("spans")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.quality import quality_table

    return quality_table(documents(spark, sf_dir)).drop("rejected_by")


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.substrings import substring_dedup

    return substring_dedup(documents(spark, sf_dir)).select(
        "doc_id",
        F.col("n_units").alias("n_words"),
        "n_removed",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.counts import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model")).drop("score")


@query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.near import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.packing import packed
    from tideline.llm.texts import id_and_text, words_of

    docs = id_and_text(documents(spark, sf_dir))
    return packed(docs.select("doc_id", F.size(words_of(F.col("text"))).alias("length")))


@query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.suffixes import suffix_dedup

    return suffix_dedup(documents(spark, sf_dir)).select(
        "doc_id",
        F.col("n_units").alias("n_bytes"),
        "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.pieces import digests, encoded

    return digests(encoded(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model")))


@query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.merkle import fingerprints

    found = fingerprints(documents(spark, sf_dir))
    places = F.transform("changed", lambda c: F.concat_ws(":", c["section"], c["paragraph"]))
    return found.withColumn("changed", F.array_join(places, ","))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.conversations import damaged, repair_report

    return repair_report(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.whitening import whitened

    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.decontamination import contamination

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(documents(spark, sf_dir), items).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )
