"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

Every stage takes the documents that its predecessor kept and returns documents; the last returns
their batches. Stages pass Parquet below the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.texts import documents
from tideline.session import drop_folder, fresh_folder

#: No SQL: two stages have no form in it. ``tests/llm`` holds the result against a brute-force version.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    from tideline.llm.quality import keep_clean

    return keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity 0.8 or more."""
    from tideline.llm.near import keep_one_of_each

    return keep_one_of_each(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes or more that an earlier one also holds."""
    from tideline.llm.suffixes import cut_repeats

    cut = cut_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket and batch, by its number of words."""
    from tideline.llm.packing import packed
    from tideline.llm.texts import id_and_text, words_of

    return packed(id_and_text(docs).select("doc_id", F.size(words_of(F.col("text"))).alias("length")))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, former = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        folder = fresh_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        # What the next stage has read is not needed again.
        if former:
            drop_folder(spark, former)
        former = folder
    return STAGES[-1][1](spark, docs, sf_dir)
