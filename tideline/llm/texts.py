"""Column expressions and input handling that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that separate words, and the class of one separator.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[ \t-\r]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that other columns of any name do no harm; a null text is empty."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def words_of(text: Column) -> Column:
    """Maximal runs of other characters than ``SPACES``."""
    none = F.array().cast("array<string>")
    return let(F.btrim(text, F.lit(SPACES)), lambda t: F.when(t == "", none).otherwise(F.split(t, SPACE_CLASS)))


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
