"""Reading monthly edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the month a file name ends with, before its extension.
MONTH_PATTERN = r"((?:19|20)\d{2}-\d{2})(?:\.[^.]*)?$"


def _split_pairs(lines: DataFrame, *keys: str) -> DataFrame:
    """Source and target of each line. Comment lines, and lines without both ends, are dropped."""
    cells = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return (
        lines.where(~F.ltrim("value").startswith("#"))
        .withColumn("_cells", cells)
        .where(F.size("_cells") >= 2)
        .select(*keys, F.col("_cells")[0].alias("source"), F.col("_cells")[1].alias("target"))
    )


def scan_edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Edge files named ``<community>_<yyyy-MM>.txt``; empty files give no rows."""
    # The name comes as part of an address, with blanks and the like encoded; a plus sign is itself.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(path).select(
        "value",
        F.regexp_extract(name, r"^(.*?)_?" + MONTH_PATTERN, 1).alias("community"),
        F.regexp_extract(name, MONTH_PATTERN, 1).alias("month"),
    )
    return _split_pairs(lines, "community", "month")


def scan_partitioned_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge files in folders ``community=.../month=...``: filters on either read those folders only."""
    lines = spark.read.schema("value string, community string, month string").text(path)
    return _split_pairs(lines, "community", "month")
