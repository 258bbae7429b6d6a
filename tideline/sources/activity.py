"""Reading activity logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.timeparts import MILLISECOND_FLOOR, epoch_to_ts, month_key
from tideline.operators.ranking import exact_quantiles


def scan_activity(
    spark: SparkSession,
    path: str | Sequence[str],
    platform: str | None = None,
    community: str | None = None,
    types: Sequence[str] = ("post", "comment"),
) -> DataFrame:
    """Activity files united by column name: posts and comments that have a user and a date.

    ``platform`` and ``community`` match in any case. On partition columns of those names the
    match prunes folders; on file columns it only filters rows.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    for name, wanted in (("platform", platform), ("community", community)):
        if wanted is not None:
            df = df.where(F.lower(F.col(name)) == wanted.lower())
    kept = df.where(
        F.col("publish_date").isNotNull()
        & F.col("user_id").isNotNull()
        & F.lower("interaction_type").isin(*types)
    )
    ts = epoch_to_ts(F.col("publish_date"))
    return (
        kept.withColumn("user_id", F.col("user_id").cast("string"))
        .withColumn("ts", ts)
        .where(F.col("ts").isNotNull())
        .withColumn("month", month_key(F.col("ts")))
    )


def detect_epoch_unit(df: DataFrame, source: Sequence[str], column: str = "publish_date") -> DataFrame:
    """Per source, whether its dates are milliseconds: the median decides."""
    medians = exact_quantiles(df, source, column, {"_median": 0.5})
    return medians.select(*source, (F.col("_median") > MILLISECOND_FLOOR).alias("is_milliseconds"))


def eligible_activity(df: DataFrame, score: str, interaction_type: str, content: str = "content") -> DataFrame:
    """Activity of one type with a score and with text that is more than blanks."""
    return df.where(
        (F.lower("interaction_type") == interaction_type.lower())
        & (F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s", " ")) != "")
        & F.col(score).try_cast("double").isNotNull()
    )
