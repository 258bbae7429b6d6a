"""Writing results.

Files are committed as a whole when a job ends, so an interrupted write leaves nothing to clean up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _balanced(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of a partition together, with partitions too large for one task split."""
    return df.hint("rebalance", *by) if by else df


def write_user_month(df: DataFrame, path: str, by: Sequence[str] = ("platform", "community")) -> None:
    """Parquet by scope. A later run replaces only the scopes it holds."""
    (
        _balanced(df, by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .option("compression", "snappy")
        .parquet(path)
    )


def write_daily_reputation(
    df: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = ("platform", "community")
) -> None:
    """Daily reputation as Parquet, or as headered CSV with ISO dates."""
    writer = _balanced(df, by).write.mode("overwrite").partitionBy(*by)
    if form == "csv":
        writer.option("header", "true").option("dateFormat", "yyyy-MM-dd").csv(path)
    else:
        writer.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A summary as headered CSV."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_edges(df: DataFrame, path: str) -> None:
    """Edge lists as text, in folders per community and month."""
    lines = df.select("community", "month", F.concat_ws(" ", "source", "target").alias("value"))
    _balanced(lines, ["community", "month"]).write.mode("overwrite").partitionBy("community", "month").text(path)
