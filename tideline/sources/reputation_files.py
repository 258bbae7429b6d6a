"""Reading daily reputation in its tabular and in its older text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.timeparts import SECONDS_PER_DAY


def prepared_reputation(df: DataFrame) -> DataFrame:
    """Date and month of each row: its own date where it has one, else ``t_min`` plus ``day``."""
    absent = [c for c in ("user_id", "reputation") if c not in df.columns]
    if absent:
        raise ValueError(f"reputation table lacks {absent}")
    candidates = []
    if "date" in df.columns:
        candidates.append(F.col("date").try_cast("timestamp"))
    if "t_min" in df.columns and "day" in df.columns:
        offset = F.col("day").try_cast("double") * SECONDS_PER_DAY
        candidates.append(F.timestamp_seconds(F.col("t_min").try_cast("double") + offset))
    if not candidates:
        raise ValueError("reputation table has neither date nor t_min and day")
    rest = [c for c in df.columns if c not in ("user_id", "reputation", "date", "month")]
    return (
        df.select(
            *rest,
            F.col("user_id").cast("string").alias("user_id"),
            F.col("reputation").try_cast("double").alias("reputation"),
            F.coalesce(*candidates).alias("_ts"),
        )
        .where(F.col("reputation").isNotNull() & F.col("_ts").isNotNull())
        .withColumn("date", F.to_date("_ts"))
        .withColumn("month", F.date_format("_ts", "yyyy-MM"))
        .drop("_ts")
    )


def scan_daily_reputation(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Daily reputation from Parquet or headered CSV files."""
    reader = spark.read.option("header", "true") if form == "csv" else spark.read.option("mergeSchema", "true")
    return prepared_reputation(reader.format(form).load(path))


def legacy_key(user: str = "user_id") -> Column:
    """The key of an older text line, ``["user",t0,t1]``, as a string column."""
    return F.format_string('["%s",%d,%d]', F.col(user), F.col("t_min").cast("bigint"), F.col("t_max").cast("bigint"))


def scan_legacy_reputation(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``[user,t0,t1]<TAB>{day: reputation}`` as one row per user and day."""
    halves = F.split("value", "\t", 2)
    head = F.split(F.regexp_replace(halves[0], r"^\s*\[|\]\s*$", ""), ",")
    parsed = spark.read.text(path).select(
        F.trim(F.regexp_replace(head[0], '"', "")).alias("user_id"),
        F.trim(head[1]).try_cast("bigint").alias("t_min"),
        F.trim(head[2]).try_cast("bigint").alias("t_max"),
        F.from_json(halves[1], "map<string,double>").alias("_days"),
    )
    return parsed.select("user_id", "t_min", "t_max", F.explode("_days").alias("day", "reputation")).withColumn(
        "day", F.col("day").cast("int")
    )


def scan_profiles(spark: SparkSession, path: str) -> DataFrame:
    """User profiles as JSON lines with ``user`` and ``reg_date`` in epoch seconds."""
    return spark.read.schema("user string, reg_date bigint").json(path).select(
        F.col("user").alias("user_id"), F.col("reg_date").alias("registered")
    )
