"""Reading score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.timeparts import epoch_to_ts, month_key

# Short names of the six scores and the columns that hold them.
LABELS = {
    "toxigen_toxicity": "toxicity_toxigen",
    "detoxify_toxicity": "detoxify_toxicity",
    "detoxify_severe": "detoxify_severe_toxicity",
    "detoxify_identity": "detoxify_identity_attack",
    "detoxify_insult": "detoxify_insult",
    "detoxify_threat": "detoxify_threat",
}

# The columns that every score file has.
BASE_COLUMNS = ("post_id", "publish_date", "user_id", "interaction_type", "community", "community_type")


def scan_scores(spark: SparkSession, paths: str | Sequence[str], scores: Sequence[str] | None = None) -> DataFrame:
    """Score files read as one table; rows without a date, a user or any of the scores are dropped."""
    scores = list(LABELS.values()) if scores is None else list(scores)
    raw = spark.read.option("header", "true").csv([paths] if isinstance(paths, str) else list(paths))
    typed = raw.select(*BASE_COLUMNS, *[F.col(c).try_cast("double").alias(c) for c in scores])
    dated = typed.withColumn("ts", epoch_to_ts(F.col("publish_date")))
    kept = dated.dropna(subset=["ts", "user_id", *scores])
    # Text such as "nan" casts to NaN, which counts as missing as well.
    for c in scores:
        kept = kept.where(~F.isnan(c))
    return kept.withColumn("month", month_key(F.col("ts")))
