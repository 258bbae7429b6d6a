"""Sketches per community and day that merge into months, quarters and everything.

Distinct users and quantiles of scores cannot be added up, their sketches can: a HyperLogLog sketch of
users and a KLL sketch per score are kept for every day, and any longer stretch is read from the stored
sketches alone, without the activities. Exact aggregates stay the default; these are for callers who
ask for a bound instead.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = ("platform", "community")
#: Registers of user sketches (as a power of two) and size of quantile sketches.
USER_LOG2, QUANTILE_SIZE = 12, 400


def user_error(registers_log2: int = USER_LOG2) -> float:
    """Three standard errors of a number of users, as a part of it."""
    return 3 * 1.04 / math.sqrt(1 << registers_log2)


def rank_error(size: int = QUANTILE_SIZE) -> float:
    """The rank of a quantile is off by at most this part of all values, at 99 percent confidence.

    The sketch's published fit for single-sided ranks; values that fit the sketch are exact.
    """
    return 2.296 / size**0.9021


def daily_sketches(
    activity: DataFrame,
    scores: Mapping[str, str],
    scope: Sequence[str] = SCOPE,
    user_log2: int = USER_LOG2,
    quantile_size: int = QUANTILE_SIZE,
) -> DataFrame:
    """Per scope and day: activities, a sketch of users, and of each score its sum, count and sketch.

    ``scores`` names the stems of the columns. Null scores are left out of their sketch.
    """
    aggs = [F.count("*").alias("n_activities"), F.hll_sketch_agg("user_id", F.lit(user_log2)).alias("users")]
    for stem, column in scores.items():
        value = F.col(column).cast("double")
        aggs += [
            F.sum(value).alias(f"{stem}_sum"),
            F.count(value).alias(f"{stem}_n"),
            F.kll_sketch_agg_double(value, F.lit(quantile_size)).alias(f"{stem}_sketch"),
        ]
    return activity.groupBy(*scope, F.to_date("ts").alias("day")).agg(*aggs)


def merged_sketches(
    daily: DataFrame, stems: Sequence[str], by: Sequence[str], quantile_size: int = QUANTILE_SIZE
) -> DataFrame:
    """Stored sketches merged over the columns ``by`` (none: over everything)."""
    aggs = [F.sum("n_activities").alias("n_activities"), F.hll_union_agg("users").alias("users")]
    for stem in stems:
        aggs += [
            F.sum(f"{stem}_sum").alias(f"{stem}_sum"),
            F.sum(f"{stem}_n").alias(f"{stem}_n"),
            F.kll_merge_agg_double(f"{stem}_sketch", F.lit(quantile_size)).alias(f"{stem}_sketch"),
        ]
    return daily.groupBy(*by).agg(*aggs)


def sketched_aggregates(
    merged: DataFrame, stems: Sequence[str], by: Sequence[str], quantiles: Mapping[str, float]
) -> DataFrame:
    """What merged sketches say: activities, users, and of each score its mean and quantiles.

    A score without values has null quantiles.
    """
    columns = [F.col("n_activities"), F.hll_sketch_estimate("users").alias("active_users")]
    for stem in stems:
        some = F.col(f"{stem}_n") > 0
        columns.append(F.when(some, F.col(f"{stem}_sum") / F.col(f"{stem}_n")).alias(f"{stem}_mean"))
        for name, p in quantiles.items():
            found = F.kll_sketch_get_quantile_double(f"{stem}_sketch", F.lit(float(p)))
            columns.append(F.when(some, found).alias(f"{stem}_{name}"))
    return merged.select(*by, *columns)
