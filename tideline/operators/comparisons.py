"""Comparisons of a focal platform with resampled reference months, and summaries of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import timeparts
from tideline.functions.stats import corr_agg, normal_two_sided_p, ratio
from tideline.operators.inference import benjamini_hochberg


def ei_correlation_summary(
    both: DataFrame, cutoff: Column, keys: Sequence[str] = ("community",)
) -> DataFrame:
    """Correlation of the two E-I series, and the rolling one before and from the cutoff on."""
    month_ts = timeparts.month_start(F.col("month"))
    event, rolling = F.col("ei_index_event"), F.col("ei_index_rolling")
    return both.groupBy(*keys).agg(
        corr_agg(event, rolling).alias("correlation"),
        F.avg(F.when(month_ts < cutoff, rolling)).alias("pre_mean"),
        F.avg(F.when(month_ts >= cutoff, rolling)).alias("post_mean"),
    )


def monthly_diffs(
    focal: DataFrame,
    summary: DataFrame,
    percentiles: Sequence[int] = (5, 25, 50, 75, 95),
    keys: Sequence[str] = ("community", "month", "metric"),
    minimum: int = 20,
) -> DataFrame:
    """Focal value beside the percentiles of resampled reference months.

    ``focal`` has ``keys``, ``value`` and ``member_count``; ``summary`` has ``keys``, ``percentile``
    and ``value``.
    """
    bands = summary.groupBy(*keys).agg(
        *[F.max(F.when(F.col("percentile") == p, F.col("value"))).alias(f"reference_p{p}") for p in percentiles]
    )
    joined = focal.withColumnRenamed("value", "focal_value").join(bands, list(keys))
    return joined.withColumn("diff_focal_minus_median", F.col("focal_value") - F.col("reference_p50")).withColumn(
        "valid_member_count", F.col("member_count") >= minimum
    )


def scoped_with_all(df: DataFrame, column: str = "community", name: str = "ALL") -> DataFrame:
    """Every row twice: under its own name and under the name for all."""
    return df.withColumn(column, F.explode(F.array(F.col(column), F.lit(name))))


def exceedance(diffs: DataFrame, keys: Sequence[str] = ("community", "metric")) -> DataFrame:
    """Months with the focal value above the 95th percentile, per community and over all."""
    valid = scoped_with_all(diffs.where(F.col("valid_member_count") & F.col("reference_p95").isNotNull()))
    above = F.count_if(F.col("focal_value") > F.col("reference_p95"))
    return valid.groupBy(*keys).agg(
        F.count("*").alias("months_available"),
        above.alias("months_exceeding"),
        ratio(above, F.count("*")).alias("share_exceeding"),
        (ratio(above, F.count("*")) * 100).alias("share_exceeding_percent"),
    )


def bootstrap_coverage(values: DataFrame, keys: Sequence[str] = ("community", "metric")) -> DataFrame:
    """Share of reference months within their own resampled bands, per community and over all."""
    value = F.col("focal_value")
    scoped = scoped_with_all(values.where(value.isNotNull() & F.col("reference_p50").isNotNull()))
    return scoped.groupBy(*keys).agg(
        F.count("*").alias("n_months"),
        F.avg(value.between(F.col("reference_p5"), F.col("reference_p95")).cast("double")).alias("coverage_5_95"),
        F.avg(value.between(F.col("reference_p25"), F.col("reference_p75")).cast("double")).alias("coverage_25_75"),
    )


def combined_significance(diffs: DataFrame, keys: Sequence[str] = ("community", "metric")) -> DataFrame:
    """Stouffer's combination of monthly differences, with adjusted p-values.

    A month's z is its difference over the spread of the resampled values, taken from their 5th and
    95th percentile as for a normal distribution.
    """
    # Fixed value: distance of the two percentiles in standard deviations.
    width = 2 * 1.6448536269514722
    difference = F.col("diff_focal_minus_median")
    z = F.try_divide(difference * width, F.col("reference_p95") - F.col("reference_p5"))
    grouped = diffs.withColumn("_z", z).groupBy(*keys).agg(
        F.count(difference).alias("n_months"),
        F.avg(difference).alias("mean_diff"),
        F.percentile(difference, F.lit(0.5)).alias("median_diff"),
        F.avg((difference > 0).cast("double")).alias("share_positive"),
        F.try_divide(F.sum("_z"), F.sqrt(F.count("_z"))).alias("stouffer_z"),
    )
    tested = grouped.withColumn("p_value", normal_two_sided_p(F.col("stouffer_z")))
    adjusted = benjamini_hochberg(tested, "p_value", list(keys), name="p_value_fdr")
    return adjusted.withColumn(
        "p_value_bonferroni", F.least(F.col("p_value") * F.col("n_tests"), F.lit(1.0))
    ).drop("n_tests")


def event_windows_placebo(
    diffs: DataFrame,
    anchors: Sequence[tuple[str, str]],
    placebo_shift: int = 6,
    pre: tuple[int, int] = (-6, -1),
    post: tuple[int, int] = (0, 12),
    keys: Sequence[str] = ("community", "metric"),
) -> DataFrame:
    """Months around each event and around a placebo date some months earlier."""
    variants = [("actual", 0), ("placebo", placebo_shift)]
    array = F.array(*[
        F.struct(F.lit(event).alias("event"), F.lit(month).alias("month"), F.lit(v).alias("variant"), F.lit(s).alias("shift"))
        for event, month in anchors
        for v, s in variants
    ])
    anchored = diffs.withColumn("_a", F.explode(array))
    anchor = timeparts.month_index(F.col("_a.month")) - F.col("_a.shift")
    placed = anchored.withColumn("offset", timeparts.month_index(F.col("month")) - anchor).where(
        F.col("offset").between(pre[0], post[1])
    )
    return placed.select(
        *keys,
        "month",
        F.col("_a.event").alias("event"),
        F.col("_a.variant").alias("event_variant"),
        timeparts.month_from_index(anchor).alias("anchor_month"),
        "offset",
        "focal_value",
        "diff_focal_minus_median",
    )


def group_month_validity(
    group_month: DataFrame, metrics: Sequence[str], group: str = "label", core: object = 0,
    core_minimum: int = 5, minimum: int = 20, focal: Column | None = None,
) -> DataFrame:
    """Which group-months have enough members, and which metrics they lack.

    Cores of the focal platform need fewer members than other groups.
    """
    is_core = F.col(group) == F.lit(core)
    if focal is not None:
        is_core = is_core & focal
    threshold = F.when(is_core, F.lit(core_minimum)).otherwise(F.lit(minimum))
    missing = sum((F.col(m).isNull().cast("int") for m in metrics), F.lit(0))
    valid = F.col("member_count") >= F.col("group_min_member_threshold")
    reasons = F.concat_ws(
        ";",
        F.when(~valid, F.lit("member_count_below_threshold")),
        F.when(F.col("num_metrics_missing") > 0, F.lit("missing_metrics")),
    )
    return (
        group_month.withColumn("group_min_member_threshold", threshold)
        .withColumn("num_metrics_missing", missing)
        .withColumn("metrics_missing_ratio", F.col("num_metrics_missing") / len(metrics))
        .withColumn("valid_member_count", valid)
        .withColumn("validation_reason", reasons)
        .withColumn("min_member_threshold", F.col("group_min_member_threshold"))
    )
