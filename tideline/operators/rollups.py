"""User-month and community-month rollups, and the tables joined from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.stats import ratio
from tideline.operators.ranking import exact_quantiles
from tideline.session import cut_lineage

SCOPE = ("platform", "community")

# User-month columns and the stems of their aggregates.
METRIC_STEMS = {
    "mean_toxicity": "toxicity",
    "mean_vader": "vader",
    "mean_textblob": "textblob",
    "mean_subjectivity": "subjectivity",
    "mean_reputation": "reputation",
}

# The columns a network snapshot adds to a community-month.
NETWORK_COLUMNS = (
    "n_nodes",
    "n_edges",
    "mean_degree",
    "median_degree",
    "std_degree",
    "degree_heterogeneity",
    "mean_clustering",
    "er_expected_clustering",
    "normalized_clustering",
    "avg_shortest_path",
    "diameter",
    "giant_component_size",
    "giant_component_fraction",
    "density",
    "degree_assortativity",
)


def unpivoted(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``keys, metric, value`` with one row per key and column."""
    doubles = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(keys), list(columns), "metric", "value")


def user_month_metrics(
    activity: DataFrame, scores: Mapping[str, str], scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Mean scores and number of activities per user and month."""
    return activity.groupBy(*scope, "user_id", "month").agg(
        *[F.avg(source).alias(name) for name, source in scores.items()],
        F.count("*").alias("activity_count"),
    )


def reputation_user_month(daily: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Mean reputation and number of days of a user and month, over days with reputation 1 or more."""
    return (
        daily.where(F.col("reputation") >= 1)
        .groupBy(*scope, "user_id", "month")
        .agg(F.avg("reputation").alias("mean_reputation"), F.count("*").alias("active_days"))
    )


def join_user_month_reputation(
    user_month: DataFrame, reputation: DataFrame | None, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Attach reputation; without it ``mean_reputation`` is null and ``active_days`` 0."""
    if reputation is None:
        return user_month.withColumn("mean_reputation", F.lit(None).cast("double")).withColumn(
            "active_days", F.lit(0).cast("bigint")
        )
    joined = user_month.join(reputation, [*scope, "user_id", "month"], "left")
    return joined.withColumn("active_days", F.coalesce("active_days", F.lit(0).cast("bigint")))


def with_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with each absent column added as null."""
    for name in columns:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    return df


def community_month_basic(user_month: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Counts, means and standard deviations per community and month.

    A user-month table holds a user once per month, so counting its rows counts users.
    """
    user_month = with_missing(user_month, ["mean_reputation"])
    return user_month.groupBy(*scope, "month").agg(*_basic_aggregates())


def _basic_aggregates() -> list[Column]:
    aggs = [F.count("user_id").alias("active_users"), F.sum("activity_count").alias("total_activity")]
    for column, stem in METRIC_STEMS.items():
        aggs += [F.avg(column).alias(f"{stem}_mean"), F.stddev_samp(column).alias(f"{stem}_std")]
    return aggs


def community_month_aggregates(user_month: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """:func:`community_month_basic` with reputable users and exact medians.

    Medians of all metrics come from one pass over bins, since a community-month may hold far more
    users than one task can sort. The user-months are read three times, so they are written down.
    """
    user_month = cut_lineage(with_missing(user_month, ["mean_reputation"]))
    keys = [*scope, "month"]
    basic = user_month.groupBy(*keys).agg(
        *_basic_aggregates(), F.count_if(F.col("mean_reputation") > 1).alias("rep_active_users")
    )
    medians = exact_quantiles(
        unpivoted(user_month, keys, list(METRIC_STEMS)), [*keys, "metric"], "value", {"median": 0.5}
    )
    wide = medians.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("metric") == column, F.col("median"))).alias(f"{stem}_median")
            for column, stem in METRIC_STEMS.items()
        ]
    )
    order = [*keys, "active_users", "total_activity", "rep_active_users"]
    order += [f"{stem}_{part}" for stem in METRIC_STEMS.values() for part in ("mean", "median", "std")]
    return basic.join(wide, keys, "left").select(*order)


def join_network_metrics(
    community_month: DataFrame, network: DataFrame | None, keys: Sequence[str] = ("community", "month")
) -> DataFrame:
    """Attach snapshot metrics; normalised clustering is derived where absent."""
    if network is None:
        return with_missing(community_month, NETWORK_COLUMNS)
    if "normalized_clustering" not in network.columns and "mean_clustering" in network.columns:
        network = network.withColumn(
            "normalized_clustering", ratio(F.col("mean_clustering"), F.col("er_expected_clustering"))
        )
    return with_missing(community_month.join(network, list(keys), "left"), NETWORK_COLUMNS)


def group_quantile_by_platform(
    user_month: DataFrame, metric: str, prob: float, platforms: Sequence[str], name: str
) -> DataFrame:
    """Quantile per community-month, averaged over communities, one column per platform."""
    quantiles = exact_quantiles(user_month, ["platform", "community", "month"], metric, {"q": prob})
    return quantiles.groupBy("month").agg(
        *[F.avg(F.when(F.col("platform") == p, F.col("q"))).alias(f"{name}_{p}") for p in platforms]
    )


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: weighted mean over rows that have both; null where the weights sum to 0."""
    both = value.isNotNull() & weight.isNotNull()
    return ratio(F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight)))


def weighted_global_average(
    community_month: DataFrame, weights: Mapping[str, str], total: str, keys: Sequence[str] = ("month",)
) -> DataFrame:
    """Per month, each metric weighted by a column of its own, and the sum of ``total``."""
    return community_month.groupBy(*keys).agg(
        F.sum(total).alias(f"total_{total}"),
        *[weighted_mean(F.col(m), F.col(w)).alias(m) for m, w in weights.items()],
    )


def global_unweighted_mean(
    community_month: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("month",)
) -> DataFrame:
    return community_month.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def metric_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and median of every metric of a monthly table (its rows are months, so few)."""
    return (
        unpivoted(df, [], metrics)
        .groupBy("metric")
        .agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"))
    )


def pivot_platform(
    df: DataFrame, metrics: Sequence[str], platforms: Sequence[str], keys: Sequence[str] = ("community", "month")
) -> DataFrame:
    """One row per key, one column ``<metric>_<platform>`` per metric and platform."""
    return df.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("platform") == p, F.col(m))).alias(f"{m}_{p}")
            for m in metrics
            for p in platforms
        ]
    )


def rolling_mean_centered(
    df: DataFrame, series: Sequence[str], columns: Sequence[str], order: str = "month", width: int = 3
) -> DataFrame:
    """Centred mean over rows of a series, shorter at its ends."""
    reach = width // 2
    window = Window.partitionBy(*series).orderBy(order).rowsBetween(-reach, reach)
    return df.select("*", *[F.avg(c).over(window).alias(f"{c}_roll") for c in columns])


def attach_bootstrap_bands(
    monthly: DataFrame,
    summary: DataFrame,
    metrics: Sequence[str],
    percentiles: Sequence[int] = (5, 50, 95),
    keys: Sequence[str] = ("community", "month"),
) -> DataFrame:
    """Attach the wanted percentiles of resampled metrics as columns ``<metric>_p<percentile>``."""
    bands = summary.groupBy(*keys).agg(
        *[
            F.max(
                F.when((F.col("metric") == m) & (F.col("percentile") == p), F.col("value"))
            ).alias(f"{m}_p{p}")
            for m in metrics
            for p in percentiles
        ]
    )
    return monthly.join(bands, list(keys), "left")


def override_metric(
    df: DataFrame, override: DataFrame, metric: str, source: str, keys: Sequence[str]
) -> DataFrame:
    """Replace a metric where the other table has a value for it."""
    other = override.select(*keys, F.col(source).alias("_override"))
    joined = df.join(other, list(keys), "left")
    return joined.withColumn(metric, F.coalesce("_override", metric)).drop("_override")


def left_join_all(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """``base`` with the columns of every other table of the same keys."""
    for other in others:
        base = base.join(other, list(keys), "left")
    return base


def partition_projection(partition: DataFrame, keys: Sequence[str] = ("community", "month")) -> DataFrame:
    return partition.select(
        *keys,
        F.col("assortativity").alias("partition_assortativity"),
        "ei_index",
        "n_newcomers",
        "n_existing",
    )


def ordered_by_rank(df: DataFrame, column: str, names: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """Rows in the given order of names, names outside it last."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))
    return df.orderBy(F.when(place == 0, len(names) + 1).otherwise(place), *then)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def period_difference(
    community_month: DataFrame, metric: str, period: Column, focal: str, reference: str
) -> DataFrame:
    """Mean of monthly values per community and period on either platform, and focal minus reference."""
    labelled = community_month.withColumn("period", period).where(F.col("period").isNotNull())
    side = {p: F.avg(F.when(F.col("platform") == p, F.col(metric))) for p in (focal, reference)}
    return labelled.groupBy("community", "period").agg(
        side[focal].alias(f"{metric}_{focal}"),
        side[reference].alias(f"{metric}_{reference}"),
        (side[focal] - side[reference]).alias("difference"),
    )
