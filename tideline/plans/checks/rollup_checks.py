"""Checks of user-month and community-month rollups and of the tables joined from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import timeparts
from tideline.operators import rollups
from tideline.plans import shared, standins
from tideline.plans.catalog import check, rounded
from tideline.plans.standins import ORDER_CALENDAR, with_views

PLATFORMS = ["focal", "reference"]

@check("user_month_metrics", with_views("user_month", body="""
    SELECT platform, community, user_id, month, round(mean_toxicity,6) AS mean_toxicity,
      round(mean_vader,6) AS mean_vader, round(mean_textblob,6) AS mean_textblob,
      round(mean_subjectivity,6) AS mean_subjectivity, activity_count FROM user_month"""))
def user_month_metrics(spark, folder):
    return rounded(shared.user_month(spark, folder))


@check("community_month_basic", with_views("community_month", body="""
    SELECT platform, community, month, active_users, total_activity,
      round(toxicity_mean,6) AS toxicity_mean, round(toxicity_std,6) AS toxicity_std,
      round(vader_mean,6) AS vader_mean, round(vader_std,6) AS vader_std,
      round(textblob_mean,6) AS textblob_mean, round(textblob_std,6) AS textblob_std,
      round(subjectivity_mean,6) AS subjectivity_mean, round(subjectivity_std,6) AS subjectivity_std,
      CAST(NULL AS DOUBLE) AS reputation_mean, CAST(NULL AS DOUBLE) AS reputation_std
    FROM community_month"""))
def community_month_basic(spark, folder):
    return rounded(shared.community_month(spark, folder))


@check("q90_toxicity", with_views("user_month", body="""
    , q AS (SELECT platform, community, month, quantile_cont(mean_toxicity, 0.9) AS q FROM user_month GROUP BY ALL)
    SELECT month, round(avg(q) FILTER (platform='focal'),6) AS toxicity_q90_focal,
      round(avg(q) FILTER (platform='reference'),6) AS toxicity_q90_reference
    FROM q GROUP BY month"""))
def q90_toxicity(spark, folder):
    return rounded(
        rollups.group_quantile_by_platform(
            shared.user_month(spark, folder), "mean_toxicity", 0.9, PLATFORMS, "toxicity_q90"
        )
    )


@check("weighted_global_average", with_views("community_month", body="""
    SELECT platform, month, CAST(sum(active_users) AS BIGINT) AS total_active_users,
      round(sum(toxicity_mean*active_users)/sum(active_users),6) AS toxicity_mean,
      round(sum(CASE WHEN vader_std IS NOT NULL THEN vader_std*total_activity END)
        / nullif(sum(CASE WHEN vader_std IS NOT NULL THEN total_activity END),0),6) AS vader_std
    FROM community_month GROUP BY ALL"""))
def weighted_global_average(spark, folder):
    weights = {"toxicity_mean": "active_users", "vader_std": "total_activity"}
    return rounded(
        rollups.weighted_global_average(
            shared.community_month(spark, folder), weights, "active_users", ["platform", "month"]
        )
    )


@check("weighted_reference_toxicity", with_views("community_month", body="""
    SELECT month, round(sum(toxicity_mean*active_users)/sum(active_users),6) AS toxicity_mean,
      CAST(sum(active_users) AS BIGINT) AS total_active_users
    FROM community_month WHERE platform='reference' GROUP BY month"""))
def weighted_reference_toxicity(spark, folder):
    reference = shared.community_month(spark, folder).where(F.col("platform") == "reference")
    return rounded(rollups.weighted_global_average(reference, {"toxicity_mean": "active_users"}, "active_users"))


@check("global_unweighted_mean", with_views("community_month", body="""
    SELECT platform, month, round(avg(toxicity_mean),6) AS toxicity_mean, round(avg(vader_mean),6) AS vader_mean,
      round(avg(textblob_mean),6) AS textblob_mean FROM community_month GROUP BY ALL"""))
def global_unweighted_mean(spark, folder):
    return rounded(
        rollups.global_unweighted_mean(
            shared.community_month(spark, folder),
            ["toxicity_mean", "vader_mean", "textblob_mean"],
            ["platform", "month"],
        )
    )


@check("metric_summary", with_views("community_month_full", body="""
    , long AS (UNPIVOT (SELECT CAST(COLUMNS(* EXCLUDE (platform, community, month)) AS DOUBLE)
        FROM community_month_full) ON COLUMNS(*) INTO NAME metric VALUE v)
    SELECT metric, round(avg(v),6) AS mean, round(median(v),6) AS median FROM long GROUP BY metric"""))
def metric_summary(spark, folder):
    """Every numeric column of the monthly table."""
    from tideline.plans.checks.reputation_checks import user_month_with_reputation

    monthly = rollups.community_month_aggregates(user_month_with_reputation(spark, folder))
    numeric = [name for name, kind in monthly.dtypes if kind != "string"]
    return rounded(rollups.metric_summary(monthly, numeric))


@check("pivot_platform", with_views("community_month", body="""
    SELECT community, month, round(max(toxicity_mean) FILTER (platform='focal'),6) AS toxicity_mean_focal,
      round(max(toxicity_mean) FILTER (platform='reference'),6) AS toxicity_mean_reference,
      max(active_users) FILTER (platform='focal') AS active_users_focal,
      max(active_users) FILTER (platform='reference') AS active_users_reference
    FROM community_month GROUP BY community, month"""))
def pivot_platform(spark, folder):
    return rounded(
        rollups.pivot_platform(
            shared.community_month(spark, folder), ["toxicity_mean", "active_users"], PLATFORMS
        )
    )


@check("rolling_mean_centered", with_views("community_month", body="""
    SELECT platform, community, month,
      round(avg(toxicity_mean) OVER w,6) AS toxicity_mean_roll, round(avg(vader_mean) OVER w,6) AS vader_mean_roll
    FROM community_month
    WINDOW w AS (PARTITION BY platform, community ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""))
def rolling_mean_centered(spark, folder):
    rolled = rollups.rolling_mean_centered(
        shared.community_month(spark, folder), ["platform", "community"], ["toxicity_mean", "vader_mean"]
    )
    return rounded(rolled.select("platform", "community", "month", "toxicity_mean_roll", "vader_mean_roll"))


@check("event_period_diff", with_views("community_month", body="""
    , p AS (SELECT *, CAST(month || '-01' AS TIMESTAMP) AS m FROM community_month),
    q AS (SELECT *, CASE WHEN m >= TIMESTAMP '1996-04-10' AND m < TIMESTAMP '1997-08-23' THEN 'A-B'
        WHEN m >= TIMESTAMP '1997-08-23' AND m < TIMESTAMP '1999-03-12' THEN 'B-C'
        WHEN m >= TIMESTAMP '1999-03-12' AND m < TIMESTAMP '2000-07-29' THEN 'C-D'
        WHEN m >= TIMESTAMP '2000-07-29' AND m < TIMESTAMP '2001-08-01' THEN 'D-end' END AS period FROM p)
    SELECT community, period, round(avg(toxicity_mean) FILTER (platform='focal'),6) AS toxicity_mean_focal,
      round(avg(toxicity_mean) FILTER (platform='reference'),6) AS toxicity_mean_reference,
      round(avg(toxicity_mean) FILTER (platform='focal') - avg(toxicity_mean) FILTER (platform='reference'),6) AS difference
    FROM q WHERE period IS NOT NULL GROUP BY community, period"""))
def event_period_diff(spark, folder):
    return rounded(
        rollups.period_difference(
            shared.community_month(spark, folder),
            "toxicity_mean",
            ORDER_CALENDAR.event_period_of_month(F.col("month")),
            "focal",
            "reference",
        )
    )


@check("union_by_name", with_views("community_month", body="""
    SELECT platform, community, month, round(toxicity_mean,6) AS toxicity_mean,
      CASE WHEN platform='focal' THEN active_users END AS active_users FROM community_month"""))
def union_by_name(spark, folder):
    monthly = shared.community_month(spark, folder)
    keys = ["platform", "community", "month", "toxicity_mean"]
    focal = monthly.where(F.col("platform") == "focal").select(*keys, "active_users")
    reference = monthly.where(F.col("platform") == "reference").select(*keys)
    return rounded(rollups.union_by_name([focal, reference]))


@check("filter_month_range", with_views("community_month", body="""
    SELECT platform, community, month, active_users FROM community_month
    WHERE month >= '1996-02' AND month <= '1999-11'"""))
def filter_month_range(spark, folder):
    return (
        shared.community_month(spark, folder)
        .where(timeparts.in_month_range(F.col("month"), "1996-02", "1999-11"))
        .select("platform", "community", "month", "active_users")
    )
