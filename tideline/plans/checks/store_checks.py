"""Checks of stores: bucketed tables, and user-months that grow by files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import rollups
from tideline.plans import shared, standins
from tideline.plans.catalog import ORACLES, check, rounded
from tideline.plans.checks import label_checks, rollup_checks  # noqa: F401  (their SQL)
from tideline.plans.checks.reputation_checks import order_days
from tideline.session import cut_lineage, fresh_folder
from tideline.sources.activity import scan_activity
from tideline.sources.bucketed import bucket_count, write_bucketed
from tideline.sources.user_month_store import UserMonthStore


def bucketed_join(spark, folder):
    """User-months and days of reputation in buckets of user and month; days are summed up and joined where they lie."""
    users = cut_lineage(shared.user_month(spark, folder))
    buckets = bucket_count(users.count())
    months = write_bucketed(users, fresh_folder(spark, "user-months"), buckets)
    days = write_bucketed(order_days(spark, folder), fresh_folder(spark, "days"), buckets)
    return rollups.join_user_month_reputation(months, rollups.reputation_user_month(days))


@check("join_user_month_bucketed", ORACLES["join_user_month_reputation"])
def join_user_month_bucketed(spark, folder):
    keys = ["platform", "community", "user_id", "month", "activity_count", "mean_toxicity"]
    return rounded(bucketed_join(spark, folder).select(*keys, "mean_reputation", "active_days"))


def grown_store(spark, folder):
    """Orders in files that arrive in two lots; the first lot is offered again with the second, and both once more."""
    place = fresh_folder(spark, "activity")
    store = UserMonthStore(spark, fresh_folder(spark, "store"), scan_activity, standins.SCORES)
    raw = standins.raw_activity(spark, folder)
    for lot in (0, 1):
        part = raw.where(F.pmod(F.xxhash64("post_id"), F.lit(2)) == lot)
        part.repartition(4).write.mode("append").parquet(place)
        store.append(place)
    store.append(place)
    return store


@check("user_month_appended", ORACLES["user_month_metrics"])
def user_month_appended(spark, folder):
    return rounded(grown_store(spark, folder).user_months())


@check("first_seen_appended", ORACLES["first_seen"])
def first_seen_appended(spark, folder):
    seen = grown_store(spark, folder).first_seen()
    return seen.select(
        "user_id", F.date_format("first_seen", "yyyy-MM-dd").alias("first_day"), F.date_format("first_seen", "yyyy-MM").alias("first_month")
    )
