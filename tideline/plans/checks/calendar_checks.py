"""Checks of calendars that are tables: a community's events are its dearest orders of each half year."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import calendars
from tideline.plans import standins
from tideline.plans.catalog import check, rounded
from tideline.plans.standins import VIEW_SQL, with_views

VIEW_SQL["calendar"] = ((), """
    SELECT o_orderpriority AS community, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y') || CASE WHEN month(o_orderdate) > 6 THEN 'b' ELSE 'a' END AS event,
      arg_max(CAST(o_orderdate AS TIMESTAMP), (o_totalprice, o_orderkey)) AS day FROM orders GROUP BY ALL""")
VIEW_SQL["steps"] = (("calendar",), """
    SELECT community, event, day AS s, lead(event) OVER w AS next_event, lead(day) OVER w AS e FROM calendar WINDOW w AS (PARTITION BY community ORDER BY day, event)""")
VIEW_SQL["first_by_community"] = (("activity",), """
    SELECT community, user_id, min(ts) AS first_seen FROM activity GROUP BY ALL""")


def calendar(spark, folder):
    orders = standins.table(spark, folder, "orders")
    half = F.concat(F.date_format("o_orderdate", "yyyy"), F.when(F.month("o_orderdate") > 6, "b").otherwise("a"))
    return orders.groupBy(F.col("o_orderpriority").alias("community"), half.alias("event")).agg(
        F.max_by("o_orderdate", F.struct("o_totalprice", "o_orderkey")).alias("day")
    )


def first_by_community(spark, folder):
    return standins.activity(spark, folder).groupBy("community", "user_id").agg(F.min("ts").alias("first_seen"))


@check("event_period_by_calendar", with_views("activity", "steps", body="""
    SELECT a.community, event || '-' || next_event AS period, count(*) AS n_activities, count(DISTINCT user_id) AS n_users,
      round(avg(toxicity_toxigen),6) AS toxicity_mean
    FROM activity a JOIN steps p ON p.community=a.community AND a.ts >= p.s AND a.ts < p.e GROUP BY ALL"""))
def event_period_by_calendar(spark, folder):
    placed = calendars.with_calendar_step(standins.activity(spark, folder), calendar(spark, folder), ["community"])
    period = calendars.event_period_name(F.col("event"), F.col("next_event"))
    return rounded(
        placed.withColumn("period", period)
        .where(F.col("period").isNotNull())
        .groupBy("community", "period")
        .agg(
            F.count("*").alias("n_activities"),
            F.count_distinct("user_id").alias("n_users"),
            F.avg("toxicity_toxigen").alias("toxicity_mean"),
        )
    )


@check("arrival_cohort_by_calendar", with_views("first_by_community", "steps", body="""
    , edge AS (SELECT community, min(s) AS lo, max(s) AS hi, arg_min(event, (s, event)) AS first_event, arg_max(event, (s, event)) AS last_event FROM steps GROUP BY ALL)
    SELECT f.community, f.user_id, CASE WHEN first_seen < lo THEN 'before' || first_event WHEN first_seen >= hi THEN 'after' || last_event
        ELSE 'between' || event || '-' || next_event END AS arrival_cohort,
      CASE WHEN first_seen < lo THEN 'pre_' || first_event WHEN first_seen >= hi THEN last_event ELSE event || '_' || next_event END AS fixed_cohort
    FROM first_by_community f JOIN edge USING (community) LEFT JOIN steps p ON p.community=f.community AND first_seen >= p.s AND first_seen < p.e"""))
def arrival_cohort_by_calendar(spark, folder):
    placed = calendars.with_calendar_step(
        first_by_community(spark, folder), calendar(spark, folder), ["community"], "first_seen"
    )
    ends = F.col("event"), F.col("next_event")
    return placed.select(
        "community",
        "user_id",
        calendars.arrival_cohort_name(*ends).alias("arrival_cohort"),
        calendars.fixed_cohort_name(*ends).alias("fixed_cohort"),
    )


@check("event_cohort_by_calendar", with_views("first_by_community", "steps", body="""
    SELECT f.community, event, CASE WHEN first_seen < s THEN 'existing' ELSE 'event_arrival' END AS cohort_group, count(*) AS n_users
    FROM first_by_community f JOIN steps p ON p.community=f.community AND (p.e IS NULL OR first_seen < p.e) GROUP BY ALL"""))
def event_cohort_by_calendar(spark, folder):
    found = calendars.event_cohorts(first_by_community(spark, folder), calendar(spark, folder), ["community"])
    return found.groupBy("community", "event", "cohort_group").agg(F.count("*").alias("n_users"))
