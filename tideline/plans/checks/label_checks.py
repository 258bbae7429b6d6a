"""Checks of scalar functions and labels over the activity log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import labels, timeparts
from tideline.functions.calendar import newcomer_days
from tideline.operators import cohorts
from tideline.plans import standins
from tideline.plans.catalog import check, rounded
from tideline.plans.standins import ORDER_CALENDAR, VIEW_SQL, with_views

DAYS = newcomer_days(ORDER_CALENDAR)

VIEW_SQL["first_seen"] = (("activity",), """
    SELECT user_id, min(ts) AS first_seen, strftime(min(ts), '%Y-%m') AS first_month FROM activity GROUP BY user_id""")
VIEW_SQL["first_seen_community"] = (("activity",), """
    SELECT community, user_id, min(ts) AS first_seen, strftime(min(ts), '%Y-%m') AS first_month
    FROM activity GROUP BY community, user_id""")

PERIOD_SQL = """CASE WHEN {ts} >= TIMESTAMP '1996-04-10' AND {ts} < TIMESTAMP '1997-08-23' THEN 'A-B'
    WHEN {ts} >= TIMESTAMP '1997-08-23' AND {ts} < TIMESTAMP '1999-03-12' THEN 'B-C'
    WHEN {ts} >= TIMESTAMP '1999-03-12' AND {ts} < TIMESTAMP '2000-07-29' THEN 'C-D'
    WHEN {ts} >= TIMESTAMP '2000-07-29' AND {ts} < TIMESTAMP '2001-08-01' THEN 'D-end' END"""
ARRIVAL_SQL = """CASE WHEN {ts} < TIMESTAMP '1996-04-10' THEN 'beforeA' WHEN {ts} < TIMESTAMP '1997-08-23' THEN 'betweenA-B'
    WHEN {ts} < TIMESTAMP '1999-03-12' THEN 'betweenB-C' WHEN {ts} < TIMESTAMP '2000-07-29' THEN 'betweenC-D'
    ELSE 'afterD' END"""
FIXED_SQL = """CASE WHEN {ts} IS NULL THEN 'unknown' WHEN {ts} < TIMESTAMP '1996-04-10' THEN 'pre_fph'
    WHEN {ts} < TIMESTAMP '1997-08-23' THEN 'fph_pg' WHEN {ts} < TIMESTAMP '1999-03-12' THEN 'pg_ga'
    WHEN {ts} < TIMESTAMP '2000-07-29' THEN 'ga_td' ELSE 'td_shutdown' END"""
NEWCOMER_SQL = """CASE WHEN {month} < TIMESTAMP '1996-04-10' THEN 'existing'
    WHEN {month} < TIMESTAMP '1999-03-12' THEN CASE WHEN {seen} >= TIMESTAMP '1996-04-10' THEN 'newcomer' ELSE 'existing' END
    WHEN {month} < TIMESTAMP '2000-07-29' THEN CASE WHEN {seen} >= TIMESTAMP '1999-03-12' THEN 'newcomer' ELSE 'existing' END
    ELSE CASE WHEN {seen} >= TIMESTAMP '2000-07-29' THEN 'newcomer' ELSE 'existing' END END"""
BIN_SQL = """CASE WHEN {n} = 1 THEN '1' WHEN {n} = 2 THEN '2' WHEN {n} BETWEEN 3 AND 5 THEN '3-5'
    WHEN {n} BETWEEN 6 AND 10 THEN '6-10' WHEN {n} BETWEEN 11 AND 20 THEN '11-20' WHEN {n} >= 21 THEN '21+' ELSE '0' END"""
GROUP_SQL = """CASE WHEN {ts} < TIMESTAMP '1996-04-10' THEN 'preA' WHEN {ts} < TIMESTAMP '1999-03-12' THEN 'A-B'
    WHEN {ts} < TIMESTAMP '2000-07-29' THEN 'B-C' ELSE 'C-End' END"""


@check("epoch_to_ts", with_views("activity", body="""
    SELECT post_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_seconds,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_milliseconds, CAST(NULL AS VARCHAR) AS from_text FROM activity"""))
def epoch_to_ts(spark, folder):
    raw = standins.raw_activity(spark, folder)

    def shown(value):
        return F.date_format(timeparts.epoch_to_ts(value), "yyyy-MM-dd HH:mm:ss")

    return raw.select(
        "post_id",
        shown(F.col("publish_date")).alias("from_seconds"),
        shown(F.col("publish_date") * 1000).alias("from_milliseconds"),
        shown(F.concat(F.lit("bad"), F.col("post_id"))).alias("from_text"),
    )


@check("detect_epoch_unit", with_views("activity", body="""
    SELECT community, platform, median(CASE WHEN platform='focal' THEN publish_date*1000 ELSE publish_date END) > 1e11
      AS is_milliseconds FROM activity GROUP BY ALL"""))
def detect_epoch_unit(spark, folder):
    from tideline.sources.activity import detect_epoch_unit

    raw = standins.raw_activity(spark, folder)
    mixed = raw.withColumn(
        "publish_date",
        F.when(F.col("platform") == "focal", F.col("publish_date") * 1000).otherwise(F.col("publish_date")),
    )
    return detect_epoch_unit(mixed, ["community", "platform"])


@check("month_key", with_views("activity", body="SELECT post_id, month FROM activity"))
def month_key(spark, folder):
    return standins.activity(spark, folder).select("post_id", "month")


@check("month_from_epoch", with_views("activity", body="SELECT user_id, month, count(*) AS n FROM activity GROUP BY ALL"))
def month_from_epoch(spark, folder):
    month = timeparts.month_key(timeparts.epoch_to_ts(F.col("publish_date") * 1000))
    return standins.raw_activity(spark, folder).groupBy("user_id", month.alias("month")).agg(F.count("*").alias("n"))


@check("month_distance", with_views("activity", "first_seen", body="""
    SELECT post_id, CAST(datediff('month', first_seen, ts) AS INTEGER) AS since_first,
      CAST(abs(datediff('month', TIMESTAMP '1999-03-12', ts)) AS INTEGER) AS from_event,
      strftime(ts - INTERVAL 5 MONTH, '%Y-%m') AS five_months_before
    FROM (SELECT post_id, user_id, date_trunc('month', ts) AS ts FROM activity) JOIN first_seen USING (user_id)"""))
def month_distance(spark, folder):
    activity = standins.activity(spark, folder)
    joined = activity.join(cohorts.first_seen(activity), "user_id")
    return joined.select(
        "post_id",
        timeparts.month_distance(F.col("first_month"), F.col("month")).alias("since_first"),
        timeparts.absolute_month_distance(F.col("month"), F.lit("1999-03")).alias("from_event"),
        timeparts.month_from_index(timeparts.month_index(F.col("month")) - 5).alias("five_months_before"),
    )


@check("first_seen", with_views("first_seen", body="""
    SELECT user_id, strftime(first_seen, '%Y-%m-%d') AS first_day, first_month FROM first_seen"""))
def first_seen(spark, folder):
    seen = cohorts.first_seen(standins.activity(spark, folder))
    return seen.select("user_id", F.date_format("first_seen", "yyyy-MM-dd").alias("first_day"), "first_month")


@check("assign_period_group", with_views("first_seen_community", body="""
    SELECT community, user_id, first_month, CASE WHEN m < TIMESTAMP '1996-04-10' THEN 'existing' ELSE 'newcomer' END AS label,
      """ + GROUP_SQL.format(ts="m") + """ AS period_group
    FROM (SELECT *, CAST(first_month || '-01' AS TIMESTAMP) AS m FROM first_seen_community)"""))
def assign_period_group(spark, folder):
    first = cohorts.first_seen(standins.activity(spark, folder), ["community", "user_id"])
    return cohorts.newcomer_labels(first, DAYS).drop("first_seen")


@check("newcomer_label", with_views("activity", "first_seen", body="""
    SELECT DISTINCT user_id, month, """ + NEWCOMER_SQL.format(month="m", seen="f") + """ AS label,
      """ + NEWCOMER_SQL.format(month="m", seen="CAST(NULL AS TIMESTAMP)") + """ AS label_if_unseen
    FROM (SELECT user_id, month, CAST(month || '-01' AS TIMESTAMP) AS m, CAST(first_month || '-01' AS TIMESTAMP) AS f
      FROM activity JOIN first_seen USING (user_id))"""))
def newcomer_label(spark, folder):
    activity = standins.activity(spark, folder)
    month_ts = timeparts.month_start(F.col("month"))
    joined = activity.select("user_id", "month").distinct().join(cohorts.first_seen(activity), "user_id")
    return joined.select(
        "user_id",
        "month",
        labels.newcomer_label(timeparts.month_start(F.col("first_month")), month_ts, DAYS).alias("label"),
        labels.newcomer_label(F.lit(None).cast("timestamp"), month_ts, DAYS).alias("label_if_unseen"),
    )


@check("rolling_tenure_label", with_views("activity", "first_seen", body="""
    SELECT DISTINCT user_id, month, CASE WHEN f >= m - INTERVAL 6 MONTH THEN 'newcomer' ELSE 'existing' END AS label
    FROM (SELECT user_id, month, CAST(month || '-01' AS TIMESTAMP) AS m, CAST(first_month || '-01' AS TIMESTAMP) AS f
      FROM activity JOIN first_seen USING (user_id))"""))
def rolling_tenure_label(spark, folder):
    activity = standins.activity(spark, folder)
    joined = activity.select("user_id", "month").distinct().join(cohorts.first_seen(activity), "user_id")
    first = timeparts.month_start(F.col("first_month"))
    label = labels.rolling_tenure_label(first, timeparts.month_start(F.col("month")), 6)
    return joined.select("user_id", "month", label.alias("label"))


@check("fixed_cohort", with_views("first_seen", body="""
    SELECT user_id, """ + FIXED_SQL.format(ts="first_seen") + """ AS fixed_cohort FROM first_seen"""))
def fixed_cohort(spark, folder):
    seen = cohorts.first_seen(standins.activity(spark, folder))
    return seen.select("user_id", ORDER_CALENDAR.fixed_cohort(F.col("first_seen")).alias("fixed_cohort"))


@check("arrival_cohort", with_views("first_seen", body="""
    SELECT user_id, """ + ARRIVAL_SQL.format(ts="date_trunc('day', first_seen)") + """ AS cohort FROM first_seen"""))
def arrival_cohort(spark, folder):
    seen = cohorts.first_seen(standins.activity(spark, folder))
    return seen.select("user_id", ORDER_CALENDAR.arrival_cohort(F.date_trunc("day", "first_seen")).alias("cohort"))


@check("event_cohort", with_views("first_seen", body="""
    , ev AS (SELECT * FROM (VALUES ('A', TIMESTAMP '1996-04-10', TIMESTAMP '1997-08-23'), ('B', TIMESTAMP '1997-08-23', TIMESTAMP '1999-03-12'),
      ('C', TIMESTAMP '1999-03-12', TIMESTAMP '2000-07-29'), ('D', TIMESTAMP '2000-07-29', NULL)) t(event, s, e))
    SELECT user_id, event, CASE WHEN first_seen < s THEN 'existing' WHEN e IS NULL OR first_seen < e THEN 'event_arrival'
      ELSE 'future_arrival' END AS cohort_group FROM first_seen, ev"""))
def event_cohort(spark, folder):
    seen = cohorts.first_seen(standins.activity(spark, folder))
    each = seen.withColumn("e", F.explode(ORDER_CALENDAR.as_array()))
    group = labels.event_cohort(F.col("first_seen"), F.col("e.event_ts"), F.col("e.next_ts"))
    return each.select("user_id", F.col("e.event").alias("event"), group.alias("cohort_group"))


@check("assign_event_period", with_views("activity", body="""
    SELECT post_id, by_time, by_month FROM (SELECT post_id, """ + PERIOD_SQL.format(ts="ts") + """ AS by_time,
      """ + PERIOD_SQL.format(ts="CAST(month || '-01' AS TIMESTAMP)") + """ AS by_month FROM activity)
    WHERE by_time IS NOT NULL OR by_month IS NOT NULL"""))
def assign_event_period(spark, folder):
    activity = standins.activity(spark, folder)
    return activity.select(
        "post_id",
        ORDER_CALENDAR.event_period(F.col("ts")).alias("by_time"),
        ORDER_CALENDAR.event_period_of_month(F.col("month")).alias("by_month"),
    ).where(F.col("by_time").isNotNull() | F.col("by_month").isNotNull())


@check("relative_week", with_views("activity", body="""
    SELECT post_id, CAST(floor(datediff('day', TIMESTAMP '1999-03-12', ts)/7.0) AS INTEGER) AS relative_week FROM activity
    WHERE floor(datediff('day', TIMESTAMP '1999-03-12', ts)/7.0) BETWEEN -4 AND 4"""))
def relative_week(spark, folder):
    week = timeparts.relative_week(F.col("ts"), F.lit("1999-03-12").cast("timestamp"))
    activity = standins.activity(spark, folder)
    return activity.select("post_id", week.alias("relative_week")).where(F.col("relative_week").between(-4, 4))


@check("activity_bin", with_views("activity", body="""
    SELECT user_id, n, """ + BIN_SQL.format(n="n") + """ AS activity_bin, """ + BIN_SQL.format(n="n-1") + """ AS bin_of_one_less
    FROM (SELECT user_id, count(*) AS n FROM activity GROUP BY user_id)"""))
def activity_bin(spark, folder):
    counts = standins.activity(spark, folder).groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.select(
        "user_id",
        "n",
        labels.activity_bin(F.col("n")).alias("activity_bin"),
        labels.activity_bin(F.col("n") - 1).alias("bin_of_one_less"),
    )


@check("registration_group", """
    SELECT c_custkey, CASE WHEN r < 1399593600 THEN 1 WHEN r < 1433558400 THEN 2 WHEN r < 1479840000 THEN 3
      WHEN r < 1521081600 THEN 4 ELSE 5 END AS registration_group
    FROM (SELECT c_custkey, 1380000000 + (c_custkey * 104729) % 180000000 AS r FROM customer)""")
def registration_group(spark, folder):
    registered = 1380000000 + (F.col("c_custkey") * 104729) % 180000000
    customers = standins.table(spark, folder, "customer")
    return customers.select("c_custkey", labels.registration_group(registered).alias("registration_group"))


@check("community_type", with_views("activity", body="""
    SELECT post_id, CASE WHEN community IN ('1-URGENT','2-HIGH') THEN 'controversial'
      WHEN community IN ('3-MEDIUM','5-LOW') THEN 'normal' ELSE 'unknown' END AS community_type FROM activity"""))
def community_type(spark, folder):
    kind = labels.community_type(F.col("community"), ["1-URGENT", "2-HIGH"], ["3-MEDIUM", "5-LOW"])
    return standins.activity(spark, folder).select("post_id", kind.alias("community_type"))


@check("day_offset_to_date", """
    SELECT event_id, CAST(CAST(make_timestamp(1704067200000000 + CAST(event_id % 400 AS BIGINT) * 86400000000) AS DATE) AS VARCHAR) AS day
    FROM events""")
def day_offset_to_date(spark, folder):
    events = standins.table(spark, folder, "events")
    day = timeparts.day_offset_to_date(F.lit(1704067200), F.col("event_id") % 400)
    return events.select("event_id", day.cast("string").alias("day"))


@check("effect_size_label", """
    SELECT o_orderkey, CASE WHEN abs(d) < 0.147 THEN 'negligible' WHEN abs(d) < 0.33 THEN 'small'
      WHEN abs(d) < 0.474 THEN 'medium' ELSE 'large' END AS size
    FROM (SELECT o_orderkey, ((o_orderkey * 31) % 1994 - 997)/997.0 AS d FROM orders)""")
def effect_size_label(spark, folder):
    delta = ((F.col("o_orderkey") * 31) % 1994 - 997) / 997.0
    return standins.table(spark, folder, "orders").select("o_orderkey", labels.effect_size_label(delta).alias("size"))
