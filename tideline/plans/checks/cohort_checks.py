"""Checks of cohort, period and event-window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.calendar import newcomer_days
from tideline.operators import cohorts
from tideline.plans import shared, standins
from tideline.plans.catalog import check, rounded
from tideline.plans.checks.label_checks import ARRIVAL_SQL, GROUP_SQL, NEWCOMER_SQL, PERIOD_SQL
from tideline.plans.standins import ORDER_CALENDAR, VIEW_SQL, with_views

DAYS = newcomer_days(ORDER_CALENDAR)
SCORE = "toxicity_toxigen"

EVENTS_SQL = """(VALUES ('A', TIMESTAMP '1996-04-10', TIMESTAMP '1997-08-23'), ('B', TIMESTAMP '1997-08-23', TIMESTAMP '1999-03-12'),
      ('C', TIMESTAMP '1999-03-12', TIMESTAMP '2000-07-29'), ('D', TIMESTAMP '2000-07-29', NULL)) ev(event, s, e)"""

METRICS_SQL = """count(*) AS active_users, CAST(sum(n) AS BIGINT) AS activity_count, avg(m) AS user_mean,
      CASE WHEN count(*) > 1 THEN stddev_samp(m)/sqrt(count(*)) END AS user_se,
      sum(m*n)/sum(n) AS activity_mean,
      CASE WHEN count(*) > 1 THEN sqrt(greatest(sum(n*(m - c)*(m - c))/sum(n), 0)/count(*)) END AS activity_se"""
SHOWN_SQL = """coalesce(active_users,0) AS active_users, coalesce(activity_count,0) AS activity_count,
      round(user_mean,6) AS user_mean, round(user_se,6) AS user_se, round(user_mean-1.96*user_se,6) AS user_ci95_low,
      round(user_mean+1.96*user_se,6) AS user_ci95_high, round(activity_mean,6) AS activity_mean,
      round(activity_se,6) AS activity_se, round(activity_mean-1.96*activity_se,6) AS activity_ci95_low,
      round(activity_mean+1.96*activity_se,6) AS activity_ci95_high"""

VIEW_SQL["labelled_user_month"] = (("user_month", "first_seen_community"), """
    SELECT u.*, CAST(u.month || '-01' AS TIMESTAMP) AS m, CAST(f.first_month || '-01' AS TIMESTAMP) AS f,
      """ + NEWCOMER_SQL.format(month="CAST(u.month || '-01' AS TIMESTAMP)", seen="CAST(f.first_month || '-01' AS TIMESTAMP)") + """ AS label
    FROM user_month u JOIN first_seen_community f USING (community, user_id)""")


def community_first(spark, folder):
    return cohorts.first_seen(standins.activity(spark, folder), ["community", "user_id"])


@check("join_first_seen", with_views("activity", "first_seen", body="""
    SELECT post_id, user_id, first_month FROM activity JOIN first_seen USING (user_id) WHERE toxicity_toxigen > 0.5"""))
def join_first_seen(spark, folder):
    activity = standins.activity(spark, folder)
    scored = activity.where(F.col(SCORE) > 0.5).select("post_id", "user_id")
    return scored.join(cohorts.first_seen(activity).select("user_id", "first_month"), "user_id")


@check("newcomer_behavior_monthly", with_views("labelled_user_month", body="""
    SELECT community, month, round(avg(mean_toxicity) FILTER (label='newcomer'),6) AS mean_toxicity_newcomer,
      round(avg(mean_vader) FILTER (label='newcomer'),6) AS mean_vader_newcomer, count(*) FILTER (label='newcomer') AS n_users_newcomer,
      round(avg(mean_toxicity) FILTER (label='existing'),6) AS mean_toxicity_existing,
      round(avg(mean_vader) FILTER (label='existing'),6) AS mean_vader_existing, count(*) FILTER (label='existing') AS n_users_existing
    FROM labelled_user_month GROUP BY community, month"""))
def newcomer_behavior_monthly(spark, folder):
    return rounded(
        cohorts.behaviour_by_label(
            shared.user_month(spark, folder), community_first(spark, folder), DAYS, ["mean_toxicity", "mean_vader"]
        )
    )


@check("newcomer_behavior_cumulative", with_views("labelled_user_month", body="""
    SELECT community, """ + GROUP_SQL.format(ts="m") + """ AS period, label AS "group", round(avg(mean_toxicity),6) AS mean_toxicity,
      round(avg(mean_vader),6) AS mean_vader, count(*) AS n_user_months
    FROM labelled_user_month WHERE m >= TIMESTAMP '1996-04-10' GROUP BY ALL"""))
def newcomer_behavior_cumulative(spark, folder):
    return rounded(
        cohorts.behaviour_by_period(
            shared.user_month(spark, folder), community_first(spark, folder), DAYS, ["mean_toxicity", "mean_vader"]
        )
    )


@check("active_users_by_status", with_views("labelled_user_month", body="""
    SELECT month, count(*) FILTER (label='newcomer') AS newcomer_active, count(*) FILTER (label='existing') AS existing_active
    FROM labelled_user_month WHERE mean_toxicity*4 > 1 GROUP BY month"""))
def active_users_by_status(spark, folder):
    ranked = shared.user_month(spark, folder).withColumn("mean_reputation", F.col("mean_toxicity") * 4)
    return cohorts.active_users_by_status(ranked, community_first(spark, folder), DAYS)


@check("event_window_slice", with_views("community_month", body="""
    SELECT platform, community, month, event, CASE WHEN m < s THEN 'pre' ELSE 'post' END AS side, round(toxicity_mean,6) AS toxicity_mean
    FROM (SELECT *, CAST(month || '-01' AS TIMESTAMP) AS m FROM community_month), """ + EVENTS_SQL + """
    WHERE m >= s - INTERVAL 3 MONTH AND m <= s + INTERVAL 3 MONTH"""))
def event_window_slice(spark, folder):
    monthly = shared.community_month(spark, folder).select("platform", "community", "month", "toxicity_mean")
    return rounded(cohorts.event_window_slice(monthly, ORDER_CALENDAR))


@check("event_window_jump", with_views("community_month", body="""
    , w AS (SELECT platform, community, event, CASE WHEN m < s THEN 'pre' ELSE 'post' END AS side, toxicity_mean, vader_mean
      FROM (SELECT *, CAST(month || '-01' AS TIMESTAMP) AS m FROM community_month), """ + EVENTS_SQL + """
      WHERE m >= s - INTERVAL 3 MONTH AND m <= s + INTERVAL 3 MONTH),
    l AS (UNPIVOT w ON toxicity_mean, vader_mean INTO NAME metric VALUE v)
    SELECT platform, community, event, metric, round(avg(v) FILTER (side='pre'),6) AS pre_mean,
      round(avg(v) FILTER (side='post'),6) AS post_mean,
      round(avg(v) FILTER (side='post') - avg(v) FILTER (side='pre'),6) AS jump FROM l GROUP BY ALL"""))
def event_window_jump(spark, folder):
    monthly = shared.community_month(spark, folder)
    return rounded(cohorts.event_window_jump(monthly, ORDER_CALENDAR, ["toxicity_mean", "vader_mean"]))


VIEW_SQL["weekly"] = (("activity", "first_seen"), """
    SELECT coalesce(community, 'global') AS community, event, relative_week, cohort_group,
      count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_posts, avg(t/n) AS user_mean, sum(t)/sum(n) AS activity_mean
    FROM (SELECT community, event, relative_week, cohort_group, user_id, sum(toxicity_toxigen) AS t, count(*) AS n
      FROM (SELECT a.community, event, CAST(floor(datediff('day', s, a.ts)/7.0) AS INTEGER) AS relative_week, a.user_id, a.toxicity_toxigen,
          CASE WHEN first_seen < s THEN 'existing' WHEN e IS NULL OR first_seen < e THEN 'event_arrival' ELSE 'future' END AS cohort_group
        FROM activity a JOIN first_seen USING (user_id), """ + EVENTS_SQL + """)
      WHERE relative_week BETWEEN -4 AND 4 AND cohort_group <> 'future'
      GROUP BY GROUPING SETS ((community, event, relative_week, cohort_group, user_id), (event, relative_week, cohort_group, user_id)))
    GROUP BY ALL""")


@check("weekly_event_window", with_views("weekly", body="""
    SELECT community, event, relative_week, cohort_group, n_users, n_posts, round(user_mean,6) AS user_mean,
      round(activity_mean,6) AS activity_mean FROM weekly"""))
def weekly_event_window(spark, folder):
    return rounded(cohorts.weekly_event_window(standins.activity(spark, folder), ORDER_CALENDAR, SCORE))


@check("weekly_prepost_summary", with_views("weekly", body="""
    , g AS (SELECT * FROM weekly WHERE community='global')
    SELECT event, cohort_group,
      round(avg(n_users) FILTER (relative_week<0),6) AS pre_n_users, round(avg(n_users) FILTER (relative_week>=0),6) AS post_n_users,
      round(avg(n_posts) FILTER (relative_week<0),6) AS pre_n_posts, round(avg(n_posts) FILTER (relative_week>=0),6) AS post_n_posts,
      round(avg(user_mean) FILTER (relative_week<0),6) AS pre_user_mean, round(avg(user_mean) FILTER (relative_week>=0),6) AS post_user_mean,
      round(avg(user_mean) FILTER (relative_week>=0) - avg(user_mean) FILTER (relative_week<0),6) AS delta_user_mean,
      round(avg(activity_mean) FILTER (relative_week<0),6) AS pre_activity_mean, round(avg(activity_mean) FILTER (relative_week>=0),6) AS post_activity_mean,
      round(avg(activity_mean) FILTER (relative_week>=0) - avg(activity_mean) FILTER (relative_week<0),6) AS delta_activity_mean
    FROM g GROUP BY event, cohort_group"""))
def weekly_prepost_summary(spark, folder):
    weekly = cohorts.weekly_event_window(standins.activity(spark, folder), ORDER_CALENDAR, SCORE)
    return rounded(cohorts.weekly_prepost_summary(weekly))


VIEW_SQL["cohort_user"] = (("activity", "first_seen_community"), """
    SELECT community, """ + ARRIVAL_SQL.format(ts="date_trunc('day', first_seen)") + """ AS cohort, user_id,
      avg(toxicity_toxigen) AS m, count(*) AS n
    FROM activity JOIN first_seen_community USING (community, user_id) GROUP BY ALL""")


@check("cohort_metrics", with_views("cohort_user", body="""
    , c AS (SELECT community, cohort, sum(m*n)/sum(n) AS c FROM cohort_user GROUP BY ALL),
    g AS (SELECT community, cohort, """ + METRICS_SQL + """ FROM cohort_user JOIN c USING (community, cohort) GROUP BY community, cohort, c)
    SELECT community, cohort, """ + SHOWN_SQL + """ FROM g"""))
def cohort_metrics(spark, folder):
    activity = standins.activity(spark, folder)
    days = cohorts.user_days(activity, SCORE)
    totals = (
        cohorts.with_arrival_cohort(days, activity, ORDER_CALENDAR)
        .groupBy("community", "cohort", "user_id")
        .agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    )
    return rounded(cohorts.cohort_metrics(totals, ["community", "cohort"]))


def _period_sql(key: str, seen: str) -> str:
    """Cohort metrics from the first event on, per ``key``, with all five cohorts."""
    return f"""
    , p AS (SELECT {key}, {ARRIVAL_SQL.format(ts="date_trunc('day', first_seen)")} AS cohort, user_id, date_trunc('day', ts) AS day,
        toxicity_toxigen AS t FROM activity JOIN {seen} USING ({'community, ' if seen.endswith('community') else ''}user_id)
        WHERE date_trunc('day', ts) >= TIMESTAMP '1996-04-10'),
    u AS (SELECT {key}, cohort, user_id, avg(t) AS m, count(*) AS n FROM p GROUP BY ALL),
    c AS (SELECT {key}, cohort, sum(m*n)/sum(n) AS c FROM u GROUP BY ALL),
    g AS (SELECT {key}, cohort, {METRICS_SQL} FROM u JOIN c USING ({key}, cohort) GROUP BY {key}, cohort, c),
    s AS (SELECT {key}, strftime(max(day), '%Y-%m-%d') AS period_end FROM p GROUP BY ALL),
    grid AS (SELECT * FROM s, (VALUES ('beforeA'), ('betweenA-B'), ('betweenB-C'), ('betweenC-D'), ('afterD')) x(cohort))
    SELECT {key}, cohort, period_end, {SHOWN_SQL} FROM grid LEFT JOIN g USING ({key}, cohort)"""


@check("cohort_period_summary", with_views("activity", "first_seen_community", body=_period_sql("community", "first_seen_community")))
def cohort_period_summary(spark, folder):
    return rounded(cohorts.cohort_period_summary(standins.activity(spark, folder), ORDER_CALENDAR, SCORE))


@check("cohort_period_summary_pooled", with_views("activity", "first_seen", body=_period_sql("platform", "first_seen")))
def cohort_period_summary_pooled(spark, folder):
    """All communities of a platform together; cohorts follow the pooled first activity."""
    return rounded(cohorts.cohort_period_summary(standins.activity(spark, folder), ORDER_CALENDAR, SCORE, ["platform"]))


@check("sliding_window_timeseries", with_views("activity", body="""
    , f AS (SELECT community, user_id, """ + ARRIVAL_SQL.format(ts="date_trunc('day', min(ts))") + """ AS cohort FROM activity GROUP BY community, user_id),
    d AS (SELECT community, cohort, user_id, CAST(ts AS DATE) AS day, toxicity_toxigen AS t FROM activity JOIN f USING (community, user_id)),
    span AS (SELECT community, min(day) AS lo, max(day) AS hi FROM d GROUP BY community),
    starts AS (SELECT community, CAST(k AS INTEGER) AS step, lo + CAST(k AS INTEGER) AS w FROM span, range(0, 5000) r(k) WHERE lo + CAST(k AS INTEGER) <= hi - 29),
    u AS (SELECT community, step, cohort, user_id, avg(t) AS m, count(*) AS n FROM d JOIN starts USING (community)
      WHERE day >= w AND day < w + 30 GROUP BY ALL),
    c AS (SELECT community, step, cohort, sum(m*n)/sum(n) AS c FROM u GROUP BY ALL),
    g AS (SELECT community, step, cohort, """ + METRICS_SQL + """ FROM u JOIN c USING (community, step, cohort) GROUP BY community, step, cohort, c),
    grid AS (SELECT * FROM starts, (VALUES ('beforeA'), ('betweenA-B'), ('betweenB-C'), ('betweenC-D'), ('afterD')) x(cohort))
    SELECT community, step, cohort, CAST(w AS VARCHAR) AS window_tmin, CAST(w + 30 AS VARCHAR) AS window_tmax, """ + SHOWN_SQL + """
    FROM grid LEFT JOIN g USING (community, step, cohort)"""))
def sliding_window_timeseries(spark, folder):
    return rounded(cohorts.sliding_window_timeseries(standins.activity(spark, folder), ORDER_CALENDAR, SCORE))


@check("period_cohort_bars", with_views("activity", "first_seen_community", body="""
    , u AS (SELECT community, """ + PERIOD_SQL.format(ts="date_trunc('day', ts)") + """ AS period,
        """ + ARRIVAL_SQL.format(ts="date_trunc('day', first_seen)") + """ AS cohort, user_id, sum(toxicity_toxigen) AS t, count(*) AS n
      FROM activity JOIN first_seen_community USING (community, user_id) GROUP BY ALL)
    SELECT community, period, cohort, count(*) AS n_users, round(sum(t)/sum(n),6) AS activity_mean, round(avg(t/n),6) AS user_mean
    FROM u WHERE period IS NOT NULL GROUP BY ALL"""))
def period_cohort_bars(spark, folder):
    return rounded(cohorts.period_cohort_bars(standins.activity(spark, folder), ORDER_CALENDAR, SCORE))


@check("interaction_type_sensitivity", with_views("activity", body="""
    , u AS (SELECT community, month, user_id, avg(toxicity_toxigen) AS a, avg(toxicity_toxigen) FILTER (interaction_type='COMMENT') AS c
      FROM activity GROUP BY ALL)
    SELECT community, month, count(*) AS member_count, round(avg(a),6) AS mean_toxicity, count(c) AS member_count_comments,
      round(avg(c),6) AS mean_toxicity_comments, round(avg(c)-avg(a),6) AS delta_toxicity_comments_minus_all FROM u GROUP BY ALL"""))
def interaction_type_sensitivity(spark, folder):
    return rounded(cohorts.interaction_type_sensitivity(standins.activity(spark, folder), SCORE))


@check("composition_decomposition", with_views("labelled_user_month", body="""
    , b AS (SELECT community, month, count(*) AS member_count, count(*) FILTER (label='newcomer') AS newcomer_count,
        count(*) FILTER (label='existing') AS incumbent_count, count(*) FILTER (label='newcomer')/count(*) AS s,
        avg(mean_toxicity) FILTER (label='newcomer') AS a, avg(mean_toxicity) FILTER (label='existing') AS o, avg(mean_toxicity) AS t
      FROM labelled_user_month GROUP BY ALL),
    l AS (SELECT *, lag(s) OVER w AS s0, lag(a) OVER w AS a0, lag(o) OVER w AS o0, lag(t) OVER w AS t0 FROM b
      WINDOW w AS (PARTITION BY community ORDER BY month)),
    p AS (SELECT *, t - t0 AS d, (s-s0)*((a+a0)/2-(o+o0)/2) AS c1, (a-a0)*(s+s0)/2 AS c2, (o-o0)*(1-(s+s0)/2) AS c3 FROM l)
    SELECT community, month, member_count, newcomer_count, incumbent_count, round(s,6) AS share_newcomers, round(a,6) AS mean_newcomers,
      round(o,6) AS mean_incumbents, round(t,6) AS overall_mean, round(d,6)+0.0 AS delta_overall, round(c1,6)+0.0 AS composition_component,
      round(c2,6)+0.0 AS newcomer_behavior_component, round(c3,6)+0.0 AS incumbent_behavior_component,
      round(d-c1-c2-c3,6)+0.0 AS residual_component, member_count >= 20 AS valid_member_count FROM p"""))
def composition_decomposition(spark, folder):
    return rounded(
        cohorts.composition_decomposition(
            shared.user_month(spark, folder), community_first(spark, folder), DAYS, "mean_toxicity"
        )
    )
