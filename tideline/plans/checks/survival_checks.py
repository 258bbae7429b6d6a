"""Checks of retention and survival operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import cohorts, hubs, rollups, survival
from tideline.plans import shared, standins
from tideline.plans.catalog import check, rounded
from tideline.plans.checks import graph_checks  # registers the views of hubs and cohort shares
from tideline.plans.checks.label_checks import FIXED_SQL
from tideline.plans.standins import ORDER_CALENDAR, VIEW_SQL, with_views
from tideline.session import cut_lineage

COHORTS = ORDER_CALENDAR.fixed_cohorts

VIEW_SQL["survival_months"] = (("activity", "first_seen_community"), """
    SELECT community, user_id, month, """ + FIXED_SQL.format(ts="any_value(first_seen)") + """ AS fixed_cohort, any_value(first_month) AS first_month,
      CAST(month[1:4] AS INTEGER)*12 + CAST(month[6:7] AS INTEGER) AS mn, avg(toxicity_toxigen) AS tox, count(*) AS n
    FROM activity JOIN first_seen_community USING (community, user_id) GROUP BY community, user_id, month""")
VIEW_SQL["early"] = (("survival_months",), """
    SELECT community, user_id, avg(tox) FILTER (r<=1) AS e1, avg(tox) FILTER (r<=3) AS e3, avg(tox) FILTER (r<=6) AS e6, max(n) FILTER (r=1) AS first_n
    FROM (SELECT *, row_number() OVER (PARTITION BY community, user_id ORDER BY mn) AS r FROM survival_months) GROUP BY ALL""")
VIEW_SQL["summary"] = (("survival_months", "early"), """
    SELECT *, CASE WHEN first_n >= quantile_cont(first_n, 0.9) OVER (PARTITION BY community, fixed_cohort) THEN 'high_activity' ELSE 'lower_activity' END AS activity_group
    FROM (SELECT community, user_id, any_value(fixed_cohort) AS fixed_cohort, any_value(first_month) AS first_month, min(month) AS fm, max(month) AS lm,
        count(DISTINCT mn) AS active_months, CAST(sum(n) AS BIGINT) AS total_activity, avg(tox) AS tox, max(mn)-min(mn)+1 AS surv, max(mn) < 2001*12+8 AS ev
      FROM survival_months GROUP BY ALL) JOIN early USING (community, user_id)""")
VIEW_SQL["definitions"] = (("summary",), """
    SELECT *, CASE WHEN v >= cut THEN 'high' WHEN v < cut THEN 'lower' END AS grp FROM (
      SELECT *, CASE q WHEN 0.5 THEN quantile_cont(v, 0.5) OVER w WHEN 0.75 THEN quantile_cont(v, 0.75) OVER w ELSE quantile_cont(v, 0.9) OVER w END AS cut
      FROM (SELECT community, user_id, fixed_cohort, surv, ev, k, v, q FROM (
          SELECT *, unnest([1,3,6]) AS k, unnest([e1,e3,e6]) AS v FROM summary), (VALUES (0.5::DOUBLE),(0.75::DOUBLE),(0.9::DOUBLE)) x(q))
      WINDOW w AS (PARTITION BY community, fixed_cohort, k, q))""")
VIEW_SQL["spells"] = (("definitions",), """
    SELECT * FROM definitions WHERE grp IS NOT NULL AND fixed_cohort <> 'pre_fph'
    UNION ALL SELECT 'global' AS community, * EXCLUDE (community) FROM definitions WHERE grp IS NOT NULL AND fixed_cohort <> 'pre_fph'""")
VIEW_SQL["curves"] = (("spells",), """
    SELECT *, product(1 - n_events/n_at_risk) OVER (PARTITION BY community, fixed_cohort, k, q, grp ORDER BY t) AS s FROM (
      SELECT *, CAST(sum(n_events+n_censored) OVER (PARTITION BY community, fixed_cohort, k, q, grp ORDER BY t DESC) AS BIGINT) AS n_at_risk FROM (
        SELECT community, fixed_cohort, k, q, grp, CAST(surv AS DOUBLE) AS t, count(*) FILTER (ev) AS n_events, count(*) FILTER (NOT ev) AS n_censored
        FROM spells GROUP BY ALL)) WHERE n_events > 0""")
_SIDES = []
for _g in ("high", "lower"):
    _SIDES.append(f"median(surv) FILTER (grp='{_g}') AS median_survival_months_{_g}")
    for _h in (3, 6, 12):
        _SIDES.append(f"avg(CASE WHEN surv >= {_h + 1} THEN 1.0 ELSE 0.0 END) FILTER (grp='{_g}') AS retention_{_h}m_{_g}")
_CURVE = [
    f"coalesce(arg_max(s, t) FILTER (grp='{g}' AND t <= {h}), 1.0) AS km_survival_{h}m_{g}" for g in ("high", "lower") for h in (3, 6, 12)
]
VIEW_SQL["survival_wide"] = (("spells", "curves"), f"""
    SELECT * FROM (SELECT community, fixed_cohort, k, q, count(*) AS n_users, count(*) FILTER (grp='high') AS n_high, count(*) FILTER (grp='lower') AS n_lower,
        avg(CASE WHEN ev THEN 0.0 ELSE 1.0 END) AS censored_rate, {", ".join(_SIDES)} FROM spells GROUP BY ALL)
    JOIN (SELECT s.community, s.fixed_cohort, s.k, s.q, {", ".join(_CURVE)} FROM (SELECT DISTINCT community, fixed_cohort, k, q FROM spells) s
      LEFT JOIN curves USING (community, fixed_cohort, k, q) GROUP BY ALL) USING (community, fixed_cohort, k, q)
    WHERE n_high > 0 AND n_lower > 0""")


def months(spark, folder):
    activity = standins.activity(spark, folder)
    first = cohorts.first_seen(activity, ["community", "user_id"])
    monthly = rollups.user_month_metrics(activity, {"mean_toxicity": "toxicity_toxigen"}, ["community"])
    return survival.user_months(monthly, first, ORDER_CALENDAR)


def summary(spark, folder):
    return survival.user_summary(months(spark, folder), ORDER_CALENDAR)


@check("first_k_active_months_mean", with_views("early", body="""
    SELECT community, user_id, round(e1,6) AS early_toxicity_first1_months, round(e3,6) AS early_toxicity_first3_months,
      round(e6,6) AS early_toxicity_first6_months FROM early"""))
def first_k_active_months_mean(spark, folder):
    return rounded(survival.first_k_active_months_mean(months(spark, folder), "mean_toxicity"))


@check("first_month_activity", with_views("early", body="SELECT community, user_id, first_n AS first_month_activity_count FROM early"))
def first_month_activity(spark, folder):
    return survival.first_month_activity(months(spark, folder))


@check("group_quantile_threshold", with_views("summary", body="""
    SELECT community, fixed_cohort, round(quantile_cont(e3,0.5),6) AS q50, round(quantile_cont(e3,0.75),6) AS q75, round(quantile_cont(e3,0.9),6) AS q90
    FROM summary GROUP BY ALL"""))
def group_quantile_threshold(spark, folder):
    users = summary(spark, folder)
    probs = {"q50": 0.5, "q75": 0.75, "q90": 0.9}
    return rounded(survival.group_threshold(users, "early_toxicity_first3_months", probs))


@check("user_summary", with_views("summary", body="""
    SELECT community, user_id, fixed_cohort, first_month, fm AS first_active_month, lm AS last_active_month, active_months, total_activity,
      round(tox,6) AS mean_toxicity, round(e1,6) AS early_toxicity_first1_months, round(e3,6) AS early_toxicity_first3_months,
      round(e6,6) AS early_toxicity_first6_months, first_n AS first_month_activity_count, surv AS survival_months, ev AS event_observed,
      surv >= 4 AS retained_3m, surv >= 7 AS retained_6m, surv >= 13 AS retained_12m, activity_group FROM summary"""))
def user_summary(spark, folder):
    return rounded(summary(spark, folder).drop("activity_q90"))


@check("kaplan_meier", with_views("curves", body="""
    SELECT fixed_cohort, k AS early_months, q AS high_toxicity_quantile, grp || '_toxicity' AS toxicity_group, t AS time_months, n_at_risk, n_events, n_censored,
      round(s,6) AS survival_probability FROM curves WHERE community='global'
    UNION ALL SELECT DISTINCT fixed_cohort, k, q, grp || '_toxicity', 0.0::DOUBLE, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, 1.0::DOUBLE FROM spells WHERE community='global'"""))
def kaplan_meier(spark, folder):
    grouped = survival.with_toxicity_groups(summary(spark, folder))
    scoped = survival.post_event_scopes(grouped, ORDER_CALENDAR).where(F.col("community") == survival.EVERYWHERE)
    keys = ["fixed_cohort", "early_months", "high_toxicity_quantile", "toxicity_group"]
    return rounded(survival.kaplan_meier(scoped, keys))


@check("survival_at", with_views("curves", body="""
    , s AS (SELECT DISTINCT community, fixed_cohort, k, q, grp FROM spells)
    SELECT s.community, s.fixed_cohort, s.k AS early_months, s.q AS high_toxicity_quantile, s.grp || '_toxicity' AS toxicity_group,
      round(coalesce(arg_max(c.s, c.t) FILTER (c.t <= 6), 1.0),6) AS survival_6m
    FROM s LEFT JOIN curves c USING (community, fixed_cohort, k, q, grp) GROUP BY ALL"""))
def survival_at(spark, folder):
    grouped = survival.with_toxicity_groups(summary(spark, folder))
    keys = ["community", "fixed_cohort", "early_months", "high_toxicity_quantile", "toxicity_group"]
    curves = survival.kaplan_meier(survival.post_event_scopes(grouped, ORDER_CALENDAR), keys)
    return rounded(curves.groupBy(*keys).agg(survival.survival_at(6).alias("survival_6m")))


_MEASURES = [f"{m}_{h}m" for h in (3, 6, 12) for m in ("km_survival", "retention")]


@check("survival_by_toxicity", with_views("survival_wide", body="""
    SELECT community, fixed_cohort, k AS early_months, q AS high_toxicity_quantile, n_users, n_high AS n_high_toxicity, n_lower AS n_lower_toxicity,
      round(censored_rate,6) AS censored_rate, """ + ", ".join(
        [f"round({m}_{g},6) AS {m}_{g}" for m in [*_MEASURES, "median_survival_months"] for g in ("high", "lower")]
        + [f"round({m}_high - {m}_lower,6)+0.0 AS {m}_high_minus_lower" for m in _MEASURES]) + " FROM survival_wide"))
def survival_by_toxicity(spark, folder):
    grouped = survival.with_toxicity_groups(summary(spark, folder))
    return rounded(survival.survival_by_toxicity(grouped, ORDER_CALENDAR))


def sensitivity(spark, folder):
    grouped = survival.with_toxicity_groups(summary(spark, folder))
    return survival.survival_sensitivity(survival.survival_by_toxicity(grouped, ORDER_CALENDAR))


_COMPARED = ("km_survival_3m", "km_survival_12m", "retention_3m", "retention_12m")


@check("survival_sensitivity", with_views("survival_wide", body="""
    SELECT fixed_cohort, k AS early_months, q AS high_toxicity_quantile, n_users, n_high AS n_high_toxicity, """ + ", ".join(
        f"round({m}_high - {m}_lower,6)+0.0 AS {m}_high_minus_lower" for m in _COMPARED) + " FROM survival_wide WHERE community='global'"))
def survival_sensitivity(spark, folder):
    return rounded(sensitivity(spark, folder))


@check("cohort_order_sort", with_views("survival_wide", body="""
    SELECT fixed_cohort, k AS early_months, q AS high_toxicity_quantile, n_users FROM survival_wide WHERE community='global'"""))
def cohort_order_sort(spark, folder):
    ordered = rollups.ordered_by_rank(
        sensitivity(spark, folder), "fixed_cohort", COHORTS, ["early_months", "high_toxicity_quantile"]
    )
    return ordered.select("fixed_cohort", "early_months", "high_toxicity_quantile", "n_users")


VIEW_SQL["ascent"] = (("summary", "hub_flags", "cohort_share"), """
    SELECT fixed_cohort, hub_fraction, n_users, med, under, a, b, c FROM
    (SELECT * FROM (VALUES ('fph_pg'),('pg_ga'),('ga_td'),('td_shutdown')) x(fixed_cohort), (VALUES (0.05::DOUBLE),(0.1::DOUBLE),(0.2::DOUBLE)) y(hub_fraction))
    LEFT JOIN (SELECT fixed_cohort, hub_fraction, count(*) AS n_users, avg(h) AS a, avg(h) FILTER (activity_group='high_activity') AS b,
        avg(h) FILTER (activity_group<>'high_activity') AS c
      FROM (SELECT s.fixed_cohort, s.activity_group, unnest([0.05::DOUBLE,0.1,0.2]) AS hub_fraction,
          unnest([CAST(coalesce(ever_hub_top5,false) AS DOUBLE), CAST(coalesce(ever_hub_top10,false) AS DOUBLE), CAST(coalesce(ever_hub_top20,false) AS DOUBLE)]) AS h
        FROM summary s LEFT JOIN hub_flags f ON f.community=s.community AND f.node='c'||s.user_id) GROUP BY ALL) USING (fixed_cohort, hub_fraction)
    LEFT JOIN (SELECT fixed_cohort, median(degree_share_ratio) AS med, avg(CASE WHEN degree_share_ratio<1 THEN 1.0 ELSE 0.0 END) AS under
      FROM cohort_share GROUP BY ALL) USING (fixed_cohort)""")


def ascent(spark, folder):
    users = summary(spark, folder)
    # Hubs, first months and shares all come from the nodes.
    nodes = cut_lineage(graph_checks.month_graph(spark, folder)[1])
    flags = hubs.ever_hub(hubs.top_fraction_hubs(nodes, graph_checks.MONTH)).where(F.col("node").startswith("c"))
    named = flags.withColumn("user_id", F.expr("substr(node, 2)")).drop("node")
    flagged = hubs.join_hub_flags(users, named, ["community", "user_id"])
    return survival.hub_ascent_summary(flagged, graph_checks.cohort_share(spark, folder, nodes), ORDER_CALENDAR)


@check("hub_ascent_summary", with_views("ascent", body="""
    SELECT fixed_cohort, hub_fraction, hub_fraction AS hub_equality_baseline, coalesce(n_users,0) AS n_users, round(med,6) AS median_degree_share_ratio,
      round(under,6) AS share_months_underrepresented, round(a,6) AS mean_ever_hub_rate, round(b,6) AS high_activity_ever_hub_rate,
      round(c,6) AS non_high_activity_ever_hub_rate FROM ascent"""))
def hub_ascent_summary(spark, folder):
    return rounded(ascent(spark, folder))


@check("manuscript_table", with_views("survival_wide", "ascent", body="""
    SELECT s.fixed_cohort AS cohort, s.n_users, n_high AS n_high_early_toxicity, round(km_survival_3m_high-km_survival_3m_lower,4)+0.0 AS km_3m_high_minus_lower,
      round(km_survival_12m_high-km_survival_12m_lower,4)+0.0 AS km_12m_high_minus_lower, round(med,4) AS median_degree_share_ratio,
      round(a,4) AS mean_ever_hub_rate_top10, 0.1::DOUBLE AS hub_rate_equality_baseline_top10, round(b,4) AS high_activity_ever_hub_rate_top10,
      round(c,4) AS non_high_activity_ever_hub_rate_top10
    FROM survival_wide s LEFT JOIN ascent h ON h.fixed_cohort=s.fixed_cohort AND h.hub_fraction=0.1 WHERE s.community='global' AND k=3 AND q=0.75"""))
def manuscript_table(spark, folder):
    return rounded(survival.manuscript_table(sensitivity(spark, folder), ascent(spark, folder)))
