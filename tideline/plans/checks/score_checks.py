"""Checks of score tables, samples and the scoring job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tideline.operators import cohorts, comparisons, panel, scores
from tideline.plans import shared, standins
from tideline.plans.catalog import check, rounded
from tideline.plans.checks import regression_checks
from tideline.plans.checks.cohort_checks import METRICS_SQL, SHOWN_SQL
from tideline.plans.checks.label_checks import ARRIVAL_SQL, PERIOD_SQL
from tideline.plans.oracle_math import student_p_sql
from tideline.plans.standins import LABELS, ORDER_CALENDAR, VIEW_SQL, with_views
from tideline.sources.activity import eligible_activity

DISTRIBUTION_SQL = """count(*) AS n_rows, round(avg(v),6) AS mean, round(median(v),6) AS median, round(quantile_cont(v,0.9),6) AS q90,
      round(quantile_cont(v,0.95),6) AS q95, round(avg(CASE WHEN v>0.5 THEN 1.0 ELSE 0 END),6) AS share_gt_0_5, round(avg(CASE WHEN v>0.9 THEN 1.0 ELSE 0 END),6) AS share_gt_0_9"""


@check("score_distribution", with_views("scores_scoped", body=f"""
    SELECT community_type, community, label, {DISTRIBUTION_SQL} FROM scores_scoped GROUP BY ALL"""))
def score_distribution(spark, folder):
    return rounded(scores.score_distribution(standins.scores(spark, folder), LABELS))


@check("top_rank_summary", with_views("scores_long", body=f"""
    SELECT community_type, community, label, {DISTRIBUTION_SQL} FROM scores_long WHERE label='detoxify_insult' GROUP BY ALL ORDER BY avg(v) DESC, community LIMIT 3"""))
def top_rank_summary(spark, folder):
    found = scores.score_distribution(standins.scores(spark, folder), LABELS)
    return rounded(scores.top_rank_summary(found, "detoxify_insult", 3))


@check("community_label_pivot", with_views("scores", body="""
    SELECT community_type, community, """ + ", ".join(f"round(avg({c}),6) AS {n}" for n, c in LABELS.items()) + " FROM scores GROUP BY ALL"))
def community_label_pivot(spark, folder):
    found = scores.score_distribution(standins.scores(spark, folder), LABELS)
    return rounded(scores.community_label_pivot(found, list(LABELS), "detoxify_toxicity"))


@check("score_monthly", with_views("scores", body="""
    SELECT community_type, community, month, count(*) AS activity_count, count(DISTINCT user_id) AS active_users, """ + ", ".join(
        f"round(avg({c}),6) AS {n}_mean, round(quantile_cont({c},0.9),6) AS {n}_q90, round(avg(CASE WHEN {c}>0.5 THEN 1.0 ELSE 0 END),6) AS {n}_share_gt_0_5"
        for n, c in LABELS.items()) + " FROM scores GROUP BY ALL"))
def score_monthly(spark, folder):
    return rounded(scores.score_monthly(standins.scores(spark, folder), LABELS))


VIEW_SQL["score_periods"] = (("scores",), "SELECT community_type, community, " + PERIOD_SQL.format(ts="ts") + """ AS period, count(*) AS activity_count,
      count(DISTINCT user_id) AS active_users, """ + ", ".join(
        f"avg({c}) AS {n}_mean, avg(CASE WHEN {c}>0.5 THEN 1.0 ELSE 0 END) AS {n}_share_gt_0_5" for n, c in LABELS.items()) + """
    FROM scores WHERE ts >= TIMESTAMP '1996-04-10' AND ts < TIMESTAMP '2001-08-01' GROUP BY ALL""")


@check("score_event_period", with_views("score_periods", body="SELECT community_type, community, period, activity_count, active_users, " + ", ".join(
    f"round({n}_{p},6) AS {n}_{p}" for n in LABELS for p in ("mean", "share_gt_0_5")) + " FROM score_periods"))
def score_event_period(spark, folder):
    return rounded(scores.score_event_period(standins.scores(spark, folder), LABELS, ORDER_CALENDAR))


@check("score_period_rollup", with_views("score_periods", body="SELECT period, " + ", ".join(
    f"round(avg({n}_mean),6) AS {n}_mean" for n in LABELS) + " FROM score_periods WHERE community_type='normal' GROUP BY period"))
def score_period_rollup(spark, folder):
    periods = scores.score_event_period(standins.scores(spark, folder), LABELS, ORDER_CALENDAR)
    return rounded(scores.score_period_rollup(periods, LABELS))


@check("score_by_interaction", with_views("scores", body="SELECT lower(interaction_type) AS interaction, community_type, community, count(*) AS n_rows, " + ", ".join(
    f"round(avg({c}),6) AS {n}_mean" for n, c in LABELS.items()) + " FROM scores GROUP BY ALL"))
def score_by_interaction(spark, folder):
    return rounded(scores.score_by_interaction(standins.scores(spark, folder), LABELS))


@check("score_density_grid", with_views("scores", body="""
    , e AS (SELECT min(toxicity_toxigen) AS lx, max(toxicity_toxigen) AS hx, min(detoxify_toxicity) AS ly, max(detoxify_toxicity) AS hy FROM scores)
    SELECT CAST(least(floor((toxicity_toxigen-lx)/(hx-lx)*55),54) AS INTEGER) AS cell_x, CAST(least(floor((detoxify_toxicity-ly)/(hy-ly)*55),54) AS INTEGER) AS cell_y, count(*) AS n,
      round(log10(count(*)),6) AS log10_n FROM scores, e GROUP BY ALL"""))
def score_density_grid(spark, folder):
    return rounded(scores.score_density_grid(standins.scores(spark, folder), "toxicity_toxigen", "detoxify_toxicity"))


# Ranks compare values, so both sides see them to nine digits.
RANKED_SQL = """r1 AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY x) + (count(*) OVER (PARTITION BY {k}, x)-1)/2.0 AS rx,
      rank() OVER (PARTITION BY {k} ORDER BY y) + (count(*) OVER (PARTITION BY {k}, y)-1)/2.0 AS ry FROM pr)"""


@check("score_scope_summary", with_views("scores", body="""
    , sc AS (SELECT lower(interaction_type) AS scope, * FROM scores UNION ALL SELECT 'both', * FROM scores),
    pr AS (SELECT *, round(toxicity_toxigen,9) AS x, round(detoxify_toxicity,9) AS y FROM sc), """ + RANKED_SQL.format(k="scope") + """
    SELECT scope, count(*) AS n_rows, """ + ", ".join(
        f"round(avg({c}),6) AS {n}_mean, round(avg(CASE WHEN {c}>0.5 THEN 1.0 ELSE 0 END),6) AS {n}_share_gt_0_5" for n, c in LABELS.items()) + """,
      round(corr(x, y),6) AS pearson_r, round(corr(rx, ry),6) AS spearman_rho FROM r1 GROUP BY scope"""))
def score_scope_summary(spark, folder):
    table = standins.scores(spark, folder).withColumns({
        "x": F.round("toxicity_toxigen", 9), "y": F.round("detoxify_toxicity", 9)
    })
    return rounded(scores.score_scope_summary(table, LABELS, "x", "y"))


OTHERS = {n: c for n, c in LABELS.items() if n != "toxigen_toxicity"}
_SCORES_WITH_X = """
    , lg AS (SELECT l.community_type, l.community, l.label, round(s.toxicity_toxigen,9) AS x, round(l.v,9) AS y FROM scores_long l JOIN scores s USING (post_id) WHERE l.label<>'toxigen_toxicity'),
    pr AS (SELECT * FROM lg UNION ALL SELECT * REPLACE ('global' AS community) FROM lg UNION ALL SELECT * REPLACE ('global' AS community_type, 'global' AS community) FROM lg), """


@check("pearson_spearman", with_views("scores", "scores_long", body=_SCORES_WITH_X + RANKED_SQL.format(k="community_type, community, label") + f""",
    g AS (SELECT community_type, community, label, count(*) AS n, avg(x) AS mx, avg(y) AS my, corr(x,y) AS r, corr(rx,ry) AS rho FROM r1 GROUP BY ALL),
    t AS (SELECT *, r*sqrt((n-2)/(1-r*r)) AS t1, rho*sqrt((n-2)/(1-rho*rho)) AS t2, (n-2)::DOUBLE AS df FROM g)
    SELECT community_type, community, label, n, round(mx,6) AS mean_x, round(my,6) AS mean_y, round(r,6) AS pearson_r, round({student_p_sql('t1','df')},6) AS pearson_p,
      round(rho,6) AS spearman_rho, round({student_p_sql('t2','df')},6) AS spearman_p FROM t"""))
def pearson_spearman(spark, folder):
    table = standins.scores(spark, folder)
    for column in LABELS.values():
        table = table.withColumn(column, F.round(column, 9))
    return rounded(scores.correlation_table(table, "toxicity_toxigen", OTHERS))


@check("multi_label_cohort_summary", with_views("scores_long", "first_seen", body="""
    , u0 AS (SELECT community, label, """ + ARRIVAL_SQL.format(ts="first_seen") + """ AS cohort, user_id, v FROM scores_long JOIN first_seen USING (user_id)
      WHERE ts >= TIMESTAMP '1996-04-10'),
    u AS (SELECT community, label, cohort, user_id, avg(v) AS m, count(*) AS n FROM (SELECT * FROM u0 UNION ALL SELECT * REPLACE ('all_examined_communities' AS community) FROM u0) GROUP BY ALL),
    c AS (SELECT community, label, cohort, sum(m*n)/sum(n) AS c FROM u GROUP BY ALL),
    g AS (SELECT community, label, cohort, """ + METRICS_SQL + """ FROM u JOIN c USING (community, label, cohort) GROUP BY community, label, cohort, c),
    grid AS (SELECT * FROM (SELECT DISTINCT community, label FROM u), (VALUES ('beforeA'), ('betweenA-B'), ('betweenB-C'), ('betweenC-D'), ('afterD')) x(cohort))
    SELECT community, label, cohort, """ + SHOWN_SQL + " FROM grid LEFT JOIN g USING (community, label, cohort)"))
def multi_label_cohort_summary(spark, folder):
    return rounded(scores.multi_label_cohort_summary(standins.scores(spark, folder), LABELS, ORDER_CALENDAR))


@check("toxicity_calibration", with_views("activity", body="""
    , y AS (SELECT platform, community, CAST(year(ts) AS INTEGER) AS year, CASE WHEN CAST(post_id AS BIGINT) % 7 <> 0 THEN toxicity_toxigen END AS v FROM activity)
    SELECT platform, community, year, count(*) AS total_rows, count(v) AS non_null_rows, round(1-count(v)/count(*),6) AS missing_share, """ + ", ".join(
        f"round(quantile_cont(v,{p / 100}),6) AS q_{p}" for p in (10, 25, 50, 75, 90)) + """,
      round(count(*) FILTER (v>=0.5)/count(v),6) AS share_ge_0_5, round(count(*) FILTER (v>=0.8)/count(v),6) AS share_ge_0_8 FROM y GROUP BY ALL"""))
def toxicity_calibration(spark, folder):
    gappy = standins.activity(spark, folder).withColumn(
        "toxicity_toxigen", F.when(F.col("post_id").cast("bigint") % 7 != 0, F.col("toxicity_toxigen"))
    )
    return rounded(scores.toxicity_calibration(gappy, "toxicity_toxigen"))


@check("group_month_validity", with_views("labelled_user_month", body="""
    , g AS (SELECT platform, community, month, label, count(*) AS member_count, avg(CASE WHEN activity_count > 1 THEN mean_toxicity END) AS mean_toxicity, avg(mean_vader) AS mean_vader
      FROM labelled_user_month GROUP BY ALL),
    t AS (SELECT *, CASE WHEN label='existing' AND platform='focal' THEN 5 ELSE 20 END AS thr, CAST(mean_toxicity IS NULL AS INTEGER) + CAST(mean_vader IS NULL AS INTEGER) AS miss FROM g)
    SELECT platform, community, month, label, member_count, round(mean_toxicity,6) AS mean_toxicity, round(mean_vader,6) AS mean_vader, thr AS group_min_member_threshold,
      miss AS num_metrics_missing, round(miss/2,6) AS metrics_missing_ratio, member_count >= thr AS valid_member_count,
      concat_ws(';', CASE WHEN member_count < thr THEN 'member_count_below_threshold' END, CASE WHEN miss > 0 THEN 'missing_metrics' END) AS validation_reason,
      thr AS min_member_threshold FROM t"""))
def group_month_validity(spark, folder):
    from tideline.functions import labels, timeparts
    from tideline.functions.calendar import newcomer_days

    activity = standins.activity(spark, folder)
    first = cohorts.first_seen(activity, ["community", "user_id"]).select("community", "user_id", "first_month")
    label = labels.newcomer_label(
        timeparts.month_start(F.col("first_month")), timeparts.month_start(F.col("month")), newcomer_days(ORDER_CALENDAR)
    )
    grouped = (
        shared.user_month(spark, folder)
        .join(first, ["community", "user_id"])
        .groupBy("platform", "community", "month", label.alias("label"))
        .agg(
            F.count("*").alias("member_count"),
            F.avg(F.when(F.col("activity_count") > 1, F.col("mean_toxicity"))).alias("mean_toxicity"),
            F.avg("mean_vader").alias("mean_vader"),
        )
    )
    return rounded(
        comparisons.group_month_validity(
            grouped, ["mean_toxicity", "mean_vader"], core="existing", focal=F.col("platform") == "focal"
        )
    )


_LABEL_ROWS = " UNION ALL ".join(
    f"SELECT '{n}_mean' AS outcome, s.community AS g, avg(s.{c}) AS y, any_value(d.s) AS s, CAST(s.month >= '1999-03' AS INTEGER) AS post, "
    "CAST(s.month[1:4] AS INTEGER)*12 + CAST(s.month[6:7] AS INTEGER) AS t FROM scores s LEFT JOIN panel_raw d ON d.community=s.community AND d.month=s.month GROUP BY s.community, s.month"
    for n, c in LABELS.items()
)


@check("multi_label_panel", with_views("scores", "panel_raw", body=f""", {regression_checks.panel_views(_LABEL_ROWS)}, {regression_checks.EFFECTS_SQL},
    al AS (SELECT outcome, term, coef, se, r2, n, gs FROM slopes UNION ALL SELECT outcome, term, coef, se, NULL, NULL, NULL FROM fe)
    SELECT {regression_checks.SLOPES_SQL} FROM al"""))
def multi_label_panel(spark, folder):
    keys = ["community", "month"]
    monthly = scores.score_monthly(standins.scores(spark, folder), LABELS)
    shares = regression_checks.community_panel(spark, folder).select(*keys, "newcomer_pop_share")
    outcomes = [f"{name}_mean" for name in LABELS]
    return rounded(panel.multi_outcome_terms(monthly.join(shares, keys, "left"), outcomes, regression_checks.CUTOFF))


@check("eligible_activity", with_views("eligible", body="SELECT post_id, community, toxicity_toxigen FROM eligible"))
def eligible_activity_query(spark, folder):
    eligible = eligible_activity(standins.texts(spark, folder), "toxicity_toxigen", "post")
    return eligible.select("post_id", "community", "toxicity_toxigen")


# The strata of the sample, a parameter of the job.
STRATA = [f"src{i}" for i in range(20)]


def eligible_posts(spark, folder):
    return eligible_activity(standins.texts(spark, folder), "toxicity_toxigen", "post")


@check("stratified_sample", with_views("eligible", body="""
    , s AS (SELECT *, CAST(substr(community, 4) AS INTEGER) AS si, md5(concat_ws('|', '7', post_id)) AS k FROM eligible WHERE regexp_full_match(community, 'src1?[0-9]')),
    p AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY k, post_id) AS r, CASE WHEN si < 10 THEN 13 ELSE 12 END AS req FROM s),
    q AS (SELECT * FROM p WHERE r <= req)
    SELECT post_id, community, toxicity_toxigen, req AS sample_requested_n, CAST(7 AS INTEGER) AS sample_seed, count(*) OVER (PARTITION BY community) AS sample_actual_n,
      row_number() OVER (ORDER BY md5(concat_ws('|', '7', 'order', post_id)), post_id) AS sample_row_id FROM q"""))
def stratified_sample(spark, folder):
    columns = eligible_posts(spark, folder).select("post_id", "community", "toxicity_toxigen")
    return scores.stratified_sample(columns, STRATA, 250, 7)


def word_scorer():
    """A small scorer: share of letters, and length relative to long texts."""

    def score(texts: pd.Series) -> pd.DataFrame:
        letters = texts.str.count("[a-z]")
        return pd.DataFrame({"letter_share": letters / texts.str.len(), "length_score": (texts.str.len() / 20000).clip(upper=1.0)})

    return score


@check("batch_text_scoring", with_views("texts", body=r"""
    SELECT post_id, community, round(length(regexp_replace(content, '[^a-z]', '', 'g'))/length(content),6) AS letter_share, round(least(length(content)/20000.0,1.0),6) AS length_score
    FROM texts WHERE trim(regexp_replace(coalesce(content,''), '\s', ' ', 'g')) <> '' AND toxicity_toxigen IS NOT NULL AND interaction_type='COMMENT'
      AND CAST(post_id AS BIGINT) % 5 <> 0"""))
def batch_text_scoring(spark, folder):
    """Comments, of which every fifth has been scored before."""
    eligible = eligible_activity(standins.texts(spark, folder), "toxicity_toxigen", "comment")
    already = eligible.where(F.col("post_id").cast("bigint") % 5 == 0)
    found = scores.batch_text_scoring(
        eligible.select("post_id", "community", "content"), word_scorer, ["letter_share", "length_score"], already
    )
    return rounded(found)


@check("scoring_manifest", with_views("eligible", body="""
    SELECT community, count(*) AS eligible_rows, count(*) FILTER (CAST(post_id AS BIGINT) % 5 = 0) AS scored_rows FROM eligible GROUP BY community"""))
def scoring_manifest(spark, folder):
    eligible = eligible_posts(spark, folder).select("post_id", "community")
    return scores.scoring_manifest(eligible, eligible.where(F.col("post_id").cast("bigint") % 5 == 0))
