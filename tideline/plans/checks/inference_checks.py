"""Checks of effect sizes, resampling tests, corrections and matched samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import comparisons, graph, inference, rollups
from tideline.plans import shared, standins
from tideline.plans.catalog import check, rounded
from tideline.plans.checks import graph_checks, reputation_checks
from tideline.plans.checks.label_checks import BIN_SQL
from tideline.plans.oracle_math import draw_sql, normal_p_sql, student_p_sql
from tideline.plans.standins import ORDER_CALENDAR, VIEW_SQL, with_views
from tideline.session import cut_lineage

SPLIT = ORDER_CALENDAR.days[2]
IS_FOCAL_SQL = "platform='focal'"


# Means that are equal as fractions may differ in their last bit with the order of summation. Where
# values are compared with each other, both sides therefore see them to nine digits.
VIEW_SQL["toxicity_series"] = (("community_month",), """
    SELECT platform, community, month, round(toxicity_mean, 9) AS toxicity_mean FROM community_month""")


def is_focal():
    return F.col("platform") == "focal"


def toxicity_series(spark, folder):
    monthly = shared.community_month(spark, folder)
    return monthly.select("platform", "community", "month", F.round("toxicity_mean", 9).alias("toxicity_mean"))


VIEW_SQL["cliff"] = (("toxicity_series",), """
    SELECT x.community, (count(*) FILTER (x.toxicity_mean > y.toxicity_mean) - count(*) FILTER (x.toxicity_mean < y.toxicity_mean))/count(*) AS d
    FROM toxicity_series x JOIN toxicity_series y USING (community) WHERE x.platform='focal' AND y.platform='reference' GROUP BY x.community""")


@check("cliffs_delta", with_views("cliff", body="SELECT community, round(d,6) AS cliffs_delta FROM cliff"))
def cliffs_delta(spark, folder):
    return rounded(inference.cliffs_delta(toxicity_series(spark, folder), ["community"], "toxicity_mean", is_focal(), True))


@check("cliffs_delta_users", with_views("user_month", body="""
    , v AS (SELECT community, platform, round(mean_toxicity, 9) AS t FROM user_month),
    r AS (SELECT community, platform, t, rank() OVER (PARTITION BY community ORDER BY t) AS lo,
        count(*) OVER (PARTITION BY community, t) AS ties FROM v),
    s AS (SELECT community, sum(lo + (ties-1)/2.0) FILTER (platform='focal') AS w, count(*) FILTER (platform='focal') AS n1,
        count(*) FILTER (platform='reference') AS n2 FROM r GROUP BY community)
    SELECT community, round(2*(w - n1*(n1+1)/2.0)/(n1*n2) - 1,6) AS cliffs_delta FROM s"""))
def cliffs_delta_users(spark, folder):
    """Over all user-months, where a pairwise form would be out of reach."""
    users = shared.user_month(spark, folder).withColumn("mean_toxicity", F.round("mean_toxicity", 9))
    return rounded(inference.cliffs_delta(users, ["community"], "mean_toxicity", is_focal()))


@check("glass_delta", with_views("toxicity_series", body="""
    SELECT community, round((avg(toxicity_mean) FILTER (platform='focal') - avg(toxicity_mean) FILTER (platform='reference'))
      / stddev_samp(toxicity_mean) FILTER (platform='reference'),6) AS glass_delta FROM toxicity_series GROUP BY community"""))
def glass_delta(spark, folder):
    value = F.col("toxicity_mean")
    delta = inference.glass_delta(F.when(is_focal(), value), F.when(~is_focal(), value))
    return rounded(toxicity_series(spark, folder).groupBy("community").agg(delta.alias("glass_delta")))


REPETITIONS = 1000
VIEW_SQL["boot"] = (("toxicity_series",), f"""
    SELECT d.community, d.platform, d.r, v.toxicity_mean AS t FROM (
      SELECT community, platform, r, i, {draw_sql('n', "'42'", 'community', 'platform', 'r', 'i')} AS j
      FROM (SELECT community, platform, row_number() OVER (PARTITION BY community, platform ORDER BY month) - 1 AS i,
          count(*) OVER (PARTITION BY community, platform) AS n FROM toxicity_series), range(0, {REPETITIONS}) q(r)) d
    JOIN (SELECT community, platform, toxicity_mean, row_number() OVER (PARTITION BY community, platform ORDER BY month) - 1 AS i FROM toxicity_series) v
      ON v.community=d.community AND v.platform=d.platform AND v.i=d.j""")
VIEW_SQL["boot_glass"] = (("boot",), """
    SELECT community, r, (avg(t) FILTER (platform='focal') - avg(t) FILTER (platform='reference'))/nullif(stddev_samp(t) FILTER (platform='reference'),0) AS g
    FROM boot GROUP BY ALL""")
VIEW_SQL["boot_cliff"] = (("boot",), """
    SELECT community, r, 2*(sum(lo + (ties-1)/2.0) FILTER (platform='focal') - any_value(n1)*(any_value(n1)+1)/2.0)/(any_value(n1)*any_value(n2)) - 1 AS c
    FROM (SELECT *, rank() OVER (PARTITION BY community, r ORDER BY t) AS lo, count(*) OVER (PARTITION BY community, r, t) AS ties,
        count(*) FILTER (platform='focal') OVER (PARTITION BY community, r) AS n1, count(*) FILTER (platform='reference') OVER (PARTITION BY community, r) AS n2 FROM boot)
    GROUP BY ALL""")
VIEW_SQL["boot_ci"] = (("boot_glass", "boot_cliff"), """
    SELECT community, quantile_cont(g, 0.025) AS glass_ci_lower, quantile_cont(g, 0.975) AS glass_ci_upper,
      quantile_cont(c, 0.025) AS cliffs_ci_lower, quantile_cont(c, 0.975) AS cliffs_ci_upper
    FROM boot_glass JOIN boot_cliff USING (community, r) GROUP BY community""")


# Eight digits: shares of 80 times 80 pairs end on the seventh.
@check("bootstrap_ci", with_views("boot_ci", body="""
    SELECT community, round(glass_ci_lower,8) AS glass_ci_lower, round(glass_ci_upper,8) AS glass_ci_upper,
      round(cliffs_ci_lower,8) AS cliffs_ci_lower, round(cliffs_ci_upper,8) AS cliffs_ci_upper FROM boot_ci"""))
def bootstrap_ci(spark, folder):
    table = inference.effect_sizes(toxicity_series(spark, folder), ["community"], "toxicity_mean", "focal")
    return rounded(table.select("community", "glass_ci_lower", "glass_ci_upper", "cliffs_ci_lower", "cliffs_ci_upper"), 8)


@check("effect_sizes", with_views("boot_ci", "cliff", body="""
    , m AS (SELECT community, avg(toxicity_mean) FILTER (platform='focal') AS a, avg(toxicity_mean) FILTER (platform='reference') AS b,
      stddev_samp(toxicity_mean) FILTER (platform='reference') AS s, count(*) FILTER (platform='focal') AS n1, count(*) FILTER (platform='reference') AS n2
      FROM toxicity_series GROUP BY community)
    SELECT community, round(a,8) AS focal_mean, round(b,8) AS reference_mean, round(a-b,8) AS difference, round(a/b,8) AS ratio, round((a-b)/s,8) AS glass_delta,
      n1 AS n_focal, n2 AS n_reference, round(d,8) AS cliffs_delta, round(glass_ci_lower,8) AS glass_ci_lower, round(glass_ci_upper,8) AS glass_ci_upper,
      round(cliffs_ci_lower,8) AS cliffs_ci_lower, round(cliffs_ci_upper,8) AS cliffs_ci_upper,
      CASE WHEN abs(d)<0.147 THEN 'negligible' WHEN abs(d)<0.33 THEN 'small' WHEN abs(d)<0.474 THEN 'medium' ELSE 'large' END AS interpretation
    FROM m JOIN cliff USING (community) JOIN boot_ci USING (community)"""))
def effect_sizes(spark, folder):
    return rounded(
        inference.effect_sizes(toxicity_series(spark, folder), ["community"], "toxicity_mean", "focal", repetitions=REPETITIONS), 8
    )


def _permutation_sql(source: str, keys: str, value: str, pre: str, repetitions: int) -> str:
    """The test point by point: every point gets its place in every shuffle."""
    return f"""
    , pts AS (SELECT *, (i - i % 3)/3 AS blk FROM (SELECT {keys}, {value} AS v, {pre} AS pre,
        row_number() OVER (PARTITION BY {keys} ORDER BY month) - 1 AS i FROM {source} WHERE {value} IS NOT NULL)),
    obs AS (SELECT {keys}, avg(v) FILTER (pre) AS a, avg(v) FILTER (NOT pre) AS b, count(*) FILTER (pre) AS n1, count(*) FILTER (NOT pre) AS n2, sum(v) AS t FROM pts GROUP BY ALL),
    bl AS (SELECT {keys}, CAST(blk AS BIGINT) AS blk, count(*) AS n FROM pts GROUP BY ALL),
    sh AS (SELECT {keys}, blk, r, coalesce(sum(n) OVER (PARTITION BY {keys}, r ORDER BY k, blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS st
      FROM (SELECT {keys}, blk, r, n, md5(concat_ws('|', '42', {keys}, r, blk)) AS k FROM bl, range(0, {repetitions}) q(r))),
    df AS (SELECT {keys}, r, (any_value(t) - coalesce(sum(v) FILTER (st + i % 3 < n1),0))/any_value(n2) - coalesce(sum(v) FILTER (st + i % 3 < n1),0)/any_value(n1) AS d
      FROM sh JOIN pts USING ({keys}, blk) JOIN obs USING ({keys}) WHERE n1 > 0 AND n2 > 0 GROUP BY {keys}, r),
    pv AS (SELECT {keys}, avg(CASE WHEN abs(d) >= abs(b-a) - 1e-12 THEN 1.0 ELSE 0.0 END) AS p FROM df JOIN obs USING ({keys}) GROUP BY {keys})
    SELECT {keys}, round(a,6) AS pre_mean, round(b,6) AS post_mean, n1 AS n_pre, n2 AS n_post, round(b-a,6) AS observed_diff, round(p,6) AS p_value
    FROM obs LEFT JOIN pv USING ({keys})"""


@check("block_permutation_test", with_views("community_month", body=_permutation_sql(
    "community_month", "platform, community", "toxicity_mean", f"CAST(month||'-01' AS TIMESTAMP) < TIMESTAMP '{SPLIT}'", 10_000)))
def block_permutation_test(spark, folder):
    pre = F.to_timestamp(F.concat("month", F.lit("-01"))) < F.lit(SPLIT).cast("timestamp")
    return rounded(
        inference.block_permutation_test(
            shared.community_month(spark, folder), ["platform", "community"], "toxicity_mean", pre
        )
    )


VIEW_SQL["regime_series"] = (("community_month", "ei_both"), """
    SELECT 'global' AS community, 'toxicity' AS metric, month, sum(toxicity_mean*active_users)/sum(active_users) AS v
      FROM community_month WHERE platform='focal' AND month >= '1996-04' GROUP BY month
    UNION ALL SELECT 'global', 'vader', month, sum(vader_mean*active_users)/sum(active_users) FROM community_month WHERE platform='focal' AND month >= '1996-04' GROUP BY month
    UNION ALL SELECT 'global', 'ei_index', month, avg(ei_index_event) FROM ei_both WHERE month >= '1996-04' GROUP BY month
    UNION ALL SELECT community, 'ei_index', month, ei_index_event FROM ei_both WHERE month >= '1996-04'""")


def regime_series(spark, folder):
    """Global toxicity, sentiment and E-I, and the E-I of every community, from the first event on."""
    first = ORDER_CALENDAR.days[0][:7]
    focal = shared.community_month(spark, folder).where(is_focal() & (F.col("month") >= first))
    weights = {"toxicity_mean": "active_users", "vader_mean": "active_users"}
    averaged = rollups.weighted_global_average(focal, weights, "active_users").select(
        "month", F.col("toxicity_mean").alias("toxicity"), F.col("vader_mean").alias("vader")
    )
    scores = averaged.unpivot(["month"], ["toxicity", "vader"], "metric", "v").withColumn("community", F.lit("global"))
    pairs, _, labelled = graph_checks.month_tables(spark, folder)
    ei = cut_lineage(graph.ei_index(pairs, labelled, ["community", "month"]).where(F.col("month") >= first))
    by_community = ei.select("community", "month", F.col("ei_index").alias("v"))
    overall = by_community.groupBy("month").agg(F.avg("v").alias("v")).withColumn("community", F.lit("global"))
    mixing = by_community.unionByName(overall).withColumn("metric", F.lit("ei_index"))
    return scores.unionByName(mixing)


REGIME_SQL = _permutation_sql("regime_series", "community, metric", "v", f"CAST(month||'-01' AS TIMESTAMP) < TIMESTAMP '{SPLIT}'", 10_000)


def regime_tests(spark, folder):
    pre = F.to_timestamp(F.concat("month", F.lit("-01"))) < F.lit(SPLIT).cast("timestamp")
    return inference.block_permutation_test(
        regime_series(spark, folder), ["community", "metric"], "v", pre
    )


@check("regime_permutation_tests", with_views("regime_series", body=REGIME_SQL))
def regime_permutation_tests(spark, folder):
    return rounded(regime_tests(spark, folder))


@check("benjamini_hochberg", with_views("regime_series", body=REGIME_SQL.replace("SELECT community, metric, round(a,6)", ", res AS (SELECT community, metric, round(a,6)") + """),
    k AS (SELECT *, count(p_value) OVER () AS m, row_number() OVER (ORDER BY p_value, community, metric) AS rk FROM res)
    SELECT x.community, x.metric, x.p_value, x.m AS n_tests, round(min(least(y.p_value*y.m/y.rk, 1.0)),6) AS p_fdr, min(least(y.p_value*y.m/y.rk, 1.0)) < 0.05 AS p_fdr_significant
    FROM k x JOIN k y ON y.rk >= x.rk GROUP BY x.community, x.metric, x.p_value, x.m"""))
def benjamini_hochberg(spark, folder):
    tests = rounded(regime_tests(spark, folder)).select("community", "metric", "p_value")
    return rounded(inference.benjamini_hochberg(tests, "p_value", ["community", "metric"]))


ITERATIONS = 40
FALLBACK_SQL = "CASE {b} " + " ".join(
    f"WHEN '{name}' THEN [{', '.join(repr(n) for n in near)}]" for name, near in inference.fallback_bins().items()
) + " END"
VIEW_SQL["matched"] = (("user_month_rep",), f"""
    WITH u AS (SELECT *, {BIN_SQL.format(n='activity_count')} AS bin FROM user_month_rep),
    tg AS (SELECT community, month, bin, count(*) AS tc FROM u WHERE platform='focal' GROUP BY ALL),
    sz AS (SELECT community, month, bin, count(*) AS n FROM u WHERE platform='reference' GROUP BY ALL),
    cand AS (SELECT community, month, bin, tc, unnest(l) AS cb, unnest(range(0, len(l))) AS pri FROM (SELECT *, {FALLBACK_SQL.format(b='bin')} AS l FROM tg)),
    ch AS (SELECT c.community, c.month, c.bin, any_value(tc) AS tc, arg_min(cb, pri) AS cb, arg_min(n, pri) AS n
      FROM cand c JOIN sz ON sz.community=c.community AND sz.month=c.month AND sz.bin=c.cb GROUP BY ALL),
    dr AS (SELECT community, month, cb, it, {draw_sql('n', "'2025'", 'community', 'month', 'bin', 'it', 'd')} + 1 AS place
      FROM (SELECT *, unnest(range(1, tc+1)) AS d FROM ch), range(0, {ITERATIONS}) q(it)),
    pl AS (SELECT *, row_number() OVER (PARTITION BY community, month, bin ORDER BY user_id) AS place FROM u WHERE platform='reference')
    SELECT dr.community, dr.month, dr.it AS iteration, count(*) AS sample_size, avg(mean_toxicity) AS toxicity_mean, avg(mean_vader) AS vader_mean,
      avg(mean_textblob) AS textblob_mean, avg(mean_subjectivity) AS subjectivity_mean, avg(mean_reputation) AS reputation_mean
    FROM dr JOIN pl ON pl.community=dr.community AND pl.month=dr.month AND pl.bin=dr.cb AND pl.place=dr.place GROUP BY ALL""")
VIEW_SQL["matched_long"] = (("matched",), """
    SELECT * FROM (SELECT community, month, iteration, sample_size, toxicity_mean, vader_mean, textblob_mean, subjectivity_mean, reputation_mean FROM matched)
      UNPIVOT INCLUDE NULLS (v FOR metric IN (toxicity_mean, vader_mean, textblob_mean, subjectivity_mean, reputation_mean))""")
METRICS = {
    "toxicity_mean": "mean_toxicity",
    "vader_mean": "mean_vader",
    "textblob_mean": "mean_textblob",
    "subjectivity_mean": "mean_subjectivity",
    "reputation_mean": "mean_reputation",
}


def matched(spark, folder, users=None, metrics=tuple(METRICS)):
    if users is None:
        users = cut_lineage(reputation_checks.user_month_with_reputation(spark, folder))
    wanted = {name: METRICS[name] for name in metrics}
    return inference.activity_matched_bootstrap(users.where(is_focal()), users.where(~is_focal()), wanted, ITERATIONS)


@check("activity_matched_bootstrap", with_views("matched_long", body="""
    SELECT community, month, CAST(iteration AS INTEGER) AS iteration, sample_size, metric, round(v,6) AS value FROM matched_long"""))
def activity_matched_bootstrap(spark, folder):
    return rounded(matched(spark, folder))


VIEW_SQL["bands"] = (("matched_long",), """
    SELECT community, month, metric, unnest([5,25,50,75,95]) AS percentile, unnest(quantile_cont(v, [0.05,0.25,0.5,0.75,0.95])) AS v
    FROM matched_long WHERE v IS NOT NULL GROUP BY community, month, metric""")


@check("bootstrap_percentiles", with_views("bands", body="SELECT community, month, metric, percentile, round(v,6) AS value FROM bands"))
def bootstrap_percentiles(spark, folder):
    return rounded(inference.bootstrap_percentiles(matched(spark, folder)))


VIEW_SQL["focal_wide"] = (("community_month", "bands"), """
    SELECT m.*, """ + ", ".join(
        f"max(b.v) FILTER (b.metric='{s}' AND percentile={p}) AS {s}_p{p}" for s in ("toxicity_mean", "vader_mean") for p in (5, 50, 95)) + """
    FROM (SELECT community, month, toxicity_mean, vader_mean, active_users FROM community_month WHERE platform='focal') m
    LEFT JOIN bands b USING (community, month) GROUP BY ALL""")


@check("attach_bootstrap_bands", with_views("focal_wide", body="""
    SELECT community, month, round(toxicity_mean,6) AS toxicity_mean, round(vader_mean,6) AS vader_mean, """ + ", ".join(
        f"round({s}_p{p},6) AS {s}_p{p}" for s in ("toxicity_mean", "vader_mean") for p in (5, 50, 95)) + " FROM focal_wide"))
def attach_bootstrap_bands(spark, folder):
    focal = shared.community_month(spark, folder).where(is_focal())
    summary = inference.bootstrap_percentiles(matched(spark, folder))
    monthly = focal.select("community", "month", "toxicity_mean", "vader_mean")
    return rounded(rollups.attach_bootstrap_bands(monthly, summary, ["toxicity_mean", "vader_mean"]))


VIEW_SQL["diffs"] = (("community_month_full", "bands"), """
    SELECT community, month, metric, round(f.v,9) AS focal_value, member_count, p5, p25, p50, p75, p95, round(f.v,9) - p50 AS d, member_count >= 20 AS valid
    FROM (SELECT * FROM (SELECT community, month, active_users AS member_count, toxicity_mean, vader_mean, textblob_mean, subjectivity_mean, reputation_mean FROM community_month_full WHERE platform='focal')
        UNPIVOT INCLUDE NULLS (v FOR metric IN (toxicity_mean, vader_mean, textblob_mean, subjectivity_mean, reputation_mean))) f
    JOIN (SELECT community, month, metric, """ + ", ".join(f"round(max(v) FILTER (percentile={p}),9) AS p{p}" for p in (5, 25, 50, 75, 95)) + """
      FROM bands GROUP BY ALL) USING (community, month, metric)""")
DIFF_METRICS = list(METRICS)


def monthly_values(spark, folder, platform, users=None):
    if users is None:
        users = reputation_checks.user_month_with_reputation(spark, folder)
    monthly = rollups.community_month_basic(users).where(F.col("platform") == platform)
    values = [F.round(m, 9).alias(m) for m in DIFF_METRICS]
    return monthly.select("community", "month", F.col("active_users").alias("member_count"), *values).unpivot(
        ["community", "month", "member_count"], DIFF_METRICS, "metric", "value"
    )


def diffs(spark, folder, platform="focal"):
    users = cut_lineage(reputation_checks.user_month_with_reputation(spark, folder))
    summary = inference.bootstrap_percentiles(matched(spark, folder, users)).withColumn("value", F.round("value", 9))
    return comparisons.monthly_diffs(monthly_values(spark, folder, platform, users), summary)


@check("monthly_diffs", with_views("diffs", body="""
    SELECT community, month, metric, round(focal_value,6) AS focal_value, member_count, """ + ", ".join(
        f"round(p{p},6) AS reference_p{p}" for p in (5, 25, 50, 75, 95)) + """, round(d,6) AS diff_focal_minus_median, valid AS valid_member_count FROM diffs"""))
def monthly_diffs(spark, folder):
    return rounded(diffs(spark, folder))


@check("periphery_exceedance", with_views("diffs", body="""
    , s AS (SELECT * FROM diffs WHERE valid UNION ALL SELECT * REPLACE ('ALL' AS community) FROM diffs WHERE valid)
    SELECT community, metric, count(*) AS months_available, count(*) FILTER (focal_value > p95) AS months_exceeding,
      round(count(*) FILTER (focal_value > p95)/count(*),6) AS share_exceeding, round(100.0*count(*) FILTER (focal_value > p95)/count(*),6) AS share_exceeding_percent
    FROM s GROUP BY ALL"""))
def periphery_exceedance(spark, folder):
    return rounded(comparisons.exceedance(diffs(spark, folder)))


@check("bootstrap_coverage", with_views("bands", "community_month_full", body="""
    , v AS (SELECT community, month, metric, round(f.v,9) AS v, p5, p25, p75, p95
    FROM (UNPIVOT (SELECT community, month, toxicity_mean, vader_mean, textblob_mean, subjectivity_mean, reputation_mean FROM community_month_full WHERE platform='reference') ON toxicity_mean, vader_mean, textblob_mean, subjectivity_mean, reputation_mean INTO NAME metric VALUE v) f
    JOIN (SELECT community, month, metric, """ + ", ".join(f"round(max(v) FILTER (percentile={p}),9) AS p{p}" for p in (5, 25, 75, 95)) + """
      FROM bands GROUP BY ALL) USING (community, month, metric)),
    s AS (SELECT * FROM v UNION ALL SELECT * REPLACE ('ALL' AS community) FROM v)
    SELECT community, metric, count(*) AS n_months, round(avg(CASE WHEN v BETWEEN p5 AND p95 THEN 1.0 ELSE 0 END),6) AS coverage_5_95,
      round(avg(CASE WHEN v BETWEEN p25 AND p75 THEN 1.0 ELSE 0 END),6) AS coverage_25_75 FROM s GROUP BY ALL"""))
def bootstrap_coverage(spark, folder):
    return rounded(comparisons.bootstrap_coverage(diffs(spark, folder, "reference")))


@check("combined_significance", with_views("diffs", body=f"""
    , z AS (SELECT *, d*2*1.6448536269514722/nullif(p95-p5,0) AS z FROM diffs),
    g AS (SELECT community, metric, count(d) AS n, avg(d) AS md, median(d) AS mm, avg(CASE WHEN d>0 THEN 1.0 ELSE 0 END) AS sp, sum(z)/sqrt(count(z)) AS sz FROM z GROUP BY ALL),
    p AS (SELECT *, {normal_p_sql('sz')} AS p FROM g),
    k AS (SELECT *, count(p) OVER () AS m, row_number() OVER (ORDER BY p, community, metric) AS rk FROM p),
    f AS (SELECT x.community, x.metric, min(least(y.p*y.m/y.rk,1.0)) AS fdr FROM k x JOIN k y ON y.rk >= x.rk GROUP BY ALL)
    SELECT community, metric, n AS n_months, round(md,6) AS mean_diff, round(mm,6) AS median_diff, round(sp,6) AS share_positive, round(sz,6) AS stouffer_z,
      round(p,6) AS p_value, round(least(p*m,1.0),6) AS p_value_bonferroni, round(fdr,6) AS p_value_fdr, fdr < 0.05 AS p_value_fdr_significant
    FROM k JOIN f USING (community, metric)"""))
def combined_significance(spark, folder):
    return rounded(comparisons.combined_significance(diffs(spark, folder)))


ANCHORS = list(zip(ORDER_CALENDAR.letters, [d[:7] for d in ORDER_CALENDAR.days]))
VIEW_SQL["placebo"] = (("diffs",), """
    SELECT community, metric, month, event, variant, strftime(anchor, '%Y-%m') AS anchor_month, CAST(datediff('month', anchor, CAST(month||'-01' AS DATE)) AS INTEGER) AS off, focal_value, d
    FROM diffs, (SELECT event, variant, CAST(CAST(m||'-01' AS DATE) - s * INTERVAL 1 MONTH AS DATE) AS anchor FROM
      (VALUES ('A','1996-04'),('B','1997-08'),('C','1999-03'),('D','2000-07')) e(event, m), (VALUES ('actual',0),('placebo',6)) v(variant, s))
    WHERE datediff('month', anchor, CAST(month||'-01' AS DATE)) BETWEEN -6 AND 12""")


@check("event_windows_placebo", with_views("placebo", body="""
    SELECT community, metric, month, event, variant AS event_variant, anchor_month, off AS "offset", round(focal_value,6) AS focal_value,
      round(d,6) AS diff_focal_minus_median FROM placebo"""))
def event_windows_placebo(spark, folder):
    return rounded(comparisons.event_windows_placebo(diffs(spark, folder), ANCHORS))


VIEW_SQL["significance"] = (("community_month",), """
    WITH l AS (UNPIVOT (SELECT community, platform, toxicity_mean, vader_mean, textblob_mean, subjectivity_mean FROM community_month)
      ON toxicity_mean, vader_mean, textblob_mean, subjectivity_mean INTO NAME metric VALUE v0),
    lr AS (SELECT community, platform, metric, round(v0, 9) AS v FROM l),
    r AS (SELECT *, rank() OVER (PARTITION BY community, metric ORDER BY v) + (count(*) OVER (PARTITION BY community, metric, v) - 1)/2.0 AS rk,
      count(*) OVER (PARTITION BY community, metric, v) AS ties FROM lr)
    SELECT community, metric, count(*) FILTER (platform='focal') AS n1, count(*) FILTER (platform='reference') AS n2,
      avg(v) FILTER (platform='focal') AS m1, avg(v) FILTER (platform='reference') AS m2, var_samp(v) FILTER (platform='focal') AS s1, var_samp(v) FILTER (platform='reference') AS s2,
      sum(rk) FILTER (platform='focal') AS w, sum(ties*ties-1) AS tie FROM r GROUP BY ALL""")


@check("platform_significance", with_views("significance", body=f"""
    , t AS (SELECT *, w - n1*(n1+1)/2.0 AS u, (m1-m2)/sqrt(s1/n1+s2/n2) AS t, pow(s1/n1+s2/n2,2)/(pow(s1/n1,2)/(n1-1)+pow(s2/n2,2)/(n2-1)) AS v,
      n1*n2/12.0*((n1+n2+1) - tie/((n1+n2)*(n1+n2-1.0))) AS var FROM significance),
    q AS (SELECT *, greatest((greatest(u, n1*n2-u) - n1*n2/2.0 - 0.5)/sqrt(var), 0.0) AS z FROM t)
    SELECT community, metric, n1 AS n_focal, n2 AS n_reference, round(m1,6) AS focal_mean, round(m2,6) AS reference_mean, round(t,6) AS t_statistic,
      round({student_p_sql('t', 'v')},6) AS t_p_value, round(u,6) AS u_statistic, round({normal_p_sql('z')},6) AS u_p_value,
      {student_p_sql('t', 'v')} < 0.05 AS significant FROM q"""))
def platform_significance(spark, folder):
    metrics = ["toxicity_mean", "vader_mean", "textblob_mean", "subjectivity_mean"]
    monthly = shared.community_month(spark, folder)
    values = monthly.select("platform", "community", "month", *[F.round(m, 9).alias(m) for m in metrics])
    return rounded(inference.platform_significance(values, metrics, "focal"))
