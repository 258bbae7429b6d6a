"""Checks of segmented regression and of the fixed-effect panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import breakpoints, graph, hubs, panel, rollups
from tideline.plans import shared
from tideline.plans.catalog import check, rounded
from tideline.plans.checks import graph_checks, reputation_checks
from tideline.plans.oracle_math import draw_sql, normal_p_sql
from tideline.plans.standins import ORDER_CALENDAR, VIEW_SQL, with_views
from tideline.session import cut_lineage

EVENT_MONTH = ORDER_CALENDAR.days[2][:7]
CUTOFF = f"{EVENT_MONTH}-01"
SERIES = ["metric", "community"]


def sse_sql(prefix: str = "") -> str:
    return f"regr_syy({prefix}y, {prefix}x) - coalesce(pow(regr_sxy({prefix}y, {prefix}x), 2)/nullif(regr_sxx({prefix}y, {prefix}x), 0), 0)"


# The metrics whose breaks are looked for.
BREAK_METRICS = ("toxicity_mean", "ei_index", "existing_gini", "reputation_mean", "degree_assortativity")
VIEW_SQL["assort_month"] = (("pairs_month", "deg_month"), """
    WITH e AS (SELECT q.community, q.month, x.degree AS da, y.degree AS db, a=b AS loop FROM pairs_month q
      JOIN deg_month x ON x.community=q.community AND x.month=q.month AND x.node=a JOIN deg_month y ON y.community=q.community AND y.month=q.month AND y.node=b)
    SELECT community, month, CASE WHEN stddev_pop(da)>0 THEN corr(da, db) END AS degree_assortativity
    FROM (SELECT community, month, da, db FROM e UNION ALL SELECT community, month, db, da FROM e WHERE NOT loop) GROUP BY ALL""")
VIEW_SQL["metric_series"] = (("community_month_full", "ei_both", "dynamics", "assort_month"), f"""
    WITH wide AS (SELECT community, month, toxicity_mean, ei_index_event AS ei_index, existing_gini, reputation_mean, degree_assortativity
      FROM (SELECT * FROM community_month_full WHERE platform='focal') LEFT JOIN ei_both USING (community, month)
      LEFT JOIN dynamics USING (community, month) LEFT JOIN assort_month USING (community, month)),
    long AS (UNPIVOT wide ON {", ".join(BREAK_METRICS)} INTO NAME metric VALUE v)
    SELECT metric, community, month, round(v, 9) AS y FROM long
    UNION ALL SELECT metric, 'global', month, round(avg(v), 9) FROM long GROUP BY metric, month""")
VIEW_SQL["points"] = (("metric_series",), """
    SELECT metric, community, month, y, CAST(month[1:4] AS INTEGER)*12 + CAST(month[6:7] AS INTEGER) AS x,
      row_number() OVER (PARTITION BY metric, community ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY metric, community) AS n FROM metric_series""")


def metric_months(spark, folder):
    """The five metrics of every focal community, and of all of them together."""
    keys = ["community", "month"]
    users = reputation_checks.user_month_with_reputation(spark, folder)
    focal = rollups.community_month_basic(users).where(F.col("platform") == "focal").drop("platform")
    pairs, nodes, labelled = graph_checks.month_tables(spark, folder)
    ends = graph.edge_ends(pairs, labelled, keys)
    parts = [
        hubs.degree_dynamics(pairs, labelled, keys).select(*keys, "existing_gini"),
        graph.ei_index(pairs, labelled, keys, ends=ends).select(*keys, "ei_index"),
        graph.degree_assortativity(pairs, nodes, keys, ends=ends),
    ]
    stacked = breakpoints.metric_series(rollups.left_join_all(focal, parts, keys), BREAK_METRICS)
    # Breaks are chosen by comparing sums of squares, so both sides see the values to nine digits.
    return cut_lineage(stacked.withColumn("value", F.round("value", 9)))


def _break_view(points: str, keys: str) -> str:
    """The best break by fitting both sides of every candidate anew."""
    return f"""
    SELECT {keys}, any_value(n) AS n, min({{sse}}) AS sse, arg_min(i, {{sse}}) AS i, arg_min(month, {{sse}}) AS month, arg_min(s1, {{sse}}) AS s1, arg_min(s2, {{sse}}) AS s2,
      arg_min(i1, {{sse}}) AS i1, arg_min(i2, {{sse}}) AS i2
    FROM (SELECT c.{keys.replace(', ', ', c.')}, c.i, c.month, c.n,
        coalesce(regr_syy(p.y, p.x) FILTER (p.i < c.i) - pow(regr_sxy(p.y, p.x) FILTER (p.i < c.i), 2)/(regr_sxx(p.y, p.x) FILTER (p.i < c.i)), 0)
        + coalesce(regr_syy(p.y, p.x) FILTER (p.i >= c.i) - pow(regr_sxy(p.y, p.x) FILTER (p.i >= c.i), 2)/(regr_sxx(p.y, p.x) FILTER (p.i >= c.i)), 0) AS total,
        regr_slope(p.y, p.x) FILTER (p.i < c.i) AS s1, regr_slope(p.y, p.x) FILTER (p.i >= c.i) AS s2,
        regr_intercept(p.y, p.x) FILTER (p.i < c.i) AS i1, regr_intercept(p.y, p.x) FILTER (p.i >= c.i) AS i2
      FROM {points} c JOIN {points} p USING ({keys}) WHERE c.n >= 14 AND c.i >= 6 AND c.i <= c.n - 6
      GROUP BY ALL) GROUP BY {keys}""".replace("{sse}", "total")


VIEW_SQL["best"] = (("points",), _break_view("points", "metric, community"))
VIEW_SQL["single"] = (("points",), f"SELECT metric, community, {sse_sql()} AS sse0, regr_slope(y, x) AS s0 FROM points WHERE n >= 14 GROUP BY ALL")
VIEW_SQL["breaks"] = (("best", "single"), "SELECT *, sse/nullif(sse0,0) AS sse_ratio FROM best JOIN single USING (metric, community)")
BREAK_COLUMNS_SQL = """CAST(n AS INTEGER) AS n_obs, month AS break_month, round(s1,6) AS pre_slope, round(s2,6) AS post_slope, round(sse_ratio,6) AS sse_ratio"""


@check("segmented_regression_1break", with_views("breaks", body=f"SELECT metric, community, {BREAK_COLUMNS_SQL} FROM breaks"))
def segmented_regression_1break(spark, folder):
    return rounded(breakpoints.segmented_regression_1break(metric_months(spark, folder), SERIES, "value"))


VIEW_SQL["fitted"] = (("points", "best"), """
    SELECT *, r0 - avg(r0) OVER (PARTITION BY metric, community) AS r FROM (
      SELECT p.metric, p.community, p.month, p.x, p.i, p.n, CASE WHEN p.i < b.i THEN b.i1 + b.s1*p.x ELSE b.i2 + b.s2*p.x END AS f,
        p.y - CASE WHEN p.i < b.i THEN b.i1 + b.s1*p.x ELSE b.i2 + b.s2*p.x END AS r0
      FROM points p JOIN best b USING (metric, community))""")
VIEW_SQL["redrawn"] = (("fitted",), f"""
    SELECT d.metric, d.community, d.rep, d.month, d.x, d.i, d.n, d.f + q.r AS y FROM (
      SELECT *, {draw_sql('n', "'2025'", 'metric', 'community', 'rep', 'i')} AS j FROM fitted, range(0, 200) z(rep)) d
    JOIN fitted q ON q.metric=d.metric AND q.community=d.community AND q.i=d.j""")
VIEW_SQL["again"] = (("redrawn",), _break_view("redrawn", "metric, community, rep"))
VIEW_SQL["intervals"] = (("again", "best"), """
    SELECT metric, community, list_sort(list(a.month)) AS l, avg(CASE WHEN abs(datediff('month', CAST(a.month||'-01' AS DATE), CAST(b.month||'-01' AS DATE))) <= 3 THEN 1.0 ELSE 0 END) AS st
    FROM again a JOIN best b USING (metric, community) GROUP BY ALL""")


@check("break_bootstrap", with_views("breaks", "intervals", body=f"""
    SELECT metric, community, {BREAK_COLUMNS_SQL}, l[CAST(floor(0.05*(len(l)-1)) AS INTEGER)+1] AS ci_low_month,
      l[CAST(floor(0.95*(len(l)-1)) AS INTEGER)+1] AS ci_high_month, round(st,6) AS bootstrap_stability FROM breaks JOIN intervals USING (metric, community)"""))
def break_bootstrap(spark, folder):
    return rounded(breakpoints.break_bootstrap(metric_months(spark, folder), SERIES, "value"))


DISTANCE_SQL = f"CAST(abs(datediff('month', CAST(month||'-01' AS DATE), DATE '{CUTOFF}')) AS INTEGER)"


def distances(spark, folder):
    found = breakpoints.segmented_regression_1break(metric_months(spark, folder), SERIES, "value")
    return breakpoints.break_event_distance(found, EVENT_MONTH)


@check("break_event_distance", with_views("breaks", body=f"""
    SELECT metric, community, {BREAK_COLUMNS_SQL}, {DISTANCE_SQL} AS dist_to_event_months, {DISTANCE_SQL} <= 3 AS near_event FROM breaks"""))
def break_event_distance(spark, folder):
    return rounded(distances(spark, folder))


@check("break_summary", with_views("breaks", body=f"""
    SELECT metric, count(*) AS n_series, count(*) FILTER ({DISTANCE_SQL} <= 3) AS n_near_event, array_to_string(list_sort(list(DISTINCT month)), ', ') AS break_months,
      round(median(sse_ratio),6) AS median_sse_ratio FROM breaks GROUP BY metric"""))
def break_summary(spark, folder):
    return rounded(breakpoints.break_summary(distances(spark, folder), ["metric"]))


@check("strongest_breaks", with_views("breaks", body="""
    SELECT metric, community, month AS break_month, round(sse_ratio,6) AS sse_ratio FROM breaks ORDER BY sse_ratio LIMIT 8"""))
def strongest_breaks(spark, folder):
    found = breakpoints.strongest_breaks(distances(spark, folder))
    return rounded(found.select("metric", "community", "break_month", "sse_ratio"))


VIEW_SQL["two"] = (("points",), """
    WITH seg AS (SELECT a.metric, a.community, a.i AS lo, b.i + 1 AS hi, a.n, a.month,
        regr_syy(p.y, p.x) - pow(regr_sxy(p.y, p.x),2)/regr_sxx(p.y, p.x) AS sse, regr_slope(p.y, p.x) AS slope
      FROM points a JOIN points b USING (metric, community) JOIN points p USING (metric, community)
      WHERE b.i - a.i >= 5 AND p.i BETWEEN a.i AND b.i AND a.n >= 14 GROUP BY ALL),
    pairs AS (SELECT s1.metric, s1.community, s1.n, s2.month AS m1, s3.month AS m2, s1.sse + s2.sse + s3.sse AS sse, s1.slope AS a, s2.slope AS b, s3.slope AS c, s2.lo AS l2, s3.lo AS l3
      FROM seg s1 JOIN seg s2 ON s2.metric=s1.metric AND s2.community=s1.community AND s2.lo=s1.hi
      JOIN seg s3 ON s3.metric=s1.metric AND s3.community=s1.community AND s3.lo=s2.hi AND s3.hi=s1.n WHERE s1.lo=0)
    SELECT metric, community, any_value(n) AS n, min(sse) AS sse, arg_min(m1||';'||m2, (sse, l2, l3)) AS months, arg_min(a, (sse, l2, l3)) AS a, arg_min(b, (sse, l2, l3)) AS b, arg_min(c, (sse, l2, l3)) AS c
    FROM pairs GROUP BY ALL""")
VIEW_SQL["models"] = (("two", "breaks"), """
    WITH m AS (SELECT metric, community, 0 AS nb, n, NULL::VARCHAR AS months, sse0 AS sse, s0 AS a, NULL::DOUBLE AS b, NULL::DOUBLE AS c FROM breaks
      UNION ALL SELECT metric, community, 1, n, month, sse, s1, s2, NULL FROM breaks UNION ALL SELECT metric, community, 2, n, months, sse, a, b, c FROM two),
    k AS (SELECT *, 3*nb+2 AS k, n*ln(sse/n) AS fit FROM m), s AS (SELECT *, fit + k*ln(n) AS bic, fit + 2*k + 2.0*k*(k+1)/(n-k-1) AS aicc FROM k)
    SELECT *, bic - max(bic) FILTER (nb=0) OVER w AS db, nb = arg_min(nb, bic) OVER w AS sel FROM s WINDOW w AS (PARTITION BY metric, community)""")


@check("regime_model_comparison", with_views("models", body=f"""
    , d AS (SELECT metric, community, nb, min(abs(datediff('month', CAST(x||'-01' AS DATE), DATE '{CUTOFF}'))) AS dist
      FROM (SELECT metric, community, nb, unnest(string_split(months, ';')) AS x FROM models) GROUP BY ALL)
    SELECT metric, community, nb AS n_breaks, CAST(n AS INTEGER) AS n_obs, months AS break_months, round(sse,6) AS sse, round(sqrt(sse/n),6) AS rmse,
      round(bic,6) AS bic, round(aicc,6) AS aicc, round(db,6) AS delta_bic_vs_no_break, sel AS bic_selected, CAST(dist AS INTEGER) AS dist_to_event_months,
      coalesce(dist <= 3, false) AS near_event, round(a,6) AS slope_1, round(b,6) AS slope_2, round(c,6) AS slope_3
    FROM models LEFT JOIN d USING (metric, community, nb)"""))
def regime_model_comparison(spark, folder):
    return rounded(breakpoints.regime_model_comparison(metric_months(spark, folder), SERIES, "value", EVENT_MONTH))


def community_panel(spark, folder):
    """Focal toxicity with newcomer share and E-I of the same community and month."""
    keys = ["community", "month"]
    focal = shared.community_month(spark, folder).where(F.col("platform") == "focal").drop("platform")
    pairs, _, labelled = graph_checks.month_tables(spark, folder)
    share = hubs.degree_dynamics(pairs, labelled, keys).select(*keys, "newcomer_pop_share")
    mixing = graph.ei_index(pairs, labelled, keys).select(*keys, "ei_index")
    return rollups.left_join_all(focal, [share, mixing], keys)


@check("join_panel", with_views("community_month", "dynamics", "ei_both", body="""
    SELECT community, month, active_users, round(toxicity_mean,6) AS toxicity_mean, round(newcomer_pop_share,6) AS newcomer_pop_share, round(ei_index_event,6) AS ei_index
    FROM (SELECT * FROM community_month WHERE platform='focal') LEFT JOIN dynamics USING (community, month) LEFT JOIN ei_both USING (community, month)"""))
def join_panel(spark, folder):
    panel_ = community_panel(spark, folder)
    return rounded(panel_.select("community", "month", "active_users", "toxicity_mean", "newcomer_pop_share", "ei_index"))


VIEW_SQL["panel_raw"] = (("community_month", "dynamics", "ei_both"), """
    SELECT community, month, toxicity_mean, vader_mean, newcomer_pop_share AS s, ei_index_event AS ei_index, CAST(month >= '1999-03' AS INTEGER) AS post
    FROM (SELECT * FROM community_month WHERE platform='focal') LEFT JOIN dynamics USING (community, month) LEFT JOIN ei_both USING (community, month)""")


TERMS = panel.TERMS


def panel_views(rows: str) -> str:
    """The model solved by taking the other columns out of each in turn, without matrices.

    ``rows`` gives outcome, g (community), y, s (share), post and t (month number).
    """
    parts = [
        f"pr AS MATERIALIZED ({rows})",
        "pc AS (SELECT outcome, g, y AS y0, s AS m0, CAST(post AS DOUBLE) AS m1, s*post AS m2, CAST(t AS DOUBLE) AS m3 FROM pr WHERE y IS NOT NULL AND s IS NOT NULL)",
        "dm AS (SELECT outcome, g, y0 - avg(y0) OVER w AS y, " + ", ".join(f"m{i} - avg(m{i}) OVER w AS x{i}" for i in range(4))
        + " FROM pc WINDOW w AS (PARTITION BY outcome, g))",
    ]
    for k in range(4):
        order = [i for i in range(4) if i != k] + [k]
        source = "dm"
        for j, column in enumerate(order):
            taken = "".join(f" - q{i}*sum(x{column}*q{i}) OVER o/nullif(sum(q{i}*q{i}) OVER o,0)" for i in range(j))
            parts.append(f"c{k}{j} AS (SELECT *, x{column}{taken} AS q{j} FROM {source} WINDOW o AS (PARTITION BY outcome))")
            source = f"c{k}{j}"
        rest = "".join(f" - q{i}*sum(y*q{i}) OVER o/nullif(sum(q{i}*q{i}) OVER o,0)" for i in range(4))
        parts.append(f"u{k} AS (SELECT *, y{rest} AS u FROM {source} WINDOW o AS (PARTITION BY outcome))")
    parts.append("pg AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT outcome, g, {k} AS k, sum(y*q3) AS yq, sum(q3*q3) AS qq, sum(q3*u) AS sc, sum(u*u) AS uu, count(*) AS n FROM u{k} GROUP BY outcome, g"
        for k in range(4)) + ")")
    parts += [
        "fx AS (SELECT outcome, k, sum(yq)/sum(qq) AS coef, sum(qq) AS qq, sum(uu) AS ssr, CAST(sum(n) AS BIGINT) AS n, count(*) AS gs, "
        "CASE WHEN count(*) > 1 AND sum(n) > count(*) + 5 THEN count(*)/(count(*)-1)*((sum(n)-1)/(sum(n)-count(*)-4)) ELSE 1 END AS adj, sqrt(sum(sc*sc))/sum(qq) AS raw FROM pg GROUP BY outcome, k)",
        "tot AS (SELECT outcome, var_pop(y0)*count(*) AS sst FROM pc GROUP BY outcome)",
        "slopes AS (SELECT outcome, CASE k " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TERMS))
        + " END AS term, coef, raw*sqrt(adj) AS se, 1 - ssr/sst AS r2, n, gs FROM fx JOIN tot USING (outcome))",
    ]
    return ", ".join(parts)


SLOPES_SQL = f"""outcome, term, round(coef,6) AS coef, round(se,6) AS se_cluster, round(r2,6) AS r2, n AS n_obs, gs AS n_clusters,
      round(coef/nullif(se,0),6) AS t_stat, round({normal_p_sql('(coef/nullif(se,0))')},6) AS p_value_norm"""
_ROWS_SQL = """SELECT outcome, community AS g, y, s, post, CAST(month[1:4] AS INTEGER)*12 + CAST(month[6:7] AS INTEGER) AS t FROM (
      SELECT 'toxicity_mean' AS outcome, community, month, toxicity_mean AS y, s, post FROM panel_raw{more})"""
_EI_SQL = " UNION ALL SELECT 'ei_index', community, month, ei_index, s, post FROM panel_raw"
EFFECTS_SQL = """
    fd AS (SELECT outcome, g, avg(y0) AS y, avg(m0) AS m0, avg(m1) AS m1, avg(m2) AS m2, avg(m3) - min(min(m3)) OVER (PARTITION BY outcome) AS m3 FROM pc GROUP BY outcome, g),
    fb AS (SELECT * FROM fd QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY g) = 1),
    fr AS (SELECT d.outcome, d.g, d.g = b.g AS base, d.y - CASE WHEN d.g = b.g THEN 0 ELSE b.y END AS y, unnest([0,1,2,3]) AS k,
      unnest([d.m0 - CASE WHEN d.g=b.g THEN 0 ELSE b.m0 END, d.m1 - CASE WHEN d.g=b.g THEN 0 ELSE b.m1 END, d.m2 - CASE WHEN d.g=b.g THEN 0 ELSE b.m2 END,
        d.m3 - CASE WHEN d.g=b.g THEN 0 ELSE b.m3 END]) AS d FROM fd d JOIN fb b USING (outcome)),
    fv AS (SELECT outcome, g, sum(v*v) AS v FROM (SELECT fr.outcome, fr.g, pg.g AS h, sum(fr.d*pg.sc/fx.qq) AS v FROM fr JOIN pg ON pg.outcome=fr.outcome AND pg.k=fr.k
      JOIN fx ON fx.outcome=fr.outcome AND fx.k=fr.k GROUP BY ALL) GROUP BY ALL),
    fe AS (SELECT fr.outcome, CASE WHEN any_value(base) THEN 'intercept' ELSE 'fe_' || fr.g END AS term, any_value(y) - sum(d*coef) AS coef, sqrt(any_value(v)*any_value(adj)) AS se
      FROM fr JOIN fx USING (outcome, k) JOIN fv ON fv.outcome=fr.outcome AND fv.g=fr.g GROUP BY fr.outcome, fr.g)"""


@check("panel_fe_cluster_ols", with_views("panel_raw", body=f", {panel_views(_ROWS_SQL.format(more=''))} SELECT {SLOPES_SQL} FROM slopes"))
def panel_fe_cluster_ols(spark, folder):
    return rounded(panel.panel_fe_cluster_ols(community_panel(spark, folder), "toxicity_mean", CUTOFF))


@check("panel_models", with_views("panel_raw", body=f""", {panel_views(_ROWS_SQL.format(more=_EI_SQL))},
    ds AS (SELECT outcome, avg(y) FILTER (post=0) AS a, avg(y) FILTER (post=1) AS b, avg(s) FILTER (post=0) AS c, avg(s) FILTER (post=1) AS d FROM pr WHERE y IS NOT NULL AND s IS NOT NULL GROUP BY outcome)
    SELECT {SLOPES_SQL}, round(a,6) AS pre_outcome_mean, round(b,6) AS post_outcome_mean, round(c,6) AS pre_share_mean, round(d,6) AS post_share_mean,
      round(max(coef) FILTER (term='newcomer_pop_share') OVER (PARTITION BY outcome),6) AS implied_effect_pre,
      round(max(coef) FILTER (term='newcomer_pop_share') OVER (PARTITION BY outcome) + max(coef) FILTER (term='newcomer_x_post') OVER (PARTITION BY outcome),6) AS implied_effect_post
    FROM slopes JOIN ds USING (outcome)"""))
def panel_models(spark, folder):
    return rounded(panel.panel_models(community_panel(spark, folder), ["toxicity_mean", "ei_index"], CUTOFF))


@check("panel_descriptives", with_views("panel_raw", body="""
    , l AS (SELECT 'toxicity_mean' AS outcome, toxicity_mean AS y, s, post FROM panel_raw UNION ALL SELECT 'ei_index', ei_index, s, post FROM panel_raw)
    SELECT outcome, round(avg(y) FILTER (post=0),6) AS pre_outcome_mean, round(avg(y) FILTER (post=1),6) AS post_outcome_mean,
      round(avg(s) FILTER (post=0),6) AS pre_share_mean, round(avg(s) FILTER (post=1),6) AS post_share_mean FROM l WHERE y IS NOT NULL AND s IS NOT NULL GROUP BY outcome"""))
def panel_descriptives(spark, folder):
    fit = panel.PanelFit(community_panel(spark, folder), ["toxicity_mean", "ei_index"], CUTOFF)
    return rounded(fit.descriptives().drop("implied_effect_pre", "implied_effect_post"))
