"""Checks of the reputation model and of the tables made from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import labels
from tideline.operators import cohorts, core_periphery, ranking, reputation, reputation_periods, rollups
from tideline.operators.reputation import ReputationModel
from tideline.plans import shared, standins
from tideline.plans.catalog import check, rounded
from tideline.plans.standins import VIEW_SQL, with_views
from tideline.session import cut_lineage, fresh_folder

MODEL = ReputationModel(beta=0.96, alpha=2.0, base=1.0)
COMPOUNDING = ReputationModel(beta=0.96, alpha=2.0, base=1.0, compounding=True)
SCOPE = "platform, community"


def _register_views(stem: str, source: str, compounding: bool) -> None:
    """The model over single activities: running sums of grown gains, with no per-day step."""
    exponent = "dt + g*(g+1)/2.0 + g*(1-off0)" if compounding else "dt"
    idle = "i*(i+1)/2.0 + i*(1-off)" if compounding else "i+1-off"
    VIEW_SQL[f"{stem}_steps"] = ((source,), f"""
      SELECT *, x - day AS off, lag(x) OVER w AS x0, lag(day) OVER w AS day0,
        row_number() OVER w AS k
      FROM (SELECT {SCOPE}, user_id, post_id, t_min, t_max, (t - t_min)/86400.0 AS x, CAST(floor((t - t_min)/86400.0) AS INTEGER) AS day
        FROM (SELECT *, epoch(ts) AS t, min(epoch(ts)) OVER (PARTITION BY {SCOPE}) AS t_min, max(epoch(ts)) OVER (PARTITION BY {SCOPE}) AS t_max FROM {source}))
      WINDOW w AS (PARTITION BY {SCOPE}, user_id ORDER BY x, post_id)""")
    VIEW_SQL[f"{stem}_runs"] = ((f"{stem}_steps",), f"""
      SELECT *, coalesce({exponent}, 0) AS e, sum(CASE WHEN day - day0 <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY {SCOPE}, user_id ORDER BY k) AS run
      FROM (SELECT *, x - x0 AS dt, greatest(day - day0 - 1, 0) AS g, x0 - day0 AS off0 FROM {stem}_steps)""")
    VIEW_SQL[f"{stem}_values"] = ((f"{stem}_runs",), f"""
      SELECT *, exp(-l*se) * sum((3 - 2.0/(a+1))*exp(l*se)) OVER (PARTITION BY {SCOPE}, user_id ORDER BY k) AS r
      FROM (SELECT *, -ln(0.96) AS l, sum(e) OVER (PARTITION BY {SCOPE}, user_id ORDER BY k) AS se,
          row_number() OVER (PARTITION BY {SCOPE}, user_id, run ORDER BY k) AS a FROM {stem}_runs)""")
    VIEW_SQL[stem] = ((f"{stem}_values",), f"""
      SELECT *, lead(day) OVER (PARTITION BY {SCOPE}, user_id ORDER BY day) AS next_day
      FROM (SELECT {SCOPE}, user_id, day, arg_max(off, k) AS off, arg_max(r, k) AS r, max(a) AS a, any_value(t_min) AS t_min, any_value(t_max) AS t_max
        FROM {stem}_values GROUP BY {SCOPE}, user_id, day)""")
    VIEW_SQL[f"{stem}_daily"] = ((stem,), f"""
      SELECT {SCOPE}, user_id, CAST(day + i AS INTEGER) AS day, CASE WHEN i = 0 THEN r ELSE r*exp(ln(0.96)*({idle})) END AS reputation,
        CAST(make_timestamp(CAST(floor((t_min + (day+i)*86400.0)*1000000) AS BIGINT)) AS DATE) AS date, t_min, t_max
      FROM (SELECT *, unnest(range(0, coalesce(next_day, CAST(floor((t_max-t_min)/86400.0) AS INTEGER)+1) - day)) AS i FROM {stem})""")


_register_views("rep_events", "event_activity", False)
_register_views("rep_events_c", "event_activity", True)
_register_views("rep_orders", "activity", False)

VIEW_SQL["rep_user_month"] = (("rep_orders_daily",), """
    SELECT platform, community, user_id, strftime(date, '%Y-%m') AS month, avg(reputation) AS mean_reputation, count(*) AS active_days
    FROM rep_orders_daily WHERE reputation >= 1 GROUP BY ALL""")
VIEW_SQL["user_month_rep"] = (("user_month", "rep_user_month"), """
    SELECT u.*, r.mean_reputation, coalesce(r.active_days, 0) AS active_days
    FROM user_month u LEFT JOIN rep_user_month r USING (platform, community, user_id, month)""")


def order_events(spark, folder):
    return reputation.reputation_events(standins.activity(spark, folder), MODEL)


def order_days(spark, folder):
    return reputation.with_month(reputation.reputation_daily(order_events(spark, folder), MODEL, at_least=1.0))


def user_month_with_reputation(spark, folder, days=None):
    monthly = rollups.reputation_user_month(order_days(spark, folder) if days is None else days)
    return rollups.join_user_month_reputation(shared.user_month(spark, folder), monthly)


@check("sort_user_time", with_views("event_activity", body="""
    SELECT platform, community, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM event_activity"""))
def sort_user_time(spark, folder):
    ordered = reputation.sort_user_time(standins.event_activity(spark, folder))
    return ordered.select("platform", "community", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@check("gaps_and_islands", with_views("rep_events_runs", body="""
    SELECT platform, community, user_id, CAST(run AS INTEGER) AS run, min(day) AS first_day, max(day) AS last_day,
      count(DISTINCT day) AS active_days, count(*) AS n_events FROM rep_events_runs GROUP BY platform, community, user_id, run"""))
def gaps_and_islands(spark, folder):
    return reputation.activity_runs(reputation.on_scope_clock(standins.event_activity(spark, folder)))


def _events_query(model):
    def query(spark, folder):
        events = reputation.reputation_events(standins.event_activity(spark, folder), model)
        return rounded(
            events.select("platform", "community", "user_id", "day", "run_events", "day_fraction", "next_day", "reputation")
        )

    return query


def _daily_query(model):
    def query(spark, folder):
        events = reputation.reputation_events(standins.event_activity(spark, folder), model)
        return rounded(
            reputation.reputation_daily(events, model).select(
                "platform", "community", "user_id", "day", F.date_format("date", "yyyy-MM-dd").alias("date"), "reputation"
            )
        )

    return query


for _name, _stem, _model in (("", "rep_events", MODEL), ("_compounding", "rep_events_c", COMPOUNDING)):
    check(f"reputation_events{_name}", with_views(_stem, body=f"""
        SELECT platform, community, user_id, day, a AS run_events, round(off,6) AS day_fraction, next_day, round(r,6) AS reputation
        FROM {_stem}"""))(_events_query(_model))
    check(f"reputation_daily{_name}", with_views(f"{_stem}_daily", body=f"""
        SELECT platform, community, user_id, day, CAST(date AS VARCHAR) AS date, round(reputation,6) AS reputation
        FROM {_stem}_daily"""))(_daily_query(_model))


@check("reputation_batch", with_views("rep_orders_daily", body="""
    SELECT platform, community, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, round(sum(reputation),3) AS total
    FROM rep_orders_daily GROUP BY ALL"""))
def reputation_batch(spark, folder):
    """The dense table of all scopes in one job, summed up."""
    daily = reputation.reputation_daily(order_events(spark, folder), MODEL)
    per_user = daily.groupBy("platform", "community", "user_id").agg(
        F.count("*").alias("_n"), F.sum("reputation").alias("_r")
    )
    return per_user.groupBy("platform", "community").agg(
        F.sum("_n").alias("n_rows"), F.count("*").alias("n_users"), F.round(F.sum("_r"), 3).alias("total")
    )


@check("reputation_by_period", with_views("rep_orders", body="""
    SELECT platform, community, user_id, day, a AS run_events, round(off,6) AS day_fraction, next_day, round(r,6) AS reputation
    FROM rep_orders"""))
def reputation_by_period(spark, folder):
    """All months but three in one run; then each of the three from its own rows and the last summaries."""
    orders = standins.activity(spark, folder).withColumn("period", F.col("month"))
    months = sorted(r["month"] for r in orders.select("month").distinct().collect())
    store = reputation_periods.ReputationStore(spark, fresh_folder(spark, "reputation"), MODEL)
    ends = months[-4:] if len(months) > 3 else months[-1:]
    after = ""
    for end in ends:
        store.append(orders.where((F.col("month") > after) & (F.col("month") <= end)), end)
        after = end
    return rounded(
        store.events().select("platform", "community", "user_id", "day", "run_events", "day_fraction", "next_day", "reputation")
    )


@check("reputation_user_month", with_views("rep_user_month", body="""
    SELECT platform, community, user_id, month, round(mean_reputation,6) AS mean_reputation, active_days FROM rep_user_month"""))
def reputation_user_month(spark, folder):
    return rounded(rollups.reputation_user_month(order_days(spark, folder)))


@check("join_user_month_reputation", with_views("user_month_rep", body="""
    SELECT platform, community, user_id, month, activity_count, round(mean_toxicity,6) AS mean_toxicity,
      round(mean_reputation,6) AS mean_reputation, active_days FROM user_month_rep"""))
def join_user_month_reputation(spark, folder):
    joined = user_month_with_reputation(spark, folder)
    keys = ["platform", "community", "user_id", "month", "activity_count", "mean_toxicity"]
    return rounded(joined.select(*keys, "mean_reputation", "active_days"))


STEMS = ("toxicity", "vader", "textblob", "subjectivity", "reputation")
VIEW_SQL["community_month_full"] = (("user_month_rep",), """
    SELECT platform, community, month, count(DISTINCT user_id) AS active_users, CAST(sum(activity_count) AS BIGINT) AS total_activity,
      count(DISTINCT CASE WHEN mean_reputation > 1 THEN user_id END) AS rep_active_users, """ + ", ".join(
        f"avg(mean_{s}) AS {s}_mean, median(mean_{s}) AS {s}_median, stddev_samp(mean_{s}) AS {s}_std" for s in STEMS) + """
    FROM user_month_rep GROUP BY ALL""")


@check("community_month_aggregates", with_views("community_month_full", body="""
    SELECT platform, community, month, active_users, total_activity, rep_active_users, """ + ", ".join(
        f"round({s}_{p},6) AS {s}_{p}" for s in STEMS for p in ("mean", "median", "std")) + """ FROM community_month_full"""))
def community_month_aggregates(spark, folder):
    return rounded(rollups.community_month_aggregates(user_month_with_reputation(spark, folder)))


@check("daily_reputation_mean", with_views("rep_events_daily", body="""
    SELECT platform, community, day, count(*) FILTER (reputation>=1) AS n_users,
      round(coalesce(sum(reputation) FILTER (reputation>=1)/nullif(count(*) FILTER (reputation>=1),0),0.0),6) AS mean_reputation
    FROM rep_events_daily GROUP BY ALL"""))
def daily_reputation_mean(spark, folder):
    events = reputation.reputation_events(standins.event_activity(spark, folder), MODEL)
    daily = reputation.reputation_daily(events, MODEL, at_least=1.0)
    bounds = reputation.day_bounds(events, ["platform", "community"])
    return rounded(reputation.daily_reputation_mean(daily, bounds))


PROFILES_SQL = """profiles AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, 1380000000 + (c_custkey*104729) % 180000000 AS registered
      FROM customer WHERE c_mktsegment <> 'BUILDING'),
    grouped AS (SELECT *, CAST(CASE WHEN registered < 1399593600 THEN 1 WHEN registered < 1433558400 THEN 2
      WHEN registered < 1479840000 THEN 3 WHEN registered < 1521081600 THEN 4 ELSE 5 END AS INTEGER) AS registration_group FROM profiles)"""


def all_profiles(spark, folder):
    registered = 1380000000 + (F.col("c_custkey") * 104729) % 180000000
    return standins.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"), registered.alias("registered"), "c_mktsegment"
    )


def profiles(spark, folder):
    """Some users have no profile."""
    return all_profiles(spark, folder).where(F.col("c_mktsegment") != "BUILDING").drop("c_mktsegment")


@check("join_profiles", with_views("rep_events", body="," + PROFILES_SQL + """
    SELECT platform, community, user_id, day, registration_group, round(r,6) AS reputation FROM rep_events JOIN grouped USING (user_id)"""))
def join_profiles(spark, folder):
    events = reputation.reputation_events(standins.event_activity(spark, folder), MODEL)
    group = labels.registration_group(F.col("registered"))
    joined = reputation.join_profiles(events, profiles(spark, folder), group)
    return rounded(joined.select("platform", "community", "user_id", "day", "registration_group", "reputation"))


@check("daily_reputation_mean_by_group", with_views("rep_events_daily", body="," + PROFILES_SQL + """
    SELECT platform, community, registration_group, day, count(*) FILTER (reputation>=1) AS n_users,
      round(coalesce(sum(reputation) FILTER (reputation>=1)/nullif(count(*) FILTER (reputation>=1),0),0.0),6) AS mean_reputation
    FROM rep_events_daily JOIN grouped USING (user_id) GROUP BY ALL"""))
def daily_reputation_mean_by_group(spark, folder):
    events = reputation.reputation_events(standins.event_activity(spark, folder), MODEL)
    group = labels.registration_group(F.col("registered"))
    grouped = reputation.join_profiles(events, profiles(spark, folder), group)
    scope = ["platform", "community", "registration_group"]
    daily = reputation.reputation_daily(grouped, MODEL, scope, at_least=1.0)
    bounds = reputation.day_bounds(grouped, scope)
    return rounded(reputation.daily_reputation_mean(daily, bounds, group="registration_group"))


VIEW_SQL["cp_labels"] = (("deg_month",), """
    SELECT community, month, substr(node, 2) AS user_id, CASE WHEN degree >= q THEN 0 ELSE 1 END AS label
    FROM deg_month JOIN (SELECT community, month, quantile_cont(degree, 0.9) AS q FROM deg_month WHERE node[1]='c' GROUP BY ALL) USING (community, month)
    WHERE node[1] = 'c'""")
VIEW_SQL["cp_joined"] = (("rep_orders_daily", "cp_labels"), """
    SELECT d.platform, d.community, l.month, l.label, d.user_id, d.date, d.reputation
    FROM rep_orders_daily d JOIN cp_labels l ON d.community = l.community AND d.user_id = l.user_id AND strftime(d.date, '%Y-%m') = l.month
    WHERE d.reputation >= 1""")
VIEW_SQL["cp_monthly"] = (("cp_joined",), """
    SELECT community, month, label, d.mean_rep_active, d.active_daily_avg, m.median_rep_active, m.active_users
    FROM (SELECT community, month, label, avg(s/n) AS mean_rep_active, avg(n) AS active_daily_avg
      FROM (SELECT community, month, label, date, sum(reputation) AS s, count(DISTINCT user_id) AS n FROM cp_joined GROUP BY ALL) GROUP BY ALL) d
    JOIN (SELECT community, month, label, median(u) AS median_rep_active, count(*) AS active_users
      FROM (SELECT community, month, label, user_id, avg(reputation) AS u FROM cp_joined GROUP BY ALL) GROUP BY ALL) m
    USING (community, month, label)""")
VIEW_SQL["cp_wide"] = (("cp_monthly", "cp_labels"), """
    SELECT community, month, b.n_core, b.n_periphery,
      max(mean_rep_active) FILTER (label=0) AS core_mean_rep_active, max(mean_rep_active) FILTER (label=1) AS periphery_mean_rep_active,
      max(median_rep_active) FILTER (label=0) AS core_median_rep_active, max(median_rep_active) FILTER (label=1) AS periphery_median_rep_active,
      max(active_daily_avg) FILTER (label=0) AS core_active_daily_avg, max(active_daily_avg) FILTER (label=1) AS periphery_active_daily_avg,
      max(active_users) FILTER (label=0) AS core_active_users, max(active_users) FILTER (label=1) AS periphery_active_users
    FROM (SELECT community, month, count(*) FILTER (label=0) AS n_core, count(*) FILTER (label=1) AS n_periphery FROM cp_labels GROUP BY ALL) b
    LEFT JOIN cp_monthly USING (community, month) GROUP BY ALL""")


def cp_labels(spark, folder):
    from tideline.operators import graph

    keys = ["community", "month"]
    nodes = graph.degrees(standins.edges_month(spark, folder), keys).where(F.col("node").startswith("c"))
    thresholds = graph.degree_quantiles(nodes, keys, {"q": 0.9})
    label = F.when(F.col("degree") >= F.col("q"), 0).otherwise(1)
    return nodes.join(thresholds, keys).select(*keys, F.expr("substr(node, 2)").alias("user_id"), label.alias("label"))


def cp_joined(spark, folder):
    return core_periphery.join_cp_labels(order_days(spark, folder), cp_labels(spark, folder))


def cp_wide(spark, folder, days=None):
    labelled = cut_lineage(cp_labels(spark, folder))
    days = order_days(spark, folder) if days is None else days
    monthly = core_periphery.cp_reputation_monthly(core_periphery.join_cp_labels(days, labelled))
    return core_periphery.join_blocks_wide(core_periphery.core_periphery_blocks(labelled), monthly)


@check("join_cp_labels", with_views("cp_joined", body="""
    SELECT platform, community, month, label, user_id, CAST(date AS VARCHAR) AS date, round(reputation,6) AS reputation FROM cp_joined"""))
def join_cp_labels(spark, folder):
    joined = cp_joined(spark, folder).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return rounded(joined.select("platform", "community", "month", "label", "user_id", "date", "reputation"))


@check("cp_reputation_monthly", with_views("cp_monthly", body="""
    SELECT community, month, label, round(mean_rep_active,6) AS mean_rep_active, round(active_daily_avg,6) AS active_daily_avg,
      round(median_rep_active,6) AS median_rep_active, active_users FROM cp_monthly"""))
def cp_reputation_monthly(spark, folder):
    return rounded(core_periphery.cp_reputation_monthly(cp_joined(spark, folder)))


CP_COLUMNS = [f"{side}_{c}" for c in ("mean_rep_active", "median_rep_active", "active_daily_avg") for side in ("core", "periphery")]


@check("join_blocks_wide", with_views("cp_wide", body="""
    SELECT community, month, n_core, n_periphery, core_active_users, periphery_active_users, """
    + ", ".join(f"round({c},6) AS {c}" for c in CP_COLUMNS) + " FROM cp_wide"))
def join_blocks_wide(spark, folder):
    return rounded(cp_wide(spark, folder))


WEIGHTED_SQL = """(coalesce(core_mean_rep_active,0)*coalesce(core_active_users,0) + coalesce(periphery_mean_rep_active,0)*coalesce(periphery_active_users,0))
      / nullif(coalesce(core_active_users,0)+coalesce(periphery_active_users,0),0)"""


def cp_weighted(spark, folder, days=None):
    value = reputation.weighted_core_periphery(
        F.col("core_mean_rep_active"),
        F.col("periphery_mean_rep_active"),
        F.col("core_active_users").cast("double"),
        F.col("periphery_active_users").cast("double"),
    )
    return cp_wide(spark, folder, days).select("community", "month", value.alias("cp_reputation"))


@check("cp_reputation_weighted", with_views("cp_wide", body=f"""
    SELECT community, month, round({WEIGHTED_SQL},6) AS cp_reputation FROM cp_wide"""))
def cp_reputation_weighted(spark, folder):
    return rounded(cp_weighted(spark, folder))


@check("join_reputation_override", with_views("community_month_full", "cp_wide", body=f"""
    SELECT m.platform, community, month, round(coalesce({WEIGHTED_SQL}, reputation_mean),6) AS reputation_mean
    FROM community_month_full m LEFT JOIN cp_wide USING (community, month)"""))
def join_reputation_override(spark, folder):
    monthly = rollups.community_month_basic(user_month_with_reputation(spark, folder))
    merged = rollups.override_metric(
        monthly, cp_weighted(spark, folder), "reputation_mean", "cp_reputation", ["community", "month"]
    )
    return rounded(merged.select("platform", "community", "month", "reputation_mean"))


DESCRIBED_SQL = """count(d) AS "count", round(avg(d),6) AS mean, round(stddev_samp(d),6) AS std,
      round(stddev_samp(d)/nullif(CASE WHEN abs(avg(d)) > 1e-12 THEN avg(d) END,0),6) AS coef_variation, round(min(d),6) AS min,
      round(quantile_cont(d,0.25),6) AS q1, round(median(d),6) AS median, round(quantile_cont(d,0.75),6) AS q3,
      round(quantile_cont(d,0.75)-quantile_cont(d,0.25),6) AS iqr, round(max(d),6) AS max, round(max(d)-min(d),6) AS range,
      round(CASE WHEN min(d) > 0 THEN exp(avg(ln(greatest(d,1e-300)))) END,6) AS geometric_mean,
      round(skewness(d),6) AS skew, round(kurtosis(d),6) AS kurtosis,
      round(avg(CASE WHEN d>0 THEN 1.0 ELSE 0.0 END),6) AS positive_share, round(avg(CASE WHEN d<0 THEN 1.0 ELSE 0.0 END),6) AS negative_share"""


@check("describe_difference", with_views("cp_wide", body=f"""
    SELECT community, {DESCRIBED_SQL} FROM (SELECT community, round(core_mean_rep_active - periphery_mean_rep_active, 9) AS d FROM cp_wide)
    WHERE d IS NOT NULL GROUP BY community"""))
def describe_difference(spark, folder):
    # To nine digits, so that equal means have no sign.
    difference = F.round(F.col("core_mean_rep_active") - F.col("periphery_mean_rep_active"), 9)
    return rounded(core_periphery.describe_difference(cp_wide(spark, folder).withColumn("d", difference), "d"))


VIEW_SQL["cp_pairs"] = (("cp_labels",), """
    SELECT a.community, a.month, count(b.user_id) AS common_nodes,
      count(*) FILTER (a.label=0 AND b.label=0) AS core_both, count(*) FILTER (a.label=b.label) AS same_label,
      any_value(s.n) + any_value(t.n) - count(*) FILTER (a.label=0 AND b.label=0) AS core_union
    FROM cp_labels a
    JOIN (SELECT community, month, count(*) FILTER (label=0) AS n FROM cp_labels GROUP BY ALL) s ON s.community=a.community AND s.month=a.month
    JOIN (SELECT community, month, count(*) FILTER (label=0) AS n FROM cp_labels GROUP BY ALL) t
      ON t.community=a.community AND t.month=strftime(CAST(a.month||'-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m')
    LEFT JOIN cp_labels b ON b.community=a.community AND b.user_id=a.user_id AND b.month=t.month
    GROUP BY a.community, a.month""")


@check("core_periphery_stability", with_views("cp_pairs", body="""
    SELECT community, count(*) AS pairs, round(median(core_both/nullif(core_union,0)),6) AS median_jaccard_core,
      round(median(100.0*same_label/nullif(common_nodes,0)),6) AS median_label_agreement_pct,
      round(avg(CASE WHEN common_nodes>=10 THEN 1.0 ELSE 0.0 END),6) AS share_common_nodes_ge_10,
      round(avg(CASE WHEN core_both/core_union>=0.2 THEN 1.0 ELSE 0.0 END),6) AS share_jaccard_ge_0_2
    FROM cp_pairs GROUP BY community"""))
def core_periphery_stability(spark, folder):
    pairs = core_periphery.core_periphery_stability(cp_labels(spark, folder))
    return rounded(core_periphery.stability_summary(pairs))
