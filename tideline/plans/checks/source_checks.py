"""Checks of readers and writers: Spark writes a file form from the given tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import graph, inference, reputation, rollups
from tideline.plans import overview, shared, standins
from tideline.plans.catalog import check, rounded
from tideline.plans.checks import graph_checks, inference_checks, reputation_checks
from tideline.plans.standins import LABELS, with_views
from tideline.session import cut_lineage, fresh_folder
from tideline.sources import activity as activity_files
from tideline.sources import edges as edge_files
from tideline.sources import reputation_files, score_files, sinks


@check("scan_activity", with_views("activity", body="""
    SELECT post_id, user_id, platform, community, month, round(toxicity_toxigen,6) AS toxicity_toxigen
    FROM activity WHERE community IN ('1-URGENT') AND platform='focal' AND (CAST(post_id AS BIGINT) % 13 <> 0)"""))
def scan_activity(spark, folder):
    """Some rows without a date, some of another type, one community asked for in other letters."""
    raw = standins.raw_activity(spark, folder)
    key = F.col("post_id").cast("bigint")
    spoiled = raw.withColumn("publish_date", F.when(key % 26 != 0, F.col("publish_date"))).withColumn(
        "interaction_type", F.when(key % 26 == 13, "VOTE").otherwise(F.col("interaction_type"))
    )
    path = fresh_folder(spark, "activity")
    spoiled.write.partitionBy("platform", "community").parquet(path)
    found = activity_files.scan_activity(spark, path, platform="FOCAL", community="1-urgent")
    return rounded(found.select("post_id", "user_id", "platform", "community", "month", "toxicity_toxigen"))


EDGE_COUNTS_SQL = with_views("edges_month", body="SELECT community, month, source, target, count(*) AS n FROM edges_month GROUP BY ALL")


@check("scan_edges", EDGE_COUNTS_SQL)
def scan_edges(spark, folder):
    """One file per community and month, named after both, with comments and lines without both ends; one is empty."""
    path = fresh_folder(spark, "edges")
    edges = standins.edges_month(spark, folder).select(
        F.concat_ws("_", "community", "month").alias("name"), F.concat_ws("\t ", "source", "target").alias("value")
    )
    spoiled = edges.groupBy("name").agg(F.count("*").alias("n")).select(
        "name", F.explode(F.array(F.lit("# source target"), F.lit("alone"), F.lit(""))).alias("value")
    )
    edges.union(spoiled).repartition("name").write.partitionBy("name").text(path)
    system, place = _file_system(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    for found in system.listStatus(place(path)):
        if found.isDirectory():
            name = found.getPath().getName().removeprefix("name=")
            part = next(f.getPath() for f in system.listStatus(found.getPath()) if f.getPath().getName().startswith("part-"))
            system.rename(part, place(f"{path}/{name}.txt"))
            system.delete(found.getPath(), True)
    system.create(place(f"{path}/empty_2000-01.txt")).close()
    read = edge_files.scan_edges(spark, path)
    return read.groupBy("community", "month", "source", "target").agg(F.count("*").alias("n"))


def _file_system(spark, path):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


@check("scan_partitioned_edges", EDGE_COUNTS_SQL)
def scan_partitioned_edges(spark, folder):
    path = fresh_folder(spark, "edges")
    sinks.write_edges(standins.edges_month(spark, folder), path)
    found = edge_files.scan_partitioned_edges(spark, path)
    return found.groupBy("community", "month", "source", "target").agg(F.count("*").alias("n"))


def event_days(spark, folder):
    events = reputation.reputation_events(standins.event_activity(spark, folder), reputation_checks.MODEL)
    return reputation.reputation_daily(events, reputation_checks.MODEL)


DAYS_SQL = "SELECT platform, community, user_id, CAST(date AS VARCHAR) AS date, strftime(date, '%Y-%m') AS month, round(reputation,6) AS reputation FROM rep_events_daily"


def _shown(found):
    date = F.date_format("date", "yyyy-MM-dd").alias("date")
    return rounded(found.select("platform", "community", "user_id", date, "month", "reputation"))


@check("scan_daily_reputation", with_views("rep_events_daily", body=DAYS_SQL))
def scan_daily_reputation(spark, folder):
    """Parquet without dates, which then follow from ``t_min`` and ``day``."""
    path = fresh_folder(spark, "reputation")
    sinks.write_daily_reputation(event_days(spark, folder).drop("date"), path)
    return _shown(reputation_files.scan_daily_reputation(spark, path))


@check("sink_daily_reputation", with_views("rep_events_daily", body=DAYS_SQL))
def sink_daily_reputation(spark, folder):
    """CSV with ISO dates."""
    path = fresh_folder(spark, "reputation")
    sinks.write_daily_reputation(event_days(spark, folder), path, "csv")
    return _shown(reputation_files.scan_daily_reputation(spark, path, "csv"))


@check("scan_legacy_reputation", with_views("rep_events_daily", body="""
    SELECT user_id, CAST(floor(t_min) AS BIGINT) AS t_min, CAST(floor(t_max) AS BIGINT) AS t_max, day, round(reputation,6) AS reputation FROM rep_events_daily"""))
def scan_legacy_reputation(spark, folder):
    """Text lines of a user's days; a line holds at most one entry per day of the period."""
    days = event_days(spark, folder).withColumns({
        "t_min": F.floor("t_min").cast("bigint"), "t_max": F.floor("t_max").cast("bigint")
    })
    lines = days.groupBy("platform", "community", "user_id", "t_min", "t_max").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("day").cast("string"), "reputation")))).alias("_days")
    )
    path = fresh_folder(spark, "legacy")
    lines.select(F.concat_ws("\t", reputation_files.legacy_key(), "_days").alias("value")).write.text(path)
    return rounded(reputation_files.scan_legacy_reputation(spark, path))


@check("scan_profiles", """
    SELECT CAST(c_custkey AS VARCHAR) AS user_id, 1380000000 + (c_custkey*104729) % 180000000 AS registered FROM customer""")
def scan_profiles(spark, folder):
    path = fresh_folder(spark, "profiles")
    profiles = reputation_checks.all_profiles(spark, folder)
    profiles.select(F.col("user_id").alias("user"), F.col("registered").alias("reg_date")).write.json(path)
    return reputation_files.scan_profiles(spark, path)


@check("scan_scores", with_views("scores", body="""
    SELECT post_id, user_id, month, community_type, """ + ", ".join(f"round({c},6) AS {c}" for c in LABELS.values()) + """
    FROM scores WHERE CAST(post_id AS BIGINT) % 19 <> 0"""))
def scan_scores(spark, folder):
    """Two sets of CSV files, one per type, with some scores that are no numbers."""
    table = standins.scores(spark, folder).drop("ts", "month")
    spoiled = table.withColumn(
        "detoxify_insult",
        F.when(F.col("post_id").cast("bigint") % 19 == 0, F.lit("nan")).otherwise(F.col("detoxify_insult").cast("string")),
    )
    paths = []
    for kind in ("POST", "COMMENT"):
        paths.append(fresh_folder(spark, "scores"))
        sinks.write_table(spoiled.where(F.col("interaction_type") == kind), paths[-1])
    found = score_files.scan_scores(spark, paths)
    return rounded(found.select("post_id", "user_id", "month", "community_type", *LABELS.values()))


@check("sink_user_month", with_views("user_month", body="""
    SELECT platform, community, user_id, month, activity_count, round(mean_toxicity,6) AS mean_toxicity FROM user_month"""))
def sink_user_month(spark, folder):
    path = fresh_folder(spark, "user-month")
    sinks.write_user_month(shared.user_month(spark, folder), path)
    found = spark.read.parquet(path)
    return rounded(found.select("platform", "community", "user_id", "month", "activity_count", "mean_toxicity"))


@check("sink_csv_tables", with_views("community_month", body="""
    SELECT platform, community, month, active_users, total_activity, round(toxicity_mean,6) AS toxicity_mean FROM community_month"""))
def sink_csv_tables(spark, folder):
    path = fresh_folder(spark, "community-month")
    columns = ["platform", "community", "month", "active_users", "total_activity", "toxicity_mean"]
    sinks.write_table(shared.community_month(spark, folder).select(*columns), path)
    schema = "platform string, community string, month string, active_users bigint, total_activity bigint, toxicity_mean double"
    return rounded(spark.read.schema(schema).option("header", "true").csv(path))


BANDED = ("toxicity_mean", "vader_mean")
PAIRED = [f"{c}_{p}" for c in overview.OVERVIEW_METRICS for p in ("focal", "reference")]
_PARTITION_PM = graph_checks.for_platform_months(graph_checks.PARTITION_SQL).replace(
    "JOIN lab_pm l USING (community, node)", "JOIN lab_pm l USING (community, month, node)"
)


@check("overview_monthly", with_views("community_month_full", "cp_wide", "pairs_pm", "deg_pm", "clustering_pm", "lab_pm", "focal_wide", body=f"""
    , net AS (WITH e AS (SELECT q.community, q.month, x.degree AS da, y.degree AS db, a=b AS loop FROM pairs_pm q
        JOIN deg_pm x ON x.community=q.community AND x.month=q.month AND x.node=a JOIN deg_pm y ON y.community=q.community AND y.month=q.month AND y.node=b),
      sy AS (SELECT community, month, da, db FROM e UNION ALL SELECT community, month, db, da FROM e WHERE NOT loop),
      r AS (SELECT community, month, CASE WHEN stddev_pop(da)>0 THEN corr(da, db) END AS degree_assortativity FROM sy GROUP BY ALL),
      d AS (SELECT community, month, avg(degree) AS mean_degree FROM deg_pm GROUP BY ALL),
      c AS (SELECT community, month, avg(c) AS mean_clustering FROM clustering_pm GROUP BY ALL)
      SELECT * FROM r JOIN d USING (community, month) JOIN c USING (community, month)),
    part AS (WITH {_PARTITION_PM.lstrip().removeprefix(",")}
      SELECT split_part(community, '|', 2) AS community, month, nn AS n_newcomers, no AS n_existing,
        CASE WHEN nn > 0 AND no > 0 THEN (tr - an*an - (1-an)*(1-an))/nullif(1 - an*an - (1-an)*(1-an),0) END AS partition_assortativity,
        CASE WHEN nn > 0 AND no > 0 THEN (eno-enn-eoo)/m END AS ei_index
      FROM s LEFT JOIN k USING (community, month) LEFT JOIN mx USING (community, month) WHERE community LIKE 'focal|%'),
    j AS (SELECT m.* REPLACE (coalesce({reputation_checks.WEIGHTED_SQL}, m.reputation_mean) AS reputation_mean), mean_degree, degree_assortativity, mean_clustering
      FROM community_month_full m LEFT JOIN cp_wide w ON w.community=m.community AND w.month=m.month
      LEFT JOIN net n ON n.community=m.platform||'|'||m.community AND n.month=m.month),
    w AS (SELECT community, month, """ + ", ".join(
        f"max({c}) FILTER (platform='{p}') AS {c}_{p}" for c in overview.OVERVIEW_METRICS for p in ("focal", "reference")) + """ FROM j GROUP BY ALL)
    SELECT community, month, """ + ", ".join(c if c.startswith("active_users") else f"round({c},6) AS {c}" for c in PAIRED) + """,
      round(partition_assortativity,6) AS partition_assortativity, round(ei_index,6) AS ei_index, n_newcomers, n_existing, """ + ", ".join(
        f"round({s}_p{p},6) AS {s}_p{p}" for s in ("toxicity_mean", "vader_mean") for p in (5, 50, 95)) + """
    FROM w LEFT JOIN part USING (community, month)
    LEFT JOIN (SELECT community, month, toxicity_mean_p5, toxicity_mean_p50, toxicity_mean_p95, vader_mean_p5, vader_mean_p50, vader_mean_p95 FROM focal_wide) USING (community, month)"""))
def overview_monthly(spark, folder):
    """Overridden reputation, both platforms' networks, mixing and matched bands joined to the months."""
    keys = ["community", "month"]
    # Days with reputation and user-months feed several parts each.
    days = cut_lineage(reputation_checks.order_days(spark, folder))
    users = cut_lineage(reputation_checks.user_month_with_reputation(spark, folder, days))
    monthly = rollups.community_month_basic(users)
    by_platform = graph_checks.PLATFORM_MONTH
    # Labels and pairs read the same lines, which are joined once.
    edges = cut_lineage(standins.edges_platform_month(spark, folder))
    pairs = cut_lineage(graph.dedup_edges(edges, by_platform))
    nodes = cut_lineage(graph.pair_degrees(pairs, by_platform))
    # Degrees and labels meet the pairs once, for all metrics.
    labels = cut_lineage(graph_checks.platform_month_labels(edges, nodes))
    labelled = nodes.join(labels.hint("shuffle_hash"), [*by_platform, "node"], "left")
    ends = graph.named_ends(pairs, labelled, by_platform, "label")
    network = rollups.left_join_all(
        graph.degree_stats(nodes, by_platform).select(*by_platform, "mean_degree"),
        [
            graph.degree_assortativity(pairs, nodes, by_platform, ends),
            graph.clustering_stats(pairs, nodes, by_platform, ends).select(*by_platform, "mean_clustering"),
        ],
        by_platform,
    )
    mixing = graph_checks.platform_partition(pairs, nodes, labels, ends).where(F.col("platform") == "focal").drop("platform")
    bands = inference.bootstrap_percentiles(inference_checks.matched(spark, folder, users, BANDED))
    override = reputation_checks.cp_weighted(spark, folder, days)
    return rounded(
        overview.overview_monthly(monthly, network, mixing, bands, override, ["focal", "reference"]).select(
            *keys,
            *PAIRED,
            "partition_assortativity",
            "ei_index",
            "n_newcomers",
            "n_existing",
            *[f"{m}_p{p}" for m in BANDED for p in (5, 50, 95)],
        )
    )
