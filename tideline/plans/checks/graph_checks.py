"""Checks of graph metrics over weekly and monthly snapshots."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tideline.functions import labels, timeparts
from tideline.functions.calendar import newcomer_days
from tideline.operators import cohorts, components, graph, hubs, rollups
from tideline.plans import network, standins
from tideline.plans.catalog import check, rounded
from tideline.plans.checks.label_checks import FIXED_SQL, NEWCOMER_SQL
from tideline.plans.standins import ORDER_CALENDAR, VIEW_SQL, with_views
from tideline.session import cut_lineage

DAYS = newcomer_days(ORDER_CALENDAR)
WEEK = ["community", "week"]
MONTH = ["community", "month"]


def week_graph(spark, folder):
    edges = standins.edges_week(spark, folder)
    return graph.dedup_edges(edges, WEEK), graph.degrees(edges, WEEK)


def week_tables(spark, folder):
    """Pairs and nodes of weekly snapshots, each written down; the edges are read once."""
    pairs = cut_lineage(graph.dedup_edges(standins.edges_week(spark, folder), WEEK))
    return pairs, cut_lineage(graph.pair_degrees(pairs, WEEK))


def month_graph(spark, folder):
    edges = standins.edges_month(spark, folder)
    return graph.dedup_edges(edges, MONTH), graph.degrees(edges, MONTH)


def month_tables(spark, folder):
    """Pairs, nodes and labelled nodes of monthly snapshots, each written down; the edges are read once."""
    pairs = cut_lineage(graph.dedup_edges(standins.edges_month(spark, folder), MONTH))
    nodes = cut_lineage(graph.pair_degrees(pairs, MONTH))
    return pairs, nodes, cut_lineage(labelled_months(spark, folder, nodes))


def node_first_month(spark, folder, nodes=None):
    """First month of every node per community, from the edges or from the snapshots' ``nodes``."""
    if nodes is None:
        edges = standins.edges_month(spark, folder)
        nodes = edges.select("community", "month", F.explode(F.array("source", "target")).alias("node"))
    # Numbers of months are kept in a hash table, strings would be sorted.
    first = F.min(timeparts.month_index(F.col("month")))
    return nodes.groupBy("community", "node").agg(
        F.when(first.isNotNull(), timeparts.month_from_index(first)).alias("first_month")
    )


def labelled_months(spark, folder, nodes=None):
    """Nodes of monthly snapshots with newcomer labels; nodes without a first month are existing."""
    held, nodes = nodes, month_graph(spark, folder)[1] if nodes is None else nodes
    customers = node_first_month(spark, folder, held).where(F.col("node").startswith("c"))
    label = labels.newcomer_label(
        timeparts.month_start(F.col("first_month")), timeparts.month_start(F.col("month")), DAYS
    )
    return (
        nodes.join(customers.hint("shuffle_hash"), ["community", "node"], "left")
        .withColumn("label", label)
        .drop("first_month")
    )


VIEW_SQL["node_first"] = (("edges_month",), """
    SELECT community, node, min(month) AS first_month
    FROM (SELECT community, month, source AS node FROM edges_month UNION ALL SELECT community, month, target FROM edges_month) GROUP BY ALL""")
_CUSTOMER_LABEL = NEWCOMER_SQL.format(month="CAST(month||'-01' AS TIMESTAMP)", seen="CAST(first_month||'-01' AS TIMESTAMP)")
VIEW_SQL["lab_month"] = (("deg_month", "node_first"), f"""
    SELECT d.community, d.month, d.node, d.degree, {_CUSTOMER_LABEL} AS label
    FROM deg_month d LEFT JOIN node_first f ON f.community=d.community AND f.node=d.node AND f.node[1]='c'""")
# A label of weekly nodes for every source, so that nodes which never act have none.
VIEW_SQL["lab_week"] = (("edges_week",), """
    SELECT DISTINCT community, source AS node, CASE WHEN CAST(source AS BIGINT) % 3 = 0 THEN 'newcomer' ELSE 'existing' END AS label FROM edges_week""")


def week_labels(spark, folder):
    sources = standins.edges_week(spark, folder).select("community", F.col("source").alias("node")).distinct()
    return sources.withColumn("label", F.when(F.col("node").cast("bigint") % 3 == 0, "newcomer").otherwise("existing"))


@check("dedup_edges", with_views("pairs_week", body="SELECT community, week, a, b FROM pairs_week"))
def dedup_edges(spark, folder):
    return graph.dedup_edges(standins.edges_week(spark, folder), WEEK)


@check("degrees", with_views("deg_week", body="SELECT community, week, node, degree FROM deg_week"))
def degrees(spark, folder):
    return graph.degrees(standins.edges_week(spark, folder), WEEK)


STATS_SQL = """count(*) AS n_nodes, round(avg(degree),6) AS mean_degree, round(median(degree),6) AS median_degree,
      round(coalesce(stddev_samp(degree),0),6) AS std_degree, round(coalesce(stddev_samp(degree),0)/avg(degree),6) AS degree_heterogeneity"""


@check("degree_stats", with_views("deg_week", body=f"SELECT community, week, {STATS_SQL} FROM deg_week GROUP BY ALL"))
def degree_stats(spark, folder):
    return rounded(graph.degree_stats(week_graph(spark, folder)[1], WEEK))


@check("degree_stats_month", with_views("deg_month", body=f"SELECT community, month, {STATS_SQL} FROM deg_month GROUP BY ALL"))
def degree_stats_month(spark, folder):
    return rounded(graph.degree_stats(month_graph(spark, folder)[1], MONTH))


@check("density", with_views("pairs_week", "deg_week", body="""
    SELECT community, week, n_nodes, n_edges, round(CASE WHEN n_nodes<=1 THEN 0 ELSE 2.0*n_edges/(n_nodes*(n_nodes-1)) END,6) AS density
    FROM (SELECT community, week, count(*) AS n_nodes FROM deg_week GROUP BY ALL)
    JOIN (SELECT community, week, count(*) AS n_edges FROM pairs_week GROUP BY ALL) USING (community, week)"""))
def density(spark, folder):
    return rounded(graph.density(*week_graph(spark, folder), WEEK))


@check("degree_assortativity", with_views("pairs_week", "deg_week", body="""
    , e AS (SELECT p.community, p.week, x.degree AS da, y.degree AS db, a=b AS loop FROM pairs_week p
      JOIN deg_week x ON x.community=p.community AND x.week=p.week AND x.node=a JOIN deg_week y ON y.community=p.community AND y.week=p.week AND y.node=b),
    s AS (SELECT community, week, da, db FROM e UNION ALL SELECT community, week, db, da FROM e WHERE NOT loop)
    SELECT community, week, round(CASE WHEN stddev_pop(da)>0 THEN corr(da, db) END,6) AS degree_assortativity FROM s GROUP BY ALL"""))
def degree_assortativity(spark, folder):
    return rounded(graph.degree_assortativity(*week_graph(spark, folder), WEEK))


VIEW_SQL["clustering_week"] = (("pairs_week", "deg_week"), """
    SELECT d.community, d.week, d.node, coalesce(t.n,0) AS triangles, CASE WHEN k.k>=2 THEN 2.0*coalesce(t.n,0)/(k.k*(k.k-1)) ELSE 0 END AS c
    FROM deg_week d
    LEFT JOIN (SELECT community, week, node, count(*) AS k FROM (SELECT community, week, a AS node FROM pairs_week WHERE a<>b
      UNION ALL SELECT community, week, b FROM pairs_week WHERE a<>b) GROUP BY ALL) k USING (community, week, node)
    LEFT JOIN (SELECT community, week, node, count(*) AS n FROM (
        SELECT x.community, x.week, unnest([x.a, x.b, y.b]) AS node FROM pairs_week x
        JOIN pairs_week y ON y.community=x.community AND y.week=x.week AND y.a=x.b
        JOIN pairs_week z ON z.community=x.community AND z.week=x.week AND z.a=x.a AND z.b=y.b
        WHERE x.a<x.b AND y.a<y.b) GROUP BY ALL) t USING (community, week, node)""")


@check("local_clustering", with_views("clustering_week", body="""
    SELECT community, week, node, triangles, round(c,6) AS clustering FROM clustering_week"""))
def local_clustering(spark, folder):
    return rounded(graph.local_clustering(*week_graph(spark, folder), WEEK))


@check("clustering_stats", with_views("clustering_week", body="""
    , n AS (SELECT community, week, count(*) AS n, avg(c) AS mc FROM clustering_week GROUP BY ALL),
    m AS (SELECT community, week, count(*) AS m FROM pairs_week GROUP BY ALL)
    SELECT community, week, round(mc,6) AS mean_clustering, round(2.0*m/(n*(n-1)),6) AS er_expected_clustering,
      round(mc/(2.0*m/(n*(n-1))),6) AS normalized_clustering FROM n JOIN m USING (community, week)"""))
def clustering_stats(spark, folder):
    return rounded(graph.clustering_stats(*week_graph(spark, folder), WEEK))


def _components_sql(stem: str, key: str) -> str:
    """Labels by repeated minima over a recursive walk: every node reaches all of its component."""
    return f"""
    , arcs AS (SELECT community, {key}, a AS u, b AS v FROM pairs_{stem} UNION SELECT community, {key}, b, a FROM pairs_{stem}),
    walk AS (SELECT community, {key}, node AS src, node FROM deg_{stem}
      UNION SELECT w.community, w.{key}, w.src, x.v FROM walk w JOIN arcs x ON x.community=w.community AND x.{key}=w.{key} AND x.u=w.node),
    comp AS (SELECT community, {key}, node, min(src) AS component FROM walk GROUP BY ALL)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@check("connected_components", _recursive(with_views("pairs_week", "deg_week", body=_components_sql("week", "week") + """
    SELECT community, week, node, component FROM comp""")))
def connected_components(spark, folder):
    return components.connected_components(*week_graph(spark, folder), WEEK)


@check("connected_components_month", _recursive(with_views("pairs_month", "deg_month", body=_components_sql("month", "month") + """
    SELECT community, month, component, count(*) AS size FROM comp GROUP BY ALL""")))
def connected_components_month(spark, folder):
    found = components.connected_components(*month_graph(spark, folder), MONTH)
    return components.component_sizes(found, MONTH)


@check("giant_component", _recursive(with_views("pairs_week", "deg_week", body=_components_sql("week", "week") + """
    , s AS (SELECT community, week, component, count(*) AS size FROM comp GROUP BY ALL)
    SELECT community, week, max(size) AS giant_component_size, round(max(size)/sum(size),6) AS giant_component_fraction FROM s GROUP BY ALL""")))
def giant_component(spark, folder):
    found = components.connected_components(*week_graph(spark, folder), WEEK)
    return rounded(components.giant_component(found, WEEK).drop("component"))


PATHS_SQL = """
    , arcs AS (SELECT community, week, a AS u, b AS v FROM pairs_week WHERE a<>b UNION SELECT community, week, b, a FROM pairs_week WHERE a<>b),
    walk(community, week, src, node, d) USING KEY (community, week, src, node) AS (SELECT community, week, node, node, 0 FROM deg_week
      UNION SELECT w.community, w.week, w.src, x.v, w.d+1 FROM walk w JOIN arcs x ON x.community=w.community AND x.week=w.week AND x.u=w.node
        LEFT JOIN recurring.walk r ON r.community=w.community AND r.week=w.week AND r.src=w.src AND r.node=x.v WHERE r.d IS NULL),
    dist AS (SELECT community, week, src, node, min(d) AS d FROM walk GROUP BY ALL),
    comp AS (SELECT community, week, node, min(src) AS component FROM dist GROUP BY ALL),
    s AS (SELECT community, week, component, count(*) AS size FROM comp GROUP BY ALL),
    g AS (SELECT community, week, max(size) AS size, sum(size) AS n FROM s GROUP BY ALL),
    c AS (SELECT s.community, s.week, min(component) AS component FROM s JOIN g USING (community, week, size) GROUP BY ALL),
    p AS (SELECT c.community, c.week, sum(d) AS total, max(d) AS diameter FROM dist JOIN comp ON comp.community=dist.community AND comp.week=dist.week AND comp.node=dist.src
      JOIN c ON c.community=comp.community AND c.week=comp.week AND c.component=comp.component GROUP BY ALL)"""
PATH_COLUMNS_SQL = """g.size AS giant_component_size, round(g.size/g.n,6) AS giant_component_fraction,
      round(total/nullif(g.size*(g.size-1.0),0),6) AS avg_shortest_path, CASE WHEN g.size > 1 THEN CAST(diameter AS INTEGER) END AS diameter"""


@check("path_metrics", _recursive(with_views("pairs_week", "deg_week", body=PATHS_SQL + f"""
    SELECT community, week, {PATH_COLUMNS_SQL} FROM g JOIN p USING (community, week)""")))
def path_metrics(spark, folder):
    pairs, nodes = week_tables(spark, folder)
    found = components.connected_components(pairs, nodes, WEEK)
    return rounded(components.path_metrics(pairs, found, WEEK))


SNAPSHOT_SQL = PATHS_SQL + f"""
    , st AS (SELECT community, week, {STATS_SQL} FROM deg_week GROUP BY ALL),
    m AS (SELECT community, week, count(*) AS n_edges FROM pairs_week GROUP BY ALL),
    cl AS (SELECT community, week, avg(c) AS mc FROM clustering_week GROUP BY ALL),
    e AS (SELECT q.community, q.week, x.degree AS da, y.degree AS db, a=b AS loop FROM pairs_week q
      JOIN deg_week x ON x.community=q.community AND x.week=q.week AND x.node=a JOIN deg_week y ON y.community=q.community AND y.week=q.week AND y.node=b),
    sy AS (SELECT community, week, da, db FROM e UNION ALL SELECT community, week, db, da FROM e WHERE NOT loop),
    r AS (SELECT community, week, round(CASE WHEN stddev_pop(da)>0 THEN corr(da, db) END,6) AS degree_assortativity FROM sy GROUP BY ALL)
    SELECT community, week, st.n_nodes, m.n_edges, mean_degree, median_degree, std_degree, degree_heterogeneity,
      round(mc,6) AS mean_clustering, round(2.0*n_edges/(n_nodes*(n_nodes-1)),6) AS er_expected_clustering,
      round(mc/(2.0*n_edges/(n_nodes*(n_nodes-1))),6) AS normalized_clustering, {PATH_COLUMNS_SQL},
      round(2.0*n_edges/(n_nodes*(n_nodes-1)),6) AS density, degree_assortativity
    FROM st JOIN m USING (community, week) JOIN cl USING (community, week) JOIN r USING (community, week) JOIN g USING (community, week) JOIN p USING (community, week)"""


@check("network_snapshot", _recursive(with_views("pairs_week", "deg_week", "clustering_week", body=SNAPSHOT_SQL)))
def network_snapshot(spark, folder):
    return rounded(network.network_snapshot(standins.edges_week(spark, folder), WEEK))


PARTITION_SQL = """
    , n AS (SELECT d.community, d.week, d.node, l.label FROM deg_week d JOIN lab_week l USING (community, node)),
    s AS (SELECT community, week, count(*) FILTER (label='newcomer') AS nn, count(*) FILTER (label='existing') AS no FROM n GROUP BY ALL),
    e AS (SELECT p.community, p.week, x.label AS la, y.label AS lb, a=b AS loop FROM pairs_week p
      JOIN n x ON x.community=p.community AND x.week=p.week AND x.node=a JOIN n y ON y.community=p.community AND y.week=p.week AND y.node=b),
    k AS (SELECT community, week, count(*) AS m, count(*) FILTER (la='newcomer' AND lb='newcomer') AS enn,
      count(*) FILTER (la='existing' AND lb='existing') AS eoo, count(*) FILTER (la<>lb) AS eno FROM e GROUP BY ALL),
    dirs AS (SELECT community, week, la, lb FROM e UNION ALL SELECT community, week, lb, la FROM e WHERE NOT loop),
    mx AS (SELECT community, week, avg(CASE WHEN la=lb THEN 1.0 ELSE 0 END) AS tr, avg(CASE WHEN la='newcomer' THEN 1.0 ELSE 0 END) AS an FROM dirs GROUP BY ALL)"""


@check("partition_metrics", with_views("pairs_week", "deg_week", "lab_week", body=PARTITION_SQL + """
    SELECT community, week, nn AS n_newcomers, no AS n_existing,
      CASE WHEN full_ THEN round((enn+eoo)/m - pow((2*enn+eno)/(2.0*m),2) - pow((2*eoo+eno)/(2.0*m),2),6) END AS modularity,
      CASE WHEN full_ THEN round((tr - an*an - (1-an)*(1-an))/nullif(1 - an*an - (1-an)*(1-an),0),6) END AS assortativity,
      CASE WHEN full_ THEN round((eno-enn-eoo)/m,6) END AS ei_index,
      CASE WHEN full_ THEN round(CASE WHEN nn<=1 THEN 0 ELSE 2.0*coalesce(enn,0)/(nn*(nn-1)) END,6) END AS density_newcomer,
      CASE WHEN full_ THEN round(CASE WHEN no<=1 THEN 0 ELSE 2.0*coalesce(eoo,0)/(no*(no-1)) END,6) END AS density_existing
    FROM (SELECT *, nn > 0 AND no > 0 AS full_ FROM s) LEFT JOIN k USING (community, week) LEFT JOIN mx USING (community, week)"""))
def partition_metrics(spark, folder):
    pairs, nodes = week_graph(spark, folder)
    return rounded(graph.partition_metrics(pairs, nodes, week_labels(spark, folder), WEEK, ["community", "node"]))


@check("partition_projection", with_views("pairs_week", "deg_week", "lab_week", body=PARTITION_SQL + """
    SELECT community, week, nn AS n_newcomers, no AS n_existing,
      CASE WHEN full_ THEN round((tr - an*an - (1-an)*(1-an))/nullif(1 - an*an - (1-an)*(1-an),0),6) END AS partition_assortativity,
      CASE WHEN full_ THEN round((eno-enn-eoo)/m,6) END AS ei_index
    FROM (SELECT *, nn > 0 AND no > 0 AS full_ FROM s) LEFT JOIN k USING (community, week) LEFT JOIN mx USING (community, week)"""))
def partition_projection(spark, folder):
    pairs, nodes = week_graph(spark, folder)
    metrics = graph.partition_metrics(pairs, nodes, week_labels(spark, folder), WEEK, ["community", "node"])
    return rounded(rollups.partition_projection(metrics, WEEK))


@check("join_node_labels", with_views("deg_week", "lab_week", body="""
    SELECT 'dropped' AS policy, community, week, label, count(*) AS n FROM deg_week JOIN lab_week USING (community, node) GROUP BY ALL
    UNION ALL SELECT 'existing', community, week, coalesce(label,'existing'), count(*) FROM deg_week LEFT JOIN lab_week USING (community, node) GROUP BY ALL
    UNION ALL SELECT 'unknown', community, week, coalesce(label,'unknown'), count(*) FROM deg_week LEFT JOIN lab_week USING (community, node) GROUP BY ALL"""))
def join_node_labels(spark, folder):
    _, nodes = week_graph(spark, folder)
    known = week_labels(spark, folder)
    counted = []
    for policy in ("dropped", "existing", "unknown"):
        joined = cohorts.join_node_labels(nodes, known, ["community", "node"], None if policy == "dropped" else policy)
        counts = joined.groupBy(*WEEK, "label").agg(F.count("*").alias("n"))
        counted.append(counts.withColumn("policy", F.lit(policy)))
    return rollups.union_by_name(counted)


@check("ei_index_event", with_views("pairs_month", "lab_month", body="""
    , e AS (SELECT p.community, p.month, x.label AS la, y.label AS lb FROM pairs_month p
      JOIN lab_month x ON x.community=p.community AND x.month=p.month AND x.node=a JOIN lab_month y ON y.community=p.community AND y.month=p.month AND y.node=b)
    SELECT community, month, n_nodes, n_newcomers, n_existing, count(*) AS n_edges,
      round((2*count(*) FILTER (la<>lb) - count(*))/count(*),6) AS ei_index
    FROM e JOIN (SELECT community, month, count(*) AS n_nodes, count(*) FILTER (label='newcomer') AS n_newcomers,
      count(*) FILTER (label='existing') AS n_existing FROM lab_month GROUP BY ALL) USING (community, month)
    GROUP BY community, month, n_nodes, n_newcomers, n_existing"""))
def ei_index_event(spark, folder):
    pairs, _ = month_graph(spark, folder)
    return rounded(graph.ei_index(pairs, labelled_months(spark, folder), MONTH))


VIEW_SQL["lab_roll"] = (("deg_month", "node_first"), """
    SELECT d.community, d.month, d.node, d.degree,
      CASE WHEN CAST(first_month||'-01' AS TIMESTAMP) >= CAST(d.month||'-01' AS TIMESTAMP) - INTERVAL 6 MONTH THEN 'newcomer' ELSE 'existing' END AS label
    FROM deg_month d LEFT JOIN node_first f ON f.community=d.community AND f.node=d.node AND f.node[1]='c'""")
VIEW_SQL["ei_both"] = (("pairs_month", "lab_roll", "lab_month"), """
    SELECT community, month, r.ei AS ei_index_rolling, r.n AS n_newcomers_rolling, e.ei AS ei_index_event FROM
    (SELECT p.community, p.month, any_value(n) AS n, (2.0*count(*) FILTER (x.label<>y.label) - count(*))/count(*) AS ei FROM pairs_month p
      JOIN lab_roll x ON x.community=p.community AND x.month=p.month AND x.node=a JOIN lab_roll y ON y.community=p.community AND y.month=p.month AND y.node=b
      JOIN (SELECT community, month, count(*) FILTER (label='newcomer') AS n FROM lab_roll GROUP BY ALL) z ON z.community=p.community AND z.month=p.month
      GROUP BY p.community, p.month) r
    LEFT JOIN (SELECT p.community, p.month, (2.0*count(*) FILTER (x.label<>y.label) - count(*))/count(*) AS ei FROM pairs_month p
      JOIN lab_month x ON x.community=p.community AND x.month=p.month AND x.node=a JOIN lab_month y ON y.community=p.community AND y.month=p.month AND y.node=b
      GROUP BY p.community, p.month) e USING (community, month)""")


def rolling_months(spark, folder):
    _, nodes = month_graph(spark, folder)
    customers = node_first_month(spark, folder).where(F.col("node").startswith("c"))
    label = labels.rolling_tenure_label(
        timeparts.month_start(F.col("first_month")), timeparts.month_start(F.col("month")), 6
    )
    return nodes.join(customers, ["community", "node"], "left").withColumn("label", label).drop("first_month")


def ei_both(spark, folder):
    pairs, _ = month_graph(spark, folder)
    rolling = graph.ei_index(pairs, rolling_months(spark, folder), MONTH, "ei_index_rolling")
    event = graph.ei_index(pairs, labelled_months(spark, folder), MONTH, "ei_index_event")
    return rolling.select(*MONTH, "ei_index_rolling", F.col("n_newcomers").alias("n_newcomers_rolling")).join(
        event.select(*MONTH, "ei_index_event"), MONTH, "left"
    )


@check("ei_index_rolling", with_views("ei_both", body="""
    SELECT community, month, n_newcomers_rolling, round(ei_index_rolling,6) AS ei_index_rolling FROM ei_both"""))
def ei_index_rolling(spark, folder):
    pairs, _ = month_graph(spark, folder)
    rolling = graph.ei_index(pairs, rolling_months(spark, folder), MONTH, "ei_index_rolling")
    return rounded(rolling.select(*MONTH, F.col("n_newcomers").alias("n_newcomers_rolling"), "ei_index_rolling"))


@check("join_event_vs_rolling_ei", with_views("ei_both", body="""
    SELECT community, month, n_newcomers_rolling, round(ei_index_rolling,6) AS ei_index_rolling, round(ei_index_event,6) AS ei_index_event FROM ei_both"""))
def join_event_vs_rolling_ei(spark, folder):
    return rounded(ei_both(spark, folder))


@check("ei_correlation_summary", with_views("ei_both", body="""
    SELECT community, round(CASE WHEN stddev_pop(ei_index_event)>0 AND stddev_pop(ei_index_rolling)>0 THEN corr(ei_index_event, ei_index_rolling) END,6) AS correlation,
      round(avg(ei_index_rolling) FILTER (month < '1999-04'),6) AS pre_mean, round(avg(ei_index_rolling) FILTER (month >= '1999-04'),6) AS post_mean
    FROM ei_both GROUP BY community"""))
def ei_correlation_summary(spark, folder):
    from tideline.operators import comparisons

    cutoff = F.lit(ORDER_CALENDAR.days[2]).cast("timestamp")
    return rounded(comparisons.ei_correlation_summary(ei_both(spark, folder), cutoff))


VIEW_SQL["gini_week"] = (("deg_week",), """
    SELECT community, week, (2*sum(i*degree) - (count(*)+1)*sum(degree))/(count(*)*sum(degree)) AS gini
    FROM (SELECT *, row_number() OVER (PARTITION BY community, week ORDER BY degree) AS i FROM deg_week) GROUP BY ALL""")


@check("gini", with_views("gini_week", body="SELECT community, week, round(gini,6) AS gini FROM gini_week"))
def gini(spark, folder):
    _, nodes = week_graph(spark, folder)
    return rounded(graph.gini(graph.degree_histogram(nodes, WEEK), WEEK))


VIEW_SQL["dynamics"] = (("lab_month", "pairs_month"), """
    SELECT community, month, n_nodes, n_edges, n_newcomers, n_existing, newcomer_gini, existing_gini,
      CASE WHEN n_newcomers>0 AND n_existing>0 THEN p90 END AS hub_threshold_p90, CASE WHEN n_newcomers>0 AND n_existing>0 THEN hub_rate END AS newcomer_hub_rate,
      dn/dt AS newcomer_degree_share, n_newcomers/n_nodes AS newcomer_pop_share, (dn/dt)/nullif(n_newcomers/n_nodes,0) AS degree_share_ratio,
      dn/nullif(n_newcomers,0) AS mean_newcomer_degree, (dt-dn)/nullif(n_existing,0) AS mean_existing_degree
    FROM (SELECT community, month, count(*) AS n_nodes, count(*) FILTER (label='newcomer') AS n_newcomers, count(*) FILTER (label='existing') AS n_existing,
        coalesce(sum(degree) FILTER (label='newcomer'),0) AS dn, sum(degree) AS dt, any_value(p90) AS p90,
        avg(CASE WHEN degree>p90 THEN 1.0 ELSE 0.0 END) FILTER (label='newcomer') AS hub_rate
      FROM lab_month LEFT JOIN (SELECT community, month, quantile_cont(degree,0.9) AS p90 FROM lab_month WHERE label='existing' GROUP BY ALL) USING (community, month)
      GROUP BY community, month)
    JOIN (SELECT community, month, count(*) AS n_edges FROM pairs_month GROUP BY ALL) USING (community, month)
    LEFT JOIN (SELECT community, month, max(g) FILTER (label='newcomer') AS newcomer_gini, max(g) FILTER (label='existing') AS existing_gini
      FROM (SELECT community, month, label, (2*sum(i*degree) - (count(*)+1)*sum(degree))/(count(*)*sum(degree)) AS g
        FROM (SELECT *, row_number() OVER (PARTITION BY community, month, label ORDER BY degree) AS i FROM lab_month) GROUP BY ALL) GROUP BY ALL) USING (community, month)""")
DYNAMICS_COLUMNS = ", ".join(f"round({c},6) AS {c}" for c in ("hub_threshold_p90", *hubs.WEIGHTED_DYNAMICS))


def dynamics(spark, folder):
    pairs, _ = month_graph(spark, folder)
    return hubs.degree_dynamics(pairs, labelled_months(spark, folder), MONTH)


@check("degree_dynamics", with_views("dynamics", body=f"""
    SELECT community, month, n_nodes, n_edges, n_newcomers, n_existing, {DYNAMICS_COLUMNS} FROM dynamics"""))
def degree_dynamics(spark, folder):
    return rounded(dynamics(spark, folder))


@check("global_weighted_degree_dynamics", with_views("dynamics", body="""
    , g AS (SELECT month, CAST(sum(n_nodes) AS BIGINT) AS n_nodes, CAST(sum(n_edges) AS BIGINT) AS n_edges, CAST(sum(n_newcomers) AS BIGINT) AS n_newcomers,
      CAST(sum(n_existing) AS BIGINT) AS n_existing, """ + ", ".join(
        f"sum({c}*n_nodes)/sum(CASE WHEN {c} IS NOT NULL THEN n_nodes END) AS {c}" for c in hubs.WEIGHTED_DYNAMICS) + """
      FROM dynamics GROUP BY month)
    SELECT month, n_nodes, n_edges, n_newcomers, n_existing, """ + ", ".join(
        f"round({c},6) AS {c}" for c in hubs.WEIGHTED_DYNAMICS if c != "degree_share_ratio") + """,
      round(CASE WHEN newcomer_pop_share>0 THEN newcomer_degree_share/newcomer_pop_share ELSE degree_share_ratio END,6) AS degree_share_ratio FROM g"""))
def global_weighted_degree_dynamics(spark, folder):
    return rounded(hubs.global_weighted_dynamics(dynamics(spark, folder)))


VIEW_SQL["sensitivity"] = (("lab_month",), """
    SELECT community, month, f AS hub_fraction, t AS hub_threshold, count(*) FILTER (degree>=t) AS n_hubs, count(*) FILTER (label='newcomer') AS n_newcomers,
      count(*) FILTER (degree>=t AND label='newcomer')/nullif(count(*) FILTER (degree>=t),0) AS newcomer_hub_share,
      count(*) FILTER (degree>=t AND label='newcomer')/nullif(count(*) FILTER (label='newcomer'),0) AS newcomer_hub_rate,
      CASE WHEN count(*) FILTER (label='newcomer')>0 THEN o END AS existing_threshold,
      CASE WHEN o IS NOT NULL THEN count(*) FILTER (degree>o AND label='newcomer')/nullif(count(*) FILTER (label='newcomer'),0) END AS newcomer_hub_rate_vs_existing
    FROM lab_month JOIN (SELECT community, month, f, quantile_cont(degree, 1-f) AS t, quantile_cont(degree, 1-f) FILTER (label='existing') AS o FROM (
        SELECT community, month, degree, label, 0.05::DOUBLE AS f FROM lab_month UNION ALL SELECT community, month, degree, label, 0.1 FROM lab_month
        UNION ALL SELECT community, month, degree, label, 0.2 FROM lab_month) GROUP BY community, month, f) USING (community, month)
    GROUP BY community, month, f, t, o""")
VIEW_SQL["sensitivity"] = (("lab_month",), VIEW_SQL["sensitivity"][1].replace(
    "quantile_cont(degree, 1-f) AS t, quantile_cont(degree, 1-f) FILTER (label='existing') AS o FROM (",
    "CASE f WHEN 0.05 THEN quantile_cont(degree,0.95) WHEN 0.1 THEN quantile_cont(degree,0.9) ELSE quantile_cont(degree,0.8) END AS t, "
    "CASE f WHEN 0.05 THEN quantile_cont(degree,0.95) FILTER (label='existing') WHEN 0.1 THEN quantile_cont(degree,0.9) FILTER (label='existing') "
    "ELSE quantile_cont(degree,0.8) FILTER (label='existing') END AS o FROM ("))


@check("hub_threshold_sensitivity", with_views("sensitivity", body="""
    SELECT community, month, hub_fraction, round(hub_threshold,6) AS hub_threshold, n_hubs, n_newcomers, round(newcomer_hub_share,6) AS newcomer_hub_share,
      round(newcomer_hub_rate,6) AS newcomer_hub_rate, round(existing_threshold,6) AS existing_threshold,
      round(newcomer_hub_rate_vs_existing,6) AS newcomer_hub_rate_vs_existing FROM sensitivity"""))
def hub_threshold_sensitivity(spark, folder):
    return rounded(hubs.hub_threshold_sensitivity(labelled_months(spark, folder), MONTH))


@check("hub_sensitivity_summary", with_views("sensitivity", body="""
    SELECT community, hub_fraction, round(max(newcomer_hub_share),6) AS max_hub_share, round(median(newcomer_hub_share),6) AS median_hub_share,
      round(max(newcomer_hub_rate),6) AS max_hub_rate, round(median(newcomer_hub_rate_vs_existing),6) AS median_rate_vs_existing,
      round(max(newcomer_hub_rate_vs_existing),6) AS max_rate_vs_existing FROM sensitivity GROUP BY community, hub_fraction"""))
def hub_sensitivity_summary(spark, folder):
    found = hubs.hub_threshold_sensitivity(labelled_months(spark, folder), MONTH)
    return rounded(hubs.hub_sensitivity_summary(found))


VIEW_SQL["top_hubs"] = (("deg_month",), """
    SELECT community, month, node, degree, f AS hub_fraction FROM (
      SELECT *, row_number() OVER (PARTITION BY community, month, f ORDER BY degree DESC, node) AS r, count(*) OVER (PARTITION BY community, month, f) AS n
      FROM deg_month, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) v(f)) WHERE r <= greatest(1, ceil(round(n*f, 9)))""")


@check("top_fraction_hubs", with_views("top_hubs", body="SELECT community, month, node, degree, hub_fraction FROM top_hubs"))
def top_fraction_hubs(spark, folder):
    return hubs.top_fraction_hubs(month_graph(spark, folder)[1], MONTH)


VIEW_SQL["node_cohorts"] = (("node_first",), """
    SELECT community, node, """ + FIXED_SQL.format(ts="CAST(first_month||'-01' AS TIMESTAMP)") + """ AS fixed_cohort FROM node_first WHERE node[1]='c'""")
VIEW_SQL["cohort_share"] = (("deg_month", "node_cohorts"), """
    SELECT community, month, fixed_cohort, n AS cohort_active_nodes, n/sum(n) OVER w AS cohort_pop_share, d/sum(d) OVER w AS cohort_degree_share,
      (d/sum(d) OVER w)/(n/sum(n) OVER w) AS degree_share_ratio
    FROM (SELECT community, month, fixed_cohort, count(*) AS n, sum(degree) AS d FROM deg_month JOIN node_cohorts USING (community, node) GROUP BY ALL)
    WINDOW w AS (PARTITION BY community, month)""")


def node_cohorts(spark, folder, nodes=None):
    customers = node_first_month(spark, folder, nodes).where(F.col("node").startswith("c"))
    cohort = ORDER_CALENDAR.fixed_cohort(timeparts.month_start(F.col("first_month")))
    return customers.select("community", "node", cohort.alias("fixed_cohort"))


def cohort_share(spark, folder, nodes=None):
    held, nodes = nodes, month_graph(spark, folder)[1] if nodes is None else nodes
    known = nodes.join(node_cohorts(spark, folder, held), ["community", "node"])
    return hubs.cohort_degree_share(known, MONTH)


@check("cohort_degree_share", with_views("cohort_share", body="""
    SELECT community, month, fixed_cohort, cohort_active_nodes, round(cohort_pop_share,6) AS cohort_pop_share,
      round(cohort_degree_share,6) AS cohort_degree_share, round(degree_share_ratio,6) AS degree_share_ratio FROM cohort_share"""))
def cohort_degree_share(spark, folder):
    return rounded(cohort_share(spark, folder))


VIEW_SQL["hub_flags"] = (("top_hubs",), """
    SELECT community, node, bool_or(hub_fraction=0.05) AS ever_hub_top5, bool_or(hub_fraction=0.1) AS ever_hub_top10, bool_or(hub_fraction=0.2) AS ever_hub_top20
    FROM top_hubs GROUP BY ALL""")


@check("ever_hub", with_views("hub_flags", body="SELECT community, node, ever_hub_top5, ever_hub_top10, ever_hub_top20 FROM hub_flags"))
def ever_hub(spark, folder):
    return hubs.ever_hub(hubs.top_fraction_hubs(month_graph(spark, folder)[1], MONTH))


@check("join_hub_flags", with_views("hub_flags", "node_cohorts", body="""
    SELECT community, node, fixed_cohort, coalesce(ever_hub_top5,false) AS ever_hub_top5, coalesce(ever_hub_top10,false) AS ever_hub_top10,
      coalesce(ever_hub_top20,false) AS ever_hub_top20 FROM node_cohorts LEFT JOIN hub_flags USING (community, node)"""))
def join_hub_flags(spark, folder):
    flags = hubs.ever_hub(hubs.top_fraction_hubs(month_graph(spark, folder)[1], MONTH))
    return hubs.join_hub_flags(node_cohorts(spark, folder), flags, ["community", "node"])


def for_platform_months(sql: str) -> str:
    """SQL over weekly snapshots as SQL over the monthly ones of both platforms."""
    for stem in ("pairs", "deg", "clustering", "lab"):
        sql = sql.replace(f"{stem}_week", f"{stem}_pm")
    return re.sub(r"\bweek\b", "month", sql)


VIEW_SQL["clustering_pm"] = (("pairs_pm", "deg_pm"), for_platform_months(VIEW_SQL["clustering_week"][1]))
VIEW_SQL["snapshot_pm"] = (
    ("pairs_pm", "deg_pm", "clustering_pm"),
    # Small snapshots have correlations that end in a five at the seventh digit; both sides see nine digits first.
    "WITH RECURSIVE "
    + for_platform_months(SNAPSHOT_SQL).lstrip().removeprefix(",").replace(
        "round(CASE WHEN stddev_pop(da)>0 THEN corr(da, db) END,6)",
        "round(round(CASE WHEN stddev_pop(da)>0 THEN corr(da, db) END,9),6)",
    ),
)
PLATFORM_MONTH = ["platform", "community", "month"]
SNAPSHOT_SHOWN = ", ".join(rollups.NETWORK_COLUMNS)


def platform_graph(spark, folder):
    """Pairs and degrees of the monthly snapshots, each written down once."""
    edges = standins.edges_platform_month(spark, folder)
    pairs = cut_lineage(graph.dedup_edges(edges, PLATFORM_MONTH))
    return pairs, cut_lineage(graph.pair_degrees(pairs, PLATFORM_MONTH))


def platform_network(spark, folder):
    return network.network_snapshot(standins.edges_platform_month(spark, folder), PLATFORM_MONTH)


@check("join_network_metrics", with_views("community_month", "snapshot_pm", body=f"""
    SELECT m.platform, m.community, m.month, active_users, round(toxicity_mean,6) AS toxicity_mean, {SNAPSHOT_SHOWN}
    FROM community_month m LEFT JOIN snapshot_pm s ON s.community = m.platform||'|'||m.community AND s.month = m.month"""))
def join_network_metrics(spark, folder):
    """Every snapshot metric of either platform's network."""
    from tideline.plans import shared

    joined = rollups.join_network_metrics(
        shared.community_month(spark, folder), platform_network(spark, folder), PLATFORM_MONTH
    )
    shown = joined.select(*PLATFORM_MONTH, "active_users", "toxicity_mean", *rollups.NETWORK_COLUMNS)
    return rounded(shown.withColumn("degree_assortativity", F.round("degree_assortativity", 9)))


@check("path_metrics_month", with_views("snapshot_pm", body="""
    SELECT split_part(community, '|', 1) AS platform, split_part(community, '|', 2) AS community, month,
      giant_component_size, giant_component_fraction, avg_shortest_path, diameter FROM snapshot_pm"""))
def path_metrics_month(spark, folder):
    """Paths of the monthly snapshots of either platform."""
    pairs, nodes = platform_graph(spark, folder)
    found = components.connected_components(pairs, nodes, PLATFORM_MONTH)
    return rounded(components.path_metrics(pairs, found, PLATFORM_MONTH))


VIEW_SQL["lab_pm"] = (("edges_pm", "deg_pm"), f"""
    SELECT d.community, d.month, d.node, {_CUSTOMER_LABEL} AS label
    FROM deg_pm d JOIN (SELECT community, source AS node, min(month) AS first_month FROM edges_pm GROUP BY ALL) f
      ON f.community=d.community AND f.node=d.node""")


def platform_month_labels(edges, nodes):
    """Labels per month of the nodes that ever act; others have none."""
    keys = ["platform", "community"]
    # Numbers of months are kept in a hash table, strings would be sorted.
    first = F.min(timeparts.month_index(F.col("month")))
    first = edges.groupBy(*keys, F.col("source").alias("node")).agg(
        F.when(first.isNotNull(), timeparts.month_from_index(first)).alias("first_month")
    )
    label = labels.newcomer_label(
        timeparts.month_start(F.col("first_month")), timeparts.month_start(F.col("month")), DAYS
    )
    return nodes.join(first.hint("shuffle_hash"), [*keys, "node"]).select(*PLATFORM_MONTH, "node", label.alias("label"))


def platform_partition(pairs, nodes, labels, ends):
    """Mixing of newcomers and existing nodes, from pairs, degrees, labels and ends that are made once."""
    return graph.partition_metrics(pairs, nodes, labels, PLATFORM_MONTH, [*PLATFORM_MONTH, "node"], ends)
