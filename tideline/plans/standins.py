"""The given tables seen as an activity log, edge lists, reputations and scores.

The library works on activity logs, edge lists and score tables. These views express such inputs
over the star schema the checks run on, so that each check reads the whole of the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.calendar import Event, EventCalendar
from tideline.functions.timeparts import epoch_to_ts, month_key
from tideline.sources.score_files import LABELS  # noqa: F401  (the labels of ``scores``)

# Mid-month dates within the span of the order dates.
ORDER_CALENDAR = EventCalendar(
    events=(
        Event("fph", "1996-04-10"),
        Event("pg", "1997-08-23"),
        Event("ga", "1999-03-12"),
        Event("td", "2000-07-29"),
    ),
    end="2001-08-01",
)

# Dates within the month the events table covers.
EVENT_CALENDAR = EventCalendar(
    events=(
        Event("fph", "2024-01-08"),
        Event("pg", "2024-01-13"),
        Event("ga", "2024-01-18"),
        Event("td", "2024-01-23"),
    ),
    end="2024-01-31",
)

SCORES = {
    "mean_toxicity": "toxicity_toxigen",
    "mean_vader": "sentiment_vader",
    "mean_textblob": "sentiment_textblob",
    "mean_subjectivity": "subjectivity_textblob",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as posts and comments: customers are users, priorities are communities."""
    orders = table(spark, folder, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint") % 997
    return orders.select(
        F.col("o_orderkey").cast("string").alias("post_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("publish_date"),
        F.when(F.col("o_orderstatus") == "P", "POST").otherwise("COMMENT").alias("interaction_type"),
        F.when(F.col("o_custkey") % 3 == 0, "focal").otherwise("reference").alias("platform"),
        F.col("o_orderpriority").alias("community"),
        (cents.cast("double") / 997).alias("toxicity_toxigen"),
        ((cents * 3 + (F.col("o_orderkey") * 7919) % 997).cast("double") / 3988).alias("sentiment_vader"),
        (((F.col("o_orderkey") * 31) % 997).cast("double") / 997).alias("sentiment_textblob"),
        (((F.col("o_custkey") * 17 + F.col("o_orderkey")) % 997).cast("double") / 997).alias("subjectivity_textblob"),
    )


def activity(spark: SparkSession, folder: str) -> DataFrame:
    ts = epoch_to_ts(F.col("publish_date"))
    return raw_activity(spark, folder).withColumn("ts", ts).withColumn("month", month_key(ts))


def event_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Events as activity: 30 days, many events per user and day."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("event_id").cast("string").alias("post_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("community"),
        F.when(F.col("user_id") % 3 == 0, "focal").otherwise("reference").alias("platform"),
        (((F.col("event_id") * 7919) % 997).cast("double") / 997).alias("toxicity_toxigen"),
    )


def edges_week(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly edge lists with triangles, self-loops and nodes that never act."""
    events = table(spark, folder, "events")
    week = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 604800)
    return events.select(
        F.col("event_type").alias("community"),
        week.cast("bigint").alias("week"),
        F.col("user_id").cast("string").alias("source"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") + 75).cast("string").alias("target"),
    )


def edges_month(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly customer-supplier edge lists: large, sparse and without triangles."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    # Orders are hashed, so that neither side is sorted.
    return lines.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("community"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"),
    )


def edges_platform_month(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly edge lists of either platform over whole ids: nodes grow with the tables.

    Customers and suppliers share one range of ids, as in ``edges_week``, so there are triangles.
    """
    # Texts are made once per order, and orders are hashed, so that neither side is sorted.
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 3 == 0, "focal").otherwise("reference").alias("platform"),
        F.col("o_orderpriority").alias("community"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.col("o_custkey").cast("string").alias("source"),
    )
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    return lines.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "platform", "community", "month", "source", F.col("l_suppkey").cast("string").alias("target")
    )


# The same views as DuckDB common table expressions, each with those it builds on.
VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "activity": ((), """
        SELECT CAST(o_orderkey AS VARCHAR) AS post_id, CAST(o_custkey AS VARCHAR) AS user_id,
          CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS publish_date,
          CASE WHEN o_orderstatus='P' THEN 'POST' ELSE 'COMMENT' END AS interaction_type,
          CASE WHEN o_custkey % 3 = 0 THEN 'focal' ELSE 'reference' END AS platform,
          o_orderpriority AS community,
          CAST(CAST(ROUND(o_totalprice*100) AS BIGINT) % 997 AS DOUBLE)/997 AS toxicity_toxigen,
          CAST((CAST(ROUND(o_totalprice*100) AS BIGINT) % 997)*3 + (o_orderkey*7919) % 997 AS DOUBLE)/3988 AS sentiment_vader,
          CAST((o_orderkey*31) % 997 AS DOUBLE)/997 AS sentiment_textblob,
          CAST((o_custkey*17 + o_orderkey) % 997 AS DOUBLE)/997 AS subjectivity_textblob,
          CAST(o_orderdate AS TIMESTAMP) AS ts,
          strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m') AS month
        FROM orders"""),
    "user_month": (("activity",), """
        SELECT platform, community, user_id, month, avg(toxicity_toxigen) AS mean_toxicity,
          avg(sentiment_vader) AS mean_vader, avg(sentiment_textblob) AS mean_textblob,
          avg(subjectivity_textblob) AS mean_subjectivity, count(*) AS activity_count
        FROM activity GROUP BY ALL"""),
    "community_month": (("user_month",), """
    SELECT platform, community, month, count(DISTINCT user_id) AS active_users,
      CAST(sum(activity_count) AS BIGINT) AS total_activity,
      avg(mean_toxicity) AS toxicity_mean, stddev_samp(mean_toxicity) AS toxicity_std,
      avg(mean_vader) AS vader_mean, stddev_samp(mean_vader) AS vader_std,
      avg(mean_textblob) AS textblob_mean, stddev_samp(mean_textblob) AS textblob_std,
      avg(mean_subjectivity) AS subjectivity_mean, stddev_samp(mean_subjectivity) AS subjectivity_std
    FROM user_month GROUP BY ALL"""),
    "event_activity": ((), """
        SELECT CAST(event_id AS VARCHAR) AS post_id, CAST(user_id AS VARCHAR) AS user_id,
          CAST(ts AS TIMESTAMP) AS ts, event_type AS community,
          CASE WHEN user_id % 3 = 0 THEN 'focal' ELSE 'reference' END AS platform,
          CAST((event_id*7919) % 997 AS DOUBLE)/997 AS toxicity_toxigen
        FROM events"""),
    "edges_week": ((), """
        SELECT event_type AS community,
          CAST(floor((floor(epoch(CAST(ts AS TIMESTAMP))) - 1704067200)/604800) AS BIGINT) AS week,
          CAST(user_id AS VARCHAR) AS source,
          CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 75 AS VARCHAR) AS target
        FROM events"""),
    "edges_month": ((), """
        SELECT o_orderpriority AS community, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m') AS month,
          'c' || o_custkey AS source, 's' || l_suppkey AS target
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    # One name for platform and community, so that views of monthly snapshots read it like a community.
    "edges_pm": ((), """
        SELECT CASE WHEN o_custkey % 3 = 0 THEN 'focal' ELSE 'reference' END || '|' || o_orderpriority AS community,
          strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m') AS month,
          CAST(o_custkey AS VARCHAR) AS source, CAST(l_suppkey AS VARCHAR) AS target
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "pairs_pm": (("edges_pm",), """
        SELECT DISTINCT community, month, least(source, target) AS a, greatest(source, target) AS b FROM edges_pm"""),
    "deg_pm": (("pairs_pm",), """
        SELECT community, month, node, count(*) AS degree
        FROM (SELECT community, month, a AS node FROM pairs_pm UNION ALL SELECT community, month, b FROM pairs_pm)
        GROUP BY ALL"""),
    "pairs_week": (("edges_week",), """
        SELECT DISTINCT community, week, least(source, target) AS a, greatest(source, target) AS b FROM edges_week"""),
    "pairs_month": (("edges_month",), """
        SELECT DISTINCT community, month, least(source, target) AS a, greatest(source, target) AS b FROM edges_month"""),
    "deg_week": (("pairs_week",), """
        SELECT community, week, node, count(*) AS degree
        FROM (SELECT community, week, a AS node FROM pairs_week UNION ALL SELECT community, week, b FROM pairs_week)
        GROUP BY ALL"""),
    "deg_month": (("pairs_month",), """
        SELECT community, month, node, count(*) AS degree
        FROM (SELECT community, month, a AS node FROM pairs_month UNION ALL SELECT community, month, b FROM pairs_month)
        GROUP BY ALL"""),
}


def with_views(*names: str, body: str) -> str:
    """``body`` behind the common table expressions it names, each placed after those it needs."""
    placed: dict[str, str] = {}

    def place(name: str) -> None:
        if name in placed:
            return
        needs, sql = VIEW_SQL[name]
        for need in needs:
            place(need)
        placed[name] = sql

    for name in names:
        place(name)
    head = ",\n".join(f"{name} AS ({sql})" for name, sql in placed.items())
    return f"WITH {head}{',' if body.lstrip().startswith('+') else ''}\n{body.lstrip().lstrip('+')}"


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """The activity log with six scores and a community type."""
    key = F.col("post_id").cast("bigint")
    kind = (
        F.when(F.col("community").isin("1-URGENT", "2-HIGH"), "controversial")
        .when(F.col("community").isin("3-MEDIUM", "5-LOW"), "normal")
        .otherwise("unknown")
    )
    return activity(spark, folder).select(
        "post_id",
        "publish_date",
        "ts",
        "month",
        "user_id",
        "interaction_type",
        "community",
        kind.alias("community_type"),
        "toxicity_toxigen",
        F.col("sentiment_vader").alias("detoxify_toxicity"),
        F.col("sentiment_textblob").alias("detoxify_severe_toxicity"),
        F.col("subjectivity_textblob").alias("detoxify_identity_attack"),
        (((key * 53) % 997).cast("double") / 997).alias("detoxify_insult"),
        (((key * 101) % 991).cast("double") / 991).alias("detoxify_threat"),
    )


VIEW_SQL["scores"] = (("activity",), """
    SELECT post_id, publish_date, ts, month, user_id, interaction_type, community,
      CASE WHEN community IN ('1-URGENT','2-HIGH') THEN 'controversial' WHEN community IN ('3-MEDIUM','5-LOW') THEN 'normal' ELSE 'unknown' END AS community_type,
      toxicity_toxigen, sentiment_vader AS detoxify_toxicity, sentiment_textblob AS detoxify_severe_toxicity, subjectivity_textblob AS detoxify_identity_attack,
      CAST((CAST(post_id AS BIGINT)*53) % 997 AS DOUBLE)/997 AS detoxify_insult, CAST((CAST(post_id AS BIGINT)*101) % 991 AS DOUBLE)/991 AS detoxify_threat
    FROM activity""")
VIEW_SQL["scores_long"] = (("scores",), """
    UNPIVOT (SELECT post_id, ts, month, user_id, interaction_type, community, community_type, toxicity_toxigen AS toxigen_toxicity, detoxify_toxicity,
      detoxify_severe_toxicity AS detoxify_severe, detoxify_identity_attack AS detoxify_identity, detoxify_insult, detoxify_threat FROM scores)
    ON toxigen_toxicity, detoxify_toxicity, detoxify_severe, detoxify_identity, detoxify_insult, detoxify_threat INTO NAME label VALUE v""")
VIEW_SQL["scores_scoped"] = (("scores_long",), """
    SELECT * REPLACE ('global' AS community_type, 'global' AS community) FROM scores_long UNION ALL
    SELECT * REPLACE ('global' AS community) FROM scores_long UNION ALL SELECT * FROM scores_long""")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as posts and comments with text; some have no score."""
    documents = table(spark, folder, "documents")
    key = F.col("doc_id")
    return documents.select(
        key.cast("string").alias("post_id"),
        F.when(key % 3 == 0, "POST").otherwise("COMMENT").alias("interaction_type"),
        F.when(key % 29 != 0, F.col("text")).alias("content"),
        F.col("source").alias("community"),
        F.when(key % 11 != 0, ((key * 7919) % 997).cast("double") / 997).alias("toxicity_toxigen"),
    )


VIEW_SQL["texts"] = ((), """
    SELECT CAST(doc_id AS VARCHAR) AS post_id, CASE WHEN doc_id % 3 = 0 THEN 'POST' ELSE 'COMMENT' END AS interaction_type,
      CASE WHEN doc_id % 29 <> 0 THEN text END AS content, source AS community,
      CASE WHEN doc_id % 11 <> 0 THEN CAST((doc_id*7919) % 997 AS DOUBLE)/997 END AS toxicity_toxigen FROM documents""")
VIEW_SQL["eligible"] = (("texts",), r"""
    SELECT * FROM texts WHERE interaction_type='POST' AND trim(regexp_replace(coalesce(content,''), '\s', ' ', 'g')) <> '' AND toxicity_toxigen IS NOT NULL""")
