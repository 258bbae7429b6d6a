from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tideline.operators import scores
from tideline.session import cut_lineage, shared_folder
from tideline.sources import activity, edges, reputation_files, score_files, sinks


def test_edge_files_take_their_month_from_the_name(spark, tmp_path):
    (tmp_path / "funny_2015-06.txt").write_text("")
    (tmp_path / "funny_2015-07.txt").write_text("# a comment\na b\nb\t c  9\nlonely\n\n")
    (tmp_path / "more_fun_2016-01.txt").write_text("x y\n")
    found = edges.scan_edges(spark, str(tmp_path))
    assert rows(found) == [("funny", "2015-07", "a", "b"), ("funny", "2015-07", "b", "c"), ("more_fun", "2016-01", "x", "y")]


def test_activity_files_are_united_by_name(spark, tmp_path):
    one = spark.createDataFrame([("p1", "u1", 1433894400, "Post"), ("p2", None, 1433894400, "POST")], "post_id string, user_id string, publish_date long, interaction_type string")
    two = spark.createDataFrame([(1433894400000, "comment", 7, "p3", 0.5), (None, "comment", 7, "p4", 0.5)], "publish_date long, interaction_type string, user_id int, post_id string, score double")
    one.write.parquet(str(tmp_path / "one"))
    two.withColumn("user_id", F.col("user_id").cast("string")).write.parquet(str(tmp_path / "two"))
    found = activity.scan_activity(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert rows(found, "post_id", "user_id", "month", "score") == [("p1", "u1", "2015-06", None), ("p3", "7", "2015-06", 0.5)]


def test_partition_filters_prune_folders(spark, tmp_path):
    df = spark.createDataFrame([("a", "X", "u", 1433894400, "post"), ("b", "Y", "u", 1433894400, "post")], "platform string, community string, user_id string, publish_date long, interaction_type string")
    df.write.partitionBy("platform", "community").parquet(str(tmp_path / "t"))
    found = activity.scan_activity(spark, str(tmp_path / "t"), community="x")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(community" in plan
    assert found.count() == 1


def test_legacy_lines(spark, tmp_path):
    (tmp_path / "r.txt").write_text('["ann",1430000000,1440000000]\t{"0": 2.0, "3": 1.25}\n[bob, 1430000000, 1440000000]\t{"1": 0.5}\n')
    found = reputation_files.scan_legacy_reputation(spark, str(tmp_path / "r.txt"))
    assert rows(found, "user_id", "t_min", "day", "reputation") == [("ann", 1430000000, 0, 2.0), ("ann", 1430000000, 3, 1.25), ("bob", 1430000000, 1, 0.5)]


def test_bad_dates_fall_back_on_the_day(spark):
    df = spark.createDataFrame([("u", "1.5", "2015-06-10", 0, 0), ("u", "1.5", "??", 1433894400, 2), ("u", "x", "2015-06-10", 0, 0)], "user_id string, reputation string, date string, t_min long, day int")
    assert rows(reputation_files.prepared_reputation(df).select("month", F.col("date").cast("string").alias("d"))) == [("2015-06", "2015-06-10"), ("2015-06", "2015-06-12")]
    with pytest.raises(ValueError):
        reputation_files.prepared_reputation(df.drop("reputation"))


def test_score_files_drop_rows_without_a_label(spark, tmp_path):
    header = "post_id,publish_date,user_id,interaction_type,community,community_type,a,b\n"
    (tmp_path / "1.csv").write_text(header + "p1,1433894400,u,post,c,normal,0.5,0.25\np2,1433894400,u,post,c,normal,,0.25\n")
    (tmp_path / "2.csv").write_text(header + "p3,1433894400000,u,post,c,normal,0.5,nan\np4,,u,post,c,normal,0.5,0.1\np5,1433894400000,u,post,c,normal,1,0\n")
    found = score_files.scan_scores(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")], ["a", "b"])
    assert rows(found, "post_id", "month", "a") == [("p1", "2015-06", 0.5), ("p5", "2015-06", 1.0)]


def test_a_second_write_replaces_only_its_scopes(spark, tmp_path):
    path = str(tmp_path / "um")
    schema = "platform string, community string, user_id string"
    sinks.write_user_month(spark.createDataFrame([("p", "a", "u1"), ("p", "b", "u2")], schema), path)
    sinks.write_user_month(spark.createDataFrame([("p", "b", "u3")], schema), path)
    assert rows(spark.read.parquet(path), "community", "user_id") == [("a", "u1"), ("b", "u3")]


def make_scorer():
    def score(texts):
        return pd.DataFrame({"length": texts.str.len().astype("float64")})

    return score


def test_a_second_scoring_run_scores_nothing(spark):
    df = spark.createDataFrame([(f"p{i}", "c", "x" * i) for i in range(1, 40)], "post_id string, community string, content string")
    first = cut_lineage(scores.batch_text_scoring(df, make_scorer, ["length"]))
    assert "content" not in first.columns
    assert sum(r["length"] for r in first.collect()) == sum(range(1, 40))
    assert scores.batch_text_scoring(df, make_scorer, ["length"], already=first).count() == 0


def test_blank_texts_and_missing_scores_are_not_eligible(spark):
    df = spark.createDataFrame(
        [("1", "POST", " \n\t", 0.5), ("2", "post", "text", None), ("3", "Post", " text ", 0.5), ("4", "comment", "text", 0.5), ("5", "post", None, 0.5)],
        "post_id string, interaction_type string, content string, s double",
    )
    assert rows(activity.eligible_activity(df, "s", "post"), "post_id") == [("3",)]


def test_samples_take_what_a_small_stratum_has(spark):
    df = spark.createDataFrame([(f"p{i}", "big") for i in range(50)] + [("q", "small")], "post_id string, community string")
    found = scores.stratified_sample(df, ["big", "small"], 11, 1)
    counts = {r["community"]: r["n"] for r in found.groupBy("community").agg(F.count("*").alias("n")).collect()}
    assert counts == {"big": 6, "small": 1}
    assert sorted(r["sample_row_id"] for r in found.collect()) == list(range(1, 8))
    assert rows(found.select("post_id")) == rows(scores.stratified_sample(df.repartition(7), ["big", "small"], 11, 1).select("post_id"))


def test_the_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or spark.sparkContext.getCheckpointDir())
