"""Bucketed tables and user-months that grow by files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tideline.operators import rollups
from tideline.session import drop_folder, fresh_folder
from tideline.sources.activity import scan_activity
from tideline.sources.bucketed import bucket_count, open_bucketed, write_bucketed
from tideline.sources.user_month_store import UserMonthStore

SCORES = {"mean_toxicity": "toxicity"}


@pytest.fixture
def no_broadcast(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def tables(spark):
    months = spark.range(3_000).select(
        F.lit("p").alias("platform"), F.lit("c").alias("community"), (F.col("id") % 701).cast("string").alias("user_id"),
        F.concat(F.lit("2020-0"), (F.floor(F.col("id") / 701) + 1).cast("string")).alias("month"), F.col("id").alias("activity_count"),
    )
    days = months.where("activity_count % 3 <> 0").select(
        "platform", "community", "user_id", "month", F.explode(F.array(F.lit(0.5), F.lit(1.5), F.col("activity_count") / 7)).alias("reputation")
    )
    return months, days


def test_bucketed_tables_join_without_an_exchange(spark, no_broadcast):
    months, days = tables(spark)
    places = [fresh_folder(spark, "bucketed") for _ in range(2)]
    expected = rows(rollups.join_user_month_reputation(months, rollups.reputation_user_month(days)))
    written = [write_bucketed(df, place, 8) for df, place in zip((months, days), places)]
    for a, b in (written, [open_bucketed(spark, place) for place in places]):
        joined = rollups.join_user_month_reputation(a, rollups.reputation_user_month(b))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert rows(joined) == expected
    assert sorted(written[0].columns) == sorted(months.columns)


def test_a_bucket_is_one_file_and_tables_are_replaced(spark):
    months, _ = tables(spark)
    place = fresh_folder(spark, "bucketed")
    write_bucketed(months, place, 8)
    files = months.sparkSession.read.parquet(place).select(F.input_file_name()).distinct().count()
    assert files <= 8
    write_bucketed(months.where("activity_count < 10"), place, 4)
    assert open_bucketed(spark, place).count() == 10


def activity(spark, seed, n):
    draw = random.Random(seed)
    data = [
        (draw.choice(["POST", "comment", "VOTE"]), f"u{draw.randrange(12)}", 1_430_000_000 + draw.randrange(200 * 86_400), draw.random() if draw.random() < 0.9 else None)
        for _ in range(n)
    ]
    df = spark.createDataFrame(data, "interaction_type string, user_id string, publish_date long, toxicity double")
    return df.withColumn("platform", F.lit("p")).withColumn("community", F.lit("c"))


def same(found, expected):
    mine, theirs = (sorted(map(tuple, df.select("user_id", "month", "activity_count", "mean_toxicity").collect())) for df in (found, expected))
    assert [r[:3] for r in mine] == [r[:3] for r in theirs]
    for a, b in zip(mine, theirs):
        assert a[3] == (None if b[3] is None else pytest.approx(b[3]))


def test_appends_and_repeats_come_to_one_full_run(spark):
    place, home = fresh_folder(spark, "in"), fresh_folder(spark, "store")
    store = UserMonthStore(spark, home, scan_activity, SCORES)
    with pytest.raises(ValueError):
        store.user_months()
    activity(spark, 1, 300).repartition(2).write.parquet(place)
    assert store.append(place) == 2 and store.append(place) == 0
    activity(spark, 2, 200).repartition(3).write.mode("append").parquet(place)
    assert store.append(place) == 3
    # Another store object on the same folder knows what has been taken.
    again = UserMonthStore(spark, home, scan_activity, SCORES)
    assert again.append(place) == 0
    whole = scan_activity(spark, place)
    same(again.user_months(), rollups.user_month_metrics(whole, SCORES))
    first = {r.user_id: r.first_seen for r in again.first_seen().collect()}
    assert first == {r.user_id: r.t for r in whole.groupBy("user_id").agg(F.min("ts").alias("t")).collect()}


def test_a_run_that_broke_off_counts_nothing(spark):
    place, home = fresh_folder(spark, "in"), fresh_folder(spark, "store")
    store = UserMonthStore(spark, home, scan_activity, SCORES)
    activity(spark, 3, 100).write.parquet(place)
    store.append(place)
    (run,) = [p.split("/")[-1] for p in store._paths("files")]
    drop_folder(spark, f"{home}/files/{run}")
    with pytest.raises(ValueError):
        store.user_months()
    assert store.append(place) > 0
    same(store.user_months(), rollups.user_month_metrics(scan_activity(spark, place), SCORES))


def test_a_changed_file_is_refused(spark, tmp_path):
    place = str(tmp_path / "in")
    store = UserMonthStore(spark, str(tmp_path / "store"), scan_activity, SCORES)
    activity(spark, 4, 50).coalesce(1).write.parquet(place)
    store.append(place)
    (file,) = (tmp_path / "in").glob("*.parquet")
    other = str(tmp_path / "other")
    activity(spark, 5, 80).coalesce(1).write.parquet(other)
    (new,) = (tmp_path / "other").glob("*.parquet")
    file.write_bytes(new.read_bytes())
    file.with_name(f".{file.name}.crc").write_bytes(new.with_name(f".{new.name}.crc").read_bytes())
    with pytest.raises(ValueError):
        store.append(place)


def test_buckets_grow_with_the_keys():
    assert [bucket_count(n) for n in (0, 1, 1 << 20, (1 << 20) + 1, 54_000_000)] == [16, 16, 16, 17, 824]
