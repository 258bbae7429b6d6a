"""Calendars as tables: the rules of the literal calendar, any number of events, each pair once."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.functions.calendar import STUDY_CALENDAR
from tideline.functions.labels import event_cohort
from tideline.operators import calendars

EDGES = ["2015-06-09", "2015-06-10", "2016-11-22", "2016-11-23", "2018-09-11", "2018-09-12", "2020-06-28", "2020-06-29", "2020-12-30", "2020-12-31"]


def study_rows(end=False):
    rows = [("c", letter, day) for letter, day in zip(STUDY_CALENDAR.letters, STUDY_CALENDAR.days)]
    return rows + ([("c", "end", STUDY_CALENDAR.end)] if end else [])


def times(spark, days):
    df = spark.createDataFrame([("c", d) for d in days], "community string, d string")
    return df.select("community", F.to_timestamp("d").alias("ts"))


def test_steps_follow_the_rules_of_the_literal_calendar(spark):
    points = times(spark, EDGES)
    held = calendars.with_calendar_step(points, spark.createDataFrame(study_rows(), "community string, event string, day string"), ["community"])
    names = calendars.arrival_cohort_name(F.col("event"), F.col("next_event"))
    rows = held.select(names.alias("a"), STUDY_CALENDAR.arrival_cohort(F.col("ts")).alias("b")).collect()
    assert len(rows) == len(EDGES) and all(r.a == r.b for r in rows)
    ended = spark.createDataFrame(study_rows(end=True), "community string, event string, day string")
    held = calendars.with_calendar_step(points, ended, ["community"])
    names = calendars.event_period_name(F.col("event"), F.col("next_event"))
    rows = held.select(names.alias("a"), STUDY_CALENDAR.event_period(F.col("ts")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and {r.a for r in rows} == {None, *STUDY_CALENDAR.periods}


def test_fixed_cohorts_have_the_names_of_the_literal_calendar(spark):
    keys = [(e.key, e.day) for e in STUDY_CALENDAR.events] + [(STUDY_CALENDAR.end_key, STUDY_CALENDAR.end)]
    table = spark.createDataFrame([("c", k, d) for k, d in keys], "community string, event string, day string")
    held = calendars.with_calendar_step(times(spark, EDGES[:-1]), table, ["community"])
    names = calendars.fixed_cohort_name(F.col("event"), F.col("next_event"))
    rows = held.select(names.alias("a"), STUDY_CALENDAR.fixed_cohort(F.col("ts")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_event_cohorts_match_the_literal_ones(spark):
    table = spark.createDataFrame(study_rows(), "community string, event string, day string")
    users = times(spark, EDGES).withColumnRenamed("ts", "first_seen")
    found = calendars.event_cohorts(users, table, ["community"]).select("first_seen", "event", "cohort_group")
    each = users.select("first_seen", F.explode(STUDY_CALENDAR.as_array()).alias("e"))
    group = event_cohort(F.col("first_seen"), F.col("e.event_ts"), F.col("e.next_ts"))
    expected = each.select("first_seen", F.col("e.event").alias("event"), group.alias("cohort_group"))
    expected = expected.where("cohort_group <> 'future_arrival'")
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, expected.collect()))


def test_calendars_of_any_length_and_odd_rows(spark):
    start = datetime(2020, 1, 1)
    long = [("long", f"e{i:04d}", start + timedelta(days=i * 3)) for i in range(700)]
    other = [("two", "x", datetime(2020, 5, 1)), ("two", "y", datetime(2020, 5, 1)), ("two", "z", datetime(2021, 5, 1))]
    table = spark.createDataFrame(long + other, "community string, event string, day timestamp")
    at = [start + timedelta(hours=h * 37) for h in range(-20, 1400)]
    rows = [(c, t) for c in ("long", "two", "none") for t in at] + [("long", None), ("two", datetime(2020, 5, 1))] * 2
    points = spark.createDataFrame(rows, "community string, ts timestamp").withColumn("start", F.lit(1)).withColumn("_x", F.lit(2))
    held = calendars.with_calendar_step(points, table, ["community"])
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

    def step(c, t):
        mine = sorted((d, e) for k, e, d in long + other if k == c)
        if t is None or not mine:
            return None, None
        past = [e for d, e in mine if d <= t]
        ahead = [e for d, e in mine if d > t]
        return (past[-1] if past else None), (ahead[0] if ahead else None)

    found = Counter((r.community, r.ts, r.event, r.next_event) for r in held.collect())
    assert found == Counter((c, t, *step(c, t)) for c, t in rows)


@pytest.mark.parametrize("most_bins", [1, 64])
def test_overlapping_intervals_meet_each_point_once(spark, most_bins):
    day = timedelta(days=1)
    start = datetime(2021, 3, 1)
    spans = [("a", n, start + a * day, start + b * day) for n, a, b in ((1, 0, 300), (2, 5, 6), (3, 5, 40), (4, 9, 9), (5, 280, 290))]
    intervals = spark.createDataFrame(spans, "k string, number int, start timestamp, end timestamp")
    points = [("a", start + timedelta(hours=7 * i)) for i in range(-5, 1100)] + [("b", start)]
    df = spark.createDataFrame(points, "k string, ts timestamp")
    found = calendars.interval_join(df, intervals, ["k"], "ts", most_bins=most_bins).select("k", "ts", "number").collect()
    expected = Counter((k, t, n) for k, t in points for key, n, a, b in spans if key == k and a <= t < b)
    assert Counter(map(tuple, found)) == expected
    left = calendars.interval_join(df, intervals, ["k"], "ts", "left", most_bins).where("number IS NULL").count()
    assert left == sum(not any(k == key and a <= t < b for key, _, a, b in spans) for k, t in points)
    none = calendars.interval_join(df, intervals.where("false"), ["k"], "ts", "left")
    assert none.count() == len(points)
