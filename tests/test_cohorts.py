from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tideline.functions import timeparts
from tideline.functions.calendar import STUDY_CALENDAR
from tideline.operators import cohorts, survival

SCHEMA = "user_id string, community string, ts timestamp, score double"


def activity(spark, data):
    df = spark.createDataFrame(data, "user_id string, community string, day string, score double")
    return df.select("user_id", "community", F.col("day").cast("timestamp").alias("ts"), "score")


def test_milliseconds_are_told_by_size(spark):
    df = spark.createDataFrame([("1433894400000",), ("1433894400",), ("soon",)], "v string")
    shown = [r[0] for r in df.select(F.date_format(timeparts.epoch_to_ts(F.col("v")), "yyyy-MM-dd")).collect()]
    assert shown == ["2015-06-10", "2015-06-10", None]


def test_an_event_day_belongs_to_the_later_cohort(spark):
    days = ["2015-06-09", "2015-06-10", "2016-11-23", "2018-09-12", "2020-06-29"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select("d", F.col("d").cast("timestamp").alias("ts"))
    found = dict(df.select("d", STUDY_CALENDAR.arrival_cohort(F.col("ts"))).collect())
    assert [found[d] for d in days] == ["beforeA", "betweenA-B", "betweenB-C", "betweenC-D", "afterD"]
    fixed = dict(df.select("d", STUDY_CALENDAR.fixed_cohort(F.col("ts"))).collect())
    assert [fixed[d] for d in days] == ["pre_fph", "fph_pg", "pg_ga", "ga_td", "td_shutdown"]


def test_pooled_cohorts_follow_the_earliest_row(spark):
    df = activity(spark, [("u1", "x", "2015-06-09", 1.0), ("u1", "y", "2020-07-01", 1.0), ("u2", "y", "2020-07-01", 1.0)])
    days = cohorts.user_days(df, "score", [])
    tagged = cohorts.with_arrival_cohort(days, df, STUDY_CALENDAR, [])
    assert rows(tagged, "user_id", "cohort") == [("u1", "beforeA"), ("u1", "beforeA"), ("u2", "afterD")]


def test_sliding_window_means_and_errors(spark):
    df = activity(spark, [
        ("u1", "f", "2015-06-10", 0.0), ("u1", "f", "2015-06-11", 1.0), ("u2", "f", "2015-06-10", 1.0), ("u3", "f", "2015-06-15", 0.2),
    ])
    found = cohorts.sliding_window_timeseries(df, STUDY_CALENDAR, "score", window_days=2)
    assert found.count() == 5 * 5
    row = found.where("window_tmin = '2015-06-10' and cohort = 'betweenA-B'").first()
    assert (row["active_users"], row["activity_count"]) == (2, 3)
    assert row["user_mean"] == pytest.approx(0.75) and row["activity_mean"] == pytest.approx(2 / 3)
    assert row["user_se"] == pytest.approx(0.25) and row["activity_se"] == pytest.approx(1 / 6)
    empty = found.where("window_tmin = '2015-06-10' and cohort = 'afterD'").first()
    assert (empty["active_users"], empty["user_mean"]) == (0, None)
    assert found.where("window_tmin = '2015-06-14' and cohort = 'betweenA-B'").first()["user_se"] is None


def test_steps_wider_than_a_day(spark):
    df = activity(spark, [("u", "f", f"2015-06-{d:02d}", 0.5) for d in range(10, 20)])
    found = cohorts.sliding_window_timeseries(df, STUDY_CALENDAR, "score", window_days=3, step_days=2)
    own = found.where("cohort = 'betweenA-B'")
    assert rows(own, "step", "window_tmin", "activity_count") == [
        (0, "2015-06-10", 3), (2, "2015-06-12", 3), (4, "2015-06-14", 3), (6, "2015-06-16", 3),
    ]


def test_period_summary_starts_at_the_first_event(spark):
    df = activity(spark, [("old", "f", "2015-06-09", 1.0), ("old", "f", "2015-06-10", 0.2), ("new", "f", "2020-07-01", 0.8)])
    found = {r["cohort"]: r for r in cohorts.cohort_period_summary(df, STUDY_CALENDAR, "score").collect()}
    assert found["beforeA"]["activity_count"] == 1 and found["beforeA"]["activity_mean"] == pytest.approx(0.2)
    assert found["afterD"]["activity_count"] == 1 and found["betweenB-C"]["activity_count"] == 0


def test_weekly_windows_count_unscored_and_foreign_first_activity(spark):
    df = activity(spark, [
        ("u1", "x", "2015-06-01", None), ("u1", "x", "2015-06-11", 0.8),
        ("u2", "x", "2015-06-02", 0.1), ("u2", "y", "2015-06-12", 0.4),
        ("u3", "y", "2015-06-12", 0.6),
    ])
    found = cohorts.weekly_event_window(df, STUDY_CALENDAR, "score").where("event = 'A' and relative_week = 0")
    shown = {(r["community"], r["cohort_group"]): (r["n_users"], round(r["user_mean"], 6)) for r in found.collect()}
    assert shown == {
        ("x", "existing"): (1, 0.8), ("y", "existing"): (1, 0.4), ("y", "event_arrival"): (1, 0.6),
        ("global", "existing"): (2, 0.6), ("global", "event_arrival"): (1, 0.6),
    }


def test_periods_go_by_exact_time(spark):
    df = activity(spark, [("u", "f", "2015-06-09 23:59:59", 1.0), ("u", "f", "2015-06-10", 1.0), ("u", "f", "2020-12-31", 1.0)])
    assert [r[0] for r in df.select(STUDY_CALENDAR.event_period(F.col("ts"))).collect()] == [None, "A-B", None]


def test_kaplan_meier_with_censoring(spark):
    spells = spark.createDataFrame(
        [("g", 1, True), ("g", 2, True), ("g", 2, False), ("g", 3, False), ("g", 4, True), ("g", 0, True)],
        "k string, survival_months int, event_observed boolean",
    )
    curve = {r["time_months"]: r for r in survival.kaplan_meier(spells, ["k"]).collect()}
    assert sorted(curve) == [0.0, 1.0, 2.0, 4.0]
    assert curve[1.0]["survival_probability"] == pytest.approx(0.8) and curve[1.0]["n_at_risk"] == 5
    assert curve[2.0]["survival_probability"] == pytest.approx(0.8 * 0.75) and curve[2.0]["n_censored"] == 1
    assert curve[4.0]["survival_probability"] == 0.0


def test_hub_summary_counts_user_communities(spark):
    users = spark.createDataFrame(
        [("x", "u", "fph_pg", "high_activity", True, True, True), ("y", "u", "fph_pg", "lower_activity", False, False, True)],
        "community string, user_id string, fixed_cohort string, activity_group string, ever_hub_top5 boolean, ever_hub_top10 boolean, ever_hub_top20 boolean",
    )
    shares = spark.createDataFrame([("fph_pg", 0.5)], "fixed_cohort string, degree_share_ratio double")
    found = survival.hub_ascent_summary(users, shares, STUDY_CALENDAR)
    row = found.where("fixed_cohort = 'fph_pg' and hub_fraction = 0.1").first()
    assert (row["n_users"], row["mean_ever_hub_rate"], row["high_activity_ever_hub_rate"]) == (2, 0.5, 1.0)
    assert found.where("fixed_cohort = 'ga_td'").first()["n_users"] == 0


@pytest.mark.parametrize("window,step", [(5, 1), (7, 3)])
def test_sliding_windows_match_a_plain_scan(spark, window, step):
    """Every window counted afresh; users come and go, one with many days, days with several scores."""
    import random
    import statistics
    from datetime import date, timedelta

    from tideline.functions.calendar import Event, EventCalendar

    calendar = EventCalendar(events=(Event("a", "2020-01-10"), Event("b", "2020-01-20")), end="2020-03-01")
    draw = random.Random(window)
    start = date(2020, 1, 1)
    data = [(f"u{draw.randrange(9)}", start + timedelta(days=draw.randrange(45)), draw.random()) for _ in range(120)]
    data += [("hot", start + timedelta(days=d), draw.random()) for d in range(45) for _ in range(3)]
    df = spark.createDataFrame([("c", u, str(d), v) for u, d, v in data], "community string, user_id string, day string, score double")
    df = df.withColumn("ts", F.to_timestamp("day"))
    found = {(r.step, r.cohort): r for r in cohorts.sliding_window_timeseries(df, calendar, "score", window, step).collect()}
    first_days = {}
    for u, d, _ in data:
        first_days[u] = min(first_days.get(u, d), d)
    names = ["beforeA", "betweenA-B", "afterB"]
    cohort = {u: names[(d >= date(2020, 1, 10)) + (d >= date(2020, 1, 20))] for u, d in first_days.items()}
    low, high = min(d for _, d, _ in data), max(d for _, d, _ in data)
    steps = range(0, (high - low).days - window + 2, step)
    assert set(found) == {(k, c) for k in steps for c in names}
    for (k, name), row in found.items():
        held = {}
        for u, d, v in data:
            if cohort[u] == name and 0 <= (d - low).days - k < window:
                held.setdefault(u, []).append(v)
        means = [statistics.fmean(v) for v in held.values()]
        count = sum(map(len, held.values()))
        assert (row.active_users, row.activity_count) == (len(held), count)
        if not held:
            assert row.user_mean is None and row.activity_mean is None
            continue
        mean = sum(map(sum, held.values())) / count
        assert row.user_mean == pytest.approx(statistics.fmean(means), abs=1e-9)
        assert row.activity_mean == pytest.approx(mean, abs=1e-9)
        if len(held) == 1:
            assert row.user_se is None and row.activity_se is None
        else:
            assert row.user_se == pytest.approx(statistics.stdev(means) / len(held) ** 0.5, abs=1e-6)
            weighted = sum(len(v) * (m - mean) ** 2 for v, m in zip(held.values(), means)) / count
            assert row.activity_se == pytest.approx((weighted / len(held)) ** 0.5, abs=1e-6)
