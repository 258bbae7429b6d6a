from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions.stats import student_t_tail
from tideline.operators import breakpoints, inference, panel
from tideline.plans.checks import inference_checks, reputation_checks


def months(n, first=2015 * 12 + 1):
    return [f"{(first + i - 1) // 12:04d}-{(first + i - 1) % 12 + 1:02d}" for i in range(n)]


def test_student_tail_at_known_points():
    # Two-sided 5 % points of the distribution.
    for df, t in ((1, 12.706204736), (5, 2.570581836), (30, 2.042272456), (1000, 1.962339081)):
        assert student_t_tail(t, df) == pytest.approx(0.05, abs=1e-9)
    assert student_t_tail(0.0, 7) == 1.0
    assert student_t_tail(2.0, 2) == pytest.approx(1 - 2 / math.sqrt(6), abs=1e-12)


def test_benjamini_hochberg_keeps_nulls_and_order(spark):
    p = {"a": 0.01, "b": 0.04, "c": 0.03, "d": 0.005, "e": None}
    df = spark.createDataFrame(list(p.items()), "t string, p double")
    found = {r["t"]: r for r in inference.benjamini_hochberg(df, "p", ["t"]).collect()}
    assert [round(found[t]["p_fdr"], 6) for t in "dacb"] == [0.02, 0.02, 0.04, 0.04]
    assert found["e"]["p_fdr"] is None and not found["e"]["p_fdr_significant"]
    assert all(found[t]["n_tests"] == 4 for t in "abcd")


def test_permutation_of_a_clear_and_of_no_difference(spark):
    rng = np.random.default_rng(3)
    clear = np.concatenate([np.zeros(30), np.ones(30)]) + rng.normal(0, 0.05, 60)
    none = rng.normal(0, 1, 61)
    data = [("clear", m, float(v)) for m, v in zip(months(60), clear)] + [("none", m, float(v)) for m, v in zip(months(61), none)]
    data += [("one-sided", m, 1.0) for m in months(10)]
    df = spark.createDataFrame(data, "s string, month string, v double")
    test = inference.block_permutation_test(df, ["s"], "v", F.col("month") < months(31)[-1], repetitions=400)
    found = {r["s"]: r for r in test.collect()}
    assert found["clear"]["p_value"] < 0.01 and found["clear"]["n_pre"] == 30
    assert found["none"]["p_value"] > 0.05
    assert found["one-sided"]["p_value"] is None


def test_matched_draws_follow_the_focal_profile(spark):
    schema = "community string, month string, user_id string, activity_count int, m double"
    focal = spark.createDataFrame([("c", "2015-01", f"f{i}", n, 0.0) for i, n in enumerate([1, 1, 2, 30])], schema)
    # The bin 2 is empty, so the bin below it is drawn from; most users sit in one bin.
    reference = spark.createDataFrame(
        [("c", "2015-01", f"r{i}", 1, 1.0) for i in range(200)] + [("c", "2015-01", "big", 50, 5.0)], schema
    )
    choice = {r["activity_bin"]: r for r in inference.matched_bin_choice(focal, reference).collect()}
    assert (choice["2"]["chosen_bin"], choice["21+"]["chosen_bin"], choice["1"]["bin_size"]) == ("1", "21+", 200)
    drawn = inference.activity_matched_bootstrap(focal, reference, {"mean": "m"}, iterations=5).collect()
    assert len(drawn) == 5 and all(r["sample_size"] == 4 for r in drawn)
    assert all(r["value"] == pytest.approx((3 * 1.0 + 5.0) / 4) for r in drawn)


def test_draws_are_made_in_pieces_and_never_broadcast(spark, monkeypatch):
    rows = [("c", "2020-01", f"u{i}", 1 + i % 7, float(i)) for i in range(60)] + [("c", None, "v", 1, 1.0)]
    users = spark.createDataFrame(rows, "community string, month string, user_id string, activity_count int, m double")
    focal, reference = users.where("m < 25"), users.where("m >= 25")
    whole = inference.activity_matched_bootstrap(focal, reference, {"mean": "m"}, iterations=6)
    # The planner sees the size of the bins, of which draws are very many times as many.
    plan = whole._jdf.queryExecution().sparkPlan().toString()
    assert any("SortMergeJoin" in line and "_place" in line for line in plan.splitlines())
    assert not any("BroadcastHashJoin" in line and "_place" in line for line in plan.splitlines())
    expected = sorted(whole.collect())
    assert len(expected) == 6 and all(r["sample_size"] == 25 for r in expected)
    monkeypatch.setattr(inference, "PIECE_DRAWS", 2)
    monkeypatch.setattr(inference, "TASK_DRAWS", 8)
    pieces = sorted(inference.activity_matched_bootstrap(focal, reference, {"mean": "m"}, iterations=6).collect())
    assert [tuple(r) for r in pieces] == [(*r[:5], pytest.approx(r[5])) for r in expected]


def test_nearest_bins_look_left_first():
    near = inference.fallback_bins()
    assert near["3-5"] == ["3-5", "2", "6-10", "1", "11-20", "21+"]
    assert near["1"][:3] == ["1", "2", "3-5"]


def test_breaks_are_found_where_they_were_put(spark):
    x = np.arange(60)
    y = np.where(x < 25, 0.1 * x, 10 - 0.2 * x)
    gaps = [m for i, m in enumerate(months(70)) if i not in range(40, 50)]
    df = spark.createDataFrame([("s", m, float(v)) for m, v in zip(gaps, y)] + [("short", m, 1.0) for m in months(13)], "s string, month string, v double")
    found = breakpoints.segmented_regression_1break(df, ["s"], "v").collect()
    assert [r["s"] for r in found] == ["s"]
    assert found[0]["break_month"] == gaps[25] and found[0]["pre_slope"] == pytest.approx(0.1)


def test_information_criteria(spark):
    rng = np.random.default_rng(0)
    n = 50
    y = np.concatenate([np.linspace(0, 1, 20), np.linspace(5, 4, 15), np.linspace(0, 3, 15)]) + rng.normal(0, 0.01, n)
    df = spark.createDataFrame([("s", m, float(v)) for m, v in zip(months(n), y)], "s string, month string, v double")
    rows = {r["n_breaks"]: r for r in breakpoints.regime_model_comparison(df, ["s"], "v", "2018-09").collect()}
    assert rows[2]["bic_selected"] and rows[2]["break_months"] == f"{months(n)[20]};{months(n)[35]}"
    for breaks, r in rows.items():
        k = 3 * breaks + 2
        fit = n * math.log(r["sse"] / n)
        assert r["bic"] == pytest.approx(fit + k * math.log(n))
        assert r["aicc"] == pytest.approx(fit + 2 * k + 2 * k * (k + 1) / (n - k - 1))


def test_panel_equals_a_regression_with_a_dummy_per_community(spark):
    rng = np.random.default_rng(9)
    data, times = [], months(40)
    for g, name in enumerate(["a", "b", "c", "d"]):
        for t, m in enumerate(times):
            if rng.random() < 0.1:
                continue
            share = rng.random()
            data.append((name, m, share, 0.3 * g + 0.5 * share + 0.1 * (t >= 20) + 0.01 * t + rng.normal(0, 0.2)))
    df = spark.createDataFrame(data, "community string, month string, newcomer_pop_share double, y double")
    found = {r["term"]: r for r in panel.multi_outcome_terms(df, ["y"], f"{times[20]}-01").collect()}

    names = sorted({d[0] for d in data})
    first = min(times.index(d[1]) for d in data)
    share = np.array([d[2] for d in data])
    t = np.array([times.index(d[1]) for d in data])
    post = (t >= 20).astype(float)
    dummies = [np.array([float(d[0] == n) for d in data]) for n in names[1:]]
    x = np.column_stack([np.ones(len(data)), share, post, share * post, t - first, *dummies])
    y = np.array([d[3] for d in data])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    u = y - x @ beta
    inverse = np.linalg.inv(x.T @ x)
    meat = sum(np.outer(s, s) for n in names for s in [x[[d[0] == n for d in data]].T @ u[[d[0] == n for d in data]]])
    n, k, g = len(y), x.shape[1], len(names)
    errors = np.sqrt(np.diag(inverse @ meat @ inverse) * g / (g - 1) * (n - 1) / (n - k))
    terms = ["intercept", *panel.TERMS, *[f"fe_{n}" for n in names[1:]]]
    for i, term in enumerate(terms):
        assert found[term]["coef"] == pytest.approx(beta[i], rel=1e-8), term
        assert found[term]["se_cluster"] == pytest.approx(errors[i], rel=1e-6), term
    assert found["time_index"]["r2"] == pytest.approx(1 - u @ u / np.sum((y - y.mean()) ** 2))


def test_resampled_intervals_hold_the_estimate(spark):
    rng = np.random.default_rng(2)
    data = [("c", p, m, float(v)) for p, mean in (("focal", 0.6), ("reference", 0.5)) for m, v in zip(months(40), rng.normal(mean, 0.1, 40))]
    df = spark.createDataFrame(data, "community string, platform string, month string, v double")
    row = inference.effect_sizes(df, ["community"], "v", "focal", repetitions=200).first()
    assert row["glass_ci_lower"] < row["glass_delta"] < row["glass_ci_upper"]
    assert row["cliffs_ci_lower"] < row["cliffs_delta"] < row["cliffs_ci_upper"]
    assert row["n_focal"] == row["n_reference"] == 40


@pytest.mark.parametrize("df", [1e3, 1e5, 9e5, 1.1e6, 1e10, 1e14])
def test_the_tail_of_large_samples_keeps_its_digits(df):
    """Against a sum over the density, whose constant is a short series for large samples."""
    for t in (0.05, 1.0, 2.5, 6.0):
        x = np.linspace(t, t + 40, 400_001)
        density = np.exp(-(df + 1) / 2 * np.log1p(x * x / df)) / math.sqrt(2 * math.pi) * (1 - 1 / (4 * df) + 1 / (32 * df**2))
        weights = np.where(np.arange(len(x)) % 2, 4.0, 2.0)
        weights[[0, -1]] = 1.0
        total = 2 * float((weights * density).sum()) * (x[1] - x[0]) / 3
        assert student_t_tail(t, df) == pytest.approx(total, rel=2e-8)
        assert student_t_tail(-t, df) == student_t_tail(t, df)


def test_points_of_a_permutation_test_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            made.add(1)
            yield r

    points = [("a", f"2000-{m:02d}", float(m)) for m in range(1, 13)]
    series = spark.createDataFrame(spark.sparkContext.parallelize(points, 2).mapPartitions(seen), "g string, month string, v double")
    found = inference.block_permutation_test(series, ["g"], "v", F.col("month") < "2000-07", repetitions=20).collect()
    assert len(found) == 1 and made.value == len(points)


def test_pairs_of_a_correlation_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            made.add(1)
            yield r

    pairs = [("a", float(i % 5), float(i * i % 7)) for i in range(20)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(pairs, 2).mapPartitions(seen), "g string, x double, y double")
    row = inference.pearson_spearman(df, ["g"], "x", "y").first()
    assert made.value == len(pairs)
    x, y = (np.array([p[i] for p in pairs]) for i in (1, 2))
    rank_x, rank_y = ((v[:, None] > v).sum(1) + ((v[:, None] == v).sum(1) + 1) / 2 for v in (x, y))
    assert row["pearson_r"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert row["spearman_rho"] == pytest.approx(np.corrcoef(rank_x, rank_y)[0, 1])


def test_bands_and_monthly_values_read_one_reputation(spark, monkeypatch):
    data = [
        (platform, "c", f"{platform}{u}", month, 0.1 * u, 0.2, 0.3, 0.4, 1 + u % 3, 1.5, 2)
        for platform in ("focal", "reference") for u in range(25) for month in ("2020-01", "2020-02")
    ]
    columns = "platform string, community string, user_id string, month string, mean_toxicity double, mean_vader double, " \
        "mean_textblob double, mean_subjectivity double, activity_count long, mean_reputation double, active_days long"
    made = []
    monkeypatch.setattr(
        reputation_checks, "user_month_with_reputation", lambda *_: made.append(1) or spark.createDataFrame(data, columns)
    )
    found = inference_checks.diffs(spark, "").where("metric = 'toxicity_mean'").collect()
    assert len(made) == 1 and len(found) == 2
    assert all(r.focal_value == pytest.approx(1.2) and r.member_count == 25 and r.valid_member_count for r in found)
