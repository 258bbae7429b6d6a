from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.operators.inference import cliffs_delta, with_average_ranks
from tideline.operators.ranking import exact_quantiles, numbered_rows, running_weights, value_bin


def skewed_frame(spark, n=4000):
    """One group holds most rows; values range over many magnitudes, with repeats, zeros and signs."""
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, n // 2), np.exp(rng.normal(0, 12, n // 4)), np.repeat([0.0, -1.5, 2.0], n // 12)])
    groups = np.where(rng.random(len(values)) < 0.7, "hot", rng.choice(list("abc"), len(values)))
    data = list(zip(groups.tolist(), values.tolist()))
    return data, spark.createDataFrame(data, "g string, v double")


def test_quantiles_match_linear_interpolation(spark):
    data, df = skewed_frame(spark)
    probs = {"q05": 0.05, "q50": 0.5, "q90": 0.9, "q100": 1.0, "q0": 0.0}
    found = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in {g for g, _ in data}:
        values = [v for h, v in data if h == g]
        for name, p in probs.items():
            assert found[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300)


def test_quantiles_without_groups_and_with_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (2.0,), (4.0,)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 2.5


def test_running_weights_count_what_lies_below(spark):
    data, df = skewed_frame(spark, 1200)
    table = running_weights(df, ["g"], "v", {"n": F.lit(1)}).collect()
    for row in table[:: max(1, len(table) // 60)]:
        values = [v for g, v in data if g == row["g"]]
        assert row["n_below"] == sum(v < row["v"] for v in values)
        assert row["n"] == sum(v == row["v"] for v in values)


def test_small_groups_form_agrees(spark):
    _, df = skewed_frame(spark, 1200)
    wide = running_weights(df, ["g"], "v", {"n": F.lit(1)})
    small = running_weights(df, ["g"], "v", {"n": F.lit(1)}, small_groups=True).select(wide.columns)
    assert wide.exceptAll(small).count() == 0 and small.exceptAll(wide).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=2, max_size=60))
def test_bins_follow_the_order_of_values(spark, values):
    ordered = sorted(v for v in values if v == 0 or abs(v) > 1e-300)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ordered)], "i int, v double").coalesce(1)
    bins = [r["b"] for r in df.select("i", value_bin(F.col("v")).alias("b")).orderBy("i").collect()]
    assert bins == sorted(bins)


def test_numbered_rows_number_every_group_without_gaps(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        F.md5(F.col("id").cast("string")).alias("k"),
    )
    numbered = numbered_rows(df, ["g"], [F.col("k")], "n").collect()
    assert len(numbered) == 5000
    for g in {r["g"] for r in numbered}:
        mine = sorted((r["k"], r["n"]) for r in numbered if r["g"] == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_cliffs_delta_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, 60), rng.integers(2, 11, 45)
    df = spark.createDataFrame([("s", True, float(v)) for v in x] + [("s", False, float(v)) for v in y], "s string, f boolean, v double")
    expected = np.mean(np.sign(x[:, None] - y[None, :]))
    for small in (False, True):
        assert cliffs_delta(df, ["s"], "v", F.col("f"), small).first()["cliffs_delta"] == pytest.approx(expected)


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("s", v) for v in (3.0, 1.0, 3.0, 2.0, 3.0)], "s string, v double")
    ranks = sorted((r["v"], r["r"]) for r in with_average_ranks(df, ["s"], "v", "r").collect())
    assert ranks == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]
