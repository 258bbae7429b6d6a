"""Effect sizes, resampling tests and corrections, for many series in one job.

A series is a group of rows under some key columns. Random draws are hashes of the series, the
repetition and the draw, so results do not depend on partitioning and retried tasks repeat them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.draws import draw_index, draw_key
from tideline.functions.labels import activity_bin, bin_names, effect_size_label
from tideline.functions.stats import (
    correlation_p,
    normal_two_sided_p,
    ratio,
    student_t_two_sided_p,
)
from tideline.operators.ranking import numbered_rows, running_weights
from tideline.operators.rollups import unpivoted
from tideline.session import cut_lineage

#: Draws that stand in a row before they are made, and that a task makes.
PIECE_DRAWS, TASK_DRAWS = 1 << 12, 1 << 20


# Two samples ---------------------------------------------------------------------------------


def cliffs_delta(
    df: DataFrame, keys: Sequence[str], value: str, is_first: Column, small_groups: bool = False
) -> DataFrame:
    """Chance that a value of the first sample exceeds one of the second, minus the reverse.

    Each distinct value knows how many values of the second sample lie below it and at it, which
    gives all comparisons without making any pair.
    """
    keys = list(keys)
    marked = df.select(*keys, value, is_first.alias("_first"))
    weights = {"x": F.when(F.col("_first"), 1).otherwise(0), "y": F.when(F.col("_first"), 0).otherwise(1)}
    table = running_weights(marked, keys, value, weights, small_groups)
    x, y, below = F.col("x").cast("double"), F.col("y").cast("double"), F.col("y_below").cast("double")
    n_y = F.sum(y)
    # greater minus less = below - (n_y - below - at), summed over the first sample
    score = F.sum(x * (2 * below + y)) - F.sum(x) * n_y
    return table.groupBy(*keys).agg(ratio(score, F.sum(x) * n_y).alias("cliffs_delta"))


def glass_delta(first: Column, second: Column) -> Column:
    """Aggregate: difference of means over the deviation of the second sample."""
    spread = F.stddev_samp(second)
    return F.when(spread > 0, F.try_divide(F.avg(first) - F.avg(second), spread))


def mann_whitney(
    df: DataFrame, keys: Sequence[str], value: str, is_first: Column, small_groups: bool = False
) -> DataFrame:
    """U statistic of the first sample and its p-value, corrected for ties and continuity."""
    keys = list(keys)
    marked = df.select(*keys, value, is_first.alias("_first"))
    weights = {"x": F.when(F.col("_first"), 1).otherwise(0), "y": F.when(F.col("_first"), 0).otherwise(1)}
    table = running_weights(marked, keys, value, weights, small_groups)
    x, y, below = F.col("x").cast("double"), F.col("y").cast("double"), F.col("y_below").cast("double")
    ties = x + y
    grouped = table.groupBy(*keys).agg(
        F.sum(x).alias("_n1"),
        F.sum(y).alias("_n2"),
        F.sum(x * (below + y / 2)).alias("u_statistic"),
        F.sum(ties * ties * ties - ties).alias("_ties"),
    )
    n1, n2 = F.col("_n1"), F.col("_n2")
    n = n1 + n2
    variance = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1)))
    larger = F.greatest(F.col("u_statistic"), n1 * n2 - F.col("u_statistic"))
    z = F.when(variance > 0, F.try_divide(larger - n1 * n2 / 2 - 0.5, F.sqrt(variance)))
    return grouped.withColumn("_z", F.greatest(z, F.lit(0.0))).select(
        *keys, "u_statistic", normal_two_sided_p(F.col("_z")).alias("u_p_value")
    )


def welch_t(df: DataFrame, keys: Sequence[str], value: str, is_first: Column) -> DataFrame:
    """t statistic for unequal variances and its p-value."""
    first, second = F.when(is_first, F.col(value)), F.when(~is_first, F.col(value))
    moments = df.groupBy(*keys).agg(
        F.avg(first).alias("_m1"),
        F.avg(second).alias("_m2"),
        ratio(F.var_samp(first), F.count(first)).alias("_v1"),
        ratio(F.var_samp(second), F.count(second)).alias("_v2"),
        F.count(first).alias("_n1"),
        F.count(second).alias("_n2"),
    )
    v1, v2 = F.col("_v1"), F.col("_v2")
    t = F.try_divide(F.col("_m1") - F.col("_m2"), F.sqrt(v1 + v2))
    freedom = F.try_divide(F.pow(v1 + v2, 2), v1 * v1 / (F.col("_n1") - 1) + v2 * v2 / (F.col("_n2") - 1))
    tested = moments.withColumn("t_statistic", t).withColumn("_df", freedom)
    return tested.select(
        *keys,
        F.col("_n1").alias("n_focal"),
        F.col("_n2").alias("n_reference"),
        F.col("_m1").alias("focal_mean"),
        F.col("_m2").alias("reference_mean"),
        "t_statistic",
        student_t_two_sided_p(F.col("t_statistic"), F.col("_df")).alias("t_p_value"),
    )


def platform_significance(
    community_month: DataFrame, metrics: Sequence[str], focal: str, keys: Sequence[str] = ("community",)
) -> DataFrame:
    """Rank and mean tests of monthly values between the platforms, per metric (groups are months)."""
    group = [*keys, "metric"]
    long = unpivoted(community_month, [*keys, "platform"], metrics).where(F.col("value").isNotNull())
    is_first = F.col("platform") == focal
    tests = welch_t(long, group, "value", is_first).join(mann_whitney(long, group, "value", is_first, True), group)
    return tests.withColumn("significant", F.col("t_p_value") < 0.05)


# Bootstrap of effect sizes -------------------------------------------------------------------


def numbered_values(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Values of monthly series with their place in the series (series are months, so short)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    size = F.count("*").over(Window.partitionBy(*keys))
    kept = df.where(F.col(value).isNotNull())
    return kept.select(*keys, F.col(value).alias("_value"), place.alias("_i"), size.alias("_size"))


def resampled(values: DataFrame, keys: Sequence[str], repetitions: int, seed: int) -> DataFrame:
    """``repetitions`` samples of each series with replacement, each as long as the series."""
    draws = (
        values.select(*keys, F.col("_i").alias("_draw"), "_size")
        .withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
        .withColumn(
            "_i",
            draw_index(F.col("_size"), F.lit(seed), *[F.col(k) for k in keys], F.col("repetition"), F.col("_draw")),
        )
    )
    return draws.join(values.select(*keys, "_i", "_value"), [*keys, "_i"])


def effect_sizes(
    series: DataFrame,
    keys: Sequence[str],
    value: str,
    focal: str,
    order: Sequence[str] = ("month",),
    repetitions: int = 1000,
    seed: int = 42,
    coverage: float = 0.95,
) -> DataFrame:
    """Means and effect sizes of two platforms with resampled intervals, one row per group.

    ``series`` holds months. Both effect sizes of all repetitions come from one resampled table.
    """
    keys = list(keys)
    both = [*keys, "platform"]
    is_first = F.col("platform") == focal
    known = cut_lineage(series.where(F.col(value).isNotNull()).select(*both, *order, value))
    first, second = F.when(is_first, F.col(value)), F.when(~is_first, F.col(value))
    base = known.groupBy(*keys).agg(
        F.avg(first).alias("focal_mean"),
        F.avg(second).alias("reference_mean"),
        (F.avg(first) - F.avg(second)).alias("difference"),
        F.when(F.avg(second) > 0, ratio(F.avg(first), F.avg(second))).alias("ratio"),
        glass_delta(first, second).alias("glass_delta"),
        F.count(first).alias("n_focal"),
        F.count(second).alias("n_reference"),
    )
    observed = base.join(cliffs_delta(known, keys, value, is_first, small_groups=True), keys)

    sample = resampled(numbered_values(known, both, value, order), both, repetitions, seed)
    run = [*keys, "repetition"]
    first, second = F.when(is_first, F.col("_value")), F.when(~is_first, F.col("_value"))
    glass = sample.groupBy(*run).agg(glass_delta(first, second).alias("glass"))
    cliff = cliffs_delta(sample, run, "_value", is_first, small_groups=True)
    tail = (1 - coverage) / 2
    # One value per repetition, a fixed number of them.
    intervals = glass.join(cliff, run).groupBy(*keys).agg(
        F.percentile("glass", F.lit(tail)).alias("glass_ci_lower"),
        F.percentile("glass", F.lit(1 - tail)).alias("glass_ci_upper"),
        F.percentile("cliffs_delta", F.lit(tail)).alias("cliffs_ci_lower"),
        F.percentile("cliffs_delta", F.lit(1 - tail)).alias("cliffs_ci_upper"),
    )
    return observed.join(intervals, keys).withColumn("interpretation", effect_size_label(F.col("cliffs_delta")))


# Permutation of blocks -----------------------------------------------------------------------


def block_permutation_test(
    series: DataFrame,
    keys: Sequence[str],
    value: str,
    is_pre: Column,
    order: Sequence[str] = ("month",),
    block: int = 3,
    repetitions: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """Difference of means after and before a split against shuffles of blocks of consecutive points.

    A block enters a shuffle as one row with the running sums of its points. Where the shuffled
    series reaches the length of the first part it may cut a block, and the running sums give the
    sum up to the cut. The points, a few hundred per series, are read by several branches and are
    written down, so that what they come from runs once.
    """
    keys = list(keys)
    known = cut_lineage(
        series.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).alias("_value"), is_pre.alias("_pre"))
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_pre"), *order)) - 1
    # The points before the split come first, as they do in time.
    points = known.withColumn("_i", place).withColumn("_block", F.floor(F.col("_i") / block))
    observed = points.groupBy(*keys).agg(
        F.avg(F.when(F.col("_pre"), F.col("_value"))).alias("pre_mean"),
        F.avg(F.when(~F.col("_pre"), F.col("_value"))).alias("post_mean"),
        F.count_if(F.col("_pre")).alias("n_pre"),
        F.count_if(~F.col("_pre")).alias("n_post"),
        F.sum("_value").alias("_total"),
    )
    observed = observed.withColumn("observed_diff", F.col("post_mean") - F.col("pre_mean"))
    blocks = points.groupBy(*keys, "_block").agg(
        F.count("*").alias("_size"),
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_value"))), lambda p: p["_value"]).alias("_values"),
    )
    ordered = Window.partitionBy(*keys, "repetition").orderBy("_key", "_block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    testable = (F.col("n_pre") > 0) & (F.col("n_post") > 0)
    shuffled = (
        blocks.join(observed.where(testable).select(*keys, "n_pre", "n_post", "_total"), keys)
        .withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
        .withColumn("_key", draw_key(F.lit(seed), *[F.col(k) for k in keys], F.col("repetition"), F.col("_block")))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    )
    taken = F.least(F.greatest(F.col("n_pre") - F.col("_start"), F.lit(0)), F.col("_size")).cast("int")
    inside = F.aggregate(F.slice("_values", 1, taken), F.lit(0.0), lambda a, v: a + v)
    differences = shuffled.groupBy(*keys, "repetition").agg(
        F.sum(inside).alias("_sum"),
        F.first("_total").alias("_total"),
        F.first("n_pre").alias("_n_pre"),
        F.first("n_post").alias("_n_post"),
    ).withColumn(
        "_diff", (F.col("_total") - F.col("_sum")) / F.col("_n_post") - F.col("_sum") / F.col("_n_pre")
    )
    # Shuffles that restore the split differ from it by rounding only, and count as reaching it.
    reaches = F.abs("_diff") >= F.abs("observed_diff") - 1e-12
    p = (
        differences.join(observed.select(*keys, "observed_diff"), keys)
        .groupBy(*keys)
        .agg(F.avg(reaches.cast("double")).alias("p_value"))
    )
    return observed.drop("_total").join(p, keys, "left")


# Corrections for many tests ------------------------------------------------------------------


def benjamini_hochberg(
    tests: DataFrame,
    p: str,
    order: Sequence[str],
    family: Sequence[str] = (),
    alpha: float = 0.05,
    name: str = "p_fdr",
) -> DataFrame:
    """Adjusted p-values and flags within each family; null p-values stay null.

    A family is a table of tests, one row each; ``n_tests`` is the number of those with a p-value.
    """
    known = F.col(p).isNotNull()
    within = Window.partitionBy(*family, known)
    rank = F.row_number().over(within.orderBy(p, *order))
    counted = tests.withColumn("n_tests", F.count(p).over(within)).withColumn("_rank", rank)
    raw = F.least(F.col(p) * F.col("n_tests") / F.col("_rank"), F.lit(1.0))
    down = within.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.when(known, F.min("_raw").over(down))
    return (
        counted.withColumn("_raw", raw)
        .withColumn(name, adjusted)
        .withColumn(f"{name}_significant", F.when(known, F.col(name) < alpha).otherwise(F.lit(False)))
        .drop("_rank", "_raw")
    )


# Matched samples -----------------------------------------------------------------------------


def fallback_bins() -> dict[str, list[str]]:
    """For each activity bin, all bins by distance from it, the lower one first."""
    names = bin_names()
    order = {}
    for i, name in enumerate(names):
        near = sorted(range(len(names)), key=lambda j: (abs(i - j), j > i))
        order[name] = [names[j] for j in near]
    order["0"] = names
    return order


def matched_bin_choice(
    focal: DataFrame, reference: DataFrame, keys: Sequence[str] = ("community", "month")
) -> DataFrame:
    """For every focal bin, how many to draw and the nearest reference bin that has anyone.

    A bin looks through at most six candidates, held in an array.
    """
    keys = list(keys)
    targets = focal.groupBy(*keys, activity_bin(F.col("activity_count")).alias("activity_bin")).agg(
        F.count("*").alias("target_count")
    )
    sizes = reference.groupBy(*keys, activity_bin(F.col("activity_count")).alias("_bin")).agg(F.count("*").alias("_n"))
    filled = sizes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_bins"))
    candidates = F.create_map(*[
        cell for name, near in fallback_bins().items() for cell in (F.lit(name), F.array(*[F.lit(n) for n in near]))
    ])
    usable = F.filter(candidates[F.col("activity_bin")], lambda b: F.map_contains_key("_bins", b))
    chosen = F.when(F.size(usable) > 0, usable[0])
    return (
        targets.join(filled, keys)
        .withColumn("chosen_bin", chosen)
        .where(F.col("chosen_bin").isNotNull())
        .withColumn("bin_size", F.col("_bins")[F.col("chosen_bin")])
        .drop("_bins")
    )


def activity_matched_bootstrap(
    focal: DataFrame,
    reference: DataFrame,
    metrics: Mapping[str, str],
    iterations: int = 40,
    seed: int = 2025,
    keys: Sequence[str] = ("community", "month"),
) -> DataFrame:
    """Reference users drawn with replacement to the activity profile of the focal users.

    Every focal user-month makes one draw per iteration, told apart by its place in its bin. A bin's
    draws are made in pieces of at most ``PIECE_DRAWS``, by as many tasks as the draws of all bins
    need. Draws name a place within a reference bin. Places come from :func:`numbered_rows`, which
    numbers bins of any size. Draws of one place in one iteration are counted before they meet the
    users, so a user is read once per iteration at most.
    """
    keys = list(keys)
    choice = cut_lineage(matched_bin_choice(focal, reference, keys))
    places = numbered_rows(
        reference.select(*keys, "user_id", *metrics.values(), activity_bin(F.col("activity_count")).alias("chosen_bin")),
        [*keys, "chosen_bin"],
        [F.col("user_id")],
        "_place",
    )
    draw = draw_index(
        F.col("bin_size"), F.lit(seed), *[F.col(k) for k in keys], F.col("activity_bin"), F.col("iteration"), F.col("_draw")
    )
    # One number reaches the driver.
    total = choice.agg(F.sum("target_count")).first()[0] or 0
    first = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("target_count"), F.lit(PIECE_DRAWS).cast("bigint")))
    last = F.least(F.col("_first") + (PIECE_DRAWS - 1), F.col("target_count"))
    pieces = (
        choice.withColumn("_first", first)
        .withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
        .repartition(max(1, math.ceil(total * iterations / TASK_DRAWS)), *keys, "activity_bin", "iteration", "_first")
    )
    draws = (
        pieces.withColumn("_draw", F.explode(F.sequence(F.col("_first"), last)))
        .withColumn("_place", draw + 1)
        .groupBy(*keys, "chosen_bin", "iteration", "_place")
        .agg(F.count("*").alias("_times"))
    )
    # The planner sees the size of the bins, not of their draws, and would broadcast these.
    joined = draws.hint("merge").join(places, [*keys, "chosen_bin", "_place"])
    times = F.col("_times")
    aggs = [F.sum(times).alias("sample_size")]
    for name, column in metrics.items():
        value = F.col(column)
        aggs.append(ratio(F.sum(times * value), F.sum(F.when(value.isNotNull(), times))).alias(name))
    wide = joined.groupBy(*keys, "iteration").agg(*aggs)
    return wide.unpivot([*keys, "iteration", "sample_size"], list(metrics), "metric", "value")


def bootstrap_percentiles(
    samples: DataFrame,
    percentiles: Sequence[int] = (5, 25, 50, 75, 95),
    keys: Sequence[str] = ("community", "month", "metric"),
) -> DataFrame:
    """Percentiles over iterations (a fixed number per group)."""
    ranks = F.array(*[F.lit(p / 100) for p in percentiles])
    names = F.array(*[F.lit(p) for p in percentiles])
    grouped = samples.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.percentile("value", ranks).alias("_q"))
    return grouped.select(*keys, F.explode(F.arrays_zip(names.alias("percentile"), F.col("_q").alias("value"))).alias("_p")).select(
        *keys, "_p.percentile", "_p.value"
    )


# Correlations --------------------------------------------------------------------------------


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, name: str, weight: str | None = None
) -> DataFrame:
    """The average rank of each distinct value, written down, so that readers see its size."""
    table = running_weights(df, keys, value, {"_n": F.col(weight) if weight else F.lit(1)})
    return cut_lineage(table.select(*keys, value, (F.col("_n_below") + (F.col("_n") + 1) / 2).alias(name)))


def with_average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, name: str, weight: str | None = None
) -> DataFrame:
    """Attach average ranks, from the running weights of distinct values."""
    return df.join(average_ranks(df, keys, value, name, weight), [*keys, value])


def weighted_correlation(x: Column, y: Column, w: Column) -> Column:
    """Aggregate: correlation of two columns that stand for ``w`` rows each; null without spread."""
    x, y, w = x.cast("double"), y.cast("double"), w.cast("double")
    total, sum_x, sum_y = F.sum(w), F.sum(w * x), F.sum(w * y)
    spread_x = total * F.sum(w * x * x) - sum_x * sum_x
    spread_y = total * F.sum(w * y * y) - sum_y * sum_y
    spread = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(spread, (total * F.sum(w * x * y) - sum_x * sum_y) / F.sqrt(spread_x) / F.sqrt(spread_y))


def pearson_spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """Both correlations of two columns with p-values; null below three pairs or without spread.

    Equal pairs are counted before anything is ranked or joined, and written down, as both ranks and the
    sums read them; with ``weight`` a row already stands for that many.
    """
    keys = list(keys)
    known = cut_lineage(
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .agg(F.sum(weight or F.lit(1)).alias("_w"))
    )
    ranks_x, ranks_y = (average_ranks(known, keys, v, f"rank_{v}", "_w") for v in ("x", "y"))
    ranked = known.join(ranks_x, [*keys, "x"]).join(ranks_y, [*keys, "y"])
    w = F.col("_w")
    grouped = ranked.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        (F.sum(w * F.col("x")) / F.sum(w)).alias("mean_x"),
        (F.sum(w * F.col("y")) / F.sum(w)).alias("mean_y"),
        weighted_correlation(F.col("x"), F.col("y"), w).alias("_r"),
        weighted_correlation(F.col("rank_x"), F.col("rank_y"), w).alias("_rho"),
    )
    enough = F.col("n") >= 3
    return grouped.select(
        *keys,
        "n",
        "mean_x",
        "mean_y",
        F.when(enough, F.col("_r")).alias("pearson_r"),
        F.when(enough, correlation_p(F.col("_r"), F.col("n"))).alias("pearson_p"),
        F.when(enough, F.col("_rho")).alias("spearman_rho"),
        F.when(enough, correlation_p(F.col("_rho"), F.col("n"))).alias("spearman_p"),
    )
