"""Breaks in monthly series by segmented regression, for all series in one job.

A series has at most a few hundred months. Running sums at each month give the fit of every segment
that ends or starts there, so each candidate break costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import timeparts
from tideline.functions.draws import draw_index
from tideline.functions.stats import ratio

_SUMS = ("n", "x", "y", "xx", "xy", "yy")


def indexed_series(df: DataFrame, keys: Sequence[str], value: str, month: str = "month") -> DataFrame:
    """Points of each series with their place and their calendar month, both centred values.

    Gaps keep their length in ``x``; places count points.
    """
    known = df.where(F.col(value).isNotNull())
    whole = Window.partitionBy(*keys)
    number = timeparts.month_index(F.col(month))
    placed = known.select(
        *keys,
        F.col(month).alias("month"),
        (F.row_number().over(whole.orderBy(month)) - 1).alias("place"),
        F.count("*").over(whole).cast("int").alias("n_obs"),
        (number - F.avg(number).over(whole)).alias("x"),
        F.col(value).cast("double").alias("y"),
    )
    return placed.withColumn("y", F.col("y") - F.avg("y").over(whole))


def _sse(s: dict[str, Column]) -> Column:
    """Squared error of the least-squares line through the points behind the sums."""
    xx = s["xx"] - s["x"] * s["x"] / s["n"]
    xy = s["xy"] - s["x"] * s["y"] / s["n"]
    yy = s["yy"] - s["y"] * s["y"] / s["n"]
    return F.greatest(yy - F.coalesce(F.try_divide(xy * xy, xx), F.lit(0.0)), F.lit(0.0))


def _slope(s: dict[str, Column]) -> Column:
    return ratio(s["xy"] - s["x"] * s["y"] / s["n"], s["xx"] - s["x"] * s["x"] / s["n"])


def _intercept(s: dict[str, Column]) -> Column:
    return s["y"] / s["n"] - F.coalesce(_slope(s), F.lit(0.0)) * s["x"] / s["n"]


def _named(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}_{k}") for k in _SUMS}


def _minus(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {k: a[k] - b[k] for k in _SUMS}


def with_running_sums(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums over the points before each point, and over the whole series."""
    before = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    x, y = F.col("x"), F.col("y")
    terms = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}
    return points.select(
        "*",
        *[F.coalesce(F.sum(t).over(before), F.lit(0.0)).alias(f"before_{k}") for k, t in terms.items()],
        *[F.sum(t).over(whole).alias(f"whole_{k}") for k, t in terms.items()],
    )


def _candidates(points: DataFrame, keys: Sequence[str], min_segment: int) -> DataFrame:
    """Points a break may fall on, with the fit of either side."""
    before, whole = _named("before"), _named("whole")
    place, n = F.col("place"), F.col("n_obs")
    allowed = (n >= 2 * min_segment + 2) & (place >= min_segment) & (place <= n - min_segment)
    return with_running_sums(points, keys).where(allowed).withColumns({
        "pre_sse": _sse(before),
        "post_sse": _sse(_minus(whole, before)),
        "pre_slope": _slope(before),
        "post_slope": _slope(_minus(whole, before)),
        "pre_intercept": _intercept(before),
        "post_intercept": _intercept(_minus(whole, before)),
        "single_sse": _sse(whole),
    })


def best_break(points: DataFrame, keys: Sequence[str], min_segment: int = 6) -> DataFrame:
    """The break with the least total squared error, the earliest of equals."""
    candidates = _candidates(points, keys, min_segment)
    columns = ("place", "month", "n_obs", "pre_slope", "post_slope", "pre_intercept", "post_intercept", "single_sse")
    total = F.col("pre_sse") + F.col("post_sse")
    chosen = candidates.groupBy(*keys).agg(F.min(F.struct(total.alias("sse"), *columns)).alias("_b"))
    return chosen.select(*keys, "_b.*").withColumnRenamed("month", "break_month").withColumn(
        "sse_ratio", ratio(F.col("sse"), F.col("single_sse"))
    )


def segmented_regression_1break(
    df: DataFrame, keys: Sequence[str], value: str, min_segment: int = 6
) -> DataFrame:
    found = best_break(indexed_series(df, keys, value), keys, min_segment)
    return found.select(*keys, "n_obs", "break_month", "pre_slope", "post_slope", "sse_ratio")


def break_bootstrap(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    min_segment: int = 6,
    repetitions: int = 200,
    seed: int = 2025,
    near_months: int = 3,
) -> DataFrame:
    """Interval and stability of each break under resampled residuals."""
    keys = list(keys)
    points = indexed_series(df, keys, value)
    best = best_break(points, keys, min_segment)
    fit = best.select(*keys, F.col("place").alias("_at"), "break_month", "pre_slope", "post_slope", "pre_intercept", "post_intercept")
    x, pre = F.col("x"), F.col("place") < F.col("_at")
    line = F.when(pre, F.col("pre_intercept") + F.col("pre_slope") * x).otherwise(
        F.col("post_intercept") + F.col("post_slope") * x
    )
    fitted = points.join(fit, keys).withColumn("_fit", line).withColumn("_residual", F.col("y") - line)
    centred = F.col("_residual") - F.avg("_residual").over(Window.partitionBy(*keys))
    fitted = fitted.withColumn("_residual", centred)
    residuals = fitted.select(*keys, F.col("place").alias("_pick"), F.col("_residual").alias("_drawn"))
    draw = draw_index(F.col("n_obs"), F.lit(seed), *[F.col(k) for k in keys], F.col("repetition"), F.col("place"))
    redrawn = (
        fitted.select(*keys, "month", "place", "n_obs", "x", "_fit")
        .withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
        .withColumn("_pick", draw.cast("int"))
        .join(residuals, [*keys, "_pick"])
        .select(*keys, "repetition", "month", "place", "n_obs", "x", (F.col("_fit") + F.col("_drawn")).alias("y"))
    )
    again = best_break(redrawn, [*keys, "repetition"], min_segment).select(*keys, F.col("break_month").alias("_month"))
    near = timeparts.absolute_month_distance(F.col("_month"), F.col("break_month")) <= near_months
    # One break per repetition, a fixed number of them.
    gathered = again.join(best.select(*keys, "break_month"), keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list("_month")).alias("_all"),
        F.avg(near.cast("double")).alias("bootstrap_stability"),
    )

    def at(share: float) -> Column:
        return F.get("_all", F.floor((F.size("_all") - 1) * F.lit(share)).cast("int"))

    interval = gathered.select(
        *keys, at(0.05).alias("ci_low_month"), at(0.95).alias("ci_high_month"), "bootstrap_stability"
    )
    shown = best.select(*keys, "n_obs", "break_month", "pre_slope", "post_slope", "sse_ratio")
    return shown.join(interval, keys, "left")


def metric_series(
    monthly: DataFrame, metrics: Sequence[str], scope: str = "community", everywhere: str = "global"
) -> DataFrame:
    """``metric, <scope>, month, value`` of every metric and scope, and the plain mean of all scopes per month."""
    doubles = monthly.select(scope, "month", *[F.col(m).cast("double").alias(m) for m in metrics])
    long = doubles.unpivot([scope, "month"], list(metrics), "metric", "value").where(F.col("value").isNotNull())
    overall = long.groupBy("metric", "month").agg(F.avg("value").alias("value")).withColumn(scope, F.lit(everywhere))
    return long.unionByName(overall)


def break_event_distance(breaks: DataFrame, event_month: str, near_months: int = 3) -> DataFrame:
    """Months between each break and an event."""
    distance = timeparts.absolute_month_distance(F.col("break_month"), F.lit(event_month))
    return breaks.withColumn("dist_to_event_months", distance).withColumn(
        "near_event", F.col("dist_to_event_months") <= near_months
    )


def break_summary(breaks: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Series near the event and the median gain per metric (a row per series, so few)."""
    return breaks.groupBy(*keys).agg(
        F.count("*").alias("n_series"),
        F.count_if("near_event").alias("n_near_event"),
        F.array_join(F.array_sort(F.collect_set("break_month")), ", ").alias("break_months"),
        F.percentile("sse_ratio", F.lit(0.5)).alias("median_sse_ratio"),
    )


def strongest_breaks(breaks: DataFrame, n: int = 8) -> DataFrame:
    return breaks.orderBy("sse_ratio", *[c for c in breaks.columns if c not in ("sse_ratio",)]).limit(n)


def _best_two(points: DataFrame, keys: Sequence[str], min_segment: int) -> DataFrame:
    """The best pair of breaks. Each second break looks through the first breaks in an array."""
    candidates = _candidates(points, keys, min_segment)
    earlier = F.collect_list(
        F.struct("place", "month", "pre_sse", "pre_slope", *[F.col(f"before_{k}").alias(k) for k in _SUMS])
    ).over(Window.partitionBy(*keys))
    held = candidates.withColumn("_firsts", earlier)

    def pair(first: Column) -> Column:
        middle = _minus(_named("before"), {k: first[k] for k in _SUMS})
        total = first["pre_sse"] + _sse(middle) + F.col("post_sse")
        return F.struct(
            total.alias("sse"),
            first["place"].alias("first_place"),
            F.col("place").alias("second_place"),
            first["month"].alias("first_month"),
            F.col("month").alias("second_month"),
            first["pre_slope"].alias("slope_1"),
            _slope(middle).alias("slope_2"),
            F.col("post_slope").alias("slope_3"),
        )

    far_enough = F.filter("_firsts", lambda f: f["place"] <= F.col("place") - min_segment)
    best_first = F.array_min(F.transform(far_enough, pair))
    return (
        held.withColumn("_pair", best_first)
        .where(F.col("_pair").isNotNull())
        .groupBy(*keys)
        .agg(F.min("_pair").alias("_p"))
        .select(*keys, "_p.*")
    )


def regime_model_comparison(
    df: DataFrame, keys: Sequence[str], value: str, event_month: str, min_segment: int = 6, near_months: int = 3
) -> DataFrame:
    """Models with no, one and two breaks per series, with information criteria.

    A model has three parameters per break and two more. The distance is that of the nearest break.
    """
    keys = list(keys)
    points = indexed_series(df, keys, value)
    one = best_break(points, keys, min_segment)
    nothing, no_month = F.lit(None).cast("double"), F.lit(None).cast("string")

    def model(frame: DataFrame, breaks: int, sse: str, months: list[Column], slopes: list[Column]) -> DataFrame:
        return frame.select(
            *keys,
            F.lit(breaks).alias("n_breaks"),
            "n_obs",
            F.array_join(F.array(*months), ";").alias("break_months") if months else no_month.alias("break_months"),
            F.col(sse).alias("sse"),
            *[(slopes[i] if i < len(slopes) else nothing).alias(f"slope_{i + 1}") for i in range(3)],
        )

    two = _best_two(points, keys, min_segment).join(one.select(*keys, "n_obs"), keys)
    whole = _named("whole")
    flat = (
        with_running_sums(points, keys)
        .where((F.col("place") == 0) & (F.col("n_obs") >= 2 * min_segment + 2))
        .withColumn("sse", _sse(whole))
        .withColumn("slope", _slope(whole))
    )
    models = (
        model(flat, 0, "sse", [], [F.col("slope")])
        .unionByName(model(one, 1, "sse", [F.col("break_month")], [F.col("pre_slope"), F.col("post_slope")]))
        .unionByName(
            model(two, 2, "sse", [F.col("first_month"), F.col("second_month")], [F.col(f"slope_{i}") for i in (1, 2, 3)])
        )
    )
    n, sse = F.col("n_obs").cast("double"), F.col("sse")
    k = 3 * F.col("n_breaks") + 2
    fit = n * F.log(sse / n)
    scored = models.withColumns({
        "rmse": F.sqrt(sse / n),
        "bic": F.when(sse > 0, fit + k * F.log(n)),
        "aicc": F.when((sse > 0) & (n > k + 1), fit + 2 * k + ratio(2 * k * (k + 1), n - k - 1)),
    })
    whole_series = Window.partitionBy(*keys)
    base = F.max(F.when(F.col("n_breaks") == 0, F.col("bic"))).over(whole_series)
    chosen = F.min_by("n_breaks", "bic").over(whole_series)
    distance = F.array_min(
        F.transform(F.split("break_months", ";"), lambda m: timeparts.absolute_month_distance(m, F.lit(event_month)))
    )
    return scored.withColumns({
        "delta_bic_vs_no_break": F.col("bic") - base,
        "bic_selected": F.coalesce(F.col("n_breaks") == chosen, F.lit(False)),
        "dist_to_event_months": distance,
    }).withColumn("near_event", F.coalesce(F.col("dist_to_event_months") <= near_months, F.lit(False)))
