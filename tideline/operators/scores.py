"""Tables of classifier scores: distributions, agreement, samples and the scoring job itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.calendar import EventCalendar
from tideline.functions.draws import draw_key
from tideline.functions.stats import corr_agg, ratio
from tideline.operators import cohorts, inference
from tideline.operators.ranking import exact_quantiles, numbered_rows

EVERYWHERE = "global"


def by_label(scores: DataFrame, keys: Sequence[str], labels: dict[str, str]) -> DataFrame:
    """One row per score: ``keys, label, score``."""
    named = scores.select(*keys, *[F.col(c).cast("double").alias(name) for name, c in labels.items()])
    return named.unpivot(list(keys), list(labels), "label", "score")


def in_scopes(df: DataFrame, kind: str = "community_type", community: str = "community") -> DataFrame:
    """Every row under all, under its kind, and under its kind and community.

    A scope is a pair of names, ``global`` where it spans all of them.
    """
    whole = F.lit(EVERYWHERE)
    scopes = F.array(
        F.struct(whole.alias("kind"), whole.alias("place")),
        F.struct(F.col(kind).alias("kind"), whole.alias("place")),
        F.struct(F.col(kind).alias("kind"), F.col(community).alias("place")),
    )
    return (
        df.withColumn("_scope", F.explode(scopes))
        .withColumn(kind, F.col("_scope.kind"))
        .withColumn(community, F.col("_scope.place"))
        .drop("_scope")
    )


def score_distribution(scores: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Mean, quantiles and shares above 0.5 and 0.9 of every score in every scope.

    Values are counted per community before they are spread over scopes, and quantiles come from
    bins, so no task ever holds a scope.
    """
    keys = ["community_type", "community", "label"]
    long = by_label(scores, keys[:2], labels).where(F.col("score").isNotNull())
    n = F.count("*")
    partial = long.groupBy(*keys).agg(
        n.alias("_n"),
        F.sum("score").alias("_sum"),
        F.count_if(F.col("score") > 0.5).alias("_half"),
        F.count_if(F.col("score") > 0.9).alias("_most"),
    )
    means = in_scopes(partial).groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        ratio(F.sum("_sum"), F.sum("_n")).alias("mean"),
        ratio(F.sum("_half"), F.sum("_n")).alias("share_gt_0_5"),
        ratio(F.sum("_most"), F.sum("_n")).alias("share_gt_0_9"),
    )
    quantiles = exact_quantiles(in_scopes(long), keys, "score", {"median": 0.5, "q90": 0.9, "q95": 0.95})
    return means.join(quantiles, keys)


def score_monthly(scores: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Activities, users, and mean, upper decile and share above 0.5 of every score per month."""
    keys = ["community_type", "community", "month"]
    counts = _counts_and_means(scores, keys, labels)
    deciles = exact_quantiles(by_label(scores, keys, labels), [*keys, "label"], "score", {"q": 0.9})
    wide = deciles.groupBy(*keys).agg(
        *[F.max(F.when(F.col("label") == name, F.col("q"))).alias(f"{name}_q90") for name in labels]
    )
    return counts.join(wide, keys)


def _counts_and_means(scores: DataFrame, keys: Sequence[str], labels: dict[str, str]) -> DataFrame:
    """Per user first, so that counting users needs no further pass over the scores."""
    users = scores.groupBy(*keys, "user_id").agg(
        F.count("*").alias("_n"),
        *[F.sum(c).alias(f"_s_{name}") for name, c in labels.items()],
        *[F.count(c).alias(f"_c_{name}") for name, c in labels.items()],
        *[F.count_if(F.col(c) > 0.5).alias(f"_h_{name}") for name, c in labels.items()],
    )
    aggs = [F.sum("_n").alias("activity_count"), F.count("*").alias("active_users")]
    for name in labels:
        aggs.append(ratio(F.sum(f"_s_{name}"), F.sum(f"_c_{name}")).alias(f"{name}_mean"))
        aggs.append(ratio(F.sum(f"_h_{name}"), F.sum("_n")).alias(f"{name}_share_gt_0_5"))
    return users.groupBy(*keys).agg(*aggs)


def score_event_period(scores: DataFrame, labels: dict[str, str], calendar: EventCalendar) -> DataFrame:
    """As :func:`score_monthly` without deciles, per event period by exact time."""
    within = scores.withColumn("period", calendar.event_period(F.col("ts"))).where(F.col("period").isNotNull())
    return _counts_and_means(within, ["community_type", "community", "period"], labels)


def score_by_interaction(scores: DataFrame, labels: dict[str, str]) -> DataFrame:
    return scores.groupBy(F.lower("interaction_type").alias("interaction"), "community_type", "community").agg(
        F.count("*").alias("n_rows"), *[F.avg(c).alias(f"{name}_mean") for name, c in labels.items()]
    )


def score_period_rollup(periods: DataFrame, labels: dict[str, str], kind: str = "normal") -> DataFrame:
    """Mean over communities of one kind per period."""
    return periods.where(F.col("community_type") == kind).groupBy("period").agg(
        *[F.avg(f"{name}_mean").alias(f"{name}_mean") for name in labels]
    )


def score_density_grid(scores: DataFrame, x: str, y: str, cells: int = 55) -> DataFrame:
    """Number of rows per cell of a square grid over two scores, and its logarithm.

    The grid spans the scores' own extents; the largest value of a score lies in the last cell.
    """
    known = scores.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    low_x, high_x, low_y, high_y = known.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()

    def cell(c: str, low: float | None, high: float | None) -> Column:
        if low is None or high == low:
            return F.lit(0)
        place = (F.col(c) - F.lit(low)) / F.lit(high - low) * cells
        return F.least(F.floor(place), F.lit(cells - 1)).cast("int")

    return known.groupBy(cell(x, low_x, high_x).alias("cell_x"), cell(y, low_y, high_y).alias("cell_y")).agg(F.count("*").alias("n")).withColumn(
        "log10_n", F.log10("n")
    )


def score_scope_summary(scores: DataFrame, labels: dict[str, str], x: str, y: str) -> DataFrame:
    """Posts, comments and both: rows, means, shares above 0.5 and the agreement of two scores."""
    scoped = scores.withColumn(
        "scope", F.explode(F.array(F.lower("interaction_type"), F.lit("both")))
    )
    means = scoped.groupBy("scope").agg(
        F.count("*").alias("n_rows"),
        *[F.avg(c).alias(f"{name}_mean") for name, c in labels.items()],
        *[F.avg((F.col(c) > 0.5).cast("double")).alias(f"{name}_share_gt_0_5") for name, c in labels.items()],
    )
    agreement = inference.pearson_spearman(scoped, ["scope"], x, y).select("scope", "pearson_r", "spearman_rho")
    return means.join(agreement, "scope")


def correlation_table(scores: DataFrame, base: str, others: dict[str, str]) -> DataFrame:
    """Agreement of one score with each of the others, in every scope."""
    keys = ["community_type", "community"]
    named = scores.select(*keys, F.col(base).alias("_base"), *[F.col(c).alias(n) for n, c in others.items()])
    long = named.unpivot([*keys, "_base"], list(others), "label", "score")
    # Counted per community before the scopes multiply them.
    counted = long.groupBy(*keys, "label", "_base", "score").agg(F.count("*").alias("_rows"))
    return inference.pearson_spearman(in_scopes(counted), [*keys, "label"], "_base", "score", "_rows")


def multi_label_cohort_summary(scores: DataFrame, labels: dict[str, str], calendar: EventCalendar) -> DataFrame:
    """Cohort metrics of every score from the first event on, per community and over all of them.

    A user's cohort follows the first activity anywhere.
    """
    seen = cohorts.first_seen(scores).select("user_id", calendar.arrival_cohort(F.col("first_seen")).alias("cohort"))
    since = scores.where(F.col("ts") >= F.lit(calendar.days[0]).cast("timestamp"))
    long = by_label(since, ["community", "user_id"], labels).where(F.col("score").isNotNull())
    per_user = long.groupBy("community", "label", "user_id").agg(F.sum("score").alias("_sum"), F.count("*").alias("_n"))
    scoped = (
        per_user.withColumn("community", F.explode(F.array(F.col("community"), F.lit("all_examined_communities"))))
        .groupBy("community", "label", "user_id")
        .agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
        .join(seen, "user_id")
    )
    metrics = cohorts.cohort_metrics(scoped, ["community", "label", "cohort"])
    scopes = scoped.select("community", "label").distinct()
    return cohorts.with_all_cohorts(scopes, calendar.arrival_cohorts, metrics, ["community", "label"])


def top_rank_summary(distribution: DataFrame, label: str, n: int = 5) -> DataFrame:
    """Communities with the highest mean of a score."""
    rows = distribution.where((F.col("label") == label) & (F.col("community") != EVERYWHERE))
    return rows.orderBy(F.desc("mean"), "community").limit(n)


def community_label_pivot(distribution: DataFrame, labels: Sequence[str], by: str) -> DataFrame:
    """Communities by scores, in order of one of them."""
    rows = distribution.where(F.col("community") != EVERYWHERE)
    wide = rows.groupBy("community_type", "community").agg(
        *[F.max(F.when(F.col("label") == name, F.col("mean"))).alias(name) for name in labels]
    )
    return wide.orderBy(F.desc(by), "community")


def scoring_manifest(eligible: DataFrame, scored: DataFrame, key: str = "post_id") -> DataFrame:
    """Eligible and scored rows per community."""
    done = scored.select(key).distinct().withColumn("_done", F.lit(True))
    joined = eligible.join(done, key, "left")
    return joined.groupBy("community").agg(
        F.count("*").alias("eligible_rows"), F.count("_done").alias("scored_rows")
    )


def toxicity_calibration(
    activity: DataFrame, score: str, keys: Sequence[str] = ("platform", "community")
) -> DataFrame:
    """Yearly quantiles, shares at or above 0.5 and 0.8, and share without a score."""
    group = [*keys, "year"]
    yearly = activity.withColumn("year", F.year("ts"))
    value = F.col(score)
    counts = yearly.groupBy(*group).agg(
        F.count("*").alias("total_rows"),
        F.count(value).alias("non_null_rows"),
        (1 - ratio(F.count(value), F.count("*"))).alias("missing_share"),
        ratio(F.count_if(value >= 0.5), F.count(value)).alias("share_ge_0_5"),
        ratio(F.count_if(value >= 0.8), F.count(value)).alias("share_ge_0_8"),
    )
    probs = {f"q_{p}": p / 100 for p in (10, 25, 50, 75, 90)}
    return counts.join(exact_quantiles(yearly, group, score, probs), group, "left")


def stratified_sample(
    eligible: DataFrame, strata: Sequence[str], total: int, seed: int, stratum: str = "community", key: str = "post_id"
) -> DataFrame:
    """``total`` rows split evenly over the named strata, the first ones taking what is left over.

    A stratum with fewer rows gives all it has. Rows are ordered by a hash of seed and key: the
    first ones of each stratum are the sample, and another hash shuffles and numbers it. The rank is
    cut before the shuffle of the window, so a task passes on no more rows than the sample takes.
    """
    base, extra = divmod(total, len(strata))
    wanted = F.create_map(*[
        cell for i, name in enumerate(strata) for cell in (F.lit(name), F.lit(base + (1 if i < extra else 0)))
    ])
    most = base + (1 if extra else 0)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_key", key))
    keyed = eligible.where(F.col(stratum).isin(*strata)).withColumn("_key", draw_key(F.lit(seed), F.col(key)))
    picked = (
        keyed.withColumn("_place", place)
        .where(F.col("_place") <= most)
        .withColumn("sample_requested_n", wanted[F.col(stratum)])
        .where(F.col("_place") <= F.col("sample_requested_n"))
        .withColumn("sample_seed", F.lit(seed))
        .withColumn("_order", draw_key(F.lit(seed), F.lit("order"), F.col(key)))
    )
    actual = F.count("*").over(Window.partitionBy(stratum))
    numbered = numbered_rows(
        picked.withColumn("sample_actual_n", actual).drop("_key", "_place"),
        [],
        [F.col("_order"), F.col(key)],
        "sample_row_id",
    )
    return numbered.drop("_order")


Scorer = Callable[[pd.Series], pd.DataFrame]


def batch_text_scoring(
    eligible: DataFrame,
    make_scorer: Callable[[], Scorer],
    labels: Sequence[str],
    already: DataFrame | None = None,
    text: str = "content",
    key: str = "post_id",
    keep_text: bool = False,
    batch: int = 16,
) -> DataFrame:
    """Score whole texts with the caller's scorer, leaving out rows that have been scored.

    ``make_scorer`` runs once per task, where a model would be loaded; the scorer it returns takes a
    batch of texts and returns one column per label.
    """
    todo = eligible if already is None else eligible.join(already.select(key).distinct(), key, "left_anti")
    kept = [c for c in todo.columns if keep_text or c != text]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema.fields if f.name in kept]
    schema = ", ".join([*fields, *[f"`{name}` double" for name in labels]])
    names = list(labels)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            parts = [scorer(frame[text].iloc[i : i + batch])[names] for i in range(0, len(frame), batch)]
            found = pd.concat(parts) if parts else pd.DataFrame(columns=names)
            out = frame[kept].reset_index(drop=True)
            for name in names:
                out[name] = found[name].to_numpy(dtype="float64")
            yield out

    return todo.mapInPandas(score, schema)
