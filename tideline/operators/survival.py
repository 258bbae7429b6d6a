"""Retention of fixed arrival cohorts: user summaries, survival curves and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import timeparts
from tideline.functions.calendar import EventCalendar
from tideline.functions.stats import ratio
from tideline.operators.ranking import exact_quantiles
from tideline.session import cut_lineage, sized_side

# Months of early behaviour, quantiles that split it, and horizons in months.
EARLY_MONTHS = (1, 3, 6)
TOXICITY_QUANTILES = (0.5, 0.75, 0.9)
HORIZONS = (3, 6, 12)

EVERYWHERE = "global"


def user_months(user_month: DataFrame, first_seen: DataFrame, calendar: EventCalendar) -> DataFrame:
    """User-months with the user's arrival cohort; users without a first activity are dropped."""
    cohorts = first_seen.select(
        "community", "user_id", "first_month", calendar.fixed_cohort(F.col("first_seen")).alias("fixed_cohort")
    )
    joined = user_month.join(cohorts, ["community", "user_id"])
    return joined.where(F.col("fixed_cohort") != "unknown").withColumn(
        "month_number", timeparts.month_index(F.col("month"))
    )


def first_k_active_months_mean(
    months: DataFrame, metric: str, ks: Sequence[int] = EARLY_MONTHS, users: Sequence[str] = ("community", "user_id")
) -> DataFrame:
    """Mean over a user's first ``k`` active months, for every ``k``; null where all are null.

    A user's window holds months, so it is short however active the user is.
    """
    nth = F.row_number().over(Window.partitionBy(*users).orderBy("month_number"))
    ranked = months.select(*users, metric, nth.alias("_nth"))
    return ranked.groupBy(*users).agg(
        *[F.avg(F.when(F.col("_nth") <= k, F.col(metric))).alias(f"early_toxicity_first{k}_months") for k in ks]
    )


def first_month_activity(months: DataFrame, users: Sequence[str] = ("community", "user_id")) -> DataFrame:
    """Activity of each user in the first active month."""
    return months.groupBy(*users).agg(
        F.min_by("activity_count", "month_number").alias("first_month_activity_count")
    )


def user_summary(months: DataFrame, calendar: EventCalendar, metric: str = "mean_toxicity") -> DataFrame:
    """One row per community and user: span, activity, early behaviour, survival and retention.

    A spell has ended when the last active month is before the month the period ends in.
    """
    users = ["community", "user_id"]
    months = cut_lineage(months)
    shutdown = int(calendar.end[:4]) * 12 + int(calendar.end[5:7])
    summary = months.groupBy(*users).agg(
        F.first("fixed_cohort").alias("fixed_cohort"),
        F.first("first_month").alias("first_month"),
        F.min("month_number").alias("_first"),
        F.max("month_number").alias("_last"),
        F.count_distinct("month_number").alias("active_months"),
        F.sum("activity_count").alias("total_activity"),
        F.avg(metric).alias("mean_toxicity"),
    )
    spell = F.col("_last") - F.col("_first") + 1
    summary = (
        summary.join(first_k_active_months_mean(months, metric), users)
        .join(first_month_activity(months), users)
        .withColumns({
            "first_active_month": timeparts.month_from_index(F.col("_first")),
            "last_active_month": timeparts.month_from_index(F.col("_last")),
            "survival_months": spell.cast("int"),
            "event_observed": F.col("_last") < shutdown,
            **{f"retained_{h}m": spell >= h + 1 for h in HORIZONS},
        })
        .drop("_first", "_last")
    )
    # Read for the threshold and for the users.
    summary = cut_lineage(summary)
    high = group_threshold(summary, "first_month_activity_count", {"activity_q90": 0.9})
    label = F.when(F.col("first_month_activity_count") >= F.col("activity_q90"), "high_activity")
    return summary.join(sized_side(high), ["community", "fixed_cohort"]).withColumn(
        "activity_group", label.otherwise("lower_activity")
    )


def group_threshold(
    users: DataFrame, column: str, probs: dict[str, float], keys: Sequence[str] = ("community", "fixed_cohort")
) -> DataFrame:
    return exact_quantiles(users, list(keys), column, probs)


def with_toxicity_groups(
    users: DataFrame,
    early_months: Sequence[int] = EARLY_MONTHS,
    quantiles: Sequence[float] = TOXICITY_QUANTILES,
) -> DataFrame:
    """Users once per definition, split at the quantile of their community and cohort.

    Users without the early value have a null group under that definition.
    """
    kept = ["community", "user_id", "fixed_cohort", "survival_months", "event_observed"]
    kept += [f"retained_{h}m" for h in HORIZONS]
    tall = users.select(
        *kept,
        F.explode(
            F.array(*[
                F.struct(F.lit(k).alias("early_months"), F.col(f"early_toxicity_first{k}_months").alias("early_value"))
                for k in early_months
            ])
        ).alias("_e"),
    ).select(*kept, F.col("_e.early_months").alias("early_months"), F.col("_e.early_value").alias("early_value"))
    # Read for the cuts and again for the groups.
    tall = cut_lineage(tall)
    names = {f"_q{i}": q for i, q in enumerate(quantiles)}
    cuts = group_threshold(tall, "early_value", names, ["community", "fixed_cohort", "early_months"])
    choices = F.array(*[
        F.struct(F.lit(float(q)).alias("q"), F.col(name).alias("cut")) for name, q in names.items()
    ])
    split = tall.join(sized_side(cuts), ["community", "fixed_cohort", "early_months"], "left").withColumn("_c", F.explode(choices))
    group = F.when(F.col("early_value") >= F.col("_c.cut"), "high_toxicity").when(
        F.col("early_value") < F.col("_c.cut"), "lower_toxicity"
    )
    return split.select(
        *kept, "early_months", F.col("_c.q").alias("high_toxicity_quantile"), group.alias("toxicity_group")
    )


def _spell_counts(grouped: DataFrame) -> DataFrame:
    scope = ["community", "fixed_cohort", "early_months", "high_toxicity_quantile", "toxicity_group"]
    counted = grouped.groupBy(*scope, "survival_months", "event_observed").agg(F.count("*").alias("spells"))
    return cut_lineage(counted)


def kaplan_meier(
    spells: DataFrame,
    keys: Sequence[str],
    time: str = "survival_months",
    event: str = "event_observed",
    weight: str | None = None,
) -> DataFrame:
    """Product-limit curve per group: one row at 0 and one per time with an event.

    Spells are counted per time first (``weight`` says how many a row stands for); the windows see
    times, which are at most the months of the study.
    """
    keys = list(keys)
    t = F.col(time)
    many = F.lit(1) if weight is None else F.col(weight)
    counts = spells.where(t > 0).groupBy(*keys, t.cast("double").alias("time_months")).agg(
        F.sum(F.when(F.col(event), many).otherwise(0)).alias("n_events"),
        F.sum(F.when(F.col(event), 0).otherwise(many)).alias("n_censored"),
    )
    from_here = Window.partitionBy(*keys).orderBy(F.desc("time_months")).rowsBetween(Window.unboundedPreceding, 0)
    up_to_here = Window.partitionBy(*keys).orderBy("time_months").rowsBetween(Window.unboundedPreceding, 0)
    curve = (
        counts.withColumn("n_at_risk", F.sum(F.col("n_events") + F.col("n_censored")).over(from_here))
        .where(F.col("n_events") > 0)
        .withColumn("_kept", 1 - F.col("n_events") / F.col("n_at_risk"))
        .withColumn("survival_probability", F.product("_kept").over(up_to_here))
        .drop("_kept")
    )
    start = counts.select(*keys).distinct().withColumns({
        "time_months": F.lit(0.0),
        "n_events": F.lit(None).cast("bigint"),
        "n_censored": F.lit(None).cast("bigint"),
        "n_at_risk": F.lit(None).cast("bigint"),
        "survival_probability": F.lit(1.0),
    })
    return start.unionByName(curve)


def survival_at(horizon: int) -> Column:
    """Aggregate over a curve: its last value up to the horizon, 1 before any event."""
    inside = F.col("time_months") <= horizon
    last = F.max_by(F.when(inside, F.col("survival_probability")), F.when(inside, F.col("time_months")))
    return F.coalesce(last, F.lit(1.0))


def post_event_scopes(grouped: DataFrame, calendar: EventCalendar) -> DataFrame:
    """Users of the cohorts after the first event, under their community and under all of them."""
    later = grouped.where(F.col("fixed_cohort").isin(*calendar.fixed_cohorts[1:]))
    return later.where(F.col("toxicity_group").isNotNull()).withColumn(
        "community", F.explode(F.array(F.col("community"), F.lit(EVERYWHERE)))
    )


def survival_by_toxicity(grouped: DataFrame, calendar: EventCalendar) -> DataFrame:
    """High against lower early toxicity per scope, cohort and definition, in one job.

    Scopes in which only one of the groups occurs are left out. Curves and counts read the spells
    apart, so these are first counted per length: a scope has as many rows as months.
    """
    scoped = _spell_counts(post_event_scopes(grouped, calendar))
    scope = ["community", "fixed_cohort", "early_months", "high_toxicity_quantile"]
    curves = kaplan_meier(scoped, [*scope, "toxicity_group"], weight="spells").groupBy(*scope, "toxicity_group").agg(
        *[survival_at(h).alias(f"km_survival_{h}m") for h in HORIZONS]
    )
    sides = scoped.groupBy(*scope, "toxicity_group").agg(
        F.sum("spells").alias("_n"),
        F.sum(F.when(F.col("event_observed"), 0).otherwise(F.col("spells"))).alias("_censored"),
        F.percentile("survival_months", F.lit(0.5), F.col("spells")).alias("median_survival_months"),
        *[
            ratio(F.sum(F.when(F.col("survival_months") >= h + 1, F.col("spells")).otherwise(0)), F.sum("spells")).alias(
                f"retention_{h}m"
            )
            for h in HORIZONS
        ],
    )
    both = sides.join(curves, [*scope, "toxicity_group"], "left")

    def of(group: str, column: str) -> Column:
        return F.max(F.when(F.col("toxicity_group") == f"{group}_toxicity", F.col(column)))

    measures = [f"{m}_{h}m" for h in HORIZONS for m in ("km_survival", "retention")]
    aggs = [
        F.sum("_n").alias("n_users"),
        of("high", "_n").alias("n_high_toxicity"),
        of("lower", "_n").alias("n_lower_toxicity"),
        ratio(F.sum("_censored"), F.sum("_n")).alias("censored_rate"),
    ]
    for prefix in ("high", "lower"):
        aggs.append(of(prefix, "median_survival_months").alias(f"median_survival_months_{prefix}"))
        aggs += [of(prefix, m).alias(f"{m}_{prefix}") for m in measures]
    aggs += [(of("high", m) - of("lower", m)).alias(f"{m}_high_minus_lower") for m in measures]
    wide = both.groupBy(*scope).agg(*aggs)
    return wide.where(F.col("n_high_toxicity").isNotNull() & F.col("n_lower_toxicity").isNotNull())


def survival_sensitivity(summary: DataFrame) -> DataFrame:
    """The global rows of every definition, with the columns that are compared."""
    return summary.where(F.col("community") == EVERYWHERE).select(
        "fixed_cohort",
        "early_months",
        "high_toxicity_quantile",
        "n_users",
        "n_high_toxicity",
        "km_survival_3m_high_minus_lower",
        "km_survival_12m_high_minus_lower",
        "retention_3m_high_minus_lower",
        "retention_12m_high_minus_lower",
    )


def hub_ascent_summary(
    users: DataFrame, shares: DataFrame, calendar: EventCalendar, fractions: Sequence[float] = (0.05, 0.1, 0.2)
) -> DataFrame:
    """Per cohort and hub definition: degree shares over months, and who ever became a hub.

    Users count once per community. Cohorts without users still appear.
    """
    later = calendar.fixed_cohorts[1:]
    flags = F.array(*[
        F.struct(F.lit(float(f)).alias("hub_fraction"), F.col(f"ever_hub_top{round(f * 100)}").alias("hub"))
        for f in fractions
    ])
    high = F.col("activity_group") == "high_activity"
    hub = F.col("_f.hub").cast("double")
    rates = users.withColumn("_f", F.explode(flags)).groupBy("fixed_cohort", F.col("_f.hub_fraction").alias("hub_fraction")).agg(
        F.count("*").alias("n_users"),
        F.avg(hub).alias("mean_ever_hub_rate"),
        F.avg(F.when(high, hub)).alias("high_activity_ever_hub_rate"),
        F.avg(F.when(~high, hub)).alias("non_high_activity_ever_hub_rate"),
    )
    # Rows of ``shares`` are community-months, few per cohort. A null ratio is not below 1.
    below = F.when(F.col("degree_share_ratio") < 1, 1.0).otherwise(0.0)
    months = shares.groupBy("fixed_cohort").agg(
        F.percentile("degree_share_ratio", F.lit(0.5)).alias("median_degree_share_ratio"),
        F.avg(below).alias("share_months_underrepresented"),
    )
    spark = users.sparkSession
    grid = spark.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in later])).alias("fixed_cohort")
    ).withColumn("hub_fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    joined = grid.join(rates, ["fixed_cohort", "hub_fraction"], "left").join(months, "fixed_cohort", "left")
    return joined.withColumn("n_users", F.coalesce("n_users", F.lit(0))).withColumn(
        "hub_equality_baseline", F.col("hub_fraction")
    )


def manuscript_table(
    sensitivity: DataFrame, hubs: DataFrame, early_months: int = 3, quantile: float = 0.75, fraction: float = 0.1
) -> DataFrame:
    """Primary survival differences beside the primary hub rates, rounded to 4 digits."""
    primary = sensitivity.where(
        (F.col("early_months") == early_months) & (F.abs(F.col("high_toxicity_quantile") - quantile) < 1e-9)
    )
    top = hubs.where(F.abs(F.col("hub_fraction") - fraction) < 1e-9)
    percent = round(fraction * 100)

    def shown(column: str, name: str) -> Column:
        return F.round(column, 4).alias(name)

    return primary.join(top.drop("n_users"), "fixed_cohort", "left").select(
        F.col("fixed_cohort").alias("cohort"),
        "n_users",
        F.col("n_high_toxicity").alias("n_high_early_toxicity"),
        shown("km_survival_3m_high_minus_lower", "km_3m_high_minus_lower"),
        shown("km_survival_12m_high_minus_lower", "km_12m_high_minus_lower"),
        shown("median_degree_share_ratio", "median_degree_share_ratio"),
        shown("mean_ever_hub_rate", f"mean_ever_hub_rate_top{percent}"),
        F.lit(float(fraction)).alias(f"hub_rate_equality_baseline_top{percent}"),
        shown("high_activity_ever_hub_rate", f"high_activity_ever_hub_rate_top{percent}"),
        shown("non_high_activity_ever_hub_rate", f"non_high_activity_ever_hub_rate_top{percent}"),
    )
