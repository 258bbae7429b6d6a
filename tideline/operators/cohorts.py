"""Arrival cohorts, event periods and windows around events.

Activity is reduced to one row per user and day (or week) before anything is joined to it: a user
with a third of all activity then has as many rows as there are days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import labels, timeparts
from tideline.functions.calendar import EventCalendar
from tideline.functions.stats import Z_95, ratio
from tideline.session import cut_lineage, sized_side

EVERYWHERE = "global"


def first_seen(activity: DataFrame, keys: Sequence[str] = ("user_id",), ts: str = "ts") -> DataFrame:
    """First activity per user, and its month."""
    return (
        activity.where(F.col(ts).isNotNull())
        .groupBy(*keys)
        .agg(F.min(ts).alias("first_seen"))
        .withColumn("first_month", timeparts.month_key(F.col("first_seen")))
    )


def newcomer_labels(first: DataFrame, days: Sequence[str]) -> DataFrame:
    """Static label and period group of each user by the first day of the first month."""
    start = timeparts.month_start(F.col("first_month"))
    return first.select(
        "*",
        labels.static_newcomer_label(start, days).alias("label"),
        labels.period_group(start, days).alias("period_group"),
    )


def join_node_labels(nodes: DataFrame, node_labels: DataFrame, on: Sequence[str], unlabelled: str | None) -> DataFrame:
    """Attach ``label`` to nodes. Nodes without one get ``unlabelled``, or are dropped when it is None."""
    if unlabelled is None:
        return nodes.join(node_labels, list(on))
    joined = nodes.join(node_labels, list(on), "left")
    return joined.withColumn("label", F.coalesce("label", F.lit(unlabelled)))


def behaviour_by_label(
    user_month: DataFrame,
    first: DataFrame,
    days: Sequence[str],
    metrics: Sequence[str],
    keys: Sequence[str] = ("community", "month"),
    on: Sequence[str] = ("community", "user_id"),
) -> DataFrame:
    """Mean metrics and user-months per month and newcomer label, as columns ``<metric>_<label>``.

    Users without a first month take no part.
    """
    labelled = user_month.join(first.select(*on, "first_month"), list(on)).withColumn(
        "label",
        labels.newcomer_label(
            timeparts.month_start(F.col("first_month")), timeparts.month_start(F.col("month")), days
        ),
    )
    aggs = []
    for name in ("newcomer", "existing"):
        inside = F.col("label") == name
        aggs += [F.avg(F.when(inside, F.col(m))).alias(f"{m}_{name}") for m in metrics]
        aggs.append(F.count_if(inside).alias(f"n_users_{name}"))
    return labelled.groupBy(*keys).agg(*aggs)


def behaviour_by_period(
    user_month: DataFrame,
    first: DataFrame,
    days: Sequence[str],
    metrics: Sequence[str],
    keys: Sequence[str] = ("community",),
    on: Sequence[str] = ("community", "user_id"),
) -> DataFrame:
    """Mean metrics and number of user-months per whole newcomer period and group."""
    month_ts = timeparts.month_start(F.col("month"))
    labelled = user_month.join(first.select(*on, "first_month"), list(on)).select(
        *keys,
        "user_id",
        *metrics,
        labels.period_group(month_ts, days).alias("period"),
        labels.newcomer_label(timeparts.month_start(F.col("first_month")), month_ts, days).alias("group"),
    )
    return (
        labelled.where(F.col("period") != "preA")
        .groupBy(*keys, "period", "group")
        .agg(*[F.avg(m).alias(m) for m in metrics], F.count("user_id").alias("n_user_months"))
    )


def active_users_by_status(
    user_month: DataFrame,
    first: DataFrame,
    days: Sequence[str],
    reputation: str = "mean_reputation",
    on: Sequence[str] = ("community", "user_id"),
) -> DataFrame:
    """Users with reputation above 1 per month and newcomer status, summed over communities."""
    known = user_month.where(F.col(reputation) > 1).join(first.select(*on, "first_month"), list(on), "left")
    status = labels.newcomer_label(
        timeparts.month_start(F.col("first_month")), timeparts.month_start(F.col("month")), days
    )
    return (
        known.withColumn("status", status)
        .groupBy("month")
        .agg(
            F.count_if(F.col("status") == "newcomer").alias("newcomer_active"),
            F.count_if(F.col("status") == "existing").alias("existing_active"),
        )
    )


def event_window_slice(df: DataFrame, calendar: EventCalendar, months: int = 3) -> DataFrame:
    """Rows within ``months`` of each event, with the side of the event they fall on.

    A row near two events appears once for each. Months count as their first day, so the event's
    own month is before it unless the event falls on the first.
    """
    month_ts = timeparts.month_start(F.col("month"))
    near = df.withColumn("_event", F.explode(calendar.as_array()))
    event_ts = F.col("_event.event_ts")
    reach = F.make_ym_interval(F.lit(0), F.lit(months))
    return (
        near.where((month_ts >= event_ts - reach) & (month_ts <= event_ts + reach))
        .withColumn("event", F.col("_event.event"))
        .withColumn("side", F.when(month_ts < event_ts, "pre").otherwise("post"))
        .drop("_event")
    )


def event_window_jump(
    community_month: DataFrame,
    calendar: EventCalendar,
    metrics: Sequence[str],
    keys: Sequence[str] = ("community", "platform"),
    months: int = 3,
) -> DataFrame:
    """Mean before and after each event per metric, and the jump between them."""
    sliced = event_window_slice(community_month, calendar, months)
    doubles = sliced.select(*keys, "event", "side", *[F.col(m).cast("double").alias(m) for m in metrics])
    long = doubles.unpivot([*keys, "event", "side"], list(metrics), "metric", "value")
    pre = F.avg(F.when(F.col("side") == "pre", F.col("value")))
    post = F.avg(F.when(F.col("side") == "post", F.col("value")))
    return long.groupBy(*keys, "event", "metric").agg(
        pre.alias("pre_mean"), post.alias("post_mean"), (post - pre).alias("jump")
    )


def weekly_event_window(
    activity: DataFrame, calendar: EventCalendar, score: str, weeks: tuple[int, int] = (-4, 4)
) -> DataFrame:
    """Weekly users, posts and means around each event, per community and over all of them.

    First activity is that of the user anywhere, scored or not. Both scopes come from the same
    sums per user: those of a community, and those added up over communities.
    """
    low, high = weeks
    seen = first_seen(activity).select("user_id", "first_seen")
    event_ts = F.col("_event.event_ts")
    week = timeparts.relative_week(F.col("ts"), event_ts)
    per_user = (
        activity.where(F.col(score).isNotNull())
        .select("user_id", "community", "ts", score, F.explode(calendar.as_array()).alias("_event"))
        .withColumn("relative_week", week)
        .where(F.col("relative_week").between(low, high))
        .groupBy("community", "user_id", "_event", "relative_week")
        .agg(F.sum(score).alias("_sum"), F.count(score).alias("_n"))
        .join(seen, "user_id")
        .withColumn("cohort_group", labels.event_cohort(F.col("first_seen"), event_ts, F.col("_event.next_ts")))
        .where(F.col("cohort_group") != "future_arrival")
        .withColumn("event", F.col("_event.event"))
    )
    group = ["event", "relative_week", "cohort_group"]
    scoped = (
        per_user.withColumn("community", F.explode(F.array(F.col("community"), F.lit(EVERYWHERE))))
        .groupBy("community", *group, "user_id")
        .agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    )
    return scoped.groupBy("community", *group).agg(
        F.count("*").alias("n_users"),
        F.sum("_n").alias("n_posts"),
        F.avg(F.col("_sum") / F.col("_n")).alias("user_mean"),
        (F.sum("_sum") / F.sum("_n")).alias("activity_mean"),
    )


def weekly_prepost_summary(weekly: DataFrame) -> DataFrame:
    """Means of the weeks before and from the event on, over all communities together."""
    pooled = weekly.where(F.col("community") == EVERYWHERE)
    before, after = F.col("relative_week") < 0, F.col("relative_week") >= 0
    aggs = []
    for column in ("n_users", "n_posts", "user_mean", "activity_mean"):
        pre = F.avg(F.when(before, F.col(column)))
        post = F.avg(F.when(after, F.col(column)))
        aggs += [pre.alias(f"pre_{column}"), post.alias(f"post_{column}")]
        if column.endswith("_mean"):
            aggs.append((post - pre).alias(f"delta_{column}"))
    return pooled.groupBy("event", "cohort_group").agg(*aggs)


def cohort_metrics(user_totals: DataFrame, keys: Sequence[str], total: str = "_sum", count: str = "_n") -> DataFrame:
    """Equal-user and activity-weighted means with standard errors, from one row per user.

    The weighted variance is taken around the weighted mean, which is joined back for it: sums of
    squares would cancel.
    """
    user_mean = F.col(total) / F.col(count)
    centre = user_totals.groupBy(*keys).agg((F.sum(total) / F.sum(count)).alias("_centre"))
    spread = F.col(count) * F.pow(user_mean - F.col("_centre"), 2)
    users = F.count("*")
    grouped = user_totals.join(sized_side(centre), list(keys)).groupBy(*keys).agg(
        users.alias("active_users"),
        F.sum(count).cast("bigint").alias("activity_count"),
        F.avg(user_mean).alias("user_mean"),
        F.when(users > 1, F.stddev_samp(user_mean) / F.sqrt(users)).alias("user_se"),
        F.max("_centre").alias("activity_mean"),
        F.when(users > 1, F.sqrt(F.sum(spread) / F.sum(count) / users)).alias("activity_se"),
    )
    return with_confidence(grouped)


def with_confidence(df: DataFrame) -> DataFrame:
    out = df
    for side in ("user", "activity"):
        mean, error = F.col(f"{side}_mean"), F.col(f"{side}_se")
        out = out.withColumn(f"{side}_ci95_low", mean - Z_95 * error)
        out = out.withColumn(f"{side}_ci95_high", mean + Z_95 * error)
    return out


def with_all_cohorts(scopes: DataFrame, cohorts: Sequence[str], metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every scope with every cohort; cohorts without activity have counts 0 and null means."""
    grid = scopes.withColumn("cohort", F.explode(F.array(*[F.lit(c) for c in cohorts])))
    joined = grid.join(metrics, [*keys, "cohort"], "left")
    return joined.fillna(0, ["active_users", "activity_count"])


def user_days(activity: DataFrame, score: str, keys: Sequence[str] = ("community",)) -> DataFrame:
    """Score sum and count per user and day, over scored activity."""
    return (
        activity.where(F.col(score).isNotNull())
        .groupBy(*keys, "user_id", F.to_date("ts").alias("day"))
        .agg(F.sum(score).alias("_sum"), F.count(score).alias("_n"))
    )


def with_arrival_cohort(
    days: DataFrame, activity: DataFrame, calendar: EventCalendar, keys: Sequence[str] = ("community",)
) -> DataFrame:
    """Attach the cohort of each user's first day of any activity within ``keys``."""
    seen = first_seen(activity, [*keys, "user_id"]).select(
        *keys, "user_id", calendar.arrival_cohort(F.date_trunc("day", "first_seen")).alias("cohort")
    )
    return days.join(seen, [*keys, "user_id"])


def cohort_period_summary(
    activity: DataFrame, calendar: EventCalendar, score: str, keys: Sequence[str] = ("community",)
) -> DataFrame:
    """Cohort metrics from the first event to the end. Pool communities by passing other keys."""
    tagged = with_arrival_cohort(user_days(activity, score, keys), activity, calendar, keys)
    period = tagged.where(F.col("day") >= F.lit(calendar.days[0]).cast("date"))
    totals = period.groupBy(*keys, "cohort", "user_id").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    scopes = period.groupBy(*keys).agg(F.date_format(F.max("day"), "yyyy-MM-dd").alias("period_end"))
    return with_all_cohorts(scopes, calendar.arrival_cohorts, cohort_metrics(totals, [*keys, "cohort"]), keys)


def sliding_window_timeseries(
    activity: DataFrame,
    calendar: EventCalendar,
    score: str,
    window_days: int = 30,
    step_days: int = 1,
    keys: Sequence[str] = ("community",),
) -> DataFrame:
    """Cohort metrics of every sliding window that fits between first and last day.

    A user's sum over the window only changes at the windows that a day of theirs enters or leaves, so
    a user-day becomes two rows at most, whatever the window's length. A user's part in a cohort's sums
    is the difference at these changes; running sums over the windows of a cohort then give every
    window. Sums are decimals, so that what enters also leaves without a trace, and means are taken
    from the cohort's own mean.
    """
    # Read for the spans, the means, the scopes and the windows.
    tagged = cut_lineage(with_arrival_cohort(user_days(activity, score, keys), activity, calendar, keys))
    span = tagged.groupBy(*keys).agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    span = span.where(F.date_add("_first", window_days - 1) <= F.col("_last"))
    last_step = F.floor((F.datediff("_last", "_first") - (window_days - 1)) / step_days).cast("int")
    scopes = span.select(*keys, "_first", F.explode(F.sequence(F.lit(0), last_step)).alias("_k")).select(
        *keys, "_k", F.date_add("_first", F.col("_k") * step_days).alias("_start")
    )
    place = F.datediff("day", "_first")
    first_k = F.greatest(F.lit(0), F.ceil((place - (window_days - 1)) / step_days)).cast("int")
    last_k = F.least(F.floor(place / step_days).cast("int"), last_step)
    exact = F.col("_sum").cast("decimal(36,20)")
    moves = F.array(
        F.struct(first_k.alias("_k"), exact.alias("_s"), F.col("_n").alias("_c")),
        F.struct((last_k + 1).alias("_k"), (-exact).alias("_s"), (-F.col("_n")).alias("_c")),
    )
    centre = tagged.groupBy(*keys, "cohort").agg((F.sum("_sum") / F.sum("_n")).alias("_centre"))
    changes = (
        tagged.join(sized_side(span), list(keys))
        .where(first_k <= last_k)
        .select(*keys, "cohort", "user_id", F.inline(moves))
        .groupBy(*keys, "cohort", "user_id", "_k")
        .agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
        .join(sized_side(centre), [*keys, "cohort"])
    )
    by_user = Window.partitionBy(*keys, "cohort", "user_id").orderBy("_k")
    so_far = by_user.rowsBetween(Window.unboundedPreceding, 0)
    held = changes.withColumns({"_total": F.sum("_s").over(so_far), "_count": F.sum("_c").over(so_far)})
    away = F.col("_total").cast("double") / F.col("_count") - F.col("_centre")
    parts = {
        "_users": F.lit(1),
        "_n": F.col("_count"),
        "_sum": F.col("_total"),
        "_x": away,
        "_xx": away * away,
        "_nxx": F.col("_count") * away * away,
    }
    zero = F.lit(0).cast("decimal(36,20)")
    present = {c: F.when(F.col("_count") > 0, v.cast("decimal(36,20)")).otherwise(zero) for c, v in parts.items()}
    deltas = {c: F.col(c) - F.coalesce(F.lag(c).over(by_user), zero) for c in parts}
    summed = (
        held.withColumns(present)
        .select(*keys, "cohort", "_k", *[v.alias(c) for c, v in deltas.items()])
        .groupBy(*keys, "cohort", "_k")
        .agg(*[F.sum(c).alias(c) for c in parts])
    )
    # One row per window and cohort from here on.
    cohorts = F.array(*[F.lit(c) for c in calendar.arrival_cohorts])
    grid = scopes.withColumn("cohort", F.explode(cohorts)).join(summed, [*keys, "cohort", "_k"], "left")
    by_step = Window.partitionBy(*keys, "cohort").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    running = grid.withColumns({c: F.coalesce(F.sum(c).over(by_step), zero).cast("double") for c in parts})
    running = running.join(sized_side(centre), [*keys, "cohort"], "left")
    users, count, x, some = F.col("_users"), F.col("_n"), F.col("_x"), F.col("_users") > 0
    # Sums around the cohort's mean, moved to the window's own means.
    spread = F.greatest(F.col("_xx") - x * x / users, F.lit(0.0)) / (users - 1)
    offset = F.col("_sum") / count - F.col("_centre")
    weighted = F.greatest(F.col("_nxx") / count - offset * offset, F.lit(0.0))
    metrics = running.select(
        *keys,
        (F.col("_k") * step_days).alias("step"),
        "cohort",
        users.cast("bigint").alias("active_users"),
        count.cast("bigint").alias("activity_count"),
        F.when(some, F.col("_centre") + x / users).alias("user_mean"),
        F.when(users > 1, F.sqrt(spread / users)).alias("user_se"),
        F.when(some, F.col("_sum") / count).alias("activity_mean"),
        F.when(users > 1, F.sqrt(weighted / users)).alias("activity_se"),
        F.date_format("_start", "yyyy-MM-dd").alias("window_tmin"),
        F.date_format(F.date_add("_start", window_days), "yyyy-MM-dd").alias("window_tmax"),
    )
    return with_confidence(metrics)


def period_cohort_bars(
    activity: DataFrame, calendar: EventCalendar, score: str, keys: Sequence[str] = ("community",)
) -> DataFrame:
    """Users and means per event period and arrival cohort."""
    scored = user_days(activity, score, keys)
    tagged = with_arrival_cohort(scored, activity, calendar, keys)
    totals = (
        tagged.withColumn("period", calendar.event_period(F.col("day").cast("timestamp")))
        .where(F.col("period").isNotNull())
        .groupBy(*keys, "period", "cohort", "user_id")
        .agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    )
    return totals.groupBy(*keys, "period", "cohort").agg(
        F.count("*").alias("n_users"),
        ratio(F.sum("_sum"), F.sum("_n")).alias("activity_mean"),
        F.avg(F.col("_sum") / F.col("_n")).alias("user_mean"),
    )


def interaction_type_sensitivity(
    activity: DataFrame, score: str, keys: Sequence[str] = ("community", "month"), comment: str = "COMMENT"
) -> DataFrame:
    """Equal-user mean over comments alone against that over all activity."""
    is_comment = F.upper("interaction_type") == comment
    per_user = activity.where(F.col(score).isNotNull()).groupBy(*keys, "user_id").agg(
        F.avg(score).alias("_all"), F.avg(F.when(is_comment, F.col(score))).alias("_comments")
    )
    everyone, commenters = F.avg("_all"), F.avg("_comments")
    return per_user.groupBy(*keys).agg(
        F.count("*").alias("member_count"),
        everyone.alias("mean_toxicity"),
        F.count("_comments").alias("member_count_comments"),
        commenters.alias("mean_toxicity_comments"),
        (commenters - everyone).alias("delta_toxicity_comments_minus_all"),
    )


def composition_decomposition(
    user_month: DataFrame,
    first: DataFrame,
    days: Sequence[str],
    metric: str,
    keys: Sequence[str] = ("community",),
    on: Sequence[str] = ("community", "user_id"),
    minimum: int = 20,
) -> DataFrame:
    """Month-to-month change of the mean, split into composition and behaviour of either group.

    With share ``s`` of newcomers and group means ``n`` and ``o``, and bars for the average of this
    month and the last: the change of ``s`` times ``bar(n) - bar(o)``, the change of ``n`` times
    ``bar(s)``, the change of ``o`` times ``1 - bar(s)``; the residual is what is left. A part is
    null where a group is empty in either month.
    """
    monthly = behaviour_by_label(user_month.where(F.col(metric).isNotNull()), first, days, [metric], [*keys, "month"], on)
    new, old = F.col("n_users_newcomer"), F.col("n_users_existing")
    mean_new, mean_old = F.col(f"{metric}_newcomer"), F.col(f"{metric}_existing")
    base = monthly.select(
        *keys,
        "month",
        (new + old).alias("member_count"),
        new.alias("newcomer_count"),
        old.alias("incumbent_count"),
        (new / (new + old)).alias("share_newcomers"),
        mean_new.alias("mean_newcomers"),
        mean_old.alias("mean_incumbents"),
        (
            (F.coalesce(mean_new, F.lit(0.0)) * new + F.coalesce(mean_old, F.lit(0.0)) * old) / (new + old)
        ).alias("overall_mean"),
    )
    before = Window.partitionBy(*keys).orderBy("month")

    def change(c: str) -> Column:
        return F.col(c) - F.lag(c).over(before)

    def middle(c: str) -> Column:
        return (F.col(c) + F.lag(c).over(before)) / 2

    parts = base.select(
        "*",
        change("overall_mean").alias("delta_overall"),
        (change("share_newcomers") * (middle("mean_newcomers") - middle("mean_incumbents"))).alias("composition_component"),
        (change("mean_newcomers") * middle("share_newcomers")).alias("newcomer_behavior_component"),
        (change("mean_incumbents") * (1 - middle("share_newcomers"))).alias("incumbent_behavior_component"),
    )
    explained = (
        F.col("composition_component") + F.col("newcomer_behavior_component") + F.col("incumbent_behavior_component")
    )
    return parts.withColumn("residual_component", F.col("delta_overall") - explained).withColumn(
        "valid_member_count", F.col("member_count") >= minimum
    )
