"""Activity-based reputation with exponential decay.

A user gains ``base + base * alpha * (1 - 1 / (A + 1))`` at each activity, where ``A`` counts the
activities of the current run of consecutive active days, and what was gained decays by ``beta`` per
day. The recurrence is linear, so a user's value is a decayed running sum, which windows express.

The sums are taken in two steps. Activities of a user's day are gathered first, in pieces of at most
``PIECE_EVENTS``; the running sum then runs over a user's pieces. The second window holds one row per
active day, and one more for every ``PIECE_EVENTS`` activities, and the first splits even the most
active user by day.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.stats import ratio
from tideline.functions.timeparts import SECONDS_PER_DAY, unix_micros_seconds
from tideline.session import sized_side

SCOPE = ("platform", "community")

#: Activities of a user's day that stand in one row.
PIECE_EVENTS = 1024

# Exponents are kept within this range of a block's start, well inside that of doubles.
_BLOCK = 300.0


@dataclass(frozen=True)
class ReputationModel:
    """Parameters of the model. ``compounding`` decays an idle day from the day before it."""

    beta: float = 0.96
    alpha: float = 2.0
    base: float = 1.0
    compounding: bool = False

    @property
    def rate(self) -> float:
        return -math.log(self.beta)


def scope_bounds(activity: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """First and last activity of each scope in epoch seconds."""
    seconds = unix_micros_seconds(F.col("ts"))
    return activity.groupBy(*scope).agg(F.min(seconds).alias("t_min"), F.max(seconds).alias("t_max"))


def on_scope_clock(activity: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Day number and fraction of the day since the scope's first activity."""
    place = (unix_micros_seconds(F.col("ts")) - F.col("t_min")) / SECONDS_PER_DAY
    return (
        activity.select(*scope, "user_id", "ts")
        .join(sized_side(scope_bounds(activity, scope)), list(scope))
        .withColumn("_place", place)
        .withColumn("day", F.floor("_place").cast("int"))
    )


def user_active_days(clocked: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """One row per user and active day, with the run of consecutive days it belongs to."""
    days = clocked.groupBy(*scope, "user_id", "day").agg(
        F.count("*").alias("n_events"),
        F.max("_place").alias("last_place"),
        F.first("t_min").alias("t_min"),
        F.first("t_max").alias("t_max"),
    )
    by_user = Window.partitionBy(*scope, "user_id").orderBy("day")
    so_far = by_user.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.when(F.col("day") - F.lag("day").over(by_user) == 1, 0).otherwise(1)
    return (
        days.withColumn("_fresh", fresh)
        .withColumn("run", F.sum("_fresh").over(so_far).cast("int"))
        .withColumn("previous_day", F.lag("day").over(by_user))
        .withColumn("previous_place", F.lag("last_place").over(by_user))
        .withColumn("next_day", F.lead("day").over(by_user))
        .drop("_fresh")
    )


def activity_runs(clocked: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Runs of consecutive active days per user."""
    return (
        user_active_days(clocked, scope)
        .groupBy(*scope, "user_id", "run")
        .agg(
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
            F.count("*").alias("active_days"),
            F.sum("n_events").alias("n_events"),
        )
    )


def decayed_running_sum(placed: DataFrame, keys: Sequence[str], order: Sequence[str] = ("day",)) -> DataFrame:
    """``_value``, the running sum of ``_gain`` over the days of ``keys``, decayed by the exponent ``_decay``.

    Sums are taken relative to the start of a block of exponents. What lies two blocks back has
    decayed below the precision of doubles.
    """
    since_block = F.col("_decay") - F.col("_block") * _BLOCK
    in_block = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    block_before = Window.partitionBy(*keys).orderBy("_block").rangeBetween(-1, -1)
    value = F.exp(-since_block) * F.sum("_grown").over(in_block) + F.exp(-since_block - _BLOCK) * F.coalesce(
        F.sum("_grown").over(block_before), F.lit(0.0)
    )
    return (
        placed.withColumn("_block", F.floor(F.col("_decay") / _BLOCK))
        .withColumn("_grown", F.col("_gain") * F.exp(since_block))
        .withColumn("_value", value)
    )


def day_pieces(clocked: DataFrame, keys: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """Activities of each day of ``keys`` in order of time, at most ``PIECE_EVENTS`` a row; ``kept`` is alike within a key.

    Rows without a user or a time are left out.
    """
    in_day = Window.partitionBy(*keys, "day").orderBy("_place")
    return (
        clocked.where(F.col("user_id").isNotNull() & F.col("day").isNotNull())
        .withColumn("_piece", F.floor((F.row_number().over(in_day) - 1) / PIECE_EVENTS))
        .groupBy(*keys, "day", "_piece")
        .agg(F.sort_array(F.collect_list("_place")).alias("_places"), *[F.first(c).alias(c) for c in kept])
        .withColumn("n_events", F.size("_places").cast("bigint"))
        .withColumn("last_place", F.element_at("_places", -1))
    )


def running_reputation(
    pieces: DataFrame,
    keys: Sequence[str],
    model: ReputationModel,
    order: Sequence[str] = ("day", "_piece"),
    entered: str | None = None,
) -> DataFrame:
    """Pieces with the events of the run before them (``_before``), the value after them (``_value``) and ``next_day``.

    ``next_day`` is the day of the user's next piece, so a day's last piece is the one with another next day
    or none. A row with a value in ``entered`` stands for all before it: its events are those of the run it
    ends with.
    """
    by_user = Window.partitionBy(*keys).orderBy(*order)
    so_far = by_user.rowsBetween(Window.unboundedPreceding, 0)
    earlier = by_user.rowsBetween(Window.unboundedPreceding, -1)
    previous_day, previous_place = F.lag("day").over(by_user), F.lag("last_place").over(by_user)

    # Decay from one piece to the next as an exponent; pieces of one day have no idle day between.
    exponent = F.col("last_place") - previous_place
    if model.compounding:
        idle = F.greatest(F.col("day") - previous_day - 1, F.lit(0))
        rest_of_day = 1 - (previous_place - previous_day)
        exponent = exponent + idle * (idle + 1) / 2 + idle * rest_of_day
    days = (
        pieces.withColumns({
            "_fresh": F.coalesce(F.col("day") - previous_day > 1, F.lit(True)),
            "_earlier": F.coalesce(F.sum("n_events").over(earlier), F.lit(0)),
            "_step": F.coalesce(exponent * model.rate, F.lit(0.0)),
            "next_day": F.lead("day").over(by_user),
        })
        .withColumns({
            # Activities before a run only grow from run to run, so the largest is that of the current one.
            "_before": F.col("_earlier") - F.max(F.when(F.col("_fresh"), F.col("_earlier"))).over(so_far),
            "_decay": F.sum("_step").over(so_far),
        })
    )

    # Gains of a piece, decayed to its last activity.
    def gain(count: Column) -> Column:
        return model.base + model.base * model.alpha * (1 - 1 / (count + 1))

    def decayed(place: Column, i: Column) -> Column:
        return gain(F.col("_before") + i + 1) * F.exp(-model.rate * (F.col("last_place") - place))

    several = F.aggregate(F.transform("_places", decayed), F.lit(0.0), lambda total, one: total + one)
    gained = F.when(F.col("n_events") == 1, gain(F.col("_before") + 1)).otherwise(several)
    if entered is not None:
        gained = F.when(F.col(entered).isNotNull(), F.col(entered)).otherwise(gained)
    placed = days.withColumn("_gain", gained).drop("_places", "_fresh", "_earlier", "_step")
    return decayed_running_sum(placed, keys, order)


def reputation_events(
    activity: DataFrame, model: ReputationModel, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Reputation after the last activity of each active day of each user.

    Rows without a user, a scope or a time are left out. Activities cross two shuffles, by user and day
    and by user; every step over a user's days reads them in the same order.
    """
    keys = [*scope, "user_id"]
    pieces = day_pieces(on_scope_clock(activity, scope), keys, ("t_min", "t_max"))
    # A day's value is that of its last piece.
    ended = F.col("next_day").isNull() | (F.col("next_day") > F.col("day"))
    return (
        running_reputation(pieces, keys, model)
        .where(ended)
        .withColumnRenamed("_value", "reputation")
        .select(
            *keys,
            "day",
            (F.col("_before") + F.col("n_events")).alias("run_events"),
            (F.col("last_place") - F.col("day")).alias("day_fraction"),
            "next_day",
            "t_min",
            "t_max",
            "reputation",
        )
    )


def _idle_exponent(model: ReputationModel, idle: Column, fraction: Column) -> Column:
    if model.compounding:
        return idle * (idle + 1) / 2 + idle * (1 - fraction)
    return idle + 1 - fraction


def reputation_daily(
    events: DataFrame, model: ReputationModel, scope: Sequence[str] = SCOPE, at_least: float | None = None
) -> DataFrame:
    """One row per user and day from the first activity to the end of the scope.

    With ``at_least``, only days with that much reputation: decay is monotone, so the last such day
    is known from the value itself and the days after it are never made.
    """
    fraction = F.col("day_fraction")
    day_max = F.floor((F.col("t_max") - F.col("t_min")) / SECONDS_PER_DAY).cast("int")
    span = F.coalesce(F.col("next_day") - 1, day_max) - F.col("day")
    if at_least is not None and model.rate > 0:
        events = events.withColumn(
            "_left", F.log(F.greatest(F.col("reputation") / at_least, F.lit(1.0))) / model.rate
        )
        left = F.col("_left")
        if model.compounding:
            lead = 1.5 - fraction
            reach = F.sqrt(lead * lead + 2 * left) - lead
        else:
            reach = left - 1 + fraction
        # One day of slack for rounding; the filter below decides.
        span = F.least(span, F.greatest(F.floor(reach) + 1, F.lit(0)).cast("int"))
    idle = F.col("_idle")
    decayed = F.col("reputation") * F.exp(-model.rate * _idle_exponent(model, idle, fraction))
    days = (
        events.withColumn("_idle", F.explode(F.sequence(F.lit(0), span)))
        .withColumn("reputation", F.when(idle == 0, F.col("reputation")).otherwise(decayed))
        .withColumn("day", F.col("day") + idle)
    )
    if at_least is not None:
        days = days.where(F.col("reputation") >= at_least)
    stamp = F.timestamp_seconds(F.col("t_min") + F.col("day") * SECONDS_PER_DAY)
    return days.select(*scope, "user_id", "day", "reputation", "t_min", "t_max", F.to_date(stamp).alias("date"))


def with_month(daily: DataFrame) -> DataFrame:
    return daily.withColumn("month", F.date_format("date", "yyyy-MM"))


def sort_user_time(activity: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Activities of a user together and in order of time; no global order is needed."""
    keys = [F.col(k) for k in (*scope, "user_id")]
    return activity.repartition(*keys).sortWithinPartitions(*keys, "ts")


def daily_reputation_mean(
    daily: DataFrame, bounds: DataFrame, scope: Sequence[str] = SCOPE, group: str | None = None
) -> DataFrame:
    """Users with reputation 1 or more and their mean, for every day from the first on.

    ``daily`` need only hold days with reputation 1 or more; ``bounds`` gives ``first_day`` and
    ``day_max`` per scope (and group), so that days without such users show with 0.
    """
    keys = [*scope, *([group] if group else [])]
    grid = bounds.select(*keys, F.explode(F.sequence("first_day", "day_max")).alias("day"))
    means = (
        daily.where(F.col("reputation") >= 1)
        .groupBy(*keys, "day")
        .agg(F.count("*").alias("n_users"), F.sum("reputation").alias("_sum"))
    )
    joined = grid.join(means, [*keys, "day"], "left")
    return joined.select(
        *keys,
        "day",
        F.coalesce("n_users", F.lit(0)).alias("n_users"),
        F.coalesce(F.col("_sum") / F.col("n_users"), F.lit(0.0)).alias("mean_reputation"),
    )


def day_bounds(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First active day and last day per scope, or per scope and group."""
    day_max = F.floor((F.col("t_max") - F.col("t_min")) / SECONDS_PER_DAY).cast("int")
    return events.groupBy(*keys).agg(F.min("day").alias("first_day"), F.max(day_max).alias("day_max"))


def join_profiles(df: DataFrame, profiles: DataFrame, group: Column) -> DataFrame:
    """Attach the registration group of users that have a profile; others are dropped."""
    return df.join(profiles.select("user_id", group.alias("registration_group")), "user_id")


def weighted_core_periphery(
    core: Column, periphery: Column, n_core: Column, n_periphery: Column
) -> Column:
    """Mean of core and periphery weighted by size; nulls count as 0."""
    zero = F.lit(0.0)
    weight_core, weight_periphery = F.coalesce(n_core, zero), F.coalesce(n_periphery, zero)
    total = F.coalesce(core, zero) * weight_core + F.coalesce(periphery, zero) * weight_periphery
    return ratio(total, weight_core + weight_periphery)
