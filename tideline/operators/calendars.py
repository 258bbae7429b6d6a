"""Event calendars as tables: each community has its own events, as many as it likes.

``functions/calendar.py`` holds one short calendar as literals of a plan. Here a calendar is a table of
``event`` and ``day`` per key, and times find their place in it by a join on bins: an interval stands in
every bin of time that it touches, a time in one, so each pair meets once and the join is on equality.
The day of an event belongs to the later step, as everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.timeparts import SECONDS_PER_DAY
from tideline.session import cut_lineage

#: An interval stands in so many bins at most, and one more.
MOST_BINS = 64


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    ts: str,
    how: str = "inner",
    most_bins: int = MOST_BINS,
    taken: Sequence[str] | None = None,
) -> DataFrame:
    """Points with the intervals ``[start, end)`` of their key that hold them; every pair once.

    Intervals may overlap and have gaps; empty ones hold nothing. Bins are as wide as the longest
    interval over ``most_bins``, a day at least. The intervals' columns ``taken`` come along, by default
    all but the keys. ``how`` is ``inner``, or ``left`` for points that no interval holds.
    """
    keys = list(keys)
    held = cut_lineage(intervals.withColumns({"_from": _micros(F.col("start")), "_to": _micros(F.col("end"))}).where("_from < _to"))
    # One number of the calendar, whatever the points are.
    longest = held.agg(F.max(F.col("_to") - F.col("_from"))).first()[0] or 1
    width = max(SECONDS_PER_DAY * 1_000_000, -(-longest // most_bins))
    bins = held.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width)))
    )
    at = _micros(F.col(ts))
    placed = points.withColumns({"_at": at, "_bin": F.floor(at / width)})
    on = [placed[k] == bins[k] for k in (*keys, "_bin")]
    inside = (placed["_at"] >= bins["_from"]) & (placed["_at"] < bins["_to"])
    taken = [c for c in intervals.columns if c not in keys] if taken is None else taken
    columns = [placed[c] for c in points.columns] + [bins[c] for c in taken]
    return placed.join(bins, [*on, inside], how).select(*columns)


def calendar_steps(calendar: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stretch from each event to the next of its key: ``event, next_event, start, end``, the last without end.

    Of events on one day the last in order of names starts the stretch.
    """
    by_day = Window.partitionBy(*keys).orderBy("start", "event")
    dated = calendar.select(*keys, "event", F.col("day").cast("timestamp").alias("start"))
    return dated.select(
        "*", F.lead("event").over(by_day).alias("next_event"), F.lead("start").over(by_day).alias("end")
    )


def with_calendar_step(points: DataFrame, calendar: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Points with ``event`` (the last at or before them) and ``next_event``.

    Before all events ``event`` is null, after all ``next_event`` is; both are null without a calendar
    for the key or without a time.
    """
    keys = list(keys)
    steps = cut_lineage(calendar_steps(calendar, keys))
    # One row per key with the open stretches at both ends.
    ends = steps.groupBy(*keys).agg(
        F.min("start").alias("_first"),
        F.min_by("event", F.struct("start", "event")).alias("_first_event"),
        F.max("start").alias("_last"),
        F.max_by("event", F.struct("start", "event")).alias("_last_event"),
    )
    inner = steps.where(F.col("end").isNotNull())
    between = interval_join(points, inner, keys, ts, "left", taken=["event", "next_event"])
    joined = between.join(ends, keys, "left")
    after, before = F.col(ts) >= F.col("_last"), F.col(ts) < F.col("_first")
    return joined.select(
        *[F.col(c) for c in points.columns],
        F.when(after, F.col("_last_event")).otherwise(F.col("event")).alias("event"),
        F.when(before, F.col("_first_event")).otherwise(F.col("next_event")).alias("next_event"),
    )


def arrival_cohort_name(event: Column, next_event: Column) -> Column:
    """``before...``, ``between...-...`` or ``after...``; null without both."""
    return (
        F.when(event.isNull(), F.concat(F.lit("before"), next_event))
        .when(next_event.isNull(), F.concat(F.lit("after"), event))
        .otherwise(F.concat(F.lit("between"), event, F.lit("-"), next_event))
    )


def fixed_cohort_name(event: Column, next_event: Column) -> Column:
    """``pre_...`` or the names of both events, the last of a calendar being its end; ``unknown`` without any."""
    return (
        F.when(event.isNull() & next_event.isNull(), "unknown")
        .when(event.isNull(), F.concat(F.lit("pre_"), next_event))
        .otherwise(F.concat_ws("_", event, next_event))
    )


def event_period_name(event: Column, next_event: Column) -> Column:
    """The half-open period between two events; null before the first and from the last, the end, on."""
    return F.when(event.isNotNull() & next_event.isNotNull(), F.concat(event, F.lit("-"), next_event))


def event_cohorts(first_seen: DataFrame, calendar: DataFrame, keys: Sequence[str], ts: str = "first_seen") -> DataFrame:
    """Every user and event of their key: ``existing`` before it, ``event_arrival`` up to the next one.

    Users who come later are left out. A user exists for all events to come, so there are that many rows.
    """
    steps = calendar_steps(calendar, keys).select(*keys, "event", F.col("start").alias("event_ts"), F.col("end").alias("next_ts"))
    met = first_seen.join(steps, list(keys)).where(F.col("next_ts").isNull() | (F.col(ts) < F.col("next_ts")))
    group = F.when(F.col(ts) < F.col("event_ts"), "existing").otherwise("event_arrival")
    return met.select(*[F.col(c) for c in first_seen.columns], "event", group.alias("cohort_group"))
