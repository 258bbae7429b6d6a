"""Labels of users, nodes and communities as ``when`` chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower and upper ends of the activity bins (no upper end: open).
ACTIVITY_BINS: tuple[tuple[int, int | None], ...] = ((1, 1), (2, 2), (3, 5), (6, 10), (11, 20), (21, None))

# Registration cut-offs in epoch seconds.
REGISTRATION_CUTS = (1399593600, 1433558400, 1479840000, 1521081600)

# Upper ends of the effect sizes called negligible, small and medium.
EFFECT_SIZE_CUTS = ((0.147, "negligible"), (0.33, "small"), (0.474, "medium"))


def _day(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def bin_name(low: int, high: int | None) -> str:
    if high is None:
        return f"{low}+"
    return str(low) if low == high else f"{low}-{high}"


def bin_names() -> list[str]:
    return [bin_name(low, high) for low, high in ACTIVITY_BINS]


def activity_bin(count: Column) -> Column:
    """Bin of an activity count; below the first bin or null is ``0``."""
    label = F.lit("0")
    for low, high in ACTIVITY_BINS:
        label = F.when(count >= low, F.lit(bin_name(low, high))).otherwise(label)
    return label


def period_group(first_month_ts: Column, days: Sequence[str]) -> Column:
    """Static group of a first month against the three newcomer events."""
    first, second, third = days
    return (
        F.when(first_month_ts < _day(first), "preA")
        .when(first_month_ts < _day(second), "A-B")
        .when(first_month_ts < _day(third), "B-C")
        .otherwise("C-End")
    )


def static_newcomer_label(first_month_ts: Column, days: Sequence[str]) -> Column:
    return F.when(first_month_ts < _day(days[0]), "existing").otherwise("newcomer")


def newcomer_label(first_seen: Column, month_ts: Column, days: Sequence[str]) -> Column:
    """Newcomer when first seen since the event that opened the month's period.

    Months before the first event and users never seen are ``existing``.
    """
    first, second, third = days
    opened = (
        F.when(month_ts < _day(first), F.lit(None).cast("timestamp"))
        .when(month_ts < _day(second), _day(first))
        .when(month_ts < _day(third), _day(second))
        .otherwise(_day(third))
    )
    return F.when(first_seen >= opened, "newcomer").otherwise("existing")


def rolling_tenure_label(first_seen: Column, month_ts: Column, tenure_months: int) -> Column:
    since = F.add_months(month_ts, -tenure_months).cast("timestamp")
    return F.when(first_seen >= since, "newcomer").otherwise("existing")


def registration_group(reg_epoch: Column, cuts: Sequence[int] = REGISTRATION_CUTS) -> Column:
    """Group 1 before the first cut-off, one higher from each cut-off on."""
    return sum((F.when(reg_epoch >= cut, 1).otherwise(0) for cut in cuts), F.lit(1)).cast("int")


def community_type(community: Column, controversial: Sequence[str], normal: Sequence[str]) -> Column:
    name = F.lower(community)
    return (
        F.when(name.isin(*[c.lower() for c in controversial]), "controversial")
        .when(name.isin(*[c.lower() for c in normal]), "normal")
        .otherwise("unknown")
    )


def effect_size_label(delta: Column) -> Column:
    size = F.abs(delta)
    chain = None
    for cut, name in EFFECT_SIZE_CUTS:
        chain = F.when(size < cut, name) if chain is None else chain.when(size < cut, name)
    return F.when(delta.isNull(), F.lit(None).cast("string")).otherwise(chain.otherwise("large"))


def event_cohort(first_seen: Column, event_ts: Column, next_ts: Column) -> Column:
    """``existing`` before the event, ``event_arrival`` up to the next one, else ``future_arrival``."""
    return (
        F.when(first_seen < event_ts, "existing")
        .when(next_ts.isNull() | (first_seen < next_ts), "event_arrival")
        .otherwise("future_arrival")
    )
