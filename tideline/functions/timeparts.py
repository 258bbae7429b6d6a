"""Epoch numbers, months and weeks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: epoch numbers above this are milliseconds.
MILLISECOND_FLOOR = 100_000_000_000

SECONDS_PER_DAY = 86_400
SECONDS_PER_WEEK = 7 * SECONDS_PER_DAY


def epoch_seconds(value: Column) -> Column:
    """Epoch seconds from seconds or milliseconds; values that are no number give null."""
    number = value.try_cast("double")
    return F.when(number > MILLISECOND_FLOOR, number / 1000).otherwise(number)


def epoch_to_ts(value: Column) -> Column:
    return F.timestamp_seconds(epoch_seconds(value))


def unix_micros_seconds(ts: Column) -> Column:
    """Seconds since the epoch with the fraction kept."""
    return F.unix_micros(ts) / F.lit(1_000_000.0)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_index(month: Column) -> Column:
    """``year * 12 + month`` of a ``yyyy-MM`` string, so that months can be subtracted."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")


def month_from_index(index: Column) -> Column:
    year = F.floor((index - 1) / 12).cast("int")
    return F.format_string("%04d-%02d", year, (index - year * 12).cast("int"))


def month_start(month: Column) -> Column:
    return F.to_timestamp(F.concat(month, F.lit("-01")), "yyyy-MM-dd")


def month_distance(start: Column, end: Column) -> Column:
    """Signed number of months from ``start`` to ``end``."""
    return month_index(end) - month_index(start)


def absolute_month_distance(start: Column, end: Column) -> Column:
    return F.abs(month_distance(start, end))


def in_month_range(month: Column, first: str | None, last: str | None) -> Column:
    keep = F.lit(True)
    if first is not None:
        keep = keep & (month >= first)
    if last is not None:
        keep = keep & (month <= last)
    return keep


def relative_week(ts: Column, event: Column) -> Column:
    """Whole weeks since the event, negative before it."""
    return F.floor((F.unix_micros(ts) - F.unix_micros(event)) / (SECONDS_PER_WEEK * 1_000_000)).cast("int")


def day_offset_to_date(start_epoch: Column, day: Column) -> Column:
    return F.to_date(F.timestamp_seconds(start_epoch + day * SECONDS_PER_DAY))
