"""The calendar of dated events and the labels that follow from it.

A calendar holds a handful of events and is a parameter of every job, so it enters plans as
literals: no table, no join, no broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.timeparts import month_start


@dataclass(frozen=True)
class Event:
    key: str
    day: str


@dataclass(frozen=True)
class EventCalendar:
    """Events in order of time, and the exclusive end of the observed period."""

    events: tuple[Event, ...]
    end: str
    end_key: str = "shutdown"

    @property
    def letters(self) -> list[str]:
        return [chr(ord("A") + i) for i in range(len(self.events))]

    @property
    def days(self) -> list[str]:
        return [event.day for event in self.events]

    @property
    def arrival_cohorts(self) -> list[str]:
        marks = self.letters
        between = [f"between{a}-{b}" for a, b in zip(marks, marks[1:])]
        return [f"before{marks[0]}", *between, f"after{marks[-1]}"]

    @property
    def fixed_cohorts(self) -> list[str]:
        keys = [event.key for event in self.events] + [self.end_key]
        return [f"pre_{keys[0]}"] + [f"{a}_{b}" for a, b in zip(keys, keys[1:])]

    @property
    def periods(self) -> list[str]:
        marks = self.letters + ["end"]
        return [f"{a}-{b}" for a, b in zip(marks, marks[1:])]

    def _step(self, ts: Column, names: list[str]) -> Column:
        """Name of the step ``ts`` falls on; the day of an event belongs to the later step."""
        label = F.lit(names[-1])
        for day, name in reversed(list(zip(self.days, names))):
            label = F.when(ts < F.lit(day).cast("timestamp"), F.lit(name)).otherwise(label)
        return label

    def arrival_cohort(self, first_seen: Column) -> Column:
        return self._step(first_seen, self.arrival_cohorts)

    def fixed_cohort(self, first_seen: Column) -> Column:
        """Arrival cohort by exact first activity; an unknown first activity is ``unknown``."""
        return F.when(first_seen.isNull(), "unknown").otherwise(self._step(first_seen, self.fixed_cohorts))

    def event_period(self, ts: Column) -> Column:
        """Half-open period ``[event, next event)`` by exact time; null outside all periods."""
        inside = (ts >= F.lit(self.days[0]).cast("timestamp")) & (ts < F.lit(self.end).cast("timestamp"))
        return F.when(inside, self._step(ts, ["", *self.periods]))

    def event_period_of_month(self, month: Column) -> Column:
        """As :meth:`event_period`, for a month taken as its first day."""
        return self.event_period(month_start(month))

    def as_array(self) -> Column:
        """The events as an array of structs ``(event, event_ts, next_ts)``; the last has no next."""
        upcoming = [*self.days[1:], None]
        return F.array(*[
            F.struct(
                F.lit(letter).alias("event"),
                F.lit(day).cast("timestamp").alias("event_ts"),
                F.lit(after).cast("timestamp").alias("next_ts"),
            )
            for letter, day, after in zip(self.letters, self.days, upcoming)
        ])


# The dated events of the study period.
STUDY_CALENDAR = EventCalendar(
    events=(
        Event("fph", "2015-06-10"),
        Event("pg", "2016-11-23"),
        Event("ga", "2018-09-12"),
        Event("td", "2020-06-29"),
    ),
    end="2020-12-31",
)

# The three events that decide newcomer labels (the second event is not one of them).
NEWCOMER_DAYS = ("2015-06-10", "2018-09-12", "2020-06-29")


def newcomer_days(calendar: EventCalendar) -> tuple[str, str, str]:
    """First, third and fourth event: those that start a newcomer period."""
    days = calendar.days
    return days[0], days[2], days[3]
