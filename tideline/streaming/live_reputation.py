"""Reputation kept up to date while activities arrive, in any order within an allowed lateness.

Every user has the open days with their activities, which late rows may still change, and a summary of
all days before them. A day closes once the watermark has passed its end; nothing can then arrive for it,
and its activities are folded into the summary. State therefore holds the activities of the allowed
lateness and a constant per user.

Users are dealt to shards by a hash of their key, and a shard is a key of the stream: a batch reads and
writes the state of a shard once and sets one event-time timer for it, whatever the number of its users.

Rows come out at once and again when later ones change them; the newest row of a user's day counts.
Rows of a batch are written below its number, so a repeated batch replaces itself.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tideline.functions.timeparts import SECONDS_PER_DAY, unix_micros_seconds
from tideline.operators.reputation import SCOPE, ReputationModel
from tideline.session import sized_side

#: Day, place of its last activity, events of its run so far, reputation after it.
Summary = tuple[int, float, int, float]

#: Parts of the users whose state is read and written together.
SHARDS = 1 << 12

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def after_day(model: ReputationModel, before: Summary | None, day: int, places: Sequence[float]) -> Summary:
    """The summary of a user after one more active day, whose activities stand in order of time."""
    last = places[-1]
    events, value = 0, 0.0
    if before is not None:
        idle = day - before[0] - 1
        exponent = last - before[1]
        if model.compounding:
            exponent += idle * (idle + 1) / 2 + idle * (1 - (before[1] - before[0]))
        value = before[3] * math.exp(-model.rate * exponent)
        events = before[2] if idle == 0 else 0
    for place in places:
        events += 1
        gain = model.base + model.base * model.alpha * (1 - 1 / (events + 1))
        value += gain * math.exp(-model.rate * (last - place))
    return day, last, events, value


class UserDays(StatefulProcessor):
    """Open days and the summary of closed ones of the users of a shard.

    A user is held as ``[summary, {day: (due, places)}]`` under the values of its key, all users of a shard
    in one state value beside the time of the shard's timer.
    """

    def __init__(self, model: ReputationModel, keys: Sequence[str]):
        self.model = model
        self.width = len(keys)
        self.row = Row(*keys, "day", "run_events", "day_fraction", "next_day", "reputation")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "users binary, timer bigint")

    def _read(self) -> tuple[dict, int | None]:
        if not self.held.exists():
            return {}, None
        users, timer = self.held.get()
        return pickle.loads(bytes(users)), timer

    def _write(self, users: dict, timer: int | None) -> None:
        """Keep the users, and a timer at the first end of an open day; ``timer`` is the one that is set."""
        first = min((due for _, days in users.values() for due, _ in days.values()), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.held.update((pickle.dumps(users), first))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh: dict[tuple, dict[int, tuple[int, list[float]]]] = {}
        for r in rows:
            days = fresh.setdefault(tuple(r[: self.width]), {})
            days.setdefault(r["day"], (r["due"], []))[1].append(r["place"])
        users, timer = self._read()
        for user, changed in fresh.items():
            yield from self._changed(users, user, changed)
        self._write(users, timer)

    def _changed(self, users: dict, user: tuple, fresh: dict[int, tuple[int, list[float]]]) -> Iterator[Row]:
        """Rows of a user from the first changed day on, whose activities are added to the open days."""
        summary, days = users.setdefault(user, [None, {}])
        for day, (due, places) in fresh.items():
            held = days[day][1] if day in days else []
            days[day] = (due, sorted(held + places))
        first, order = min(fresh), sorted(days)
        for day, following in zip(order, [*order[1:], None]):
            if summary is not None and day == first:
                # The day before the first change has a new next day.
                yield self._row(user, summary, day)
            summary = after_day(self.model, summary, day, days[day][1])
            if day >= first:
                yield self._row(user, summary, following)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        users, _ = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        for held in users.values():
            days = held[1]
            for day in sorted(d for d, (due, _) in days.items() if due <= now):
                held[0] = after_day(self.model, held[0], day, days.pop(day)[1])
        # The timer that led here is gone.
        self._write(users, None)
        return iter(())

    def close(self) -> None:
        pass

    def _row(self, key, summary: Summary, following: int | None) -> Row:
        day, place, events, value = summary
        return self.row(*key, day, events, place - day, following, value)


def _row_schema(activity: DataFrame, scope: Sequence[str]) -> str:
    keys = ", ".join(f"{k} {activity.schema[k].dataType.simpleString()}" for k in (*scope, "user_id"))
    return f"{keys}, day int, run_events bigint, day_fraction double, next_day int, reputation double"


def live_reputation_events(
    activity: DataFrame,
    origins: DataFrame,
    model: ReputationModel,
    lateness: str,
    scope: Sequence[str] = SCOPE,
    shards: int = SHARDS,
) -> DataFrame:
    """Reputation after the last activity of each active day, as a stream of new and changed rows.

    ``origins`` gives ``t_min`` per scope, from which days are counted. Rows of scopes without one and
    rows later than ``lateness`` behind the newest are left out. In the end the newest row of every
    user and day is that of ``reputation_events`` over all activities. A batch writes whole shards, so
    ``shards`` should grow with the users; it must not change while a stream goes on.
    """
    spark = activity.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keys = [*scope, "user_id"]
    place = (unix_micros_seconds(F.col("ts")) - F.col("t_min")) / SECONDS_PER_DAY
    end_of_day = F.col("t_min") + (F.col("day") + 1) * SECONDS_PER_DAY
    clocked = (
        activity.select(*keys, "ts")
        .withWatermark("ts", lateness)
        .join(sized_side(origins.select(*scope, "t_min")), list(scope))
        .withColumn("place", place)
        .withColumn("day", F.floor("place").cast("int"))
        .select(*keys, "ts", "place", "day", F.ceil(end_of_day * 1000).cast("bigint").alias("due"))
        .withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)))
    )
    return clocked.groupBy("shard").transformWithState(
        UserDays(model, keys), outputStructType=_row_schema(activity, scope), outputMode="Update", timeMode="EventTime"
    )


def write_live(rows: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing changed rows, each batch below its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current_events(spark: SparkSession, folder: str, scope: Sequence[str] = SCOPE) -> DataFrame:
    """The newest row of every user and day that ``write_live`` has written."""
    written = spark.read.parquet(folder)
    keys = [*scope, "user_id", "day"]
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*keys, "_r.*")
