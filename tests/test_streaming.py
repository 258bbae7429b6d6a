"""The stream of reputations: late rows, closed days and repeated batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Row

from tests.test_reputation import DAY, frame, histories
from tideline.operators import reputation
from tideline.operators.reputation import ReputationModel
from tideline.session import fresh_folder
from tideline.streaming import live_reputation


def run(spark, batches, model, lateness):
    """Batches of (user, second) through the stream; the newest rows and the query's progress."""
    place, written, state = (fresh_folder(spark, n) for n in ("in", "live", "state"))
    whole = frame(spark, [r for b in batches for r in b])
    for batch in batches:
        frame(spark, batch).coalesce(1).write.mode("append").parquet(place)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(place)
    rows = live_reputation.live_reputation_events(stream, reputation.scope_bounds(whole), model, lateness)
    query = live_reputation.write_live(rows, written, state, availableNow=True)
    query.awaitTermination()
    columns = ["user_id", "day", "run_events", "day_fraction", "next_day", "reputation"]
    found = live_reputation.current_events(spark, written).select(*columns).collect()
    expected = reputation.reputation_events(whole, model).select(*columns).collect()
    return found, expected, query.recentProgress, written


def agree(found, expected):
    mine, theirs = ({(r.user_id, r.day): r for r in rows} for rows in (found, expected))
    assert mine.keys() == theirs.keys() and len(mine) == len(found)
    for key, row in theirs.items():
        assert (mine[key].run_events, mine[key].next_day) == (row.run_events, row.next_day), key
        assert mine[key].day_fraction == pytest.approx(row.day_fraction, abs=1e-12)
        assert mine[key].reputation == pytest.approx(row.reputation, rel=1e-12)


@pytest.mark.parametrize("compounding", [False, True])
def test_rows_in_any_order_end_as_the_batch(spark, compounding):
    rows = histories(11, users=8, days=40)
    random.Random(5).shuffle(rows)
    batches = [rows[i::4] for i in range(4)]
    found, expected, _, _ = run(spark, batches, ReputationModel(compounding=compounding), "60 days")
    agree(found, expected)


def test_days_close_once_nothing_can_arrive(spark):
    start = 1_430_000_000
    rng = random.Random(7)
    rows = [(f"u{u}", start + d * DAY + rng.randrange(DAY)) for u in range(4) for d in range(60) if rng.random() < 0.7]
    rows += [("u0", start)]
    # Ten days a batch, and a third of the rows one batch late.
    batches = [[] for _ in range(7)]
    for user, second in rows:
        batches[(second - start) // (10 * DAY) + (second % 3 == 0)].append((user, second))
    found, expected, progress, _ = run(spark, [b for b in batches if b], ReputationModel(), "21 days")
    agree(found, expected)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    # Open days and their timers leave the state, which would else grow to all days of all users.
    assert held[-1] < 2 * len(expected) / 2


def test_a_repeated_batch_replaces_itself(spark):
    start = 1_430_000_000
    found, expected, _, written = run(spark, [[("a", start), ("a", start + DAY)], [("a", start + 10)]], ReputationModel(), "9 days")
    agree(found, expected)
    before = sorted(tuple(r) for r in live_reputation.current_events(spark, written).collect())
    last = spark.read.parquet(f"{written}/batch=1").collect()
    spark.createDataFrame(last, spark.read.parquet(f"{written}/batch=1").schema).write.mode("overwrite").parquet(f"{written}/batch=1")
    assert sorted(tuple(r) for r in live_reputation.current_events(spark, written).collect()) == before


def test_the_step_of_a_day(spark):
    model = ReputationModel()
    first = live_reputation.after_day(model, None, 0, [0.0, 0.5])
    assert first[:3] == (0, 0.5, 2)
    assert first[3] == pytest.approx(2.0 * 0.96**0.5 + 1 + 2 * (1 - 1 / 3))
    again = live_reputation.after_day(model, first, 2, [2.25])
    assert again[2] == 1 and again[3] == pytest.approx(first[3] * 0.96**1.75 + 2.0)


class Held:
    """State of one shard, outside of a stream, that counts its calls."""

    def __init__(self):
        self.value, self.timers, self.reads, self.writes = None, set(), 0, 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.reads += 1
        return self.value

    def update(self, value):
        self.writes += 1
        self.value = value

    def registerTimer(self, time):
        self.timers.add(time)

    def deleteTimer(self, time):
        self.timers.remove(time)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_batch_reads_and_writes_the_state_of_many_users_once(spark):
    held, days = Held(), live_reputation.UserDays(ReputationModel(), ["user_id"])
    days.init(held)
    one = Row("user_id", "ts", "place", "day", "due")
    rows = [one(f"u{u}", None, d + 0.5, d, (d + 1) * 1000) for u in range(50) for d in (3, 1)]
    found = list(days.handleInputRows((0,), iter(rows), held))
    assert {(r.user_id, r.day, r.next_day) for r in found} == {(f"u{u}", d, n) for u in range(50) for d, n in ((1, 3), (3, None))}
    assert (held.reads, held.writes, held.timers) == (0, 1, {2000})
    held.now, held.timers = 2500, set()
    assert list(days.handleExpiredTimer((0,), held, None)) == []
    # The first day is closed for every user, and the next timer is that of the third.
    assert (held.reads, held.writes, held.timers) == (1, 2, {4000})
    found = list(days.handleInputRows((0,), iter([one("u7", None, 2.25, 2, 3000)]), held))
    assert [(r.day, r.next_day) for r in found] == [(1, 2), (2, 3), (3, None)]
    whole = live_reputation.after_day(ReputationModel(), None, 1, [1.5])
    for day, place in ((2, 2.25), (3, 3.5)):
        whole = live_reputation.after_day(ReputationModel(), whole, day, [place])
    assert found[-1].reputation == whole[3] and found[-1].run_events == 3
    assert (held.reads, held.writes, held.timers) == (2, 3, {3000})
