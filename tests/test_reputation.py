from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import reputation
from tideline.operators.reputation import ReputationModel

DAY = 86_400


def simulate(seconds, t_min, t_max, model):
    """Day by day and activity by activity, as the model is told."""
    day_max = math.floor((t_max - t_min) / DAY)
    values, last, runs, current = {}, None, 0, 0.0
    for t in sorted(seconds):
        day = math.floor((t - t_min) / DAY)
        if last is None:
            runs = 1
            current = model.base + model.base * model.alpha * (1 - 1 / (runs + 1))
        else:
            last_day = math.floor((last - t_min) / DAY)
            carried = current
            for idle in range(last_day + 1, day):
                span = (t_min + (idle + 1) * DAY - last) / DAY
                carried = values[idle] = (carried if model.compounding else current) * model.beta**span
                runs = 0
            runs += 1
            gain = model.base + model.base * model.alpha * (1 - 1 / (runs + 1))
            current = gain + carried_or(current, carried, model) * model.beta ** ((t - last) / DAY)
        values[day] = current
        last = t
    carried = current
    for idle in range(math.floor((last - t_min) / DAY) + 1, day_max + 1):
        span = (t_min + (idle + 1) * DAY - last) / DAY
        carried = values[idle] = (carried if model.compounding else current) * model.beta**span
    return values


def carried_or(current, carried, model):
    return carried if model.compounding else current


def histories(seed, users=25, days=60):
    rng = random.Random(seed)
    start = 1_430_000_000
    out = []
    for u in range(users):
        n = rng.choice([1, 2, 5, 30])
        out += [(f"u{u}", start + rng.randrange(days * DAY)) for _ in range(n)]
    # One user holds more than a third of all rows, and several activities share a second.
    out += [("hot", start + rng.randrange(days * DAY)) for _ in range(len(out))] + [("hot", start + 5)] * 3
    return out


def frame(spark, data):
    df = spark.createDataFrame(data, "user_id string, s long")
    return df.select(F.lit("p").alias("platform"), F.lit("c").alias("community"), "user_id", F.timestamp_seconds("s").alias("ts"))


@pytest.mark.parametrize("compounding", [False, True])
@pytest.mark.parametrize("beta", [0.96, 0.999])
def test_daily_values_match_the_step_by_step_model(spark, beta, compounding):
    model = ReputationModel(beta=beta, compounding=compounding)
    data = histories(int(beta * 1000) + compounding)
    events = reputation.reputation_events(frame(spark, data), model)
    found = {(r["user_id"], r["day"]): r["reputation"] for r in reputation.reputation_daily(events, model).collect()}
    low, high = min(t for _, t in data), max(t for _, t in data)
    expected = {}
    for user in {u for u, _ in data}:
        for day, value in simulate([t for u, t in data if u == user], low, high, model).items():
            expected[user, day] = value
    assert found.keys() == expected.keys()
    for key, value in expected.items():
        assert found[key] == pytest.approx(value, rel=1e-9, abs=1e-200)


@pytest.mark.parametrize("compounding", [False, True])
def test_long_histories_neither_overflow_nor_lose_their_past(spark, compounding):
    """Exponents reach far beyond the range of doubles."""
    model = ReputationModel(beta=0.9, compounding=compounding)
    start = 1_000_000_000
    data = [("u", start + d * DAY + 60) for d in (*range(0, 9000, 7), *range(9000, 9040))]
    events = reputation.reputation_events(frame(spark, data), model).collect()
    expected = simulate([t for _, t in data], min(t for _, t in data), max(t for _, t in data), model)
    for r in events:
        assert r["reputation"] == pytest.approx(expected[r["day"]], rel=1e-9)


@pytest.mark.parametrize("compounding", [False, True])
def test_days_with_enough_reputation_are_found_without_the_rest(spark, compounding):
    model = ReputationModel(compounding=compounding)
    events = reputation.reputation_events(frame(spark, histories(3)), model)
    whole = reputation.reputation_daily(events, model).where("reputation >= 1").select("user_id", "day")
    limited = reputation.reputation_daily(events, model, at_least=1.0).select("user_id", "day")
    assert whole.exceptAll(limited).count() == 0 and limited.exceptAll(whole).count() == 0


def test_first_activity_and_runs(spark):
    start = 1_430_000_000
    data = [("a", start), ("a", start + 10), ("a", start + DAY), ("a", start + 3 * DAY)]
    clocked = reputation.on_scope_clock(frame(spark, data))
    runs = sorted((r["first_day"], r["last_day"], r["n_events"]) for r in reputation.activity_runs(clocked).collect())
    assert runs == [(0, 1, 3), (3, 3, 1)]
    first = reputation.reputation_events(frame(spark, [("a", start)]), ReputationModel()).first()
    assert first["reputation"] == pytest.approx(2.0)


@pytest.mark.parametrize("compounding", [False, True])
def test_days_of_several_pieces_go_on_from_piece_to_piece(spark, monkeypatch, compounding):
    # Activities at one second stand in different pieces, and days are next to each other and far apart.
    start, model = 1_430_000_000, ReputationModel(compounding=compounding)
    data = [("a", start + d * DAY + s) for d in (0, 1, 5, 6) for s in (10, 10, 10, 500, 7_000, 80_000, 80_000)] + [("b", start)]
    whole = sorted(map(tuple, reputation.reputation_events(frame(spark, data), model).collect()))
    monkeypatch.setattr(reputation, "PIECE_EVENTS", 2)
    pieces = sorted(map(tuple, reputation.reputation_events(frame(spark, data), model).collect()))
    assert len(pieces) == 5
    for mine, theirs in zip(pieces, whole):
        assert mine[:-1] == theirs[:-1]
        assert mine[-1] == pytest.approx(theirs[-1], rel=1e-12)


def test_events_cross_two_shuffles(spark):
    events = reputation.reputation_events(frame(spark, histories(3, users=3)), ReputationModel())
    plan = events._jdf.queryExecution().sparkPlan()
    prepared = spark._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(spark._jsparkSession, plan)
    assert prepared.toString().count("Exchange hashpartitioning") == 2
