"""Reputation period by period against the run over all rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tests.test_reputation import DAY, frame, histories
from tideline.operators import reputation, reputation_periods
from tideline.operators.reputation import ReputationModel
from tideline.operators.reputation_periods import ReputationStore
from tideline.session import fresh_folder

COLUMNS = ["user_id", "day", "run_events", "day_fraction", "next_day", "t_min", "t_max", "reputation"]


def with_periods(spark, data, seconds):
    """Periods of so many seconds from the first activity on; they cut days where they are no multiple of one."""
    low = min(t for _, t in data)
    df = frame(spark, data)
    number = F.floor((F.unix_seconds("ts") - low) / seconds).cast("int")
    return df.withColumn("period", F.lpad(number.cast("string"), 5, "0"))


def agree(found, expected):
    mine, theirs = ({(r.user_id, r.day): r for r in rows} for rows in (found, expected))
    assert len(mine) == len(found) and mine.keys() == theirs.keys()
    for key, row in theirs.items():
        held = mine[key]
        assert (held.run_events, held.next_day, held.t_min, held.t_max) == (row.run_events, row.next_day, row.t_min, row.t_max), key
        assert held.day_fraction == pytest.approx(row.day_fraction, abs=1e-9)
        assert held.reputation == pytest.approx(row.reputation, rel=1e-12), key


@pytest.mark.parametrize("compounding", [False, True])
@pytest.mark.parametrize("seconds,cuts", [(7 * DAY, [2, 5, 6]), (2 * DAY + 5_000, [9, 20]), (100 * DAY, [])])
def test_periods_come_to_the_whole(spark, compounding, seconds, cuts):
    model = ReputationModel(compounding=compounding)
    data = histories(seconds + compounding, users=10)
    # A user whose run spans all periods, and one with a single activity in the first.
    start = min(t for _, t in data)
    data += [("daily", start + d * DAY + 40_000) for d in range(60)] + [("once", start)]
    df = with_periods(spark, data, seconds)
    store = ReputationStore(spark, fresh_folder(spark, "store"), model)
    after = ""
    for end in [f"{c:05d}" for c in cuts] + ["99999"]:
        store.append(df.where((F.col("period") > after) & (F.col("period") <= end)), end)
        after = end
    expected = reputation.reputation_events(df.drop("period"), model)
    agree(store.events().select(*COLUMNS).collect(), expected.select(*COLUMNS).collect())


def test_a_new_period_reads_its_rows_and_the_last_summaries(spark, tmp_path):
    model, data = ReputationModel(), histories(5, users=6)
    df = with_periods(spark, data, 20 * DAY)
    store = ReputationStore(spark, str(tmp_path / "store"), model)
    for end in ("00000", "00001"):
        store.append(df.where(F.col("period") == end), end)
    # What older runs wrote can no longer be read, and is not.
    hidden = []
    for old in [*tmp_path.glob("store/events/*/*.parquet"), *tmp_path.glob("store/carried/run=00000/*.parquet")]:
        hidden.append((old, old.read_bytes()))
        old.write_bytes(b"not a table")
    (tmp_path / "store" / "carried" / "run=00000").joinpath("_SUCCESS").touch()
    store.append(df.where(F.col("period") == "00002"), "00002")
    for old, content in hidden:
        old.write_bytes(content)
        crc = old.with_name(f".{old.name}.crc")
        assert crc.exists()
    expected = reputation.reputation_events(df.drop("period"), model)
    agree(store.events().select(*COLUMNS).collect(), expected.select(*COLUMNS).collect())


def test_runs_repeat_but_do_not_go_back(spark):
    model, data = ReputationModel(), histories(6, users=5)
    df = with_periods(spark, data, 20 * DAY)
    store = ReputationStore(spark, fresh_folder(spark, "store"), model)
    for end in ("00000", "00001", "00001"):
        store.append(df.where(F.col("period") == end), end)
    with pytest.raises(ValueError):
        store.append(df.where(F.col("period") == "00000"), "00000")
    with pytest.raises(ValueError):
        store.append(df.where(F.col("period") <= "00002"), "00002")
    # An empty period keeps everyone as they are.
    store.append(df.where("false"), "000019")
    store.append(df.where(F.col("period") == "00002"), "00002")
    expected = reputation.reputation_events(df.drop("period"), model)
    agree(store.events().select(*COLUMNS).collect(), expected.select(*COLUMNS).collect())
    assert store.runs() == ["00000", "00001", "000019", "00002"]


def test_long_histories_neither_overflow_nor_lose_their_past(spark):
    model = ReputationModel(beta=0.9)
    start = 1_000_000_000
    data = [("u", start + d * DAY + 60) for d in (*range(0, 9000, 7), *range(9000, 9040))]
    df = with_periods(spark, data, 365 * DAY)
    store = ReputationStore(spark, fresh_folder(spark, "store"), model)
    store.append(df.where(F.col("period") < "00012"), "00011")
    store.append(df.where(F.col("period") >= "00012"), "00099")
    expected = reputation.reputation_events(df.drop("period"), model)
    agree(store.events().select(*COLUMNS).collect(), expected.select(*COLUMNS).collect())
    assert all(math.isfinite(r.reputation) for r in store.events().collect())


def test_a_run_of_periods_crosses_two_shuffles(spark, monkeypatch):
    model, data = ReputationModel(), histories(8, users=6)
    df = with_periods(spark, data, 3 * DAY + 5_000)
    plans = []

    def cut(table):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return table

    monkeypatch.setattr(reputation_periods, "cut_lineage", cut)
    origins = reputation.scope_bounds(df)
    rows, left = reputation_periods.reputation_of_periods(df, origins, model)
    assert len(plans) == 1 and plans[0].count("hashpartitioning") == 2
    agree(rows.join(origins, ["platform", "community"]).select(*COLUMNS).collect(), reputation.reputation_events(df.drop("period"), model).select(*COLUMNS).collect())
    assert left.count() == df.select("user_id").distinct().count()
