"""Sketches: within their bounds of exact values, merged in any order, read from what is stored."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import components, graph, neighbourhood, sketches
from tideline.session import cut_lineage


def test_neighbourhoods_of_a_large_component(spark):
    draw = random.Random(2)
    n = 4_000
    data = [("g", str(i), str(draw.randrange(i))) for i in range(1, n)] + [("g", str(draw.randrange(n)), str(draw.randrange(n))) for _ in range(n)]
    data += [("pair", "a", "b"), ("one", "a", "a"), ("two", "a", "b"), ("two", "x", "y"), ("two", "y", "z")]
    edges = spark.createDataFrame(data, "g string, source string, target string")
    pairs, nodes = graph.dedup_edges(edges, ["g"]), graph.degrees(edges, ["g"])
    found = components.connected_components(pairs, nodes, ["g"])
    exact = {r.g: r for r in components.path_metrics(pairs, found, ["g"]).collect()}
    said = {r.g: r for r in neighbourhood.sketched_path_metrics(pairs, found, ["g"]).collect()}
    # A single node has no paths.
    assert set(said) == {"g", "pair", "two"}
    for g, row in said.items():
        assert abs(row.avg_shortest_path - exact[g].avg_shortest_path) <= row.path_error + 1e-9
        assert row.least_diameter <= exact[g].diameter
        assert row.giant_component_size == exact[g].giant_component_size
    assert 0 < said["g"].path_error < 0.15 * said["g"].avg_shortest_path
    assert said["pair"].avg_shortest_path == 1.0 and said["two"].avg_shortest_path == pytest.approx(4 / 3)
    empty = edges.where("false")
    none = components.connected_components(graph.dedup_edges(empty, ["g"]), graph.degrees(empty, ["g"]), ["g"])
    assert neighbourhood.sketched_path_metrics(graph.dedup_edges(empty, ["g"]), none, ["g"]).count() == 0


def test_many_arcs_are_sent_by_many_tasks(spark):
    ring = [(0, i, (i + d) % 9) for i in range(9) for d in (1, 8)]
    arcs = spark.createDataFrame(ring, "_s long, u long, v long")
    nodes = cut_lineage(spark.createDataFrame([(0, i) for i in range(9)], "_s long, _i long"))
    few = neighbourhood.neighbourhood_sizes(arcs, nodes, 10)
    many = neighbourhood.neighbourhood_sizes(arcs, nodes, 10, task_arcs=2, few_arcs=17)
    said = [{r._d: r._pairs for r in found.collect()} for found in (few, many)]
    assert set(said[0]) == set(said[1]) and all(said[0][d] == pytest.approx(said[1][d], rel=0.05) for d in said[0])
    assert said[1][1] == pytest.approx(27, rel=0.02)
    state = cut_lineage(nodes.groupBy("_s", "_i").agg(F.hll_sketch_agg("_i", F.lit(10)).alias("sketch")))
    # By bytes alone, all of it would fit one task.
    assert neighbourhood.sent_sketches(arcs, state, 40).rdd.getNumPartitions() >= 40
    assert neighbourhood.sent_sketches(arcs, state, None).count() == neighbourhood.sent_sketches(arcs, state, 40).count() == 18


def test_small_snapshots_are_sketched_in_their_tasks(spark, monkeypatch):
    draw = random.Random(4)
    n = 1_500
    data = [("g", str(i), str(draw.randrange(i))) for i in range(1, n)] + [("g", "0", str(i)) for i in range(1, n, 9)]
    data += [("path", chr(97 + i), chr(98 + i)) for i in range(5)]
    edges = spark.createDataFrame(data, "g string, source string, target string")
    pairs, nodes = graph.dedup_edges(edges, ["g"]), graph.degrees(edges, ["g"])
    found = components.connected_components(pairs, nodes, ["g"])
    exact = {r.g: r for r in components.path_metrics(pairs, found, ["g"]).collect()}
    by_joins = {r.g: r for r in neighbourhood.sketched_path_metrics(pairs, found, ["g"], task_arcs=0).collect()}

    def refuse(*_):
        raise AssertionError("sketches were joined to the edges")

    monkeypatch.setattr(neighbourhood, "neighbourhood_sizes", refuse)
    said = {r.g: r for r in neighbourhood.sketched_path_metrics(pairs, found, ["g"]).collect()}
    assert set(said) == set(by_joins) == {"g", "path"}
    for g, row in said.items():
        assert abs(row.avg_shortest_path - exact[g].avg_shortest_path) <= row.path_error
        assert row.least_diameter <= exact[g].diameter
        assert row.path_error == pytest.approx(by_joins[g].path_error, rel=0.1)
    # Fewer nodes than registers are counted exactly.
    assert said["path"].avg_shortest_path == pytest.approx(exact["path"].avg_shortest_path, rel=1e-12)
    assert said["path"].least_diameter == exact["path"].diameter == 5


@pytest.mark.parametrize("n", [100, 1_024, 1_025, 3_000])
def test_sketches_of_a_ring(n):
    i = np.arange(n)
    sizes = neighbourhood.summed_sizes(np.append(i, i), np.append((i + 1) % n, (i - 1) % n), 10)
    assert len(sizes) <= n // 2 and len(sizes) >= 0.9 * (n // 2)
    for d in (1, 10, n // 4):
        assert sizes[d - 1] == pytest.approx(n * (2 * d + 1), rel=1e-12 if n <= 1_024 else 3 * neighbourhood.sketch_error(10))


def test_more_registers_err_less():
    assert neighbourhood.sketch_error(10) == pytest.approx(1.04 / 32)
    assert sketches.user_error(14) < sketches.user_error(12) and sketches.rank_error(800) < sketches.rank_error(200)


def test_merged_days_stay_within_their_bounds(spark):
    n = 60_000
    df = spark.range(n).select(
        F.lit("p").alias("platform"),
        F.lit("c").alias("community"),
        F.concat(F.lit("u"), (F.col("id") % 20_011).cast("string")).alias("user_id"),
        F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 97).alias("ts"),
        F.when(F.col("id") % 7 != 0, F.pow((F.col("id") * 7919 % 10_007) / 10_007, 3)).alias("score"),
        F.lit(None).cast("double").alias("nothing"),
    )
    daily = sketches.daily_sketches(df, {"score": "score", "nothing": "nothing"})
    assert daily.count() == df.select(F.to_date("ts")).distinct().count()
    weekly = sketches.merged_sketches(daily.withColumn("week", F.weekofyear("day")), ["score", "nothing"], ["platform", "community", "week"])
    by_two_ways = [
        sketches.merged_sketches(daily, ["score", "nothing"], ["platform"]),
        sketches.merged_sketches(weekly, ["score", "nothing"], ["platform"]),
    ]
    ordered = [r[0] for r in df.where("score IS NOT NULL").select("score").orderBy("score").collect()]
    for merged in by_two_ways:
        row = sketches.sketched_aggregates(merged, ["score", "nothing"], ["platform"], {"q10": 0.1, "median": 0.5, "q90": 0.9}).first()
        assert row.n_activities == n and row.nothing_median is None and row.nothing_mean is None
        assert abs(row.active_users - 20_011) <= sketches.user_error() * 20_011
        assert row.score_mean == pytest.approx(math.fsum(ordered) / len(ordered))
        for name, p in (("q10", 0.1), ("median", 0.5), ("q90", 0.9)):
            rank = sum(v <= row[f"score_{name}"] for v in ordered) / len(ordered)
            assert abs(rank - p) <= 2 * sketches.rank_error()


def test_few_values_are_exact(spark):
    df = spark.createDataFrame([("p", "c", f"u{i}", float(i)) for i in range(21)], "platform string, community string, user_id string, v double")
    daily = sketches.daily_sketches(df.withColumn("ts", F.timestamp_seconds(F.lit(0))), {"v": "v"})
    row = sketches.sketched_aggregates(sketches.merged_sketches(daily, ["v"], []), ["v"], [], {"median": 0.5}).first()
    assert (row.active_users, row.v_median, row.v_mean) == (21, 10.0, 10.0)
