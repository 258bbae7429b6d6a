from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tideline.operators import components, graph, hubs
from tideline.plans.checks import graph_checks
from tideline.plans.network import network_snapshot

GRAPHS = {
    "triangle": [("a", "b"), ("b", "c"), ("c", "a")],
    "star": [("s", "a"), ("s", "b"), ("s", "c"), ("s", "d")],
    "path": [("a", "b"), ("b", "c"), ("c", "d")],
    "two": [("a", "b"), ("b", "c"), ("x", "y")],
    "loop": [("a", "a"), ("a", "b")],
    "repeated": [("a", "b"), ("b", "a"), ("a", "b")],
}


@pytest.fixture(scope="module")
def edges(spark):
    data = [(name, a, b) for name, pairs in GRAPHS.items() for a, b in pairs]
    return spark.createDataFrame(data, "g string, source string, target string")


@pytest.fixture(scope="module")
def snapshot(edges):
    return {r["g"]: r for r in network_snapshot(edges, ["g"]).collect()}


def test_sizes(snapshot):
    sizes = {g: (r["n_nodes"], r["n_edges"]) for g, r in snapshot.items()}
    assert sizes == {"triangle": (3, 3), "star": (5, 4), "path": (4, 3), "two": (5, 3), "loop": (2, 2), "repeated": (2, 1)}


def test_clustering_and_assortativity(snapshot):
    assert snapshot["triangle"]["mean_clustering"] == 1.0
    assert snapshot["triangle"]["degree_assortativity"] is None
    assert snapshot["star"]["mean_clustering"] == 0.0
    assert snapshot["star"]["degree_assortativity"] == pytest.approx(-1.0)


def test_paths(snapshot):
    assert snapshot["path"]["avg_shortest_path"] == pytest.approx(10 / 6)
    assert snapshot["path"]["diameter"] == 3
    assert snapshot["star"]["avg_shortest_path"] == pytest.approx((4 * 1 + 6 * 2) / 10)
    assert snapshot["repeated"]["diameter"] == 1


def test_components_and_loops(snapshot, edges):
    assert snapshot["two"]["giant_component_size"] == 3
    assert snapshot["two"]["giant_component_fraction"] == pytest.approx(0.6)
    degrees = {(r["g"], r["node"]): r["degree"] for r in graph.degrees(edges, ["g"]).collect()}
    assert degrees["loop", "a"] == 3 and degrees["loop", "b"] == 1
    assert degrees["repeated", "a"] == 1


def test_paths_are_null_above_the_limit(edges):
    pairs, nodes = graph.dedup_edges(edges, ["g"]), graph.degrees(edges, ["g"])
    found = components.connected_components(pairs, nodes, ["g"])


def test_long_chain_and_wide_words(spark):
    """A chain settles in few rounds, and more than 64 sources need several words."""
    n = 150
    chain = spark.createDataFrame([("c", f"{i:04d}", f"{i + 1:04d}") for i in range(n - 1)], "g string, source string, target string")
    pairs, nodes = graph.dedup_edges(chain, ["g"]), graph.degrees(chain, ["g"])
    for most in (components.TASK_ARCS, 0):
        found = components.connected_components(pairs, nodes, ["g"], most)
        assert {r["component"] for r in found.collect()} == {"0000"} and found.count() == n
    star = spark.createDataFrame([("s", "hub", f"{i:04d}") for i in range(n)], "g string, source string, target string")
    pairs, nodes = graph.dedup_edges(star, ["g"]), graph.degrees(star, ["g"])
    found = components.connected_components(pairs, nodes, ["g"])
    # In one task, in a task per word, by joins over all words of sources, and by joins word by word.
    metrics = components.path_metrics(pairs, found, ["g"]).first()
    assert metrics == components.path_metrics(pairs, found, ["g"], task_work=1).first()
    assert metrics == components.path_metrics(pairs, found, ["g"], task_arcs=0).first()
    assert metrics == components.path_metrics(pairs, found, ["g"], task_arcs=0, most_rows=1).first()
    assert metrics["diameter"] == 2
    assert metrics["avg_shortest_path"] == pytest.approx((2 * n + 2 * n * (n - 1)) / ((n + 1) * n))


@pytest.mark.parametrize("most_rows,passes", [(1 << 28, 1), (6_200 * 40, 3)])
def test_paths_of_more_than_five_thousand_nodes(spark, monkeypatch, most_rows, passes):
    """A hub with spokes that have leaves, whose distances are known; a pass writes once per distance."""
    spokes, leaves = 80, 75
    data = [("g", "hub", f"s{i}") for i in range(spokes)] + [
        ("g", f"s{i}", f"l{i}-{j}") for i in range(spokes) for j in range(leaves)
    ]
    wide = spark.createDataFrame(data, "g string, source string, target string")
    pairs, nodes = graph.dedup_edges(wide, ["g"]), graph.degrees(wide, ["g"])
    found = components.connected_components(pairs, nodes, ["g"])
    steps = []
    fresh = components.fresh_folder
    monkeypatch.setattr(components, "fresh_folder", lambda s, stem: steps.append(stem) or fresh(s, stem))
    row = components.path_metrics(pairs, found, ["g"], task_arcs=0, most_rows=most_rows).first()
    assert row == components.path_metrics(pairs, found, ["g"], task_work=1 << 24).first()
    n = 1 + spokes + spokes * leaves
    everyone = spokes * leaves
    total = 2 * (
        spokes + 2 * everyone + everyone + 3 * everyone * (spokes - 1)
        + 2 * spokes * (spokes - 1) // 2 + 2 * spokes * leaves * (leaves - 1) // 2
        + 4 * everyone * (everyone - leaves) // 2
    )
    assert row["giant_component_size"] == n > 5_000 and row["diameter"] == 4
    assert row["avg_shortest_path"] == pytest.approx(total / (n * (n - 1)), rel=1e-12)
    assert steps.count("paths") == 4 * passes


def test_distances_in_a_task_match_a_plain_search():
    import random
    from collections import Counter, deque

    import numpy as np

    draw = random.Random(3)
    n = 150
    links = {(i, draw.randrange(i)) for i in range(1, n)} | {(draw.randrange(n), draw.randrange(n)) for _ in range(30)}
    arcs = sorted({(a, b) for x, y in links if x != y for a, b in ((x, y), (y, x))})
    following = {}
    for a, b in arcs:
        following.setdefault(a, []).append(b)
    expected = Counter()
    for source in range(20, 140):
        away, queue = {source: 0}, deque([source])
        while queue:
            at = queue.popleft()
            for b in following[at]:
                if b not in away:
                    away[b] = away[at] + 1
                    queue.append(b)
        expected.update(d for d in away.values() if d)
    u, v = (np.array(x) for x in zip(*arcs))
    for words in (1, len(arcs), 1 << 20):
        found = components.distance_counts(u, v, 20, 120, words)
        assert dict(enumerate(found, 1)) == dict(expected)


def test_components_in_tasks_and_by_rounds(spark):
    import random

    draw = random.Random(9)
    data = [(g, f"n{draw.randrange(90):02d}", f"n{draw.randrange(90):02d}") for g in "abc" for _ in range(20 * (ord(g) - 96))]
    links = spark.createDataFrame(data, "g string, source string, target string")
    pairs, nodes = graph.dedup_edges(links, ["g"]), graph.degrees(links, ["g"])
    found = [rows(components.connected_components(pairs, nodes, ["g"], most)) for most in (components.TASK_ARCS, 60, 0)]
    assert found[0] == found[1] == found[2] and len(found[0]) == nodes.count()


def test_empty_snapshots_give_no_rows(spark):
    empty = spark.createDataFrame([], "g string, source string, target string")
    assert graph.degrees(empty, ["g"]).count() == 0
    assert network_snapshot(empty, ["g"]).count() == 0


def test_hub_quota_breaks_ties_by_name(spark):
    nodes = spark.createDataFrame([("g", f"n{i}", d) for i, d in enumerate([5, 1, 1, 1, 1, 1, 1, 1, 1, 1])], "g string, node string, degree long")
    found = rows(hubs.top_fraction_hubs(nodes, ["g"], [0.1, 0.3]), "hub_fraction", "node")
    assert found == [(0.1, "n0"), (0.3, "n0"), (0.3, "n1"), (0.3, "n2")]


def test_mixing_counts_self_loops_as_internal(spark):
    edges = spark.createDataFrame([("g", "a", "a"), ("g", "a", "b"), ("g", "b", "c"), ("g", "c", "z")], "g string, source string, target string")
    labels = spark.createDataFrame([("a", "newcomer"), ("b", "existing"), ("c", "existing")], "node string, label string")
    pairs, nodes = graph.dedup_edges(edges, ["g"]), graph.degrees(edges, ["g"])
    row = graph.partition_metrics(pairs, nodes, labels, ["g"], ["node"]).first()
    # The edge to the unlabelled z takes no part: one external edge, two internal ones.
    assert row["ei_index"] == pytest.approx(-1 / 3)
    assert (row["n_newcomers"], row["n_existing"]) == (1, 2)
    assert row["modularity"] == pytest.approx(2 / 3 - (3 / 6) ** 2 - (3 / 6) ** 2)


def test_gini_of_equal_and_empty(spark):
    histogram = spark.createDataFrame([("equal", 2, 5), ("zero", 0, 4), ("two", 0, 1), ("two", 1, 1)], "g string, degree long, n long")
    found = {r["g"]: r["gini"] for r in graph.gini(histogram, ["g"]).collect()}
    assert found["equal"] == pytest.approx(0.0) and found["zero"] is None and found["two"] == pytest.approx(0.5)


@pytest.mark.parametrize("shape", ["path", "star", "even ring", "twins", "tree", "random"])
def test_distances_follow_from_joined_leaves_and_twins(shape):
    rng = np.random.default_rng(3)
    for n in (2, 3, 4, 9, 70, 150):
        i = np.arange(1, n)
        ends = {
            "path": (i, i - 1),
            "star": (i, 0 * i),
            "even ring": (np.arange(n), (np.arange(n) + 1) % n),
            "twins": (np.repeat(i, 2), np.tile([0, 1], n - 1)),
            "tree": (i, rng.integers(0, i)),
            "random": (np.append(i, rng.integers(0, n, n // 3)), np.append(rng.integers(0, i), rng.integers(0, n, n // 3))),
        }[shape]
        pairs = np.unique(np.sort(np.stack(ends, 1), axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        u, v = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        counts = components.distance_counts(u, v, 0, n, 1 << 20)
        graph_ = components.Reduced(u, v)
        assert graph_.weight.sum() == n
        total = graph_.inside + 2 * (graph_.depths * (n - graph_.weight)).sum()
        far, left = graph_.far, len(graph_.weight)
        for first in range(0, left if left > 1 else 0, 70):
            more, reach = components.weighted_distances(
                graph_.u, graph_.v, graph_.weight, graph_.height, first, min(70, left - first), 1
            )
            total, far = total + more, max(far, reach)
        assert (total, far) == (sum(d * c for d, c in enumerate(counts, 1)), len(counts))
        if shape in ("path", "star", "tree"):
            assert left <= 2


def test_pairs_meet_hashed_nodes_once_for_both_metrics(spark, edges):
    pairs, nodes = graph.dedup_edges(edges, ["g"]), graph.degrees(edges, ["g"])
    label = F.when(F.col("node").isin("a", "s", "x"), "newcomer").otherwise("existing")
    labelled = nodes.withColumn("label", label)
    plan = graph.with_end_values(pairs, labelled, ["g"], "degree", "label")._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    ends = graph.edge_ends(pairs, labelled, ["g"])
    assert ends.count() == pairs.count() and ends.where("loop").count() == 1
    mixed, like = graph.ei_index(pairs, labelled, ["g"], ends=ends), graph.degree_assortativity(pairs, nodes, ["g"], ends=ends)
    assert rows(mixed) == rows(graph.ei_index(pairs, labelled, ["g"]))
    assert rows(like) == rows(graph.degree_assortativity(pairs, nodes, ["g"]))


def test_first_months_need_no_sort(spark):
    seen = [("c", "1998-12", "u"), ("c", "1999-01", "u"), ("c", "2001-12", "v"), ("c", None, "v"), ("c", None, "w")]
    nodes = spark.createDataFrame(seen, "community string, month string, node string")
    first = graph_checks.node_first_month(spark, "", nodes)
    assert rows(first) == [("c", "u", "1998-12"), ("c", "v", "2001-12"), ("c", "w", None)]
    assert "SortAggregate" not in first._jdf.queryExecution().toString()


def test_weighted_distances_over_hubs_match_a_plain_search():
    rng = np.random.default_rng(5)
    n = 400
    # Two nodes with some hundred arcs, a chain, and draws between the rest.
    ends = np.stack([np.append(np.arange(1, n), rng.integers(0, n, 60)), np.append(rng.integers(0, 2, n - 1), rng.integers(0, n, 60))], 1)
    ends = np.concatenate([ends, np.stack([np.arange(n, n + 40), np.append(5, np.arange(n, n + 39))], 1)])
    pairs = np.unique(np.sort(ends[ends[:, 0] != ends[:, 1]], axis=1), axis=0)
    u, v = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    n += 40
    weight, height = np.sort(rng.integers(1, 10, n)), rng.integers(0, 4, n)
    away = np.full((n, n), -1)
    for source in range(n):
        away[source, source], at = 0, [source]
        while at:
            at = [b for a in at for b in v[u == a] if away[source, b] < 0 and not away[source].__setitem__(b, away[source, a] + 1)]
    first, count = 30, 300
    own = away[first : first + count]
    total = int((own * weight[first : first + count, None] * weight).sum())
    far = int((own + height[first : first + count, None] + height)[own > 0].max())
    assert len(components.Neighbours(u, v).slots) == components.SLOT_ARCS
    for words in (1, 1 << 11, 1 << 22):
        assert components.weighted_distances(u, v, weight, height, first, count, words) == (total, far)


def test_steps_that_reach_few_nodes_do_not_pass_over_all(monkeypatch):
    """Along a chain every step finds few nodes, so none of them may cost as much as the whole graph."""

    def refuse(*_):
        raise AssertionError("a step went over all nodes")

    monkeypatch.setattr(components.Neighbours, "all_ored", refuse)
    n = 2_000
    i = np.arange(n - 1)
    found = components.distance_counts(np.append(i, i + 1), np.append(i + 1, i), 0, 64, 1 << 22)
    assert len(found) == n - 1 and found[0] == 127 and found[-1] == 1


def test_small_snapshots_are_numbered_in_their_tasks(spark, edges, snapshot, monkeypatch):
    """Names of pairs and nodes are not joined for snapshots that a task can hold."""

    def refuse(*_):
        raise AssertionError("names were joined")

    pairs, nodes = graph.dedup_edges(edges, ["g"]), graph.degrees(edges, ["g"])
    found = components.connected_components(pairs, nodes, ["g"])
    expected = rows(components.path_metrics(pairs, found, ["g"], task_arcs=0))
    monkeypatch.setattr(components, "numbered_graph", refuse)
    assert rows(components.path_metrics(pairs, found, ["g"])) == expected
    # Pairs that leave a component in parts are an error in both.
    apart = found.withColumn("component", F.lit("a"))
    with pytest.raises(Exception, match="not connected by the given pairs"):
        components.path_metrics(pairs.where("g = 'two'"), apart.where("g = 'two'"), ["g"]).collect()


def test_degrees_meet_the_pairs_once_for_a_snapshot(spark, edges, snapshot, monkeypatch):
    calls = []
    joined = graph.with_end_values
    monkeypatch.setattr(graph, "with_end_values", lambda *a: calls.append(a) or joined(*a))
    again = {r["g"]: r for r in network_snapshot(edges, ["g"]).collect()}
    assert again == snapshot and len(calls) == 1
    # From ends that are there: clustering, of loops and of nodes without pairs too, and mixing with unlabelled nodes.
    pairs = graph.dedup_edges(edges, ["g"])
    nodes = graph.pair_degrees(pairs, ["g"])
    label = F.when(F.col("node").isin("a", "x"), "newcomer").when(F.col("node") != "c", "existing")
    labels = nodes.select("g", "node", label.alias("label")).where("label IS NOT NULL")
    ends = graph.named_ends(pairs, nodes.join(labels, ["g", "node"], "left"), ["g"], "label")
    more = nodes.unionByName(spark.createDataFrame([("loop", "z", 0)], "g string, node string, degree long"))
    assert rows(graph.local_clustering(pairs, more, ["g"], ends)) == rows(graph.local_clustering(pairs, more, ["g"]))
    plain = graph.partition_metrics(pairs, nodes, labels, ["g"], ["g", "node"])
    assert rows(graph.partition_metrics(pairs, nodes, labels, ["g"], ["g", "node"], ends)) == rows(plain)
    assert rows(graph.degree_assortativity(pairs, nodes, ["g"], ends)) == rows(graph.degree_assortativity(pairs, nodes, ["g"]))
