"""Metrics of interaction graphs, for all snapshots at once.

A snapshot is one value of the key columns, such as a community and a month. Graphs are undirected
and unweighted: parallel and reversed edges count once, a self-loop adds 2 to its node's degree.

The distinct degrees of a snapshot with ``m`` edges are at most ``2 * sqrt(m)``, so everything about
the distribution of degrees is computed from its histogram, and never from a sorted list of nodes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.stats import ratio
from tideline.session import cut_lineage


def dedup_edges(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each unordered pair once, as ``a <= b``."""
    return edges.select(
        *keys, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    ).distinct()


def pair_degrees(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        pairs.select(*keys, F.explode(F.array("a", "b")).alias("node"))
        .groupBy(*keys, "node")
        .agg(F.count("*").alias("degree"))
    )


def degrees(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Degree of every node of every snapshot."""
    return pair_degrees(dedup_edges(edges, keys), keys)


def degree_histogram(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return nodes.groupBy(*keys, "degree").agg(F.count("*").alias("n"))


def degree_quantiles(nodes: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Interpolated quantiles of degrees per snapshot, over the histogram."""
    return degree_histogram(nodes, keys).groupBy(*keys).agg(
        *[F.percentile("degree", F.lit(float(p)), F.col("n")).alias(name) for name, p in probs.items()]
    )


def degree_stats(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes, and mean, median, sample deviation and variation of their degrees."""
    histogram = degree_histogram(nodes, keys)
    moments = nodes.groupBy(*keys).agg(
        F.count("*").alias("n_nodes"),
        F.avg("degree").alias("mean_degree"),
        F.coalesce(F.stddev_samp("degree"), F.lit(0.0)).alias("std_degree"),
    )
    medians = histogram.groupBy(*keys).agg(F.percentile("degree", F.lit(0.5), F.col("n")).alias("median_degree"))
    return (
        moments.join(medians, list(keys))
        .withColumn("degree_heterogeneity", ratio(F.col("std_degree"), F.col("mean_degree")))
        .select(*keys, "n_nodes", "mean_degree", "median_degree", "std_degree", "degree_heterogeneity")
    )


def density_of(n_nodes: Column, n_edges: Column) -> Column:
    """``2m / (n (n - 1))``; 0 for a single node."""
    return F.when(n_nodes <= 1, F.lit(0.0)).otherwise(ratio(2.0 * n_edges, n_nodes * (n_nodes - 1)))


def density(pairs: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    n_nodes = nodes.groupBy(*keys).agg(F.count("*").alias("n_nodes"))
    n_edges = pairs.groupBy(*keys).agg(F.count("*").alias("n_edges"))
    joined = n_nodes.join(n_edges, list(keys))
    return joined.withColumn("density", density_of(F.col("n_nodes"), F.col("n_edges")))


def with_end_values(pairs: DataFrame, nodes: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """Pairs with node columns attached at both ends, as ``<value>_a`` and ``<value>_b``.

    Nodes, a row per snapshot and name, are hashed, so that the pairs are not sorted by their names.
    """
    for end in ("a", "b"):
        side = nodes.select(*keys, F.col("node").alias(end), *[F.col(v).alias(f"{v}_{end}") for v in values])
        pairs = pairs.join(side.hint("shuffle_hash"), [*keys, end])
    return pairs


def edge_ends(pairs: DataFrame, labelled_nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Degrees and labels at both ends of each pair, written down for metrics that read either."""
    ends = with_end_values(pairs, labelled_nodes, keys, "degree", "label").withColumn("loop", F.col("a") == F.col("b"))
    return cut_lineage(ends.select(*keys, "degree_a", "degree_b", "label_a", "label_b", "loop"))


def named_ends(pairs: DataFrame, nodes: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """Pairs with degrees and other ``values`` of both ends, written down for all metrics that read them.

    ``nodes`` have the degrees of just these pairs.
    """
    return cut_lineage(with_end_values(pairs, nodes, keys, "degree", *values).withColumn("loop", F.col("a") == F.col("b")))


def degree_assortativity(
    pairs: DataFrame, nodes: DataFrame, keys: Sequence[str], ends: DataFrame | None = None
) -> DataFrame:
    """Correlation of degrees across edges taken in both directions; a self-loop has one direction.

    Edges are first counted per pair of degrees, so the sums run over a small table of integers.
    ``ends`` is :func:`edge_ends` or :func:`named_ends` of the same graph, where that exists.
    """
    if ends is None:
        ends = with_end_values(pairs, nodes, keys, "degree").withColumn("loop", F.col("a") == F.col("b"))
    loop = F.when(F.col("loop"), 1).otherwise(2)
    table = ends.groupBy(*keys, "degree_a", "degree_b").agg(F.sum(loop).cast("double").alias("_w"))
    # Either direction carries half the weight of both.
    w, x, y = F.col("_w"), F.col("degree_a").cast("double"), F.col("degree_b").cast("double")
    total, first = F.sum(w), F.sum(w * (x + y)) / 2
    second, cross = F.sum(w * (x * x + y * y)) / 2, F.sum(w * x * y)
    spread = total * second - first * first
    return table.groupBy(*keys).agg(
        F.when(spread > 0, F.try_divide(total * cross - first * first, spread)).alias("degree_assortativity")
    )


def gini(histogram: DataFrame, keys: Sequence[str], value: str = "degree", count: str = "n") -> DataFrame:
    """Gini coefficient from a histogram; null when empty or all values are 0.

    The ``n`` equal values at ranks ``b + 1 .. b + n`` enter the sum of rank times value together.
    """
    below = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    x, c, b = F.col(value).cast("double"), F.col(count).cast("double"), F.col("_below")
    ranked = histogram.withColumn("_below", F.coalesce(F.sum(count).over(below), F.lit(0)).cast("double"))
    size, total = F.sum(c), F.sum(c * x)
    by_rank = F.sum(x * (c * b + c * (c + 1) / 2))
    return ranked.groupBy(*keys).agg(ratio(2 * by_rank - (size + 1) * total, size * total).alias("gini"))


def local_clustering(
    pairs: DataFrame, nodes: DataFrame, keys: Sequence[str], ends: DataFrame | None = None
) -> DataFrame:
    """Clustering coefficient of every node; 0 below two neighbours. Self-loops are ignored.

    Edges point from the end with fewer neighbours to the one with more. Any node then has at most
    ``sqrt(2m)`` outgoing edges, hubs included, so these fit an array, and a triangle is a node that
    both ends of an edge point to. No pair of neighbours becomes a row. ``ends`` is :func:`named_ends`
    of the same graph, where that exists; ``nodes`` then have their degrees, in which a self-loop counts 2.
    """
    keys = list(keys)
    if ends is None:
        simple = pairs.where(F.col("a") != F.col("b"))
        reach = pair_degrees(simple, keys)
        ends = with_end_values(simple, reach, keys, "degree")
        held = nodes.select(*keys, "node").join(
            reach.select(*keys, "node", F.col("degree").alias("_k")), [*keys, "node"], "left"
        )
    else:
        loops = pairs.where(F.col("a") == F.col("b")).groupBy(*keys, F.col("a").alias("node")).agg(F.count("*").alias("_loops"))
        held = nodes.join(loops, [*keys, "node"], "left").select(
            *keys, "node", (F.col("degree") - 2 * F.coalesce("_loops", F.lit(0))).alias("_k")
        )
        ends = ends.where(~F.col("loop"))
    forward = (F.col("degree_a") < F.col("degree_b")) | (
        (F.col("degree_a") == F.col("degree_b")) & (F.col("a") < F.col("b"))
    )
    arcs = ends.select(
        *keys,
        F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"),
        F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"),
    )
    out = arcs.groupBy(*keys, "u").agg(F.collect_list("v").alias("_out"))
    onward = out.select(*keys, F.col("u").alias("v"), F.col("_out").alias("_onward"))
    closed = (
        out.select(*keys, "u", "_out", F.explode("_out").alias("v"))
        .join(onward, [*keys, "v"])
        .select(*keys, "u", "v", F.array_intersect("_out", "_onward").alias("_common"))
        .where(F.size("_common") > 0)
    )
    size = F.size("_common").cast("bigint")
    credit = F.concat(
        F.array(F.struct(F.col("u").alias("node"), size.alias("t")), F.struct(F.col("v").alias("node"), size.alias("t"))),
        F.transform("_common", lambda w: F.struct(w.alias("node"), F.lit(1).cast("bigint").alias("t"))),
    )
    triangles = (
        closed.select(*keys, F.explode(credit).alias("_c"))
        .groupBy(*keys, F.col("_c.node").alias("node"))
        .agg(F.sum("_c.t").alias("triangles"))
    )
    k = F.col("_k")
    return (
        held.join(triangles, [*keys, "node"], "left")
        .select(
            *keys,
            "node",
            F.coalesce("triangles", F.lit(0)).alias("triangles"),
            F.when(k >= 2, 2.0 * F.coalesce("triangles", F.lit(0)) / (k * (k - 1))).otherwise(F.lit(0.0)).alias("clustering"),
        )
    )


def clustering_stats(
    pairs: DataFrame, nodes: DataFrame, keys: Sequence[str], ends: DataFrame | None = None
) -> DataFrame:
    """Mean clustering, its expectation in a random graph of the same size, and their ratio."""
    mean = local_clustering(pairs, nodes, keys, ends).groupBy(*keys).agg(F.avg("clustering").alias("mean_clustering"))
    sizes = density(pairs, nodes, keys)
    joined = sizes.join(mean, list(keys)).withColumn("er_expected_clustering", F.col("density"))
    return joined.select(
        *keys,
        "mean_clustering",
        "er_expected_clustering",
        ratio(F.col("mean_clustering"), F.col("er_expected_clustering")).alias("normalized_clustering"),
    )


def partition_metrics(
    pairs: DataFrame,
    nodes: DataFrame,
    labels: DataFrame,
    keys: Sequence[str],
    on: Sequence[str],
    ends: DataFrame | None = None,
) -> DataFrame:
    """How newcomers and existing users mix, over nodes that have a label.

    Everything follows from counts of edges within and between the two groups. Without members in
    one of the groups only the counts are given. ``ends`` is :func:`named_ends` of the same graph with
    ``label``, null where there is none; such ends count nowhere.
    """
    keys = list(keys)
    labelled = nodes.select(*keys, "node").join(labels.select(*on, "label"), list(on))
    is_new = F.col("label") == "newcomer"
    sizes = labelled.groupBy(*keys).agg(
        F.count_if(is_new).alias("n_newcomers"), F.count_if(~is_new).alias("n_existing")
    )
    if ends is None:
        ends = with_end_values(pairs, labelled, keys, "label")
    new_a, new_b = F.col("label_a") == "newcomer", F.col("label_b") == "newcomer"
    loop = F.col("a") == F.col("b")
    mixed = ends.groupBy(*keys).agg(
        F.count_if(new_a & new_b).alias("_nn"),
        F.count_if(~new_a & ~new_b).alias("_oo"),
        F.count_if(new_a != new_b).alias("_no"),
        F.count_if(loop & new_a).alias("_loops_n"),
        F.count_if(loop & ~new_a).alias("_loops_o"),
    )
    nn, oo, no = (F.coalesce(c, F.lit(0)).cast("double") for c in ("_nn", "_oo", "_no"))
    loops_n, loops_o = (F.coalesce(c, F.lit(0)).cast("double") for c in ("_loops_n", "_loops_o"))
    m = nn + oo + no
    share_n, share_o = ratio(2 * nn + no, 2 * m), ratio(2 * oo + no, 2 * m)
    modularity = ratio(nn + oo, m) - share_n * share_n - share_o * share_o
    # Mixing counts edges in both directions, self-loops once.
    to_n, to_o = 2 * nn - loops_n, 2 * oo - loops_o
    total = to_n + to_o + 2 * no
    margins = F.pow(ratio(to_n + no, total), 2) + F.pow(ratio(to_o + no, total), 2)
    assortativity = F.when(margins < 1, ratio(ratio(to_n + to_o, total) - margins, 1 - margins))
    n_new, n_old = F.col("n_newcomers"), F.col("n_existing")
    complete = (n_new > 0) & (n_old > 0)
    return sizes.join(mixed, keys, "left").select(
        *keys,
        "n_newcomers",
        "n_existing",
        F.when(complete, modularity).alias("modularity"),
        F.when(complete, assortativity).alias("assortativity"),
        F.when(complete, ratio(no - nn - oo, m)).alias("ei_index"),
        F.when(complete, density_of(n_new, nn)).alias("density_newcomer"),
        F.when(complete, density_of(n_old, oo)).alias("density_existing"),
    )


def ei_index(
    pairs: DataFrame, labelled_nodes: DataFrame, keys: Sequence[str], name: str = "ei_index", ends: DataFrame | None = None
) -> DataFrame:
    """External minus internal edges over all edges, and the sizes of the two groups.

    ``ends`` is :func:`edge_ends` of the same graph, where that exists.
    """
    sizes = labelled_nodes.groupBy(*keys).agg(
        F.count("*").alias("n_nodes"),
        F.count_if(F.col("label") == "newcomer").alias("n_newcomers"),
        F.count_if(F.col("label") != "newcomer").alias("n_existing"),
    )
    if ends is None:
        ends = with_end_values(pairs, labelled_nodes, keys, "label")
    crossing = F.count_if(F.col("label_a") != F.col("label_b"))
    mixed = ends.groupBy(*keys).agg(
        F.count("*").alias("n_edges"), ratio(2 * crossing - F.count("*"), F.count("*")).alias(name)
    )
    return sizes.join(mixed, list(keys))
