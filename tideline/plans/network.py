"""Complete graph descriptions made from the single metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import components, graph
from tideline.operators.rollups import NETWORK_COLUMNS, left_join_all
from tideline.session import cut_lineage


def network_snapshot(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All metrics of every snapshot in one row.

    The deduplicated edges and the degrees feed every metric, so both are written down once, and so are the
    degrees of both ends of each pair.
    """
    keys = list(keys)
    pairs = cut_lineage(graph.dedup_edges(edges, keys))
    nodes = cut_lineage(graph.pair_degrees(pairs, keys))
    found = components.connected_components(pairs, nodes, keys)
    ends = graph.named_ends(pairs, nodes, keys)
    parts = [
        graph.degree_stats(nodes, keys).drop("n_nodes"),
        graph.clustering_stats(pairs, nodes, keys, ends),
        components.path_metrics(pairs, found, keys),
        graph.degree_assortativity(pairs, nodes, keys, ends),
    ]
    joined = left_join_all(graph.density(pairs, nodes, keys), parts, keys)
    return joined.select(*keys, *[F.col(c) for c in NETWORK_COLUMNS])
