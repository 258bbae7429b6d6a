"""The neighbourhood function by register sketches: mean distances of graphs too large for exact search.

Every node keeps a HyperLogLog sketch of the nodes within reach; one step merges the sketches of all
neighbours into it, and the sizes of the sketches summed over nodes tell how many pairs are that far
apart. A step moves a sketch per edge instead of a bit per edge and source, so the cost does not grow
with the square of the nodes. Snapshots that a task can hold are sketched in one, some registers of all nodes at a
time; of larger ones sketches are joined to the edges. ``components.path_metrics`` stays exact at every size; this is for
callers who ask for it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.stats import ratio
from tideline.operators import components as search
from tideline.session import Rounds, cut_lineage

#: The estimate of a merged sketch has this standard error times the root of its registers.
REGISTER_ERROR = 1.04
#: Arcs whose sketches a task sends on in a step where there are more than ``FEW_ARCS``. Their numbers take few
#: bytes and their sketches many, so tasks sized by bytes would hold millions.
TASK_ARCS, FEW_ARCS = 1 << 17, 1 << 21
#: Registers that a task holds of every node at once, and nodes whose registers it adds up at once.
HELD_REGISTERS, HELD_NODES = 64, 1 << 14


def sketch_error(registers_log2: int) -> float:
    """Relative standard error of a sketch's size."""
    return REGISTER_ERROR / math.sqrt(1 << registers_log2)


def _registers(n: int, registers_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """The register of every node, and what it holds: 1 and the zeros that a hash of the node's number ends with."""
    number = np.arange(n, dtype=np.uint64)
    if n <= 1 << registers_log2:
        return number.astype(np.int64), np.ones(n, np.uint8)
    hashed = (number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        hashed = (hashed ^ (hashed >> np.uint64(shift))) * np.uint64(factor)
    hashed ^= hashed >> np.uint64(31)
    left = hashed >> np.uint64(registers_log2) | np.uint64(1) << np.uint64(64 - registers_log2)
    return (hashed & np.uint64((1 << registers_log2) - 1)).astype(np.int64), np.bitwise_count(left ^ (left - np.uint64(1)))


def _estimates(zeros: np.ndarray, inverse: np.ndarray, registers: int) -> np.ndarray:
    """Sizes from empty registers and the sum of ``2 ** -value`` of the others, in whole nodes (Ertl, 2017)."""
    share = np.arange(registers) / registers
    sigma, power, scale = share.copy(), share.copy(), 1.0
    for _ in range(64):
        power = power * power
        sigma, scale = sigma + power * scale, scale * 2
    sigma = np.append(sigma, np.inf)
    return np.rint(registers**2 / (2 * math.log(2)) / (registers * sigma[zeros] + inverse))


def summed_sizes(u: np.ndarray, v: np.ndarray, registers_log2: int) -> list[float]:
    """For 1, 2, ... steps the sizes of all nodes' sketches, summed, until no register changes.

    Sketches of up to as many nodes as registers are exact, as each node has a register of its own.
    """
    near = search.Neighbours(u, v)
    registers = 1 << registers_log2
    register, value = _registers(near.n, registers_log2)
    register, value = register[near.node], value[near.node]
    # Empty registers and the others' sums in one number: the latter are below the former's unit.
    worth = np.append(float(registers), 0.5 ** np.arange(1, 66))

    def added(held: np.ndarray) -> np.ndarray:
        parts = (worth[held[i : i + HELD_NODES]].sum(axis=1) for i in range(0, len(held), HELD_NODES))
        return np.concatenate([*parts, np.zeros(0)])

    # Of each step the sums over the registers seen so far, and these sums at the end of their last steps.
    found: list[np.ndarray] = []
    ends = np.zeros(near.n)
    for first in range(0, registers, HELD_REGISTERS):
        width = min(HELD_REGISTERS, registers - first)
        own = np.flatnonzero((register >= first) & (register < first + width))
        held = np.zeros((near.n, width), np.uint8)
        held[own, register[own] - first] = value[own]
        other, spare = np.empty_like(held), np.empty_like(held)
        sums, step = added(held), 0
        while True:
            np.maximum(near.all_ored(held, other, spare, np.maximum), held, out=other)
            moved = np.flatnonzero((other != held).any(axis=1))
            if not len(moved):
                break
            held, other = other, held
            sums[moved] = added(held[moved])
            if step == len(found):
                found.append(ends.copy())
            found[step] += sums
            step += 1
        for later in found[step:]:
            later += sums
        ends += sums
    sizes = []
    for sums in found:
        zeros = np.floor(sums / registers).astype(np.int64)
        exact = near.n <= registers
        sizes.append(float((registers - zeros if exact else _estimates(zeros, sums - registers * zeros, registers)).sum()))
    return sizes


def _sizes_in_tasks(links: DataFrame, registers_log2: int) -> DataFrame:
    """``_s, _d, _pairs`` as of :func:`neighbourhood_sizes`, a task holding a snapshot's links."""

    def run(table: pa.Table) -> pa.Table:
        sizes = summed_sizes(*search.giant_arcs(table), registers_log2)
        steps = pa.array(range(1, len(sizes) + 1), pa.int32())
        columns = [pa.repeat(table.column("_s")[0], len(sizes)), steps, pa.array(sizes, pa.float64())]
        return pa.table(columns, names=["_s", "_d", "_pairs"])

    return cut_lineage(links.groupBy("_s").applyInArrow(run, "_s bigint, _d int, _pairs double"))


def sent_sketches(arcs: DataFrame, state: DataFrame, tasks: int | None) -> DataFrame:
    """The sketch of the first end of every arc, at its second end; with ``tasks``, by at least so many tasks."""
    ends = state.select("_s", F.col("_i").alias("u"), "sketch")
    if tasks is not None:
        # With fewer parts than these the planner would deal out anew, and size its tasks by bytes.
        tasks = max(tasks, int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        arcs, ends = arcs.repartition(tasks, "_s", "u"), ends.repartition(tasks, "_s", "u").hint("merge")
    return arcs.join(ends, ["_s", "u"]).select(
        "_s", F.col("v").alias("_i"), "sketch", F.lit(None).cast("double").alias("size")
    )


def neighbourhood_sizes(
    arcs: DataFrame,
    nodes: DataFrame,
    registers_log2: int,
    task_arcs: int = TASK_ARCS,
    few_arcs: int = FEW_ARCS,
) -> DataFrame:
    """``_s, _d, _pairs``: ordered pairs at most ``_d`` edges apart, both ends alike included, as sketches see them.

    Steps go on until no sketch's size changes, in whole nodes. Their number is the largest distance at
    which one still grew, at most the diameter.
    """
    spark = arcs.sparkSession
    rounds = Rounds(spark)
    n_arcs = arcs.count()
    tasks = math.ceil(n_arcs / task_arcs) if n_arcs > few_arcs else None
    sketch = F.hll_sketch_agg(F.col("_i"), F.lit(registers_log2)).alias("sketch")
    state = nodes.groupBy("_s", "_i").agg(sketch)
    state = rounds.cut(state.withColumn("size", F.lit(1.0)))
    sizes, distance = [], 0
    while True:
        distance += 1
        near = sent_sketches(arcs, state, tasks)
        merged = (
            state.unionByName(near)
            .groupBy("_s", "_i")
            .agg(F.hll_union_agg("sketch").alias("sketch"), F.max("size").alias("_before"))
            .withColumn("size", F.hll_sketch_estimate("sketch").cast("double"))
        )
        held = rounds.cut(merged)
        summed = cut_lineage(
            held.groupBy("_s")
            .agg(F.sum("size").alias("_pairs"), F.count_if(F.col("size") != F.col("_before")).alias("_moved"))
            .where("_moved > 0")
            .select("_s", F.lit(distance).alias("_d"), "_pairs")
        )
        if summed.isEmpty():
            break
        sizes.append(summed)
        # Snapshots in which nothing moved are done.
        state = held.join(summed.select("_s"), "_s", "semi").select("_s", "_i", "sketch", "size")
    schema = "_s bigint, _d int, _pairs double"
    return reduce(DataFrame.unionByName, sizes, spark.createDataFrame([], schema))


def sketched_path_metrics(
    pairs: DataFrame,
    components: DataFrame,
    keys: Sequence[str],
    registers_log2: int = 10,
    task_arcs: int = search.TASK_ARCS,
) -> DataFrame:
    """Mean shortest path of the giant component from sketches, with its bound, and the steps it took.

    The pairs of the giant component are known, so the mean is the sum over distances of the share of
    pairs farther apart. ``path_error`` is three standard errors: each sketched count is off by at most
    the error of a sketch, as if all nodes erred alike. ``least_diameter`` is at most the diameter.
    Snapshots of more than ``task_arcs`` arcs are sketched by joins.
    """
    keys = list(keys)
    snapshots = search.numbered_snapshots(search.giant_component(components, keys))
    links, large = search.links_of_small(pairs, snapshots, keys, task_arcs)
    sizes = _sizes_in_tasks(links, registers_log2)
    if not large.isEmpty():
        _, nodes, arcs = search.numbered_graph(pairs, components, keys, large)
        sizes = sizes.unionByName(neighbourhood_sizes(arcs, nodes, registers_log2))
    n = F.col("giant_component_size").cast("double")
    held = sizes.join(snapshots.select(*keys, "_s", "giant_component_size"), "_s")
    last = held.groupBy("_s").agg(F.max("_d").alias("_last"))
    # At the last step all pairs are within reach, which needs no sketch.
    inner = F.when(F.col("_d") < F.col("_last"), F.least(F.col("_pairs"), n * n))
    summed = held.join(last, "_s").groupBy(*keys, "giant_component_size").agg(
        F.max("_last").alias("least_diameter"),
        F.coalesce(F.sum(inner), F.lit(0.0)).alias("_reached"),
        F.count(inner).alias("_steps"),
    )
    apart = n * (n - 1) + F.col("_steps") * n * n - F.col("_reached")
    return summed.select(
        *keys,
        "giant_component_size",
        ratio(apart, n * (n - 1)).alias("avg_shortest_path"),
        ratio(F.lit(3 * sketch_error(registers_log2)) * F.col("_reached"), n * (n - 1)).alias("path_error"),
        "least_diameter",
    )
