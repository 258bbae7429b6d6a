"""Connected components and shortest paths of all snapshots at once.

Both loop on the driver over plain joins and write each round down, so a lost executor costs at
most one round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tideline.functions.stats import ratio
from tideline.operators.ranking import numbered_rows
from tideline.session import Rounds, cut_lineage, drop_folder, fresh_folder

#: Arcs of a snapshot that a task may hold (16 bytes each), arcs times sources that it searches, and
#: words that stand in each of its arrays at once.
TASK_ARCS, TASK_WORK, HELD_WORDS = 1 << 22, 1 << 36, 1 << 22
#: Arcs times sources for which there is a task of its own, where snapshots are small.
PART_WORK = 1 << 30
#: Words of a node that stand side by side, a power of two; more of them leave the processor's cache.
MOST_WORDS = 16
#: Arcs of a node that are followed one after the other; nodes with more are cut into slots of so many.
SLOT_ARCS = 32
#: Share of the nodes up to which a step looks at the ones next to its newest alone.
FEW_ROWS = 0.4


def _both_ways(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges in both directions, without self-loops."""
    there = pairs.where(F.col("a") != F.col("b")).select(*keys, F.col("a").alias("u"), F.col("b").alias("v"))
    return there.unionByName(there.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))


def smallest_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of ``n`` numbers is linked with, itself included."""
    root = np.arange(n)
    while True:
        one, other = root[a], root[b]
        low, high = np.minimum(one, other), np.maximum(one, other)
        if (low == high).all():
            return root
        # Every root with a smaller neighbour points to it; then all pointers lead to roots again.
        np.minimum.at(root, high, low)
        while not ((above := root[root]) == root).all():
            root = above


def _numbered_ends(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The names in columns ``a`` and ``b``, each once and in order, and both columns as numbers of names."""
    ends = pa.concat_arrays([*table.column("a").chunks, *table.column("b").chunks])
    held = ends.dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(held.dictionary)
    number = np.empty(len(order), np.int64)
    number[order.to_numpy()] = np.arange(len(order))
    number = number[held.indices.to_numpy()]
    return held.dictionary.take(order), number[: len(table)], number[len(table) :]


def _components_in_tasks(links: DataFrame, keys: list[str]) -> DataFrame:
    """Components of snapshots that a task can hold."""

    def run(table: pa.Table) -> pa.Table:
        names, a, b = _numbered_ends(table)
        smallest = smallest_linked(a, b, len(names))
        held = [pa.repeat(table.column(k)[0], len(names)) for k in keys]
        return pa.table([*held, names, names.take(pa.array(smallest))], names=[*keys, "node", "component"])

    schema = links.select(*keys, F.col("a").alias("node"), F.col("b").alias("component")).schema
    return links.groupBy(*keys).applyInArrow(run, schema)


def connected_components(
    pairs: DataFrame, nodes: DataFrame, keys: Sequence[str], task_arcs: int = TASK_ARCS
) -> DataFrame:
    """Every node with ``component``, the smallest node name of its component.

    A snapshot with up to ``task_arcs`` pairs and nodes is searched in one task; larger ones by rounds
    of joins.
    """
    keys = list(keys)
    alone = nodes.select(*keys, F.col("node").alias("a"), F.col("node").alias("b"))
    links = cut_lineage(pairs.select(*keys, "a", "b").unionByName(alone))
    sizes = cut_lineage(links.groupBy(*keys).agg(F.count("*").alias("_links")))
    large = sizes.where(F.col("_links") > task_arcs).select(*keys)
    if large.isEmpty():
        return _components_in_tasks(links, keys)
    small = links.join(sizes.where(F.col("_links") <= task_arcs).select(*keys), keys, "semi")
    rest = components_by_rounds(pairs.join(large, keys, "semi"), nodes.join(large, keys, "semi"), keys)
    return _components_in_tasks(small, keys).unionByName(rest.select(*keys, "node", "component"))


def components_by_rounds(pairs: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Components of snapshots of any size.

    Each round every node looks at the labels its neighbours point to, passes the smallest one on to
    the node it points to itself, and shortens its own pointer. Trees of pointers at least halve in
    height, so rounds grow with the logarithm of a component's diameter (Shiloach and Vishkin's
    scheme in the form of Zhang, Azad and Hu, 2020). Pointers gather on few nodes as the rounds go
    on; the table of pointed-to nodes shrinks with that, so by the time many rows share a target the
    adaptive planner sees a table small enough to broadcast. Rounds go on until nothing moves; a
    label only ever falls, so that happens.
    """
    arcs = cut_lineage(_both_ways(pairs, keys))
    state = cut_lineage(nodes.select(*keys, "node", F.col("node").alias("f")))
    rounds = Rounds(pairs.sparkSession)
    while True:
        targets = state.select(*keys, F.col("f").alias("node")).distinct().join(state, [*keys, "node"])
        grand = targets.select(*keys, F.col("node").alias("f"), F.col("f").alias("gf"))
        jumped = state.join(grand, [*keys, "f"])
        smallest = (
            arcs.join(jumped.select(*keys, F.col("node").alias("v"), "gf"), [*keys, "v"])
            .groupBy(*keys, F.col("u").alias("node"))
            .agg(F.min("gf").alias("_near"))
        )
        seen = jumped.join(smallest, [*keys, "node"], "left").withColumn("_near", F.coalesce("_near", "gf"))
        own = seen.select(*keys, "node", F.least("f", "gf", "_near").alias("f"))
        passed = seen.groupBy(*keys, F.col("f").alias("node")).agg(F.min("_near").alias("_passed"))
        moved = (
            own.join(passed, [*keys, "node"], "left")
            .withColumn("f", F.least("f", F.coalesce("_passed", "f")))
            .join(state.withColumnRenamed("f", "_old"), [*keys, "node"])
        )
        moved = rounds.cut(moved.select(*keys, "node", "f", (F.col("f") != F.col("_old")).alias("_moved")))
        state = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return state.withColumnRenamed("f", "component")


def component_sizes(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    return components.groupBy(*keys, "component").agg(F.count("*").alias("size"))


def giant_component(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest component of each snapshot (of equals, the one with the smallest name)."""
    largest = F.min(F.struct(-F.col("size"), F.col("component").isNull(), F.col("component").alias("component")))
    top = component_sizes(components.dropna(subset=list(keys)), keys).groupBy(*keys).agg(
        largest.alias("_top"), F.max("size").alias("giant_component_size"), F.sum("size").alias("_n")
    )
    return top.select(
        *keys,
        F.col("_top.component").alias("component"),
        "giant_component_size",
        ratio(F.col("giant_component_size"), F.col("_n")).alias("giant_component_fraction"),
    )


def numbered_snapshots(giant: DataFrame) -> DataFrame:
    """Snapshots whose giant component has edges, with a number ``_s``."""
    return cut_lineage(giant.where(F.col("giant_component_size") > 1).withColumn("_s", F.monotonically_increasing_id()))


def numbered_graph(
    pairs: DataFrame, components: DataFrame, keys: Sequence[str], snapshots: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Giant components with numbers in place of names, so that searches move few bytes.

    Returns the snapshots with their number ``_s``, their nodes as ``_s, node, _i`` and their arcs as
    ``_s, u, v``. ``_i`` counts the nodes of a snapshot from 0. ``snapshots`` are the ones to number, by default all.
    """
    keys = list(keys)
    if snapshots is None:
        snapshots = numbered_snapshots(giant_component(components, keys))
    named = snapshots.select(*keys, "component", "_s")
    members = components.join(named, [*keys, "component"]).select("_s", "node")
    nodes = numbered_rows(members, ["_s"], [F.col("node")], "_i").withColumn("_i", F.col("_i") - 1)
    nodes = cut_lineage(nodes.select("_s", "node", "_i"))
    arcs = _both_ways(pairs, keys).join(named.select(*keys, "_s"), keys).select("_s", "u", "v")
    for end in ("u", "v"):
        names = nodes.select("_s", F.col("node").alias(end), F.col("_i").alias(f"_{end}"))
        arcs = arcs.join(names, ["_s", end])
    return snapshots, nodes, cut_lineage(arcs.select("_s", F.col("_u").alias("u"), F.col("_v").alias("v")))


def _diagonals(arcs: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The first arcs of all rows, the second ones of those that have two, and so on; the longest rows come first."""
    counts = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0))
    return [arcs[starts[:c] + k] for k, c in enumerate(counts)]


def _ored(
    diagonals: list[np.ndarray], words: np.ndarray, out: np.ndarray, spare: np.ndarray, merge: np.ufunc = np.bitwise_or
) -> np.ndarray:
    """``out``: for each row the OR of the words that its arcs lead to."""
    for k, ends in enumerate(diagonals):
        held = np.take(words, ends, axis=0, out=spare[: len(ends)] if k else out, mode="clip")
        if k:
            merge(out[: len(ends)], held, out=out[: len(ends)])
    return out


class Neighbours:
    """Arcs in the order in which words of bits are ORed along them; every node has one, and they lead both ways.

    Nodes become rows, those with most arcs first, so that the ``k``-th arcs of all rows are one gather and one
    OR of whole rows. Nodes with more than ``SLOT_ARCS`` arcs come last; their arcs are cut into slots, which
    are ORed like rows, and then the slots of each node. Other words may be merged in another way.
    """

    def __init__(self, u: np.ndarray, v: np.ndarray):
        degree = np.bincount(v)
        hub = degree > SLOT_ARCS
        #: The node of each row, and the row of each node.
        self.node = np.lexsort((-degree, hub))
        self.row = np.empty_like(self.node)
        self.row[self.node] = np.arange(len(degree))
        lengths = degree[self.node]
        starts = np.cumsum(lengths) - lengths
        arcs = self.row[u[np.argsort(self.row[v], kind="stable")]]
        self.n, self.low = len(degree), len(degree) - int(hub.sum())
        self.single = _diagonals(arcs, starts[: self.low], lengths[: self.low])
        slots = -(-lengths[self.low :] // SLOT_ARCS)
        self.hub = np.repeat(np.arange(len(slots)), slots)
        place = np.arange(len(self.hub)) - np.repeat(np.cumsum(slots) - slots, slots)
        held = np.minimum(SLOT_ARCS, lengths[self.low :][self.hub] - SLOT_ARCS * place)
        order = np.argsort(-held, kind="stable")
        self.slots = _diagonals(arcs, (starts[self.low :][self.hub] + SLOT_ARCS * place)[order], held[order])
        self.hub_of_slot = self.hub[order]
        self.slot = np.empty_like(order)
        self.slot[order] = np.arange(len(order))

    def touched(self, active: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """Rows of ``todo`` next to one of ``active``, in order."""
        near = np.zeros(self.n, bool)
        for ends in self.single:
            near[: len(ends)] |= active[ends]
        if len(self.hub):
            met = np.zeros(len(self.hub), bool)
            for ends in self.slots:
                met[: len(ends)] |= active[ends]
            near[self.low + self.hub_of_slot[met]] = True
        return np.flatnonzero(near & todo)

    def ored(self, words: np.ndarray, rows: np.ndarray, merge: np.ufunc = np.bitwise_or) -> np.ndarray:
        """For each of ``rows``, which are in order, the OR of its neighbours' words."""

        def some(diagonals: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
            counts = np.searchsorted(wanted, [len(d) for d in diagonals])
            out = np.empty((len(wanted), words.shape[1]), words.dtype)
            return _ored([d[wanted[:c]] for d, c in zip(diagonals, counts) if c], words, out, np.empty_like(out), merge)

        cut = np.searchsorted(rows, self.low)
        low = some(self.single, rows[:cut])
        if cut == len(rows):
            return low
        wanted = np.zeros(self.n - self.low, bool)
        wanted[rows[cut:] - self.low] = True
        which = np.flatnonzero(wanted[self.hub_of_slot])
        place = np.empty(len(self.hub), np.int64)
        place[which] = np.arange(len(which))
        kept = wanted[self.hub]
        parts = np.take(some(self.slots, which), place[self.slot[kept]], axis=0)
        starts = np.flatnonzero(np.diff(self.hub[kept], prepend=-1))
        return np.concatenate([low, merge.reduceat(parts, starts, axis=0)])

    def all_ored(
        self, words: np.ndarray, out: np.ndarray, spare: np.ndarray, merge: np.ufunc = np.bitwise_or
    ) -> np.ndarray:
        """``out``: for every row the OR of its neighbours' words."""
        _ored(self.single, words, out[: self.low], spare, merge)
        if self.low < self.n:
            out[self.low :] = self.ored(words, np.arange(self.low, self.n), merge)
        return out


def _some(counts: np.ndarray) -> np.ndarray:
    """Which rows of bytes, 1, 2, 4, 8 or more in number, are not all 0."""
    wide = counts.view(f"u{min(counts.shape[1], 8)}")
    found = wide[:, 0] != 0
    for i in range(1, wide.shape[1]):
        found |= wide[:, i] != 0
    return found


def _batches(first: int, count: int, n: int, held_words: int) -> Iterator[tuple[int, int, int]]:
    """``low, high, words``: sources that are searched at once, and the words in which their bits stand."""
    words = 1
    while words < MOST_WORDS and 64 * words < count and 2 * words * n <= held_words:
        words *= 2
    for low in range(first, first + count, 64 * words):
        yield low, min(low + 64 * words, first + count), words


def _spread(
    near: Neighbours, low: int, high: int, words: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``distance, rows, newest, left``, from distance 0 on, for the sources ``low .. high - 1``.

    ``newest`` says which rows are so far from which sources, ``rows`` are those that are from any, and ``left``
    counts the sources from which a row is farther, for each word. All three change with the next step.
    """
    at = np.arange(high - low)
    rows = near.row[low:high]
    newest = np.zeros((near.n, words), np.uint64)
    newest[rows, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
    unseen = np.bitwise_or.reduce(newest, axis=0) & ~newest
    left = np.bitwise_count(unseen)
    active = np.zeros(near.n, bool)
    active[rows] = True
    other, spare = np.empty_like(newest), np.empty_like(newest)
    few, todo = False, np.ones(near.n, bool)
    yield 0, rows, newest, left
    for distance in range(1, near.n + 1):
        # Next to a row that was reached from all sources in the last step, what is left is one step farther.
        before, todo = todo, _some(left)
        reached = before & ~todo
        ended = near.touched(reached, todo) if reached.any() else np.zeros(0, np.int64)
        todo[ended] = False
        touched = near.touched(active, todo)
        if len(touched) < FEW_ROWS * near.n:
            found = near.ored(newest, touched)
            rest = np.take(unseen, touched, axis=0)
            found &= rest
            rest ^= found
            counts = np.bitwise_count(rest)
            new = _some(left[touched] ^ counts)
            if few:
                newest[rows] = 0
                active[rows] = False
            else:
                newest.fill(0)
                active.fill(False)
            rows = touched[new]
            newest[rows], unseen[rows], left[rows] = found[new], rest[new], counts[new]
            if len(ended):
                newest[ended] = np.take(unseen, ended, axis=0)
                unseen[ended], left[ended] = 0, 0
                rows = np.concatenate([rows, ended])
            active[rows] = True
            few = True
        else:
            newest, other = near.all_ored(newest, other, spare), newest
            newest &= unseen
            unseen ^= newest
            former, left = left, np.bitwise_count(unseen)
            active = _some(former ^ left)
            rows = np.flatnonzero(active)
            few = False
        todo[ended] = True
        if not len(rows):
            break
        yield distance, rows, newest, left


def distance_counts(u: np.ndarray, v: np.ndarray, first: int, count: int, held_words: int) -> list[int]:
    """How many nodes are 1, 2, ... edges away from each of ``count`` sources from ``first`` on, summed."""
    near = Neighbours(u, v)
    found: list[int] = []
    for low, high, words in _batches(first, count, near.n, held_words):
        for distance, rows, newest, _ in _spread(near, low, high, words):
            if distance > len(found):
                found.append(0)
            if distance:
                found[distance - 1] += int(np.bitwise_count(newest[rows]).sum(dtype=np.int64))
    return found


def weighted_distances(
    u: np.ndarray, v: np.ndarray, weight: np.ndarray, height: np.ndarray, first: int, count: int, held_words: int
) -> tuple[int, int]:
    """Distances of all nodes from ``count`` sources, times both weights, summed; and the largest with both heights."""
    near = Neighbours(u, v)
    row_weight, row_height = weight[near.node], height[near.node]
    heights = [int(h) for h in np.unique(height)[::-1]]
    total, far = 0, 0
    for low, high, words in _batches(first, count, near.n, held_words):
        own_weight, own_height = weight[low:high], height[low:high]
        tallest, level = int(own_height.max()), bool((own_height == own_height[0]).all())
        # A word counts with its least weight, and what its sources weigh above it bit by bit.
        least, above = [], []
        for word in range(-(-(high - low) // 64)):
            own = own_weight[64 * word : 64 * word + 64]
            least.append(int(own.min()))
            more = own - own.min()
            for bit in range(int(more.max()).bit_length()):
                mask = np.uint64(sum(1 << int(i) for i in np.flatnonzero(more >> bit & 1)))
                above.append((word, mask, 1 << bit))
        # A distance is the number of steps after which a pair is still left; bytes hold three counts of 64.
        steps, last = np.zeros((near.n, words), np.int64), 0
        for distance, rows, newest, left in _spread(near, low, high, words):
            if distance % 3 == 0:
                if distance:
                    steps += held
                held = left.copy()
            else:
                held += left
            last, at_end = distance, left
            for word, mask, times in above:
                reached = np.bitwise_count(newest[rows, word] & mask)
                total += distance * times * int(row_weight[rows] @ reached.astype(np.int64))
            for h in heights if distance else ():
                if distance + h + tallest <= far:
                    break
                some = rows[row_height[rows] == h]
                if not len(some):
                    continue
                if level:
                    far = distance + h + tallest
                    continue
                met = np.bitwise_or.reduce(np.take(newest, some, axis=0), axis=0)
                bits = np.unpackbits(met.view(np.uint8), bitorder="little")[: high - low].astype(bool)
                far = max(far, distance + h + int(own_height[bits].max()))
        # What is never reached has no distance.
        steps += held
        steps -= (last + 1) * at_end.astype(np.int64)
        total += sum(int(x) * y for x, y in zip(row_weight @ steps, least))
    return total, far


class Reduced:
    """A connected graph whose nodes stand for groups, so that all distances follow from fewer nodes.

    A node at depth ``p`` of its group is ``p`` farther than the group's node from everything outside.
    ``weight`` counts a group's nodes, ``depths`` sums their depths, ``height`` is the largest. ``inside``
    is the sum of distances of ordered pairs within groups, ``far`` the largest of these distances.
    """

    def __init__(self, u: np.ndarray, v: np.ndarray):
        n = int(u.max()) + 1
        self.u, self.v = u, v
        self.weight, self.depths = np.ones(n, np.int64), np.zeros(n, np.int64)
        self.height = np.zeros(n, np.int64)
        self.inside = self.far = 0
        while len(self.weight) > 2:
            before = len(self.weight)
            self._join_leaves()
            self._join_twins()
            if len(self.weight) > 0.99 * before:
                break
        # Sources of one weight share words.
        order = np.argsort(self.weight, kind="stable")
        self._keep(order)

    def _keep(self, kept: np.ndarray) -> None:
        """Only the nodes ``kept``, in that order, and the arcs between them."""
        number = np.full(len(self.weight), -1)
        number[kept] = np.arange(len(kept))
        u, v = number[self.u], number[self.v]
        held = (u >= 0) & (v >= 0)
        self.u, self.v = u[held], v[held]
        self.weight, self.depths, self.height = self.weight[kept], self.depths[kept], self.height[kept]

    def _merge(self, into: np.ndarray, step: np.ndarray) -> None:
        """Each node joins the group of ``into``; its nodes come to lie ``step`` deeper, and meet others through there."""
        n = len(into)
        depths, height = self.depths + step * self.weight, self.height + step
        weight = np.bincount(into, self.weight, n).astype(np.int64)
        self.inside += 2 * int((depths * (weight[into] - self.weight)).sum())
        # The two largest heights of a group meet.
        order = np.lexsort((-height, into))
        place = np.arange(n) - np.searchsorted(into[order], into[order])
        second = order[place == 1]
        top = np.zeros(n, np.int64)
        top[into[order[place == 0]]] = height[order[place == 0]]
        if len(second):
            self.far = max(self.far, int((top[into[second]] + height[second]).max()))
        self.weight, self.height = weight, top
        self.depths = np.bincount(into, depths, n).astype(np.int64)
        self._keep(np.unique(into))

    def _join_leaves(self) -> None:
        """Nodes with one neighbour join it, one deeper."""
        n = len(self.weight)
        if n <= 2:
            return
        degree = np.bincount(self.v, minlength=n)
        leaf = degree == 1
        into = np.arange(n)
        ends = leaf[self.v]
        into[self.v[ends]] = self.u[ends]
        self._merge(into, (into != np.arange(n)).astype(np.int64))

    def _join_twins(self) -> None:
        """Nodes with the same neighbours become one; they are two apart through any of these."""
        n = len(self.weight)
        if n <= 2:
            return
        order = np.lexsort((self.u, self.v))
        u = self.u[order]
        starts = np.flatnonzero(np.diff(self.v[order], prepend=-1))
        degree = np.diff(np.append(starts, len(u)))
        mark = np.random.default_rng(0).integers(0, 1 << 63, n, dtype=np.uint64)
        held = np.add.reduceat(mark[u], starts)
        # Of each group of equal marks, the first; then all neighbours are compared.
        _, one, group = np.unique(held, return_index=True, return_inverse=True)
        first = one[group]
        like = np.flatnonzero((first != np.arange(n)) & (degree == degree[first]))
        if not len(like):
            return
        run = np.arange(degree[like].sum()) - np.repeat(np.cumsum(degree[like]) - degree[like], degree[like])
        same = u[np.repeat(starts[like], degree[like]) + run] == u[np.repeat(starts[first[like]], degree[like]) + run]
        whole = np.logical_and.reduceat(same, np.cumsum(degree[like]) - degree[like])
        into = np.arange(n)
        into[like[whole]] = first[like[whole]]
        twins = np.bincount(into, minlength=n)[into] > 1
        depths, top = np.bincount(into, self.depths, n).astype(np.int64), np.zeros(n, np.int64)
        np.maximum.at(top, into, self.height)
        # Twins meet one step below both, but do not lie deeper for others.
        self._merge(into, twins.astype(np.int64))
        self.depths, self.height = depths[np.unique(into)], top[np.unique(into)]


def links_of_small(
    pairs: DataFrame, snapshots: DataFrame, keys: Sequence[str], task_arcs: int
) -> tuple[DataFrame, DataFrame]:
    """Links of the snapshots that a task can hold, for :func:`giant_arcs`, and the other snapshots.

    Links are pairs ``_s, a, b`` of names, and for each snapshot a loop at a node of its giant component, with the
    component's size as ``n``.
    """
    keys = list(keys)
    linked = pairs.where(F.col("a") != F.col("b")).select(*keys, "a", "b")
    # All pairs of a snapshot, of which those of its giant component are no more.
    sizes = cut_lineage(linked.groupBy(*keys).agg((2 * F.count("*")).alias("_arcs")).join(snapshots, keys))
    small, large = sizes.where(F.col("_arcs") <= task_arcs), sizes.where(F.col("_arcs") > task_arcs)
    blank = F.lit(None).cast("bigint").alias("n")
    at = F.col("component")
    marks = small.select("_s", at.alias("a"), at.alias("b"), F.col("giant_component_size").alias("n"))
    links = linked.join(small.select(*keys, "_s"), keys).select("_s", "a", "b", blank).unionByName(marks)
    return links, large.drop("_arcs")


def giant_arcs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Arcs of the giant component of a snapshot's links, both ways; nodes are numbered in the order of their names."""
    names, a, b = _numbered_ends(table)
    mark = int(np.flatnonzero(pc.is_valid(table.column("n")).to_numpy())[0])
    linked = smallest_linked(a, b, len(names))
    taken = linked == linked[a[mark]]
    n = int(taken.sum())
    if n != table.column("n")[mark].as_py():
        raise RuntimeError("a component is not connected by the given pairs")
    number = np.cumsum(taken) - 1
    held = taken[a] & (a != b)
    a, b = number[a[held]], number[b[held]]
    u, v = np.divmod(np.unique(np.minimum(a, b) * n + np.maximum(a, b)), n)
    return np.concatenate([u, v]), np.concatenate([v, u])


def _reduced_in_tasks(links: DataFrame) -> DataFrame:
    """Graphs of fewer nodes from which the distances of each snapshot follow; a task holds a snapshot.

    ``links`` are those of :func:`links_of_small`. Rows are pairs ``_s, u, v``, nodes ``_s, u, weight, height`` without ``v``, and
    a row without ``u``, whose weight and height are the sum and the largest of the distances that are known already.
    """

    def run(table: pa.Table) -> pa.Table:
        graph = Reduced(*giant_arcs(table))
        once = graph.u < graph.v
        n, m = len(graph.weight), int(once.sum())
        size = int(graph.weight.sum())
        # Between groups, depths count on both sides.
        known = graph.inside + 2 * int((graph.depths * (size - graph.weight)).sum())
        blank = pa.nulls(m, pa.int64())
        parts = [
            [graph.u[once], graph.v[once], blank, blank],
            [np.arange(n), pa.nulls(n, pa.int64()), graph.weight, graph.height],
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), np.array([known]), np.array([graph.far])],
        ]
        columns = [pa.concat_arrays([pa.array(p[i], pa.int64()) for p in parts]) for i in range(4)]
        names = ["_s", "u", "v", "weight", "height"]
        return pa.table([pa.repeat(table.column("_s")[0], len(columns[0])), *columns], names=names)

    return links.groupBy("_s").applyInArrow(run, "_s bigint, u bigint, v bigint, weight bigint, height bigint")


def _sums_in_tasks(links: DataFrame, sources: int) -> DataFrame:
    """``_s, _sum, _far``: distances summed over ordered pairs, and the largest, in parts that add up.

    A task holds a snapshot's reduced graph and searches some of its sources, so many that arcs times
    sources stay the same, ``sources`` being that product; so a large snapshot becomes many tasks, and a
    task's work has a bound.
    """
    spark = links.sparkSession
    reduced = cut_lineage(_reduced_in_tasks(links))
    known = reduced.where(F.col("u").isNull()).select("_s", F.col("weight").alias("_sum"), F.col("height").alias("_far"))
    rows = reduced.where(F.col("u").isNotNull())
    sizes = rows.groupBy("_s").agg((2 * F.count("v")).alias("_arcs"), F.count("weight").alias("_n")).where("_n > 1")
    # Whole batches of sources, where there is room for one.
    batch = 64 * MOST_WORDS
    per_task = F.floor(F.lit(sources) / F.col("_arcs"))
    per_task = F.when(per_task >= batch, per_task - per_task % batch).otherwise(F.greatest(F.lit(64).cast("bigint"), per_task))
    chunks = cut_lineage(
        sizes.select("_s", "_arcs", "_n", per_task.alias("_per")).withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / F.col("_per")).cast("int") - 1))
        )
    )

    def search(table: pa.Table) -> pa.Table:
        first = table.column("_part")[0].as_py() * table.column("_per")[0].as_py()
        count = min(table.column("_per")[0].as_py(), table.column("_n")[0].as_py() - first)
        is_pair = pc.is_valid(table.column("v"))
        held, nodes = table.filter(is_pair), table.filter(pc.invert(is_pair)).sort_by("u")
        u, v = held.column("u").to_numpy(), held.column("v").to_numpy()
        total, far = weighted_distances(
            np.concatenate([u, v]),
            np.concatenate([v, u]),
            nodes.column("weight").to_numpy(),
            nodes.column("height").to_numpy(),
            first,
            count,
            HELD_WORDS,
        )
        columns = [[table.column("_s")[0].as_py()], [total], [far]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["_s", "_sum", "_far"])

    # Dealt out by work: the planner, which sees few bytes, would leave it to few tasks.
    own = F.least(F.col("_per"), F.col("_n")).cast("double") * F.col("_arcs")
    number, work = chunks.agg(F.count("*"), F.coalesce(F.sum(own), F.lit(0.0))).first()
    tasks = max(1, min(number, max(2 * spark.sparkContext.defaultParallelism, math.ceil(work / PART_WORK))))
    dealt = rows.join(chunks.drop("_arcs"), "_s").repartition(tasks, "_s", "_part")
    searched = dealt.groupBy("_s", "_part").applyInArrow(search, "_s bigint, _sum bigint, _far bigint")
    return known.unionByName(searched)


def _counts_by_joins(arcs: DataFrame, nodes: DataFrame, sizes: DataFrame, most_rows: int) -> list[DataFrame]:
    """Pairs per snapshot and distance, a table per pass: no task holds a snapshot.

    A step joins the newest words to the edges and ORs them. Edges lead both ways, so a node next to
    one at distance ``d`` is itself at ``d - 1``, ``d`` or ``d + 1``: what is new is known from the last
    two steps, and a step writes new bits alone. How many pairs there are to find is known beforehand,
    and each step counts what it finds as it writes, so a pass takes one job per distance and one that
    sums up. As many sources are searched at once as keep a step within ``most_rows`` rows.
    """
    spark = arcs.sparkSession
    total = nodes.count()
    words = max(1, most_rows // max(1, total))
    word = F.floor(F.col("_i") / 64).cast("int")
    counted = nodes.groupBy("_s", F.floor(word / words).cast("int").alias("_pass")).agg(F.count("*").alias("_c"))
    wanted = counted.join(sizes, "_s").groupBy("_pass").agg(F.sum(F.col("_c") * (F.col("_n") - 1)).alias("_pairs"))
    found = []
    # One row per pass.
    for number, pairs_wanted in sorted(tuple(r) for r in wanted.collect()):
        sources = nodes.where(word.between(number * words, (number + 1) * words - 1)).select(
            "_s", F.col("_i").alias("node"), word.alias("word"), F.expr("shiftleft(1L, CAST(_i % 64 AS INT))").alias("fresh")
        )
        folders, steps = [], []
        before, newest, pairs_found = None, sources, 0
        while pairs_found < pairs_wanted:
            near = arcs.join(newest.withColumnRenamed("node", "u"), ["_s", "u"]).select(
                "_s", F.col("v").alias("node"), "word", F.lit(0).cast("bigint").alias("held"), F.col("fresh").alias("near")
            )
            known = newest if before is None else newest.unionByName(before)
            held = known.select("_s", "node", "word", F.col("fresh").alias("held"), F.lit(0).cast("bigint").alias("near"))
            step = (
                held.unionByName(near)
                .groupBy("_s", "node", "word")
                .agg(F.bit_or("near").bitwiseAND(F.bitwise_not(F.bit_or("held"))).alias("fresh"))
                .where(F.col("fresh") != 0)
            )
            seen = Observation()
            folders.append(fresh_folder(spark, "paths"))
            bits = F.coalesce(F.sum(F.bit_count("fresh")), F.lit(0).cast("bigint"))
            before, newest = newest, cut_lineage(step.observe(seen, bits.alias("bits")), folders[-1])
            steps.append(newest.select("_s", F.lit(len(folders)).alias("_d"), F.bit_count("fresh").cast("bigint").alias("_pairs")))
            if not seen.get["bits"]:
                raise RuntimeError("a component is not connected by the given pairs")
            pairs_found += seen.get["bits"]
        counts = reduce(DataFrame.unionByName, steps).groupBy("_s", "_d").agg(F.sum("_pairs").alias("_pairs"))
        found.append(cut_lineage(counts))
        for folder in folders:
            drop_folder(spark, folder)
    return found


def path_metrics(
    pairs: DataFrame,
    components: DataFrame,
    keys: Sequence[str],
    task_arcs: int = TASK_ARCS,
    task_work: int = TASK_WORK,
    most_rows: int = 1 << 28,
) -> DataFrame:
    """Mean shortest path and diameter of the giant component; null for a single node.

    Which sources a node is reached from is a set of numbered sources, in words of 64 bits that spread
    along the edges step by step. Distances are then sums of bit counts, and no pair of nodes becomes a
    row. Of snapshots with up to ``task_arcs`` arcs a task holds all arcs and searches a part of the
    sources, after leaves and nodes with the same neighbours have been joined to groups; larger ones are
    searched by joins. Both count the same pairs. ``pairs`` and ``components`` are read more than once.
    """
    keys = list(keys)
    giant = cut_lineage(giant_component(components, keys))
    snapshots = numbered_snapshots(giant)
    links, large = links_of_small(pairs, snapshots, keys, task_arcs)
    found = [_sums_in_tasks(links, task_work)]
    if not large.isEmpty():
        _, nodes, arcs = numbered_graph(pairs, components, keys, large)
        counts = _counts_by_joins(arcs, nodes, large.select("_s", F.col("giant_component_size").alias("_n")), most_rows)
        # A snapshot has a row per pass and distance.
        found += [
            c.select("_s", (F.col("_pairs") * F.col("_d")).alias("_sum"), F.col("_d").cast("bigint").alias("_far"))
            for c in counts
        ]
    base = giant.select(*keys, "giant_component_size", "giant_component_fraction")
    size = F.col("giant_component_size")
    lengths = (
        reduce(DataFrame.unionByName, found)
        .groupBy("_s")
        .agg(F.sum("_sum").alias("_sum"), F.max("_far").cast("int").alias("diameter"))
        .join(snapshots.select(*keys, "_s"), "_s")
        .drop("_s")
    )
    return base.join(lengths, keys, "left").select(
        *keys,
        "giant_component_size",
        "giant_component_fraction",
        ratio(F.col("_sum"), size * (size - 1)).alias("avg_shortest_path"),
        "diameter",
    )
