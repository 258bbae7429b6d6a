"""Near-duplicates: fast similarity sketches, banding, and links confirmed on full shingle sets.

The sketch of a set has ``SLOTS`` slots. In round ``i`` every element is hashed to a slot and a value,
and a slot keeps the smallest pair of round and value it sees; a second series of rounds sends all
elements to one slot each, so after ``2 * SLOTS`` rounds every slot is filled for certain, and two
sketches agree in a share of slots that concentrates around the sets' similarity (Dahlgaard, Knudsen
and Thorup, 2017). Rounds stop as soon as all slots are filled.

Slots are taken in bands. Documents that agree in a band are compared, first all with the smallest of
them, then, where the documents of a band have not become connected by that, with each other as far
as their whole sketches let a link be possible. Every link is confirmed on the full sets. Documents
with equal sets are one document in all of this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.blocks import block_count, documents_of, in_blocks, mixed, runs_of
from tideline.llm.repeats import STEP_BYTES, gram_hashes
from tideline.operators.components import components_by_rounds
from tideline.session import drop_folder, fresh_folder

#: With 32 bands of 4 slots a pair at similarity 0.8 shares no band with a probability below 1e-7.
SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
#: Slots in which two sketches agree at least if a link is possible: at similarity 0.8 fewer agree with
#: a probability below 1e-6. Bands and this number fit that similarity and larger ones.
LEAST_AGREED, LEAST_PERCENT = 80, 80
#: Documents of a band or cluster that are compared in one task with as many others.
CHUNK = 2048


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Distinct hashes of runs of ``size`` words; of the whole sequence where it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(gram_hashes(hashes, min(size, len(words))))


def sketch(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The slots' values, 16 bits of each."""
    filled = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for i in range(2 * slots):
        hashes = mixed(elements + np.uint64((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        # The round stands above the value, so an earlier round's entry is never replaced.
        values = (hashes >> np.uint64(8)) | (np.uint64(min(i, 254)) << np.uint64(56))
        if i < slots:
            np.minimum.at(filled, (hashes % np.uint64(slots)).astype(np.intp), values)
        else:
            filled[i - slots] = min(filled[i - slots], values.min())
        if filled.max() < np.iinfo(np.uint64).max:
            break
    return (mixed(filled) >> np.uint64(48)).astype(np.uint16)


_SKETCHES = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary())]
)


def _words_of_block(table: pa.Table) -> Iterator[tuple[int, list[bytes]]]:
    ids, texts, _ = documents_of(table)
    for a, b in runs_of([len(t) for t in texts], STEP_BYTES):
        for i in range(a, b):
            # ASCII letters only, as bytes are lower-cased.
            yield int(ids[i]), texts[i].lower().split()


def sketched(blocks: DataFrame, size: int) -> DataFrame:
    """Per document its set's size, digest and sketch; the last two are null for an empty set."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        for doc, words in _words_of_block(table):
            found = shingles(words, size)
            if len(found):
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                rows.append((doc, len(found), digest, sketch(found).tobytes()))
            else:
                rows.append((doc, 0, None, None))
        return pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _SKETCHES)], schema=_SKETCHES
        )

    return blocks.groupBy("block").applyInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, sketch binary")


def full_sets(blocks: DataFrame, wanted: DataFrame, count: int, size: int) -> DataFrame:
    """The shingle sets of the documents in ``wanted`` (``doc_id``), looked up in their blocks."""

    def block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array((mixed(ids.view(np.uint64)) % np.uint64(count)).astype(np.int32)), batch.column("doc_id")],
                ["block", "doc_id"],
            )

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        needed = set(asked.column("doc_id").to_pylist())
        docs, sets = [], []
        if needed:
            for doc, words in _words_of_block(table):
                if doc in needed:
                    # Of rows with one id the first stands for all.
                    needed.discard(doc)
                    docs.append(doc)
                    sets.append(shingles(words, size).view(np.int64))
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        return pa.Table.from_arrays(
            [pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "shingles"]
        )

    asked = wanted.mapInArrow(block_of, "block int, doc_id bigint")
    return (
        blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, "doc_id bigint, shingles array<bigint>")
    )


class _Scratch:
    """Steps written as Parquet to the shared folder; those that the result does not read are removed in the end."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.spent: list[str] = []

    def written(self, df: DataFrame, stem: str, kept: bool = False) -> DataFrame:
        folder = fresh_folder(self.spark, stem)
        df.write.parquet(folder)
        if not kept:
            self.spent.append(folder)
        return self.spark.read.parquet(folder)

    def clear(self) -> None:
        for folder in self.spent:
            drop_folder(self.spark, folder)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets have at least ``percent`` of their union in common."""
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b").join(
        sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a"
    )
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("n"), (F.size("x") + F.size("y")).alias("m")).where(
        F.col("n") * 100 >= (F.col("m") - F.col("n")) * percent
    ).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``doc_id`` and ``component``, its smallest linked document, for every document in ``links``.

    Rounds grow with the logarithm of a component's diameter, so chains of revisions take few.
    """
    pairs = links.select(F.lit(0).alias("all"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nodes = pairs.select("all", F.explode(F.array("a", "b")).alias("node")).distinct()
    found = components_by_rounds(pairs, nodes, ["all"])
    return found.select(F.col("node").alias("doc_id"), "component")


def _band_rows(reps: DataFrame) -> DataFrame:
    """One row per document and band, with the band's slots as its key."""
    return reps.select(
        F.col("rep"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(BANDS - 1)),
                lambda i: F.substring(F.col("sketch"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)),
            )
        ).alias("band", "key"),
    )


class _Joined:
    """Which of some labels have been joined: a union-find over their places in an array."""

    def __init__(self, labels: np.ndarray):
        self.names, self.of = np.unique(labels, return_inverse=True)
        self.up = list(range(len(self.names)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Join two labels by place; false if they were joined before."""
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _slots(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, SLOTS)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=_PAIR)


def _possible_joins(members: DataFrame) -> DataFrame:
    """Pairs of components that links may join, as a forest per band.

    ``members`` has band, key, rep, component, sketch and the band's number of members. A task
    compares the sketches of a band's members; of the pairs of different components that agree in
    ``LEAST_AGREED`` slots it gives out only those that join components not yet joined, so fewer rows
    leave a band than enter it. A large band is cut into chunks by hash, every two of which meet.
    """
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    placed = members.withColumn("_chunks", chunks).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_chunks")))
    spread = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_other")).select(
        "band",
        "key",
        F.least("_own", "_other").alias("lo"),
        F.greatest("_own", "_other").alias("hi"),
        "_own",
        "component",
        "sketch",
    )

    def run(table: pa.Table) -> pa.Table:
        joined = _Joined(table.column("component").to_numpy())
        own, lo, hi = table.column("_own").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        slots, of = _slots(table), joined.of
        first, second = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        found = []
        for i in first:
            rest = second[(of[second] != of[i]) & ((second > i) | (lo != hi))]
            hit = rest[(slots[rest] == slots[i]).sum(axis=1) >= LEAST_AGREED]
            for c in np.unique(of[hit]):
                if joined.join(of[i], c):
                    found.append((int(joined.names[of[i]]), int(joined.names[c])))
        return _pairs(found)

    return spread.groupBy("band", "key", "lo", "hi").applyInArrow(run, "a bigint, b bigint")


def _links_in_clusters(members: DataFrame, percent: int) -> DataFrame:
    """Links between the components of a cluster, confirmed on full sets inside the tasks.

    ``members`` has cluster, component, rep, sketch and shingles. Documents of a cluster's largest
    component need no comparison with each other: the documents of its other components meet all.
    Either side is cut into chunks by hash, and every two chunks meet in one task. Links that join
    nothing new there are not given out, so their number is below that of the documents.
    """
    per_component = members.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    per_cluster = per_component.groupBy("cluster").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"),
        F.sum("n").alias("all"),
        (F.sum("n") - F.max("n")).alias("others"),
    )
    sized = members.join(
        per_cluster.select(
            "cluster",
            "largest",
            F.ceil(F.col("all") / CHUNK).cast("int").alias("columns"),
            F.ceil(F.col("others") / CHUNK).cast("int").alias("rows"),
        ),
        "cluster",
    )
    kept = ("cluster", "component", "rep", "sketch", "shingles")
    own = F.xxhash64("rep")
    other_side = sized.where(F.col("component") != F.col("largest")).select(
        *kept,
        F.lit(True).alias("other"),
        F.pmod(own, F.col("rows")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"),
    )
    all_side = sized.select(
        *kept,
        F.lit(False).alias("other"),
        F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"),
        F.pmod(own, F.col("columns")).cast("int").alias("j"),
    )

    def run(table: pa.Table) -> pa.Table:
        joined = _Joined(table.column("component").to_numpy())
        slots, of, reps = _slots(table), joined.of, table.column("rep").to_numpy()
        shingles = table.column("shingles").combine_chunks()
        ends, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy()
        other = table.column("other").to_numpy(zero_copy_only=False)
        second = np.flatnonzero(~other)
        found = []
        for i in np.flatnonzero(other):
            rest = second[of[second] != of[i]]
            agreed = (slots[rest] == slots[i]).sum(axis=1)
            mine = flat[ends[i] : ends[i + 1]]
            # The most alike first, as they join what the less alike need not be compared for.
            for k in np.argsort(-agreed, kind="stable"):
                if agreed[k] < LEAST_AGREED:
                    break
                j = rest[k]
                if joined.root(of[i]) == joined.root(of[j]):
                    continue
                theirs = flat[ends[j] : ends[j + 1]]
                shared = len(np.intersect1d(mine, theirs, assume_unique=True))
                if 100 * shared >= percent * (len(mine) + len(theirs) - shared):
                    joined.join(of[i], of[j])
                    found.append((int(min(reps[i], reps[j])), int(max(reps[i], reps[j]))))
        return _pairs(found)

    # Dealt by all three keys: by the cluster alone all chunks of a large one would meet in one task.
    tasks = all_side.unionByName(other_side).repartition("cluster", "i", "j")
    return tasks.groupBy("cluster", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``.

    A document with a null, empty or blank text has an empty set, is linked with nothing and is its
    own component. Rows with one id are one document: each gets its row, with the set of its own text;
    links are those of the first text in order. A null id takes part as the largest id and comes out
    as null again; where it is linked with nothing, so is its component. Other columns are not looked at.
    A ``percent`` below ``LEAST_PERCENT`` is refused.
    """
    from tideline.llm.blocks import NO_ID

    if percent < LEAST_PERCENT:
        raise ValueError(f"links below {LEAST_PERCENT} percent may be missed: {percent}")
    scratch = _Scratch(docs.sparkSession)
    count = block_count(docs)
    blocks = in_blocks(docs, count)
    table = scratch.written(sketched(blocks, size), "sketches", kept=True)
    reps = table.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")
    )
    reps = scratch.written(reps, "reps", kept=True)

    rows = _band_rows(reps)
    hubs = rows.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
    joined = scratch.written(rows.join(hubs, ["band", "key"]), "bands")
    stars = joined.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    stars = scratch.written(stars, "stars")
    sets = full_sets(blocks, _ends(stars), count, size)
    links = scratch.written(confirmed(stars, sets, percent), "links")

    labels = scratch.written(components(links), "labels", kept=True)
    labelled = joined.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    open_bands = (
        labelled.groupBy("band", "key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("size").alias("size"))
        .where("low != high")
        .select("band", "key")
    )
    members = labelled.join(open_bands, ["band", "key"]).join(reps.select("rep", "sketch"), "rep")
    joins = scratch.written(_possible_joins(members).distinct(), "joins")
    if not joins.isEmpty():
        clusters = components(joins).select(F.col("doc_id").alias("component"), F.col("component").alias("cluster"))
        of_rep = reps.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select(
            "rep", "sketch", F.coalesce("component", "rep").alias("component")
        )
        inside = scratch.written(of_rep.join(clusters, "component"), "clusters")
        sets = full_sets(blocks, inside.select(F.col("rep").alias("doc_id")), count, size)
        inside = scratch.written(inside.join(sets.withColumnRenamed("doc_id", "rep"), "rep"), "clusters")
        more = scratch.written(_links_in_clusters(inside, percent), "links")
        if not more.isEmpty():
            labels = scratch.written(components(links.union(more)), "labels", kept=True)
    scratch.clear()

    of_digest = reps.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id")
    )
    null_id = F.col("doc_id") == NO_ID
    found = table.select("doc_id", "n_shingles", "digest").join(of_digest, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        F.when(~null_id, F.col("doc_id")).alias("doc_id"),
        "n_shingles",
        F.when(component != NO_ID, component).alias("component_id"),
        (F.col("doc_id") == component).alias("kept"),
    )


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def keep_one_of_each(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component."""
    kept = near_duplicates(docs, size, percent).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
