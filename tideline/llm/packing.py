"""Length buckets with the least padding, and token-budget batches inside them.

The lengths of all documents are counted in cells: one cell per length up to a bound, cells of a
fixed relative width beyond it, so the histogram that reaches the driver has a proven size. A cell's top
is the largest length in it, so no padding comes from the cells themselves; only boundaries inside a cell
are not tried. Dynamic programming over the cells finds the bucket boundaries with the least padding.
Lengths are what the caller counts, words or tokens. Documents are then
numbered inside their buckets from counts per bucket and part, without sorting a bucket in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths up to this have a cell each; beyond it a power of two has as many cells as this has lengths / 8.
EXACT_UPTO = 4096
_PER_OCTAVE = EXACT_UPTO // 8


def cell_of(length: Column) -> Column:
    """The cell of ``length``, by the largest length that it may hold."""
    octave = F.floor(F.log2(length.cast("double") / EXACT_UPTO))
    step = F.pow(F.lit(2.0), octave) * (EXACT_UPTO // _PER_OCTAVE)
    return F.when(length <= EXACT_UPTO, length).otherwise((F.ceil(length / step) * step).cast("bigint"))


def optimal_boundaries(tops: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket ends, among cell tops, with the least padded total.

    With ``n(i)`` documents up to cell ``i``, ending a bucket there costs its top times the documents
    in it. ``cost[b][j]``, the least cost of the first ``j`` cells in ``b`` buckets, takes its minimum
    over the last bucket's first cell; that cell never moves down as ``j`` grows, so halving the range
    of ``j`` bounds the search. Ties take the smallest first cell.
    """
    m = len(tops)
    if m == 0:
        return []
    below = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    buckets = min(buckets, m)
    cost = np.full(m + 1, np.inf)
    cost[0] = 0.0
    picks = []
    for _ in range(buckets):
        new, pick = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[0] = 0.0
        work = [(1, m, 0, m - 1)]
        while work:
            lo, hi, first, last = work.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            starts = np.arange(first, min(last, j - 1) + 1)
            totals = cost[starts] + tops[j - 1] * (below[j] - below[starts])
            k = int(np.argmin(totals))
            new[j], pick[j] = totals[k], starts[k]
            work += [(lo, j - 1, first, int(starts[k])), (j + 1, hi, int(starts[k]), last)]
        cost = new
        picks.append(pick)
    ends, j = [], m
    for pick in reversed(picks):
        if j == 0:
            break
        ends.append(int(tops[j - 1]))
        j = int(pick[j])
    return sorted(set(ends))


def length_histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cell tops and counts, ascending. Their number is bounded by ``EXACT_UPTO + 64 * EXACT_UPTO / 8``."""
    held = lengths.groupBy(cell_of(F.col("length")).alias("cell")).agg(F.max("length").alias("top"), F.count("*").alias("n"))
    cells = held.select("top", "n").orderBy("top").collect()
    return np.array([r[0] for r in cells], np.int64), np.array([r[1] for r in cells], np.int64)


def packed(
    lengths: DataFrame, token_budget: int = 65_536, buckets: int = 16, parts: int | None = None
) -> DataFrame:
    """``lengths`` (``doc_id``, ``length``) with bucket, batch and place in the batch.

    A bucket takes lengths up to its ``padded_length``; a batch of it takes as many documents as
    keep ``documents * padded_length`` within ``token_budget``, and one where a single document is
    longer. Lengths of 0 are batched like others, with a padded length of 0 where their bucket holds
    nothing longer; null lengths count as 0. Every row gets a place: of repeated rows each its own.
    Only the last batch of a bucket may be short. ``parts`` are the pieces a bucket is numbered in.
    """
    lengths = lengths.select("doc_id", F.coalesce(F.col("length"), F.lit(0)).cast("bigint").alias("length"))
    ends = optimal_boundaries(*length_histogram(lengths), buckets)
    parts = parts or 4 * int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.lit(0)
    for end in ends[:-1]:
        bucket = bucket + (F.col("length") > end).cast("int")
    tops = F.array(*[F.lit(e).cast("bigint") for e in ends]) if ends else F.array().cast("array<bigint>")
    placed = (
        lengths.withColumn("bucket", bucket)
        .withColumn("padded_length", F.get(tops, F.col("bucket")))
        .withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    )
    sizes = placed.groupBy("bucket", "_part").agg(F.count("*").alias("_size"))
    # At most buckets * parts rows.
    earlier = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("bucket", "_part").orderBy("doc_id", "length")
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest("padded_length", F.lit(1))))
    return (
        placed.withColumn("_n", F.row_number().over(inside))
        .join(offsets, ["bucket", "_part"])
        .withColumn("_n", F.col("_n") + F.col("_offset") - 1)
        .withColumn("_per", per_batch)
        .select(
            "doc_id",
            "length",
            "bucket",
            "padded_length",
            F.floor(F.col("_n") / F.col("_per")).cast("bigint").alias("batch"),
            (F.col("_n") % F.col("_per")).cast("bigint").alias("place"),
            (F.col("padded_length") - F.col("length")).alias("padding"),
        )
    )
