"""Exact quantiles, ranks and row numbers of groups of any size.

``percentile`` keeps every distinct value of a group in one task, and a window over a group sorts
it in one task. Both are fine for months or degrees, whose distinct values are few, and both fail
where one community holds a third of all users. Here a group is first split into bins that follow
the order of its values: counting bins is cheap, and only single bins are ever sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import cut_lineage

# Bins per power of two; a bin spans 1/4096 of its value, whatever the magnitude.
BINS_PER_OCTAVE = 4096
_OCTAVES = 1100


def value_bin(value: Column) -> Column:
    """A bin number that never decreases as the value grows.

    The exponent may be rounded up just below a power of two; exponent and remainder then move
    together, so the order of the bins still holds.
    """
    size = F.abs(value)
    octave = F.floor(F.log2(size))
    within = F.floor(size / F.pow(F.lit(2.0), octave) * BINS_PER_OCTAVE)
    place = (octave + _OCTAVES) * BINS_PER_OCTAVE + within
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, place).otherwise(-place).cast("bigint")


def _counted(df: DataFrame, keys: Sequence[str], value: str, weights: Mapping[str, Column]) -> DataFrame:
    """One row per distinct value of a group, with the summed weights and the bin."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(*[F.sum(weight).alias(name) for name, weight in weights.items()])
        .withColumn("_bin", value_bin(F.col("_v")))
    )


def _bin_offsets(counted: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per bin, the weight below it. The window sees bins, not rows: their number is bounded."""
    below = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counted.groupBy(*keys, "_bin").agg(*[F.sum(n).alias(f"_in_{n}") for n in names])
    return bins.select(
        *keys,
        "_bin",
        *[F.col(f"_in_{n}") for n in names],
        *[F.coalesce(F.sum(f"_in_{n}").over(below), F.lit(0)).alias(f"_below_{n}") for n in names],
    )


def running_weights(
    df: DataFrame, keys: Sequence[str], value: str, weights: Mapping[str, Column], small_groups: bool = False
) -> DataFrame:
    """Per distinct value ``value``: the weight at it (``name``) and below it (``name_below``).

    ``small_groups`` is for groups bounded by the months of a series: one window sorts each.
    """
    names = list(weights)
    if small_groups:
        counted = (
            df.where(F.col(value).isNotNull())
            .groupBy(*keys, F.col(value).cast("double").alias(value))
            .agg(*[F.sum(weight).alias(name) for name, weight in weights.items()])
        )
        below = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counted.select(
            "*", *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"{n}_below") for n in names]
        )
    counted = _counted(df, keys, value, weights)
    offsets = _bin_offsets(counted, keys, names)
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    joined = counted.join(offsets, [*keys, "_bin"])
    return joined.select(
        *keys,
        F.col("_v").alias(value),
        *names,
        *[
            (F.col(f"_below_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_below")
            for n in names
        ],
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group: one row per group, one column per entry of ``probs``."""
    counted = _counted(df, keys, value, {"_c": F.lit(1)})
    offsets = _bin_offsets(counted, keys, ["_c"])
    whole = Window.partitionBy(*keys)
    offsets = offsets.withColumn("_n", F.sum("_in__c").over(whole))

    def ends(p: float) -> tuple[Column, Column]:
        place = F.lit(float(p)) * (F.col("_n") - 1)
        return F.floor(place), F.ceil(place)

    def covers(position: Column, start: Column, width: Column) -> Column:
        return (position >= start) & (position < start + width)

    needed = F.lit(False)
    for p in probs.values():
        for end in ends(p):
            needed = needed | covers(end, F.col("_below__c"), F.col("_in__c"))
    bins = offsets.where(needed)

    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_below__c") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
    picked = counted.join(bins, [*keys, "_bin"]).withColumn("_start", start)

    aggs = []
    for i, p in enumerate(probs.values()):
        for side, end in zip(("lo", "hi"), ends(p)):
            hit = covers(end, F.col("_start"), F.col("_c"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
    aggs.append(F.max("_n").alias("_n"))
    grouped = picked.groupBy(*keys).agg(*aggs) if keys else picked.agg(*aggs)
    columns = []
    for i, (name, p) in enumerate(probs.items()):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        share = place - F.floor(place)
        columns.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share).alias(name))
    return grouped.select(*keys, *columns)


def numbered_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "row_number"
) -> DataFrame:
    """``row_number`` over groups of any size.

    Rows are range-partitioned by group and order, so a large group spreads over many tasks; the
    placement is written down once, and each piece of a group is then numbered from where the
    previous piece ends.
    """
    placed = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    placed = cut_lineage(placed.withColumn("_piece", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys, "_piece").agg(F.count("*").alias("_size"))
    offsets = sizes.select(*keys, "_piece", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_piece").orderBy(*order)
    return (
        placed.withColumn("_local", F.row_number().over(within))
        .join(offsets, [*keys, "_piece"])
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_local", "_offset", "_piece")
    )
