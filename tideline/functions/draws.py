"""Random draws as hashes of their own coordinates.

A draw depends on the seed and on which draw it is, never on the partition that computes it, so a
retried task repeats it and any engine with md5 can check it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(*coordinates: Column) -> Column:
    """A hexadecimal key to sort by, which shuffles rows."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in coordinates]))


def draw_index(size: Column, *coordinates: Column) -> Column:
    """A draw from ``0 .. size - 1`` (48 bits of the key, so far larger groups than any here)."""
    bits = F.conv(F.substring(draw_key(*coordinates), 1, 12), 16, 10).cast("bigint")
    return F.when(size > 0, bits % size)
