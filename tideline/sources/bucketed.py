"""Tables dealt into hash buckets of user and month, a layout that later joins and sums need not shuffle.

Rows lie in the bucket that the hash of their bucket columns names, in every table with as many buckets.
Joins and aggregations over these columns then read matching buckets side by side. The planner asks that
the bucket columns are all columns of a join, unless ``spark.sql.requireAllClusterKeysForCoPartition`` is
off; a user's rows then spread over the buckets by month, which a single busy user gains from. The layout
is written down beside the files, so that any session can open the table again.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tideline.operators.rollups import SCOPE

#: Columns that user-months and days of reputation have in common.
USER_MONTH = (*SCOPE, "user_id", "month")
_LAYOUT = "schema string, columns array<string>, buckets int"
#: Keys of a bucket, and the fewest buckets.
BUCKET_KEYS, LEAST_BUCKETS = 1 << 16, 16


def bucket_count(keys: int) -> int:
    """So many buckets that one holds ``BUCKET_KEYS`` of ``keys``: a task's share stays the same as tables grow."""
    return max(LEAST_BUCKETS, math.ceil(keys / BUCKET_KEYS))


def write_bucketed(df: DataFrame, path: str, buckets: int, columns: Sequence[str] = USER_MONTH) -> DataFrame:
    """Write ``df`` as Parquet in ``buckets`` buckets of ``columns``, sorted by them, and open it.

    A former table at ``path`` is replaced. Rows are dealt as buckets are before they are written, so a
    bucket is one file.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *columns)
    dealt.write.bucketBy(buckets, *columns).sortBy(*columns).option("path", path).mode("overwrite").saveAsTable(name)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    layout = [(ddl, list(columns), buckets)]
    spark.createDataFrame(layout, _LAYOUT).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_layout")
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_bucketed`` wrote, with its layout known to the planner."""
    layout = spark.read.schema(_LAYOUT).parquet(f"{path.rstrip('/')}/_layout").first()
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{c}`" for c in layout.columns)
    spark.sql(
        f"CREATE TABLE {name} ({layout.schema}) USING parquet "
        f"CLUSTERED BY ({columns}) SORTED BY ({columns}) INTO {layout.buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
