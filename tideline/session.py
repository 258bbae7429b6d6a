"""Session settings and the shared folder used to cut long lineages."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "tideline", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; a cluster supplies the rest."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A session whose executors are threads of one process may go without the setting: it gets a
    folder of its own, removed when the process ends. Elsewhere such a folder would be lost with its
    machine, so the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        own = tempfile.mkdtemp(prefix="tideline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
        current = context.getCheckpointDir()
    return current


def fresh_folder(spark: SparkSession, stem: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex[:12]}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that was written below the shared one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def finished_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` whose writing job ended, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(f.getPath().getParent().getName() for f in found or [])


def cut_lineage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` down as Parquet and read it back, so that later steps neither recompute it nor see other rows.

    Readers take only the columns they need. ``folder`` is the place, by default a new one.
    """
    spark = df.sparkSession
    folder = folder or fresh_folder(spark, "cut")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


class Rounds:
    """States of a loop, written down one after the other; only the last two are kept."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: list[str] = []

    def cut(self, state: DataFrame) -> DataFrame:
        self.folders.append(fresh_folder(self.spark, "round"))
        held = cut_lineage(state, self.folders[-1])
        if len(self.folders) > 2:
            drop_folder(self.spark, self.folders.pop(0))
        return held


def size_in_bytes(df: DataFrame) -> int:
    """What the planner knows of a table's size; for one that ``cut_lineage`` wrote, its files' bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def sized_side(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """A join side that is broadcast only once its size is known to be small.

    The side is written down and measured; above ``most_bytes`` it joins by shuffle instead.
    """
    held = cut_lineage(df)
    return F.broadcast(held) if size_in_bytes(held) <= most_bytes else held
