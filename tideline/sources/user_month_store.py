"""User-months and first activities that grow by files, each of which counts once.

A run takes the files it has not taken before, sums them up per user and month, and writes the sums and
then the list of files; the list commits the run. Sums of all committed runs add up to the user-months,
whatever the files' order, and a repeated run finds nothing new. A run that broke off before its list
was written has left sums that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.rollups import SCOPE
from tideline.session import finished_folders

_FILE = ("path", "length", "modificationTime")


class UserMonthStore:
    """Sums per user and month below ``folder``.

    ``read`` makes an activity log (scope, ``user_id``, ``ts``, ``month`` and the columns of ``scores``)
    of a list of files.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        read: Callable[[SparkSession, list[str]], DataFrame],
        scores: Mapping[str, str],
        scope: Sequence[str] = SCOPE,
    ):
        self.spark, self.folder, self.read = spark, folder.rstrip("/"), read
        self.scores, self.scope = dict(scores), list(scope)

    def _paths(self, kind: str) -> list[str]:
        return [f"{self.folder}/{kind}/{run}" for run in finished_folders(self.spark, f"{self.folder}/files")]

    def taken(self) -> DataFrame | None:
        """Files that have been taken, none as None."""
        paths = self._paths("files")
        return self.spark.read.parquet(*paths) if paths else None

    def new_files(self, source: str, pattern: str = "*.parquet") -> DataFrame:
        """Files below ``source`` that have not been taken as they are now. Their content is not read."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        listed = found.option("pathGlobFilter", pattern).load(source).select(*_FILE)
        taken = self.taken()
        return listed if taken is None else listed.join(taken, list(_FILE), "anti")

    def append(self, source: str, pattern: str = "*.parquet") -> int:
        """Take the new files below ``source``; how many there were.

        A file that was replaced since it was taken is refused: its old sums cannot be taken back.
        """
        files = [tuple(r) for r in self.new_files(source, pattern).collect()]
        if not files:
            return 0
        taken = self.taken()
        new = self.spark.createDataFrame(files, "path string, length bigint, modificationTime timestamp")
        if taken is not None and not new.join(taken, "path", "semi").isEmpty():
            raise ValueError("a file has changed since it was taken")
        activity = self.read(self.spark, [path for path, _, _ in files])
        sums = []
        for name, column in self.scores.items():
            sums += [F.sum(column).alias(f"{name}_sum"), F.count(column).alias(f"{name}_n")]
        parts = activity.groupBy(*self.scope, "user_id", "month").agg(
            *sums, F.count("*").alias("activity_count"), F.min("ts").alias("first_seen")
        )
        run = uuid.uuid4().hex
        parts.write.parquet(f"{self.folder}/sums/{run}")
        new.write.parquet(f"{self.folder}/files/{run}")
        return len(files)

    def _sums(self) -> DataFrame:
        paths = self._paths("sums")
        if not paths:
            raise ValueError("nothing has been taken")
        return self.spark.read.parquet(*paths)

    def user_months(self) -> DataFrame:
        """As ``user_month_metrics`` over all files that were taken."""
        means = [F.try_divide(F.sum(f"{n}_sum"), F.sum(f"{n}_n")).alias(n) for n in self.scores]
        return self._sums().groupBy(*self.scope, "user_id", "month").agg(
            *means, F.sum("activity_count").alias("activity_count")
        )

    def first_seen(self, keys: Sequence[str] = ("user_id",)) -> DataFrame:
        """First activity per ``keys`` over all files that were taken."""
        return self._sums().groupBy(*keys).agg(F.min("first_seen").alias("first_seen"))
