"""Reputation by period: each stretch of time is read once, and a later one starts from the last summary.

What earlier periods left of a user is one row, whose value enters decayed and whose open run goes on. It
stands before the user's first piece of a day as if it were one, so that a run takes the steps of
``reputation_events`` over its own activities and one row per user, in two shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.timeparts import SECONDS_PER_DAY, unix_micros_seconds
from tideline.operators.reputation import SCOPE, ReputationModel, day_pieces, running_reputation, scope_bounds
from tideline.session import cut_lineage, finished_folders, sized_side

def reputation_of_periods(
    activity: DataFrame,
    origins: DataFrame,
    model: ReputationModel,
    carried: DataFrame | None = None,
    scope: Sequence[str] = SCOPE,
) -> tuple[DataFrame, DataFrame]:
    """Rows as ``reputation_events`` gives them, with their ``period``, and what each user carries on.

    ``activity`` has a ``period`` that grows with time; a day may lie in two. ``origins`` has ``t_min``
    per scope, from which days are counted. ``carried`` is what earlier periods left; the last row of
    such a user is given again, with its next day.
    """
    keys = [*scope, "user_id"]
    place = (unix_micros_seconds(F.col("ts")) - F.col("t_min")) / SECONDS_PER_DAY
    clocked = (
        activity.where(F.col("period").isNotNull())
        .select(*scope, "user_id", "ts", "period")
        .join(sized_side(origins.select(*scope, "t_min")), list(scope))
        .select(*keys, "period", place.alias("_place"), F.floor(place).cast("int").alias("day"))
    )
    pieces = day_pieces(clocked, [*keys, "period"]).withColumn("_entered", F.lit(None).cast("double"))
    if carried is not None:
        # What was carried stands before the first piece.
        held = carried.select(
            *keys,
            F.lit("").alias("period"),
            "day",
            F.lit(0).cast("bigint").alias("_piece"),
            F.lit(None).cast("array<double>").alias("_places"),
            F.col("run_events").alias("n_events"),
            "last_place",
            F.col("value").alias("_entered"),
        )
        pieces = pieces.unionByName(held)
    order = ("period", "day", "_piece")
    following = F.lead("period").over(Window.partitionBy(*keys).orderBy(*order))
    # Both results read it.
    steps = cut_lineage(
        running_reputation(pieces, keys, model, order, "_entered")
        .withColumn("_following", following)
        .select(
            *keys,
            "period",
            "day",
            (F.col("_before") + F.col("n_events")).alias("run_events"),
            "last_place",
            "next_day",
            F.col("_value").alias("value"),
            F.col("_entered").isNotNull().alias("_held"),
            "_following",
        )
    )
    # A day that goes on in a later period is whole only there; what was carried shows once it has a next day.
    goes_on = F.col("next_day") == F.col("day")
    shown = F.when(F.col("next_day").isNull(), ~F.col("_held")).otherwise(~goes_on)
    rows = steps.where(shown).select(
        *keys,
        F.when(F.col("_held"), F.col("_following")).otherwise(F.col("period")).alias("period"),
        "day",
        "run_events",
        (F.col("last_place") - F.col("day")).alias("day_fraction"),
        "next_day",
        F.col("value").alias("reputation"),
    )
    left = steps.where(F.col("next_day").isNull()).select(*keys, "day", "last_place", "run_events", "value")
    return rows, left


class ReputationStore:
    """Reputation rows kept by the run that made them, with what the last run carries on.

    A run is named by its last period. It reads its own activities and what the run before it left; its
    rows and what it leaves are written to folders of its own, the latter last, which commits it. The
    newest run may be repeated; a run between others may not, as later ones build on it.
    """

    def __init__(self, spark: SparkSession, folder: str, model: ReputationModel, scope: Sequence[str] = SCOPE):
        self.spark, self.folder, self.model, self.scope = spark, folder.rstrip("/"), model, list(scope)

    def _place(self, kind: str, run: str) -> str:
        return f"{self.folder}/{kind}/run={run}"

    def runs(self) -> list[str]:
        return [name.removeprefix("run=") for name in finished_folders(self.spark, f"{self.folder}/carried")]

    def append(self, activity: DataFrame, run: str) -> None:
        """Activities with their ``period`` (text that sorts by time), all after earlier runs and up to ``run``."""
        earlier = [r for r in self.runs() if r < run]
        if any(r > run for r in self.runs()):
            raise ValueError(f"there are later runs than {run}")
        activity = cut_lineage(activity.select(*self.scope, "user_id", "ts", "period"))
        span = activity.agg(F.min("period").alias("low"), F.max("period").alias("high")).first()
        if span.low is not None and (span.high > run or (earlier and span.low <= earlier[-1])):
            raise ValueError(f"periods {span.low} to {span.high} do not lie after {earlier[-1:]} and up to {run}")
        bounds = scope_bounds(activity, self.scope)
        carried = None
        if earlier:
            carried = self.spark.read.parquet(self._place("carried", earlier[-1]))
            known = self.spark.read.parquet(self._place("scopes", earlier[-1]))
            # The clock of a scope starts once.
            bounds = (
                known.withColumn("_new", F.lit(0))
                .unionByName(bounds.withColumn("_new", F.lit(1)))
                .groupBy(*self.scope)
                .agg(F.min_by("t_min", "_new").alias("t_min"), F.max("t_max").alias("t_max"))
            )
        bounds.write.mode("overwrite").parquet(self._place("scopes", run))
        origins = self.spark.read.parquet(self._place("scopes", run))
        rows, left = reputation_of_periods(activity, origins, self.model, carried, self.scope)
        rows.write.mode("overwrite").parquet(self._place("events", run))
        left.write.mode("overwrite").parquet(self._place("carried", run))

    def events(self) -> DataFrame:
        """All rows so far, as ``reputation_events`` gives them for all activities."""
        runs = self.runs()
        if not runs:
            raise ValueError("nothing has been appended")
        keys = [*self.scope, "user_id", "day"]
        held = self.spark.read.option("basePath", f"{self.folder}/events").parquet(*[self._place("events", r) for r in runs])
        rest = [c for c in held.columns if c not in (*keys, "period", "run")]
        later = F.lead("period").over(Window.partitionBy(*keys).orderBy("period"))
        newest = held.withColumn("_later", later).where(F.col("_later").isNull()).select(*keys, *rest)
        return newest.join(sized_side(self.spark.read.parquet(self._place("scopes", runs[-1]))), self.scope)
