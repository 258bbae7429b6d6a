"""Checks of streams: what they end with is what a batch over all rows gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import reputation
from tideline.plans import standins
from tideline.plans.catalog import check, rounded
from tideline.plans.checks.reputation_checks import MODEL
from tideline.plans.standins import with_views
from tideline.session import fresh_folder
from tideline.streaming import live_reputation

#: Days whose orders arrive in one micro-batch, half of them one batch late.
SLOT_DAYS = 240


def arriving(spark, folder):
    """Orders as files that arrive in shuffled micro-batches, and the folder that holds them."""
    activity = standins.activity(spark, folder).select("platform", "community", "user_id", "post_id", "ts")
    first = activity.agg(F.min("ts").alias("_t")).first()["_t"]
    late = F.pmod(F.xxhash64("post_id"), F.lit(2))
    slot = F.floor(F.datediff("ts", F.lit(first)) / SLOT_DAYS) + late
    held = fresh_folder(spark, "slots")
    activity.withColumn("slot", slot).write.partitionBy("slot").parquet(held)
    slotted = spark.read.parquet(held)
    place = fresh_folder(spark, "arriving")
    for (number,) in sorted(tuple(r) for r in slotted.select("slot").distinct().collect()):
        slotted.where(F.col("slot") == number).drop("slot", "post_id").coalesce(1).write.mode("append").parquet(place)
    return activity.drop("post_id"), place


@check("reputation_events_stream", with_views("rep_orders", body="""
    SELECT platform, community, user_id, day, a AS run_events, round(off,6) AS day_fraction, next_day, round(r,6) AS reputation
    FROM rep_orders"""))
def reputation_events_stream(spark, folder):
    """Reputation of orders that arrive out of order, up to two slots late, in micro-batches of one file."""
    activity, place = arriving(spark, folder)
    stream = spark.readStream.schema(activity.schema).option("maxFilesPerTrigger", 1).parquet(place)
    rows = live_reputation.live_reputation_events(
        stream, reputation.scope_bounds(activity), MODEL, f"{2 * SLOT_DAYS + 10} days"
    )
    written = fresh_folder(spark, "live")
    live_reputation.write_live(rows, written, fresh_folder(spark, "live-state"), availableNow=True).awaitTermination()
    return rounded(live_reputation.current_events(spark, written))
