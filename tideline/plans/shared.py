"""Intermediate tables that several checked queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.operators import rollups
from tideline.plans import standins


def user_month(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.user_month_metrics(standins.activity(spark, folder), standins.SCORES)


def community_month(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.community_month_basic(user_month(spark, folder))
