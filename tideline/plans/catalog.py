"""The table of checked queries: a name, a Spark query and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def in_utc(query: Query) -> Query:
    """The query in a session set to UTC, as its dates are, whatever the caller's session was built with."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, folder)

    return run


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = in_utc(query)
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    columns: list[Column] = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.dataType.typeName() == "double":
            # Adding zero turns a rounded -0.0 into 0.0.
            column = (F.round(column, digits) + F.lit(0.0)).alias(field.name)
        columns.append(column)
    return df.select(*columns)
