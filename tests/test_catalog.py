"""Every registered query against its oracle, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests import compare
from tideline.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def tables():
    connection = compare.connect(FOLDER)
    yield connection
    connection.close()


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_oracle(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare.difference(df, tables, ORACLES[name]) is None


@needs_tables
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_the_entry_registers_the_catalog():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@needs_tables
def test_whole_monthly_graph_keeps_every_id(spark):
    from pyspark.sql import functions as F

    from tideline.plans import standins

    edges = standins.edges_platform_month(spark, FOLDER)
    ids = {r[0] for r in edges.select(F.explode(F.array("source", "target"))).distinct().collect()}
    customers = {str(r[0]) for r in standins.table(spark, FOLDER, "orders").select("o_custkey").distinct().collect()}
    suppliers = {str(r[0]) for r in standins.table(spark, FOLDER, "lineitem").select("l_suppkey").distinct().collect()}
    assert ids == customers | suppliers


def test_every_headline_of_the_benchmark_is_registered():
    import bench

    assert set(bench.HEADLINE) <= set(entry.queries()) and len(set(bench.HEADLINE)) == len(bench.HEADLINE)
