"""The registered queries on the smallest tables: against SQL where there is one, else against plain versions."""

from __future__ import annotations

import os
from collections import Counter

import pytest

from tests import compare
from tests.llm import brute
from tideline.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    tables = compare.connect(FOLDER)
    assert compare.difference(QUERIES[name](spark, FOLDER), tables, ORACLES[name]) is None
    tables.close()


def test_every_query_runs_over_all_documents(spark):
    import __spark_entry__ as entry

    docs = Counter(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    for name, query in QUERIES.items():
        if name.split("_")[0] in ("op11", "op12"):
            continue
        assert Counter(r.doc_id for r in query(spark, FOLDER).select("doc_id").collect()) == docs, name


@pytest.mark.parametrize("name,window,words", [("op4_substring_dedup", 13, True), ("op8_suffix_array_dedup", 50, False)])
def test_digests_of_what_is_kept(spark, name, window, words):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    expected = set()
    for (d, _), (units, flags) in zip(docs, brute.repeats(docs, window, words)):
        kept = [u for u, f in zip(units, flags) if not f]
        row = (d, len(units), sum(flags), *([] if words else [brute.runs(flags)]))
        expected.add((*row, brute.sha(b" ".join(kept) if words else bytes(kept))))
    assert {tuple(r) for r in QUERIES[name](spark, FOLDER).collect()} == expected


def test_queries_of_other_tables_run_over_all_rows(spark):
    conversations = {r.conv_id for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()}
    found = [r.conv_id for r in QUERIES["op11_conversation_repair"](spark, FOLDER).collect()]
    assert len(found) == len(conversations) and set(found) == conversations
    vectors = Counter({r.vec_id: 16 for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()})
    assert Counter(r.vec_id for r in QUERIES["op12_embedding_whitening"](spark, FOLDER).collect()) == vectors
