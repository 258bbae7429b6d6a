"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import os
from collections import Counter

import pytest

from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_pipeline_matches_plain_stages(spark):
    import corpus_pipeline
    from tideline.llm.quality import quality_table

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = {r.doc_id for r in quality_table(docs).collect() if r.kept}
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id in good)
    rows = [r for r, (_, c) in zip(rows, brute.near_components(rows, 5)) if r[0] == c]
    expected = Counter()
    for (d, text), (_, flags) in zip(rows, brute.repeats(rows, 50, False)):
        left, place = [], 0
        for c in text:
            n = len(c.encode())
            # A character goes when all its bytes lie in one removed run, as runs are maximal.
            if not all(flags[place : place + n]):
                left.append(c)
            place += n
        expected[d, len("".join(left).encode().split())] += 1
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r.doc_id, r.length) for r in found) == expected


def test_stages_keep_the_columns_of_documents(texts, spark):
    import corpus_pipeline

    docs = texts([(1, "some words of a text " * 3 + " ".join(f"w{i}" for i in range(60))), (2, None), (3, "")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_pipeline_of_odd_and_empty_tables(texts, spark, tmp_path):
    """Repeated rows, nulls and clashing columns pass all stages; an empty table gives no rows."""
    import corpus_pipeline

    long = " ".join(f"word{i} of a text" for i in range(60)) + "."
    other = " ".join(f"thing{i} in other words" for i in range(60)) + "."
    rows = [(1, long), (1, long), (2, long), (3, other), (4, None), (5, ""), (None, other), (6, "too short")]
    for name, table in (("odd", texts(rows, extra=True)), ("empty", texts([]))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
    found = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect())
    assert found == {1: 2, 3: 1}
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
