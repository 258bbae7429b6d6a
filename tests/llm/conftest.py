from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def texts(spark):
    """Makes a documents table of ids and texts, with columns whose names the operators use themselves."""

    def make(rows, extra=False):
        docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA)
        if not extra:
            return docs
        clashing = ("block", "words", "n_words", "length", "row", "bucket", "rest", "ids", "component_id", "kept", "a.b")
        for name in clashing:
            docs = docs.selectExpr("*", f"'x' AS `{name}`")
        return docs

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long text, ties, repeated rows, copies and shared passages."""
    passage = " ".join(f"shared{i} wörd" for i in range(40))
    return [
        (5, None),
        (None, "null id " + passage),
        (1, ""),
        (2, " \t\n\x0b\f\r "),
        (3, "one"),
        (4, "x y\n\nz é 漢字 \U0001f600\n" * 3),
        (10, f"before {passage} after"),
        (11, f"other words {passage} and an end"),
        (12, f"before {passage} after"),
        (12, f"before {passage} after"),
        (20, " ".join(f"w{i % 997}" for i in range(30_000))),
        (21, "a" * 60_000),
        (22, "a" * 60_000 + " tail"),
        (30, "cc-by CC BY All Rights Reserved; general public license, cc"),
    ]
