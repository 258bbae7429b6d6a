"""Decontamination against a plain scan for windows."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from tests.llm.brute import ascii_lower
from tideline.llm import decontamination as D

ITEMS = "item_id bigint, text string"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return _WORD.findall(ascii_lower(text or ""))


def plain(docs, items, window):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    hit |= set(range(i, i + size))
                    ids |= found
        names = tuple(sorted(str(i) for i in ids if i is not None))
        out.append((d, len(w), len(hit), len(names), names, bool(hit)))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids), r.contaminated) for r in df.collect())


def benchmark_rows():
    passage = " ".join(f"shared{i} wörd" for i in range(9))
    return [
        (1, passage), (2, passage + " and more of it, here"), (2, "another text of item two: x y z"), (10, "one"),
        (11, None), (12, " .,; "), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (13, "x y\n\nz é 漢字"),
        (14, "aa bb aa bb aa bb aa bb aa bb aa bb aa bb"), (15, "Z É x"),
    ]


@pytest.mark.parametrize("window", [1, 3, 10])
@pytest.mark.parametrize("many", [False, True])
def test_odd_rows(spark, texts, odd_rows, monkeypatch, window, many):
    if many:
        monkeypatch.setattr(D, "BLOCK_BYTES", 60)
        monkeypatch.setattr(D, "PIECE_WORDS", 4)
        monkeypatch.setattr(D, "CHUNK_BYTES", 500)
    rows = odd_rows + [(40, "AA bb " * 9), (41, "bb aa " * 9 + "shared0"), (42, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")]
    items = spark.createDataFrame(benchmark_rows(), ITEMS).selectExpr("*", "1 AS block", "'q' AS spans")
    docs = texts(rows, extra=True)
    assert found(D.contamination(docs, items, window)) == plain(rows, benchmark_rows(), window)


def test_spans_and_longest(spark, texts):
    items = spark.createDataFrame([(1, "a b c d"), (2, "c d e f")], ITEMS)
    docs = texts([(1, "x a b c d e f y c d e"), (2, "a b c")])
    rows = {r.doc_id: r for r in D.contamination(docs, items, 3).collect()}
    assert [tuple(s) for s in rows[1].spans] == [(1, 7), (8, 11)] and rows[1].longest == 6
    assert [tuple(s) for s in rows[2].spans] == [(0, 3)]


def test_empty_tables(spark, texts):
    none = spark.createDataFrame([], ITEMS)
    docs = texts([(1, "some words"), (2, None)])
    assert found(D.contamination(docs, none)) == plain([(1, "some words"), (2, None)], [], 10)
    assert D.contamination(texts([]), spark.createDataFrame(benchmark_rows(), ITEMS)).collect() == []
    assert D.decontaminated(texts([]), none).collect() == []


def test_cut_texts_keep_the_rest(spark, texts):
    items = spark.createDataFrame([(1, "alpha Beta gamma delta")], ITEMS)
    rows = [
        (1, "One, two; ALPHA beta, gamma delta! three four five six é"), (2, None), (3, ""),
        (4, "alpha beta gamma delta."), (5, "clean words stay"), (5, "clean words stay"),
    ]
    docs = texts(rows, extra=True)
    cut = D.decontaminated(docs, items, window=4)
    assert cut.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == Counter(
        [(1, "One, two; ! three four five six é"), (2, None), (3, ""), (5, "clean words stay"), (5, "clean words stay")]
    )
    kept = D.decontaminated(docs, items, window=4, least_span=5, most_cover=1.0)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(rows)


def test_window_needs_a_word(spark, texts):
    with pytest.raises(ValueError):
        D.contamination(texts([]), spark.createDataFrame([], ITEMS), 0)
