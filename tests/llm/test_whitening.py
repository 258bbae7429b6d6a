"""Whitening: exact parts against integers, components against a plain eigensolver."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import whitening as W

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors_of(rows):
    return {d: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000 for d, v in rows}


def check(found, rows, components=16):
    """Rows against a plain eigensolver; returns the number of components."""
    x = vectors_of(rows)
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    rank = int((values > 1e-9 * values[0]).sum())
    m = min(components, rank)
    cells = {(r.vec_id, r.component): r for r in found}
    assert set(cells) == {(d, c) for d in x for c in range(1, m + 1)}
    for (d, c), r in cells.items():
        assert r.n == n and r.deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[d], sums))
        assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    ids = sorted(x)
    mine = np.array([[cells[d, c].whitened for c in range(1, m + 1)] for d in ids])
    theirs = (np.stack([x[d] for d in ids]) - sums / n) @ directions[:, :m] / np.sqrt(values[:m])
    return mine, theirs


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_given_vectors(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    mine, theirs = check(W.whitened(df).collect(), rows)
    assert np.abs(np.abs(mine) - np.abs(theirs)).max() < 1e-8
    assert (np.abs(mine - theirs).max(axis=0) < 1e-8).sum() + (np.abs(mine + theirs).max(axis=0) < 1e-8).sum() == 16


def test_odd_vectors(spark):
    good = [(i, [0.25 * i, math.sin(i) * 3, (i % 3) * 1.5, 0.5]) for i in range(30)]
    bad = [
        (100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan"), 1.0, 1.0, 1.0]),
        (103, [float("inf"), 0.0, 0.0, 0.0]), (104, [1.0, 2.0]), (105, []),
    ]
    again = [(200, good[3][1]), (201, good[3][1])]
    df = spark.createDataFrame([(d, v, 0) for d, v in good + bad + again], SCHEMA)
    df = df.withColumn("key", F.lit("x")).withColumn("x", F.lit(1)).withColumn("component", F.lit("y"))
    found = W.whitened(df).collect()
    # The last dimension does not vary, so there are three components.
    mine, theirs = check(found, good + again)
    assert mine.shape[1] == 3 and np.abs(np.abs(mine) - np.abs(theirs)).max() < 1e-9
    whole = W.whitened(df.unionByName(df.where("vec_id = 7"))).where("vec_id = 7").count()
    assert whole == 6
    null_id = W.whitened(df.withColumn("vec_id", F.when(F.col("vec_id") != 7, F.col("vec_id"))))
    assert null_id.where("vec_id IS NULL").count() == 3


def test_equal_eigenvalues_get_orthogonal_components(spark):
    # A cross: every direction has the same variance.
    rows = [(2 * i + s, [float((1 - 2 * s) * (j == i)) for j in range(5)]) for i in range(5) for s in (0, 1)]
    found = W.whitened(spark.createDataFrame([(d, v, 0) for d, v in rows], SCHEMA)).collect()
    assert len(found) == 10 * 5
    assert {round(r.explained, 12) for r in found} == {0.2} and max(r.identity_error for r in found) < 1e-12


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert W.whitened(empty).collect() == []
    assert W.whitened(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert W.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).collect() == []
    assert W.whitened(spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)).collect() == []


def test_polynomials_modulo_primes():
    random = np.random.default_rng(5)
    for d in (1, 2, 3, 6):
        for matrix in (random.integers(-9, 9, (d, d)), np.zeros((d, d), np.int64), np.eye(d, dtype=np.int64) * 3):
            p = W.primes(3)[2]
            expected = np.rint(np.poly(matrix.astype(float))).astype(np.int64)[::-1] % p
            assert W.polynomial_modulo(matrix.astype(np.int64), p) == expected.tolist()
    assert W.primes(2) == [2147483647, 2147483629]


def test_roots_of_known_polynomials():
    # (x - 9)^2 (x - 4) x
    roots, bits = W.largest_roots([1, 22, 153, 324, 0], 3)
    assert [r / (1 << bits) for r in roots] == pytest.approx([9, 9, 4], rel=1e-30)
    # x^2 - 3 x + 1: the golden ratio's square and its inverse
    roots, bits = W.largest_roots([1, 3, 1], 16)
    assert [r / (1 << bits) for r in roots] == pytest.approx([(3 + 5**0.5) / 2, (3 - 5**0.5) / 2], rel=1e-15)
    assert W.largest_roots([1, 0, 0], 2) == ([], 0)


def test_products_are_exact_beyond_doubles():
    for far in (100, 1 << 25, 1 << 40):
        x = np.random.default_rng(1).integers(-far, far, (50, 3))
        found = W.exact_products(x)
        assert [[int(v) for v in row] for row in found] == [
            [sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for j in range(3)] for i in range(3)
        ]


def test_rows_pack_to_their_least_width():
    x = np.array([[1, -128], [128, 0], [-129, 5], [1 << 40, -(1 << 40)], [-(1 << 31), 7]])
    cells = W._packed(x)
    assert [len(c) for c in cells] == [2, 4, 4, 16, 8]
    assert (W._unpacked(cells, 2) == x).all()
