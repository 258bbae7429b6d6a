"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

Vectors become integers, each distinct one counts once, and their scatter is summed without rounding.
Its characteristic polynomial is found modulo primes, each in a task (Hessenberg reduction), and put
together by Chinese remaindering. All its roots are real, so the signs of its shifted coefficients
count the roots beyond any point exactly (Descartes), which isolates the largest ones to over a
hundred bits; inverse iteration in fixed point then gives the components.

The driver holds numbers of the dimension alone: the scatter, the polynomial and the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from functools import reduce
from math import comb, gcd, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import cut_lineage

#: The integer of an entry ``c`` is ``floor(SCALE * c) + SHIFT``.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this count as it; their scatter would not fit any result.
FARTHEST = 1 << 50
#: Correct bits of the smallest eigenvalue other than zero.
ROOT_BITS = 128
#: Bits behind the point in the inverse iteration, more than those of the roots.
SOLVE_BITS = 256
_EXACT = 1 << 53
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


# --- integers of vectors -------------------------------------------------------------------------


def _packed(values: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes of the least width that holds the row; equal rows have equal bytes."""
    out: list[bytes] = [b""] * len(values)
    far = np.maximum(values.max(axis=1, initial=0), -1 - values.min(axis=1, initial=0))
    width = np.searchsorted([(1 << 7) - 1, (1 << 15) - 1, (1 << 31) - 1], far)
    for k, kind in enumerate(_WIDTHS):
        rows = np.flatnonzero(width == k)
        small = values[rows].astype(kind)
        for row, data in zip(rows.tolist(), small):
            out[row] = data.tobytes()
    return out


def _unpacked(cells: list[bytes], size: int) -> np.ndarray:
    values = np.empty((len(cells), size), np.int64)
    lengths = np.array([len(c) for c in cells])
    for kind in _WIDTHS:
        rows = np.flatnonzero(lengths == size * np.dtype(kind).itemsize)
        if len(rows):
            values[rows] = np.frombuffer(b"".join(cells[r] for r in rows), kind).reshape(len(rows), size)
    return values


def _integers(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Keys with their vectors' integers (without ``SHIFT``) as bytes, and the number of dimensions."""
    sound = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))), F.lit(False))
    )
    sizes = sound.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size"))
    top = sizes.first()
    size = top["size"] if top else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            whole = np.clip(np.floor(SCALE * values), -FARTHEST, FARTHEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(_packed(whole), pa.binary())], ["key", "x"]
            )

    schema = T.StructType([T.StructField("key", sound.schema["key"].dataType), T.StructField("x", T.BinaryType())])
    rows = sound.where((F.size("v") == size) & F.lit(size > 0)).mapInArrow(run, schema)
    return cut_lineage(rows), size


# --- exact sums ----------------------------------------------------------------------------------


def _summed(fit: DataFrame, part) -> dict[tuple[int, int], int]:
    """Sums over all tasks of the integers that ``part`` makes of a batch's cells, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}
        for batch in batches:
            for place, value in part(batch.column("x").to_pylist()):
                held[place] = held.get(place, 0) + value
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in held], pa.int32()),
                pa.array([j for _, j in held], pa.int32()),
                pa.array([Decimal(v) for v in held.values()], pa.decimal128(38, 0)),
            ],
            ["i", "j", "v"],
        )

    parts = fit.select("x").mapInArrow(run, "i int, j int, v decimal(38,0)")
    return {(r.i, r.j): int(r.v) for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def exact_products(centred: np.ndarray) -> np.ndarray:
    """``centred.T @ centred`` as integers of any size."""
    far = int(np.abs(centred).max(initial=0))
    size = centred.shape[1]
    total = np.zeros((size, size), object)
    if far * far >= _EXACT:
        wide = centred.astype(object)
        return wide.T @ wide if len(wide) else total
    step = max(1, (_EXACT - 1) // max(1, far * far))
    for at in range(0, len(centred), step):
        # Products and sums below 2**53 are exact in doubles.
        part = centred[at : at + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _scatter(fit: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and ``n`` times the centred scatter: ``n * sum(z z') - sum(z) sum(z)'``."""

    def sums(cells: list[bytes]):
        values = _unpacked(cells, size)
        yield (-1, -1), len(cells)
        for j, v in enumerate(values.astype(object).sum(axis=0) if len(cells) else []):
            yield (-1, j), int(v)

    first = _summed(fit, sums)
    n = first.get((-1, -1), 0)
    total = [first.get((-1, j), 0) for j in range(size)]
    if not n:
        return 0, total, [[0] * size for _ in range(size)]
    middle = [(2 * t + n) // (2 * n) for t in total]
    around = np.array(middle, np.int64)

    def products(cells: list[bytes]):
        found = exact_products(_unpacked(cells, size) - around)
        for i in range(size):
            for j in range(i + 1):
                yield (i, j), int(found[i, j])

    second = _summed(fit, products)
    rest = [t - n * m for t, m in zip(total, middle)]
    scatter = [[n * second[max(i, j), min(i, j)] - rest[i] * rest[j] for j in range(size)] for i in range(size)]
    return n, total, scatter


# --- characteristic polynomial -------------------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test with bases that are enough below 3.2e9."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(count: int) -> list[int]:
    """The largest primes below 2**31."""
    out, n = [], (1 << 31) - 1
    while len(out) < count:
        if _is_prime(n):
            out.append(n)
        n -= 2
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of ``det(x I - matrix)`` modulo a prime below 2**31, the constant first."""
    h = matrix.copy() % p
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    # Characteristic polynomials of the leading blocks, one after the other.
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polys[k - 1, :-1]
        weights = np.empty(k, np.int64)
        below = 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * below % p
            if i:
                below = below * int(h[i, i - 1]) % p
        polys[k] = (new - (weights[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d].tolist()


def symmetric_functions(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Elementary symmetric functions of the eigenvalues of an integer matrix without negative ones.

    Up to sign they are the coefficients of its characteristic polynomial. By Maclaurin's inequality
    the k-th is at most ``comb(d, k) * (trace / d) ** k``, which says how many primes are enough.
    """
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    most = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    chosen = primes(most.bit_length() // 30 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(matrix, object)
        for batch in batches:
            found = batch.column("p").to_pylist()
            residues = [polynomial_modulo((whole % p).astype(np.int64), p) for p in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(residues, pa.list_(pa.int64()))], ["p", "c"])

    tasks = spark.createDataFrame([(p,) for p in chosen], "p bigint").repartition(min(len(chosen), 64))
    residues = {r.p: r.c for r in tasks.mapInArrow(run, "p bigint, c array<bigint>").collect()}
    product = reduce(lambda a, b: a * b, chosen)
    factors = [(p, (product // p) * pow(product // p, -1, p)) for p in chosen]
    out = []
    for k in range(d + 1):
        c = sum(residues[p][d - k] * f for p, f in factors)
        out.append((c if k % 2 == 0 else -c) % product)
    return out


# --- roots ---------------------------------------------------------------------------------------


def _shifted(q: list[int], a: int) -> list[int]:
    """Coefficients of ``q(x + a)``, the leading one first."""
    out = list(q)
    for stop in range(len(out), 1, -1):
        for i in range(1, stop):
            out[i] += a * out[i - 1]
    return out


def _beyond(q: list[int], a: int) -> int:
    """Roots greater than ``a``, counted as often as they occur; exact, as all roots are real."""
    signs = [c > 0 for c in _shifted(q, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value(q: list[int], a: int) -> int:
    return reduce(lambda held, c: held * a + c, q, 0)


def largest_roots(functions: list[int], most: int) -> tuple[list[int], int]:
    """The ``most`` largest positive roots in falling order, as floors in units of ``2 ** -bits``, and ``bits``.

    Equal roots come as often as they occur. ``functions`` are the elementary symmetric functions.
    """
    rank = max(k for k, e in enumerate(functions) if e)
    if not rank:
        return [], 0
    # The reciprocal roots sum to the ratio of the last two functions, so the least root is larger.
    least = Fraction(functions[rank], functions[rank - 1])
    exponent = least.numerator.bit_length() - least.denominator.bit_length()
    bits = max(0, ROOT_BITS - exponent)
    q = [(-1) ** k * (e << (bits * k)) for k, e in enumerate(functions[: rank + 1])]
    top = (functions[1] + 1) << bits
    found: list[int] = []
    # Half-open pieces (low, high] with the roots beyond each end; the rightmost comes first.
    pieces = [(0, top, rank, 0)]
    while pieces and len(found) < most:
        low, high, over_low, over_high = pieces.pop()
        count = over_low - over_high
        if not count:
            continue
        if high - low == 1:
            found += [low] * count
            continue
        if count == 1:
            # One simple root: the sign changes in it.
            right = _value(q, high)
            if right == 0:
                found.append(high)
                continue
            while high - low > 1:
                middle = (low + high) // 2
                here = _value(q, middle)
                if here == 0:
                    low = middle
                    break
                if (here > 0) == (right > 0):
                    high = middle
                else:
                    low = middle
            found.append(low)
            continue
        middle = (low + high) // 2
        over = _beyond(q, middle)
        pieces.append((low, middle, over_low, over))
        pieces.append((middle, high, over, over_high))
    return found[:most], bits


# --- components ----------------------------------------------------------------------------------


def _factored(matrix: list[list[int]], root: int, bits: int):
    """``matrix`` less the root on the diagonal, in fixed point, as rows ordered by pivots with their factors."""
    d = len(matrix)
    m = np.array([[v << SOLVE_BITS for v in row] for row in matrix], object)
    spot = (root << SOLVE_BITS) >> bits
    for i in range(d):
        m[i, i] -= spot
    order = list(range(d))
    factors = np.zeros((d, d), object)
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(m[i, k]))
        if pivot != k:
            m[[k, pivot]] = m[[pivot, k]]
            factors[[k, pivot]] = factors[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if not m[k, k]:
            m[k, k] = 1
        for i in range(k + 1, d):
            if m[i, k]:
                f = (m[i, k] << SOLVE_BITS) // m[k, k]
                factors[i, k] = f
                m[i, k:] = m[i, k:] - ((f * m[k, k:]) >> SOLVE_BITS)
                m[i, k] = 0
    return m, factors, order


def _normal(v: list[int]) -> list[int]:
    """The direction with length one, in fixed point."""
    length = isqrt(sum(x * x for x in v))
    return [(x << SOLVE_BITS) // length for x in v]


def _solved(parts, v: list[int]) -> list[int]:
    m, factors, order = parts
    d = len(v)
    y = [v[i] << SOLVE_BITS for i in order]
    for i in range(d):
        for k in range(i):
            if factors[i, k]:
                y[i] -= (factors[i, k] * y[k]) >> SOLVE_BITS
    for i in range(d - 1, -1, -1):
        rest = y[i] - sum((m[i, j] * y[j]) >> SOLVE_BITS for j in range(i + 1, d))
        y[i] = (rest << SOLVE_BITS) // m[i, i]
    return y


def eigenvectors(matrix: list[list[int]], roots: list[int], bits: int) -> np.ndarray:
    """Unit eigenvectors of a symmetric integer matrix, one column per root; equal roots get orthogonal ones."""
    d = len(matrix)
    columns: list[list[int]] = []
    at = 0
    while at < len(roots):
        parts = _factored(matrix, roots[at], bits)
        together: list[list[int]] = []
        stop = at
        while stop < len(roots) and roots[at] - roots[stop] <= 1:
            # Any start that is not orthogonal to the component will do.
            v = _normal([((i + 1) * 2654435761 * (stop + 1) + 40503) % 65521 - 32749 for i in range(d)])
            for _ in range(3):
                v = _normal(_solved(parts, v))
                for u in together:
                    along = sum(x * y for x, y in zip(u, v)) >> SOLVE_BITS
                    v = [x - ((along * y) >> SOLVE_BITS) for x, y in zip(v, u)]
                v = _normal(v)
            together.append(v)
            stop += 1
        columns += together
        at = stop
    one = 1 << SOLVE_BITS
    return np.array([[x / one for x in v] for v in columns], np.float64).T.reshape(d, len(columns))


# --- the operator --------------------------------------------------------------------------------


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """The largest components of every vector, each scaled to unit variance.

    Vectors that are null or hold null, NaN or infinite entries are left out; so are those of another
    length than most (of equally frequent lengths the greatest counts), which share no dimensions with
    the fit. Each distinct integer vector counts once in the fit; repeated rows and null keys stay in
    the result. Components stand in the order of falling eigenvalues; equal eigenvalues get any
    orthogonal directions. Directions without variance have no component, so there are at most as many
    as the rank, and none for fewer than two distinct vectors. ``deviation`` is null where it exceeds
    a long. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows, size = _integers(vectors, key, vector)
    schema = T.StructType(
        [
            T.StructField(key, rows.schema["key"].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    fit = cut_lineage(rows.select("x").distinct())
    n, total, scatter = _scatter(fit, size)
    divisor = gcd(*(v for row in scatter for v in row)) if size else 0
    if not divisor:
        return spark.createDataFrame([], schema)
    matrix = [[v // divisor for v in row] for row in scatter]
    trace = sum(matrix[i][i] for i in range(size))
    roots, bits = largest_roots(symmetric_functions(spark, matrix), components)
    directions = eigenvectors(matrix, roots, bits)
    # The covariance is the scatter over n twice.
    values = [float(Fraction(r * divisor, (n * n) << bits)) for r in roots]
    shares = [float(Fraction(r, trace << bits)) for r in roots]
    scaled = directions / np.sqrt(values)
    m = len(roots)

    def centred(cells: list[bytes]) -> np.ndarray:
        """``n`` times every vector less the sums, exactly."""
        x = _unpacked(cells, size)
        most = max(int(np.abs(x).max(initial=0)), 1) * n + max(map(abs, total))
        if most < 1 << 62:
            return x * n - np.array(total, np.int64)
        return x.astype(object) * n - np.array(total, object)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((m + 1, m))
        for batch in batches:
            w = (centred(batch.column("x").to_pylist()) / n).astype(np.float64) @ scaled
            held[:m] += w.T @ w
            held[m] += w.sum(axis=0)
        places = [(i, j) for i in range(m + 1) for j in range(m)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in places], pa.int32()), pa.array([j for _, j in places], pa.int32()), pa.array(held.reshape(-1))],
            ["i", "j", "v"],
        )

    sums = fit.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = np.zeros((m + 1, m))
    for r in sums.collect():
        found[r.i, r.j] = r.v / n
    error = float(np.abs(found[:m] - np.outer(found[m], found[m]) - np.eye(m)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            away = centred(batch.column("x").to_pylist())
            w = (away / n).astype(np.float64) @ scaled
            far = int(np.abs(away).max(initial=0))
            if far * far * size < 1 << 63:
                deviation = pa.array((away.astype(np.int64) ** 2).sum(axis=1))
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in away]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            each = pa.array(np.repeat(np.arange(count), m))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(each),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * m, n, np.int64)),
                    deviation.take(each),
                    pa.array(w.reshape(-1)),
                    pa.array(np.tile(shares, count)),
                    pa.array(np.full(count * m, error)),
                ],
                schema.names,
            )

    return rows.mapInArrow(project, schema)
