"""Distribution functions written as DuckDB expressions, for oracles only."""

from __future__ import annotations


def draw_sql(size: str, *coordinates: str) -> str:
    """The library's draw from ``0 .. size - 1``."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(coordinates)})), 1, 12) AS BIGINT) % ({size}))"


def normal_p_sql(z: str) -> str:
    """Two-sided normal p-value by the series of the error function."""
    x = f"(least(abs({z}), 9.0) / sqrt(2.0))"
    terms = f"list_sum(list_transform(range(0, 220), lambda n: exp((2*n+1)*ln({x} + 1e-300) - lgamma(n + 1.5) - {x}*{x})))"
    return f"(CASE WHEN {z} IS NULL THEN NULL ELSE greatest(1 - {terms}, 0.0) END)"


def student_p_sql(t: str, v: str) -> str:
    """Two-sided Student p-value by Simpson's rule over the angle whose tangent is ``t / sqrt(v)``."""
    top = f"least(atan(abs({t})/sqrt({v})), 40.0/sqrt({v}))"
    steps = 4000
    weight = f"(CASE WHEN i=0 OR i={steps} THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)"
    area = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * pow(greatest(cos(i*{top}/{steps}), 0.0), {v} - 1))) * {top} / {3 * steps}"
    scale = f"exp(lgamma(({v}+1)/2) - lgamma(({v})/2)) / sqrt(pi())"
    return f"(CASE WHEN {t} IS NULL THEN NULL ELSE greatest(1 - 2*({scale})*({area}), 0.0) END)"
