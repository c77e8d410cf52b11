"""Vector arithmetic on array<double> columns.

With a known small dimension the sums are unrolled, so they stay inside generated code;
otherwise higher-order functions do the same. Functions ending in ``_sql`` give expression
text for unrolled loops, which is far quicker to build than hundreds of column objects.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNROLL_LIMIT = 64


def sq_dist_sql(a: str, b: str, dim: int | None = None) -> str:
    if dim is not None and dim <= UNROLL_LIMIT:
        return " + ".join(f"({a}[{j}] - {b}[{j}]) * ({a}[{j}] - {b}[{j}])" for j in range(dim))
    return f"aggregate(zip_with({a}, {b}, (p, q) -> (p - q) * (p - q)), 0D, (s, v) -> s + v)"


def euclid_sql(a: str, b: str, dim: int | None = None) -> str:
    return f"sqrt({sq_dist_sql(a, b, dim)})"


def dot_sql(x: str, w: str, dim: int) -> str:
    """Inner product plus the constant held in the last place of ``w``."""
    return " + ".join(f"{x}[{j}] * {w}[{j}]" for j in range(dim)) + f" + {w}[{dim}]"


def _unrolled(k: int, dim: int) -> bool:
    return k <= 8 and k * dim <= 4 * UNROLL_LIMIT


def _distances_sql(x: str, centres: str) -> str:
    return f"transform({centres}, c -> {sq_dist_sql(x, 'c')})"


def nearest_sql(x: str, centres: str, k: int, dim: int) -> str:
    """Index of the nearest centre, the first one on ties."""
    if k == 1:
        return "0"
    if not _unrolled(k, dim):
        dists = _distances_sql(x, centres)
        return f"int(array_position({dists}, array_min({dists})) - 1)"
    dists = [f"({sq_dist_sql(x, f'{centres}[{c}]', dim)})" for c in range(k)]
    if k == 2:
        return f"CASE WHEN {dists[1]} < {dists[0]} THEN 1 ELSE 0 END"
    listed = ", ".join(dists)
    return f"int(array_position(array({listed}), least({listed})) - 1)"


def nearest_distance_sql(x: str, centres: str, k: int, dim: int) -> str:
    """Squared distance to the nearest centre."""
    if not _unrolled(k, dim):
        return f"array_min({_distances_sql(x, centres)})"
    dists = [sq_dist_sql(x, f"{centres}[{c}]", dim) for c in range(k)]
    return dists[0] if k == 1 else f"least({', '.join(dists)})"


def as_text(x: Column) -> Column:
    """A vector as ``[a,b,c]``."""
    return F.concat(F.lit("["), F.array_join(x.cast("array<string>"), ","), F.lit("]"))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))
