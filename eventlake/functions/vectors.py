"""Vector functions over arrays of doubles, as SQL text and as columns.

Vectors of different length, empty ones, NULL and (for the cosine) those of norm zero have similarity and product 0 and the
largest double as their distance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FARTHEST = "1.7976931348623157E308D"


def dot_sql(a: str, b: str) -> str:
    return f"CASE WHEN size({a}) = size({b}) AND size({a}) > 0 THEN aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x) ELSE 0D END"


def norm_sql(a: str) -> str:
    return f"coalesce(sqrt(aggregate({a}, 0D, (s, x) -> s + x * x)), 0D)"


def cosine_sql(a: str, b: str) -> str:
    norms = f"({norm_sql(a)} * {norm_sql(b)})"
    return f"CASE WHEN {norms} > 0 THEN ({dot_sql(a, b)}) / {norms} ELSE 0D END"


def euclidean_sql(a: str, b: str) -> str:
    total = f"aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"
    return f"CASE WHEN size({a}) = size({b}) THEN sqrt({total}) ELSE {FARTHEST} END"


def _array(values) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")" if not isinstance(values, str) else f"cast({values} as array<double>)"


def cosine_similarity(a, b) -> Column:
    """a, b: column names, or sequences of numbers."""
    return F.expr(cosine_sql(_array(a), _array(b)))


def euclidean_distance(a, b) -> Column:
    return F.expr(euclidean_sql(_array(a), _array(b)))


def dot_product(a, b) -> Column:
    return F.expr(dot_sql(_array(a), _array(b)))


def vector_norm(a) -> Column:
    return F.expr(norm_sql(_array(a)))
