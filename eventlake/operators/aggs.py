"""Aggregates over records, with the engine's rules for numbers, order and names.

SUM of no numbers is 0. FIRST and LAST go by (timestamp, partition, offset), whatever the order of rows, and NULL counts as a value.
Unnamed aggregates are called count_0, sum_1 and so on, by their place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = ("timestamp", "partition", "offset")
NAMES = {"mean": "avg", "first_value": "first", "last_value": "last"}


def order_key(order: tuple[str, ...] = ORDER) -> Column:
    return F.struct(*order)


def aggregate(kind: str, value: Column | None = None, order: tuple[str, ...] = ORDER) -> Column:
    """kind: count, count_distinct, approx_count_distinct, sum, avg or mean, min, max, first, last."""
    kind = NAMES.get(kind, kind)
    if kind == "count":
        return F.count(F.lit(1) if value is None else value)
    if kind == "count_distinct":
        return F.count_distinct(value)
    if kind == "approx_count_distinct":
        return F.approx_count_distinct(value)
    if kind == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0))
    if kind in ("avg", "min", "max"):
        return getattr(F, kind)(value)
    # wrapped, so that a NULL value is kept
    pick = {"first": F.min_by, "last": F.max_by}[kind]
    return pick(F.struct(value.alias("v")), order_key(order))["v"]


def named(aggregates: list[tuple[str, Column | None]]) -> list[Column]:
    """Aggregates under their default names."""
    return [aggregate(k, v).alias(f"{NAMES.get(k, k)}_{i}") for i, (k, v) in enumerate(aggregates)]
