"""Predicate trees over a payload's top-level fields, and projections of them.

Logic has two values: a missing field (or a value of another type) makes a leaf false, so that its negation is true.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions import jsonx


def _field(name: str) -> str:
    """A path to the top-level field of that name, dots and all."""
    return "$['" + name.replace("'", "\\'") + "']"


def _typed(name: str, kinds: tuple[str, ...], target: str) -> Column:
    path = jsonx.literal(_field(name))
    kind = jsonx.is_kind(f"try_variant_get({jsonx.PARSED}, {path}, 'variant')", kinds)
    return F.expr(f"CASE WHEN {kind} THEN try_variant_get({jsonx.PARSED}, {path}, '{target}') END")


def _leaf(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def predicate(tree: Mapping) -> Column:
    """{"op": equals|greater_than|less_than|contains, "field", "value"}, {"op": and|or, "args"} or {"op": not, "arg"}."""
    op = tree["op"]
    if op in ("and", "or"):
        out = F.lit(op == "and")
        for arg in tree["args"]:
            out = out & predicate(arg) if op == "and" else out | predicate(arg)
        return out
    if op == "not":
        return ~predicate(tree["arg"])
    name, value = tree["field"], tree["value"]
    if op == "equals":
        if isinstance(value, bool):
            return _leaf(_typed(name, jsonx.BOOLEAN, "boolean") == value)
        if isinstance(value, (int, float)):
            return _leaf(_typed(name, jsonx.NUMBER, "double") == float(value))
        return _leaf(_typed(name, jsonx.STRING, "string") == value)
    if op == "contains":
        return _leaf(_typed(name, jsonx.STRING, "string").contains(value))
    number = _typed(name, jsonx.NUMBER, "double")
    return _leaf(number > float(value) if op == "greater_than" else number < float(value))


def keep(df: DataFrame, tree: Mapping, strict: bool = False) -> DataFrame:
    """Records whose payload satisfies the tree. Invalid JSON is dropped, or with ``strict`` raises."""
    parsed = jsonx.parsed(df)
    if strict:
        check = F.when(F.col(jsonx.PARSED).isNull(), F.raise_error(F.concat(F.lit("invalid JSON at offset "), F.col("offset").cast("string")))).otherwise(predicate(tree))
        return parsed.where(check.cast("boolean")).drop(jsonx.PARSED)
    return parsed.where(F.col(jsonx.PARSED).isNotNull() & predicate(tree)).drop(jsonx.PARSED)


def project(df: DataFrame, fields: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """df whose payload has only these top-level fields, renamed if a mapping is given; missing ones are left out, nulls kept."""
    names = dict(fields) if isinstance(fields, Mapping) else {f: f for f in fields}
    parsed = F.expr("from_json(value, 'map<string,variant>')")
    parts = [F.when(F.map_contains_key("__m", F.lit(old)), F.concat(F.lit(f"{_quoted(new)}:"), F.expr(f"to_json(element_at(__m, {jsonx.literal(old)}))"))) for old, new in names.items()]
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return df.withColumn("__m", parsed).withColumn("value", body).drop("__m")


def _quoted(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)
