"""Reading JSON payloads: paths, text, numbers, booleans.

A path is ``$`` followed by segments between dots; a segment of digits is an index of an array or else a key of an object; empty
segments are skipped. Numbers are JSON numbers only (neither "5" nor true is one); invalid JSON and missing paths are NULL.

Each function builds SQL text, so that the SQL dialect and DataFrame code share it. Typed reads work on a variant column
(``try_parse_json(value)``), which is parsed once for all paths.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The column that holds the parsed payload.
PARSED = "_v"
#: Kinds of variants, by the first six letters of their types.
NUMBER, STRING, BOOLEAN = ("BIGINT", "DOUBLE", "DECIMA", "FLOAT"), ("STRING",), ("BOOLEA",)


def segments(path: str) -> list[str]:
    return [s for s in path.lstrip("$").lstrip(".").split(".") if s]


def spark_paths(path: str) -> list[str]:
    """Spark's forms of a path: a segment of digits as an index, then as a key."""
    choices = [[f"[{int(s)}]", f"['{s}']"] if s.isdigit() else [f"['{s}']"] for s in segments(path)]
    return ["$" + "".join(c) for c in product(*choices)]


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _first(forms: list[str]) -> str:
    return forms[0] if len(forms) == 1 else f"coalesce({', '.join(forms)})"


def text_sql(path: str, column: str = "value") -> str:
    """Strings unquoted, the rest as JSON text."""
    return _first([f"get_json_object({column}, {literal(p)})" for p in spark_paths(path)])


def is_kind(read: str, kinds: tuple[str, ...]) -> str:
    """Whether a variant is of one of these kinds (the first six letters of their types' names)."""
    return f"left(schema_of_variant({read}), 6) IN ({', '.join(map(literal, kinds))})"


def _typed(path: str, kinds: tuple[str, ...], target: str, parsed: str) -> str:
    reads = [(p, f"try_variant_get({parsed}, {p}, 'variant')") for p in map(literal, spark_paths(path))]
    return _first([f"CASE WHEN {is_kind(r, kinds)} THEN try_variant_get({parsed}, {p}, '{target}') END" for p, r in reads])


def num_sql(path: str, parsed: str = PARSED) -> str:
    return _typed(path, NUMBER, "double", parsed)


def str_sql(path: str, parsed: str = PARSED) -> str:
    return _typed(path, STRING, "string", parsed)


def bool_sql(path: str, parsed: str = PARSED) -> str:
    return _typed(path, BOOLEAN, "boolean", parsed)


def null_sql(path: str, parsed: str = PARSED) -> str:
    """True where the payload is valid JSON and the path is missing or null."""
    reads = [f"try_variant_get({parsed}, {literal(p)}, 'variant')" for p in spark_paths(path)]
    inner = " AND ".join(f"({r} IS NULL OR is_variant_null({r}))" for r in reads)
    return f"({parsed} IS NOT NULL AND {inner})"


def vector_sql(path: str, column: str = "value") -> str:
    """An array of numbers; NULL if any item is no number."""
    raw = f"from_json({text_sql(path, column)}, 'array<double>')"
    return f"CASE WHEN NOT exists({raw}, x -> x IS NULL) THEN {raw} END"


def parsed(df: DataFrame, column: str = "value") -> DataFrame:
    """df with the payload parsed once."""
    return df.withColumn(PARSED, F.try_parse_json(column))


def json_text(path: str, column: str = "value") -> Column:
    return F.expr(text_sql(path, column))


def json_num(path: str, parsed: str = PARSED) -> Column:
    return F.expr(num_sql(path, parsed))


def json_bool(path: str, parsed: str = PARSED) -> Column:
    return F.expr(bool_sql(path, parsed))


def json_str(path: str, parsed: str = PARSED) -> Column:
    return F.expr(str_sql(path, parsed))
