"""The engine's functions for plain Spark SQL: SQL functions whose bodies Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from eventlake.functions import vectors

_INDEX = "regexp_replace(p, '[.]([0-9]+)(?=[.]|$)', '[$1]')"

FUNCTIONS = {
    "json_extract": ("s STRING, p STRING", "STRING", f"coalesce(get_json_object(s, {_INDEX}), get_json_object(s, p))"),
    "json_number": ("s STRING, p STRING", "DOUBLE", "CASE WHEN schema_of_variant(try_variant_get(try_parse_json(s), p, 'variant')) RLIKE '^(BIGINT|DOUBLE|DECIMAL)' THEN try_variant_get(try_parse_json(s), p, 'double') END"),
    "cosine_similarity": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", vectors.cosine_sql("a", "b")),
    "euclidean_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", vectors.euclidean_sql("a", "b")),
    "dot_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", vectors.dot_sql("a", "b")),
    "vector_norm": ("a ARRAY<DOUBLE>", "DOUBLE", vectors.norm_sql("a")),
    "l2_norm": ("a ARRAY<DOUBLE>", "DOUBLE", vectors.norm_sql("a")),
}


def register(spark: SparkSession) -> None:
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
