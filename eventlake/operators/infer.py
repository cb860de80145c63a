"""Schema inference over payloads, and a query's estimated cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: SQL types of JSON kinds, and bounds of confidence and of cost tiers.
SQL_TYPES = {"string": "VARCHAR", "integer": "BIGINT", "number": "DOUBLE", "boolean": "BOOLEAN", "object": "JSON", "array": "JSON"}


def _kind(v: str) -> str:
    s = f"schema_of_variant({v})"
    return (
        f"CASE WHEN {s} = 'VOID' THEN 'null' WHEN {s} = 'BIGINT' THEN 'integer' WHEN {s} RLIKE '^(DOUBLE|DECIMAL|FLOAT)' THEN 'number' "
        f"WHEN {s} = 'BOOLEAN' THEN 'boolean' WHEN {s} = 'STRING' THEN 'string' WHEN {s} LIKE 'ARRAY%' THEN 'array' ELSE 'object' END"
    )


def path_values(df: DataFrame, depth: int | None = None) -> DataFrame:
    """path, kind and value text of every field of every payload; fields of objects down to ``depth``, or of all. Unparsable payloads
    have none. Without a depth, a job for each level looks for objects in it."""
    level = df.select(F.lit("$").alias("path"), F.try_parse_json("value").alias("v")).where("v is not null")
    out, at = None, 0
    while depth is None or at < depth:
        fields = F.expr("explode(from_json(to_json(v), 'map<string,variant>')) AS (k, v2)")
        objects = level.where("schema_of_variant(v) LIKE 'OBJECT%'")
        if depth is None and at and objects.isEmpty():
            break
        level = objects.select("path", fields).select(F.concat("path", F.lit("."), "k").alias("path"), F.col("v2").alias("v"))
        found = level.select("path", F.expr(_kind("v")).alias("kind"), F.expr("CASE WHEN is_variant_null(v) THEN NULL WHEN schema_of_variant(v) = 'STRING' THEN variant_get(v, '$', 'string') ELSE to_json(v) END").alias("text"))
        out, at = found if out is None else out.unionByName(found), at + 1
    return out


def infer_schema(df: DataFrame, depth: int | None = None) -> DataFrame:
    """One row per path: occurrences, nulls, share of payloads that have it, nullable, the most frequent kind (ties by name) as a SQL
    type, distinct values and whether the name suggests an index. Every payload counts."""
    total = df.agg(F.count(F.try_parse_json("value")).alias("total"))
    kinds = path_values(df, depth).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("text").alias("distinct_values"))
    found = kinds.where("kind != 'null'").withColumn("order", F.struct("n", F.col("kind")))
    per = kinds.groupBy("path").agg(F.sum("n").alias("occurrences"), F.sum(F.when(F.col("kind") == "null", F.col("n")).otherwise(0)).alias("nulls"))
    top = found.groupBy("path").agg(F.max_by("kind", "order").alias("kind"), F.sum("distinct_values").alias("distinct_values"))
    out = per.join(top, "path", "left").crossJoin(F.broadcast(total))
    types = F.create_map(*[F.lit(x) for pair in SQL_TYPES.items() for x in pair])
    rate = F.col("occurrences") / F.col("total")
    last = F.element_at(F.split("path", r"\."), -1)
    return out.select(
        "path", "occurrences", "nulls", rate.alias("occurrence_rate"), ((F.col("nulls") > 0) | (rate < 1)).alias("nullable"),
        F.coalesce(F.try_element_at(types, F.col("kind")), F.lit("VARCHAR")).alias("sql_type"), "distinct_values",
        last.rlike("(?i)(^id$|_id$|id$|key$|timestamp$|_at$|status$|type$)").alias("index_hint"),
    )


def payload_type(df: DataFrame) -> str:
    """The one type, in SQL, that holds all payloads."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json("value")).alias("t")).first()["t"]


def confidence(samples: int) -> float:
    return 0.95 if samples >= 1000 else 0.85 if samples >= 100 else 0.7 if samples >= 10 else 0.5


def cost(df: DataFrame, limit: int | None = None, rows: int | None = None) -> dict:
    """Estimated rows and bytes of a query, from the optimizer's statistics (or a known row count), its tier and milliseconds."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    size = int(str(stats.sizeInBytes()))
    if rows is None:
        known = stats.rowCount()
        rows = int(str(known.get())) if known.isDefined() else max(1, size // max(1, 8 * len(df.columns)))
    if limit is not None:
        rows = min(rows, limit)
    tier = "low" if rows < 10_000 else "medium" if rows < 100_000 else "high"
    return {"rows": rows, "bytes": size, "tier": tier, "estimated_ms": max(10, rows // 10)}
