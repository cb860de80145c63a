"""Change data capture: parsing change envelopes, filtering, counting, and the table that they lead to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of operations, and the long names that some connectors write.
OPERATIONS = {"c": "insert", "u": "update", "d": "delete", "r": "read", "t": "truncate", "create": "insert", "update": "update", "delete": "delete", "read": "read", "truncate": "truncate", "schema_change": "schema_change"}
_SOURCE = "struct<connector:string,db:string,schema:string,table:string,server_id:string,lsn:bigint,file:string,pos:bigint>"


def parse(df: DataFrame, value: str = "value") -> DataFrame:
    """df with op, table, schema, before, after (JSON text, NULL if missing or null), ts_ms (0 if missing), source and valid.

    An envelope may stand under ``payload``. valid is false for invalid JSON and unknown operations.
    """
    body = F.coalesce(F.get_json_object(value, "$.payload"), F.col(value))
    df = df.withColumn("__b", body)
    letter = F.lower(F.get_json_object("__b", "$.op"))
    names = F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair])
    source = F.from_json(F.get_json_object("__b", "$.source"), _SOURCE)
    out = df.withColumn("op", F.try_element_at(names, letter)).withColumn("source", source)
    out = out.withColumn("table", F.coalesce("source.table", F.lit(""))).withColumn("schema", F.col("source.schema"))
    for side in ("before", "after"):
        out = out.withColumn(side, F.get_json_object("__b", f"$.{side}"))
    ts = F.coalesce(F.expr("try_cast(get_json_object(__b, '$.ts_ms') as bigint)"), F.lit(0).cast("long"))
    return out.withColumn("ts_ms", ts).withColumn("valid", F.col("op").isNotNull()).drop("__b")


def keep_operations(df: DataFrame, operations: Sequence[str] | None = None, tables: Sequence[str] | None = None, schema_changes: bool = False) -> DataFrame:
    """Valid changes of these operations and tables (all, if not given); schema changes only if asked for."""
    out = df.where("valid")
    if not schema_changes:
        out = out.where("op != 'schema_change'")
    if operations is not None:
        out = out.where(F.col("op").isin(*operations))
    return out if tables is None else out.where(F.col("table").isin(*tables))


def stats(df: DataFrame, order: Column | None = None) -> DataFrame:
    """Changes by operation, and the log position of the last of each."""
    order = F.struct("ts_ms", "partition", "offset") if order is None else order
    return df.where("valid").groupBy("op").agg(F.count(F.lit(1)).alias("changes"), F.max_by("source.lsn", order).alias("last_lsn"))


def table_state(df: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """table, key columns and row (JSON): the last image of each key that isn't deleted. Changes before their table's last truncate
    don't count. One aggregation by key."""
    order = F.struct("ts_ms", "partition", "offset") if order is None else order
    df = df.where("valid").withColumn("__order", order)
    cut = df.where("op = 'truncate'").groupBy("table").agg(F.max("__order").alias("__cut"))
    df = df.where("op not in ('truncate', 'schema_change')").join(cut, "table", "left")
    df = df.where(F.col("__cut").isNull() | (F.col("__order") > F.col("__cut")))
    image = F.coalesce("after", "before")
    named = [F.get_json_object(image, f"$['{k}']").alias(k) for k in keys]
    last = df.groupBy("table", *named).agg(F.max_by(F.struct("op", "after"), "__order").alias("r"))
    return last.where("r.op != 'delete'").select("table", *keys, F.col("r.after").alias("row"))
