"""The shared tables as topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.model import epoch_ms, to_topic
from eventlake.plans.engine import Engine


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four partitions by user, offsets by event id; props is a nested object."""
    df = table(spark, sf_dir, "events")
    value = F.struct("event_id", "event_type", "value", F.from_json("props", "struct<k:bigint>").alias("props"))
    return to_topic(df, "events", F.col("user_id"), epoch_ms("ts"), value, F.col("user_id"), ["event_id"], 4)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    value = F.struct("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return to_topic(df, "orders", F.col("o_orderkey"), epoch_ms("o_orderdate"), value, F.col("o_orderkey"), ["o_orderkey"], 4)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    value = F.struct("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return to_topic(df, "customers", F.col("c_custkey"), F.lit(0), value, F.col("c_custkey"), ["c_custkey"], 4)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per vector; a single partition whose offsets are the ids."""
    df = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    value = F.to_json(F.struct("embedding", "label"))
    key = F.col("vec_id").cast("string")
    return df.select(F.lit("vectors").alias("topic"), F.lit(0).alias("partition"), F.col("vec_id").alias("offset"), key.alias("key"), value.alias("value"), F.col("vec_id").alias("timestamp"))


TOPICS = {"events": events, "orders": orders, "customers": customers, "vectors": vectors}


def engine(spark: SparkSession, sf_dir: str, *topics: str, view_root: str | None = None) -> Engine:
    out = Engine(spark, view_root=view_root)
    for name in topics:
        out.catalog.add(name, TOPICS[name](spark, sf_dir))
    return out


#: DuckDB's form of the events topic, from the flat columns.
EVENTS_SQL = """e AS (SELECT 'events' AS topic, CAST(user_id % 4 AS INTEGER) AS "partition",
    row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS "offset", CAST(user_id AS VARCHAR) AS "key",
    epoch_us(ts) // 1000 AS "timestamp", event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
