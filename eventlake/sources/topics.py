"""Reading and writing topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.errors import OffsetNotFound
from eventlake.model import COLUMNS, partition_of_key
from eventlake.operators.numbering import by_running_number, numbered


#: Offsets of a partition that one task sorts and writes.
SPAN = 1 << 20


def by_offset_span(df: DataFrame, span: int = SPAN) -> DataFrame:
    """Records laid out by topic, partition and span of offsets, sorted; a partition of any size takes as many tasks as it has spans."""
    return df.repartition("topic", "partition", F.floor(F.col("offset") / span)).sortWithinPartitions("topic", "partition", "offset")


def write_topic(df: DataFrame, path: str, mode: str = "append", bloom_on_key: bool = True, span: int = SPAN) -> None:
    """Write records by partition, sorted by offset, so that footers prune by partition, offset and time; with a bloom filter on keys."""
    writer = by_offset_span(df, span).write.mode(mode)
    if bloom_on_key:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true")
    writer.partitionBy("topic", "partition").parquet(path)


def read_topic(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.withColumn("topic", F.col("topic").cast("string"))
    return (df if topic is None else df.where(F.col("topic") == topic)).select(*COLUMNS)


def read_lines(spark: SparkSession, path: str, topic: str, partition: int = 0, base_offset: int = 0, created_at: int = 0) -> DataFrame:
    """NDJSON files of {key, value, timestamp}. A line that is no JSON object is a value itself, with the file's time.

    Offsets follow the order of lines in each file, files in the order of their names.
    """
    # a split of a file is read in order by one task, so that its lines have running numbers
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("__at")
    )
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    inner = F.get_json_object("value", "$.value")
    out = by_running_number(lines, [], F.struct("file", "block"), "place").select(
        F.lit(topic).alias("topic"), F.lit(partition).alias("partition"), (F.col("place") + base_offset).alias("offset"),
        F.when(ok, F.get_json_object("value", "$.key")).alias("key"),
        F.when(ok & inner.isNotNull(), inner).otherwise(F.col("value")).alias("value"),
        F.coalesce(F.when(ok, F.expr("try_cast(get_json_object(value, '$.timestamp') as bigint)")), F.lit(created_at).cast("long")).alias("timestamp"),
    )
    return out


def consume(df: DataFrame, partition: int, offset: int = 0, max_records: int = 100, strict: bool = False) -> DataFrame:
    """Up to max_records records of a partition from an offset on, in order. ``strict`` raises if there are none."""
    out = df.where((F.col("partition") == partition) & (F.col("offset") >= offset)).orderBy("offset").limit(max_records)
    if strict and out.isEmpty():
        raise OffsetNotFound(f"partition {partition}, offset {offset}")
    return out


def produce(df: DataFrame, topic: str, partitions: int, ends: dict[int, int] | None = None) -> DataFrame:
    """Rows (key, value, timestamp, and optionally partition) as records after the ends of a topic's partitions."""
    given = F.col("partition") if "partition" in df.columns else F.lit(None).cast("int")
    df = df.withColumn("__p", F.coalesce(given, partition_of_key("key", partitions, F.xxhash64("timestamp", "value"))))
    start = F.create_map(*[F.lit(x) for p, n in (ends or {-1: 0}).items() for x in (p, n)])
    placed = numbered(df, ["__p"], ["timestamp", "key", "value"], "__place")
    offset = F.coalesce(F.try_element_at(start, F.col("__p")), F.lit(0)) + F.col("__place")
    return placed.select(F.lit(topic).alias("topic"), F.col("__p").alias("partition"), offset.cast("long").alias("offset"), "key", "value", "timestamp")
