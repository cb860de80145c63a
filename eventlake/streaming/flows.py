"""Streaming windows and joins, and running a flow over a finite input to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.model import ENVELOPE
from eventlake.session import shared_dir

DELAY = "5 seconds"


def _time(df: DataFrame, delay: str) -> DataFrame:
    if "__time" in df.columns:
        return df
    return df.withColumn("__time", F.timestamp_millis("timestamp")).withWatermark("__time", delay)


def by_partition(stream: DataFrame, partitions: Sequence[int], delay: str = DELAY) -> DataFrame:
    """A stream whose watermark is the least of its partitions': each is watermarked alone, and Spark takes the minimum of all
    (spark.sql.streaming.multipleWatermarkPolicy, whose default that is). The time column is __time."""
    out = None
    for p in partitions:
        own = _time(stream.where(F.col("partition") == p), delay)
        out = own if out is None else out.union(own)
    return out


def tumble(stream: DataFrame, size_ms: int, keys: Sequence[Column], aggregates: Sequence[Column], delay: str = DELAY) -> DataFrame:
    """Windows that are emitted once, when the watermark passes their end; later records of a window are dropped and counted by
    Spark (numRowsDroppedByWatermark)."""
    out = _time(stream, delay).groupBy(F.window("__time", f"{size_ms} milliseconds").alias("w"), *keys).agg(*aggregates)
    return out.select(F.unix_millis("w.start").alias("window_start"), F.unix_millis("w.end").alias("window_end"), *out.columns[1:])


def hop(stream: DataFrame, size_ms: int, slide_ms: int, keys: Sequence[Column], aggregates: Sequence[Column], delay: str = DELAY) -> DataFrame:
    window = F.window("__time", f"{size_ms} milliseconds", f"{slide_ms} milliseconds").alias("w")
    out = _time(stream, delay).groupBy(window, *keys).agg(*aggregates)
    return out.select(F.unix_millis("w.start").alias("window_start"), F.unix_millis("w.end").alias("window_end"), *out.columns[1:])


def session(stream: DataFrame, gap_ms: int, keys: Sequence[Column], aggregates: Sequence[Column], delay: str = DELAY) -> DataFrame:
    """Sessions; window_end is the last event's time. Spark wants a key beside the session; without one a constant stands in."""
    keys = list(keys) or [F.lit(0).alias("__all")]
    out = _time(stream, delay).groupBy(F.session_window("__time", f"{gap_ms} milliseconds").alias("w"), *keys).agg(*aggregates)
    rest = [c for c in out.columns[1:] if c != "__all"]
    return out.select(F.unix_millis("w.start").alias("window_start"), (F.unix_millis("w.end") - gap_ms).alias("window_end"), *rest)


def interval_join(left: DataFrame, right: DataFrame, within_ms: int, how: str = "inner", delay: str = DELAY) -> DataFrame:
    """Pairs of equal keys within within_ms, columns as l_x and r_x. Outer rows come once the watermark shows that no partner can."""
    sides = []
    for df, side in ((left, "l"), (right, "r")):
        df = df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])
        sides.append(df.withColumn(f"{side}_time", F.timestamp_millis(f"{side}_timestamp")).withWatermark(f"{side}_time", delay))
    step = f"INTERVAL '{within_ms // 1000}.{within_ms % 1000:03}' SECOND"
    near = F.expr(f"l_key = r_key AND r_time >= l_time - {step} AND r_time <= l_time + {step}")
    out = sides[0].join(sides[1], near, {"inner": "inner", "left": "leftOuter", "right": "rightOuter", "full": "fullOuter"}[how])
    return out.drop("l_time", "r_time")


def deduplicated(stream: DataFrame, keys: Sequence[str] = ("producer_id", "partition", "sequence"), delay: str = "10 minutes") -> DataFrame:
    """Each record once, however often it was produced within the delay."""
    return _time(stream, delay).dropDuplicatesWithinWatermark(list(keys)).drop("__time")


def open_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A topic's folder as a stream."""
    reader = spark.readStream.schema(ENVELOPE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_to_end(flow: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a flow over all that is there, writing Parquet."""
    q = flow.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/flows/{uuid.uuid4().hex}"


def replay(records: DataFrame, flow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a flow emits for a finite topic: records are written, streamed to the end and the output is read."""
    spark, folder = records.sparkSession, work_folder(records.sparkSession)
    records.write.parquet(f"{folder}/in")
    out = flow(open_stream(spark, f"{folder}/in"))
    run_to_end(out, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def pipeline_roundtrip(records: DataFrame, sql: str) -> DataFrame:
    """What a pipeline with a file sink leaves for a finite topic."""
    from eventlake.sources.connectors import FileSink
    from eventlake.streaming.pipelines import Pipeline

    spark, folder = records.sparkSession, work_folder(records.sparkSession)
    records.write.parquet(f"{folder}/in")
    sink = FileSink(f"{folder}/out", "parquet", "daily")
    Pipeline("roundtrip", open_stream(spark, f"{folder}/in"), sink, f"{folder}/checkpoint", sql).run_once()
    return spark.read.schema(ENVELOPE).parquet(f"{folder}/out")
