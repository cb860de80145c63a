"""Log maintenance: compaction by key, tombstones, dirtiness, sequence checks and retention."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.session import complete, delete
from eventlake.sources.topics import by_offset_span, read_topic

DAY_MS = 24 * 3600 * 1000


def compact(df: DataFrame, now_ms: int, tombstone_ms: int = DAY_MS) -> DataFrame:
    """The record of the highest offset of each (topic, partition, key), and all records without a key (NULL or empty).

    An empty value is a tombstone: it hides earlier records of its key, and goes itself once it is tombstone_ms old. One shuffle
    with partial aggregation, so that a hot key costs a row per task.
    """
    keyed = F.coalesce(F.col("key"), F.lit("")) != ""
    record = F.struct(*df.columns)
    last = df.where(keyed).groupBy("topic", "partition", "key").agg(F.max_by(record, "offset").alias("r")).select("r.*")
    expired = (F.length("value") == 0) & (F.lit(now_ms) - F.col("timestamp") >= tombstone_ms)
    return last.where(~expired).unionByName(df.where(~keyed))


def eligible(segments: DataFrame, now_ms: int, min_age_ms: int = 3600 * 1000, min_segments: int = 2, max_rows: int = 1_000_000) -> DataFrame:
    """Segments (topic, partition, base_offset, record_count, created_at) that a run compacts: old enough, at least min_segments of
    their partition, the first ones up to max_rows rows."""
    own = Window.partitionBy("topic", "partition")
    old = segments.where(F.lit(now_ms) - F.col("created_at") >= min_age_ms)
    old = old.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("rows_so_far", F.sum("record_count").over(own.orderBy("base_offset")))
    return old.where((F.col("n") >= min_segments) & (F.col("rows_so_far") <= max_rows)).drop("n", "rows_so_far")


def dirty_ratio(df: DataFrame) -> DataFrame:
    """topic, partition, records, keys and the share of records that a later one of their key hides."""
    out = df.where("key is not null").groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("key").alias("keys"))
    return out.withColumn("dirty_ratio", F.lit(1.0) - F.col("keys") / F.col("records"))


def needs_compaction(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return dirty_ratio(df).where(F.col("dirty_ratio") >= threshold)


def replace_partition(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Overwrite only those (topic, partition) folders of a topic store that df has rows of. df must not be read from the same folder at
    that time; compact_store() sees to that."""
    by_offset_span(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("topic", "partition").parquet(path)


def compact_store(spark: SparkSession, path: str, now_ms: int, tombstone_ms: int = DAY_MS, threshold: float | None = None) -> list[tuple[str, int]]:
    """Compact a topic store in place; returns the (topic, partition) pairs that were written. Only those whose dirty ratio reaches
    ``threshold`` are (all, without one).

    The compacted records are written to a folder beside the data first, which readers do not see, and replace the partitions once it
    is whole. A run that fails between leaves that folder; the next one finishes its replacement before anything else. Nothing else
    may write to the store meanwhile.
    """
    folder = f"{path.rstrip('/')}/_compaction"
    done = [p for name in complete(spark, folder) for p in _finish(spark, f"{folder}/{name}", path)]
    delete(spark, folder)
    records = read_topic(spark, path)
    if threshold is not None:
        dirty = needs_compaction(records, threshold).select("topic", "partition").collect()
        if not dirty:
            return sorted(done)
        # a condition on the folders, so that no others are read
        records = records.where(F.struct("topic", "partition").isin([F.struct(F.lit(r["topic"]), F.lit(r["partition"])) for r in dirty]))
    staged = f"{folder}/{uuid.uuid4().hex}"
    by_offset_span(compact(records, now_ms, tombstone_ms)).write.partitionBy("topic", "partition").parquet(staged)
    done += _finish(spark, staged, path)
    delete(spark, folder)
    return sorted(done)


def _finish(spark: SparkSession, staged: str, path: str) -> list[tuple[str, int]]:
    """Replace the partitions that a staged folder holds, and delete it."""
    records = read_topic(spark, staged)
    replace_partition(spark, records, path)
    found = [(r["topic"], r["partition"]) for r in records.select("topic", "partition").distinct().collect()]
    delete(spark, staged)
    return found


def _first(n: np.ndarray, at: int, hits: Callable[[np.ndarray, int], np.ndarray]) -> int:
    """The first place from ``at`` on that hits(part, place of the part), looked for in growing parts; the end if there is none."""
    width, place = 64, at
    while place < len(n):
        found = hits(n[place : place + width], place)
        if found.any():
            return place + int(found.argmax())
        place, width = min(len(n), place + width), 2 * width
    return len(n)


def _statuses(n: np.ndarray, last: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """The last accepted sequence before each record (-1: none) and its status (0 ok, 1 duplicate, 2 gap), run by run."""
    before, status, at = np.full(len(n), -1), np.zeros(len(n), np.int8), 0
    if last is None and len(n):
        last, at = int(n[0]), 1
    while at < len(n):
        # a run of accepted records, and the refused ones up to the next that is accepted
        end = _first(n, at, lambda part, place, at=at, last=last: part != last + 1 + np.arange(place - at, place - at + len(part)))
        before[at:end] = last + np.arange(end - at)
        at, last = end, last + end - at
        end = _first(n, at, lambda part, _, last=last: part == last + 1)
        before[at:end] = last
        status[at:end] = np.where(n[at:end] <= last, 1, 2)
        at = end
    return before, status, last


def sequence_status(df: DataFrame, producer: str = "producer_id", sequence: str = "sequence", order: str = "offset") -> DataFrame:
    """df with last_sequence (the producer's last accepted one in the partition so far) and status: ok, duplicate (not above it) or
    gap (more than one above it; it is not accepted). Sequences are numbers from 0.

    Whether a record is accepted hangs on all before it, which no window function expresses: records are laid out by producer
    and read in order, run by run, with one number of state.
    """
    keys = [producer, "topic", "partition"]
    laid = df.repartition(*keys).sortWithinPartitions(*keys, order)
    names, states = df.columns, pa.array(["ok", "duplicate", "gap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k).to_pylist() for k in keys]
            same = np.ones(batch.num_rows, bool)
            same[0] = False
            for c in own:
                coded = pa.array(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                same[1:] &= coded[1:] == coded[:-1]
            n = batch.column(sequence).to_numpy(zero_copy_only=False)
            before, status, first = np.full(len(n), -1), np.zeros(len(n), np.int8), np.flatnonzero(~same)
            for a, b in zip(first, [*first[1:], len(n)], strict=True):
                now = tuple(c[a] for c in own)
                if now != key:
                    key, last = now, None
                before[a:b], status[a:b], last = _statuses(n[a:b], last)
            found = [pa.array(before, pa.int64(), mask=before < 0), states.take(pa.array(status))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], names=[*names, "last_sequence", "status"])

    return laid.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", last_sequence long, status string")


def retain(df: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """Records younger than the retention."""
    return df.where(F.col("timestamp") >= now_ms - retention_ms)
