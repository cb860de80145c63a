"""Time windows over the envelope's timestamp: tumbling, hopping and session windows, with bounds in milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIME = "__time"


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn(_TIME, F.timestamp_millis("timestamp"))


def _finish(grouped: DataFrame, end: Column | None = None) -> DataFrame:
    rest = [c for c in grouped.columns if c not in ("window",)]
    start = F.unix_millis("window.start").alias("window_start")
    return grouped.select(start, (F.unix_millis("window.end") if end is None else end).alias("window_end"), *rest)


def tumble(df: DataFrame, size_ms: int, keys: Sequence[Column | str], aggregates: Sequence[Column]) -> DataFrame:
    """window_start, window_end, keys, aggregates. Windows begin at multiples of the size."""
    window = F.window(_TIME, f"{size_ms} milliseconds").alias("window")
    return _finish(_timed(df).groupBy(window, *keys).agg(*aggregates))


def hop(df: DataFrame, size_ms: int, slide_ms: int, keys: Sequence[Column | str], aggregates: Sequence[Column], leading: bool = True) -> DataFrame:
    """Windows of a size that begin every slide. Without ``leading``, none begins before the first event's own slide.

    A slide larger than the size leaves gaps whose events are in no window.
    """
    if slide_ms > size_ms:
        start = F.floor(F.col("timestamp") / slide_ms) * slide_ms
        df = df.withColumn("window_start", start.cast("long")).where(F.col("timestamp") < F.col("window_start") + size_ms)
        out = df.groupBy("window_start", *keys).agg(*aggregates)
        return out.select("window_start", (F.col("window_start") + size_ms).alias("window_end"), *out.columns[1:])
    window = F.window(_TIME, f"{size_ms} milliseconds", f"{slide_ms} milliseconds").alias("window")
    out = _finish(_timed(df).groupBy(window, *keys).agg(*aggregates))
    if leading:
        return out
    first = df.agg((F.floor(F.min("timestamp") / slide_ms) * slide_ms).cast("long").alias("__first"))
    return out.crossJoin(F.broadcast(first)).where("window_start >= __first").drop("__first")


def session(df: DataFrame, gap_ms: int, keys: Sequence[Column | str], aggregates: Sequence[Column]) -> DataFrame:
    """Sessions per key: a gap longer than gap_ms begins a new one. window_end is the last event's time."""
    window = F.session_window(_TIME, f"{gap_ms} milliseconds").alias("window")
    return _finish(_timed(df).groupBy(window, *keys).agg(*aggregates), F.unix_millis("window.end") - gap_ms)


def late_classes(df: DataFrame, delay_ms: int = 5000, grace_ms: int = 5000, span: int = 1 << 20) -> DataFrame:
    """df with the watermark (the largest time so far in the partition, by offset, less the delay) and the class of each record:
    on_time at or after the watermark that stood before it, late within the grace, too_late beyond.

    A partition is read in spans of offsets, each in a task of its own, after the largest time of each span is known.
    """
    from pyspark.sql import Window

    keys, names = ["topic", "partition", "__span"], df.columns
    df = df.withColumn("__span", F.floor(F.col("offset") / span))
    most = df.groupBy(*keys).agg(F.max("timestamp").alias("__most"))
    earlier = Window.partitionBy("topic", "partition").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    most = most.withColumn("__earlier", F.max("__most").over(earlier)).drop("__most")
    before = Window.partitionBy(*keys).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    largest = F.greatest(F.max("timestamp").over(before), F.col("__earlier"))
    df = df.join(most, keys).withColumn("watermark", largest - delay_ms).select(*names, "watermark")
    lag = F.col("watermark") - F.col("timestamp")
    return df.withColumn("lateness", F.when(lag.isNull() | (lag <= 0), "on_time").when(lag <= grace_ms, "late").otherwise("too_late"))


def global_watermark(df: DataFrame, delay_ms: int = 5000, idle_ms: int | None = None) -> DataFrame:
    """One row per topic: the least watermark of its partitions, leaving out those whose last record is older than idle_ms
    (compared with the newest of all)."""
    per = df.groupBy("topic", "partition").agg(F.max("timestamp").alias("last"))
    if idle_ms is not None:
        newest = per.groupBy("topic").agg(F.max("last").alias("newest"))
        per = per.join(newest, "topic").where(F.col("newest") - F.col("last") <= idle_ms)
    return per.groupBy("topic").agg((F.min("last") - delay_ms).alias("watermark"))
