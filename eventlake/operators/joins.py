"""Joins of topics: equi-joins on keys or payload fields, stream with table state, and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATEST = ("timestamp", "partition", "offset")


def latest_per_key(df: DataFrame, key: Column | str = "key", order: Sequence[str] = LATEST) -> DataFrame:
    """The last record of each key, null keys left out. One shuffle, after partial aggregation."""
    key = F.col(key) if isinstance(key, str) else key
    columns = df.columns
    last = df.where(key.isNotNull()).groupBy(key.alias("__key")).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r"))
    return last.select("r.*")


def equi_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, how: str = "inner", names: tuple[str, str] = ("l", "r")) -> DataFrame:
    """Columns of both sides as ``l.x`` and ``r.x``. Keys are compared as text; null keys match nothing and outer joins keep them."""
    a = left.withColumn("__lk", left_key.cast("string"))
    b = right.withColumn("__rk", right_key.cast("string"))
    a = a.select("__lk", *[F.col(c).alias(f"{names[0]}.{c}") for c in left.columns])
    b = b.select("__rk", *[F.col(c).alias(f"{names[1]}.{c}") for c in right.columns])
    return a.join(b, F.col("__lk") == F.col("__rk"), how).drop("__lk", "__rk")


def stream_table(stream: DataFrame, table: DataFrame, stream_key: Column, table_key: Column, how: str = "inner", names: tuple[str, str] = ("l", "r"), order: Sequence[str] = LATEST) -> DataFrame:
    """Each record of the stream with the table's last record of its key."""
    return equi_join(stream, latest_per_key(table, table_key, order), stream_key, table_key, how, names)


def _near(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, within_ms: int, names: tuple[str, str], how: str) -> DataFrame:
    """The left side's rows in their bucket of time, the right side's in their own and both beside it; __hit is null without partner."""
    bucket = F.floor(F.col("timestamp") / within_ms)
    a = left.select(left_key.cast("string").alias("__lk"), bucket.alias("__lb"), F.col("timestamp").alias("__lt"), *[F.col(c).alias(f"{names[0]}.{c}") for c in left.columns])
    around = F.explode(F.array(bucket - 1, bucket, bucket + 1))
    b = right.select(right_key.cast("string").alias("__rk"), around.alias("__rb"), F.col("timestamp").alias("__hit"), *[F.col(c).alias(f"{names[1]}.{c}") for c in right.columns])
    near = (F.col("__lk") == F.col("__rk")) & (F.col("__lb") == F.col("__rb")) & (F.abs(F.col("__lt") - F.col("__hit")) <= within_ms)
    return a.join(b, near, how).drop("__lk", "__lb", "__lt", "__rk", "__rb")


def interval_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, within_ms: int, how: str = "inner", names: tuple[str, str] = ("l", "r")) -> DataFrame:
    """Pairs of equal keys whose timestamps differ by within_ms at most; outer joins add the rows that have no partner.

    Time is cut in buckets of within_ms, so that a hot key is split by time and rows are compared within three buckets only.
    """
    if how in ("inner", "left"):
        return _near(left, right, left_key, right_key, within_ms, names, how).drop("__hit")
    other = _near(right, left, right_key, left_key, within_ms, names[::-1], "left")
    columns = [f"`{names[0]}.{c}`" for c in left.columns] + [f"`{names[1]}.{c}`" for c in right.columns]
    if how == "right":
        return other.select(*columns)
    if how != "full":
        raise ValueError(f"no such join: {how}")
    alone = other.where(F.col("__hit").isNull())
    return _near(left, right, left_key, right_key, within_ms, names, "left").select(*columns).unionByName(alone.select(*columns))
