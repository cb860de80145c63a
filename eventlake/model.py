"""The data model: topics of records with a fixed envelope and a JSON payload that is read at query time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType([
    T.StructField("topic", T.StringType(), False),
    T.StructField("partition", T.IntegerType(), False),
    T.StructField("offset", T.LongType(), False),
    T.StructField("key", T.StringType(), True),
    T.StructField("value", T.StringType(), False),
    T.StructField("timestamp", T.LongType(), False),
])
COLUMNS = ENVELOPE.names


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since the epoch (cut off, not rounded) of a timestamp with or without a time zone."""
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def as_time(df: DataFrame, name: str = "ts") -> DataFrame:
    """df with the envelope's timestamp as a timestamp column."""
    return df.withColumn(name, F.timestamp_millis("timestamp"))


def to_topic(
    df: DataFrame, topic: str, key: Column, timestamp: Column, value: Column, partition: Column, order: Sequence[Column | str], partitions: int | None = None
) -> DataFrame:
    """Rows as records of a topic. Offsets are dense in each partition, by ``order``.

    The value is a struct (written as JSON, nulls left out) or a text. Offsets need one shuffle: by partition, or by ranges of it where
    the input is large.
    """
    from eventlake.operators.numbering import numbered


    part = (F.pmod(partition, F.lit(partitions)) if partitions else partition).cast("int")
    body = df.select(part.alias("partition"), key.cast("string").alias("key"), timestamp.cast("long").alias("timestamp"), value.alias("value"), *[(F.col(c) if isinstance(c, str) else c).alias(f"__o{i}") for i, c in enumerate(order)])
    if not isinstance(body.schema["value"].dataType, T.StringType):
        body = body.withColumn("value", F.to_json("value"))
    body = numbered(body, ["partition"], [f"__o{i}" for i in range(len(order))], "offset")
    return body.select(F.lit(topic).alias("topic"), "partition", "offset", "key", "value", "timestamp")


#: Fixed values of the hash of keys that producers use (murmur2): seed, multiplier, shift of a word.
_SEED, _TIMES, _SHIFT = 0x9747B28C, 0x5BD1E995, 24


def murmur2(key: Column | str) -> Column:
    """The unsigned 32-bit murmur2 hash of a key's UTF-8 bytes, as producers compute it; built of SQL functions."""
    raw = F.encode(F.col(key) if isinstance(key, str) else key, "UTF-8")
    size, digits = F.octet_length(raw), F.hex(raw)

    def low(x: Column) -> Column:
        return x.bitwiseAND(F.lit(0xFFFFFFFF))

    def number(first: Column, n: int) -> Column:
        """n bytes from a place on, the lowest first."""
        each = [F.conv(F.substring(digits, 2 * (first + i) + 1, F.lit(2)), 16, 10).cast("long") * (1 << 8 * i) for i in range(n)]
        return sum(each[1:], each[0])

    def times(x: Column) -> Column:
        return low(x * F.lit(_TIMES).cast("long"))

    def stirred(x: Column, shift: int) -> Column:
        return x.bitwiseXOR(F.shiftright(x, shift))

    words = F.when(size >= 4, F.sequence(F.lit(0), F.floor(size / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    first = F.lit(_SEED).cast("long").bitwiseXOR(size.cast("long"))
    h = F.aggregate(words, first, lambda h, i: times(h).bitwiseXOR(times(stirred(times(number(4 * i, 4)), _SHIFT))))
    rest, at = size % 4, size - size % 4
    tail = F.when(rest == 1, number(at, 1)).when(rest == 2, number(at, 2)).when(rest == 3, number(at, 3))
    h = F.when(rest == 0, h).otherwise(times(h.bitwiseXOR(tail)))
    return stirred(times(stirred(h, 13)), 15)


def partition_of_key(key: Column | str, partitions: int, spread: Column | None = None) -> Column:
    """A key's partition, the same that producers choose. Keyless records are dealt out by ``spread`` (a number), which says the
    same when a task is run again; by default in turn."""
    key = F.col(key) if isinstance(key, str) else key
    spread = F.monotonically_increasing_id() if spread is None else spread
    return F.pmod(F.when(key.isNull(), spread).otherwise(murmur2(key)), F.lit(partitions)).cast("int")
