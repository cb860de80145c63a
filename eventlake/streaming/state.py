"""Stateful streaming operators of our own: sequence checks of producers, and a keyed store with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

_STATUS = "producer_id string, partition int, sequence long, status string"


class SequenceCheck(StatefulProcessor):
    """Status of each record against the producer's last accepted sequence: ok, duplicate or gap."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("sequence", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        found = pd.concat(list(rows)).sort_values("offset", kind="stable")
        status = []
        for n in found["sequence"]:
            ok = last is None or n == last + 1
            status.append("ok" if ok else "duplicate" if n <= last else "gap")
            last = int(n) if ok else last
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame({"producer_id": found["producer_id"], "partition": found["partition"], "sequence": found["sequence"], "status": status})

    def close(self) -> None:
        pass


def check_sequences(stream: DataFrame) -> DataFrame:
    """Records (producer_id, partition, offset, sequence) with their status; one number of state for each producer and partition.

    Needs the RocksDB state store.
    """
    return stream.groupBy("producer_id", "partition").transformWithStateInPandas(SequenceCheck(), _STATUS, "Append", "None")


class LatestValue(StatefulProcessor):
    """The latest value of each key, which expires when it wasn't written for a time."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("value", StringType()), StructField("offset", LongType())])
        self.value = handle.getValueState("value", schema, ttlDurationMs=self.ttl_ms) if self.ttl_ms else handle.getValueState("value", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("offset", kind="stable").iloc[-1]
        # an empty value deletes the key
        if found["value"] == "":
            self.value.clear()
        else:
            self.value.update((found["value"], int(found["offset"])))
        yield pd.DataFrame({"key": [key[0]], "value": [found["value"]], "offset": [int(found["offset"])]})

    def close(self) -> None:
        pass


def latest_values(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A changelog of each key's latest value; state is one value a key. With an expiry Spark also runs batches without data, to drop
    what expired: a flow that is to end at the end of its input needs spark.sql.streaming.noDataMicroBatches.enabled=false."""
    mode = "ProcessingTime" if ttl_ms else "None"
    return stream.groupBy("key").transformWithStateInPandas(LatestValue(ttl_ms), "key string, value string, offset long", "Update", mode)
