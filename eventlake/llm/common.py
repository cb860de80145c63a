"""What the operators share: the shared folder, bounded slices of Arrow batches, reading a table."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from eventlake.session import delete, shared_dir

T = TypeVar("T")
#: Bytes of text that an operator holds at once in Python (one longer text is a slice of its own).
SLICE = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in the one that driver and executors share."""
    return f"{shared_dir(spark)}/eventlake/{spark.sparkContext.applicationId}"


#: Tables that were spilled while a step runs.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    That cuts lineage: a lost executor costs a reread of these files, not the work before them. The table stays until settled(),
    discard() or clean() deletes it.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return _read(df.sparkSession, path, df.schema)


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out._table = path
    return out


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of make(), spilled; the tables that were spilled on the way are deleted."""
    made: list[str] = []
    token = _made.set(made)
    try:
        rows = make()
    finally:
        _made.reset(token)
    out = spill(rows, name)
    delete(spark, *made)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete spilled tables that nothing needs any more."""
    for t in tables:
        delete(t.sparkSession, t._table)


def clean(spark: SparkSession) -> None:
    """Delete all tables of this application, at its end."""
    delete(spark, work_dir(spark))


#: What a Python worker keeps from task to task, by key.
_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], T]) -> T:
    """make(), made once by a worker. Workers go on to tasks of other operators, whose slices() let go of it."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Return memory that is free in this process to the system, where the allocator has a way; else it stays the worker's until it ends."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE, keep: object = None) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in slices of limit bytes of text at most, or of one row.

    Of what the worker keeps from earlier tasks, all but ``keep`` goes first. Then and in the end free memory goes back to the system.
    """
    for key in [k for k, x in _kept.items() if x is not keep]:
        del _kept[key]
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
    give_back()
