"""Checkpoints of continuous queries: what they hold, copies by name, and reading keyed state.

A query's checkpoint is Spark's: it advances batch by batch, and keeps as many as spark.sql.streaming.minBatchesToRetain. Copies are
taken of stopped queries; each is written under another name and moved into place, so that a copy is whole or not there.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.errors import CheckpointNotFound, InvalidQuery
from eventlake.session import delete


def _store(spark: SparkSession, path: str):
    """The Hadoop path and the store that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _names(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Time of change and name of what a folder holds; none if it is missing."""
    at, fs = _store(spark, path)
    return [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(at)] if fs.exists(at) else []


def batches(spark: SparkSession, checkpoint: str) -> list[int]:
    """Numbers of the committed batches that a checkpoint keeps, the oldest first."""
    return sorted(int(name) for _, name in _names(spark, f"{checkpoint}/commits") if name.isdigit())


def owner(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to."""
    at, fs = _store(spark, f"{checkpoint}/metadata")
    if not fs.exists(at):
        raise CheckpointNotFound(checkpoint)
    return json.loads(spark.read.text(at.toString()).first()["value"])["id"]


def saved(spark: SparkSession, root: str) -> list[str]:
    """Names of the copies in a folder, the oldest first."""
    found = [name.split("-", 1) for _, name in _names(spark, root) if not name.startswith("_")]
    return [name for _, name in sorted((int(at), name) for at, name in found)]


def _copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a folder beside its place and move it there."""
    a, from_fs = _store(spark, source)
    part, fs = _store(spark, f"{target.rpartition('/')[0]}/_{target.rpartition('/')[2]}")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    fs.delete(part, True)
    fs.mkdirs(part.getParent())
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, a, fs, part, False, conf)
    to, _ = _store(spark, target)
    fs.delete(to, True)
    fs.rename(part, to)


def save(spark: SparkSession, checkpoint: str, root: str, name: str, keep: int | None = None) -> None:
    """Copy a stopped query's checkpoint; only the ``keep`` newest copies stay. A copy of the same name is replaced."""
    if "/" in name or not batches(spark, checkpoint):
        raise InvalidQuery(f"no checkpoint {name!r} of {checkpoint}")
    _drop(spark, root, {name})
    _copy(spark, checkpoint, f"{root}/{time.time_ns()}-{name}")
    if keep is not None:
        _drop(spark, root, set(saved(spark, root)[: -keep or None]))


def _drop(spark: SparkSession, root: str, names: set[str]) -> None:
    delete(spark, *[f"{root}/{full}" for _, full in _names(spark, root) if full.partition("-")[2] in names])


def drop(spark: SparkSession, root: str, name: str) -> None:
    _drop(spark, root, {name})


def restore(spark: SparkSession, root: str, name: str, checkpoint: str, query_id: str | None = None) -> None:
    """Put a copy in the place of a checkpoint. With a query's id, a copy of another query is refused."""
    full = next((f for _, f in _names(spark, root) if f.partition("-")[2] == name), None)
    if full is None:
        raise CheckpointNotFound(f"{root}: {name}")
    if query_id is not None and owner(spark, f"{root}/{full}") != query_id:
        raise InvalidQuery(f"{name} belongs to another query")
    _copy(spark, f"{root}/{full}", checkpoint.rstrip("/"))


def read_state(spark: SparkSession, checkpoint: str, variable: str, prefix: str | None = None, batch: int | None = None) -> DataFrame:
    """key and value of a keyed state variable as of the last batch (or one that is kept), of keys that begin with a prefix."""
    reader = spark.read.format("statestore").option("stateVarName", variable)
    if batch is not None:
        reader = reader.option("batchId", batch)
    out = reader.load(checkpoint)
    return out if prefix is None else out.where(F.startswith(F.col(f"key.{out.schema['key'].dataType.names[0]}").cast("string"), F.lit(prefix)))
