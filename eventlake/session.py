"""The SparkSession with the settings that the engine relies on."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile

from pyspark.sql import SparkSession

from eventlake.errors import SharedFolderUnset

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str | None = None, settings: dict[str, str] | None = None) -> SparkSession:
    """A session with SETTINGS; those given here come on top."""
    builder = SparkSession.builder.appName("eventlake")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | (settings or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, whose driver is the executor, gets one of
    its own where that is unset; on a cluster each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise SharedFolderUnset(f"spark.checkpoint.dir must name a shared folder on {master}")
    return _own()


@functools.cache
def _own() -> str:
    """A local folder of this process, which is removed at its end."""
    path = tempfile.mkdtemp(prefix="eventlake-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders in whatever store holds them; missing ones are no error."""
    jvm = spark._jvm
    for path in map(jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def complete(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder whose write was completed; none if it is missing."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(top):
        return []
    found = [s.getPath() for s in fs.listStatus(top)]
    return [p.getName() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def store_text(spark: SparkSession, folder: str, text: str) -> None:
    """Write a small text as a folder of one file, which is complete() once it is whole. No job is run."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.delete(top, True)
    for name, body in (("part-00000.txt", text.encode()), ("_SUCCESS", b"")):
        out = fs.create(jvm.org.apache.hadoop.fs.Path(top, name))
        try:
            out.write(bytearray(body))
        finally:
            out.close()
