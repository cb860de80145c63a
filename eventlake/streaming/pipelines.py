"""Pipelines: a topic's stream, an optional SQL transform over each batch, a sink; and the manager that runs them.

Batches are at least once: the checkpoint advances after the sink has taken a batch, also when the transform leaves no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventlake.errors import InvalidQuery, UnsupportedOperation
from eventlake.functions.sql import register
from eventlake.plans.dialect import _arrows
from eventlake.plans.lexer import join, statements, tokenize


def validate(sql: str) -> str:
    """A transform is exactly one query; returns it with arrows written as functions."""
    found = statements(tokenize(sql))
    if len(found) != 1:
        raise InvalidQuery("a transform is one statement")
    if found[0][0].word not in ("SELECT", "WITH", "VALUES") and found[0][0].text != "(":
        raise UnsupportedOperation("a transform is a query")
    words = {t.word for t in found[0]}
    if found[0][0].word == "WITH" and words & {"INSERT", "UPDATE", "DELETE", "MERGE"}:
        raise UnsupportedOperation("a transform is a query")
    return join(_arrows(found[0]))


def transform(batch: DataFrame, sql: str, topic: str | None = None) -> DataFrame:
    """The transform's rows over a batch, which is the view ``input`` (and the topic's name)."""
    spark = batch.sparkSession
    register(spark)
    batch.createOrReplaceTempView("input")
    if topic:
        batch.createOrReplaceTempView(f"`{topic}`")
    return spark.sql(validate(sql))


def to_records(rows: DataFrame) -> DataFrame:
    """Rows as records: the column ``value`` if there is one, else the whole row as JSON with its nulls; what is missing of the envelope is
    '' or 0."""
    names = set(rows.columns)
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})

    def own(name: str, kind: str, default) -> Column:
        return (F.coalesce(F.expr(f"try_cast(`{name}` AS {kind})"), F.lit(default)) if name in names else F.lit(default)).cast(kind).alias(name)

    key = F.col("key").cast("string") if "key" in names else F.lit(None).cast("string")
    kind = dict(rows.dtypes).get("value", "")
    given = F.to_json("value") if kind.startswith(("struct", "array", "map")) else F.col("value").cast("string") if kind else None
    value = whole if given is None else F.coalesce(given, F.lit(""))
    return rows.select(own("topic", "string", ""), own("partition", "int", 0), own("offset", "bigint", 0), key.alias("key"), value.alias("value"), own("timestamp", "bigint", 0))


@dataclass
class Pipeline:
    """source: a stream of records; sink: something with write(df, batch_id)."""

    name: str
    source: DataFrame
    sink: object
    checkpoint: str
    sql: str | None = None
    topic: str | None = None
    interval: str = "1 second"
    query: StreamingQuery | None = None

    def __post_init__(self) -> None:
        if self.sql:
            validate(self.sql)

    def _batch(self, df: DataFrame, batch_id: int) -> None:
        # sinks take a batch without rows, which leaves no files and posts nothing: no job is spent on asking
        self.sink.write(to_records(transform(df, self.sql, self.topic)) if self.sql else df, batch_id)

    def _writer(self):
        return self.source.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).queryName(self.name)

    def start(self) -> StreamingQuery:
        self.query = self._writer().trigger(processingTime=self.interval).start()
        return self.query

    def run_once(self) -> None:
        """Everything that is there now."""
        self._writer().trigger(availableNow=True).start().awaitTermination()

    def stop(self) -> None:
        """Stop; a later start resumes at the checkpoint."""
        if self.query and self.query.isActive:
            self.query.stop()
        self.query = None


@dataclass
class Continuous:
    """A continuous query of the manager."""

    id: str
    name: str
    begin: Callable[[], StreamingQuery]
    state: str = "running"
    started_at: float = field(default_factory=time.time)
    query: StreamingQuery | None = None


class Manager:
    """Submits, pauses, resumes, stops and lists continuous queries, up to a number of active ones."""

    def __init__(self, most: int = 64):
        self.most, self.queries, self._next = most, {}, 1

    def submit(self, name: str, begin: Callable[[], StreamingQuery]) -> str:
        if sum(q.state == "running" for q in self.queries.values()) >= self.most:
            raise InvalidQuery(f"{self.most} queries are running")
        q = Continuous(f"cq-{self._next}", name, begin)
        self._next += 1
        q.query = begin()
        self.queries[q.id] = q
        return q.id

    def _get(self, query_id: str) -> Continuous:
        if query_id not in self.queries:
            raise InvalidQuery(f"no such query: {query_id}")
        return self.queries[query_id]

    def pause(self, query_id: str) -> None:
        """Stop a query's work and keep its checkpoint."""
        q = self._get(query_id)
        if q.state != "running":
            raise InvalidQuery(f"{query_id} is {q.state}")
        q.query.stop()
        q.state = "paused"

    def resume(self, query_id: str) -> None:
        q = self._get(query_id)
        if q.state != "paused":
            raise InvalidQuery(f"{query_id} is {q.state}")
        q.query, q.state = q.begin(), "running"

    def stop(self, query_id: str) -> None:
        q = self._get(query_id)
        if q.state == "running":
            q.query.stop()
        q.state = "stopped"

    def stats(self, query_id: str) -> dict:
        q = self._get(query_id)
        progress = [p for p in q.query.recentProgress] if q.query else []
        rows = sum(p["numInputRows"] for p in progress)
        late = sum(o.get("numRowsDroppedByWatermark", 0) for p in progress for o in p["stateOperators"])
        if q.state == "running" and q.query.exception():
            q.state = "failed"
        return {"id": q.id, "name": q.name, "state": q.state, "batches": len(progress), "input_rows": rows, "late_rows": late}

    def list(self) -> list[dict]:
        return [self.stats(i) for i in sorted(self.queries, key=lambda i: int(i[3:]))]

    def reconcile(self, wanted: dict[str, Callable[[], StreamingQuery]]) -> None:
        """Run exactly the wanted queries, by name."""
        running = {q.name: q.id for q in self.queries.values() if q.state == "running"}
        for name in running.keys() - wanted.keys():
            self.stop(running[name])
        for name in sorted(wanted.keys() - running.keys()):
            self.submit(name, wanted[name])
