"""Materialized views: aggregates of a topic, kept as mergeable parts, so that refreshing reads and writes new records only.

A view's table is a list of segments. Each refresh appends one: a row per group and window of the new records with parts of each
aggregate (counts and sums add up, minima and maxima combine, first and last carry their order). For a distinct count,
the values of each group are rows of a second table, so that no group's values are ever held in one row. Reading merges the segments
and finishes the parts. Segments of like size are merged from time to time, so that their number grows with the logarithm of the
records and each row is rewritten as often. The registry moves a view's segments and offsets together; segments that were
merged stay for one more refresh, for those who read them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.errors import InvalidQuery, ViewAlreadyExists, ViewNotFound
from eventlake.operators.aggs import ORDER
from eventlake.session import complete, delete, store_text

MODES = {"continuous": "continuous", "stream": "continuous", "streaming": "continuous", "manual": "manual", "on_demand": "manual", "periodic": "periodic", "scheduled": "periodic"}
DEFAULT_INTERVAL_MS = 5 * 60 * 1000


@dataclass(frozen=True)
class Aggregate:
    """An aggregate of a view: kind (count, count_distinct, sum, avg, min, max, first, last), value and name."""

    kind: str
    value: Column | None
    name: str

    def parts(self) -> list[Column]:
        """Aggregates over records."""
        n, v = self.name, self.value
        if self.kind == "count":
            return [F.count(F.lit(1) if v is None else v).alias(f"{n}__n")]
        if self.kind == "sum":
            return [F.sum(v).alias(f"{n}__s")]
        if self.kind == "avg":
            return [F.sum(v).alias(f"{n}__s"), F.count(v).alias(f"{n}__n")]
        if self.kind in ("min", "max"):
            return [getattr(F, self.kind)(v).alias(f"{n}__v")]
        if self.kind == "count_distinct":
            return []
        pick = F.min if self.kind == "first" else F.max
        return [pick(F.struct(F.struct(*ORDER).alias("at"), v.alias("v"))).alias(f"{n}__o")]

    def merged(self) -> list[Column]:
        """Aggregates over parts."""
        n = self.name
        if self.kind == "count":
            return [F.sum(f"{n}__n").alias(f"{n}__n")]
        if self.kind == "sum":
            return [F.sum(f"{n}__s").alias(f"{n}__s")]
        if self.kind == "avg":
            return [F.sum(f"{n}__s").alias(f"{n}__s"), F.sum(f"{n}__n").alias(f"{n}__n")]
        if self.kind in ("min", "max"):
            return [getattr(F, self.kind)(f"{n}__v").alias(f"{n}__v")]
        if self.kind == "count_distinct":
            return []
        return [(F.min if self.kind == "first" else F.max)(f"{n}__o").alias(f"{n}__o")]

    def finished(self) -> Column:
        n = self.name
        if self.kind == "count":
            return F.col(f"{n}__n").alias(n)
        if self.kind == "sum":
            return F.coalesce(f"{n}__s", F.lit(0.0)).alias(n)
        if self.kind == "avg":
            return (F.col(f"{n}__s") / F.nullif(F.col(f"{n}__n"), F.lit(0))).alias(n)
        if self.kind in ("min", "max"):
            return F.col(f"{n}__v").alias(n)
        if self.kind == "count_distinct":
            return F.coalesce(f"{n}__d", F.lit(0)).cast("long").alias(n)
        return F.col(f"{n}__o.v").alias(n)


def partial(df: DataFrame, keys: Sequence[Column], aggregates: Sequence[Aggregate]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), *[p for a in aggregates for p in a.parts()])


def merge(parts: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("__rows").alias("__rows"), *[p for a in aggregates for p in a.merged()])


def distinct_values(df: DataFrame, keys: Sequence[Column], aggregate: Aggregate) -> DataFrame:
    """Keys and value, a row for each different value of a group."""
    return df.select(*keys, aggregate.value.alias("__value")).where("__value is not null").distinct()


def finish(parts: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    return parts.select(*keys, *[a.finished() for a in aggregates])


def tumbling_key(size_ms: int) -> list[Column]:
    start = (F.floor(F.col("timestamp") / size_ms) * size_ms).cast("long")
    return [start.alias("window_start"), (start + size_ms).alias("window_end")]


#: What is stored of a view.
SAVED = ("name", "topic", "sql", "mode", "interval_ms", "id", "status", "error", "created_at", "last_refresh_at", "version", "offsets", "segments", "retired")
#: Segments of like size that are merged into one.
TIER = 4


@dataclass
class View:
    """A registered view. ``query`` computes it from scratch; with keys and aggregates it is refreshed by merging."""

    name: str
    topic: str
    sql: str
    mode: str = "continuous"
    interval_ms: int | None = None
    keys: Sequence[Column] = ()
    aggregates: Sequence[Aggregate] = ()
    where: str | None = None
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "initializing"
    error: str | None = None
    created_at: int = field(default_factory=lambda: int(time.time() * 1000))
    last_refresh_at: int | None = None
    version: int = 0
    offsets: dict[str, int] = field(default_factory=dict)
    #: number and rows of each segment, the oldest first; numbers of segments that no longer count
    segments: list[list[int]] = field(default_factory=list)
    retired: list[int] = field(default_factory=list)

    @property
    def mode_text(self) -> str:
        return f"periodic ({self.interval_ms}ms)" if self.mode == "periodic" else self.mode


class Views:
    """The views of a catalog, stored under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.views = spark, root.rstrip("/"), {}

    def get(self, name: str) -> View:
        for known, view in self.views.items():
            if known.lower() == name.lower():
                return view
        raise ViewNotFound(name)

    def create(self, view: View, replace: bool = False) -> View:
        if view.name in self.views and not replace:
            raise ViewAlreadyExists(view.name)
        if view.mode not in MODES:
            raise InvalidQuery(f"no refresh mode: {view.mode}")
        view.mode = MODES[view.mode]
        if view.mode == "periodic" and view.interval_ms is None:
            view.interval_ms = DEFAULT_INTERVAL_MS
        self.views[view.name] = view
        return view

    def drop(self, name: str) -> None:
        view = self.get(name)
        del self.views[view.name]
        delete(self.spark, f"{self.root}/{view.id}")

    def due(self, now_ms: int) -> list[View]:
        """Views that the maintainer refreshes now: continuous ones, and periodic ones whose interval has passed."""
        return [v for v in self.views.values() if v.mode == "continuous" or (v.mode == "periodic" and (v.last_refresh_at is None or now_ms - v.last_refresh_at >= v.interval_ms))]

    def path(self, view: View, number: int) -> str:
        return f"{self.root}/{view.id}/s{number}"

    def refresh(self, name: str, source: DataFrame, query=None, now_ms: int | None = None) -> View:
        """Bring a view up to date with a topic's records. Only offsets beyond those merged before are read."""
        view = self.get(name)
        try:
            gone, view.retired = view.retired, []
            if view.aggregates:
                self._append(view, source)
            else:
                query().write.mode("overwrite").parquet(self.path(view, view.version + 1))
                view.version, view.retired = view.version + 1, [n for n, _ in view.segments]
                view.segments = [[view.version, self._count(view, view.version)]]
            view.status, view.error = "running", None
        except Exception as e:
            view.status, view.error, view.retired = "error", str(e).split("\n")[0], gone
            raise
        values = [self._values(view, a, n) for n in gone for a in view.aggregates if a.kind == "count_distinct"]
        delete(self.spark, *[self.path(view, n) for n in gone], *values)
        view.last_refresh_at = int(time.time() * 1000) if now_ms is None else now_ms
        return view

    def _append(self, view: View, source: DataFrame) -> None:
        """A segment of the records beyond those merged before; then merges of segments of like size."""
        seen = F.create_map(*[F.lit(x) for p, o in view.offsets.items() for x in (int(p), o)]) if view.offsets else None
        fresh = source if seen is None else source.where(F.col("offset") >= F.coalesce(F.try_element_at(seen, F.col("partition")), F.lit(0)))
        # what is merged is fixed first: records that arrive meanwhile wait for the next refresh
        ends = {str(r["partition"]): r["end"] for r in fresh.groupBy("partition").agg((F.max("offset") + 1).alias("end")).collect()}
        if not ends and view.version:
            return
        if ends:
            limit = F.create_map(*[F.lit(x) for p, o in ends.items() for x in (int(p), o)])
            fresh = fresh.where(F.col("offset") < F.try_element_at(limit, F.col("partition")))
        values = {a.name: distinct_values(fresh, view.keys, a) for a in view.aggregates if a.kind == "count_distinct"}
        segment = self._write(view, partial(fresh, view.keys, view.aggregates), values)
        view.segments, view.offsets = [*view.segments, segment], view.offsets | ends
        tail = self._tier([rows for _, rows in view.segments])
        if tail > 1:
            old = [n for n, _ in view.segments[-tail:]]
            segment = self._write(view, *self._merged(view, old))
            view.segments, view.retired = [*view.segments[:-tail], segment], old

    @staticmethod
    def _tier(rows: list[int]) -> int:
        """How many of the newest segments to merge: those that are no larger than all newer ones together, once they are TIER."""
        tail, newer = 1, rows[-1]
        while tail < len(rows) and rows[-tail - 1] <= newer:
            newer += rows[-tail - 1]
            tail += 1
        return tail if tail >= TIER else 1

    def _write(self, view: View, parts: DataFrame, values: dict[str, DataFrame]) -> list[int]:
        """Write a segment; returns its number and rows."""
        view.version += 1
        parts.write.mode("overwrite").parquet(self.path(view, view.version))
        for a in view.aggregates:
            if a.name in values:
                values[a.name].write.mode("overwrite").parquet(self._values(view, a, view.version))
        return [view.version, self._count(view, view.version)]

    def _count(self, view: View, number: int) -> int:
        """Rows of a segment, from the files' footers."""
        return self.spark.read.parquet(self.path(view, number)).count()

    def _merged(self, view: View, numbers: Sequence[int]) -> tuple[DataFrame, dict[str, DataFrame]]:
        """Parts of segments, a row a group, and the distinct values of each distinct count."""
        parts = self.spark.read.parquet(*[self.path(view, n) for n in numbers])
        names = [c for c in parts.columns if "__" not in c]
        if len(numbers) > 1:
            parts = merge(parts, names, view.aggregates)
        values = {a.name: self.spark.read.parquet(*[self._values(view, a, n) for n in numbers]) for a in view.aggregates if a.kind == "count_distinct"}
        return parts, {n: v.distinct() if len(numbers) > 1 else v for n, v in values.items()}

    def read(self, name: str) -> DataFrame:
        """The view's rows. A view that was never refreshed has none."""
        view = self.get(name)
        if not view.version:
            raise InvalidQuery(f"view {name} has not been refreshed yet")
        numbers = [n for n, _ in view.segments]
        if not view.aggregates:
            return self.spark.read.parquet(self.path(view, numbers[-1]))
        stored, values = self._merged(view, numbers)
        names = [c for c in stored.columns if "__" not in c]
        for name, found in values.items():
            counts = found.groupBy(*names).agg(F.count(F.lit(1)).alias(f"{name}__d"))
            counts = counts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(names)], f"{name}__d")
            same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)]
            stored = stored.join(counts, same, "left").drop(*[f"__k{i}" for i in range(len(names))])
        return finish(stored, names, view.aggregates)

    def _values(self, view: View, aggregate: Aggregate, number: int) -> str:
        return f"{self.path(view, number)}-values-{aggregate.name}"

    def rows(self, view: View) -> int:
        if len(view.segments) < 2:
            return sum(rows for _, rows in view.segments)
        parts = self.spark.read.parquet(*[self.path(view, n) for n, _ in view.segments])
        return parts.select(*[c for c in parts.columns if "__" not in c]).distinct().count()

    def show(self) -> DataFrame:
        rows = [(v.name, v.topic, v.mode_text, v.status, self.rows(v)) for v in sorted(self.views.values(), key=lambda v: v.name)]
        return self.spark.createDataFrame(rows, "name string, source_topic string, refresh_mode string, status string, row_count long")

    def describe(self, name: str) -> DataFrame:
        v = self.get(name)
        pairs = [
            ("id", v.id), ("name", v.name), ("source_topic", v.topic), ("query_sql", v.sql), ("refresh_mode", v.mode_text), ("status", v.status), ("error_message", v.error or ""),
            ("row_count", str(self.rows(v))), ("last_refresh_at", "never" if v.last_refresh_at is None else str(v.last_refresh_at)), ("created_at", str(v.created_at)),
        ]
        return self.spark.createDataFrame(pairs, "property string, value string")

    def save(self) -> None:
        """Store what a restart needs: a new version of the registry, written whole."""
        lines = [json.dumps({f: getattr(v, f) for f in SAVED}) for v in self.views.values()]
        store_text(self.spark, f"{self.root}/registry/{max(self._saved(), default=0) + 1}", "\n".join(lines))

    def saved(self) -> list[View]:
        """The views of the last whole version; their keys and aggregates are to be planned anew."""
        numbers = self._saved()
        if not numbers:
            return []
        rows = self.spark.read.text(f"{self.root}/registry/{max(numbers)}").collect()
        return [View(**json.loads(r["value"])) for r in rows]

    def _saved(self) -> list[int]:
        """Numbers of the registry's versions whose write was completed."""
        return [int(name) for name in complete(self.spark, f"{self.root}/registry")]
