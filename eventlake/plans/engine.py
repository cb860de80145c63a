"""The SQL entry point: statements over topics and materialized views."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.errors import InvalidQuery, ParseError, QueryTimeout, TopicNotFound, UnsupportedOperation, ViewAlreadyExists, ViewNotFound
from eventlake.operators.numbering import SMALL, estimated_bytes
from eventlake.plans import dialect
from eventlake.plans.catalog import Catalog
from eventlake.plans.intervals import text_ms
from eventlake.plans.lexer import Token, clauses, join, split, statements, tokenize, unquote
from eventlake.plans.views import Aggregate, View, Views
from eventlake.session import shared_dir

MAX_ROWS, TIMEOUT_MS = 10_000, 30_000


@dataclass
class Result:
    """Rows for a client; only here are they capped."""

    columns: list[dict]
    rows: list[list]
    row_count: int
    execution_time_ms: int
    truncated: bool


class Engine:
    def __init__(self, spark: SparkSession, organisation: str = "default", view_root: str | None = None):
        self.catalog = Catalog(spark, organisation)
        self.spark = self.catalog.spark
        self.views = Views(self.spark, f"{view_root or shared_dir(spark)}/views")

    def sql(self, text: str) -> DataFrame:
        """Run the first statement of a text."""
        found = statements(tokenize(text))
        if not found:
            raise ParseError("no statement")
        tokens = found[0]
        words = [t.word for t in tokens[:6]]
        if words[0] == "SHOW":
            if words[1:3] == ["MATERIALIZED", "VIEWS"]:
                return self.views.show()
            if words[1:2] in (["TOPICS"], ["TABLES"]):
                return self.catalog.show_topics()
        elif words[0] in ("DESCRIBE", "DESC"):
            if words[1:3] == ["MATERIALIZED", "VIEW"]:
                return self.views.describe(self._name(tokens[3:]))
            return self.catalog.describe_topic(self._name(tokens[1:]))
        elif words[0] == "CREATE":
            return self._create(tokens)
        elif words[:3] == ["DROP", "MATERIALIZED", "VIEW"]:
            name = self._name(tokens[3:])
            self.views.drop(name)
            self.views.save()
            return self.spark.createDataFrame([(name, "dropped")], "name string, status string")
        elif words[:3] == ["REFRESH", "MATERIALIZED", "VIEW"]:
            name = self._name(tokens[3:])
            self.refresh(name)
            return self.spark.createDataFrame([(name, "refreshed")], "name string, status string")
        elif words[0] in ("SELECT", "WITH"):
            return self.query(tokens)
        raise UnsupportedOperation(f"only queries and statements on views are run: {tokens[0].text}")

    def query(self, tokens: list[Token]) -> DataFrame:
        try:
            return self.spark.sql(self.lower(tokens))
        except ParseException as e:
            raise ParseError(str(e).strip().split("\n")[0]) from e
        except AnalysisException as e:
            if e.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
                raise TopicNotFound(str(e).split("\n")[0]) from e
            raise InvalidQuery(str(e).split("\n")[0]) from e

    def lower(self, tokens: list[Token] | str, compat: bool = False) -> str:
        """Spark SQL of a query. Beyond the dialect it is the text itself, over the topics' views."""
        tokens = tokenize(tokens) if isinstance(tokens, str) else tokens
        if dialect.is_dialect(tokens) and "FROM" in [t.word for t in tokens]:
            if any(t.text.lower() == "json_number" for t in tokens):
                self.catalog.functions()
            return dialect.lower(tokens, self._columns, compat, self._large(tokens))
        self.catalog.functions()
        self._load_views(tokens)
        return join(dialect._arrows(tokens))

    def _large(self, tokens: list[Token]) -> bool:
        """Whether a moving average's topic is more than one task should read in order."""
        if not any(t.word == "MOVING_AVG" for t in tokens):
            return False
        names = {unquote(t).lower() for t in tokens if t.kind == "name"}
        return any(estimated_bytes(topic.frame) > SMALL for name, topic in self.catalog.topics.items() if name.lower() in names)

    def _load_views(self, tokens: list[Token]) -> None:
        names = {unquote(t).lower() for t in tokens if t.kind == "name"}
        for v in self.views.views.values():
            if v.name.lower() in names and v.version:
                self.views.read(v.name).createOrReplaceTempView(f"`{v.name}`")

    def _columns(self, name: str) -> list[str]:
        """Columns of a topic, or of a view if no topic has the name."""
        try:
            return self.catalog.columns(name)
        except TopicNotFound:
            try:
                frame = self.views.read(name)
            except ViewNotFound:
                raise TopicNotFound(name) from None
            frame.createOrReplaceTempView(f"`{name}`")
            return [c.lower() for c in frame.columns]

    @staticmethod
    def _name(tokens: list[Token]) -> str:
        if len(tokens) != 1 or tokens[0].kind != "name":
            raise ParseError("a name is expected")
        return unquote(tokens[0])

    def _create(self, tokens: list[Token]) -> DataFrame:
        words = [t.word for t in tokens]
        replace = words[1:3] == ["OR", "REPLACE"]
        at = 3 if replace else 1
        if words[at : at + 2] != ["MATERIALIZED", "VIEW"] or len(tokens) < at + 5:
            raise UnsupportedOperation("only materialized views can be created")
        name = unquote(tokens[at + 2])
        rest, options = tokens[at + 3 :], {}
        if rest[0].word == "WITH":
            end = next(i for i, t in enumerate(rest) if t.text == ")")
            for part in split(rest[2:end]):
                key, _, *value = part
                options[unquote(key).lower()] = " ".join(unquote(t) for t in value)
            rest = rest[end + 1 :]
        if not rest or rest[0].word != "AS" or len(rest) < 2 or rest[1].word != "SELECT":
            raise ParseError("AS SELECT is expected")
        query = rest[1:]
        if {"ZSCORE", "ANOMALY"} & {t.word for t in clauses(query, dialect.HEADS).get("WHERE", [])}:
            raise InvalidQuery("a view can't filter by statistics of all rows")
        topic = unquote(clauses(query, dialect.HEADS)["FROM"][0])
        self.catalog.topic(topic)
        if name in self.views.views and not replace:
            raise ViewAlreadyExists(name)
        interval = text_ms(options["interval"]) if "interval" in options else None
        view = View(name, topic, join(query), options.get("refresh_mode", "continuous").lower(), interval)
        self._plan(view, query)
        self.views.create(view, replace)
        self.views.save()
        return self.spark.createDataFrame([(name, "created")], "name string, status string")

    def _plan(self, view: View, query: list[Token]) -> None:
        """Mergeable parts of a view whose query is a tumbling or plain grouped aggregate; others are computed anew."""
        parts = clauses(dialect._arrows(query), dialect.HEADS)
        if set(parts) - {"SELECT", "FROM", "WHERE", "GROUP BY"} or len(parts["FROM"]) != 1 or not parts.get("GROUP BY"):
            return
        sides, _ = dialect._tables(parts["FROM"], self._columns)
        rewrite = dialect.Rewriter(dialect.Lowering(sides, grouped=True), self._columns)
        keys, plain = [], []
        for g in split(parts["GROUP BY"]):
            if dialect._call_name(g) in dialect.WINDOWS:
                kind, sizes = dialect.window_parts(g)
                if kind != "TUMBLE":
                    return
                start = f"cast(floor(`timestamp` / {sizes[0]}) * {sizes[0]} as bigint)"
                keys += [F.expr(start).alias("window_start"), F.expr(f"{start} + {sizes[0]}").alias("window_end")]
            else:
                path = rewrite.json_of(g)
                name = dialect.column_name(path.path) if path else dialect.default_name(g, 0)
                if not name:
                    return
                keys.append(F.expr(path.text() if path else rewrite.sql(g)).alias(name))
                plain.append(join(g))
        out = []
        for item, alias in (dialect._alias(i) for i in split(parts["SELECT"])):
            word = dialect._call_name(item)
            if word in dialect.WINDOWS or join(item) in plain or unquote(item[0]) in ("window_start", "window_end"):
                if alias:
                    return
                continue
            if word not in dialect.AGGREGATES - {"APPROX_COUNT_DISTINCT"}:
                return
            args = item[2:-1]
            distinct = args[0].word == "DISTINCT"
            kind = {"MEAN": "avg", "FIRST_VALUE": "first", "LAST_VALUE": "last"}.get(word, word.lower())
            if distinct and kind != "count":
                return
            args = args[1:] if distinct else args
            path = rewrite.json_of(args) if args[0].text != "*" else None
            if kind == "count" and args[0].text == "*" and not distinct:
                value = None
            elif kind in ("sum", "avg", "min", "max"):
                value = F.expr(rewrite.number(args))
            else:
                value = F.expr(path.text() if path else rewrite.sql(args))
            out.append(Aggregate("count_distinct" if distinct else kind, value, alias or dialect.default_name(item, len(out))))
        where = rewrite.sql(parts["WHERE"]) if parts.get("WHERE") else None
        view.keys, view.aggregates, view.where = keys, out, where

    def refresh(self, name: str, now_ms: int | None = None) -> View:
        view = self.views.get(name)
        source = self.spark.table(f"`{self.catalog.topic(view.topic).name}`")
        if view.aggregates:
            source = source.withColumn("_v", F.try_parse_json("value"))
            if view.where:
                source = source.where(view.where)
        try:
            return self.views.refresh(name, source, lambda: self.spark.sql(self.lower(view.sql)), now_ms)
        finally:
            self.views.save()

    def restore(self) -> list[str]:
        """Take up the views that an earlier engine stored under the same folder; their topics must be registered. Returns names."""
        for view in self.views.saved():
            self._plan(view, tokenize(view.sql))
            self.views.views[view.name] = view
        return sorted(self.views.views)

    def maintain(self, now_ms: int | None = None) -> list[str]:
        """Refresh the views that are due, as a background maintainer would on each tick; returns their names."""
        now = int(time.time() * 1000) if now_ms is None else now_ms
        return [self.refresh(v.name, now).name for v in self.views.due(now)]

    def execute(self, text: str, max_rows: int = MAX_ROWS, timeout_ms: int = TIMEOUT_MS) -> Result:
        """Run a statement and bring its rows to the client, max_rows at most, within a time."""
        import threading

        began = time.time()
        df = self.sql(text)
        tag = f"eventlake-{id(df)}"
        context = self.spark.sparkContext
        context.addJobTag(tag)
        expired = threading.Timer(timeout_ms / 1000, lambda: context.cancelJobsWithTag(tag))
        expired.start()
        try:
            rows = df.limit(max_rows + 1).collect()
        except Exception as e:
            if time.time() - began >= timeout_ms / 1000:
                raise QueryTimeout(f"more than {timeout_ms} ms") from e
            raise
        finally:
            expired.cancel()
            context.removeJobTag(tag)
        columns = [{"name": c, "data_type": TYPES.get(t, "json" if t.startswith(("struct", "array", "map", "variant")) else t)} for c, t in df.dtypes]
        return Result(columns, [list(r) for r in rows[:max_rows]], min(len(rows), max_rows), int((time.time() - began) * 1000), len(rows) > max_rows)


#: Names of types in results.
TYPES = {"int": "integer", "smallint": "integer", "tinyint": "integer"}
