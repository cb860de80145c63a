"""All queries over the shared tables, with the SQL that computes the same from the flat columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake import tables
from eventlake.functions import jsonx, stats, vectors
from eventlake.operators import cdc, compaction, infer, joins, predicates, windows
from eventlake.operators.aggs import aggregate
from eventlake.tables import EVENTS_SQL

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: The dialect's text of queries over the topic of events.
EVENT_SQL: dict[str, str] = {}
E = f"WITH {EVENTS_SQL} "


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with DuckDB SQL of its rows."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def dialect(name: str, sql: str, oracle: str, *topics: str, digits: dict[str, int] | None = None, casts: dict[str, str] | None = None) -> None:
    """Register a query in the engine's dialect. JSON paths read as text are cast for comparison; sums are rounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = tables.engine(spark, sf_dir, *(topics or ("events",))).sql(sql)
        for c, t in (casts or {}).items():
            out = out.withColumn(c, F.col(c).cast(t))
        for c, n in (digits or {}).items():
            out = out.withColumn(c, F.round(c, n))
        return out

    run.__name__ = name
    if topics in ((), ("events",)):
        EVENT_SQL[name] = sql
    query(oracle)(run)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly purchases: payload filter, tumbling window, aggregates."""
    return _QUERIES["tumble_purchases_1h"](spark, sf_dir)


# Scans, filters, projections, sorting

ENVELOPE_SQL = """topic, partition, "offset", "key", "timestamp" """
dialect("scan_offset_range", "SELECT topic, partition, offset, key, timestamp FROM events WHERE partition = 0 AND offset >= 10 AND offset < 50",
        E + f"SELECT {ENVELOPE_SQL} FROM e WHERE partition = 0 AND \"offset\" >= 10 AND \"offset\" < 50")
dialect("scan_star_payload", "SELECT *, json_extract(value, '$.event_id') AS event_id FROM events WHERE offset <= 20 AND partition > 1",
        E + f"""SELECT {ENVELOPE_SQL}, '{{"event_id":' || event_id || ',"event_type":"' || event_type || '","value":' || value || ',"props":{{"k":' || k || '}}}}' AS "value", event_id
        FROM e WHERE "offset" <= 20 AND partition > 1""", casts={"event_id": "bigint"})  # fmt: skip
dialect("filter_key", "SELECT partition, offset, timestamp FROM events WHERE key = '3'", E + """SELECT partition, "offset", "timestamp" FROM e WHERE user_id = 3""")
dialect("filter_time_range", "SELECT partition, offset FROM events WHERE timestamp >= '2024-01-05T00:00:00Z' AND timestamp < '2024-01-06T12:00:00Z'",
        E + """SELECT partition, "offset" FROM e WHERE "timestamp" >= 1704412800000 AND "timestamp" < 1704542400000""")
dialect("filter_json_number", "SELECT key, json_extract(value, '$.value') AS v FROM events WHERE json_extract(value, '$.value') >= 100.5 AND json_extract(value, '$.value') <= 150",
        E + """SELECT "key", value AS v FROM e WHERE value >= 100.5 AND value <= 150""", casts={"v": "double"})
dialect("filter_json_text", "SELECT offset, partition FROM events WHERE json_extract(value, '$.event_type') = 'error' AND value->>'event_type' != 'view'",
        E + """SELECT "offset", partition FROM e WHERE event_type = 'error'""")
dialect("filter_or_in_between", "SELECT key, offset FROM events WHERE (event_type IN ('click', 'view') OR json_extract(value, '$.props.k') BETWEEN 10 AND 12) AND NOT partition = 2 AND key LIKE '1%'",
        E + """SELECT "key", "offset" FROM e WHERE (event_type IN ('click', 'view') OR k BETWEEN 10 AND 12) AND partition <> 2 AND "key" LIKE '1%'""")
dialect("filter_any_operator", "SELECT partition, offset FROM events WHERE topic = 'events' AND partition > 1 AND key > '5' AND 100 > offset AND key != '7'",
        E + """SELECT partition, "offset" FROM e WHERE partition > 1 AND "key" > '5' AND "offset" < 100 AND "key" <> '7'""")
dialect("group_by_envelope", "SELECT topic, offset, COUNT(*) AS n, MAX('$.value') AS m FROM events WHERE offset < 60 GROUP BY topic, offset",
        E + """SELECT topic, "offset", count(*) AS n, max(value) AS m FROM e WHERE "offset" < 60 GROUP BY topic, "offset" """)
dialect("group_by_timestamp", "SELECT timestamp, COUNT(*) AS n FROM events GROUP BY timestamp HAVING COUNT(*) > 1 OR timestamp < 1704200000000",
        E + """SELECT "timestamp", count(*) AS n FROM e GROUP BY "timestamp" HAVING count(*) > 1 OR "timestamp" < 1704200000000""")
dialect("default_names", "SELECT event_type, COUNT(*), SUM('$.value'), MIN('$.props.k'), COUNT(DISTINCT key) FROM events GROUP BY event_type",
        E + """SELECT event_type, count(*) AS count_0, round(sum(value), 2) AS sum_1, CAST(min(k) AS DOUBLE) AS min_2, count(DISTINCT "key") AS count_distinct_3 FROM e GROUP BY event_type""", digits={"sum_1": 2})
dialect("join_reversed_on", "SELECT o.offset AS off, c.key AS ck FROM orders o JOIN customers c ON c.key = json_extract(o.value, '$.o_custkey') WHERE c.partition = 1 AND o.offset < 500",
        """WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS off FROM orders)
        SELECT off, CAST(c_custkey AS VARCHAR) AS ck FROM o JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 4 = 1 AND off < 500""", "orders", "customers")  # fmt: skip
dialect("filter_missing_is_null", "SELECT COUNT(*) AS n FROM events WHERE json_extract(value, '$.nothing') = NULL", "SELECT count(*) AS n FROM events")
dialect("json_nested_path", "SELECT partition, offset, json_extract(value, '$.props.k') AS k, value->'props'->>'k' AS k2, props AS props FROM events WHERE json_extract(value, '$.props.k') > 90",
        E + """SELECT partition, "offset", k, k AS k2, '{"k":' || k || '}' AS props FROM e WHERE k > 90""", casts={"k": "bigint", "k2": "bigint"})
dialect("order_by_payload_number", "SELECT json_extract(value, '$.event_id') AS id, json_extract(value, '$.value') AS v FROM events ORDER BY v DESC, id LIMIT 25 OFFSET 5",
        E + "SELECT event_id AS id, value AS v FROM e ORDER BY value DESC, event_id LIMIT 25 OFFSET 5", casts={"id": "bigint", "v": "double"})
dialect("order_by_offset_paged", "SELECT partition, offset, key FROM events WHERE partition = 1 ORDER BY offset LIMIT 10 OFFSET 20",
        E + """SELECT partition, "offset", "key" FROM e WHERE partition = 1 ORDER BY "offset" LIMIT 10 OFFSET 20""")
dialect("distinct_types", "SELECT DISTINCT event_type AS t, partition FROM events", E + "SELECT DISTINCT event_type AS t, partition FROM e")
dialect("count_all", "SELECT COUNT(*) FROM events", 'SELECT count(*) AS "count" FROM events')
dialect("count_filtered", "SELECT COUNT(*) AS n FROM events WHERE event_type = 'purchase' AND json_extract(value, '$.value') > 20.25",
        "SELECT count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 20.25")
dialect("expressions_and_functions", """SELECT upper(event_type) AS t, CASE WHEN json_extract(value, '$.value') > 50 THEN 'high' ELSE 'low' END AS band,
        round(json_extract(value, '$.value') * 2 + 1, 1) AS twice, length(key) AS n FROM events""",
        E + """SELECT upper(event_type) AS t, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band, round(value * 2 + 1, 1) AS twice, CAST(length("key") AS INTEGER) AS n FROM e""")


@query(E + """SELECT partition, "offset", "key", "timestamp" FROM e WHERE partition = 2 AND "offset" >= 100 ORDER BY "offset" LIMIT 50""")
def consume_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlake.sources.topics import consume

    return consume(tables.events(spark, sf_dir), 2, 100, 50).select("partition", "offset", "key", "timestamp")


@query(E + """SELECT "key", "offset" FROM e WHERE (event_type = 'click' AND value > 30) OR event_type LIKE '%sign%'""")
def predicate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {"op": "or", "args": [
        {"op": "and", "args": [{"op": "equals", "field": "event_type", "value": "click"}, {"op": "greater_than", "field": "value", "value": 30}]},
        {"op": "contains", "field": "event_type", "value": "sign"},
    ]}
    return predicates.keep(tables.events(spark, sf_dir), {"op": "and", "args": [tree, {"op": "not", "arg": {"op": "equals", "field": "nothing", "value": 1}}]}).select("key", "offset")


@query(E + """SELECT partition, "offset", '{"type":"' || event_type || '","k":{"k":' || k || '}}' AS "value" FROM e""")
def project_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.events(spark, sf_dir)
    return predicates.project(df, {"event_type": "type", "props": "k", "nothing": "nothing"}).select("partition", "offset", "value")


# Aggregates

_GROUP = """count(*) AS count_0, round(sum(value), 2) AS sum_1, round(avg(value), 6) AS avg_2, min(value) AS min_3, max(value) AS max_4"""
_AGGS = "COUNT(*), SUM(json_extract(value, '$.value')), AVG('$.value'), MIN(json_extract(value, '$.value')), MAX($.value)"
dialect("group_by_payload", f"SELECT json_extract(value, '$.event_type'), {_AGGS} FROM events GROUP BY json_extract(value, '$.event_type')",
        f"SELECT event_type, {_GROUP} FROM events GROUP BY event_type", digits={"sum_1": 2, "avg_2": 6})
dialect("group_by_nested_and_key", "SELECT key, json_extract(value, '$.props.k') AS k, COUNT(*) AS n, SUM('$.value') AS s FROM events GROUP BY key, json_extract(value, '$.props.k') HAVING COUNT(*) > 1",
        E + """SELECT "key", k, count(*) AS n, round(sum(value), 2) AS s FROM e GROUP BY "key", k HAVING count(*) > 1""", digits={"s": 2}, casts={"k": "bigint"})
dialect("group_by_partition", "SELECT partition, COUNT(*) AS n, MIN(offset) AS lo, MAX(offset) AS hi FROM events GROUP BY partition ORDER BY partition",
        E + """SELECT partition, count(*) AS n, CAST(min("offset") AS DOUBLE) AS lo, CAST(max("offset") AS DOUBLE) AS hi FROM e GROUP BY partition""")
dialect("global_aggregates", "SELECT SUM('$.value') AS s, AVG('$.value') AS a, COUNT(*) AS n, SUM('$.nothing') AS none, MIN('$.nothing') AS nothing FROM events",
        "SELECT round(sum(value), 2) AS s, round(avg(value), 6) AS a, count(*) AS n, 0.0::DOUBLE AS none, NULL::DOUBLE AS nothing FROM events", digits={"s": 2, "a": 6})
dialect("count_distinct", "SELECT event_type, COUNT(DISTINCT key) AS users, COUNT(DISTINCT '$.props.k') AS ks, COUNT(DISTINCT *) AS n FROM events GROUP BY event_type",
        "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT json_extract(props, '$.k')) AS ks, count(*) AS n FROM events GROUP BY event_type")
dialect("first_last", "SELECT key, FIRST('$.event_id') AS f, LAST('$.event_type') AS l FROM events GROUP BY key",
        E + """SELECT "key", arg_min(event_id, ("timestamp", partition, "offset")) AS f, arg_max(event_type, ("timestamp", partition, "offset")) AS l FROM e GROUP BY "key" """, casts={"f": "bigint"})


@query("SELECT event_type, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY event_type")
def approx_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.engine(spark, sf_dir, "events").sql("SELECT event_type, APPROX_COUNT_DISTINCT(key) AS n, COUNT(DISTINCT key) AS exact FROM events GROUP BY event_type")
    return out.select("event_type", "exact", (F.abs(F.col("n") / F.col("exact") - 1) < 0.2).alias("near"))


# Windows

_HOUR = 3_600_000
dialect("tumble_purchases_1h", "SELECT window_start, window_end, COUNT(*) AS cnt, SUM(json_extract(value, '$.value')) AS total FROM events WHERE json_extract(value, '$.event_type') = 'purchase' GROUP BY TUMBLE(timestamp, INTERVAL '1 hour')",
        E + f"""SELECT ("timestamp" // {_HOUR}) * {_HOUR} AS window_start, ("timestamp" // {_HOUR}) * {_HOUR} + {_HOUR} AS window_end, count(*) AS cnt, round(sum(value), 2) AS total
        FROM e WHERE event_type = 'purchase' GROUP BY ALL""", digits={"total": 2})  # fmt: skip
dialect("tumble_by_type", "SELECT TUMBLE(timestamp, INTERVAL '6' HOUR) AS w, event_type, COUNT(*) AS n, MAX('$.value') AS top FROM events GROUP BY w, event_type",
        E + """SELECT ("timestamp" // 21600000) * 21600000 AS window_start, ("timestamp" // 21600000) * 21600000 + 21600000 AS window_end, ("timestamp" // 21600000) * 21600000 AS w,
        event_type, count(*) AS n, max(value) AS top FROM e GROUP BY ALL""")  # fmt: skip
dialect("tumble_limit", "SELECT window_start, window_end, COUNT(*) AS n FROM events GROUP BY TUMBLE(timestamp, '1 day') ORDER BY window_start LIMIT 5",
        E + """SELECT ("timestamp" // 86400000) * 86400000 AS window_start, ("timestamp" // 86400000) * 86400000 + 86400000 AS window_end, count(*) AS n FROM e GROUP BY ALL ORDER BY 1 LIMIT 5""")
_HOP = """w AS (SELECT CAST(unnest(generate_series(("timestamp" // 1800000) * 1800000 - 5400000, ("timestamp" // 1800000) * 1800000, 1800000)) AS BIGINT) AS window_start, value FROM e)
    SELECT window_start, window_start + 7200000 AS window_end, count(*) AS n, round(sum(value), 2) AS s FROM w"""
dialect("hop_2h_30m", "SELECT window_start, window_end, COUNT(*) AS n, SUM('$.value') AS s FROM events GROUP BY HOP(timestamp, INTERVAL '2 hours', INTERVAL '30 minutes')",
        f"WITH {EVENTS_SQL}, {_HOP} GROUP BY window_start", digits={"s": 2})


@query(f"WITH {EVENTS_SQL}, {_HOP} WHERE window_start >= (SELECT min(\"timestamp\") // 1800000 * 1800000 FROM e) GROUP BY window_start")
def hop_without_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = jsonx.parsed(tables.events(spark, sf_dir))
    total = F.round(aggregate("sum", jsonx.json_num("$.value")), 2).alias("s")
    return windows.hop(df, 7_200_000, 1_800_000, [], [aggregate("count").alias("n"), total], leading=False)


@query(E + """SELECT ("timestamp" // 7200000) * 7200000 AS window_start, ("timestamp" // 7200000) * 7200000 + 1800000 AS window_end, count(*) AS n FROM e
    WHERE "timestamp" % 7200000 < 1800000 GROUP BY ALL""")
def hop_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.hop(tables.events(spark, sf_dir), 1_800_000, 7_200_000, [], [aggregate("count").alias("n")])


_SESSIONS = """g AS (SELECT *, CASE WHEN "timestamp" - lag("timestamp") OVER (PARTITION BY "key" ORDER BY "timestamp", event_id) <= 1800000 THEN 0 ELSE 1 END AS fresh FROM e),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY "key" ORDER BY "timestamp", event_id) AS n FROM g)"""
dialect("session_30m_by_user", "SELECT window_start, window_end, key, COUNT(*) AS c, MAX('$.value') AS top FROM events GROUP BY SESSION(timestamp, '30 minutes'), key",
        f"""WITH {EVENTS_SQL}, {_SESSIONS} SELECT min("timestamp") AS window_start, max("timestamp") AS window_end, "key", count(*) AS c, max(value) AS top FROM s GROUP BY "key", n""")


@query(f"""WITH {EVENTS_SQL}, o AS (SELECT *, max("timestamp") OVER (PARTITION BY partition ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 5000 AS wm FROM e)
    SELECT CASE WHEN wm IS NULL OR "timestamp" >= wm THEN 'on_time' WHEN wm - "timestamp" <= 5000 THEN 'late' ELSE 'too_late' END AS lateness, count(*) AS n FROM o GROUP BY 1""")
def watermark_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.late_classes(tables.events(spark, sf_dir)).groupBy("lateness").agg(F.count(F.lit(1)).alias("n"))


@query(E + """SELECT 'events' AS topic, min(m) - 5000 AS watermark FROM (SELECT max("timestamp") AS m FROM e GROUP BY partition)""")
def watermark_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.global_watermark(tables.events(spark, sf_dir))


# Joins

_OC = """o AS (SELECT CAST(o_orderkey AS VARCHAR) AS ok, CAST(o_custkey AS VARCHAR) AS ck, o_orderstatus FROM orders),
    c AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_name, c_mktsegment FROM customer)"""
for _how in ("INNER", "LEFT", "RIGHT", "FULL"):
    # the sides of ON may stand in any order; what else it says leaves rows without a partner on both sides
    dialect(f"join_{_how.lower()}",
        f"""SELECT o.key AS ok, c.key AS ck, json_extract(c.value, '$.c_name') AS name, o.o_orderstatus AS st FROM orders o {_how} JOIN customers c
        ON c.key = json_extract(o.value, '$.o_custkey') AND c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'F'""",
        f"""WITH {_OC} SELECT ok, c.key AS ck, c_name AS name, o_orderstatus AS st FROM o {_how} JOIN c ON o.ck = c.key AND c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'""",
        "orders", "customers")
dialect("join_filtered_ordered", """SELECT o.key, c.c_mktsegment AS seg, json_extract(o.value, '$.o_totalprice') AS p FROM orders o JOIN customers c ON o.o_custkey = c.key
        WHERE json_extract(o.value, '$.o_totalprice') > 200000 AND json_extract(c.value, '$.c_mktsegment') = 'BUILDING' ORDER BY p DESC, o.key LIMIT 20""",
        """SELECT CAST(o_orderkey AS VARCHAR) AS "o.key", c_mktsegment AS seg, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE o_totalprice > 200000 AND c_mktsegment = 'BUILDING' ORDER BY p DESC, 1 LIMIT 20""", "orders", "customers", casts={"p": "double"})  # fmt: skip
dialect("join_grouped", "SELECT c.c_mktsegment AS seg, COUNT(*) AS n, SUM(json_extract(o.value, '$.o_totalprice')) AS s FROM orders o JOIN customers c ON o.o_custkey = c.key GROUP BY c.c_mktsegment",
        "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 1) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", "orders", "customers", digits={"s": 1})
_LATEST = """l AS (SELECT "key", arg_max(event_id, ("timestamp", partition, "offset")) AS event_id, arg_max(event_type, ("timestamp", partition, "offset")) AS event_type FROM e GROUP BY "key")"""
dialect("stream_table_join", "SELECT a.key AS k, json_extract(a.value, '$.event_id') AS id, t.event_id AS last_id, t.event_type AS last_type FROM events a JOIN TABLE(events) t ON a.key = t.key",
        f"""WITH {EVENTS_SQL}, {_LATEST} SELECT e."key" AS k, e.event_id AS id, l.event_id AS last_id, l.event_type AS last_type FROM e JOIN l ON e."key" = l."key" """,
        casts={"id": "bigint", "last_id": "bigint"})
dialect("table_stream_join", "SELECT t.key AS k, t.event_id AS last_id, o.key AS ok FROM TABLE(events) t RIGHT JOIN orders o ON t.key = o.o_custkey",
        f"""WITH {EVENTS_SQL}, {_LATEST}, o AS (SELECT CAST(o_orderkey AS VARCHAR) AS ok, CAST(o_custkey AS VARCHAR) AS ck FROM orders)
        SELECT l."key" AS k, l.event_id AS last_id, ok FROM o LEFT JOIN l ON l."key" = ck""", "events", "orders", casts={"last_id": "bigint"})  # fmt: skip
dialect("join_three_topics", "SELECT c.c_name AS name, o.o_orderstatus AS st, COUNT(*) AS n, MAX(json_extract(e.value, '$.value')) AS top FROM orders o JOIN customers c ON o.o_custkey = c.key JOIN events e ON e.key = c.key GROUP BY c.c_name, o.o_orderstatus",
        "SELECT c_name AS name, o_orderstatus AS st, count(*) AS n, max(value) AS top FROM orders JOIN customer ON o_custkey = c_custkey JOIN events ON user_id = c_custkey GROUP BY 1, 2",
        "orders", "customers", "events")


def _views_and_purchases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = tables.events(spark, sf_dir)
    kind = jsonx.json_text("$.event_type")
    return events.where(kind == "view"), events.where(kind == "purchase")


_SIDES = "a AS (SELECT * FROM e WHERE event_type = 'view'), b AS (SELECT * FROM e WHERE event_type = 'purchase')"
for _how in ("inner", "left", "right", "full"):

    def _interval(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        a, b = _views_and_purchases(spark, sf_dir)
        out = joins.interval_join(a, b, F.col("key"), F.col("key"), _HOUR, how)
        return out.select(F.expr("get_json_object(`l.value`, '$.event_id')").cast("bigint").alias("l_id"), F.expr("get_json_object(`r.value`, '$.event_id')").cast("bigint").alias("r_id"))

    _interval.__name__ = f"interval_join_{_how}"
    query(f"""WITH {EVENTS_SQL}, {_SIDES} SELECT a.event_id AS l_id, b.event_id AS r_id FROM a {_how.upper()} JOIN b ON a."key" = b."key" AND abs(a."timestamp" - b."timestamp") <= {_HOUR}""")(_interval)


# Statistical columns and vectors

_Z = "(value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events)"
dialect("stats_zscore", "SELECT json_extract(value, '$.event_id') AS id, ZSCORE('$.value') AS z FROM events WHERE ZSCORE('$.value') > 2.0",
        f"SELECT event_id AS id, round({_Z}, 6) AS z FROM events WHERE {_Z} > 2.0", digits={"z": 6}, casts={"id": "bigint"})
dialect("stats_anomaly", "SELECT json_extract(value, '$.event_id') AS id, ANOMALY('$.value', 2.5) AS odd FROM events WHERE ANOMALY('$.value') = true",
        f"SELECT event_id AS id, abs({_Z}) > 2.5 AS odd FROM events WHERE abs({_Z}) > 2.0", casts={"id": "bigint"})
# statistics are over the rows that pass the other conditions, however those are written
_ZB = """(value - avg(value) OVER ()) / stddev_pop(value) OVER ()"""
dialect("stats_zscore_between", "SELECT offset, ZSCORE('$.value') AS z FROM events WHERE partition = 1 AND offset BETWEEN 0 AND 199 AND ZSCORE('$.value') > 0.5",
        E + f"""SELECT "offset", round(z, 6) AS z FROM (SELECT "offset", {_ZB} AS z FROM e WHERE partition = 1 AND "offset" BETWEEN 0 AND 199) WHERE z > 0.5""", digits={"z": 6})
dialect("stats_zscore_or", "SELECT key, offset FROM events WHERE (partition = 1 OR partition = 3) AND (ZSCORE('$.value') > 1.5 OR json_extract(value, '$.event_type') = 'error' AND ANOMALY('$.value', 1.0) = true)",
        E + f"""SELECT "key", "offset" FROM (SELECT "key", "offset", event_type, {_ZB} AS z FROM e WHERE partition IN (1, 3)) WHERE z > 1.5 OR event_type = 'error' AND abs(z) > 1.0""")
dialect("stats_zscore_case", "SELECT partition, offset FROM events WHERE CASE WHEN partition = 0 AND offset > 100 THEN key ELSE '3' END <> '3' AND ZSCORE('$.value') BETWEEN -0.25 AND 0.25",
        E + f"""SELECT partition, "offset" FROM (SELECT partition, "offset", {_ZB} AS z FROM e WHERE CASE WHEN partition = 0 AND "offset" > 100 THEN "key" ELSE '3' END <> '3') WHERE z BETWEEN -0.25 AND 0.25""")
dialect("stats_zscore_grouped", "SELECT partition, COUNT(*) AS n FROM events WHERE offset BETWEEN 10 AND 500 AND ZSCORE('$.value') > 1 GROUP BY partition",
        E + f"""SELECT partition, count(*) AS n FROM (SELECT partition, {_ZB} AS z FROM e WHERE "offset" BETWEEN 10 AND 500) WHERE z > 1 GROUP BY partition""")
dialect("stats_columns", "SELECT key, offset, partition, AVG('$.value') AS a, STDDEV('$.value') AS sd FROM events",
        E + """SELECT "key", "offset", partition, round(avg(value) OVER (), 6) AS a, round(stddev_pop(value) OVER (), 6) AS sd FROM e""", digits={"a": 6, "sd": 6})
dialect("stats_moving_avg", "SELECT partition, offset, MOVING_AVG('$.value', 5) AS m FROM events",
        E + """SELECT partition, "offset", round(avg(value) OVER (ORDER BY partition, "offset" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS m FROM e""", digits={"m": 6})


@query(E + """SELECT "key", "offset", round(avg(value) OVER (PARTITION BY "key" ORDER BY "timestamp", "offset" ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS m FROM e""")
def stats_moving_avg_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = jsonx.parsed(tables.events(spark, sf_dir))
    m = stats.moving_avg(jsonx.json_num("$.value"), 10, ("timestamp", "offset"), ("key",))
    return df.select("key", "offset", F.round(m, 6).alias("m"))


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_V = "CAST(embedding AS DOUBLE[])"


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in tables.table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


@query(f"""SELECT vec_id, round(list_cosine_similarity({_V}, CAST({_Q} AS DOUBLE[])), 6) AS sim FROM embeddings
    ORDER BY round(list_cosine_similarity({_V}, CAST({_Q} AS DOUBLE[])), 9) DESC, vec_id LIMIT 10""")
def vector_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = tables.engine(spark, sf_dir, "vectors")
    vector = "[" + ", ".join(map(repr, _probe(spark, sf_dir))) + "]"
    out = engine.sql(f"SELECT offset AS vec_id, COSINE_SIMILARITY('$.embedding', '{vector}') AS sim FROM vectors")
    out = out.orderBy(F.round("sim", 9).desc(), "vec_id").limit(10)
    return out.withColumn("sim", F.round("sim", 6))


@query(f"SELECT vec_id, round(list_distance({_V}, CAST({_Q} AS DOUBLE[])), 6) AS d FROM embeddings WHERE list_distance({_V}, CAST({_Q} AS DOUBLE[])) < 1.3 AND label % 2 = 0")
def vector_euclidean_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = f"EUCLIDEAN_DISTANCE('$.embedding', '{_probe(spark, sf_dir)}')"
    out = tables.engine(spark, sf_dir, "vectors").sql(f"SELECT offset AS vec_id, {distance} AS d FROM vectors WHERE {distance} < 1.3 AND json_extract(value, '$.label') % 2 = 0")
    return out.withColumn("d", F.round("d", 6))


@query(f"SELECT vec_id, round(list_inner_product({_V}, CAST({_Q} AS DOUBLE[])), 6) AS dot, round(sqrt(list_inner_product({_V}, {_V})), 6) AS norm FROM embeddings")
def vector_dot_and_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return df.select("vec_id", F.round(vectors.dot_product("v", _probe(spark, sf_dir)), 6).alias("dot"), F.round(vectors.vector_norm("v"), 6).alias("norm"))


# Statements on topics and views


@query("SELECT * FROM (VALUES ('customers', 4), ('events', 4), ('orders', 4)) t(name, partitions)")
def show_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.engine(spark, sf_dir, "events", "orders", "customers").sql("SHOW TOPICS")


@query(E + """, p AS (SELECT partition, max("offset") + 1 AS h FROM e GROUP BY partition)
    SELECT CAST(partition AS VARCHAR) AS partition_id, h AS high_watermark FROM p UNION ALL SELECT 'TOTAL (' || count(*) || ' partitions)', CAST(sum(h) AS BIGINT) FROM p""")
def describe_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.engine(spark, sf_dir, "events").sql("DESCRIBE events").select("partition_id", "high_watermark")


@query(E + """, p AS (SELECT partition, max("offset") + 1 AS h FROM e GROUP BY partition)
    SELECT CAST(partition AS VARCHAR) AS partition_id, h AS high_watermark, 1 AS segment_count FROM p UNION ALL SELECT 'TOTAL (' || count(*) || ' partitions)', CAST(sum(h) AS BIGINT), count(*) FROM p""")
def describe_stored_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored topic's segments are its writes; one write, of partitions of any size, is one segment of each."""
    from eventlake.sources.topics import write_topic
    from eventlake.streaming.flows import work_folder

    path = f"{work_folder(spark)}/store"
    write_topic(tables.events(spark, sf_dir), path)
    engine = tables.engine(spark, sf_dir)
    engine.catalog.open("events", path)
    return engine.sql("DESCRIBE events")


_VIEW = "SELECT key, COUNT(*) AS n, SUM('$.value') AS s, MIN('$.value') AS lo, AVG('$.value') AS a, LAST('$.event_id') AS last, COUNT(DISTINCT '$.event_type') AS kinds FROM events GROUP BY TUMBLE(timestamp, '1 day'), key"


@query(E + """SELECT ("timestamp" // 86400000) * 86400000 AS window_start, ("timestamp" // 86400000) * 86400000 + 86400000 AS window_end, "key", count(*) AS n, round(sum(value), 2) AS s,
    min(value) AS lo, round(avg(value), 6) AS a, arg_max(event_id, ("timestamp", partition, "offset")) AS last, count(DISTINCT event_type) AS kinds FROM e GROUP BY ALL""")
def view_incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that is refreshed thrice, as its stored topic grows, equals the query over all records."""
    from eventlake.sources.topics import write_topic
    from eventlake.streaming.flows import work_folder

    engine, whole, path = tables.engine(spark, sf_dir), tables.events(spark, sf_dir), f"{work_folder(spark)}/store"
    for part in ("offset < 100", "offset >= 100 and offset < 1500", "offset >= 1500"):
        write_topic(whole.where(part), path)
        engine.catalog.open("events", path)
        if part == "offset < 100":
            engine.sql(f"CREATE MATERIALIZED VIEW daily WITH (refresh_mode = 'manual') AS {_VIEW}")
        engine.sql("REFRESH MATERIALIZED VIEW daily")
    out = engine.sql("SELECT * FROM daily")
    return out.withColumns({"s": F.round("s", 2), "a": F.round("a", 6), "last": F.col("last").cast("bigint")})


@query("SELECT 'hourly' AS name, 'events' AS source_topic, 'periodic (60000ms)' AS refresh_mode, 'running' AS status, count(DISTINCT epoch_us(ts) // 3600000000) AS row_count FROM events")
def show_materialized_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = tables.engine(spark, sf_dir, "events")
    engine.sql("CREATE MATERIALIZED VIEW hourly WITH (refresh_mode = 'periodic', interval = '1 minute') AS SELECT COUNT(*) AS n FROM events GROUP BY TUMBLE(timestamp, '1 hour')")
    engine.maintain()
    return engine.sql("SHOW MATERIALIZED VIEWS")


def _with_view(spark: SparkSession, sf_dir: str):
    engine = tables.engine(spark, sf_dir, "events")
    engine.sql("CREATE MATERIALIZED VIEW kinds WITH (refresh_mode = 'on_demand') AS SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
    engine.sql("REFRESH MATERIALIZED VIEW kinds")
    return engine


@query("""SELECT * FROM (VALUES ('name', 'kinds'), ('source_topic', 'events'), ('refresh_mode', 'manual'), ('status', 'running'), ('error_message', '')) t(property, "value")
    UNION ALL SELECT 'row_count', CAST(count(DISTINCT event_type) AS VARCHAR) FROM events""")
def describe_materialized_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _with_view(spark, sf_dir).sql("DESCRIBE MATERIALIZED VIEW kinds")
    return out.where(F.col("property").isin("name", "source_topic", "refresh_mode", "status", "error_message", "row_count"))


@query("SELECT 'kinds' AS name, 'dropped' AS status, 0 AS views_left")
def drop_materialized_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _with_view(spark, sf_dir)
    return engine.sql("DROP MATERIALIZED VIEW kinds").withColumn("views_left", F.lit(engine.sql("SHOW MATERIALIZED VIEWS").count()))


# Log maintenance

_CHANGES = """c AS (SELECT user_id AS u, 'p' || (event_id % 50) AS k, CASE WHEN event_type = 'error' THEN '' ELSE CAST(value AS VARCHAR) END AS v, event_id AS o, epoch_us(ts) // 1000 AS t FROM events),
    l AS (SELECT k, arg_max(v, o) AS v, max(o) AS o, arg_max(t, o) AS t FROM c GROUP BY k)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.table(spark, sf_dir, "events")
    key = F.concat(F.lit("p"), (F.col("event_id") % 50).cast("string"))
    value = F.when(F.col("event_type") == "error", "").otherwise(F.col("value").cast("string"))
    return df.select(F.lit("changes").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), key.alias("key"), value.alias("value"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"))


_NOW = 1_706_000_000_000


@query(f"WITH {_CHANGES} SELECT k AS \"key\", v AS \"value\", o AS \"offset\" FROM l WHERE NOT (v = '' AND {_NOW} - t >= 86400000)")
def compact_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compact(_changes(spark, sf_dir), _NOW).select("key", "value", "offset")


@query(E + """SELECT "key", max("offset") AS "offset" FROM e GROUP BY partition, "key" """)
def compact_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compact(tables.events(spark, sf_dir), 0).select("key", "offset")


@query(E + """SELECT partition, "key", max("offset") AS "offset" FROM e GROUP BY partition, "key" """)
def compact_store_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlake.sources.topics import read_topic, write_topic
    from eventlake.streaming.flows import work_folder

    path = f"{work_folder(spark)}/store"
    write_topic(tables.events(spark, sf_dir), path)
    compaction.compact_store(spark, path, 0, threshold=0.1)
    return read_topic(spark, path, "events").select("partition", "key", "offset")


_SEGMENTS = """, s AS (SELECT topic, partition, "offset" // 100 * 100 AS base_offset, count(*) AS record_count, max("timestamp") AS created_at FROM e GROUP BY ALL),
    o AS (SELECT *, count(*) OVER (PARTITION BY partition) AS n, sum(record_count) OVER (PARTITION BY partition ORDER BY base_offset) AS upto FROM s WHERE 1706000000000 - created_at >= 86400000)"""


@query(E + _SEGMENTS + " SELECT topic, partition, base_offset, record_count, created_at FROM o WHERE n >= 2 AND upto <= 1000")
def eligible_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = (F.floor(F.col("offset") / 100) * 100).cast("long").alias("base_offset")
    segments = tables.events(spark, sf_dir).groupBy("topic", "partition", base).agg(F.count(F.lit(1)).alias("record_count"), F.max("timestamp").alias("created_at"))
    return compaction.eligible(segments, _NOW, compaction.DAY_MS, 2, 1000)


@query(E + """SELECT topic, partition, count(*) AS records, count(DISTINCT "key") AS keys, round(1 - count(DISTINCT "key") / count(*), 9) AS dirty_ratio FROM e GROUP BY 1, 2""")
def dirty_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.dirty_ratio(tables.events(spark, sf_dir)).withColumn("dirty_ratio", F.round("dirty_ratio", 9))


@query(E + """SELECT "key", "offset" FROM e WHERE "timestamp" >= 1706000000000 - 259200000""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.retain(tables.events(spark, sf_dir), _NOW, 3 * compaction.DAY_MS).select("key", "offset")


@query(E + """, p AS (SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY "offset") - 1 AS n FROM e)
    SELECT "key", CASE WHEN n % 10 = 7 THEN 'duplicate' WHEN n % 10 = 9 THEN 'gap' ELSE 'ok' END AS status, count(*) AS c FROM p GROUP BY 1, 2""")
def sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with a repeat at every eighth record of ten and a leap at every tenth."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("partition", "key").orderBy("offset")) - 1
    df = tables.events(spark, sf_dir).withColumn("n", n)
    good = (F.floor(F.col("n") / 10) * 8 + F.least(F.col("n") % 10, F.lit(7)) + F.when(F.col("n") % 10 == 8, 0).otherwise(0)).cast("long")
    seq = F.when(F.col("n") % 10 == 7, good - 1).when(F.col("n") % 10 == 8, good).when(F.col("n") % 10 == 9, good + 5).otherwise(good)
    df = df.select("topic", "partition", "offset", F.col("key").alias("producer_id"), seq.alias("sequence"))
    out = compaction.sequence_status(df)
    return out.groupBy(F.col("producer_id").alias("key"), "status").agg(F.count(F.lit(1)).alias("c"))


# Change data capture

_CDC_SQL = """x AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'd' WHEN 1 THEN 'u' WHEN 2 THEN 'r' ELSE 'c' END AS op, c_name AS name, c_acctbal AS bal FROM customer)"""


def _cdc_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.table(spark, sf_dir, "customer").withColumn("row", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))))
    op = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'd' WHEN 1 THEN 'u' WHEN 2 THEN 'r' ELSE 'c' END")
    after = F.when(op == "d", F.lit("null")).otherwise(F.col("row"))
    before = F.when(op.isin("d", "u"), F.col("row")).otherwise("null")
    source = F.format_string('{"connector":"postgresql","db":"shop","table":"customer","lsn":%d}', "c_custkey")
    value = F.concat(F.lit('{"before":'), before, F.lit(',"after":'), after, F.lit(',"source":'), source, F.lit(',"op":"'), op, F.lit('","ts_ms":'), F.col("c_custkey").cast("string"), F.lit("}"))
    return df.select(F.lit("cdc").alias("topic"), F.lit(0).alias("partition"), F.col("c_custkey").alias("offset"), F.col("c_custkey").cast("string").alias("key"), value.alias("value"), F.col("c_custkey").alias("timestamp"))


_OP = "CASE op WHEN 'd' THEN 'delete' WHEN 'u' THEN 'update' WHEN 'r' THEN 'read' ELSE 'insert' END"


@query(f"""WITH {_CDC_SQL} SELECT id AS "offset", {_OP} AS op, 'customer' AS "table", CASE WHEN op <> 'd' THEN name END AS name, id AS ts_ms, id AS lsn FROM x WHERE op <> 'r'""")
def cdc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cdc.keep_operations(cdc.parse(_cdc_topic(spark, sf_dir)), ["insert", "update", "delete"])
    return found.select("offset", "op", "table", F.get_json_object("after", "$.name").alias("name"), "ts_ms", F.col("source.lsn").alias("lsn"))


@query(f"WITH {_CDC_SQL} SELECT {_OP} AS op, count(*) AS changes, max(id) AS last_lsn FROM x GROUP BY 1")
def cdc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.stats(cdc.parse(_cdc_topic(spark, sf_dir)))


@query(f"WITH {_CDC_SQL} SELECT 'customer' AS \"table\", CAST(id AS VARCHAR) AS id, '{{\"id\":' || id || ',\"name\":\"' || name || '\"}}' AS \"row\" FROM x WHERE op <> 'd'")
def cdc_table_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.table_state(cdc.parse(_cdc_topic(spark, sf_dir)), ["id"])


# Schemas and costs


@query("""SELECT * FROM (SELECT unnest(['$.event_id', '$.event_type', '$.value', '$.props', '$.props.k']) AS path, unnest(['BIGINT', 'VARCHAR', 'DOUBLE', 'JSON', 'BIGINT']) AS sql_type),
    (SELECT count(*) AS occurrences FROM events)""")
def infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.infer_schema(tables.events(spark, sf_dir)).select("path", "sql_type", "occurrences")


# SQL beyond the dialect, over topics

_BASE = "SELECT CAST(key AS BIGINT) AS u, json_extract(value, '$.event_type') AS t, CAST(json_extract(value, '$.value') AS DOUBLE) AS v, CAST(json_extract(value, '$.event_id') AS BIGINT) AS id FROM events"
_FLAT = "SELECT user_id AS u, event_type AS t, value AS v, event_id AS id FROM events"
_PLAIN = {
    "sql_cte_subquery": "SELECT u, count(*) AS n FROM b WHERE v > (SELECT avg(v) FROM b) GROUP BY u",
    "sql_in_exists": "SELECT id FROM b WHERE u IN (SELECT u FROM b WHERE v > 300) AND EXISTS (SELECT 1 FROM b AS c WHERE c.u = b.u AND c.t = 'error')",
    "sql_ranking": "SELECT * FROM (SELECT id, CAST(row_number() OVER (PARTITION BY u ORDER BY v DESC, id) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY t ORDER BY u) AS BIGINT) AS rk, CAST(ntile(4) OVER (PARTITION BY u ORDER BY id) AS BIGINT) AS nt FROM b) AS x WHERE rn <= 3",
    "sql_lag_lead": "SELECT id, lag(id) OVER (PARTITION BY u ORDER BY id) AS before, lead(t, 2) OVER (PARTITION BY u ORDER BY id) AS after FROM b",
    "sql_frames": "SELECT id, max(v) OVER (PARTITION BY u ORDER BY id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS m, count(*) OVER (PARTITION BY u ORDER BY id RANGE BETWEEN 50 PRECEDING AND CURRENT ROW) AS c FROM b",
    "sql_union_all": "SELECT u, t FROM b WHERE t = 'view' UNION ALL SELECT u, t FROM b WHERE t = 'click'",
    "sql_set_operations": "(SELECT u FROM b WHERE t = 'view' INTERSECT SELECT u FROM b WHERE t = 'error') EXCEPT SELECT u FROM b WHERE v > 450",
    "sql_rollup": "SELECT t, u % 3 AS g, count(*) AS n, max(v) AS m FROM b GROUP BY ROLLUP (t, u % 3)",
    "sql_cube": "SELECT t, u % 3 AS g, count(*) AS n, min(v) AS m FROM b GROUP BY CUBE (t, u % 3)",
    "sql_grouping_sets": "SELECT t, u % 2 AS g, count(*) AS n FROM b GROUP BY GROUPING SETS ((t), (u % 2), ())",
    "sql_self_join": "SELECT a.id AS i, c.id AS j FROM b AS a JOIN b AS c ON a.u = c.u AND a.id < c.id AND c.id - a.id <= 20 AND a.t = c.t",
    "sql_semi_anti": "SELECT DISTINCT u FROM b WHERE u NOT IN (SELECT u FROM b WHERE v > 480)",
    "sql_case_cast": "SELECT id, CASE WHEN v < 10 THEN 'low' WHEN v < 100 THEN 'mid' ELSE 'high' END AS band, CAST(floor(v) AS BIGINT) AS whole, coalesce(nullif(t, 'view'), 'seen') AS t2 FROM b",
    "sql_strings": "SELECT DISTINCT upper(t) AS a, substring(t, 2, 3) AS s, CAST(length(t) AS BIGINT) AS n, replace(t, 'i', 'y') AS r, concat(t, '-', CAST(u % 2 AS VARCHAR(5))) AS c FROM b",
    "sql_math": "SELECT id, round(sqrt(v), 6) AS q, abs(v - 50) > 25 AS far, u % 7 AS m, power(u, 2) AS p FROM b",
    "sql_having_order": "SELECT t, count(*) AS n FROM b GROUP BY t HAVING count(*) > 10 ORDER BY n DESC NULLS LAST, t LIMIT 3",
}
for _name, _sql in _PLAIN.items():
    dialect(_name, f"WITH b AS ({_BASE}) {_sql}", f"WITH b AS ({_FLAT}) {_sql}")

dialect("sql_dates", """WITH d AS (SELECT CAST(json_extract(value, '$.event_id') AS BIGINT) AS id, timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, timestamp / 1000) AS d FROM events)
        SELECT id, date_format(d, 'yyyy-MM-dd') AS day, CAST(hour(d) AS BIGINT) AS h, CAST(dayofweek(d) AS BIGINT) AS w, CAST(datediff(last_day(d), CAST(d AS DATE)) AS BIGINT) AS to_end,
        date_format(date_trunc('WEEK', d), 'yyyy-MM-dd') AS week, date_format(add_months(d, 1), 'yyyy-MM-dd') AS later, CAST(extract(MINUTE FROM d + INTERVAL '45' MINUTE) AS BIGINT) AS m FROM d""",
        """SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS h, dayofweek(ts) + 1 AS w, datediff('day', CAST(ts AS DATE), last_day(ts)) AS to_end,
        strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(ts + INTERVAL 1 MONTH, '%Y-%m-%d') AS later, minute(ts + INTERVAL 45 MINUTE) AS m FROM events""")  # fmt: skip
dialect("sql_arrays_maps", f"""WITH b AS ({_BASE}), g AS (SELECT u, collect_set(t) AS ts, collect_list(CAST(floor(v) AS BIGINT)) AS vs FROM b GROUP BY u)
        SELECT u, array_join(array_sort(ts), ',') AS kinds, CAST(size(ts) AS BIGINT) AS n, array_contains(ts, 'error') AS bad, aggregate(filter(vs, x -> x > 50), 0L, (a, x) -> a + x) AS big,
        element_at(array_sort(transform(vs, x -> x * 2)), 1) AS least, map('view', 1, 'click', 2)[array_min(ts)] AS code FROM g""",
        f"""WITH b AS ({_FLAT}), g AS (SELECT u, list_sort(list(DISTINCT t)) AS ts, list(CAST(floor(v) AS BIGINT)) AS vs FROM b GROUP BY u)
        SELECT u, array_to_string(ts, ',') AS kinds, len(ts) AS n, list_contains(ts, 'error') AS bad, CAST(coalesce(list_sum(list_filter(vs, lambda x: x > 50)), 0) AS BIGINT) AS big,
        list_sort(list_transform(vs, lambda x: x * 2))[1] AS least, MAP {{'view': 1, 'click': 2}}[ts[1]] AS code FROM g""")  # fmt: skip
dialect("sql_explode", f"""WITH b AS ({_BASE}) SELECT u, part, count(*) AS n FROM b LATERAL VIEW explode(split(t, 'i')) x AS part GROUP BY u, part""",
        f"""WITH b AS ({_FLAT}) SELECT u, part, count(*) AS n FROM b, unnest(string_split(t, 'i')) AS x(part) GROUP BY u, part""")


@query("SELECT event_type, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events GROUP BY event_type")
def transform_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline's SQL over one batch, and its rows as records again."""
    from eventlake.streaming.pipelines import to_records, transform

    sql = "SELECT event_type, sum(CASE WHEN v > 50 THEN 1 ELSE 0 END) AS n FROM (SELECT json_extract(value, '$.event_type') AS event_type, json_number(value, '$.value') AS v FROM input) GROUP BY event_type"
    out = to_records(transform(tables.events(spark, sf_dir), sql, "events"))
    return out.select(jsonx.json_text("$.event_type").alias("event_type"), jsonx.json_text("$.n").cast("bigint").alias("n"))


# Streams, each run to the end of its input


@query(E + """, d AS (SELECT ("timestamp" // 86400000) * 86400000 AS window_start, event_type, value FROM e)
    SELECT window_start, event_type, count(*) AS n, round(sum(value), 2) AS s FROM d WHERE window_start + 86400000 <= (SELECT max("timestamp") FROM e) - 5000 GROUP BY 1, 2""")
def stream_tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlake.streaming import flows

    return flows.replay(tables.events(spark, sf_dir), lambda s: flows.tumble(jsonx.parsed(s), 86_400_000, [jsonx.json_text("$.event_type").alias("event_type")], [
        F.count(F.lit(1)).alias("n"), F.round(F.sum(jsonx.json_num("$.value")), 2).alias("s")]).drop("window_end"))


@query(f"""WITH {EVENTS_SQL}, {_SIDES} SELECT a.event_id AS l_id, b.event_id AS r_id FROM a JOIN b ON a."key" = b."key" AND abs(a."timestamp" - b."timestamp") <= {_HOUR}""")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlake.streaming import flows

    def flow(stream: DataFrame) -> DataFrame:
        kind = jsonx.json_text("$.event_type")
        out = flows.interval_join(stream.where(kind == "view"), stream.where(kind == "purchase"), _HOUR)
        return out.select(F.get_json_object("l_value", "$.event_id").cast("bigint").alias("l_id"), F.get_json_object("r_value", "$.event_id").cast("bigint").alias("r_id"))

    return flows.replay(tables.events(spark, sf_dir), flow)


@query(E + """SELECT "key", "offset", event_type FROM e WHERE event_type = 'signup'""")
def pipeline_to_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlake.streaming import flows

    return flows.pipeline_roundtrip(tables.events(spark, sf_dir), "SELECT key, offset, partition, timestamp, topic, json_extract(value, '$.event_type') AS value FROM input WHERE json_extract(value, '$.event_type') = 'signup'").select(
        "key", "offset", F.col("value").alias("event_type"))


@query(f"WITH {EVENTS_SQL}, {_HOP} WHERE window_start + 7200000 <= (SELECT max(\"timestamp\") FROM e) - 5000 GROUP BY window_start")
def stream_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlake.streaming import flows

    n, s = F.count(F.lit(1)).alias("n"), F.round(F.sum(jsonx.json_num("$.value")), 2).alias("s")
    return flows.replay(tables.events(spark, sf_dir), lambda stream: flows.hop(jsonx.parsed(stream), 7_200_000, 1_800_000, [], [n, s]))


@query(f"""WITH {EVENTS_SQL}, {_SESSIONS} SELECT min("timestamp") AS window_start, max("timestamp") AS window_end, "key", count(*) AS c FROM s GROUP BY "key", n
    HAVING max("timestamp") + 1800000 <= (SELECT max("timestamp") FROM e) - 5000""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlake.streaming import flows

    return flows.replay(tables.events(spark, sf_dir), lambda stream: flows.session(stream, 1_800_000, [F.col("key")], [F.count(F.lit(1)).alias("c")]))


@query(E + 'SELECT DISTINCT "key", event_type FROM e')
def stream_deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlake.streaming import flows

    def flow(stream: DataFrame) -> DataFrame:
        typed = stream.select("key", jsonx.json_text("$.event_type").alias("event_type"), "timestamp")
        return flows.deduplicated(typed, ["key", "event_type"], "400 days").select("key", "event_type")

    return flows.replay(tables.events(spark, sf_dir), flow)


# Sources and sinks, written and read back


@query(E + f"""SELECT {ENVELOPE_SQL}, event_id FROM e WHERE partition IN (1, 3) AND "offset" BETWEEN 50 AND 700""")
def topic_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlake.sources.topics import read_topic, write_topic
    from eventlake.streaming.flows import work_folder

    path = f"{work_folder(spark)}/store"
    write_topic(tables.events(spark, sf_dir), path)
    stored = read_topic(spark, path, "events").where("partition in (1, 3) and offset between 50 and 700")
    return stored.select("topic", "partition", "offset", "key", "timestamp", jsonx.json_text("$.event_id").cast("bigint").alias("event_id"))


@query(E + """SELECT "key", "timestamp", event_id FROM e""")
def ndjson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlake.sources.topics import read_lines
    from eventlake.streaming.flows import work_folder

    path = f"{work_folder(spark)}/lines"
    tables.events(spark, sf_dir).select(F.to_json(F.struct("key", "value", "timestamp"))).write.text(path)
    return read_lines(spark, path, "events").select("key", "timestamp", jsonx.json_text("$.event_id").cast("bigint").alias("event_id"))


@query("""SELECT CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, count(*) AS n FROM events GROUP BY ALL""")
def file_sink_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlake.sources.connectors import FileSink
    from eventlake.streaming.flows import work_folder

    path = f"{work_folder(spark)}/sink"
    FileSink(path, "parquet", "hourly").write(tables.events(spark, sf_dir))
    parts = [F.col(c).cast("int").alias(a) for c, a in (("year", "y"), ("month", "m"), ("day", "d"), ("hour", "h"))]
    return spark.read.parquet(path).groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))


@query(E + """SELECT k, arg_max(event_id, ("timestamp", partition, "offset")) AS event_id, arg_max(event_type, ("timestamp", partition, "offset")) AS event_type FROM e GROUP BY k""")
def table_sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upsert by props.k would merge: the last record of each key."""
    from eventlake.sources.connectors import TableSink

    flat = tables.events(spark, sf_dir).withColumn("value", F.expr("to_json(struct(cast(get_json_object(value, '$.props.k') as bigint) as k, cast(get_json_object(value, '$.event_id') as bigint) as event_id, get_json_object(value, '$.event_type') as event_type))"))
    return TableSink("jdbc:none", "events", "k bigint, event_id bigint, event_type string", "upsert", ["k"]).rows(flat)


@query(E + """SELECT '{"index":{"_index":"events","_id":"' || event_id || '"}}' AS action,
    '{"event_id":' || event_id || ',"event_type":"' || event_type || '","value":' || value || ',"props":{"k":' || k || '}}' AS document FROM e""")
def bulk_sink_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlake.sources.connectors import BulkSink

    lines = BulkSink("index", "events", id_field="event_id").lines(tables.events(spark, sf_dir))
    return lines.select(F.split("line", "\n")[0].alias("action"), F.split("line", "\n")[1].alias("document"))


@query(E + """SELECT k, arg_max(event_id, ("timestamp", partition, "offset")) AS event_id FROM e GROUP BY k""")
def table_sink_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches upserted into a database in the driver's process, and read back."""
    import uuid

    from eventlake.sources.connectors import TableSink

    url, driver = f"jdbc:derby:memory:eventlake{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    sink = TableSink(url, "latest", "k bigint, event_id bigint", "upsert", ["k"], driver)
    sink._execute(spark)('CREATE TABLE latest ("k" BIGINT PRIMARY KEY, "event_id" BIGINT)')
    df = tables.events(spark, sf_dir).withColumn("value", F.expr("to_json(struct(cast(get_json_object(value, '$.props.k') as bigint) as k, cast(get_json_object(value, '$.event_id') as bigint) as event_id))"))
    middle = tables.events(spark, sf_dir).agg(F.expr("percentile_approx(timestamp, 0.5)")).first()[0]
    sink.write(df.where(F.col("timestamp") <= middle), 0)
    sink.write(df.where(F.col("timestamp") > middle), 1)
    rows = []
    with sink.connection(spark) as connection:  # executors don't reach the driver's database
        found = connection.createStatement().executeQuery('SELECT "k", "event_id" FROM latest')
        while found.next():
            rows.append((found.getObject(1), found.getObject(2)))
    return spark.createDataFrame(rows, "k long, event_id long")


@query(E + """, l AS (SELECT "key", arg_max(event_type, "offset") AS kind, max("offset") AS "offset" FROM e GROUP BY "key") SELECT "key", kind, "offset" FROM l""")
def stream_latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that a changelog of each key's latest value leaves."""
    from eventlake.session import SETTINGS
    from eventlake.streaming import checkpoints, flows, state

    folder, store = flows.work_folder(spark), "spark.sql.streaming.stateStore.providerClass"
    tables.events(spark, sf_dir).withColumn("value", jsonx.json_text("$.event_type")).write.parquet(f"{folder}/in")
    before = spark.conf.get(store)
    spark.conf.set(store, SETTINGS[store])  # keyed state needs this one, whatever the session has
    try:
        out = state.latest_values(flows.open_stream(spark, f"{folder}/in"))
        writer = out.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.parquet(f"{folder}/out/{n}")).option("checkpointLocation", f"{folder}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
        found = checkpoints.read_state(spark, f"{folder}/state", "value").select(F.col("key.key").alias("key"), F.col("value.value").alias("kind"), F.col("value.offset").alias("offset"))
        found.write.parquet(f"{folder}/found")
    finally:
        spark.conf.set(store, before)
    return spark.read.parquet(f"{folder}/found")


@query(E + """, p AS (SELECT partition, max("timestamp") AS last FROM e WHERE partition <> 2 OR "timestamp" < 1704400000000 GROUP BY partition),
    n AS (SELECT max(last) AS newest FROM p) SELECT 'events' AS topic, min(last) - 5000 AS watermark FROM p, n WHERE newest - last <= 86400000""")
def watermark_idle_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition that has been silent for a day does not hold the watermark back."""
    quiet = tables.events(spark, sf_dir).where("partition <> 2 OR timestamp < 1704400000000")
    return windows.global_watermark(quiet, idle_ms=86_400_000)


@query(f"WITH {_CDC_SQL} SELECT {_OP} AS op, count(*) AS n FROM x GROUP BY 1")
def cdc_connector_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations by name, as a connector's events have them."""
    names = F.expr("CASE get_json_object(value, '$.op') WHEN 'd' THEN 'Delete' WHEN 'u' THEN 'Update' WHEN 'r' THEN 'Read' ELSE 'Create' END")
    df = _cdc_topic(spark, sf_dir).withColumn("value", F.regexp_replace("value", '"op":"."', F.concat(F.lit('"op":"'), names, F.lit('"'))))
    return cdc.parse(df).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(E + f""", {_SIDES}, w AS (SELECT least((SELECT max("timestamp") FROM a), (SELECT max("timestamp") FROM b)) - 5000 - {_HOUR} AS upto)
    SELECT a.event_id AS l_id, b.event_id AS r_id FROM a FULL JOIN b ON a."key" = b."key" AND abs(a."timestamp" - b."timestamp") <= {_HOUR}
    WHERE a.event_id IS NOT NULL AND b.event_id IS NOT NULL OR coalesce(a."timestamp", b."timestamp") < (SELECT upto FROM w)""")
def stream_interval_join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a partner come once the watermark shows that none can come any more."""
    from eventlake.streaming import flows

    def flow(stream: DataFrame) -> DataFrame:
        kind = jsonx.json_text("$.event_type")
        out = flows.interval_join(stream.where(kind == "view"), stream.where(kind == "purchase"), _HOUR, "full")
        return out.select(F.get_json_object("l_value", "$.event_id").cast("bigint").alias("l_id"), F.get_json_object("r_value", "$.event_id").cast("bigint").alias("r_id"))

    return flows.replay(tables.events(spark, sf_dir), flow)
