import pytest
from pyspark.sql import functions as F

from eventlake.errors import InvalidQuery, ParseError, QueryTimeout, TopicNotFound, UnsupportedOperation, ViewAlreadyExists, ViewNotFound
from eventlake.plans.catalog import describe
from eventlake.plans.intervals import text_ms, timestamp_ms
from eventlake.plans.lexer import statements, tokenize
from eventlake.sources.topics import write_topic

from .helpers import engine_of, records


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    rows = [(i % 2, i // 2, None if i % 5 == 4 else f"k{i % 3}", {"n": i, "s": "ab"[i % 2], "v": [i, 1.0], "items": [{"p": i * 10}]}, 1_700_000_000_000 + i * 1000) for i in range(20)]
    users = [(0, i, f"k{i}", {"name": f"user{i}", "id": i}, 5) for i in range(2)] + [(0, 2, "k0", {"name": "later", "id": 0}, 3), (0, 3, None, {"name": "nobody"}, 9)]
    return engine_of(spark, tmp_path_factory.mktemp("views"), t=records(spark, rows), users=records(spark, users, "users"))


def rows(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


def test_star_and_order(engine):
    df = engine.sql("SELECT * FROM t ORDER BY n DESC LIMIT 2 OFFSET 1")
    assert df.columns == ["topic", "partition", "offset", "key", "value", "timestamp"]
    assert [r["timestamp"] for r in df.collect()] == [1_700_000_000_000 + i * 1000 for i in (18, 17)]


def test_order_is_numeric_and_nulls_come_first(engine):
    assert [r[0] for r in rows(engine, "SELECT n FROM t ORDER BY n LIMIT 3")] == ["0", "1", "2"]
    assert rows(engine, "SELECT key FROM t ORDER BY key LIMIT 1") == [(None,)]
    assert rows(engine, "SELECT key FROM t ORDER BY key DESC LIMIT 1") == [("k2",)]


@pytest.mark.parametrize(("where", "want"), [
    ("offset = 3", 2), ("offset > 3 AND partition = 0", 6), ("offset >= 3 AND partition = 0", 7), ("offset < 3", 6), ("offset <= 3", 8), ("3 <= offset", 14),
    ("timestamp >= '2023-11-14T22:13:25Z'", 15), ("timestamp > '2023-11-14T22:13:25Z'", 14), ("timestamp <= '2023-11-14T22:13:25Z'", 6), ("timestamp < '2023-11-14T22:13:25+00:00'", 5),
    ("key = 'k0'", 6), ("key > 'k0'", 10), ("topic = 'other'", 0), ("key IS NULL", 4), ("key != 'k0'", 10), ("partition = 0 OR key = 'k1'", 13), ("NOT partition = 0", 10), ("n BETWEEN 3 AND 5", 3),
    ("json_extract(value, '$.items.0.p') >= 150", 5), ("s = 'a' AND n > 9", 5), ("key IN ('k1', 'k2')", 10),
])
def test_predicates(engine, where, want):
    assert rows(engine, f"SELECT COUNT(*) FROM t WHERE {where}") == [(want,)]


def test_names(engine):
    assert engine.sql("SELECT COUNT(*) FROM t").columns == ["count"]
    assert engine.sql("SELECT COUNT(*) AS c FROM t").columns == ["c"]
    assert engine.sql("SELECT COUNT(*), COUNT(DISTINCT key), SUM('$.n'), MEAN(n), FIRST_VALUE('$.n') FROM t").columns == ["count_0", "count_distinct_1", "sum_2", "avg_3", "first_4"]
    assert engine.sql("SELECT zscore('$.n'), moving_avg('$.n', 3), anomaly('$.n'), cosine_similarity('$.v', '$.v') FROM t").columns == ["zscore($.n)", "moving_avg($.n, 3)", "anomaly($.n)", "cosine_similarity($.v)"]
    assert engine.sql("SELECT json_extract(value, '$.items.0.p'), key AS k FROM t").columns == ["items_0_p", "k"]


def test_aggregates(engine):
    assert rows(engine, "SELECT s, COUNT(*), SUM('$.n'), AVG(n), MIN('$.n'), MAX($.n), FIRST('$.n'), LAST('$.n') FROM t GROUP BY s ORDER BY s") == [("a", 10, 90.0, 9.0, 0.0, 18.0, "0", "18"), ("b", 10, 100.0, 10.0, 1.0, 19.0, "1", "19")]
    assert rows(engine, "SELECT SUM('$.nothing') AS s, AVG('$.nothing') AS a, COUNT(key) AS k, COUNT(*) AS n FROM t") == [(0.0, None, 16, 20)]
    assert rows(engine, "SELECT COUNT(DISTINCT key) AS k, COUNT(DISTINCT '$.s') AS s, COUNT(DISTINCT *) AS a FROM t") == [(4, 2, 20)]
    assert rows(engine, "SELECT partition, COUNT(*) AS n FROM t GROUP BY 1 HAVING COUNT(*) > 5 ORDER BY partition DESC LIMIT 1") == [(1, 10)]


def test_windows(engine):
    assert rows(engine, "SELECT COUNT(*) AS n FROM t GROUP BY TUMBLE(timestamp, INTERVAL '10 seconds') ORDER BY window_start") == [(1_700_000_000_000, 1_700_000_010_000, 10), (1_700_000_010_000, 1_700_000_020_000, 10)]
    # the unit after the quotes counts
    assert len(rows(engine, "SELECT COUNT(*) AS n FROM t GROUP BY TUMBLE(timestamp, INTERVAL '1' HOUR)")) == 1
    assert rows(engine, "SELECT TUMBLE(timestamp, 10000) AS w, s, COUNT(*) AS n FROM t WHERE partition = 1 GROUP BY w, s ORDER BY w LIMIT 1") == [(1_700_000_000_000, 1_700_000_010_000, 1_700_000_000_000, "b", 5)]
    hop = rows(engine, "SELECT window_start, COUNT(*) AS n FROM t GROUP BY HOP(timestamp, '10 seconds', '5 seconds') ORDER BY window_start")
    assert hop == [(1_699_999_995_000, 5), (1_700_000_000_000, 10), (1_700_000_005_000, 10), (1_700_000_010_000, 10), (1_700_000_015_000, 5)]
    assert "window_start >=" in engine.lower("SELECT window_start, COUNT(*) AS n FROM t GROUP BY HOP(timestamp, '10 seconds', '5 seconds')", compat=True)
    gaps = rows(engine, "SELECT COUNT(*) AS n FROM t GROUP BY HOP(timestamp, '2 seconds', '10 seconds') ORDER BY window_start")
    assert gaps == [(1_700_000_000_000, 1_700_000_002_000, 2), (1_700_000_010_000, 1_700_000_012_000, 2)]


def test_session_gap_is_inclusive(spark, tmp_path):
    df = records(spark, [(0, 0, "a", {}, 0), (0, 1, "a", {}, 1000), (0, 2, "a", {}, 2001), (0, 3, "b", {}, 500), (0, 4, "b", {}, 500)])
    got = rows(engine_of(spark, tmp_path, t=df), "SELECT key, window_start, window_end, COUNT(*) AS n FROM t GROUP BY SESSION(timestamp, '1 second'), key ORDER BY key, window_start")
    assert got == [("a", 0, 1000, 2), ("a", 2001, 2001, 1), ("b", 500, 500, 2)]


def test_joins(engine):
    inner = rows(engine, "SELECT t.n AS n, users.name AS name FROM t JOIN TABLE(users) ON t.key = users.key ORDER BY n LIMIT 2")
    assert inner == [("0", "user0"), ("1", "user1")]  # the latest by time, whatever the offset
    reversed_on = rows(engine, "SELECT u.name AS name, t.n AS n FROM t JOIN users u ON u.key = t.key WHERE t.n < 3 AND u.name != 'later' ORDER BY n")
    assert reversed_on == [("user0", "0"), ("user1", "1")]
    left = rows(engine, "SELECT t.n AS n, u.name AS name FROM t LEFT JOIN TABLE(users) u ON t.key = u.key WHERE t.offset < 2 ORDER BY n")
    assert left == [("0", "user0"), ("1", "user1"), ("2", None), ("3", "user0")]
    full = rows(engine, "SELECT t.key AS a, u.key AS b FROM t FULL JOIN users u ON t.key = u.key")
    assert full.count((None, None)) == 5 and len(full) == 6 * 2 + 5 + 5 + 4 + 1
    star = engine.sql("SELECT t.*, u.name FROM t JOIN users u ON t.key = u.key").columns
    assert star[0] == "t.topic" and star[-1] == "u.name" and len(star) == 7


def test_join_keys_are_compared_as_text(spark, tmp_path):
    a, b = records(spark, [(0, 0, None, {"id": "5"}, 0), (0, 1, None, {"id": 7}, 0)]), records(spark, [(0, 0, None, {"uid": 5}, 0), (0, 1, None, {"uid": None}, 0)], "u")
    assert rows(engine_of(spark, tmp_path, a=a, b=b), "SELECT a.offset AS x, b.offset AS y FROM a JOIN b ON b.uid = a.id") == [(0, 0)]


def test_statistics(engine):
    got = rows(engine, "SELECT n, ZSCORE('$.n') AS z, MOVING_AVG('$.n', 3) AS m, AVG('$.n') AS a, STDDEV('$.n') AS sd FROM t WHERE partition = 0 ORDER BY offset")
    values = [2.0 * i for i in range(10)]
    mean, sd = 9.0, (sum((v - 9) ** 2 for v in values) / 10) ** 0.5
    assert [r[1] for r in got] == pytest.approx([(v - mean) / sd for v in values])
    assert [r[2] for r in got] == pytest.approx([sum(values[max(0, i - 2) : i + 1]) / len(values[max(0, i - 2) : i + 1]) for i in range(10)])
    assert got[0][3:] == pytest.approx((mean, sd))
    # the statistics are those of all rows that pass the other filters
    assert rows(engine, "SELECT n FROM t WHERE partition = 0 AND ZSCORE('$.n') < -1.5") == [("0",)]
    assert rows(engine, "SELECT COUNT(*) AS c FROM t WHERE n = 4") == [(1,)]


def test_statistics_without_spread(spark, tmp_path):
    df = records(spark, [(0, i, None, {"x": 3} if i else {}, i) for i in range(3)])
    run = engine_of(spark, tmp_path, t=df)
    assert rows(run, "SELECT ZSCORE('$.x') AS z, ANOMALY('$.x') AS a, STDDEV('$.x') AS s, AVG('$.none') AS m FROM t") == [(0.0, False, 0.0, 0.0)] * 3


def test_vectors(spark, tmp_path):
    df = records(spark, [(0, 0, None, {"v": [3, 4]}, 0), (0, 1, None, {"v": [0, 0]}, 0), (0, 2, None, {"v": [1, "x"]}, 0), (0, 3, None, {}, 0), (0, 4, None, {"v": [1, 2, 3]}, 0)])
    run = engine_of(spark, tmp_path, t=df)
    got = rows(run, "SELECT COSINE_SIMILARITY('$.v', ARRAY[3, 4]) AS c, EUCLIDEAN_DISTANCE('$.v', '[0, 0]') AS e, DOT_PRODUCT('$.v', ARRAY[1, -2]) AS d, L2_NORM('$.v') AS n FROM t ORDER BY offset")
    far = 1.7976931348623157e308
    assert got[0] == pytest.approx((1.0, 5.0, -5.0, 5.0)) and got[1] == (0.0, 0.0, 0.0, 0.0)
    assert got[2] == (0.0, far, 0.0, 0.0) and got[3] == (0.0, far, 0.0, 0.0) and got[4][:3] == (0.0, far, 0.0)
    assert rows(run, "SELECT offset FROM t WHERE COSINE_SIMILARITY('$.v', ARRAY[3, 4]) > 0.9") == [(0,)]
    with pytest.raises(InvalidQuery):
        run.sql("SELECT COSINE_SIMILARITY('$.v', '[]') FROM t")


@pytest.mark.parametrize(("sql", "error"), [
    ("", ParseError), ("SELECT", ParseError), ("SELECT * FROM nothing", TopicNotFound), ("INSERT INTO t VALUES (1)", UnsupportedOperation), ("DELETE FROM t", UnsupportedOperation),
    ("SELECT * FROM t WHERE (a = 1", ParseError), ("SELECT * FROM t LIMIT x", InvalidQuery), ("SELECT COUNT(*) FROM t GROUP BY TUMBLE(timestamp, '5 weeks')", ParseError),
    ("SELECT COUNT(*) FROM t GROUP BY TUMBLE(timestamp, '0 s')", InvalidQuery), ("SELECT * FROM t WHERE timestamp > 'soon'", InvalidQuery), ("SELECT * FROM t JOIN users", InvalidQuery),
    ("SELECT MOVING_AVG('$.n', 0) FROM t", InvalidQuery), ("DROP MATERIALIZED VIEW none", ViewNotFound), ("SELECT nonsense(key) FROM t", InvalidQuery), ("CREATE TABLE x (a INT)", UnsupportedOperation),
    ("DESCRIBE nothing", TopicNotFound), ("SELECT # FROM t", ParseError),
])
def test_errors(engine, sql, error):
    with pytest.raises(error):
        engine.sql(sql).collect()


def test_intervals():
    ok = {"5 ms": 5, "5 milliseconds": 5, "30s": 30_000, "2 secs": 2000, "1 second": 1000, "5 minutes": 300_000, "5 min": 300_000, "5m": 300_000, "2 hours": 7_200_000, "1h": 3_600_000, "1 day": 86_400_000, "3 d": 259_200_000, "250": 250}
    assert {k: text_ms(k) for k in ok} == ok
    for bad in ("1 week", "1 year", "x", "", "-1 s"):
        with pytest.raises(ParseError):
            text_ms(bad)
    assert timestamp_ms("2024-01-01T00:00:00.5Z") == 1704067200500 and timestamp_ms("2024-01-01T01:00:00+01:00") == 1704067200000 and timestamp_ms("no") is None


def test_only_the_first_statement_runs(engine):
    assert rows(engine, "SELECT COUNT(*) AS n FROM t; DROP MATERIALIZED VIEW x") == [(20,)]
    assert len(statements(tokenize("SELECT ';' ; -- comment ;\n SELECT 2"))) == 2


def test_result_is_capped(engine):
    out = engine.execute("SELECT offset, key, value FROM t", max_rows=5)
    assert out.row_count == 5 and out.truncated and len(out.rows) == 5
    assert out.columns[0] == {"name": "offset", "data_type": "bigint"}
    assert not engine.execute("SELECT partition FROM t").truncated
    with pytest.raises(QueryTimeout):
        engine.execute("WITH x AS (SELECT explode(sequence(1, 20000)) AS a FROM t) SELECT count(*) FROM x a JOIN x b ON a.a + b.a > 3 JOIN x c ON c.a > a.a + b.a", timeout_ms=1500)


def test_topics(engine):
    assert rows(engine, "SHOW TOPICS") == rows(engine, "SHOW TABLES") == [("t", 2), ("users", 1)]
    assert [r[:2] for r in rows(engine, "DESCRIBE t")] == [("0", 10), ("1", 10), ("TOTAL (2 partitions)", 20)]


def test_segments_are_writes(spark, tmp_path):
    """A partition of several spans of offsets has several files, but one segment for each write."""
    path = f"file://{tmp_path}/store"
    topic = records(spark, [(p, i, None, {"i": i}, i) for p in (0, 1) for i in range(30)])
    counts = lambda: [r[:3] for r in describe(spark.read.parquet(path)).collect()]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # so that spans go to files of their own
    try:
        write_topic(topic.where("offset < 20"), path, span=4)
    finally:
        spark.conf.unset(coalesce)
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() > 2
    assert counts() == [("0", 20, 1), ("1", 20, 1), ("TOTAL (2 partitions)", 40, 2)]
    write_topic(topic.where("offset >= 20 and partition = 1"), path, span=4)
    assert counts() == [("0", 20, 1), ("1", 30, 2), ("TOTAL (2 partitions)", 50, 3)]
    assert [r[2] for r in describe(topic).collect()] == [1, 1, 2]


def test_quoted_names(spark, tmp_path):
    run = engine_of(spark, tmp_path, **{"my-topic": records(spark, [(0, 0, "k", {"a b": 1}, 0)])})
    assert rows(run, """SELECT t.key, json_extract(t.value, '$.a b') AS x FROM "my-topic" t""") == [("k", "1")]
    assert rows(run, "SELECT COUNT(*) FROM `my-topic`") == [(1,)]


def test_organisations_are_apart(spark, tmp_path, engine):
    other = engine_of(spark, tmp_path)
    with pytest.raises(TopicNotFound):
        other.sql("SELECT * FROM t").collect()


def test_views(spark, tmp_path):
    base = records(spark, [(0, 0, "a", {"x": 1}, 0), (0, 1, "b", {"x": 2}, 100), (1, 0, "a", {"x": 5}, 200)])
    more = records(spark, [(0, 2, "a", {"x": 10}, 50), (1, 1, "b", {"x": 1}, 1500), (1, 2, "a", {}, 60)])
    engine = engine_of(spark, tmp_path, t=base)
    sql = "SELECT key, COUNT(*) AS n, SUM('$.x') AS s, MIN('$.x') AS lo, FIRST('$.x') AS f, LAST('$.x') AS l, AVG('$.x') AS a, COUNT(DISTINCT '$.x') AS d FROM t GROUP BY TUMBLE(timestamp, '1 second'), key"
    engine.sql(f"CREATE MATERIALIZED VIEW v AS {sql}")
    with pytest.raises(ViewAlreadyExists):
        engine.sql(f"CREATE MATERIALIZED VIEW v AS {sql}")
    with pytest.raises(InvalidQuery):
        engine.sql("SELECT * FROM v")
    engine.maintain()
    engine.catalog.add("t", base.unionByName(more))
    engine.maintain()
    engine.maintain()  # nothing new: nothing changes
    assert sorted(map(str, engine.sql("SELECT * FROM v").collect())) == sorted(map(str, engine.sql(sql).select(*engine.sql("SELECT * FROM v").columns).collect()))
    assert rows(engine, "SELECT key, s FROM v WHERE window_start = 0 ORDER BY key") == [("a", 16.0), ("b", 2.0)]
    assert rows(engine, "SHOW MATERIALIZED VIEWS") == [("v", "t", "continuous", "running", 3)]
    described = dict(rows(engine, "DESCRIBE MATERIALIZED VIEW v"))
    assert described["status"] == "running" and described["last_refresh_at"] != "never" and described["row_count"] == "3"
    engine.sql("CREATE OR REPLACE MATERIALIZED VIEW v WITH (refresh_mode = 'on_demand') AS SELECT key, COUNT(*) AS n FROM t WHERE x > 1 GROUP BY key")
    assert engine.maintain() == []
    engine.sql("REFRESH MATERIALIZED VIEW v")
    assert sorted(rows(engine, "SELECT * FROM v")) == [("a", 2), ("b", 1)]
    engine.sql("CREATE MATERIALIZED VIEW s WITH (refresh_mode = 'scheduled', interval = '1 minute') AS SELECT COUNT(*) AS n FROM t GROUP BY SESSION(timestamp, '1 s'), key")
    assert engine.maintain(1_000_000) == ["s"] and engine.maintain(1_030_000) == [] and engine.maintain(1_060_000) == ["s"]
    assert len(rows(engine, "SELECT * FROM s")) == 3
    again = engine_of(spark, tmp_path, t=base.unionByName(more))
    assert again.restore() == ["s", "v"]
    assert sorted(rows(again, "SELECT * FROM v")) == [("a", 2), ("b", 1)] and dict(rows(again, "DESCRIBE MATERIALIZED VIEW v"))["status"] == "running"
    again.catalog.add("t", base.unionByName(more).unionByName(records(spark, [(0, 3, "c", {"x": 9}, 7)])))
    again.sql("REFRESH MATERIALIZED VIEW v")
    assert sorted(rows(again, "SELECT * FROM v")) == [("a", 2), ("b", 1), ("c", 1)]
    assert rows(engine, "DROP MATERIALIZED VIEW v") == [("v", "dropped")]
    with pytest.raises(InvalidQuery):
        engine.sql("CREATE MATERIALIZED VIEW z AS SELECT COUNT(*) FROM t WHERE ZSCORE('$.x') > 1 GROUP BY key")


def test_conjuncts():
    from eventlake.plans.lexer import conjuncts, join, tokenize

    def cut(text):
        return [join(c) for c in conjuncts(tokenize(text))]

    assert cut("a = 1 AND b BETWEEN 2 AND 3 AND c") == ["a = 1", "b BETWEEN 2 AND 3", "c"]
    assert cut("CASE WHEN a AND b THEN c BETWEEN 1 AND 2 END AND d") == ["CASE WHEN a AND b THEN c BETWEEN 1 AND 2 END", "d"]
    assert cut("(a AND b) AND (c OR d) AND f(x AND y)") == ["a", "b", "c OR d", "f ( x AND y )"]
    assert cut("a AND b OR c") == ["a AND b OR c"]
    assert cut("a NOT BETWEEN 1 AND 2 AND NOT b") == ["a NOT BETWEEN 1 AND 2", "NOT b"]


def test_statistics_in_where_are_over_the_other_conditions(spark, tmp_path):
    rows_ = [(0, i, f"k{i % 2}", {"x": x}, i) for i, x in enumerate([1, 2, 3, 4, 100, 1000])]
    engine = engine_of(spark, tmp_path, t=records(spark, rows_), u=records(spark, rows_, "u"))
    forms = ("offset >= 0 AND offset <= 4", "offset BETWEEN 0 AND 4", "(offset < 2 OR offset < 5)", "CASE WHEN offset < 5 THEN true ELSE false END", "(offset <= 4 AND (partition = 0))")
    for form in forms:
        assert rows(engine, f"SELECT offset FROM t WHERE {form} AND ZSCORE('$.x') > 1") == [(4,)]
        assert rows(engine, f"SELECT offset FROM t WHERE ({form} AND ZSCORE('$.x') > 1)") == [(4,)]
        assert rows(engine, f"SELECT key, COUNT(*) AS n FROM t WHERE {form} AND ZSCORE('$.x') > 1 GROUP BY key") == [("k0", 1)]
    assert rows(engine, "SELECT offset FROM t WHERE offset < 5 AND (ZSCORE('$.x') > 1 OR offset = 0) ORDER BY offset") == [(0,), (4,)]
    assert rows(engine, "SELECT offset FROM t WHERE offset < 5 AND ZSCORE('$.x') > 1 OR offset = 0 ORDER BY offset") == [(0,)]
    assert rows(engine, "SELECT offset FROM t WHERE STDDEV('$.x') > 1 AND offset = 1") == []
    with pytest.raises(InvalidQuery):
        engine.sql("SELECT offset FROM t WHERE MOVING_AVG('$.x', 2) > 1")
    with pytest.raises(InvalidQuery):
        engine.sql("SELECT t.offset FROM t JOIN u ON t.key = u.key WHERE ZSCORE('$.x') > 1")


def test_arrows_and_lambdas(spark, tmp_path):
    engine = engine_of(spark, tmp_path, t=records(spark, [(0, 0, "k", {"a": [3, 4], "b": {"c": "z"}}, 0)]))
    assert rows(engine, "SELECT value->'a'->>0 AS x, value->'b'->>'c' AS y FROM t") == [("3", "z")]
    assert rows(engine, "SELECT transform(array(1L, 2L), x -> x + 1L) AS v, aggregate(array(1, 2), 0, (a, x) -> a + x) AS s, 1.5BD AS d, transform(array(5), x -> 1) AS o FROM t")[0][:2] == ([2, 3], 3)


def test_views_grow_by_segments(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    sql = "SELECT key, COUNT(*) AS n, SUM('$.x') AS s, COUNT(DISTINCT '$.x') AS d, FIRST('$.x') AS f, LAST('$.x') AS l FROM t GROUP BY TUMBLE(timestamp, INTERVAL '1 minute'), key"
    engine, made, seen = engine_of(spark, tmp_path, t=records(spark, [])), [], []
    engine.sql(f"CREATE MATERIALIZED VIEW v WITH (refresh_mode = 'manual') AS {sql}")
    view = engine.views.get("v")
    for step in range(6):
        made += [(0, len(made) + i, f"k{i % 3}", {"x": i % 4}, step * 9000) for i in range(6)]
        engine.catalog.add("t", records(spark, made))
        engine.refresh("v")
        seen.append([n for n, _ in view.segments])
        if step not in (0, 3, 5):
            continue
        got = sorted(map(str, engine.sql("SELECT * FROM v").collect()))
        want = engine.sql(sql.replace(" FROM", ", COUNT(*) AS again FROM")).drop("again")
        assert got == sorted(map(str, want.select(*engine.sql("SELECT * FROM v").columns).collect()))
        assert engine.views.show().first()["row_count"] == want.count()
    # each refresh wrote a segment of its own; four of like size became one, and those that were merged went a refresh later
    assert [len(s) for s in seen][:5] == [1, 2, 3, 1, 2] and max(map(len, seen)) <= 4
    held = {p.name for p in (tmp_path / "views" / view.id).iterdir() if "values" not in p.name}
    assert held == {f"s{n}" for n in seen[-1]} | {f"s{n}" for n in view.retired}
    again = engine_of(spark, tmp_path, t=records(spark, made))
    assert again.restore() == ["v"] and again.views.get("v").segments == view.segments
    engine.refresh("v")  # no new records
    assert [n for n, _ in view.segments] == seen[-1]
    engine.sql("DROP MATERIALIZED VIEW v")
    assert not (tmp_path / "views" / view.id).exists()


def test_moving_averages_in_spans(spark, tmp_path, monkeypatch):
    from eventlake.plans import dialect
    from eventlake.plans import engine as engines

    made = [(p, o, f"k{o % 3}", {"x": (o * 7 + p) % 11} if o % 5 else {}, o) for p in (0, 1, 2) for o in range(0, 60 if p != 1 else 4, p + 1)]
    engine = engine_of(spark, tmp_path, t=records(spark, made).repartition(3))
    for sql in (
        "SELECT *, MOVING_AVG('$.x', 4) AS m, MOVING_AVG('$.x', 9) AS n FROM t",
        "SELECT partition, offset, MOVING_AVG('$.x') AS m, STDDEV('$.x') AS s, ZSCORE('$.x') FROM t WHERE key != 'k1'",
        "SELECT DISTINCT MOVING_AVG('$.x', 1) AS m FROM t",
    ):
        monkeypatch.setattr(engines, "SMALL", 1 << 30)
        want = engine.sql(sql)
        monkeypatch.setattr(engines, "SMALL", 0)
        monkeypatch.setattr(dialect, "SPAN", 8)
        got = engine.sql(sql)
        assert got.columns == want.columns

        def rounded(df):
            return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())

        assert rounded(got) == rounded(want)
        text = got._jdf.queryExecution().optimizedPlan().toString()
        assert "__k" in text
