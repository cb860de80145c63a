import pytest
from pyspark.sql import functions as F

from eventlake.functions import jsonx

from .helpers import engine_of, records

VALUES = ["1", "1.0", "1.5", "1e300", '"5"', "true", "null", "[1,2]", '{"b":1}', None, "invalid", "12345678901234567890"]


@pytest.fixture(scope="module")
def typed(spark):
    rows = [(0, i, None, "{}" if v is None else "{bad" if v == "invalid" else f'{{"a":{v}}}', i) for i, v in enumerate(VALUES)]
    return records(spark, rows)


def test_kinds(typed):
    df = jsonx.parsed(typed).orderBy("offset")
    got = df.select(jsonx.json_text("$.a").alias("t"), jsonx.json_num("$.a").alias("n"), jsonx.json_str("$.a").alias("s"), jsonx.json_bool("$.a").alias("b")).collect()
    by = dict(zip(VALUES, got, strict=True))
    assert [by[v]["n"] for v in ("1", "1.0", "1.5", "1e300")] == [1.0, 1.0, 1.5, 1e300]
    assert all(by[v]["n"] is None for v in ('"5"', "true", "null", "[1,2]", '{"b":1}', None, "invalid"))
    assert by["12345678901234567890"]["n"] == pytest.approx(1.2345678901234567e19)
    assert by["1.0"]["t"] == "1.0" and by['"5"']["t"] == "5" and by["true"]["t"] == "true" and by['{"b":1}']["t"] == '{"b":1}' and by["null"]["t"] is None and by["invalid"]["t"] is None
    assert by['"5"']["s"] == "5" and by["1"]["s"] is None and by["true"]["b"] is True and by['"5"']["b"] is None


def test_paths(spark):
    value = {"items": [{"price": 5}], "a": {"b": 1}, "m": {"0": "zero"}}
    df = records(spark, [(0, 0, None, value, 0)])
    for path, want in (("$.items.0.price", "5"), ("$$..a..b", "1"), ("$.m.0", "zero"), ("a.b", "1"), ("$.items.1.price", None), ("$.nothing", None)):
        assert df.select(jsonx.json_text(path)).first()[0] == want, path
    assert '"items"' in df.select(jsonx.json_text("$")).first()[0]


def test_typed_comparisons(spark, tmp_path, typed):
    run = engine_of(spark, tmp_path, t=typed).sql
    offsets = lambda where: sorted(r["offset"] for r in run(f"SELECT offset FROM t WHERE {where}").collect())
    assert offsets("json_extract(value, '$.a') = 1") == [0, 1]
    assert offsets("json_extract(value, '$.a') >= 1 AND json_extract(value, '$.a') <= 1.5") == [0, 1, 2]
    assert offsets("json_extract(value, '$.a') > 1 AND json_extract(value, '$.a') < 1.5") == []
    assert offsets("json_extract(value, '$.a') = '5'") == [4]
    assert offsets("'5' = json_extract(value, '$.a')") == [4]
    assert offsets("json_extract(value, '$.a') = true") == [5]
    assert offsets("json_extract(value, '$.a') = NULL") == [6, 9]
    assert offsets("json_extract(value, '$.a') IN (1, 1.5)") == [0, 1, 2]
    assert offsets("json_extract(value, '$.a') NOT IN (1)") == [2, 3, 11]
    assert offsets("json_extract(value, '$.a') BETWEEN 1 AND 2") == [0, 1, 2]
    assert offsets("value->>'a' LIKE 't%'") == [5]
    assert offsets("a = 1") == [0, 1]
    assert offsets("json_extract(value, '$.a') IS NULL") == [6, 9, 10]
    assert offsets("json_extract(value, '$.a') + 1 > 2.4 AND offset < 5") == [2, 3]
    assert offsets("json_extract(value, '$.a') = -1") == []


def test_payloads_are_parsed_once(spark, tmp_path, typed):
    engine = engine_of(spark, tmp_path, t=typed)
    sql = engine.lower("SELECT SUM('$.a'), MAX('$.b'), MIN('$.c') FROM t WHERE json_extract(value, '$.d') > 1")
    assert sql.count("try_parse_json") == 1


def test_json_extract_in_plain_sql(spark, tmp_path):
    df = records(spark, [(0, 0, "k", {"items": [{"price": 5}], "s": "x", "m": {"0": 7}}, 0)])
    run = engine_of(spark, tmp_path, t=df).sql
    row = run("WITH x AS (SELECT value FROM t) SELECT json_extract(value, '$.items.0.price') AS p, json_extract(value, '$.m.0') AS m, json_number(value, '$.items[0].price') AS n FROM x").first()
    assert (row["p"], row["m"], row["n"]) == ("5", "7", 5.0)
    assert df.select(F.expr(jsonx.vector_sql("$.items"))).first()[0] is None
