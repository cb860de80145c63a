import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlake.functions import jsonx
from eventlake.operators import cdc, compaction, infer, joins, predicates, windows
from eventlake.operators.aggs import aggregate, named
from eventlake.sources import topics

from .helpers import records


def test_predicate_trees(spark):
    df = records(spark, [(0, 0, None, {"a": 5, "s": "hello", "b": True}, 0), (0, 1, None, {"a": "5"}, 0), (0, 2, None, {}, 0), (0, 3, None, "bad{", 0), (0, 4, None, {"a": 5.0, "x.y": 1}, 0)])
    leaf = lambda op, f, v: {"op": op, "field": f, "value": v}
    got = lambda tree: sorted(r["offset"] for r in predicates.keep(df, tree).collect())
    assert got(leaf("equals", "a", 5)) == [0, 4] and got(leaf("equals", "a", "5")) == [1] and got(leaf("equals", "b", True)) == [0]
    assert got(leaf("greater_than", "a", 4)) == [0, 4] and got(leaf("less_than", "a", 5)) == [] and got(leaf("contains", "s", "ell")) == [0]
    assert got({"op": "not", "arg": leaf("equals", "a", 5)}) == [1, 2]  # a missing field makes the leaf false
    assert got({"op": "or", "args": [leaf("equals", "a", "5"), leaf("equals", "x.y", 1)]}) == [1, 4]
    assert got({"op": "and", "args": []}) == [0, 1, 2, 4]
    with pytest.raises(Exception, match="invalid JSON at offset 3"):
        predicates.keep(df, leaf("equals", "a", 5), strict=True).collect()


def test_projection(spark):
    df = records(spark, [(0, 0, None, '{"a": 1, "b": null, "c": {"d": "x"}}', 0), (0, 1, None, "{}", 0)])
    assert [r["value"] for r in predicates.project(df, {"a": "n", "b": "b", "c": "c"}).orderBy("offset").collect()] == ['{"n":1,"b":null,"c":{"d":"x"}}', "{}"]


def test_aggregate_order_doesnt_hang_on_rows(spark):
    df = records(spark, [(1, 0, "k", {"v": "late"}, 9), (0, 1, "k", {}, 9), (0, 0, "k", {"v": "early"}, 1)]).orderBy(F.col("timestamp").desc())
    row = df.groupBy("key").agg(aggregate("first", jsonx.json_text("$.v")).alias("f"), aggregate("last", jsonx.json_text("$.v")).alias("l")).first()
    assert (row["f"], row["l"]) == ("early", "late")
    null_last = df.where("partition = 0").groupBy("key").agg(aggregate("last", jsonx.json_text("$.v")).alias("l")).first()
    assert null_last["l"] is None
    assert df.groupBy().agg(*named([("count", None), ("mean", F.col("offset")), ("last_value", F.col("key"))])).columns == ["count_0", "avg_1", "last_2"]


def test_latest_per_key(spark):
    df = records(spark, [(0, 5, "a", "new offset", 1), (1, 0, "a", "new time", 7), (0, 1, None, "x", 9), (0, 2, "b", "same", 3), (1, 1, "b", "same time, later partition", 3)])
    assert sorted(r["value"] for r in joins.latest_per_key(df).collect()) == ["new time", "same time, later partition"]
    assert "new offset" not in [r["value"] for r in joins.latest_per_key(df).collect()]
    assert sorted(r["value"] for r in joins.latest_per_key(df, order=("offset",)).collect()) == ["new offset", "same"]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_interval_joins_match_brute_force(spark, how):
    left = [(0, i, k, {}, t) for i, (k, t) in enumerate([("a", 0), ("a", 1000), ("a", 2001), ("b", 5), (None, 5), ("a", -1)])]
    right = [(0, i, k, {}, t) for i, (k, t) in enumerate([("a", 1000), ("a", 2000), ("b", 1006), (None, 5), ("c", 0)])]
    got = joins.interval_join(records(spark, left), records(spark, right), F.col("key"), F.col("key"), 1000, how)
    pairs = [(a[1], b[1]) for a in left for b in right if a[2] is not None and a[2] == b[2] and abs(a[4] - b[4]) <= 1000]
    want = list(pairs)
    if how in ("left", "full"):
        want += [(a[1], None) for a in left if a[1] not in {x for x, _ in pairs}]
    if how in ("right", "full"):
        want += [(None, b[1]) for b in right if b[1] not in {y for _, y in pairs}]
    assert sorted(map(str, [(r["l.offset"], r["r.offset"]) for r in got.collect()])) == sorted(map(str, want))


def test_equal_keys_with_nulls(spark):
    a, b = records(spark, [(0, 0, None, "{}", 0), (0, 1, "x", "{}", 0)]), records(spark, [(0, 0, None, "{}", 0), (0, 1, "y", "{}", 0)])
    assert joins.equi_join(a, b, F.col("key"), F.col("key")).count() == 0
    assert joins.equi_join(a, b, F.col("key"), F.col("key"), "full").count() == 4


def test_compaction(spark):
    day = compaction.DAY_MS
    df = records(spark, [
        (0, 0, "a", "1", 0), (0, 1, "a", "", 1), (0, 2, "a", "2", 2), (0, 3, "b", "1", 3), (0, 4, "b", "", 4), (0, 5, "c", "", 10 * day - 5), (0, 6, None, "n", 6), (0, 7, None, "", 7), (0, 8, "", "e", 8),
        (1, 0, "a", "other partition", 0),
    ])
    kept = sorted((r["partition"], r["offset"]) for r in compaction.compact(df, 10 * day).collect())
    assert kept == [(0, 2), (0, 5), (0, 6), (0, 7), (0, 8), (1, 0)]
    ratio = {r["partition"]: r["dirty_ratio"] for r in compaction.dirty_ratio(df).collect()}
    assert ratio[0] == pytest.approx(1 - 4 / 7) and ratio[1] == 0
    assert [r["partition"] for r in compaction.needs_compaction(df, 0.4).collect()] == [0]


def test_eligible_segments(spark):
    rows = [("t", 0, 0, 600, 0), ("t", 0, 600, 300, 0), ("t", 0, 900, 300, 0), ("t", 0, 1200, 10, 9_000_000), ("t", 1, 0, 5, 0)]
    df = spark.createDataFrame(rows, "topic string, partition int, base_offset long, record_count long, created_at long")
    assert sorted(r["base_offset"] for r in compaction.eligible(df, 9_000_001, max_rows=1000).collect()) == [0, 600]


def test_compacted_partitions_are_replaced(spark, tmp_path):
    from eventlake.sources.topics import read_topic, write_topic

    path = f"file://{tmp_path}/store"
    write_topic(records(spark, [(0, 0, "a", "1", 0), (0, 1, "a", "2", 1), (1, 0, "b", "1", 0)]), path)
    part = spark.createDataFrame(compaction.compact(read_topic(spark, path).where("partition = 0"), 0).collect(), "topic string, partition int, offset long, key string, value string, timestamp long")
    compaction.replace_partition(spark, part, path)
    assert sorted((r["partition"], r["offset"]) for r in read_topic(spark, path).collect()) == [(0, 1), (1, 0)]


def test_sequences(spark):
    rows = [("p", "t", 0, i, s) for i, s in enumerate([5, 6, 6, 4, 9, 7, 8])] + [("q", "t", 0, 9, 1), ("p", "t", 1, 0, 70)]
    df = spark.createDataFrame(rows, "producer_id string, topic string, partition int, offset long, sequence long")
    got = [r["status"] for r in compaction.sequence_status(df).where("producer_id = 'p' and partition = 0").orderBy("offset").collect()]
    assert got == ["ok", "ok", "duplicate", "duplicate", "gap", "ok", "ok"]
    assert compaction.sequence_status(df.where("offset > 99")).collect() == []


def test_retention(spark):
    df = records(spark, [(0, 0, None, "", 99), (0, 1, None, "", 100)])
    assert [r["offset"] for r in compaction.retain(df, 200, 100).collect()] == [1]


CDC = [
    {"op": "c", "before": None, "after": {"id": 1, "n": "a"}, "ts_ms": 1, "source": {"db": "d", "table": "x", "lsn": 10}},
    {"op": "u", "before": {"id": 1}, "after": {"id": 1, "n": "b"}, "ts_ms": 2, "source": {"table": "x", "lsn": 11}},
    {"payload": {"op": "r", "after": {"id": 2, "n": "c"}, "ts_ms": 3, "source": {"table": "x"}}},
    {"op": "d", "before": {"id": 2}, "after": None, "ts_ms": 4, "source": {"table": "x", "lsn": 13}},
    {"op": "Create", "after": {"id": 3}}, {"op": "t", "ts_ms": 0, "source": {"table": "y"}}, {"op": "zz"}, "not json", {"op": "schema_change", "source": {"table": "x"}},
]


def test_change_capture(spark):
    df = records(spark, [(0, i, None, v, i) for i, v in enumerate(CDC)])
    found = cdc.parse(df).orderBy("offset").collect()
    assert [r["op"] for r in found] == ["insert", "update", "read", "delete", "insert", "truncate", None, None, "schema_change"]
    assert found[4]["ts_ms"] == 0 and found[4]["table"] == "" and found[0]["before"] is None and found[0]["source"]["lsn"] == 10
    kept = cdc.keep_operations(cdc.parse(df), ["insert", "update"], ["x"])
    assert kept.count() == 2 and cdc.keep_operations(cdc.parse(df)).count() == 6 and cdc.keep_operations(cdc.parse(df), schema_changes=True).count() == 7
    counts = {r["op"]: (r["changes"], r["last_lsn"]) for r in cdc.stats(cdc.parse(df)).collect()}
    assert counts["insert"][0] == 2 and counts["delete"] == (1, 13)
    state = {(r["table"], r["id"]): r["row"] for r in cdc.table_state(cdc.parse(df), ["id"]).collect()}
    assert state == {("x", "1"): '{"id":1,"n":"b"}', ("", "3"): '{"id":3}'}


def test_truncate_clears_a_table(spark):
    rows = [{"op": "c", "after": {"id": 1}, "ts_ms": 1, "source": {"table": "x"}}, {"op": "t", "ts_ms": 2, "source": {"table": "x"}}, {"op": "c", "after": {"id": 2}, "ts_ms": 3, "source": {"table": "x"}}]
    df = records(spark, [(0, i, None, v, i) for i, v in enumerate(rows)])
    assert [r["id"] for r in cdc.table_state(cdc.parse(df), ["id"]).collect()] == ["2"]


def test_lateness(spark):
    df = records(spark, [(0, 0, None, "", 10_000), (0, 1, None, "", 5000), (0, 2, None, "", 0), (0, 3, None, "", -1), (1, 0, None, "", 3000)])
    got = [r["lateness"] for r in windows.late_classes(df).orderBy("partition", "offset").collect()]
    assert got == ["on_time", "on_time", "late", "too_late", "on_time"]
    assert windows.global_watermark(df).first()["watermark"] == 3000 - 5000
    assert windows.global_watermark(df, idle_ms=6000).first()["watermark"] == 10_000 - 5000


def test_negative_times_floor(spark):
    df = records(spark, [(0, 0, None, "", -5)])
    assert windows.tumble(df, 10, [], [F.count(F.lit(1)).alias("n")]).first()["window_start"] == -10


def test_inference_of_deep_objects(spark):
    df = spark.createDataFrame([('{"a":{"b":{"c":{"d":{"e":{"f":1}}}}}}',), ('{"a":2}',), ("no json",)], "value string")
    paths = {r["path"] for r in infer.infer_schema(df).collect()}
    assert paths == {"$" + "".join(f".{x}" for x in "abcdef"[:n]) for n in range(1, 7)}
    assert {r["path"] for r in infer.path_values(df, 2).collect()} == {"$.a", "$.a.b"}
    assert infer.infer_schema(df.where("value = 'no json'")).collect() == []


def test_inference(spark):
    df = records(spark, [(0, 0, None, {"id": 1, "x": 1.5, "s": "a", "o": {"k": True}, "n": None}, 0), (0, 1, None, {"id": 2, "x": 2, "s": "b", "l": [1]}, 0), (0, 2, None, "bad", 0)])
    got = {r["path"]: r for r in infer.infer_schema(df).collect()}
    assert {p: r["sql_type"] for p, r in got.items()} == {"$.id": "BIGINT", "$.x": "DOUBLE", "$.s": "VARCHAR", "$.o": "JSON", "$.o.k": "BOOLEAN", "$.n": "VARCHAR", "$.l": "JSON"}
    assert got["$.id"]["occurrence_rate"] == 1 and not got["$.id"]["nullable"] and got["$.id"]["index_hint"] and got["$.n"]["nulls"] == 1 and got["$.l"]["nullable"]
    assert "id" in infer.payload_type(df) and infer.confidence(5) < infer.confidence(5000)
    cost = infer.cost(df, limit=5, rows=20_000)
    assert cost["rows"] == 5 and cost["tier"] == "low" and infer.cost(df, rows=50_000)["tier"] == "medium" and cost["estimated_ms"] == 10


def test_lateness_over_spans(spark):
    rng = random.Random(2)
    rows = [(p, o, None, "x", o * 1000 - rng.choice([0, 0, 3000, 7000, 12_000])) for p in (0, 1) for o in range(300)]
    whole, spans = (sorted(map(tuple, windows.late_classes(records(spark, rows), span=n).collect()), key=str) for n in (1 << 20, 16))
    assert whole == spans and {r[-1] for r in whole} == {"on_time", "late", "too_late"}


def test_store_is_compacted_in_place(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = [(p, o, f"k{o % 3}", str(o), 0) for p in (0, 1) for o in range(9)] + [(2, 0, "only", "x", 0)]
    topics.write_topic(records(spark, rows), path)
    kept = lambda: sorted((r["partition"], r["offset"]) for r in topics.read_topic(spark, path).collect())
    before = kept()
    assert compaction.compact_store(spark, path, 0, threshold=0.9) == [] and kept() == before
    assert compaction.compact_store(spark, path, 0, threshold=0.5) == [("t", 0), ("t", 1)]
    want = [(p, o) for p in (0, 1) for o in (6, 7, 8)] + [(2, 0)]
    assert kept() == want and not (tmp_path / "t" / "_compaction").exists()
    # a run that failed after staging: the next one finishes it first
    topics.write_topic(records(spark, [(0, 9, "k0", "new", 0)]), path)
    staged = compaction.compact(topics.read_topic(spark, path).where("partition = 0"), 0)
    staged.write.partitionBy("topic", "partition").parquet(f"{path}/_compaction/left")
    staged.limit(0).write.parquet(f"{path}/_compaction/half")
    (tmp_path / "t" / "_compaction" / "half" / "_SUCCESS").unlink()
    assert kept() == sorted([*want, (0, 9)])  # readers don't see what is staged
    assert compaction.compact_store(spark, path, 0, threshold=0.9) == [("t", 0)]
    assert kept() == [(0, 7), (0, 8), (0, 9), (1, 6), (1, 7), (1, 8), (2, 0)]
    assert compaction.compact_store(spark, path, 0) == [("t", 0), ("t", 1), ("t", 2)]


def test_statuses_of_any_sequences():
    rng = random.Random(5)
    for _ in range(400):
        n, x = [], rng.randint(0, 5)
        for _ in range(rng.randint(0, 300)):
            x = max(0, x + rng.choice([1] * 20 + [0, -1, 2, 3]))
            n.append(x)
        last = start = rng.choice([None, 0, 3])
        before, status = [], []
        for v in n:
            ok = last is None or v == last + 1
            before.append(-1 if last is None else last)
            status.append(0 if ok else 1 if v <= last else 2)
            last = v if ok else last
        a, b, c = compaction._statuses(np.array(n, np.int64), start)
        assert (a.tolist(), b.tolist(), c) == (before, status, last)
