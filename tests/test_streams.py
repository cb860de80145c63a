import time

import pytest
from pyspark.sql import functions as F

from eventlake.errors import CheckpointNotFound, InvalidQuery, UnsupportedOperation
from eventlake.functions import jsonx
from eventlake.streaming import checkpoints, flows, pipelines, state

from .helpers import records


def replay_files(spark, tmp_path, batches, flow, mode="append"):
    """Each batch is a file and a micro-batch of its own."""
    path = f"file://{tmp_path}/in"
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by their time
    out = flow(flows.open_stream(spark, path, files_per_batch=1))
    flows.run_to_end(out, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", mode)
    return spark.read.schema(out.schema).parquet(f"file://{tmp_path}/out")


def test_tumbling_emits_once_and_drops_late(spark, tmp_path):
    batches = [records(spark, [(0, 0, "a", {"v": 1}, 0), (0, 1, "a", {"v": 2}, 900)]), records(spark, [(0, 2, "a", {"v": 5}, 20_000)]), records(spark, [(0, 5, "a", {"v": 1}, 20_500)]), records(spark, [(0, 3, "a", {"v": 9}, 100)]), records(spark, [(0, 4, "a", {"v": 1}, 40_000)])]
    got = replay_files(spark, tmp_path, batches, lambda s: flows.tumble(jsonx.parsed(s), 1000, [F.col("key")], [F.sum(jsonx.json_num("$.v")).alias("s")]))
    assert [tuple(r) for r in got.orderBy("window_start").collect()] == [(0, 1000, "a", 3.0), (20_000, 21_000, "a", 6.0)]


def test_watermark_of_the_slowest_partition(spark, tmp_path):
    batches = [records(spark, [(0, 0, "a", {}, 0), (1, 0, "b", {}, 0)]), records(spark, [(0, 1, "a", {}, 50_000)]), records(spark, [(1, 1, "b", {}, 500)]), records(spark, [(1, 2, "b", {}, 600)])]
    got = replay_files(spark, tmp_path, batches, lambda s: flows.tumble(flows.by_partition(s, [0, 1]), 1000, [], [F.count(F.lit(1)).alias("n")]))
    assert got.collect() == []  # partition 1 holds the watermark back


def test_hop_and_session(spark):
    df = records(spark, [(0, 0, "a", {}, 0), (0, 1, "a", {}, 1000), (0, 2, "a", {}, 2001), (0, 3, "z", {}, 100_000)])
    n = F.count(F.lit(1)).alias("n")
    hop = flows.replay(df, lambda s: flows.hop(s, 2000, 1000, [], [n])).where("window_start < 50000").orderBy("window_start")
    assert [tuple(r) for r in hop.collect()] == [(-1000, 1000, 1), (0, 2000, 2), (1000, 3000, 2), (2000, 4000, 1)]
    session = flows.replay(df, lambda s: flows.session(s, 1000, [F.col("key")], [n])).orderBy("window_start")
    assert [tuple(r) for r in session.collect()] == [(0, 1000, "a", 2), (2001, 2001, "a", 1)]


def test_outer_stream_join(spark, tmp_path):
    left = records(spark, [(0, 0, "a", {}, 1000), (0, 1, "b", {}, 1000)], "l")
    right = records(spark, [(0, 0, "a", {}, 3000), (0, 1, "c", {}, 1000)], "r")
    late = records(spark, [(0, 9, "z", {}, 90_000)], "l").unionByName(records(spark, [(0, 9, "y", {}, 90_000)], "r"))
    flow = lambda s: flows.interval_join(s.where("topic = 'l'"), s.where("topic = 'r'"), 5000, "full").select("l_key", "r_key")
    got = replay_files(spark, tmp_path, [left.unionByName(right), late, late], flow)
    assert sorted(map(str, got.collect())) == sorted(["Row(l_key='a', r_key='a')", "Row(l_key='b', r_key=None)", "Row(l_key=None, r_key='c')"])


def test_deduplication(spark):
    rows = [(0, i, None, "", i) for i in range(4)]
    df = records(spark, rows).withColumn("producer_id", F.lit("p")).withColumn("sequence", F.col("offset") % 2)
    path = f"{flows.work_folder(spark)}"
    df.write.parquet(f"{path}/in")
    out = flows.deduplicated(spark.readStream.schema(df.schema).parquet(f"{path}/in"))
    flows.run_to_end(out, f"{path}/out", f"{path}/ck")
    assert spark.read.parquet(f"{path}/out").count() == 2


def test_sequence_state(spark):
    df = spark.createDataFrame([("p", 0, i, s) for i, s in enumerate([1, 2, 2, 9, 3])], "producer_id string, partition int, offset long, sequence long")
    path = f"{flows.work_folder(spark)}"
    df.write.parquet(f"{path}/in")
    out = state.check_sequences(spark.readStream.schema(df.schema).parquet(f"{path}/in"))
    flows.run_to_end(out, f"{path}/out", f"{path}/ck")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").select("sequence", "status").collect()) == [(1, "ok"), (2, "duplicate"), (2, "ok"), (3, "ok"), (9, "gap")]


@pytest.mark.parametrize(("sql", "error"), [("SELECT 1; SELECT 2", InvalidQuery), ("DELETE FROM input", UnsupportedOperation), ("CREATE TABLE x (a INT)", UnsupportedOperation), ("", InvalidQuery)])
def test_transforms_are_one_query(sql, error):
    with pytest.raises(error):
        pipelines.validate(sql)


def test_transform_records(spark):
    df = records(spark, [(0, 1, "k1", {"action": "click", "n": None}, 1000)], "events")
    out = pipelines.to_records(pipelines.transform(df, "SELECT value->>'action' AS action, key, CAST(NULL AS INT) AS nothing FROM events", "events")).first()
    assert out["value"] == '{"action":"click","key":"k1","nothing":null}' and out["key"] == "k1" and (out["topic"], out["offset"], out["timestamp"]) == ("", 0, 0)
    counted = pipelines.to_records(pipelines.transform(df, "SELECT count(*) AS value FROM input")).first()
    assert counted["value"] == "1"
    same = pipelines.to_records(pipelines.transform(df, "SELECT * FROM input")).first()
    assert tuple(same) == tuple(df.first())


class Held:
    def __init__(self):
        self.batches = []

    def write(self, df, batch_id):
        self.batches.append((batch_id, sorted(r["value"] for r in df.collect())))


def test_pipeline_resumes_and_passes_empty_batches(spark, tmp_path):
    path, sink = f"file://{tmp_path}/in", Held()
    records(spark, [(0, 0, None, {"a": 1}, 0), (0, 1, None, {"a": 2}, 0)]).write.parquet(path)
    run = lambda: pipelines.Pipeline("p", flows.open_stream(spark, path), sink, f"file://{tmp_path}/ck", "SELECT json_extract(value, '$.a') AS value FROM input WHERE json_extract(value, '$.a') > 1").run_once()
    run()
    run()
    records(spark, [(0, 2, None, {"a": 0}, 0)]).write.mode("append").parquet(path)
    run()
    records(spark, [(0, 3, None, {"a": 7}, 0)]).write.mode("append").parquet(path)
    run()
    assert [v for _, v in sink.batches] == [["2"], [], ["7"]]


def test_manager(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    records(spark, [(0, 0, None, "x", 0)]).write.parquet(path)

    def begin(name):
        sink = Held()
        return lambda: pipelines.Pipeline(name, flows.open_stream(spark, path), sink, f"file://{tmp_path}/{name}").start()

    manager = pipelines.Manager(most=2)
    try:
        first = manager.submit("one", begin("one"))
        assert first == "cq-1"
        manager.queries[first].query.processAllAvailable()
        assert manager.stats(first)["input_rows"] == 1
        manager.pause(first)
        assert manager.stats(first)["state"] == "paused"
        manager.resume(first)
        manager.submit("two", begin("two"))
        with pytest.raises(InvalidQuery):
            manager.submit("three", begin("three"))
        manager.reconcile({"two": begin("two"), "four": begin("four")})
        assert [(q["name"], q["state"]) for q in manager.list()] == [("one", "stopped"), ("two", "running"), ("four", "running")]
        with pytest.raises(InvalidQuery):
            manager.pause("cq-99")
    finally:
        manager.reconcile({})


def changes(spark, path, rows):
    """Keyed records, a file for each call, so that each is a batch."""
    records(spark, [(0, o, k, v, 0) for o, k, v in rows]).coalesce(1).write.mode("append").parquet(path)


def keep_latest(spark, tmp_path, ttl_ms=None, name="latest"):
    out = state.latest_values(flows.open_stream(spark, f"file://{tmp_path}/in"), ttl_ms)
    held = []
    writer = out.writeStream.outputMode("update").foreachBatch(lambda df, _: held.extend(tuple(r) for r in df.collect()))
    query = writer.option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return held, query.id


def test_latest_values_and_their_state(spark, tmp_path):
    source, check = f"file://{tmp_path}/in", f"file://{tmp_path}/latest"
    changes(spark, source, [(0, "aa", "1"), (1, "ab", "2"), (2, "aa", "3"), (3, "b", "4")])
    held, first = keep_latest(spark, tmp_path)
    assert sorted(held) == [("aa", "3", 2), ("ab", "2", 1), ("b", "4", 3)]
    changes(spark, source, [(4, "ab", ""), (5, "b", "5")])
    held, second = keep_latest(spark, tmp_path)
    assert sorted(held) == [("ab", "", 4), ("b", "5", 5)] and first == second
    state_of = lambda **more: sorted((r["key"][0], r["value"]["value"]) for r in checkpoints.read_state(spark, check, "value", **more).collect())
    assert state_of() == [("aa", "3"), ("b", "5")]  # an empty value deletes a key
    assert state_of(prefix="a") == [("aa", "3")] and state_of(batch=0) == [("aa", "3"), ("ab", "2"), ("b", "4")]


def test_state_expires(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else batches that only look for what expired never end
    try:
        for step, row in enumerate([(0, "a", "1"), (1, "b", "2")]):
            time.sleep(0.3 * step)
            changes(spark, f"file://{tmp_path}/in", [row])
            keep_latest(spark, tmp_path, ttl_ms=50, name="short")
            keep_latest(spark, tmp_path, ttl_ms=3_600_000, name="long")
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    keys = {name: {r["key"][0] for r in checkpoints.read_state(spark, f"file://{tmp_path}/{name}", "value").collect()} for name in ("short", "long")}
    assert keys == {"short": {"b"}, "long": {"a", "b"}}


def test_checkpoints_are_copied_and_restored(spark, tmp_path):
    source, check, root = (f"file://{tmp_path}/{x}" for x in ("in", "latest", "copies"))
    assert checkpoints.batches(spark, check) == [] and checkpoints.saved(spark, root) == []
    changes(spark, source, [(0, "a", "1")])
    _, query = keep_latest(spark, tmp_path)
    assert checkpoints.batches(spark, check) == [0] and checkpoints.owner(spark, check) == query
    checkpoints.save(spark, check, root, "one")
    changes(spark, source, [(1, "a", "2")])
    keep_latest(spark, tmp_path)
    for name in ("two", "three"):
        checkpoints.save(spark, check, root, name, keep=2)
    assert checkpoints.saved(spark, root) == ["two", "three"]
    checkpoints.save(spark, check, root, "two")
    assert checkpoints.saved(spark, root) == ["three", "two"]
    changes(spark, source, [(2, "a", "3")])
    keep_latest(spark, tmp_path)
    with pytest.raises(InvalidQuery):
        checkpoints.restore(spark, root, "two", check, "another query")
    with pytest.raises(CheckpointNotFound):
        checkpoints.restore(spark, root, "one", check)
    checkpoints.restore(spark, root, "two", check, query)
    assert checkpoints.batches(spark, check) == [0, 1]
    held, again = keep_latest(spark, tmp_path)
    assert held == [("a", "3", 2)] and again == query
    checkpoints.drop(spark, root, "two")
    assert checkpoints.saved(spark, root) == ["three"]
