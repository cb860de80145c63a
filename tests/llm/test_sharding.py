import zlib

import pytest

from eventlake.llm import sharding


def test_query(spark, sf, texts):
    from eventlake.llm.queries import op10_virtual_slots

    rows = op10_virtual_slots(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert 0 <= r["shard"] < 40
    for shard in range(40):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    for v in {r["vslot"] for r in rows}:
        assert len({r["shard"] for r in rows if r["vslot"] == v}) == 1


def test_bytes_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sizes = [r["b"] for r in sharding.shard_documents(docs, 40).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(sizes) == 40 and max(sizes) <= 1.02 * sum(sizes) / 40


def test_growing_moves_rows_only_into_the_new_shard():
    sizes = [(100 + 7 * i % 50, 1) for i in range(500)]
    now = sharding.first_map(sizes, 8)
    later = sharding.grown_map(now, sizes, 8)
    load = [0] * 9
    for slot, shard in enumerate(later):
        assert shard in (now[slot], 8)
        load[shard] += sizes[slot][0]
    mean = sum(load) / 9
    assert 0.8 * mean < load[8] < 1.2 * mean and max(load) < 1.2 * mean


def brute_deal(sizes, n_shards):
    """Largest slot first, to the shard with the fewest bytes, then slots, then the lowest number."""
    load, out = [[0, 0] for _ in range(n_shards)], {}
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        shard = min(range(n_shards), key=lambda s: (load[s], s))
        out[slot] = shard
        load[shard][0] += sizes[slot]
        load[shard][1] += 1
    return [out[s] for s in range(len(sizes))]


def test_deal_matches_brute_force(spark, sf, docs):
    rows = sharding.shard_documents(docs, 7, n_slots=200).collect()
    sizes = [sum(r["size"] for r in rows if r["vslot"] == v) for v in range(200)]
    want = brute_deal(sizes, 7)
    assert all(r["shard"] == want[r["vslot"]] for r in rows)
    later = sharding.grown_map(want, [(b, 1) for b in sizes], 7)
    assert all(r["next_shard"] == later[r["vslot"]] for r in rows)


def total(rows, n_slots):
    return sharding.slot_sizes(sharding.records(rows, n_slots), n_slots)


def test_a_stored_map_lives_on(spark, docs, tmp_path):
    path = f"file://{tmp_path}/map"
    half = docs.where("doc_id % 2 = 0")
    one = {r["doc_id"]: r for r in sharding.shard_documents(half, 5, n_slots=64, map_path=path).collect()}
    # more data joins the old layout
    two = {r["doc_id"]: r for r in sharding.shard_documents(docs, 5, n_slots=64, map_path=path).collect()}
    assert len(two) == docs.count() and all(two[d]["shard"] == r["shard"] and two[d]["vslot"] == r["vslot"] for d, r in one.items())
    assert {r["map_version"] for r in two.values()} == {1} and sharding.versions(spark, path) == [1]
    # evening out moves few slots, and stores a version
    sizes = total(docs, 64)
    version, even = sharding.rebalance(spark, path, sizes, 0.05)
    _, first, _ = sharding.load_map(spark, path, 1)
    load = [sum(sizes[v][0] for v in range(64) if even[v] == s) for s in range(5)]
    old = [sum(sizes[v][0] for v in range(64) if first[v] == s) for s in range(5)]
    assert version == 2 and max(load) <= max(old) and sum(a != b for a, b in zip(first, even, strict=True)) <= 16
    assert sharding.rebalance(spark, path, sizes, 10.0) == (2, even)
    # one more shard: slots move only there
    three = {r["doc_id"]: r for r in sharding.shard_documents(docs, 6, n_slots=64, map_path=path).collect()}
    assert sharding.versions(spark, path) == [1, 2, 3] and {r["map_version"] for r in three.values()} == {3}
    assert {r["shard"] for r in three.values()} == set(range(6)) and all(r["shard"] in (even[r["vslot"]], 5) for r in three.values())
    for shards, slots in ((5, 64), (6, 32)):
        with pytest.raises(ValueError):
            sharding.shard_documents(docs, shards, n_slots=slots, map_path=path)
    # what a failed job left is no version, and gives way
    (tmp_path / "map" / "version=4").mkdir()
    assert sharding.load_map(spark, path)[0] == 3 and sharding.grow(spark, path, sizes)[0] == 4
    with pytest.raises(ValueError):
        sharding.load_map(spark, path, 9)


def test_rebalancing_of_one_large_slot():
    assert sharding.rebalanced_map([0, 0, 1], [(100, 1), (1, 1), (1, 1)], 2) == [0, 1, 1]
    assert sharding.rebalanced_map([0, 1], [(0, 0), (0, 0)], 2) == [0, 1]


def test_hot_slots_are_numbered_in_chunks(spark):
    docs = spark.createDataFrame([(7, "the same text")] * 900 + [(i, f"text {i}") for i in range(100)], "doc_id long, text string").repartition(5)
    rows = sharding.spill(sharding.records(docs, 16), "test-records")
    sizes = sharding.slot_sizes(rows, 16)
    out = sharding.assign(rows, sharding.first_map(sizes, 3), sizes, chunk=50)
    found = out.collect()
    for shard in range(3):
        own = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert len(found) == 1000


def test_odd_rows(spark, odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, 3, n_slots=16).collect()
    assert len(rows) == odd_docs.count()
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 1} == {(16, 0)}
    for shard in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert sharding.shard_documents(no_docs, 3, n_slots=16).collect() == []


@pytest.mark.parametrize("shards", [1, 40])
def test_map_of_nothing(shards):
    assert len(sharding.first_map([(0, 0)] * 80, shards)) == 80
