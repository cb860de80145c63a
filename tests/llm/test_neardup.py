import random

import numpy as np
import pytest
import xxhash

from eventlake.llm import neardup
from eventlake.llm.components import connected


def brute_fingerprint(text):
    words, word = [], b""
    for b in (text or "").encode():
        if b == 0x20 or 0x09 <= b <= 0x0D:
            words, word = words + [word] * bool(word), b""
        else:
            word += bytes([b + 32 if 65 <= b <= 90 else b])
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, doc in enumerate(ids):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: least[find(i)] for i, doc in enumerate(ids)}


def test_fingerprints_match_brute_force(texts):
    odd = [None, "", " \t\n", "one", "Two Words", "A b C d", "\u00c4\u00a0b c\x0bd e f\x1cg", "a b c d a b c d a b c d"]
    for t in [*texts.values(), *odd]:
        assert neardup.fingerprint(t) == brute_fingerprint(t)


def test_query_matches_brute_force(spark, sf, texts):
    from eventlake.llm.queries import op6_segment_popcount

    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    want = brute_components(ids, fps)
    rows = op6_segment_popcount(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{f:016x}", want[i]) for i, f in zip(ids, fps, strict=True)}


def flipped(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("hot", [neardup.HOT, 40])
def test_no_link_is_lost(spark, hot):
    rng = random.Random(hot)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [flipped(rng, f, n) for f in fps[:30] for n in (1, 2, 3, 4, 5, 6)]
    centre = rng.getrandbits(64)
    fps += [flipped(rng, centre, rng.randint(0, 3)) for _ in range(300)]  # one large group
    fps = sorted(set(fps))
    ids = list(range(len(fps)))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    grouped = neardup.cells(frame, hot=hot, block=hot // 3)
    roots = {r["node"]: r["root"] for r in connected(neardup.links(grouped)).collect()}
    got = {}
    for i, f in zip(ids, signed, strict=True):
        got.setdefault(roots.get(f, f), []).append(i)
    want = {}
    for i, c in brute_components(ids, fps).items():
        want.setdefault(c, []).append(i)
    assert sorted(got.values()) == sorted(want.values())
    if hot == 40:
        assert grouped.count() > neardup.cells(frame).count()  # cells were split


def test_cells_within_one_step(spark):
    rows = neardup.cells(spark.createDataFrame([(0,), (-1,), (0x5555555555555555,)], "fp long")).groupBy("fp").count().collect()
    # all lanes at 0 or 2 have one neighbour each, lanes at 1 have two
    assert {r["fp"]: r["count"] for r in rows} == {0: 34, -1: 34, 0x5555555555555555: 66}


def test_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(7, i) for i in range(8)] + [(8, 1 << 40), (9, 0)], "cell long, fp long")
        found = {tuple(sorted((r["u"], r["v"]))) for r in neardup.links(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {x for pair in found for x in pair} == set(range(8))


def test_connected(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected(spark.createDataFrame([], "u long, v long")).collect() == []


def test_odd_rows(spark, odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[5] == by[6] == 5 and by[1] == by[2] == 1
    assert by[None] in (1, None)
    kept = neardup.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 4, 5, 8, 9]
    assert neardup.near_duplicates(no_docs).collect() == [] and neardup.one_of_each(no_docs).collect() == []


def test_texts_of_one_id_stand_for_their_own_groups(spark):
    a, b, c = ("one text of a group that has words", "something else altogether goes on here", "third and last of the unlike texts")
    rows = [(1, a), (1, b), (1, b), (2, b), (2, c), (3, c), (4, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.one_of_each(df).collect()) == sorted([(1, a), (1, b), (2, c)])


def test_rows_without_an_id(spark):
    a, b, c = ("one text of a group that has words", "something else altogether goes on here", "third and last of the unlike texts")
    rows = [(None, a), (4, a), (None, b), (None, b), (None, c), (None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "map(1, text) AS more")
    kept = [(r["doc_id"], r["text"]) for r in neardup.one_of_each(df).collect()]
    assert sorted(kept, key=str) == sorted([(4, a), (None, b), (None, c), (7, "")], key=str)


def test_tables_of_rounds_go(spark, tmp_path):
    from eventlake.llm import common
    from eventlake.session import complete

    before = set(complete(spark, common.work_dir(spark)))
    found = connected(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"))
    assert found.count() == 41
    left = set(complete(spark, common.work_dir(spark))) - before
    assert len(left) == 1  # the last edges, which the result reads

    def make():
        return common.spill(common.spill(spark.range(5).toDF("n"), "inner").where("n > 1"), "middle").where("n > 2")

    out = common.settled(spark, make, "outer")
    assert sorted(r["n"] for r in out.collect()) == [3, 4]
    assert [p[:5] for p in set(complete(spark, common.work_dir(spark))) - before - left] == ["outer"]
    common.discard(out)
    assert set(complete(spark, common.work_dir(spark))) - before == left
