import hashlib
import math
from collections import Counter

import numpy as np

from eventlake.llm import fingerprints as fp


def test_entropy_levels_match_counting():
    raw = np.frombuffer("Abracadabra, said the wizard; 1234 aaaaaaaaaaaaaaaaaaaaaaaaa".encode(), np.uint8)
    levels = fp.entropy_levels(raw)
    assert len(levels) == len(raw) - fp.WINDOW + 1
    for i, level in enumerate(levels):
        counts = Counter(raw[i : i + fp.WINDOW].tolist()).values()
        exact = -sum(c / fp.WINDOW * math.log2(c / fp.WINDOW) for c in counts) * 16
        assert abs(level - exact) <= 1.01
    assert len(fp.entropy_levels(raw[:5])) == 0


def test_features_dont_depend_on_blocks(monkeypatch, texts):
    raws = [t.encode() for t in texts.values()][:40]
    alone = [fp.feature_hashes([r])[0] for r in raws]
    together = fp.feature_hashes(raws)
    monkeypatch.setattr(fp, "BLOCK", 300)
    blocked = fp.feature_hashes(raws)
    for a, b, c in zip(alone, together, blocked, strict=True):
        assert np.array_equal(a, b) and np.array_equal(a, c)


def test_likeness():
    a, b, empty = fp.digests(["the quick brown fox jumps over the lazy dog again and again " * 5, "completely different words make up this other sentence of mine " * 5, ""])
    assert fp.likeness(a, a) == 1 and fp.likeness(empty, empty) == 1 and fp.likeness(a, empty) == 0
    assert fp.likeness(a, b) < 0.1 and fp.likeness(a, b) == fp.likeness(b, a)
    assert str(fp.Digest.parse(str(a))) == str(a) and fp.likeness(fp.Digest.parse(str(a)), a) == 1


PERIODIC = ["a" * 1000, "=" * 200, "ab" * 300, "abcdefgh" * 200, "abcdefghijklmnopqrstuvwxyz" * 50, "0123456789" * 100, "ha " * 200, "1234\n" * 300, "na na hey hey " * 60]


def test_periodic_texts_have_features(monkeypatch):
    digests = fp.digests([*PERIODIC, "", "x" * 16, "y" * 40])
    empty = digests[len(PERIODIC)]
    for i, a in enumerate(digests):
        for j, b in enumerate(digests):
            if i != j:
                assert fp.likeness(a, b) < 0.5, (i, j)
        assert a is empty or a.counts.sum() > 0
    raws = [t.encode() for t in [*PERIODIC, "a quick one " + "z" * 900 + " and over the lazy dog" * 30]]
    want = fp.feature_hashes(raws)
    monkeypatch.setattr(fp, "BLOCK", 100)
    assert all(np.array_equal(a, b) for a, b in zip(want, fp.feature_hashes(raws), strict=True))


def test_features_match_the_rule():
    rng = np.random.default_rng(5)
    for _ in range(150):
        raw = b"".join(rng.choice([b"a", b"ab", b"xyz", b"word ", b"1", b"the end"]) * int(rng.integers(1, 30)) for _ in range(int(rng.integers(1, 9))))
        if len(raw) < fp.WINDOW:
            continue
        x = np.frombuffer(raw, np.uint8)
        order, n = fp._orders(x).tolist(), len(raw) - fp.WINDOW + 1
        stretch = min(fp.STRETCH, n)
        votes = Counter(min(range(s, s + stretch), key=lambda i: (order[i], i)) for s in range(n - stretch + 1))
        some = {i for i, v in votes.items() if v >= fp.VOTES}
        edge = [-1, *sorted(some), n]
        for a, b in zip(edge, edge[1:], strict=False):
            if b - a - 1 >= stretch:
                some.add(min(range(a + 1, b), key=lambda i: (order[i], i)))
        assert some and np.array_equal(fp.feature_hashes([raw])[0], fp._hash_windows(x, np.array(sorted(some))))


def test_query_matches_brute_force(spark, sf, texts):
    from eventlake.llm.queries import op1_improbable_features

    order = sorted(texts, reverse=True)
    found = {r["doc_id"]: r for r in op1_improbable_features(spark, sf).collect()}
    assert sorted(found) == sorted(texts)
    near = 0
    for i, doc in enumerate(order):
        text, after = texts[doc], texts[order[(i + 1) % len(order)]]
        n = len(text) // 2
        changed = text[: len(text) - n] + after[:n]
        own, next_, new = fp.digests([text, after, changed])
        r = found[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (str(own), str(new))
        assert r["near_edited"] == fp.likeness(own, new) and r["near_next"] == fp.likeness(own, next_)
        near += r["near_edited"] > r["near_next"] or text == after
    assert near >= 0.95 * len(order)


def test_parts_keep_the_order(spark, texts, docs, monkeypatch):
    whole = {r["doc_id"]: r for r in fp.compare(docs).collect()}
    monkeypatch.setattr(fp, "PART_ROWS", 7)
    laid = fp.in_order(docs, part_rows=7)
    assert laid.select("part").distinct().count() > 10
    assert laid.where("not ghost").count() == len(texts)
    assert len(whole) == len(texts)


def test_odd_rows(odd_docs, no_docs):
    rows = fp.compare(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_chars"] == 0 and by[1][0]["fingerprint"] == by[2][0]["fingerprint"] == "0:"
    assert len(by[5]) == 2 and by[5][0]["fingerprint"] == by[5][1]["fingerprint"] == by[6][0]["fingerprint"]
    assert by[6][0]["near_next"] == 1.0  # the next row has the same text
    assert fp.compare(no_docs).collect() == []


def test_one_row_is_its_own_next(spark):
    df = spark.createDataFrame([(1, "just one text that stands alone here")], "doc_id long, text string")
    assert fp.compare(df).first()["near_next"] == 1.0


def test_likeness_matches_the_whole_matrix(texts, monkeypatch):
    monkeypatch.setattr(fp, "FULL", 7)
    held = sorted(texts.values(), key=len)[-12:]
    held += [held[0][:2000] + held[1][500:3000], held[0][: len(held[0]) // 2] + held[2], held[0] + held[0]]
    digests = fp.digests(held)
    for a in digests:
        for b in digests:
            bits = [np.unpackbits(d.filters, axis=1).astype(float) for d in (a, b)]
            common, chance = bits[0] @ bits[1].T, np.outer(a.ones, b.ones) / fp.BITS
            score = np.maximum(0, (common - chance) / np.maximum(1, np.maximum.outer(a.ones, b.ones) - chance))
            want = 1.0 if a is b else ((score.max(axis=1) * a.counts).sum() / a.counts.sum() + (score.max(axis=0) * b.counts).sum() / b.counts.sum()) / 2
            assert abs(fp.likeness(a, b) - min(1, want)) < 1e-9


def test_very_long_texts_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(3, 9, 3000)]
    a, b = (" ".join(words[i] for i in rng.integers(0, 3000, 700_000)) for _ in range(2))
    tracemalloc.start()
    one, two = fp.digests([a])[0], fp.digests([b])[0]
    assert 0 <= fp.likeness(one, two) < 0.5
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) > 4_000_000 and most < 16 * len(a)


def brute_rows(rows):
    """(id, edited text, next text) of each row, in the order of ids."""
    out = []
    for i, (doc, text, _) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 2
        out.append((doc, hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest(), text == after))
    return out


def test_hot_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(fp, "PART_ROWS", 40)
    made = [(i, f"text number {i} of the rows that stand alone") for i in range(300)] + [(150, "one row that repeats very often")] * 700 + [(None, "rows without an id")] * 400 + [(None, "another")]
    for rows in (made, made[300:1000], [(f"id {i}", t) for i, t in made]):
        df = spark.createDataFrame(rows, "doc_id string, text string" if isinstance(rows[0][0], str) else "doc_id long, text string").repartition(6)
        laid = fp.in_order(df, part_rows=40)
        assert laid.where("not ghost").count() == len(rows)
        assert laid.groupBy("part", "sub").count().agg({"count": "max"}).first()[0] <= 160
        keys = fp._keyed(df, "doc_id", "text").collect()
        ordered = sorted(((r["doc_id"], r["text"], r["hash"]) for r in keys), key=lambda r: fp._sorting((r[0], r[2])), reverse=True)
        # of rows that repeat whole, which one is the last is open: all give the same rows but one
        found = fp.compare(df).collect()
        got = Counter((r["doc_id"], r["edited_sha256"]) for r in found)
        assert got == Counter((d, e) for d, e, _ in brute_rows(ordered))
        assert len(found) == len(rows) and sum(r["near_next"] == 1.0 for r in found) >= sum(same for _, _, same in brute_rows(ordered))
