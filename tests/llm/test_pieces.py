from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from eventlake.llm import pieces
from eventlake.llm.queries import PIECE_MODEL, tokenizer_path

MODEL = tokenizer_path(PIECE_MODEL)


@pytest.fixture(scope="module")
def known():
    return pieces.Lattices(MODEL)


@pytest.fixture(scope="module")
def vocabulary(known):
    return {p: (int(known.ids[k]), float(np.exp(known.log_weight[k]))) for k, p in enumerate(known.pieces)}


def text_of(ids):
    return pieces.Pieces(MODEL).join(np.asarray(ids))[0].decode()[1:]


def test_lossless(known, texts):
    odd = ["", "a", " a", "  a  b ", "a\u2581b \u2581\u2581 c", "\u65e5\u672c\n\t x\x00", "e\u0301 \u00df\r\n", "x" * 3000, "\U0001f642 ok\U0010ffff\U0010fffe", "\x01", " ", "\u2581"]
    for t in [*odd, *texts.values()]:
        ids = known.sample([t], ["key"])[0]
        assert text_of(ids) == t if t else len(ids) == 0


def all_paths(text, vocabulary):
    if not text:
        yield (), 1.0
    for j in range(1, len(text) + 1):
        if text[:j] in vocabulary:
            i, w = vocabulary[text[:j]]
            for rest, v in all_paths(text[j:], vocabulary):
                yield (i, *rest), w * v


def test_samples_follow_the_lattice(known, vocabulary):
    n = 20_000
    for word in ("then", "aaa"):
        paths = dict(all_paths("\u2581" + word, vocabulary))
        total = sum(paths.values())
        got = Counter(tuple(x.tolist()) for x in known.sample([word] * n, [str(i) for i in range(n)]))
        assert set(got) <= set(paths)
        for path, w in paths.items():
            p = w / total
            assert abs(got[path] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_long_segments_and_few_match(known):
    # the same random numbers lead to the same path, whether segments are walked together or alone
    texts, keys = ["therefore nothing " * 3, "abcdefghij" * 40] * 20, [str(i) for i in range(40)]
    together = known.sample(texts, keys)
    for t, k, x in zip(texts, keys, together, strict=True):
        assert np.array_equal(known.sample([t], [k])[0], x)


def test_samples_dont_depend_on_the_table(texts):
    some = sorted(texts)[:30]
    a, b = pieces.Lattices(MODEL), pieces.Lattices(MODEL)
    b.sample(list(texts.values())[100:], ["x"] * (len(texts) - 100))
    b.marks.append(b.marks[0])
    x = a.sample([texts[i] for i in some], [str(i) for i in some])
    b.forget()
    y = [b.sample([texts[i]], [str(i)])[0] for i in reversed(some)][::-1]
    assert all(np.array_equal(p, q) for p, q in zip(x, y, strict=True))
    other = a.sample([texts[i] for i in some], [str(i) for i in some], seed=1)
    assert any(not np.array_equal(p, q) for p, q in zip(x, other, strict=True))


def test_pieces_cross_no_border(known, vocabulary):
    for p in vocabulary:
        body = p.lstrip("\u2581")
        assert "\u2581" not in body
    text = " one, two;3 four  five\n"
    parts = known.segments(text)
    assert "".join(parts) == " " + text
    for a, b in pairwise(parts):
        assert not any(p.startswith("\u2581") is False and a[-1] + b[0] in p for p in vocabulary)


def test_query(spark, sf, texts):
    import hashlib

    from eventlake.llm.queries import op8_sampled_pieces

    rows = op8_sampled_pieces(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["n_ids"] == len(r["ids"]) and text_of(r["ids"]) == texts[r["doc_id"]]
    assert {r["doc_id"]: r["ids"] for r in rows} == {r["doc_id"]: r["ids"] for r in op8_sampled_pieces(spark, sf).collect()}


def test_odd_rows(odd_docs, no_docs):
    found = pieces.decode(pieces.encode(odd_docs, MODEL), MODEL).collect()
    want = Counter((r["doc_id"], r["text"]) for r in odd_docs.collect())
    assert Counter((r["doc_id"], r["decoded"]) for r in found) == want
    assert all((r["ids"] is None) == (r["decoded"] is None) for r in found)
    assert len({tuple(r["ids"]) for r in found if r["doc_id"] == 5}) == 1
    assert pieces.decode(pieces.encode(no_docs, MODEL), MODEL).collect() == []
