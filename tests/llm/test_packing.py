import gc
import unicodedata
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventlake.llm import common, packing
from eventlake.llm.queries import WORD_TOKENIZER, tokenizer_path

PATH = tokenizer_path(WORD_TOKENIZER)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers(tokenizer, texts):
    odd = ["don't STOP!!'s we'LL", "it's. \u0130stanbul \u00c5NGSTR\u00d6M x\u0301y e\u0301 a\u00a0b\x1cc <|endoftext|> <|ENDOFTEXT|>, ##a##b'' 'll 'S", "", "   ", "\u65e5\u672c\u8a9e \ufb01 \u00b2\u00bd \u01c5 \u017f \u212a",
           "x" * 5000 + "!!", "a'.b' c'','d e-f_g 12.5,6;", "a\u200db \ufdfd \u00df SS \u1e9e", "\u0391\u03a3 \u03c3\u03c2", "<|startoftext|>x<| y |>", "\u00aa\u00ba \u00b5 \u00b9\u00bc"]
    known = packing.Words(PATH)
    for t in [*odd, *texts.values()]:
        assert np.frombuffer(known.encode([t])[0], "<u4").tolist() == ids_of(tokenizer, t), t


def test_ids_of_every_character(tokenizer):
    """Every assigned character alone, between letters, and beside digits, marks and an apostrophe."""
    known = packing.Words(PATH)
    found = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Co", "Cs")]
    for at in range(0, len(found), 20_000):
        texts = [t for c in found[at : at + 20_000] for t in (c, f"a{c}b", f"1{c}, {c}'s")]
        want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [t for t, a, b in zip(texts, known.encode(texts), want, strict=True) if a != b] == []


_known = packing.Words(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "'s", "'LL", "7", " ", "\n", "<|", "|>", "\u0181", "\u0130", "\u1e9e", "\u212a", "\u0301", "\u00df", "endoftext", "\u4e2d", ".", "\u00a0", "\u023a"]) | st.characters(codec="utf-8"), max_size=30).map("".join))
def test_ids_of_mixed_texts(text):
    assert np.frombuffer(_known.encode([text])[0], "<u4").tolist() == ids_of(_known.tokenizer, text)


def test_the_table_is_bounded(monkeypatch, tokenizer, texts):
    monkeypatch.setattr(packing, "WORDS", 50)
    known = packing.Words(PATH)
    for t in list(texts.values())[:20]:
        assert np.frombuffer(known.encode([t])[0], "<u4").tolist() == ids_of(tokenizer, t)
        assert len(known) <= 50


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000, 4096])
def test_cuts(n):
    found = packing.cuts(n)
    assert [s for s, _ in found] == np.cumsum([0, *(k for _, k in found[:-1])]).tolist() and sum(k for _, k in found) == n
    assert all(k & (k - 1) == 0 and k <= 2048 for _, k in found) and [k for _, k in found].count(2048) == n // 2048
    rest = [k for _, k in found if k < 2048]
    assert len(set(rest)) == len(rest)


def test_query_matches_brute_force(spark, sf, texts, tokenizer):
    from eventlake.llm.queries import op9_power_of_two_packing

    rows = op9_power_of_two_packing(spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for doc, text in texts.items():
        ids = [*ids_of(tokenizer, text), 1]
        at = 0
        for r in sorted(by[doc], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["offset"]) == (at, len(ids), 0)
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.tobytes())
            assert r["length"] & (r["length"] - 1) == 0  # a power of two needs no padding
            at += r["length"]
        assert at == len(ids)
    order = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["sequence_id"] for r in order] == list(range(len(rows)))
    assert all(a["length"] >= b["length"] for a, b in zip(order, order[1:], strict=False))


def test_ids_come_along(spark, docs, texts, tokenizer):
    found = packing.pieces(docs.limit(5), PATH, with_ids=True).collect()
    for doc in {r["doc_id"] for r in found}:
        joined = [i for r in sorted((r for r in found if r["doc_id"] == doc), key=lambda r: r["start"]) for i in r["ids"]]
        assert joined == [*ids_of(tokenizer, texts[doc]), 1]


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs, PATH).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert [(r["start"], r["length"]) for r in rows if r["doc_id"] == 1] == [(0, 1)]
    assert sum(r["start"] == 0 for r in rows) == odd_docs.count()
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 5)
    assert packing.pack(no_docs, PATH).collect() == []


def test_repeated_rows_are_numbered_apart(spark):
    docs = spark.createDataFrame([(7, "the same words")] * 3000 + [(8, None)] * 50, "doc_id long, text string")
    found = packing.spill(packing.pieces(docs, PATH), "test-pieces")
    assert found.groupBy("length", "salt").count().agg({"count": "max"}).first()[0] <= 40
    ids = [r["sequence_id"] for r in packing.number(found).collect()]
    assert sorted(ids) == list(range(found.count()))


def test_a_workers_table_goes_once_it_does_other_work():
    texts = pa.RecordBatch.from_pydict({"text": ["a b", None, "c"]})
    table = weakref.ref(packing.words(PATH))
    assert packing.words(PATH) is table()  # kept from task to task
    assert sum(b.num_rows for b in common.slices(iter([texts]))) == 3  # as any other operator reads its rows
    gc.collect()
    assert table() is None
    again = packing.words(PATH)
    assert sum(b.num_rows for b in common.slices(iter([texts]), keep=again)) == 3 and packing.words(PATH) is again
