import zlib

import numpy as np
from pyspark.sql import functions as F

from eventlake.llm import langid


def test_codes_correct_errors():
    for k in range(2, 12):
        m = langid.code(k)
        assert set(np.unique(m)) == {-1, 1} and len({tuple(r) for r in m}) == k
        d = min((m[i] != m[j]).sum() for i in range(k) for j in range(i))
        assert d >= {2: 1, 3: 2}.get(k, 4)
    assert langid.code(1).shape == (1, 0) and langid.code(0).shape == (0, 0)


def test_counts_match_brute_force(spark):
    df = spark.createDataFrame([("Ab c", "x"), ("d\u00e9", "x"), ("zz", "y"), (None, "y"), ("q", None)], "text string, lang string")
    got = langid.trigram_counts(df)
    assert set(got) == {"x", "y"}
    for lang, texts in (("x", ["Ab c", "d\u00e9"]), ("y", ["zz"])):
        want = np.zeros(langid.CELLS)
        for t in texts:
            raw = b"  " + bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in t.lower().encode()) + b"   "
            for i in range(len(t.encode()) + 3):
                a, b, c = raw[i], raw[i + 1], raw[i + 2]
                h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
                h = ((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32
                want[h >> 17] += 1
        assert np.array_equal(got[lang], want)


def test_held_out_accuracy(spark):
    from eventlake.llm.queries import op4_output_codes

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op4_output_codes(spark, sf).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98


def test_labels_and_ids_are_no_inputs(spark, docs):
    model = langid.fit(docs)
    a = langid.identify(docs, model, keep=["doc_id"])
    b = langid.identify(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")), model, keep=["doc_id"])
    assert sorted(a.collect()) == sorted(b.collect())


def test_texts_without_letters():
    for t in (None, "", "123 .,! \u00b2", "\u0661"):
        assert not langid.has_letter(t)
    for t in ("a", "1\u00e9", "\u65e5", "12 \u03b1"):
        assert langid.has_letter(t)


def test_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs.where(~langid.held_out()))
    out = langid.identify(odd_docs, model, prefix="__")
    assert out.columns == [*odd_docs.columns, "__lang_pred", "__score", "__ambiguous"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r["__lang_pred"] == "und") == (not langid.has_letter(r["text"]))
    equal = {(r["__lang_pred"], r["__score"]) for r in rows if r["text"] and r["text"].startswith("Guten")}
    assert len(equal) == 1
    assert langid.identify(no_docs, model, prefix="__").collect() == []
    nothing = langid.fit(no_docs)
    assert {r["__lang_pred"] for r in langid.identify(odd_docs, nothing, prefix="__").collect()} == {"und"}
    one = langid.fit(odd_docs.where("lang = 'de'"))
    assert {r["__lang_pred"] for r in langid.identify(odd_docs.where("doc_id = 3"), one, prefix="__").collect()} == {"de"}


def test_long_texts_are_read_in_blocks(texts):
    rng = np.random.default_rng(1)
    counts = {x: rng.integers(1, 50, langid.CELLS) for x in ("a", "b", "c")}
    model = langid.Codewords(counts)
    held = " ".join(texts.values())
    long = (held * (1 + 3 * langid.LONG // len(held)))[: 2 * langid.LONG + 77]
    assert np.array_equal(np.concatenate([*langid.cell_blocks(long)]), langid.trigram_cells([long])[0])
    cells, _ = langid.trigram_cells([long])
    best, score, unclear = model.decode(["one", long, "two"])
    alone = [model.decode([t]) for t in ("one", long, "two")]
    assert [x[0][0] for x in alone] == best.tolist() and [x[1][0] for x in alone] == score.tolist()
    margin = np.clip(np.array([w[cells].astype(float).sum() for w in model.weights]) / np.sqrt(len(cells)), -8, 8)
    loss = np.log1p(np.exp(-margin * model.code)) @ model.trust
    assert best[1] == loss.argmin() and abs(score[1] - 1 / np.exp(-(loss - loss.min()) * 4).sum()) < 1e-9


def test_languages_are_bounded(spark):
    df = spark.createDataFrame([(f"text {i}", f"l{min(i, 40)}") for i in range(60)], "text string, lang string")
    assert set(langid.trigram_counts(df, most=3)) == {"l40", "l0", "l1"}
