import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from eventlake.llm import langid, pii
from eventlake.llm.queries import WORD_TOKENIZER, tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The rows after each stage, each written and read again."""
    from eventlake.llm.common import spill

    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = spill(stage(spark, docs, sf), f"test-{name}")
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_and_columns(stages, docs):
    assert list(stages) == ["language", "quality", "near_duplicates", "personal_data", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name].columns == docs.columns and dict(stages[name].dtypes) == dict(docs.dtypes)


def test_filters_keep_clean_documents(stages, docs, spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    after = by_id(stages["language"])
    gone = set(by_id(docs)) - set(after)
    assert len(gone) <= 0.02 * docs.count()
    good = [d for d in after if labels.get(d) == 1]
    kept = by_id(stages["quality"])
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    bad = [d for d in after if labels.get(d) == 0]
    assert sum(d not in kept for d in bad) >= 0.8 * len(bad)


def test_one_of_each_group_stays(stages):
    from .test_neardup import brute_components, brute_fingerprint

    before = by_id(stages["quality"])
    ids = sorted(before)
    want = brute_components(ids, [brute_fingerprint(before[i]["text"]) for i in ids])
    assert set(by_id(stages["near_duplicates"])) == {i for i in ids if want[i] == i}


def test_personal_data_is_masked(stages):
    before, after = by_id(stages["near_duplicates"]), by_id(stages["personal_data"])
    assert set(before) == set(after)
    for d, r in after.items():
        assert r["text"] == pii.masked(before[d]["text"], pii.base_spans(before[d]["text"])) and r["n_chars"] == len(r["text"])
        assert not [s for s in pii.base_spans(r["text"]) if s[1] != 2]


def test_packing(stages, spark, sf):
    texts = {d: r["text"] for d, r in by_id(stages["personal_data"]).items()}
    tokenizer = Tokenizer.from_file(tokenizer_path(WORD_TOKENIZER))
    rows = stages["packing"].collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        ids = np.array([*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
    assert corpus_pipeline.run(spark, sf).count() == len(rows)


def test_odd_rows(spark, odd_docs, no_docs, sf):
    for table in (odd_docs, no_docs):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == table.columns
        out = corpus_pipeline.packed(spark, docs, sf)
        assert out.count() >= docs.count()
    und = corpus_pipeline.language(spark, odd_docs, sf).collect()
    assert all(langid.has_letter(r["text"]) for r in und)
