"""The thin queries of the operators over the shared tables, and SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm import fingerprints, langid, media, neardup, packing, pieces, pii, quality, sharding, urls
from eventlake.llm.common import table

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))


def site_of_source() -> tuple:
    """Host and path of a document: its source, and the part of it in one language, as in the pages' URLs."""
    return F.col("source"), F.concat_ws("/", "source", "lang")


def op3_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), *site_of_source())


def op4_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs.withColumn("held_out", langid.held_out()), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op5_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op6_segment_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.encode(table(spark, sf_dir, "documents")))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path(PIECE_MODEL)
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


QUERIES = {f.__name__: f for f in (op1_improbable_features, op2_bootstrapped_pii, op3_hierarchical_quality, op4_output_codes, op5_url_trees, op6_segment_popcount, op7_audio_features, op8_sampled_pieces, op9_power_of_two_packing, op10_virtual_slots)}
ORACLE_SQL: dict[str, str] = {}
