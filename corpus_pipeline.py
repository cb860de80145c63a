"""The corpus pipeline: five stages over the table of documents, each written as Parquet and read again as the next one's input.

language: documents without a language that can be told (no letter, or two codewords equally near) go.
quality: documents whose quality, given their text and site, is below one half go.
near_duplicates: of each group of near-duplicates one document stays, and of rows that repeat whole one.
personal_data: personal data in texts are masked.
packing: documents are packed in sequences of tokens; a row for each piece.

Every stage but the last returns the columns of documents. A stage keeps rows whose columns are null where its decision does not
need them, and returns no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm import langid, neardup, packing, pii, quality
from eventlake.llm.common import discard, settled, table
from eventlake.llm.queries import WORD_TOKENIZER, site_of_source, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, langid.fit(docs), prefix="__")
    return found.where(~F.col("__ambiguous") & (F.col("__lang_pred") != langid.UNKNOWN)).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), *site_of_source())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    length = F.char_length("text").cast(dict(docs.dtypes)["n_chars"])
    return pii.mask(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(WORD_TOKENIZER))


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: No stage can be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage spilled, and what it read, is deleted once its rows are written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)
        before = [docs]
    return docs
