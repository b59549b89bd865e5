"""The corpus pipeline: classify, drop near copies, decontaminate, replace personal data, encode.

Each stage takes the documents that its predecessor kept, as a table that was written and read again, so that no
stage computes another one twice and a lost executor costs at most the stage at hand. Texts are read whole, however
long; an empty table goes through as one; columns beside those of documents, whatever their names, are carried to the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bpe_chunks, decontaminate, minhash_dedup, pii_surrogates, quality
from emberlog.llm.queries import pattern, tokenizer
from emberlog.llm.shared import fresh, table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject; it learns from labelled rows that aren't held out.

    Null and empty texts are judged like any text without words; repeated rows go or stay together.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep_good(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 or more hold together.

    Five words and 0.8 are what near-duplicate stages take where no contract says otherwise. Texts without words are
    no copies and all stay; of repeated rows one stays.
    """
    return minhash_dedup.keep_one(docs, words=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents into which no benchmark item leaks. Null and empty texts stay; an empty benchmark drops nothing."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the new text. Null texts stay null."""
    (found,) = fresh(docs, "_entities")
    out = pii_surrogates.replaced(docs, entities=found)
    return out.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the bytes that they decode to; a null text has none."""
    return bpe_chunks.digests(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), pattern())


STAGES = [("quality", good), ("near_dedup", distinct), ("decontaminate", clean), ("pii", private), ("bpe", encoded)]

#: A trained model and random walks have no counterpart in SQL; the stages are tested by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
