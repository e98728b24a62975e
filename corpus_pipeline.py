"""The training-data pipeline: five operators in turn, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns rows with the columns of `documents`; the last returns pieces of
packed sequences. run() writes each stage's rows as Parquet in the shared folder and reads them again, so a lost
executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import near_dups, packing, queries, repeats, secrets, toxicity
from corpusmill.llm.common import materialize, table


def counted(docs: DataFrame, before: DataFrame) -> DataFrame:
    """docs with n_chars, where there is one, as the length of the text that is left."""
    if "n_chars" not in before.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType)).select(*before.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain flags go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), queries.CHAIN))


def drop_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id."""
    return near_dups.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that occur elsewhere go; documents stay, if only with an empty text."""
    return counted(repeats.remove(docs), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return counted(secrets.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), special=queries.SPECIAL)


STAGES = [("toxicity", drop_toxic), ("near_dups", drop_near_dups), ("repeats", cut_repeats), ("secrets", mask_secrets), ("packing", pack)]

#: A trained classifier and a tokenizer are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
