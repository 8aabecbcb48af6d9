"""A cleaning and tokenising pipeline over ``documents``.

Stages, in order: documents judged toxic go; of each group of near duplicates one document stays; passages of
35 words and more that repeat anywhere are taken out of the texts; sources are mixed to target weights, which
repeats or drops whole documents; the mix is encoded. Every stage reads what its predecessor wrote.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stringloom.llm import bpe, chosenpath, mixing, substring, toxicity
from stringloom.session import drop_folder, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, trained on all labels, does not reject; null and empty texts stay."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the one with the smallest id; rows without an id join classes too, and rows
    without words all stay."""
    return chosenpath.keep_one(docs, nameless=True)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with passages that stand more than once taken out of the texts; a text may end empty."""
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the mix of sources takes them, 0 to 3 times; a row without words as its place in the mix falls."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # a trained model decides the first stage; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder as Parquet and read again, and goes once
    its successor is written. Empty tables pass through all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for before, (name, stage) in zip([None, *(n for n, _ in STAGES)], STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop_folder(f"{folder}/{before}")
    return docs
