"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, source mixing, packing.

Each stage reads what its predecessor wrote; all but the last return the columns of ``documents``.
"""
from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from adlattice.llm import dedup, langid, mixing, ngrams, packing
from adlattice.session import MADE, clear, shared_folder

BATCH_BYTES = 8 << 20


def stage(first: bool = False):
    """What a stage's predecessor has left behind goes when the stage begins, as the predecessor's result is written by then.

    Arrow batches take 8 MB instead of 64: the stages' Python workers and the JVM beside them share an executor's memory.
    """
    def wrap(function):
        @functools.wraps(function)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if first:
                _FROM[0] = len(MADE)
            clear(spark, _FROM[0])
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
            return function(spark, docs, sf_dir)
        return run_stage
    return wrap


#: How many intermediate results there were when the pipeline began; those of others stay.
_FROM = [0]


@stage(first=True)
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language stays open, go."""
    return langid.keep_identified(docs)


@stage()
def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.drop_duplicates(docs)


@stage()
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngrams.drop_near_duplicates(docs)


@stage()
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's row as often as the mix takes it."""
    return mixing.repeat(docs)


@stage()
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("copies", copies), ("near_copies", near_copies), ("mixture", mixture), ("sequences", sequences)]

#: Tokens and trained scores are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
