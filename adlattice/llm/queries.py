"""The training-data queries over the given tables, with DuckDB oracles where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from adlattice.llm import anchors, dedup, infill, langid, lengths, maintext, mixing, ngrams, packing, pii, quality, twofit, urls

#: Fixed value: how the byte-level vocabulary cuts a text before merging.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op5_exact_dedup", dedup.oracle())
def op5(spark, folder):
    return dedup.exact_duplicates(table(spark, folder, "documents"))


@query("op7_mix_sources", mixing.ORACLE)
def op7(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


@query("op8_pack")
def op8(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_language_id")
def op10(spark, folder):
    return langid.identify(table(spark, folder, "documents"))


@query("op4_ngram_jaccard", ngrams.ORACLE)
def op4(spark, folder):
    return ngrams.jaccard_components(table(spark, folder, "documents"))


@query("op9_quality_rules")
def op9(spark, folder):
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_token_counts")
def op2(spark, folder):
    return lengths.histogram(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), BYTE_PATTERN)


@query("op3_url_rules", urls.ORACLE)
def op3(spark, folder):
    return urls.judge(table(spark, folder, "pages"), urls.rule_table(spark))


@query("op6_main_text")
def op6(spark, folder):
    return maintext.extract(table(spark, folder, "pages"))


@query("op1_pii")
def op1(spark, folder):
    return pii.find(table(spark, folder, "documents"))


@query("op11_fill_in_middle", infill.ORACLE)
def op11(spark, folder):
    return infill.digests(table(spark, folder, "documents"))


@query("op12_best_two_fit")
def op12(spark, folder):
    return twofit.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), BYTE_PATTERN)


@query("op13_code_compression", anchors.ORACLE)
def op13(spark, folder):
    return anchors.compress(table(spark, folder, "embeddings"))


@query("pipeline")
def pipeline(spark, folder):
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)
