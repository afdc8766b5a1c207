"""Registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from murmuration.llm import decontam, fixity, langid, linededup, lm, manifest, mixing, neardup, phrases, quality, simhash, tokens, toxicity
from murmuration.sources.tables import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@_register("op3_quality_rules", quality.OP3_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op3(read_table(spark, sf_dir, "documents"))


@_register("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.op2(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_register("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op8(read_table(spark, sf_dir, "documents"))


@_register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op10(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@_register("op4_decontamination", decontam.OP4_SQL)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op4(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@_register("op6_weighted_mixing", mixing.OP6_SQL)
def op6_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6(read_table(spark, sf_dir, "documents"))


@_register("op7_merkle_fixity", fixity.OP7_SQL)
def op7_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.op7(read_table(spark, sf_dir, "pages"))


@_register("op9_near_duplicates", neardup.OP9_SQL)
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op9(read_table(spark, sf_dir, "documents"))


@_register("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.op5(read_table(spark, sf_dir, "documents"))


@_register("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op1(read_table(spark, sf_dir, "documents"))


@_register("op11_dataset_manifest", manifest.OP11_SQL)
def op11_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof digest of every document, and whether it still folds to the root."""
    return manifest.op11(read_table(spark, sf_dir, "documents"))


@_register("op13_simhash_duplicates", simhash.OP13_SQL)
def op13_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest id that its links reach."""
    return simhash.op13(read_table(spark, sf_dir, "documents"))


@_register("op12_phrase_collocations", phrases.OP12_SQL)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to four words of every language of the documents."""
    return phrases.op12(read_table(spark, sf_dir, "documents"))
