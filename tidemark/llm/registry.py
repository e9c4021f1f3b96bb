"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, language_model, license_scan, lines, passages, pii, quality, simhash, token_files
from .common import table
from .oracles import OP2, OP10

#: Where the public vocabularies are; they are read, never copied.
RANKS = os.environ.get("TIDEMARK_RANKS") or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = os.environ.get("TIDEMARK_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.report(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_line_dedup, op3_byte_bpe, op4_language_model, op5_token_files, op6_pii, op7_passages, op8_license_scan, op9_simhash, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    """The others are tested against brute force, round trips and held-out text."""
    return {"op2_line_dedup": OP2, "op10_quality_rules": OP10}
