"""Registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import brown_lm, chat_trees, decontam, exact_dedup, langid, license_scan, mixing, simhash_dedup, substring_dedup, token_lengths
from corpusloom.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op4_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_trees.chat_trees(table(spark, sf_dir, "conversations"))


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.brown_lm(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.groups(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op9_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.token_lengths(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat_trees": op4_chat_trees,
    "op5_brown_lm": op5_brown_lm,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_language_id": op8_language_id,
    "op9_token_lengths": op9_token_lengths,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op4_chat_trees": chat_trees.ORACLE,
    "op3_exact_dedup": """
SELECT DISTINCT doc_id, keep_id, copies_of_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text, doc_id) AS copies_of_id, count(*) OVER (PARTITION BY text) AS n
  FROM documents WHERE text IS NOT NULL) WHERE n > 1
""",
}
