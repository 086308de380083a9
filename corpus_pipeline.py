"""Corpus pipeline: five stages from raw documents to a training order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the documents are written as Parquet and read again, so that a stage works on
exactly what the one before it kept and no lineage outlives it.

All stages read doc_id, text, lang and source alone and pass other columns on,
whatever their names, but for the last, whose columns are its own.  An empty
table gives an empty one everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontam, exact_dedup, langid, mixing, simhash_dedup
from corpusloom.llm.common import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go.

    Null and empty texts and texts without a letter go; without any label every
    text with a letter stays.  Repeated rows go or stay together; a null doc_id
    or lang changes nothing.
    """
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, the one with the least doc_id.

    A null doc_id is kept only where all are null; of rows that repeat doc_id and
    text one stays, of ties in doc_id alone there is none to settle.  Null texts
    all stay, empty ones are one text.
    """
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id.

    Rows are told by doc_id and text; ties in doc_id are settled by a hash of the
    row, null ids come last, of repeated rows one stays.  Null texts and texts
    without a letter or digit are near nothing and all stay.
    """
    return simhash_dedup.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go.

    Items of fewer than five words remove nothing.  Rows are told by doc_id and
    text: a null or shared id neither keeps nor removes another row.  Null and
    empty texts stay; repeated rows go or stay together.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: every document at its positions, under the curriculum's weights.

    A null source is a source of its own; null and empty texts take no tokens and
    stand where the next document does; repeated rows are documents of their own;
    ties in position are in order of source, doc_id and epoch.
    """
    return mixing.plan(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("mixing", mix),
]

#: A trained network decides in the first stage, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
