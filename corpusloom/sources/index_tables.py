"""Indexes as stored tables: written once, queried by any later job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_bands(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A band table by band, so that a query of some bands reads those alone; keys are sorted within files for their statistics."""
    index.repartition("band", "key").sortWithinPartitions("band", "key").write.mode(mode).partitionBy("band").parquet(path)


def write_postings(fingerprints: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A fingerprint table ranged by hash, so that a lookup skips the row groups without it."""
    fingerprints.repartitionByRange("hash").sortWithinPartitions("hash").write.mode(mode).parquet(path)


def write_bucketed(index: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by its key: joins of two such tables on it need no shuffle."""
    index.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ids(index: DataFrame) -> DataFrame:
    """(id): every id of an index once."""
    return index.select("id").distinct()
