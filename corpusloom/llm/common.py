"""Shared helpers: reading tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import ship
from corpusloom.sources.scratch import delete, new_folder

#: A side of a join is broadcast up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive a lost executor and go with the process."""

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark, self.root = spark, new_folder(spark, label)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")


def row_key(docs: DataFrame) -> Column:
    """128 bits that tell rows of ``docs`` by doc_id and text, nulls included; repeated rows share them."""
    i, t = docs["doc_id"].cast("string"), docs["text"]
    part = lambda x: F.when(x.isNull(), F.lit("n")).otherwise(F.concat(F.length(x).cast("string"), F.lit(":"), x))
    return F.unhex(F.md5(F.concat(part(i), part(t)).cast("binary")))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if its rows, measured, fit the limit, else leave it to shuffle."""
    fixed = 16 + sum(16 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else 8 for f in df.schema)
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in df.schema):
        sizes = [F.octet_length(F.to_json(F.struct(*df.columns)))]
    else:
        sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    held = df.agg(F.sum(sum(sizes, F.lit(fixed).cast("bigint")))).first()[0] or 0
    return F.broadcast(df) if held <= limit else df


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Partitions that grow with the rows, and never fewer than the session's own."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))
