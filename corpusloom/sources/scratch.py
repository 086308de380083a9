"""The shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Folders made by this process, by application; they go when it ends, or with :func:`clean`.
_MADE: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder for written tables, which is removed at the end of the process if its application still runs."""
    made = _MADE.get(spark.sparkContext.applicationId)
    if made is None:
        made = _MADE[spark.sparkContext.applicationId] = []
        atexit.register(_clean, spark)
    made.append(f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return made[-1]


def delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def clean(spark: SparkSession) -> None:
    """Remove every folder made so far; DataFrames that read them no longer work."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def _clean(spark: SparkSession) -> None:
    if SparkContext._active_spark_context is not None and spark.sparkContext._jsc is not None:
        clean(spark)


def written(df: DataFrame, label: str) -> DataFrame:
    """The DataFrame as a table in the shared folder: worked out once, without lineage, whatever executors are lost."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
