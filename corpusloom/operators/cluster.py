"""Duplicate clusters: connected components whose representative comes first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.scratch import delete, new_folder


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id that an edge touches, root the least id of its component.

    Large-star and small-star rounds (Kiveris et al. 2014), each written to the
    shared folder, until no edge changes.  Edges with a null end are left out;
    loops give a component of their own; repeated edges change nothing.
    """
    spark = edges.sparkSession
    root = new_folder(spark, "components")

    def _save(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    raw = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    e = _save(raw.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "0")
    all_ids = e.select(F.explode(F.array("u", "v")).alias("id")).distinct()  # table 0 stays
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now, step = mark(e), 0
    while now[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("s"))
        step += 1
        e = _save(small.select("s.*").where("u <> v").distinct(), str(step))
        if step > 1:
            delete(spark, f"{root}/{step - 1}")
        was, now = now, mark(e)
        if was == now:
            break
    return all_ids.join(e.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def clusters(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(rep, members): every cluster of (id, seq), singletons included; members by insertion, the first is rep.

    An id inserted more than once counts from its first time.
    """
    first = ids.where("id IS NOT NULL").groupBy("id").agg(F.min("seq").alias("seq"))
    roots = connected_components(edges)
    named = first.join(roots, "id", "left").select("id", "seq", F.coalesce("root", "id").alias("root"))
    held = named.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("m"))
    return held.select(F.col("m")[0]["id"].alias("rep"), F.transform("m", lambda x: x["id"]).alias("members"))


def find(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, rep, known): an id that no cluster has gives null and false."""
    asked = ids.select("id").distinct()
    return asked.join(labels.select("id", "rep"), "id", "left").select("id", "rep", F.col("rep").isNotNull().alias("known"))


def same(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, same): whether both are known and in one cluster."""
    a, b = labels.select(F.col("id").alias("a"), F.col("rep").alias("_x")), labels.select(F.col("id").alias("b"), F.col("rep").alias("_y"))
    return pairs.select("a", "b").join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce(F.col("_x") == F.col("_y"), F.lit(False)).alias("same"))
