"""Sketches that grow with a stream, and deduplication of each batch against those before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions import columns as C
from corpusloom.functions import kernels as K
from corpusloom.functions import udfs as U
from corpusloom.operators import lsh, sketches
from corpusloom.operators.streams import SpaceSaving


def hll_stream(stream: DataFrame, keys: list[str], value: str, p: int = 14) -> DataFrame:
    """Registers of a stream (output mode ``update`` or ``complete``): the batch aggregation as it stands."""
    return sketches.hll_registers(stream, keys, value, p)


def minhash_union_stream(stream: DataFrame, keys: list[str], sig: str = "sig") -> DataFrame:
    """(keys, slot, v): least value of each slot so far, as its unsigned order (see columns.unsigned)."""
    slots = stream.select(*keys, F.posexplode(sig).alias("slot", "_v"))
    return slots.groupBy(*keys, "slot").agg(F.min(C.unsigned(F.col("_v"))).alias("v"))


def space_saving_stream(stream: DataFrame, key: str, item: str, order: list[str], capacity: int) -> DataFrame:
    """(key, item, count, err, total, version) of a stream (output mode ``update``): all counters of every group that a micro-batch touched.

    Rows of a micro-batch are taken by ``order``, micro-batches as they come; of
    a group's rows those with the greatest ``version`` hold.  Items are strings;
    null items are ignored.
    """
    SpaceSaving(capacity)
    rows = stream.where(F.col(item).isNotNull()).select(key, F.col(item).cast("string").alias("_item"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    kind = stream.schema[key]

    def step(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, version = SpaceSaving(capacity), 0
        if state.exists:
            items, counts, errs, seqs, s.n, s.seq, version = state.get
            s.load(zip(items, counts, errs, seqs, strict=True))
        for x in pd.concat(list(pdfs)).sort_values([f"_o{i}" for i in range(len(order))], kind="stable")["_item"]:
            s.add(x)
        held = list(s.held.items())
        state.update(([i for i, _ in held], [v[0] for _, v in held], [v[2] for _, v in held], [v[1] for _, v in held], s.n, s.seq, version + 1))
        yield pd.DataFrame([(group[0], i, c, e, s.n, version + 1) for i, c, e in s.top()], columns=[key, "item", "count", "err", "total", "version"])

    longs = T.ArrayType(T.LongType())
    out = T.StructType([kind, T.StructField("item", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("count", "err", "total", "version"))])
    kept = T.StructType([T.StructField("items", T.ArrayType(T.StringType())), *(T.StructField(c, longs) for c in ("counts", "errs", "seqs")), *(T.StructField(c, T.LongType()) for c in ("n", "seq", "version"))])
    return rows.groupBy(key).applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)


def reservoir_stream(stream: DataFrame, key: str, item: str, order: list[str], k: int, seed: int) -> DataFrame:
    """(key, slot, item, n, version) of a stream (output mode ``update``): the sample of every group that a micro-batch touched.

    As :func:`corpusloom.operators.streams.reservoir` over the rows so far, taken
    by ``order`` within a micro-batch and micro-batches as they come; items are strings.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    rows = stream.select(key, F.col(item).cast("string").alias("_item"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])

    def step(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, n, version = state.get if state.exists else ([], 0, 0)
        items = list(items)
        new = pd.concat(list(pdfs)).sort_values([f"_o{i}" for i in range(len(order))], kind="stable")["_item"].tolist()
        number = np.arange(n + 1, n + 1 + len(new), dtype=np.uint64)
        draws = K.finalize(np.uint64(seed & K.MASK) + (np.maximum(number, np.uint64(k)) - np.uint64(k)) * np.uint64(K.GAMMA))
        for x, at, d in zip(new, number.tolist(), draws.tolist(), strict=True):
            if at <= k:
                items.append(x)
            elif (slot := d * at >> 64) < k:
                items[slot] = x
        state.update((items, n + len(new), version + 1))
        yield pd.DataFrame({key: [group[0]] * len(items), "slot": range(len(items)), "item": items, "n": n + len(new), "version": version + 1})

    out = T.StructType([stream.schema[key], T.StructField("slot", T.LongType()), T.StructField("item", T.StringType()), T.StructField("n", T.LongType()), T.StructField("version", T.LongType())])
    return rows.groupBy(key).applyInPandasWithState(step, out, "items array<string>, n bigint, version bigint", "update", GroupStateTimeout.NoTimeout)


def dedup_batches(path: str, least: float = 0.5, w: int = 3, k: int = 128, bands: int = 16, rows: int = 8) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for (id, seq, text): writes under ``path`` signatures, bands, and the pairs (id, earlier,
    similarity) of each batch with documents of lower seq in it or before it.

    A batch that is run again overwrites its own folders.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = lambda t: f"{path}/{t}/batch={number}"
        batch.where("id IS NOT NULL").select("id", "seq", U.sketch(F.col("text"), w, k).alias("sig")).write.mode("overwrite").parquet(part("sigs"))
        new = spark.read.parquet(part("sigs"))
        lsh.band_table(new, bands, rows).write.mode("overwrite").parquet(part("bands"))
        upto = F.col("batch") <= number
        index, sigs = spark.read.parquet(f"{path}/bands").where(upto), spark.read.parquet(f"{path}/sigs").where(upto)
        asked = spark.read.parquet(part("bands")).select("band", "key", F.col("id").alias("q"), F.col("seq").alias("qseq"))
        pairs = asked.join(index, ["band", "key"]).where("seq < qseq").select("q", "id").distinct()
        a, b = new.select(F.col("id").alias("q"), F.col("sig").alias("x")), sigs.select("id", F.col("sig").alias("y"))
        out = pairs.join(a, "q").join(b, "id").select(F.col("q").alias("id"), F.col("id").alias("earlier"), C.jaccard(F.col("x"), F.col("y")).alias("similarity"))
        out.where(F.col("similarity") >= least).write.mode("overwrite").parquet(part("pairs"))

    return run
