"""Order-dependent sketches: SpaceSaving heavy hitters and reservoir samples."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import kernels as K
from corpusloom.sources.scratch import written


class SpaceSaving:
    """At most ``capacity`` counters; a newcomer takes over the least, oldest one and inherits its count as error."""

    def __init__(self, capacity: int):
        if capacity <= 0:
            raise ValueError("capacity must be positive")
        self.capacity, self.n, self.seq = capacity, 0, 0
        self.held: dict = {}  # item -> [count, seq, err]
        self.heap: list = []

    def add(self, item, n: int = 1) -> None:
        if n < 0:
            raise ValueError("a count can't be negative")
        if not n:
            return
        self.n += n
        e = self.held.get(item)
        if e is not None:
            e[0] += n
            return
        count = err = 0
        if len(self.held) >= self.capacity:
            least = self._least(True)
            count = err = self.held.pop(least)[0]
        self.held[item] = [count + n, self.seq, err]
        heapq.heappush(self.heap, (count + n, self.seq, item))
        self.seq += 1

    def load(self, rows) -> None:
        """Counters (item, count, err, seq) as they were."""
        self.held = {i: [c, s, e] for i, c, e, s in rows}
        self.heap = [(v[0], v[1], i) for i, v in self.held.items()]
        heapq.heapify(self.heap)

    def _least(self, take: bool = False):
        while True:
            count, seq, item = self.heap[0]
            e = self.held.get(item)
            if e is None or e[1] != seq:
                heapq.heappop(self.heap)
            elif e[0] != count:
                heapq.heapreplace(self.heap, (e[0], seq, item))
            else:
                if take:
                    heapq.heappop(self.heap)
                return item

    def floor(self) -> int:
        """What an item without a counter may have at most."""
        return self.held[self._least()][0] if len(self.held) >= self.capacity else 0

    def count(self, item) -> tuple[int, int]:
        e = self.held.get(item)
        return (e[0], e[2]) if e is not None else (self.floor(),) * 2

    def top(self, k: int | None = None) -> list[tuple]:
        rows = sorted(((i, c, e, s) for i, (c, s, e) in self.held.items()), key=lambda r: (-r[1], r[3]))
        return [(i, c, e) for i, c, e, _ in (rows if k is None else rows[:k])]

    def merge(self, other: SpaceSaving) -> None:
        """Add another's counters; an item that one lacks may have had that one's floor."""
        mine, theirs = self.floor(), other.floor()
        rows = [(i, c + other.held[i][0], e + other.held[i][2]) if i in other.held else (i, c + theirs, e + theirs) for i, c, e in sorted(((i, v[0], v[2]) for i, v in self.held.items()), key=lambda r: self.held[r[0]][1])]
        rows += [(i, c + mine, e + mine) for i, c, e in sorted(((i, v[0], v[2]) for i, v in other.held.items() if i not in self.held), key=lambda r: other.held[r[0]][1])]
        rows.sort(key=lambda r: -r[1])
        self.n += other.n
        self.held = {i: [c, s, e] for s, (i, c, e) in enumerate(rows[: self.capacity])}
        self.seq = len(self.held)
        self.heap = [(v[0], v[1], i) for i, v in self.held.items()]
        heapq.heapify(self.heap)


def space_saving(df: DataFrame, keys: list[str], item: str, order: list[str], capacity: int, weight: str | None = None) -> DataFrame:
    """(keys, item, count, err, total): counters of each group's items taken in ``order``; null items are ignored.

    Exact to the order and so sequential within a group: its rows pass in sorted
    batches, and no more than the counters and a batch is held.  See
    :func:`space_saving_merged` for one stream over many tasks.
    """
    if not order:
        raise ValueError("the sketch depends on the order of items: name its columns")
    SpaceSaving(capacity)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("item", df.schema[item].dataType), *(T.StructField(c, T.LongType()) for c in ("count", "err", "total"))])
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    sort = [f"_o{i}" for i in range(len(order))]
    rows = df.where(F.col(item).isNotNull()).select(*keys, *[F.col(o).alias(n) for o, n in zip(order, sort, strict=True)], F.col(item).alias("_item"), w.alias("_w"))
    rows = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, *sort).select(*keys, "_item", "_w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, now, kinds = SpaceSaving(capacity), None, []

        def counters() -> pa.RecordBatch:
            top = s.top()
            cols = [[k] * len(top) for k in now] + [[t[0] for t in top], [t[1] for t in top], [t[2] for t in top], [s.n] * len(top)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], schema.names)

        for b in batches:
            kinds = [b.schema.field(i).type for i in range(len(keys) + 1)] + [pa.int64()] * 3
            names = zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True) if keys else [()] * b.num_rows
            for key, x, n in zip(names, b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield counters()
                    s, now = SpaceSaving(capacity), key
                s.add(x, n)
        if now is not None:
            yield counters()

    return rows.mapInArrow(run, schema)


def space_saving_count(held: DataFrame, items: DataFrame, capacity: int) -> DataFrame:
    """(item, count, err, tracked) of the items asked for, each once, in counters (item, count, err) of a sketch.

    An item without a counter may have as many as the least of the counters, if
    all are taken, else it has none; count and err are that bound.
    """
    least = held.agg(F.count("*").alias("_n"), F.min("count").alias("_least")).select(F.when(F.col("_n") >= capacity, F.col("_least")).otherwise(0).cast("long").alias("_floor"))
    found = items.select("item").distinct().join(held.select("item", "count", "err"), "item", "left").crossJoin(F.broadcast(least))  # one row
    return found.select("item", F.coalesce("count", "_floor").alias("count"), F.coalesce("err", "_floor").alias("err"), F.col("count").isNotNull().alias("tracked"))


def space_saving_merged(df: DataFrame, item: str, capacity: int) -> DataFrame:
    """(item, count, err): a sketch per task, merged; the bounds count - err <= truth <= count hold for any partitioning."""
    kind = df.schema[item].dataType
    part = T.StructType([T.StructField("item", kind), T.StructField("count", T.LongType()), T.StructField("err", T.LongType()), T.StructField("floor", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, arrow = SpaceSaving(capacity), None
        for b in batches:
            arrow = b.schema.field(0).type
            for x in b.column(0).to_pylist():
                s.add(x)
        if arrow is not None:
            top, low = s.top(), s.floor()
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in top], arrow), *(pa.array([t[j] for t in top], pa.int64()) for j in (1, 2)), pa.array([low] * len(top), pa.int64())], part.names)

    parts = df.where(F.col(item).isNotNull()).select(item).mapInArrow(run, part).withColumn("_task", F.spark_partition_id())
    floors = parts.groupBy("_task").agg(F.first("floor").alias("floor")).agg(F.coalesce(F.sum("floor"), F.lit(0)).alias("_all"))
    sums = parts.groupBy("item").agg(F.sum("count").alias("c"), F.sum("err").alias("e"), F.sum("floor").alias("own")).crossJoin(F.broadcast(floors))
    missing = F.col("_all") - F.col("own")
    return sums.select("item", (F.col("c") + missing).alias("count"), (F.col("e") + missing).alias("err")).orderBy(F.desc("count"), "item").limit(capacity)


def _numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``_n``, their number from 1 within their keys: a range sort by keys and order, then each range's offset.

    A key with most of the rows is parted by ranges like any other.
    """
    rows = written(df.orderBy(*keys, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_range", *keys).agg(F.count("*").alias("_c"))
    offsets = offsets.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.withColumn("_in", within).join(offsets, on).withColumn("_n", F.col("_in") + F.col("_before")).select(*keys, "item", "_n")


def reservoir(df: DataFrame, keys: list[str], item: str, order: list[str], k: int, seed: int) -> DataFrame:
    """(keys, slot, item): Algorithm R over each group's rows in ``order``, all draws taken at once.

    Row n beyond the first k draws a number below n; if below k, it takes that
    slot, and the last taker stays.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if not order:
        raise ValueError("the sample depends on the order of items: name its columns")
    ranked = _numbered(df.select(*keys, F.col(item).alias("item"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]), keys, [f"_o{i}" for i in range(len(order))])

    @F.arrow_udf(T.LongType())
    def slot(column: pa.Array) -> pa.Array:
        n = column.to_numpy(zero_copy_only=False).astype(np.uint64)
        d = K.finalize(np.uint64(seed & K.MASK) + (np.maximum(n, np.uint64(k)) - np.uint64(k)) * np.uint64(K.GAMMA))
        lo, hi = d & np.uint64(0xFFFFFFFF), d >> np.uint64(32)
        low = (lo * (n & np.uint64(0xFFFFFFFF))) >> np.uint64(32)
        mid = hi * (n & np.uint64(0xFFFFFFFF)) + low
        high = hi * (n >> np.uint64(32)) + (mid >> np.uint64(32)) + ((lo * (n >> np.uint64(32)) + (mid & np.uint64(0xFFFFFFFF))) >> np.uint64(32))
        return pa.array(np.where(n <= k, n - np.uint64(1), high).astype(np.int64))

    at = ranked.withColumn("slot", slot(F.col("_n"))).where(F.col("slot") < k)
    return at.groupBy(*keys, "slot").agg(F.max_by("item", "_n").alias("item"))
