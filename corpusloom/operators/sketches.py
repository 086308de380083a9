"""Sketches over exploded rows: MinHash, SimHash and HyperLogLog as aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import columns as C
from corpusloom.functions import kernels as K
from corpusloom.functions import udfs as U

#: Groups whose partial signatures a task holds before it passes them on.
FOLD_GROUPS = 20_000


def minhash_agg(df: DataFrame, keys: list[str], h: str = "h", k: int = 128, seed: int = 0) -> DataFrame:
    """(keys, sig): signature of the set of hashes of each group.

    A group's hashes are folded to one partial signature per task before the
    shuffle; slots are then reduced by an unsigned minimum in the JVM.  Null
    hashes are ignored; a group of none but nulls has the empty signature.
    """
    schema = T.StructType([*(df.schema[c] for c in keys), T.StructField("sig", T.ArrayType(T.LongType()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True)) if keys else []
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array([s.view(np.int64) for s in held.values()], pa.list_(pa.int64()))], schema.names)

        for b in batches:
            kinds = [b.schema.field(i).type for i in range(len(keys))]
            x = b.column(len(keys))
            real = x.is_valid().to_numpy(zero_copy_only=False)
            x = x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            names = list(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True)) if keys else [()] * len(x)
            code: dict[tuple, int] = {}
            of = np.fromiter((code.setdefault(n, len(code)) for n in names), dtype=np.int64, count=len(x))
            order = np.argsort(of, kind="stable")
            ends = np.cumsum(np.bincount(of, minlength=len(code)))
            for name, lo, hi in zip(code, [0, *ends[:-1]], ends, strict=True):
                rows = order[lo:hi]
                sig = K.minhash(x[rows[real[rows]]], k, seed)
                held[name] = np.minimum(held[name], sig) if name in held else sig
            if len(held) > FOLD_GROUPS:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return union_agg(df.select(*keys, F.col(h).cast("long").alias("h")).mapInArrow(fold, schema), keys)


def union_agg(sigs: DataFrame, keys: list[str], sig: str = "sig") -> DataFrame:
    """(keys, sig): exact signature of the union of each group's sets; nulls are ignored.

    A group's signatures are folded to one per task before the shuffle, in the
    unsigned order that the JVM then reduces by slot.
    """
    schema = T.StructType([*(sigs.schema[c] for c in keys), T.StructField("sig", T.ArrayType(T.LongType()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True)) if keys else []
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array([s.view(np.int64) for s in held.values()], pa.list_(pa.int64()))], schema.names)

        for b in batches:
            kinds = [b.schema.field(i).type for i in range(len(keys))]
            names = zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True) if keys else [()] * b.num_rows
            for name, s in zip(names, U.longs_of(b.column(len(keys))), strict=True):
                have = held.get(name)
                if have is not None and len(have) != len(s):
                    raise ValueError(f"signatures of {len(have)} and {len(s)} slots")
                held[name] = s.copy() if have is None else np.minimum(have, s)
            if len(held) > FOLD_GROUPS:
                yield flush()
                held.clear()
        if held:
            yield flush()

    part = sigs.where(F.col(sig).isNotNull()).select(*keys, sig).mapInArrow(fold, schema)
    slots = part.select(*keys, F.posexplode("sig").alias("_slot", "_v"))
    least = slots.groupBy(*keys, "_slot").agg(F.min(C.unsigned(F.col("_v"))).alias("_m"))
    rows = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_slot", "_m"))).alias("_s"))
    return rows.select(*keys, F.transform("_s", lambda x: C.unsigned(x["_m"])).alias("sig"))


def simhash_agg(df: DataFrame, keys: list[str], h: str = "h", weight: Column | None = None) -> DataFrame:
    """(keys, fp): weighted SimHash of each group by 64 sums in one aggregation; ties give a clear bit."""
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    bit = lambda i: F.sum(F.when(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(1)) == 1, w).otherwise(-w)).alias(f"_b{i}")
    sums = df.where(F.col(h).isNotNull()).groupBy(*keys).agg(*[bit(i) for i in range(64)])
    fp = F.lit(0).cast("long")
    for i in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"_b{i}") > 0, F.lit((1 << i) if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return sums.select(*keys, fp.alias("fp"))


def _precision(registers: DataFrame) -> int | None:
    """What a table of registers says of its precision."""
    return registers.schema["idx"].metadata.get("hll_p")


def _with_precision(p: int) -> Column:
    return F.col("idx").alias("idx", metadata={"hll_p": p})


def _check_precision(p: int, *others: int | None) -> None:
    if not 4 <= p <= 18:
        raise ValueError("p must be in [4, 18]")
    for q in others:
        if q is not None and q != p:
            raise ValueError(f"a sketch of precision {q} is not one of precision {p}")


def hll_registers(df: DataFrame, keys: list[str], value: str, p: int = 14) -> DataFrame:
    """(keys, idx, rho): registers above zero of each group's sketch of a 64-bit column; nulls are ignored.

    The column ``idx`` carries the precision in its metadata, also through Parquet.
    """
    _check_precision(p)
    cells = df.where(F.col(value).isNotNull()).select(*keys, U.hll_cell(F.col(value).cast("long"), p).alias("_c"))
    return cells.groupBy(*keys, F.col("_c.idx").alias("idx")).agg(F.max("_c.rho").alias("rho")).select(*keys, _with_precision(p), "rho")


def hll_merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Registers of the union of two sketches; an error if their precisions differ."""
    p, q = _precision(a), _precision(b)
    if p is not None:
        _check_precision(p, q)
    out = a.select(*keys, "idx", "rho").unionByName(b.select(*keys, "idx", "rho")).groupBy(*keys, "idx").agg(F.max("rho").alias("rho"))
    return out if p is None else out.select(*keys, _with_precision(p), "rho")


def hll_estimate(registers: DataFrame, keys: list[str], p: int = 14) -> DataFrame:
    """(keys, estimate); counts free registers linearly where that is better; 0 for no registers at all and no keys."""
    _check_precision(p, _precision(registers))
    m = float(1 << p)
    alpha = {16.0: 0.673, 32.0: 0.697, 64.0: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    sums = registers.groupBy(*keys).agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rho"))), F.lit(0.0)).alias("_s"), F.count("*").alias("_n"))
    zeros = F.lit(m) - F.col("_n")
    raw = F.lit(alpha * m * m) / (F.col("_s") + zeros)
    linear = F.lit(m) * F.log(F.lit(m) / zeros)
    return sums.select(*keys, F.when((raw <= 2.5 * m) & (zeros > 0), linear).otherwise(raw).alias("estimate"))


def hll_bytes(registers: DataFrame, keys: list[str], p: int = 14) -> DataFrame:
    """(keys, data): the versioned bytes of each sketch."""
    _check_precision(p, _precision(registers))
    held = registers.groupBy(*keys).agg(F.collect_list(F.struct("idx", "rho")).alias("_r"))

    @F.arrow_udf(T.BinaryType())
    def pack(column: pa.Array) -> pa.Array:
        out = []
        for rows in column.to_pylist():
            reg = np.zeros(1 << p, dtype=np.uint8)
            for x in rows:
                reg[x["idx"]] = x["rho"]
            out.append(K.marshal_hll(reg, p))
        return pa.array(out, pa.binary())

    return held.select(*keys, pack(F.col("_r")).alias("data"))


def hll_from_bytes(df: DataFrame, keys: list[str], data: str = "data", strict: bool = True) -> DataFrame:
    """(keys, p, idx, rho) of sketches' bytes; what isn't one is an error or, if not strict, left out."""
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("p", T.IntegerType()), T.StructField("idx", T.IntegerType()), T.StructField("rho", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, p, idx, rho = [], [], [], []
            for i, raw in enumerate(b.column(len(keys)).to_pylist()):
                try:
                    reg, q = K.decode_hll(raw or b"")
                except ValueError:
                    if strict:
                        raise
                    continue
                at = np.flatnonzero(reg)
                row.append(np.full(len(at), i))
                p.append(np.full(len(at), q))
                idx.append(at)
                rho.append(reg[at])
            cat = lambda x: np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)
            keep = pa.array(cat(row))
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(keep) for j in range(len(keys))), pa.array(cat(p)), pa.array(cat(idx)), pa.array(cat(rho))], schema.names)

    return df.select(*keys, data).mapInArrow(run, schema)
