"""SQL names for the functions: scalar UDFs, aggregates and table functions for LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import kernels as K
from corpusloom.functions import udfs as U
from corpusloom.session import ship

_LONGS = T.ArrayType(T.LongType(), False)


def _text_udf(kernel):
    """An Arrow UDF of (text, parameter): the parameter may be a column or a literal."""

    @F.arrow_udf(_LONGS)
    def run(text: pa.Array, n: pa.Array) -> pa.Array:
        return U._lists([None if t is None or k is None else kernel(t, k) for t, k in zip(text.to_pylist(), n.to_pylist(), strict=True)])

    return run


@F.arrow_udf(_LONGS)
def _sketch(text: pa.Array, w: pa.Array, k: pa.Array, seed: pa.Array) -> pa.Array:
    rows = zip(text.to_pylist(), w.to_pylist(), k.to_pylist(), seed.to_pylist(), strict=True)
    return U._lists([None if t is None else K.minhash(K.words(t, a), b, s) for t, a, b, s in rows])


@F.arrow_udf(T.LongType())
def _simhash(text: pa.Array, w: pa.Array) -> pa.Array:
    got = [None if t is None else K.simhash(K.words(t, n)) for t, n in zip(text.to_pylist(), w.to_pylist(), strict=True)]
    return pa.array([None if x is None else x - (1 << 64) if x >> 63 else x for x in got], pa.int64())


@F.arrow_udf(_LONGS)
def _bands(sig: pa.Array, bands: pa.Array, rows: pa.Array) -> pa.Array:
    return U._lists([None if h is None else K.band_keys(h, b, r) for h, b, r in zip(U.longs_of(sig), bands.to_pylist(), rows.to_pylist(), strict=True)])


@F.pandas_udf(_LONGS)
def _union(sigs: pd.Series) -> list:
    held = [np.asarray(s, dtype=np.int64).view(np.uint64) for s in sigs if s is not None]
    return np.minimum.reduce(held).view(np.int64).tolist() if held else None


@F.pandas_udf(T.LongType())
def _simhash_agg(h: pd.Series, w: pd.Series) -> int:
    held = h.notna() & w.notna()
    x = K.simhash(h[held].to_numpy(dtype=np.int64).view(np.uint64), w[held].to_numpy(dtype=np.int64))
    return x - (1 << 64) if x >> 63 else x


@F.arrow_udf(T.DoubleType())
def _cardinality(sig: pa.Array) -> pa.Array:
    return pa.array([None if h is None else K.cardinality(h) for h in U.longs_of(sig)], pa.float64())


@F.arrow_udf(T.DoubleType())
def _containment(a: pa.Array, b: pa.Array) -> pa.Array:
    rows = zip(U.longs_of(a), U.longs_of(b), strict=True)
    return pa.array([None if x is None or y is None else K.containment(x, y) for x, y in rows], pa.float64())


@F.arrow_udf(T.BinaryType())
def _marshal(sig: pa.Array, seed: pa.Array) -> pa.Array:
    return pa.array([None if h is None else K.marshal_signature(h, s) for h, s in zip(U.longs_of(sig), seed.to_pylist(), strict=True)], pa.binary())


@F.arrow_udf(_LONGS)
def _unmarshal(data: pa.Array, k: pa.Array, seed: pa.Array) -> pa.Array:
    rows = zip(data.to_pylist(), k.to_pylist(), seed.to_pylist(), strict=True)
    return U._lists([None if raw is None else K.unmarshal_signature(raw, n, s) for raw, n, s in rows])


@F.arrow_udf(T.BinaryType())
def _marshal_fingerprint(fp: pa.Array) -> pa.Array:
    return pa.array([None if x is None else K.marshal_fingerprint(x) for x in fp.to_pylist()], pa.binary())


@F.arrow_udf(T.LongType())
def _decode_fingerprint(data: pa.Array) -> pa.Array:
    got = [None if raw is None else K.decode_fingerprint(raw) for raw in data.to_pylist()]
    return pa.array([None if x is None else x - (1 << 64) if x >> 63 else x for x in got], pa.int64())


@F.pandas_udf(T.BinaryType())
def _hll(values: pd.Series, p: pd.Series) -> bytes:
    """Bytes of the sketch of a group, which one task holds; see ``hll_cell`` for groups of any size."""
    q = int(p.iloc[0]) if len(p) else 14
    reg = np.zeros(1 << q, dtype=np.uint8)
    idx, rho = K.hll_cell(values.dropna().to_numpy(dtype=np.int64).view(np.uint64), q)
    np.maximum.at(reg, idx, rho.astype(np.uint8))
    return K.marshal_hll(reg, q)


@F.pandas_udf(T.BinaryType())
def _hll_union(data: pd.Series) -> bytes:
    """Bytes of the union of sketches; an error if their precisions differ."""
    held = [K.decode_hll(bytes(x)) for x in data if x is not None]
    if len({p for _, p in held}) > 1:
        raise ValueError(f"sketches of precisions {sorted({p for _, p in held})}")
    return K.marshal_hll(np.maximum.reduce([r for r, _ in held]), held[0][1]) if held else None


@F.arrow_udf(T.DoubleType())
def _hll_estimate(data: pa.Array) -> pa.Array:
    return pa.array([None if raw is None else K.hll_estimate(*K.decode_hll(raw)) for raw in data.to_pylist()], pa.float64())


@F.arrow_udf(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("rho", T.IntegerType())]))
def _hll_cell(values: pa.Array, p: pa.Array) -> pa.Array:
    idx, rho = (np.zeros(len(values), np.int64) for _ in range(2))
    x, q = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), p.to_numpy(zero_copy_only=False)
    for one in np.unique(q):
        idx[q == one], rho[q == one] = K.hll_cell(x[q == one], int(one))
    return pa.StructArray.from_arrays([pa.array(idx.astype(np.int32)), pa.array(rho.astype(np.int32))], ["idx", "rho"], mask=values.is_null())


#: Functions that stay in the JVM: name, parameters, result, body.
_INLINE = (
    ("jaccard", "a ARRAY<BIGINT>, b ARRAY<BIGINT>", "DOUBLE", "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) <> size(b) OR size(a) = 0 THEN CAST(raise_error('signatures of unequal or no length') AS DOUBLE) ELSE aggregate(zip_with(a, b, (x, y) -> CAST(x = y AS INT)), 0, (s, x) -> s + x) / size(a) END"),
    ("is_empty", "a ARRAY<BIGINT>", "BOOLEAN", "forall(a, v -> v = -1)"),
    ("distance", "a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
    ("cosine", "a BIGINT, b BIGINT", "DOUBLE", "cos(bit_count(a ^ b) * (pi() / 64))"),
)


@F.udtf(returnType="pos int, hash bigint")
class Shingles:
    def eval(self, text: str, w: int) -> Iterator[tuple[int, int]]:
        if text is not None:
            yield from enumerate(K.words(text, w).view(np.int64).tolist())


@F.udtf(returnType="ord int, pos int, hash bigint")
class WinnowFingerprints:
    def eval(self, text: str, k: int, w: int) -> Iterator[tuple[int, int, int]]:
        if text is not None:
            h = K.char(text, k)
            for i, p in enumerate(K.winnow(h, w).tolist()):
                yield i, p, int(h[p].view(np.int64))


@F.udtf(returnType="pos_a int, pos_b int, len int")
class Overlaps:
    """Aligned spans of two texts, by (pos_a, pos_b)."""

    def eval(self, a: str, b: str, k: int, w: int, limit: int | None = None) -> Iterator[tuple[int, int, int]]:
        if a is None or b is None:
            return
        ha, hb = K.char(a, k), K.char(b, k)
        at: dict[int, list[int]] = {}
        for p in K.winnow(ha, w).tolist():
            at.setdefault(int(ha[p]), []).append(p)
        open_: dict[int, list[int]] = {}
        out: list[tuple[int, int, int]] = []
        seen = 0
        for j, q in enumerate(K.winnow(hb, w).tolist()):
            for p in at.get(int(hb[q]), ()):
                seen += 1
                if limit is not None and seen > limit:
                    break
                run = open_.get(p - q)
                if run is not None and run[0] == j - 1:
                    run[0], run[3] = j, q
                else:
                    if run is not None:
                        out.append((run[1], run[2], run[3] - run[2] + k))
                    open_[p - q] = [j, p, q, q]
        out += [(r[1], r[2], r[3] - r[2] + k) for r in open_.values()]
        yield from sorted(out)


@F.udtf(returnType="block int, hashes array<bigint>")
class WordBlocks:
    """Word shingles in blocks; a LIMIT stops the scan."""

    def eval(self, text: str, w: int, size: int) -> Iterator[tuple[int, list[int]]]:
        from corpusloom.streaming.chunks import blocks_of

        if text is not None:
            for i, b in enumerate(blocks_of(text, w, size)):
                yield i, b.view(np.int64).tolist()


def register(spark: SparkSession, prefix: str = "cl_") -> list[str]:
    """Register all names under a prefix and return them."""
    ship(spark)
    scalars = {
        "char_hashes": _text_udf(K.char), "char_rune_hashes": _text_udf(K.char_runes), "word_hashes": _text_udf(K.words), "sketch": _sketch, "simhash": _simhash, "band_keys": _bands, "minhash_union": _union, "simhash_agg": _simhash_agg,
        "cardinality": _cardinality, "containment": _containment, "marshal_signature": _marshal, "unmarshal_signature": _unmarshal, "marshal_fingerprint": _marshal_fingerprint, "decode_fingerprint": _decode_fingerprint,
        "hll": _hll, "hll_union": _hll_union, "hll_estimate": _hll_estimate, "hll_cell": _hll_cell,
    }
    for name, f in scalars.items():
        spark.udf.register(prefix + name, f)
    for name, takes, gives, body in _INLINE:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({takes}) RETURNS {gives} RETURN {body}")
    tables = {"shingles": Shingles, "winnow": WinnowFingerprints, "overlaps": Overlaps, "word_blocks": WordBlocks}
    for name, f in tables.items():
        spark.udtf.register(prefix + name, f)
    return [prefix + n for n in (*scalars, *(x[0] for x in _INLINE), *tables)]
