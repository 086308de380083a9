"""Arrow UDFs around the kernels: one call per batch, arrays built without Python objects per hash."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import kernels as K

_LONGS = T.ArrayType(T.LongType(), False)


def _check(name: str, value: int, least: int = 1, most: int | None = None) -> int:
    if value < least or (most is not None and value > most):
        raise ValueError(f"{name} must be at least {least}" + (f" and at most {most}" if most is not None else ""))
    return value


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    """Arrays of uint64 as a list<int64>, nulls kept."""
    size = np.array([0 if p is None else len(p) for p in parts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    held = [p for p in parts if p is not None and len(p)]
    flat = np.concatenate(held).astype(np.uint64).view(np.int64) if held else np.zeros(0, np.int64)
    missing = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=missing)


def longs_of(column: pa.Array) -> list[np.ndarray | None]:
    """The arrays of a list<int64> column as uint64; null elements are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = []
    for x in column:
        if not x.is_valid:
            out.append(None)
            continue
        v = x.values
        out.append((v.drop_null() if v.null_count else v).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    return out


def _over_texts(kernel: Callable[[list], list[np.ndarray]]) -> Callable:
    """An Arrow UDF around a kernel over all texts of a batch at once."""

    @F.arrow_udf(_LONGS)
    def run(column: pa.Array) -> pa.Array:
        return _lists(over_held(column.to_pylist(), kernel))

    return run


def over_held(values: list, kernel: Callable[[list], list]) -> list:
    """What the kernel makes of the values that aren't null."""
    got = iter(kernel([v for v in values if v is not None]))
    return [None if v is None else next(got) for v in values]


def char(c: Column, k: int) -> Column:
    """XXH64 of every window of k bytes, of a string or binary column."""
    _check("k", k)
    return _over_texts(lambda ts: K.char_of(ts, k))(c)


def char_runes(c: Column, k: int) -> Column:
    _check("k", k)
    return _over_texts(lambda ts: [K.char_runes(t, k) for t in ts])(c)


def words(c: Column, w: int = 3) -> Column:
    _check("w", w)
    return _over_texts(lambda ts: K.words_of(ts, w))(c)


def token_hashes(c: Column) -> Column:
    return _over_texts(K.token_hashes_of)(c)


def tokens(c: Column) -> Column:
    @F.arrow_udf(T.ArrayType(T.StringType(), False))
    def run(column: pa.Array) -> pa.Array:
        from corpusloom.functions.unicode15 import tokens as cut

        return pa.array([None if t is None else cut(K.as_text(t)) for t in column.to_pylist()], pa.list_(pa.string()))

    return run(c)


def sketch(c: Column, w: int = 3, k: int = 128, seed: int = 0) -> Column:
    """MinHash signature of a text's word shingles, in one call."""
    _check("w", w), _check("k", k, 1, 65535)
    return _over_texts(lambda ts: [K.minhash(h, k, seed) for h in K.words_of(ts, w)])(c)


def sketch_char(c: Column, n: int, k: int = 128, seed: int = 0) -> Column:
    _check("n", n), _check("k", k, 1, 65535)
    return _over_texts(lambda ts: [K.minhash(h, k, seed) for h in K.char_of(ts, n)])(c)


def minhash(c: Column, k: int = 128, seed: int = 0) -> Column:
    """Signature of an array of hashes."""
    _check("k", k, 1, 65535)

    @F.arrow_udf(_LONGS)
    def run(column: pa.Array) -> pa.Array:
        return _lists([None if h is None else K.minhash(h, k, seed) for h in longs_of(column)])

    return run(c)


def simhash_text(c: Column, w: int = 3) -> Column:
    """64-bit SimHash of a text's word shingles, repeats counting; 0 for fewer than w tokens."""
    _check("w", w)

    @F.arrow_udf(T.LongType())
    def run(column: pa.Array) -> pa.Array:
        got = over_held(column.to_pylist(), lambda ts: [K.simhash(h) for h in K.words_of(ts, w)])
        return pa.array([None if x is None else x - (1 << 64) if x >> 63 else x for x in got], pa.int64())

    return run(c)


def band_keys(c: Column, bands: int, rows: int) -> Column:
    _check("bands", bands), _check("rows", rows)

    @F.arrow_udf(_LONGS)
    def run(column: pa.Array) -> pa.Array:
        out = []
        for h in longs_of(column):
            if h is not None and len(h) < bands * rows:
                raise ValueError(f"a signature of {len(h)} slots has no {bands} bands of {rows}")
            out.append(None if h is None else K.band_keys(h, bands, rows))
        return _lists(out)

    return run(c)


_FINGERPRINTS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType(), False), T.StructField("hash", T.LongType(), False)]), False)


def _fingerprints(found: list[tuple[np.ndarray, np.ndarray] | None]) -> pa.Array:
    size = np.array([0 if f is None else len(f[0]) for f in found], dtype=np.int64)
    held = [f for f in found if f is not None and len(f[0])]
    pos = np.concatenate([f[0] for f in held]).astype(np.int32) if held else np.zeros(0, np.int32)
    h = np.concatenate([f[1] for f in held]).view(np.int64) if held else np.zeros(0, np.int64)
    rows = pa.StructArray.from_arrays([pa.array(pos), pa.array(h)], ["pos", "hash"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), rows, mask=pa.array([f is None for f in found], pa.bool_()))


def winnow_text(c: Column, k: int, w: int) -> Column:
    """Winnowed fingerprints (pos, hash) of a text's k-byte windows; only they leave the worker."""
    _check("k", k), _check("w", w)

    @F.arrow_udf(_FINGERPRINTS)
    def run(column: pa.Array) -> pa.Array:
        return _fingerprints(over_held(column.to_pylist(), lambda ts: K.winnow_of(ts, k, w)))

    return run(c)


def winnow_set(c: Column, k: int, w: int) -> Column:
    """The distinct hashes of a text's winnowed fingerprints."""
    _check("k", k), _check("w", w)
    return _over_texts(lambda ts: [np.unique(h) for _, h in K.winnow_of(ts, k, w)])(c)


_REGIONS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType(), False) for n in ("pos", "len")]), False)


def _rows(found: list[np.ndarray | None], names: list[str]) -> pa.Array:
    """Arrays of rows of ints as a list<struct>, nulls kept."""
    flat = np.concatenate([np.zeros((0, len(names)), np.int32), *(f.astype(np.int32) for f in found if f is not None)])
    rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(len(names))], names)
    size = np.array([0 if f is None else len(f) for f in found], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), rows, mask=pa.array([f is None for f in found], pa.bool_()))


def cover_text(c: Column, rare: Column, k: int, w: int, min_run: int) -> Column:
    """Regions (pos, len) of a text's runs of at least ``min_run`` fingerprints, none of them among its rare hashes."""
    _check("k", k), _check("w", w)

    @F.arrow_udf(_REGIONS)
    def run(texts: pa.Array, few: pa.Array) -> pa.Array:
        values, few = texts.to_pylist(), longs_of(few)
        at = [i for i, t in enumerate(values) if t is not None]
        found: list[np.ndarray | None] = [None] * len(values)
        for i, x in zip(at, K.cover_of([values[i] for i in at], [few[i] for i in at], k, w, min_run), strict=True):
            found[i] = np.stack(x, axis=1)
        return _rows(found, ["pos", "len"])

    return run(c, rare)


_SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType(), False) for n in ("pos_a", "pos_b", "len")]), False)


def overlap_spans(a: Column, b: Column, k: int, w: int) -> Column:
    """Aligned spans (pos_a, pos_b, len) of two texts; null if either is."""
    _check("k", k), _check("w", w)

    @F.arrow_udf(_SPANS)
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        found = [None if not x.is_valid or not y.is_valid else K.overlap_spans(x.as_py(), y.as_py(), k, w) for x, y in zip(left, right, strict=True)]
        return _rows(found, ["pos_a", "pos_b", "len"])

    return run(a, b)


def winnow_hashes(c: Column, w: int) -> Column:
    _check("w", w)

    @F.arrow_udf(_FINGERPRINTS)
    def run(column: pa.Array) -> pa.Array:
        at = [None if h is None else (K.winnow(h, w), h) for h in longs_of(column)]
        return _fingerprints([None if x is None else (x[0], x[1][x[0]]) for x in at])

    return run(c)


def hll_cell(c: Column, p: int) -> Column:
    """(idx, rho) of each 64-bit value."""
    _check("p", p, 4, 18)

    @F.arrow_udf(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("rho", T.IntegerType())]))
    def run(column: pa.Array) -> pa.Array:
        null = column.is_null().to_numpy(zero_copy_only=False)
        x = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        i, r = K.hll_cell(x, p)
        return pa.StructArray.from_arrays([pa.array(i.astype(np.int32), mask=null), pa.array(r.astype(np.int32), mask=null)], ["idx", "rho"])

    return run(c)


def hash_text(c: Column) -> Column:
    """XXH64, seed 0, of a string or binary value."""

    @F.arrow_udf(T.LongType())
    def run(column: pa.Array) -> pa.Array:
        got = [None if t is None else K.xxh64(K.as_bytes(t)) for t in column.to_pylist()]
        return pa.array([None if x is None else x - (1 << 64) if x >> 63 else x for x in got], pa.int64())

    return run(c)


def marshal_signature(c: Column, seed: int = 0) -> Column:
    @F.arrow_udf(T.BinaryType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if h is None else K.marshal_signature(h, seed) for h in longs_of(column)], pa.binary())

    return run(c)


def decode_signature(c: Column, strict: bool = True) -> Column:
    """(sig, seed) of a signature's bytes; what isn't one is an error or, if not strict, null."""

    @F.arrow_udf(T.StructType([T.StructField("sig", _LONGS), T.StructField("seed", T.LongType())]))
    def run(column: pa.Array) -> pa.Array:
        out = []
        for raw in column.to_pylist():
            try:
                sig, seed = (None, None) if raw is None else K.decode_signature(raw)
                out.append(None if raw is None else {"sig": sig.view(np.int64).tolist(), "seed": seed - (1 << 64) if seed >> 63 else seed})
            except ValueError:
                if strict:
                    raise
                out.append(None)
        return pa.array(out, pa.struct([("sig", pa.list_(pa.int64())), ("seed", pa.int64())]))

    return run(c)


def unmarshal_signature(c: Column, k: int, seed: int = 0, strict: bool = True) -> Column:
    """Signature out of bytes for a hasher of ``k`` slots and ``seed``; other bytes are an error or, if not strict, null."""

    @F.arrow_udf(_LONGS)
    def run(column: pa.Array) -> pa.Array:
        out = []
        for raw in column.to_pylist():
            try:
                out.append(None if raw is None else K.unmarshal_signature(raw, k, seed))
            except ValueError:
                if strict:
                    raise
                out.append(None)
        return _lists(out)

    return run(c)


def marshal_fingerprint(c: Column) -> Column:
    @F.arrow_udf(T.BinaryType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else K.marshal_fingerprint(x) for x in column.to_pylist()], pa.binary())

    return run(c)


def decode_fingerprint(c: Column, strict: bool = True) -> Column:
    @F.arrow_udf(T.LongType())
    def run(column: pa.Array) -> pa.Array:
        out = []
        for raw in column.to_pylist():
            try:
                x = None if raw is None else K.decode_fingerprint(raw)
                out.append(None if x is None else x - (1 << 64) if x >> 63 else x)
            except ValueError:
                if strict:
                    raise
                out.append(None)
        return pa.array(out, pa.int64())

    return run(c)
