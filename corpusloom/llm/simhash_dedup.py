"""SimHash near-duplicate search by covering locality-sensitive hashing.

Each bit of a 64-bit SimHash is given a non-zero vector of r+1 bits; table v
keeps the bits whose vector has odd overlap with v.  The bits in which a pair
within distance r differs span at most r dimensions, so some table drops all of
them and the pair collides there: no pair within the radius is missed (Pagh,
"Locality-sensitive Hashing without False Negatives", 2016).

The searched SimHash is over words, weighted by their counts, up to a bound.  A pair that it
finds must also agree in a 128-bit SimHash over word pairs, which sets apart
texts that merely share common words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.kernels import run_hashes
from corpusloom.llm.common import Scratch, partitions_for, row_key, small
from corpusloom.operators.cluster import connected_components
from corpusloom.session import bound_batches

RADIUS = 8
#: Most bits of the 128 over word pairs in which a near duplicate may differ.
PAIR_BITS = 34
#: A word's weight is its count, up to this: common words steady the sketch of a short text and don't rule that of a long one.
SATURATION = 8
#: Rows that one task of the pair search is planned for, and that it holds at a time (or one bucket, if larger).
TABLE_ROWS, CHUNK_ROWS = 1_000_000, 100_000
#: Rows of a bucket beyond which its components are flooded, not all pairs compared; rows of the flood's front taken at once.
HOT_ROWS, PIVOTS = 64, 16
#: Up to so many distinct sketches a group of four tables, which parts them by 7 bits at least, has buckets that a task
#: can hold; beyond it tables go in twos, by about 16 bits, and twice the rows are sent.  The pairs found are the same.
FOURS_ROWS, FOURS_BITS = 100_000_000, 7
_SKETCH = ("s", "v1", "v2")

WORD = re.compile(r"[^\W_]+")
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def masks(radius: int = RADIUS) -> np.ndarray:
    """The 2^(r+1)-1 bit masks of the covering tables."""
    dims = radius + 1
    rng = np.random.default_rng(20160)
    base = np.arange(1, 1 << dims)
    vectors = np.concatenate([rng.permutation(base) for _ in range(-(-64 // len(base)))])[:64].astype(np.uint64)
    v = np.arange(1, 1 << dims, dtype=np.uint64)
    odd = np.bitwise_count(v[:, None] & vectors[None, :]) & 1
    return (odd.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


@lru_cache(maxsize=8)
def mask_groups(radius: int = RADIUS, fours: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(shared, tables): masks in fours, or in twos, with the bits that all of a group keep; tables' numbers (-1: none).

    A row is sent once per group by the shared bits and meets there all rows
    that any table of the group would bring to it.  Tables a, b, c and a^b^c
    share the bits that are odd with all of the first three, about 8; two share 16.
    """
    m = masks(radius)
    left, shared, tables = dict.fromkeys(range(1, len(m) + 1)), [], []
    keep = lambda *t: int(np.bitwise_and.reduce([m[x - 1] for x in t]))
    while left:
        group = [next(iter(left))]
        if len(left) > 1:
            group.append(max((x for x in left if x != group[0]), key=lambda x: (keep(group[0], x).bit_count(), -x)))
            a, b = group
            thirds = [x for x in left if x not in group and x ^ a ^ b in left and x ^ a ^ b not in (a, b)] if fours else []
            if thirds:
                c = max(thirds, key=lambda x: (keep(a, b, x).bit_count(), -x))
                if keep(a, b, c).bit_count() >= FOURS_BITS:
                    group += [c, a ^ b ^ c]
        for x in group:
            del left[x]
        shared.append(keep(*group))
        tables.append([x - 1 for x in group] + [-1] * (4 - len(group)))
    return np.array(shared, dtype=np.uint64), np.array(tables)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Letters and digits as they are, a space for every other code point: what WORD matches."""
    return np.fromiter((c if chr(c).isalnum() else 32 for c in range(0x110000)), dtype=np.uint32, count=0x110000)


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """XXH64 of each text's words."""
    return run_hashes([t.lower() if t else "" for t in texts], _letters())


def _votes(h: np.ndarray, weights: np.ndarray | None, most: int) -> np.ndarray:
    """For each bit of rows of hashes the weights (up to ``most``) of those that have it, added in bytes, eight at a time."""
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
    eight = bits.view(np.uint64)
    if weights is not None:
        eight = eight * weights[:, None]
    sums = np.add.reduceat(eight, np.arange(0, len(h), 255 // most), axis=0)
    return sums.view(np.uint8).reshape(-1, bits.shape[1]).sum(axis=0, dtype=np.int64)


def sketch(h: np.ndarray) -> tuple[int, int, int]:
    """Searched SimHash and the two halves of the one over word pairs, of at least one word hash."""
    u, n = np.unique(h, return_counts=True)
    w = np.minimum(n, SATURATION).astype(np.uint64)
    s = np.packbits(_votes(u, w, SATURATION) * 2 > int(w.sum()), bitorder="little").view(np.int64)[0]
    p = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29))) if len(h) > 1 else h
    p = np.stack([_mix(p), _mix(p ^ np.uint64(0xA0761D6478BD642F))], axis=1)
    v = np.packbits(_votes(p, None, 1) * 2 > len(p), bitorder="little").view(np.int64)
    return int(s), int(v[0]), int(v[1])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, s, v1, v2), key telling rows by doc_id and text; nulls in s for a text without words, which is near nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sketch(h) if len(h) else (None, None, None) for h in word_hashes(b.column(2).to_pylist())]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "key", *_SKETCH])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("key", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in _SKETCH)])
    return docs.select("doc_id", row_key(docs).alias("key"), "text").mapInArrow(run, schema)


def _find(comp: np.ndarray, i: int) -> int:
    while comp[i] != i:
        comp[i] = comp[comp[i]]
        i = comp[i]
    return i


def _flood(s: np.ndarray, v: np.ndarray, radius: int, pair_bits: int) -> np.ndarray:
    """Component of each row of one hot bucket, as the place of one of its rows.

    Rows found near leave the rows still to be searched, so that a bucket of
    texts near one another costs about one comparison a row, not one a pair.
    """
    n = len(s)
    comp, left = np.full(n, -1), np.arange(n)
    while len(left):
        root, front = left[0], left[:1]
        comp[root], left = root, left[1:]
        while len(front) and len(left):
            some, front = front[:PIVOTS], front[PIVOTS:]
            hit = np.zeros(len(left), dtype=bool)
            for i in range(0, len(left), CHUNK_ROWS):
                part = slice(i, i + CHUNK_ROWS)
                for x in some:  # a row against many
                    there = np.flatnonzero(~hit[part])
                    rows = left[part][there]
                    near = np.bitwise_count(s[x] ^ s[rows]) <= radius
                    there, rows = there[near], rows[near]
                    hit[i + there[np.bitwise_count(v[x] ^ v[rows]).sum(axis=1) <= pair_bits]] = True
            comp[left[hit]] = root
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return comp


def bucket_edges(t: np.ndarray, s: np.ndarray, v: np.ndarray, ids: np.ndarray, radius: int = RADIUS, pair_bits: int = PAIR_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, root) that join all pairs within the bounds among rows of one table and key.

    Every pair in a bucket is compared, or known to be joined already; of the
    pairs found, only those that join two components so far become edges, which
    keeps the components exact.  Pairs alike in ``s`` meet in every table and are
    compared in the first.
    """
    key = s & masks(radius)[t]
    order = np.lexsort((s, key, t))
    t, s, v, ids, key = t[order], s[order], v[order], ids[order], key[order]
    names, local = np.unique(ids, return_inverse=True)
    comp = np.arange(len(names))
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (t[1:] != t[:-1])])) if len(s) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(s))

    def join(x: int, y: int) -> None:
        x, y = _find(comp, x), _find(comp, y)
        if x != y:
            comp[max(x, y)] = min(x, y)

    hot = last - first > HOT_ROWS
    for i, j in zip(first[hot].tolist(), last[hot].tolist(), strict=True):
        if t[i] and s[i] == s[j - 1]:
            continue
        found = _flood(s[i:j], v[i:j], radius, pair_bits)
        moved = np.flatnonzero(found != np.arange(j - i))
        for x, y in zip(local[i + moved].tolist(), local[i + found[moved]].tolist(), strict=True):
            join(x, y)
    while (comp != comp[comp]).any():
        comp = comp[comp]
    end = np.repeat(last, last - first)
    here, d = np.arange(len(s))[np.repeat(~hot, last - first)], 0
    while len(here):
        d += 1
        here = here[here + d < end[here]]
        open_ = here[(comp[local[here]] != comp[local[here + d]]) & ((t[here] == 0) | (s[here] != s[here + d]))]
        if len(open_):
            near = np.bitwise_count(s[open_] ^ s[open_ + d]) <= radius
            near &= np.bitwise_count(v[open_] ^ v[open_ + d]).sum(axis=1) <= pair_bits
            hit = open_[near]
            for x, y in zip(local[hit].tolist(), local[hit + d].tolist(), strict=True):
                join(x, y)
            if len(hit):
                while (comp != comp[comp]).any():
                    comp = comp[comp]
    joined = np.flatnonzero(comp != np.arange(len(names)))
    return names[joined], names[comp[joined]]


def near_edges(unique: DataFrame, rows: int, radius: int = RADIUS, pair_bits: int = PAIR_BITS) -> DataFrame:
    """(a_s, a_v1, a_v2, b_s, b_v1, b_v2): edges between distinct sketches whose components are those of all near pairs."""
    spark = unique.sparkSession
    fours = rows <= FOURS_ROWS
    shared, group_tables = mask_groups(radius, fours)
    parts = partitions_for(spark, rows * len(shared), TABLE_ROWS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, CHUNK_ROWS
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= limit:
                t = pa.Table.from_batches(held).combine_chunks()
                bucket = t.column("bucket").to_numpy()
                cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                if cut:
                    yield edges_of(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    size = t.num_rows - cut
                limit = max(CHUNK_ROWS, 2 * size)
        if held:
            yield edges_of(pa.Table.from_batches(held).combine_chunks())

    def edges_of(t: pa.Table) -> pa.RecordBatch:
        number, *triple = (t.column(n).to_numpy() for n in ("t", *_SKETCH))
        order = np.lexsort(triple)
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in triple], axis=0)
        ids = np.empty(len(order), dtype=np.int64)
        ids[order] = np.cumsum(new) - 1
        first = order[new]
        s, v = triple[0].astype(np.uint64), np.stack(triple[1:], axis=1).astype(np.uint64)
        tables = group_tables[number]
        row, place = np.nonzero(tables >= 0)
        ends = bucket_edges(tables[row, place], s[row], v[row], ids[row], radius, pair_bits)
        return pa.RecordBatch.from_arrays([pa.array(c[first[e]]) for e in ends for c in triple], edges.names)

    edges = T.StructType([T.StructField(f"{x}_{c}", T.LongType()) for x in "ab" for c in _SKETCH])
    keep = F.array(*[F.lit(int(np.uint64(m).astype(np.int64))) for m in shared])
    sent = unique.select(*_SKETCH, F.explode(F.sequence(F.lit(0), F.lit(len(shared) - 1))).alias("t"))
    bucket = F.xxhash64("t", F.element_at(keep, F.col("t") + 1).bitwiseAND(F.col("s")))
    ordered = sent.repartition(parts, bucket).withColumn("bucket", bucket).sortWithinPartitions("bucket")
    return ordered.mapInArrow(search, edges)


def _members(docs: DataFrame, radius: int, pair_bits: int) -> DataFrame:
    """(doc_id, key, keep_id, keep_key) of every row of a group of more than one; the row kept has the least doc_id, then key, null ids last."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "simhash")
    base = scratch.save(sketches(docs).where("s IS NOT NULL"), "sketches")
    unique = base.groupBy(*_SKETCH).agg(F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id())
    unique = scratch.save(unique, "unique")  # numbers hold once they are written
    edges = scratch.save(near_edges(unique, unique.count(), radius, pair_bits).distinct(), "edges")
    for x in "ab":
        edges = edges.join(unique.select(*[F.col(c).alias(f"{x}_{c}") for c in _SKETCH], F.col("rep").alias(x)), [f"{x}_{c}" for c in _SKETCH])
    roots = connected_components(edges).withColumnRenamed("id", "rep")
    named = unique.join(roots, "rep", "left").where("copies > 1 OR root IS NOT NULL").select(*_SKETCH, F.coalesce("root", "rep").alias("root"))
    named = scratch.save(named, "named")
    members = scratch.save(base.join(small(named), [*_SKETCH]).select("root", "doc_id", "key"), "members")
    for name in ("sketches", "unique", "edges", "named"):
        scratch.drop(name)
    keep = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")).alias("k"))
    keep = scratch.save(keep.select("root", F.col("k.doc_id").alias("keep_id"), F.col("k.key").alias("keep_key")), "keep")
    return members.join(small(keep), "root").select("doc_id", "key", "keep_id", "keep_key")


def groups(docs: DataFrame, radius: int = RADIUS, pair_bits: int = PAIR_BITS) -> DataFrame:
    """(doc_id, keep_id) of every document with a near duplicate; keep_id is the least doc_id of its group.

    Groups are the connected components of all pairs within ``radius`` and
    ``pair_bits``; every row is compared, whole, whatever its doc_id: rows that
    share an id but not a text are in groups of their own, null ids are in
    groups too and are kept only where all are null.  Repeated rows are near
    duplicates of one another; a doc_id and keep_id appear once.  Texts that are
    null, empty or without a letter or digit are in no group.  An empty table
    gives no rows; only doc_id and text are read.
    """
    return _members(docs, radius, pair_bits).select("doc_id", "keep_id").distinct()


def near_dedup(docs: DataFrame, radius: int = RADIUS, pair_bits: int = PAIR_BITS) -> DataFrame:
    """The rows of ``docs``, with all columns, less every row whose group keeps another one.

    Rows are told by doc_id and text; of repeated rows one stays.  Rows in no
    group (null texts, texts without words) all stay.
    """
    scratch = Scratch(docs.sparkSession, "simhash-lost")
    members = scratch.save(_members(docs, radius, pair_bits), "members")
    lost = scratch.save(members.where("key <> keep_key").select(F.col("key").alias("_lost_key")).distinct(), "lost")
    twice = scratch.save(members.where("key = keep_key").groupBy(F.col("key").alias("_lost_key")).count().where("count > 1").select("_lost_key"), "twice")
    scratch.drop("members")
    left = docs.join(small(lost), row_key(docs) == lost["_lost_key"], "left_anti")
    if not twice.take(1):
        return left
    on = row_key(left) == twice["_lost_key"]
    return left.join(small(twice), on, "left_anti").unionByName(left.join(small(twice), on, "left_semi").dropDuplicates(["doc_id", "text"]))
