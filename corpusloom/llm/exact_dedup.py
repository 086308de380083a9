"""Exact deduplication over a cuckoo-filter index that takes inserts and deletes.

Digests are hashed to buckets.  Each bucket owns a cuckoo filter over its live
digests and the stored keys behind it; a filter hit is looked up in the stored
keys, and only digests that really occur twice send their documents on to be
compared by content.  A bucket's filter that overflows is rebuilt at twice the
size from its stored keys, so no insert is ever refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, partitions_for, small
from corpusloom.session import bound_batches

SLOTS = 4
MAX_KICKS = 64
#: Digests one bucket is planned for; the number of buckets follows the rows.
BUCKET_ROWS = 100_000

#: A filter less full than this doesn't grow for a key that finds no room: such keys, alike in mark and home, go to a stash.
LEAST_LOAD = 0.25

_FIELDS = ["log_size", "cells", "keys", "counts", "stash"]
INDEX_SCHEMA = "bucket int, log_size int, cells binary, keys binary, counts binary, stash binary"


class CuckooFilter:
    """Four-slot cuckoo filter with 16-bit fingerprints; cell value 0 means free.

    ``stored`` maps each live digest to the number of its live copies.  The
    filter answers first, the stored keys confirm; on overflow the cells double
    and are filled again from the stored keys.
    """

    def __init__(self, log_size: int = 6, stored: dict[bytes, int] | None = None):
        self.stored = dict(stored or {})
        self.log_size = log_size
        self.resizes = 0
        while not self._fill():
            self.log_size += 1

    def _fill(self) -> bool:
        self.cells = [0] * (SLOTS << self.log_size)
        self.stash: set[bytes] = set()
        sparse = len(self.stored) < LEAST_LOAD * len(self.cells)
        for key in self.stored:
            if not self._place(key):
                if not sparse:
                    return False
                self.stash.add(key)
        return True

    @staticmethod
    def _mark(key: bytes) -> int:
        return int.from_bytes(key[:2], "little") or 1

    def _home(self, key: bytes) -> int:
        return int.from_bytes(key[2:8], "little") & ((1 << self.log_size) - 1)

    def _other(self, row: int, mark: int) -> int:
        return row ^ ((mark * 0x5BD1E995) & ((1 << self.log_size) - 1))

    def _place(self, key: bytes) -> bool:
        mark, row = self._mark(key), self._home(key)
        cells = self.cells
        for at in (row, self._other(row, mark)):
            for i in range(at * SLOTS, at * SLOTS + SLOTS):
                if not cells[i]:
                    cells[i] = mark
                    return True
        moves = []
        for kick in range(MAX_KICKS):
            i = row * SLOTS + (kick + mark) % SLOTS
            moves.append(i)
            cells[i], mark = mark, cells[i]
            row = self._other(row, mark)
            for i in range(row * SLOTS, row * SLOTS + SLOTS):
                if not cells[i]:
                    cells[i] = mark
                    return True
        for i in reversed(moves):  # as it was: no key that had room loses it
            cells[i], mark = mark, cells[i]
        return False

    def may_contain(self, key: bytes) -> bool:
        mark, row = self._mark(key), self._home(key)
        a, b = row * SLOTS, self._other(row, mark) * SLOTS
        return mark in self.cells[a : a + SLOTS] or mark in self.cells[b : b + SLOTS] or key in self.stash

    def contains(self, key: bytes) -> bool:
        return self.may_contain(key) and key in self.stored

    def insert(self, key: bytes) -> bool:
        """Add one copy; True if the digest was already live."""
        if self.may_contain(key) and key in self.stored:
            self.stored[key] += 1
            return True
        self.stored[key] = 1
        if not self._place(key):
            if len(self.stored) < LEAST_LOAD * len(self.cells):
                self.stash.add(key)
                return False
            self.log_size += 1
            self.resizes += 1
            while not self._fill():
                self.log_size += 1
        return False

    def delete(self, key: bytes) -> bool:
        """Remove one copy; False if the digest isn't live."""
        if not self.contains(key):
            return False
        self.stored[key] -= 1
        if not self.stored[key]:
            del self.stored[key]
            if key in self.stash:
                self.stash.remove(key)
                return True
            mark, row = self._mark(key), self._home(key)
            for at in (row, self._other(row, mark)):
                for i in range(at * SLOTS, at * SLOTS + SLOTS):
                    if self.cells[i] == mark:
                        self.cells[i] = 0
                        return True
        return True

    def to_row(self, bucket: int) -> tuple:
        return (
            bucket,
            self.log_size,
            np.array(self.cells, dtype="<u2").tobytes(),
            b"".join(self.stored),
            np.fromiter(self.stored.values(), dtype="<i8", count=len(self.stored)).tobytes(),
            b"".join(sorted(self.stash)),
        )

    @classmethod
    def from_row(cls, log_size: int, cells: bytes, keys: bytes, counts: bytes, stash: bytes) -> CuckooFilter:
        self = cls.__new__(cls)
        self.log_size, self.resizes = int(log_size), 0
        self.cells = np.frombuffer(cells, dtype="<u2").tolist()
        n = np.frombuffer(counts, dtype="<i8").tolist()
        self.stored = {keys[16 * i : 16 * i + 16]: c for i, c in enumerate(n)}
        self.stash = {stash[i : i + 16] for i in range(0, len(stash), 16)}
        return self


def _digest(text: str = "text"):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def digests(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, digest) of every non-null text."""
    held = docs.where(F.col("text").isNotNull()).select(_digest().alias("digest"))
    return held.select(_bucket(buckets), "digest")


def build_index(docs: DataFrame, buckets: int) -> DataFrame:
    """Index rows, one per non-empty bucket, over the live digests of ``docs``."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter()
        for d in pdf["digest"]:
            f.insert(bytes(d))
        return pd.DataFrame([f.to_row(int(key[0]))], columns=["bucket", *_FIELDS])

    return digests(docs, buckets).groupBy("bucket").applyInPandas(build, INDEX_SCHEMA)


def _change(index: DataFrame, docs: DataFrame, buckets: int, delete: bool) -> DataFrame:
    def change(key: tuple, held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.from_row(*held.iloc[0][_FIELDS]) if len(held) else CuckooFilter()
        act = f.delete if delete else f.insert
        for d in new["digest"]:
            act(bytes(d))
        rows = [f.to_row(int(key[0]))] if f.stored else []
        return pd.DataFrame(rows, columns=["bucket", *_FIELDS])

    return index.groupBy("bucket").cogroup(digests(docs, buckets).groupBy("bucket")).applyInPandas(change, INDEX_SCHEMA)


def insert(index: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    """The index after the texts of ``docs`` joined it, each row as one copy."""
    return _change(index, docs, buckets, False)


def delete(index: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    """The index after one copy per row of ``docs`` left it; texts that aren't live change nothing."""
    return _change(index, docs, buckets, True)


def lookup(index: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    """(digest, copies): live digests among the texts of ``docs``, each once."""

    def find(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held):
            f = CuckooFilter.from_row(*held.iloc[0][_FIELDS])
            out = [(d, f.stored[d]) for d in {bytes(d) for d in asked["digest"]} if f.contains(d)]
        return pd.DataFrame(out, columns=["digest", "copies"])

    return index.groupBy("bucket").cogroup(digests(docs, buckets).groupBy("bucket")).applyInPandas(find, "digest binary, copies bigint")


def _repeated(narrow: DataFrame, buckets: int) -> DataFrame:
    """Digests met more than once, by streaming each bucket's digests through its filter."""

    def hits(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters: dict[int, CuckooFilter] = {}
        again: set[bytes] = set()
        for pdf in pdfs:
            new = []
            for b, d in zip(pdf["bucket"], pdf["digest"], strict=True):
                d = bytes(d)
                f = filters.get(b)
                if f is None:
                    f = filters[b] = CuckooFilter(10)
                if f.insert(d) and d not in again:
                    again.add(d)
                    new.append(d)
            yield pd.DataFrame({"digest": new})

    return narrow.repartition(buckets, "bucket").mapInPandas(hits, "digest binary")


def duplicates(docs: DataFrame) -> DataFrame:
    """Every row of a text that occurs more than once: (doc_id, digest, keep_id, id_rows).

    ``keep_id`` is the smallest doc_id among rows with the same text (nulls are
    smaller than no id, so a null id is kept only if all are null); ``id_rows``
    is the number of rows that repeat this very doc_id and text.  Hits of the
    filter are verified against the texts themselves: equal digests of unequal
    texts stay apart.  Empty texts are equal to one another.  Null texts are
    never duplicates.  An empty table gives no rows; only doc_id and text are
    read, and texts of any length compared whole.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    keyed = docs.select("doc_id", "text").where(F.col("text").isNotNull()).withColumn("digest", _digest())
    buckets = partitions_for(spark, docs.count(), BUCKET_ROWS)
    scratch = Scratch(spark, "exact")
    again = scratch.save(_repeated(keyed.select(_bucket(buckets), "digest"), buckets), "again")
    held = scratch.save(keyed.join(small(again), "digest", "left_semi"), "held")
    same = held.groupBy("digest", "text", "doc_id").agg(F.count("*").alias("id_rows"))
    first = held.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    out = same.join(first.where("n > 1"), ["digest", "text"]).select("doc_id", "digest", "keep_id", "id_rows")
    return scratch.save(out, "duplicates")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, copies_of_id) for every row whose text repeats, one row per doc_id and text."""
    return duplicates(docs).select("doc_id", "keep_id", F.col("id_rows").alias("copies_of_id"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, one per distinct text.

    Of rows with equal text the one with the smallest doc_id stays; of rows that
    repeat both doc_id and text, one stays.  Rows with a null text all stay.
    """
    dup = duplicates(docs)
    lost = dup.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("_lost_id"), F.col("digest").alias("_lost_digest"))
    twice = dup.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("id_rows") > 1)).select(F.col("doc_id").alias("_lost_id"), F.col("digest").alias("_lost_digest"))
    digest = F.unhex(F.md5(docs["text"].cast("binary")))
    on = lambda other: docs["doc_id"].eqNullSafe(other["_lost_id"]) & (digest == other["_lost_digest"])
    left = docs.join(small(lost), on(lost), "left_anti")
    if not twice.take(1):
        return left
    return left.join(twice, on(twice), "left_anti").unionByName(left.join(twice, on(twice), "left_semi").dropDuplicates(["doc_id", "text"]))
