"""Repeated spans of words by compaction of a sparse de Bruijn graph.

A k-mer is an anchor where it is the least of some window of W k-mers (by a
hash; winnowing), so that equal passages have equal anchors.  An edge of the
graph is the run of words from one anchor through the next.  With
2 * W + K <= SPAN + 1 every passage of SPAN words holds a whole edge, and it is
the same edge wherever the passage stands.

1. Edges met once in the corpus are dropped; the rest are the graph.
2. Paths without branches are compacted by pointer-jumping joins, so that each
   edge knows its path and its place in it.
3. Each stretch of a document along one path is an occurrence, with its source
   coordinates.  Where all occurrences of a path are of the same edges, the
   whole stretch is one candidate; windows of SPAN words that stick out of it,
   and all windows of other occurrences, are candidates of their own.
4. Candidates are read again at their coordinates and verified by 128-bit
   hashes of all their words; those met twice are repeated, and their union is
   the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.kernels import run_hashes
from corpusloom.llm.common import Scratch, partitions_for

#: Least words of a repeated span; words of an anchor; k-mers of an anchor's window.
SPAN, K, W = 50, 12, 19
#: Rows that one task of a search for repeats is planned for, and that a task holds before it passes them on.
TASK_ROWS, HELD_ROWS = 1_000_000, 1_000_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


class Roller:
    """Hashes of any run of a text's words, from prefix sums modulo 2^64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, words: np.ndarray, which: int = 0):
        n = len(words)
        up, down = self._powers.get(which, (np.zeros(0, np.uint64),) * 2)
        if len(up) < n + 1:
            size = max(4096, 2 * n + 2)
            base = _BASES[which] | 1
            up, down = (np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
            self._powers[which] = up, down
        self.down = down
        t = words if not which else _mix(words ^ np.uint64(0xA0761D6478BD642F))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t * up[:n], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return _mix(raw ^ ((end - start).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)))


@lru_cache(maxsize=1)
def _solid() -> np.ndarray:
    """Every code point as it is, but a space for all white space."""
    return np.fromiter((32 if chr(c).isspace() else c for c in range(0x110000)), dtype=np.uint32, count=0x110000)


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """Of each text the XXH64 of its runs without white space, as they stand."""
    return run_hashes(texts, _solid())


def edges_of(words: np.ndarray, span: int, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the edges of a text of at least ``span`` words."""
    roll = Roller(words)
    at = np.arange(len(words) - k + 1)
    order = roll(at, at + k)
    picked = len(order) - 1 - np.arange(len(order) - w + 1) - np.lib.stride_tricks.sliding_window_view(order[::-1], w).argmin(axis=1)
    picked = picked[::-1]
    anchors = picked[np.concatenate([[True], picked[1:] != picked[:-1]])]
    start, end = anchors[:-1], anchors[1:] + k
    return start, end, roll(start, end)


def _same(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, the first of each run in it, and the run's number per place in it."""
    order = np.lexsort(keys)
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


#: Rows between the two halves of a search for repeats.
_ALONE, _KNOWN, _TOKEN = 0, 1, 2


def _pass_on(cols: dict[str, np.ndarray], keys: list[str], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows by what their own task knows: met once (sent by key), met again (sent by document), and one token per key met again."""
    order, first, run = _same(*(cols[k] for k in keys))
    again = (np.diff(np.append(first, len(order))) > 1)[run]
    token = order[first][np.diff(np.append(first, len(order))) > 1]
    pick = np.concatenate([order, token])
    kind = np.concatenate([np.where(again, _KNOWN, _ALONE), np.full(len(token), _TOKEN)]).astype(np.int8)
    to = np.where(kind == _KNOWN, _mix(cols["doc"][pick].astype(np.uint64)), cols[keys[0]][pick]) % np.uint64(parts)
    names = ["part", "kind", *cols]
    for i in range(0, len(pick), 100_000):
        s = slice(i, i + 100_000)
        arrays = [pa.array(to[s].astype(np.int32)), pa.array(kind[s])] + [pa.array(c[pick[s]].view(np.int64) if c.dtype == np.uint64 else c[pick[s]]) for c in cols.values()]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _repeats(keys: list[str], out: list[str]):
    """The other half: rows whose key was met twice anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = []
        for b in batches:
            kind = b.column("kind").to_numpy()
            if (kind == _KNOWN).any():
                yield b.filter(pa.array(kind == _KNOWN)).select(out)
            if (kind != _KNOWN).any():
                alone.append(b.filter(pa.array(kind != _KNOWN)))
        if alone:
            t = pa.Table.from_batches(alone).combine_chunks()
            order, first, group = _same(*(t.column(k).to_numpy() for k in keys))
            kind = t.column("kind").to_numpy()[order]
            weight = np.add.reduceat(np.where(kind == _TOKEN, 2, 1), first)
            yield from t.select(out).take(pa.array(order[(weight[group] > 1) & (kind == _ALONE)])).to_batches(max_chunksize=100_000)

    return run


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_L, _I = T.LongType(), T.IntegerType()


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, more, doc_id, text): rows with the same doc_id and text share a key of 96 bits, doc and more, and so a result."""
    i = F.col("doc_id").cast("string")
    return docs.where(F.col("text").isNotNull()).select(F.xxhash64(i, "text").alias("doc"), F.hash("text", i, F.lit("more")).alias("more"), "doc_id", "text")


def repeated_edges(keyed: DataFrame, parts: int, span: int, k: int, w: int) -> DataFrame:
    """(doc, more, i, s, e, h): edges whose words occur at least twice."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            c = {n: np.concatenate([x[j] for x in held]) for j, n in enumerate(("doc", "more", "i", "s", "e", "h"))}
            yield from _pass_on(c, ["h"], parts)

        for b in batches:
            for doc, more, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), word_hashes(b.column(2).to_pylist()), strict=True):
                if len(words) >= span:
                    s, e, h = edges_of(words, span, k, w)
                    held.append((np.full(len(s), doc, np.int64), np.full(len(s), more, np.int32), np.arange(len(s), dtype=np.int32), s.astype(np.int32), e.astype(np.int32), h))
                    size += len(s)
                    if size > HELD_ROWS:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    sent = keyed.select("doc", "more", "text").mapInArrow(emit, _schema(part=_I, kind=T.ByteType(), doc=_L, more=_I, i=_I, s=_I, e=_I, h=_L))
    out = ["doc", "more", "i", "s", "e", "h"]
    return sent.repartitionById(parts, F.col("part")).mapInArrow(_repeats(["h"], out), _schema(doc=_L, more=_I, i=_I, s=_I, e=_I, h=_L))


def compact(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, path, idx): the branchless path of each repeated edge, named by its first edge, and the place in it.

    Pointer jumping: each round doubles the stretch that an edge knows before
    it.  An edge on a circle without a beginning is a path of its own.
    """
    w = Window.partitionBy("doc", "more").orderBy("i")
    after = edges.select("h", "i", F.lead("h").over(w).alias("n"), F.lead("i").over(w).alias("ni")).where("ni = i + 1")
    pairs = scratch.save(after.groupBy("h", "n").agg(F.lit(1).alias("one")).drop("one"), "pairs")
    only_next = pairs.groupBy("h").agg(F.count("*").alias("c"), F.min("n").alias("n")).where("c = 1")
    only_prev = pairs.groupBy("n").agg(F.count("*").alias("c"), F.min("h").alias("h")).where("c = 1")
    link = only_next.select("h", "n").join(only_prev.select("h", "n"), ["h", "n"]).where("h <> n")
    all_edges = edges.select("h").distinct()
    at = all_edges.join(link.select(F.col("n").alias("h"), F.col("h").alias("up")), "h", "left")
    at = scratch.save(at.select("h", F.coalesce("up", "h").alias("top"), F.col("up").isNotNull().cast("int").alias("idx"), F.col("up").isNotNull().alias("open")), "path-0")
    rounds, left = 0, 0
    while True:
        going = at.where("open")
        was, left = left, going.count()
        # a path with a beginning gives up some of its edges in every round: those that no longer change go in circles
        if left in (0, was):
            break
        b = at.select(F.col("h").alias("top"), F.col("top").alias("_top"), F.col("idx").alias("_idx"), F.col("open").alias("_open"))
        step = going.join(b, "top").select("h", F.col("_top").alias("top"), (F.col("idx") + F.col("_idx")).alias("idx"), F.col("_open").alias("open"))
        rounds += 1
        at = scratch.save(at.where("NOT open").unionByName(step), f"path-{rounds}")
        scratch.drop(f"path-{rounds - 1}")
    return at.select("h", F.when(F.col("open"), F.col("h")).otherwise(F.col("top")).alias("path"), F.when(F.col("open"), 0).otherwise(F.col("idx")).alias("idx"))


def occurrences(edges: DataFrame, paths: DataFrame, scratch: Scratch, span: int) -> DataFrame:
    """(doc, more, lo, hi, s, e): per stretch along a path, the range of window starts that hold an edge of it, and, if all
    occurrences of the path are of the same edges, the words s to e that it covers (else null)."""
    on = edges.join(paths, "h")
    runs = on.groupBy("doc", "more", "path", (F.col("i") - F.col("idx")).alias("shift")).agg(
        F.min("idx").alias("a"), F.max("idx").alias("b"), F.min("s").alias("s"), F.max("e").alias("e"), (F.min("e") - span).alias("lo"), F.max("s").alias("hi"),
    )
    runs = scratch.save(runs, "runs")
    even = runs.groupBy("path").agg(F.count("*").alias("c"), F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    even = even.where("c > 1 AND a0 = a1 AND b0 = b1").select("path", F.lit(True).alias("even"))
    out = runs.join(even, "path", "left")
    whole = F.col("even") & (F.col("e") - F.col("s") >= span)
    return out.select("doc", "more", "lo", "hi", F.when(whole, F.col("s")).alias("s"), F.when(whole, F.col("e")).alias("e"))


def candidates_of(n: int, ranges: list[tuple[int, int, int | None, int | None]], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the candidates in a text of ``n`` words: windows, then whole stretches."""
    want = np.zeros(max(0, n - span + 1), dtype=bool)
    for lo, hi, s, e in ranges:
        if s is None:
            want[max(0, lo) : hi + 1] = True
        else:
            want[max(0, lo) : s] = True
            want[e - span + 1 : hi + 1] = True
    at = np.flatnonzero(want)
    whole = [(s, e) for _, _, s, e in ranges if s is not None]
    return np.concatenate([at, np.array([s for s, _ in whole], dtype=np.int64)]), np.concatenate([at + span, np.array([e for _, e in whole], dtype=np.int64)])


def verified(keyed: DataFrame, ranges: DataFrame, parts: int, span: int) -> DataFrame:
    """(doc, more, s, e): candidates whose words occur at least twice."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            c = {n: np.concatenate([x[j] for x in held]) for j, n in enumerate(("doc", "more", "s", "e", "h1", "h2"))}
            yield from _pass_on(c, ["h1", "h2"], parts)

        for b in batches:
            for doc, more, words, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), word_hashes(b.column(2).to_pylist()), b.column(3).to_pylist(), strict=True):
                s, e = candidates_of(len(words), [(x["lo"], x["hi"], x["s"], x["e"]) for x in r], span)
                h1, h2 = Roller(words)(s, e), Roller(words, 1)(s, e)
                h1[len(s) - sum(x["s"] is not None for x in r) :] ^= np.uint64(0x8EBC6AF09C88C6E3)  # whole stretches are compared with their like
                held.append((np.full(len(s), doc, np.int64), np.full(len(s), more, np.int32), s.astype(np.int32), e.astype(np.int32), h1, h2))
                size += len(s)
                if size > HELD_ROWS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    per = ranges.groupBy("doc", "more").agg(F.collect_list(F.struct("lo", "hi", "s", "e")).alias("ranges"))
    sent = keyed.select("doc", "more", "text").join(per, ["doc", "more"]).select("doc", "more", "text", "ranges")
    sent = sent.mapInArrow(emit, _schema(part=_I, kind=T.ByteType(), doc=_L, more=_I, s=_I, e=_I, h1=_L, h2=_L))
    return sent.repartitionById(parts, F.col("part")).mapInArrow(_repeats(["h1", "h2"], ["doc", "more", "s", "e"]), _schema(doc=_L, more=_I, s=_I, e=_I))


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    doc, more, s, e = (t.column(c).to_numpy() for c in ("doc", "more", "s", "e"))
    order = np.lexsort((e, s, more, doc))
    doc, more, s, e = doc[order], more[order], s[order].astype(np.int64), e[order].astype(np.int64)
    own = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (more[1:] != more[:-1])])) - 1
    far = np.maximum.accumulate(own * (1 << 33) + e)  # ends so far, within a document
    new = np.concatenate([[True], own[1:] * (1 << 33) + s[1:] > far[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(more[first]), pa.array(s[first].astype(np.int32)), pa.array((far[last] - own[last] * (1 << 33)).astype(np.int32))], ["doc", "more", "s", "e"])


def repeated_spans(docs: DataFrame, span: int = SPAN, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the words that lie in a passage of ``span`` words met more than once.

    Words are runs without white space, counted from 0; end_word is exclusive;
    spans of one document neither touch nor overlap.  A passage counts as met
    again in another row or elsewhere in its own.  Rows with equal doc_id and
    text are copies of each other and give one set of spans.  Null texts and
    texts of fewer than ``span`` words have none; others are read whole, however
    long.  A null doc_id is reported as null, an id shared by unlike texts with the
    spans of each, an empty table gives no rows; only doc_id and text are read.
    """
    if 2 * w + k > span + 1:
        raise ValueError("a passage of `span` words must hold two windows of `w` k-mers")
    spark = docs.sparkSession
    scratch = Scratch(spark, "spans")
    keyed = _keyed(docs)
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions_for(spark, size // 60, TASK_ROWS)
    edges = scratch.save(repeated_edges(keyed, parts, span, k, w), "edges")
    paths = compact(edges, scratch)
    ranges = occurrences(edges, paths, scratch, span)
    found = verified(keyed, ranges, parts, span)
    spans = scratch.save(found.repartition(parts, "doc").mapInArrow(_union, _schema(doc=_L, more=_I, s=_I, e=_I)), "spans")
    names = keyed.select("doc", "more", "doc_id").distinct()
    return spans.join(names, ["doc", "more"]).select("doc_id", F.col("s").alias("start_word"), F.col("e").alias("end_word"), (F.col("e") - F.col("s")).alias("n_words"))
