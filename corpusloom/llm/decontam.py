"""Benchmark decontamination over a distributed positional inverted index.

Training texts are indexed in segments of about a million tokens.  A segment
holds every term's positions, in blocks of terms, so that a query reads blocks
and not texts; segments share no document, so that each answers for itself and
nothing is shuffled but the postings of test terms.

An item is looked for from its rarest terms.  Every window of ``n`` item tokens
has a rarest one; each of its postings, moved back by its offset in the item,
is a place where the window may stand, and postings of the neighbouring terms
confirm or refute it token by token.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import Scratch, row_key, small
from corpusloom.llm.simhash_dedup import WORD
from corpusloom.session import bound_batches

#: Tokens that must follow one another in a phrase match; a shorter item must occur whole.
PHRASE = 13
#: All items are looked for and reported; those of fewer tokens stand in clean text too, so that a match of them alone removes no document.
LEAST = 5
#: Proximity: so many rarest distinct terms, the share that must meet, and the window in item lengths.  Of items with fewer distinct terms all must meet.
RAREST, SHARE, SPREAD = 10, 0.8, 1.5
SEGMENT_TOKENS = 1_000_000
BLOCKS = 64
#: Test texts that one pass holds; beyond it items are looked for in several passes.
PASS_BYTES = 32 << 20


def terms_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(texts: pd.Series) -> pd.Series:
    return texts.map(terms_of)


def _block(term: str) -> int:
    return zlib.crc32(term.encode()) % BLOCKS


def index_schema(docs: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("seg", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("terms", T.StringType()),
        T.StructField("counts", T.BinaryType()), T.StructField("positions", T.BinaryType()),
        T.StructField("docs", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("starts", T.BinaryType()),
    ])


class _Segment:
    def __init__(self):
        self.vocabulary: dict[str, int] = defaultdict(count().__next__)  # refers to no part of itself, so that a segment goes as soon as it is written
        self.ids: list[np.ndarray] = []
        self.docs: list = []
        self.starts: list[int] = []
        self.size = 0

    def add(self, doc, words: list[str]) -> None:
        self.docs.append(doc)
        self.starts.append(self.size)
        self.ids.append(np.fromiter(map(self.vocabulary.__getitem__, words), dtype=np.int32, count=len(words)))
        self.size += len(words) + 1  # a free place parts documents

    def rows(self, seg: str) -> dict[str, list]:
        words = list(self.vocabulary)
        blocks = np.fromiter(map(_block, words), dtype=np.int32, count=len(words))
        order = np.argsort(blocks, kind="stable")
        new = np.empty(len(words), dtype=np.int32)
        new[order] = np.arange(len(words), dtype=np.int32)
        ids = new[np.concatenate(self.ids)] if self.ids else np.empty(0, np.int32)
        at = np.concatenate([np.arange(s, s + len(i), dtype=np.int32) for s, i in zip(self.starts, self.ids, strict=True)])
        by = np.argsort(ids, kind="stable")
        counts = np.bincount(ids, minlength=len(words)).astype(np.int32)
        at, ends = at[by], np.cumsum(counts)
        step = np.diff(at, prepend=0)
        step[(ends - counts)[counts > 0]] = at[(ends - counts)[counts > 0]]
        out: dict[str, list] = {k: [] for k in ("seg", "block", "terms", "counts", "positions", "docs", "starts")}
        first = 0
        for b, n in enumerate(np.bincount(blocks, minlength=BLOCKS).tolist()):
            if n:
                lo, hi = int(ends[first] - counts[first]), int(ends[first + n - 1])
                for k, v in zip(out, (seg, b, "\n".join(words[i] for i in order[first : first + n]), counts[first : first + n].tobytes(), step[lo:hi].astype(np.int32).tobytes(), None, None), strict=True):
                    out[k].append(v)
            first += n
        for k, v in zip(out, (seg, -1, None, None, None, self.docs, np.array(self.starts, dtype=np.int32).tobytes()), strict=True):
            out[k].append(v)
        return out


def build_index(docs: DataFrame, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Postings of all tokens of all texts; null and empty texts have none."""
    schema = index_schema(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, arrow = TaskContext.get().partitionId(), 0, _Segment(), None

        def flush() -> pa.RecordBatch:
            rows = held.rows(f"{part}-{n}")
            kinds = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.list_(arrow), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))

        for b in batches:
            arrow = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = terms_of(text.as_py())
                if words:
                    held.add(doc, words)
                    if held.size >= segment_tokens:
                        yield flush()
                        n, held = n + 1, _Segment()
        if held.docs:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _items(benchmark: DataFrame) -> list[tuple[object, list[str]]]:
    got = [(r[0], terms_of(r[1])) for r in benchmark.select("item_id", "text").distinct().collect()]
    return [(i, w) for i, w in got if w]


def term_counts(index: DataFrame, wanted: set[str]) -> dict[str, int]:
    """Corpus frequency of the test terms, read from the index without its positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            for terms, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t, c in zip(terms.split("\n"), np.frombuffer(counts, dtype=np.int32).tolist(), strict=True):
                    if t in wanted:
                        seen[t] = seen.get(t, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    blocks = sorted({_block(t) for t in wanted})
    rows = index.where(F.col("block").isin(blocks)).select("terms", "counts").mapInArrow(run, "term string, n bigint")
    return {r[0]: r[1] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def probes(tokens: list[int], freq: np.ndarray, n: int) -> list[int]:
    """Offsets of the rarest token of every window of n item tokens (the last of equals)."""
    f = freq[tokens]
    if len(tokens) <= n:
        return [len(f) - 1 - int(np.argmin(f[::-1]))]
    w = np.lib.stride_tricks.sliding_window_view(f[::-1], n)
    return sorted({len(f) - 1 - (i + int(a)) for i, a in enumerate(w.argmin(axis=1))})


class Query:
    """Items as term numbers, with their probes and rarest terms."""

    def __init__(self, items: list[tuple[object, list[str]]], freq: dict[str, int], n: int = PHRASE):
        self.n = n
        self.terms = {t: i for i, t in enumerate(sorted({t for _, w in items for t in w}))}
        f = np.array([freq.get(t, 0) for t in self.terms], dtype=np.int64)
        self.ids = [i for i, _ in items]
        self.tokens = [np.array([self.terms[t] for t in w], dtype=np.int32) for _, w in items]
        self.length = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64) if items else np.zeros(0, np.int64)
        self.flat = np.concatenate(self.tokens) if items else np.zeros(0, np.int32)
        self.probes = defaultdict(list)  # term -> (item, offset)
        self.rare = []
        for k, t in enumerate(self.tokens):
            for o in probes(t, f, n):
                self.probes[int(t[o])].append((k, o))
            own = sorted(set(t.tolist()), key=lambda x: (f[x], x))
            self.rare.append(own[:RAREST])

    def search(self, postings: dict[int, np.ndarray], size: int, starts: np.ndarray) -> list[tuple[int, int, str, int, int | None, int, int]]:
        """(document, item, kind, doc_start, item_start, n_tokens, matched) in one segment."""
        if not postings:
            return []
        view = np.full(size + 1, -1, dtype=np.int32)
        for t, p in postings.items():
            view[p] = t
        item, off, pos = [], [], []
        for t, places in self.probes.items():
            p = postings.get(t)
            if p is not None:
                for k, o in places:
                    item.append(np.full(len(p), k))
                    off.append(np.full(len(p), o))
                    pos.append(p)
        out: list[tuple[int, int, str, int, int | None, int, int]] = []
        if item:
            k, o, p = (np.concatenate(x).astype(np.int64) for x in (item, off, pos))
            left, right = self._reach(view, k, o, p, -1), self._reach(view, k, o, p, 1)
            run = left + right + 1
            good = run >= np.minimum(self.n, self.length[k])
            d, i, r, k = (p - left)[good], (o - left)[good], run[good], k[good]
            doc = np.searchsorted(starts, d, side="right") - 1
            for x in sorted(set(zip(doc.tolist(), k.tolist(), (d - starts[doc]).tolist(), i.tolist(), r.tolist(), strict=True))):
                out.append((x[0], x[1], "phrase", x[2], x[3], x[4], x[4]))
        for k, rare in enumerate(self.rare):
            out += self._near(k, rare, postings, starts)
        return out

    def _reach(self, view: np.ndarray, k: np.ndarray, o: np.ndarray, p: np.ndarray, way: int) -> np.ndarray:
        reach, live, step = np.zeros(len(p), dtype=np.int64), np.arange(len(p)), 0
        while len(live):
            step += 1
            i, q = o[live] + way * step, p[live] + way * step
            ok = (i >= 0) & (i < self.length[k[live]]) & (q >= 0) & (q < len(view))
            live, i, q = live[ok], i[ok], q[ok]
            same = view[q] == self.flat[self.at[k[live]] + i]
            live = live[same]
            reach[live] = step
        return reach

    def _near(self, k: int, rare: list[int], postings: dict[int, np.ndarray], starts: np.ndarray) -> list[tuple]:
        need = int(np.ceil(SHARE * len(rare))) if len(rare) == RAREST else len(rare)
        lists = [postings[t] for t in rare if t in postings]
        if not rare or len(lists) < need:
            return []
        at = np.sort(np.concatenate(lists)).astype(np.int64)
        doc = np.searchsorted(starts, at, side="right") - 1
        floor = np.maximum(at - int(SPREAD * self.length[k]) + 1, starts[doc])
        met, first = np.zeros(len(at), dtype=np.int64), at.copy()
        for p in lists:
            i = np.searchsorted(p, at, side="right") - 1
            last = np.where(i >= 0, p[i], -1).astype(np.int64)
            inside = last >= floor
            met += inside
            first = np.where(inside, np.minimum(first, last), first)
        out, good = [], np.flatnonzero(met >= need)
        # windows that overlap are one place; of each, the best window is reported
        new = np.concatenate([[True], first[good[1:]] > at[good[:-1]]]) if len(good) else np.zeros(0, dtype=bool)
        for part in np.split(good, np.flatnonzero(new)[1:]):
            if len(part):
                j = max(part.tolist(), key=lambda j: (met[j], first[j] - at[j], -first[j]))
                d = int(doc[j])
                out.append((d, k, "proximity", int(first[j] - starts[d]), None, int(at[j] - first[j]) + 1, int(met[j])))
        return out


def match_schema(docs: DataFrame, benchmark: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType),
        T.StructField("kind", T.StringType()), T.StructField("doc_start", T.LongType()), T.StructField("item_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("matched", T.LongType()),
    ])


def search_index(index: DataFrame, items: list[tuple[object, list[str]]], schema: T.StructType, n: int = PHRASE) -> DataFrame:
    """Matches of the items in an index; see :func:`matches`."""
    wanted = {t for _, w in items for t in w}
    query = Query(items, term_counts(index, wanted), n)
    blocks = sorted({_block(t) for t in wanted})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seg", "terms", "counts", "positions", "docs", "starts"]
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["terms"] is not None:
                    counts = np.frombuffer(r["counts"], dtype=np.int32)
                    ends, step = np.cumsum(counts), np.frombuffer(r["positions"], dtype=np.int32)
                    hit = [(i, query.terms[t]) for i, t in enumerate(r["terms"].split("\n")) if t in query.terms]
                    if not hit:
                        continue
                    r = r | {"terms": np.array([t for _, t in hit], dtype=np.int32).tobytes(), "counts": counts[[i for i, _ in hit]].tobytes(), "positions": b"".join(step[ends[i] - counts[i] : ends[i]].tobytes() for i, _ in hit)}
                rows.append(r)
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary(), b.schema.field("docs").type, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        postings, docs, starts, size = {}, [], np.zeros(0, np.int32), 0
        for r in pdf.itertuples():
            if r.terms is None:
                docs, starts = r.docs, np.frombuffer(r.starts, dtype=np.int32)
                continue
            counts, step, at = np.frombuffer(r.counts, dtype=np.int32), np.frombuffer(r.positions, dtype=np.int32), 0
            for t, c in zip(np.frombuffer(r.terms, dtype=np.int32).tolist(), counts.tolist(), strict=True):
                postings[t] = np.cumsum(step[at : at + c], dtype=np.int32)
                size = max(size, int(postings[t][-1]))
                at += c
        found = query.search(postings, size, starts)
        out = pd.DataFrame(found, columns=["d", "k", "kind", "doc_start", "item_start", "n_tokens", "matched"])
        out.insert(0, "doc_id", [docs[d] for d in out.pop("d")])
        out.insert(1, "item_id", [query.ids[k] for k in out.pop("k")])
        out["item_start"] = out["item_start"].astype("Int64")
        return out

    kinds = {f.name: f.dataType for f in index.schema}
    narrow = T.StructType([T.StructField("seg", T.StringType()), *(T.StructField(c, T.BinaryType()) for c in ("terms", "counts", "positions")), T.StructField("docs", kinds["docs"]), T.StructField("starts", T.BinaryType())])
    rows = index.where(F.col("block").isin([-1, *blocks])).select("seg", "terms", "counts", "positions", "docs", "starts")
    return rows.mapInArrow(fetch, narrow).groupBy("seg").applyInPandas(search, schema)


def matches(docs: DataFrame, benchmark: DataFrame, n: int = PHRASE) -> DataFrame:
    """(doc_id, item_id, kind, doc_start, item_start, n_tokens, matched), each match once.

    Tokens are lower-cased runs of letters and digits.  ``phrase``: the longest
    run of item tokens from item_start that stands in the document at doc_start,
    of at least ``n`` tokens or the whole of a shorter item.  ``proximity``: at
    least 8 of the item's 10 rarest terms, or all terms of an item with fewer,
    in a window of 1.5 item lengths; such windows that overlap are one place, and
    of each place the window with most terms, then the shortest, then the first
    is reported; item_start is null.  Every item with a token is looked for.
    Null and empty texts match nothing, texts of any length are searched whole;
    repeated rows of either table give their matches once; a null doc_id is
    reported as null.  If either table is empty there are no rows; other columns
    than doc_id, item_id and text are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch, schema = Scratch(spark, "decontam"), match_schema(docs, benchmark)
    held = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-held // PASS_BYTES))
    index, found = None, []
    for k in range(passes):
        items = _items(benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k))
        if items:
            index = scratch.save(build_index(docs), "index") if index is None else index
            found.append(scratch.save(search_index(index, items, schema, n), f"found-{k}"))
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = PHRASE, least: int = LEAST) -> DataFrame:
    """The rows of ``docs``, with all columns, that match no item of at least ``least`` tokens.

    Rows are told by doc_id and text, so that neither null nor shared ids keep a
    contaminated row or lose a clean one; repeated rows go or stay together.
    Rows with a null or empty text stay.
    """
    keyed = docs.select(row_key(docs).alias("doc_id"), "text")
    long = benchmark.select("item_id", "text").where(F.size(_tokens("text")) >= least)
    hit = Scratch(docs.sparkSession, "decontam-hit").save(matches(keyed, long, n).select(F.col("doc_id").alias("_hit_key")).distinct(), "hit")
    return docs.join(small(hit), row_key(docs) == hit["_hit_key"], "left_anti")
