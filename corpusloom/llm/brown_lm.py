"""Brown class-based bigram model: P(w | v) = P(class w | class v) P(w | class w).

Every word has a count, a class and an emission of its own.  Texts are read once:
chunks of some 500,000 tokens carry the numbers of their words and a dictionary
of their own, and all that follows goes over chunks.

The HEAD most frequent words, at most 65,536, are what driver and tasks hold.
Of them the first few hundred are clustered by exchange one at a time: each in
turn moves to the class that raises the likelihood of the corpus's class bigrams
most, until none moves.  Then all of the head are exchanged in sweeps over a
table of their bigrams, half of them at once, and a sweep is kept if the
likelihood rises by it.  All other words, however many, stay in a table with
their bigrams beside classes: each joins the class that raises the likelihood
most and is exchanged in a sweep of its own; one that is never beside a word of
the head is of a class of such words.  Their classes return to the chunks by a
join.  Transitions are then counted over the whole corpus and
smoothed towards the frequency of classes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import Scratch, partitions_for
from corpusloom.llm.simhash_dedup import _letters

#: Classes at least; they grow with the words as words ** GROWTH.
CLASSES, GROWTH = 32, 0.27
#: Words clustered one at a time before all are exchanged (more if classes need them), rounds of that, and sweeps over the head and over all other words at most.
CORE, ROUNDS, SWEEPS, TAIL_SWEEPS = 512, 20, 4, 1
#: Words whose bigrams with one another are tabled and whose classes are broadcast; two bytes number them.
HEAD = 1 << 16
#: Words with as many neighbours move by the exact gain, rarer ones by its derivative.
EXACT = 128
#: Counts added: to a transition in all, to each word within its class.
PRIOR, EMISSION = 16.0, 0.5
CHUNK = 1 << 19
#: Words that are compared with all classes at a time.
_BLOCK = 8192
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


_ASCII = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def _words(text: str) -> list[str]:
    """What WORD finds in the lower-cased text."""
    if text.isascii():
        return text.lower().encode().translate(_ASCII).decode().split()
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _letters()[codes].tobytes().decode("utf-32-le", "surrogatepass").split()


def chunks(docs: DataFrame, tokens: int = CHUNK) -> DataFrame:
    """(chunk, docs, ends, ids, words, counts): texts as numbers of words of the chunk's dictionary; document i ends before ``ends[i]``.

    Words are lower-cased runs of letters and digits; null and empty texts have none.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("docs", T.ArrayType(kind)), T.StructField("ends", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, arrow = TaskContext.get().partitionId(), 0, None
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        held, names, ends, size = [], [], [], 0

        def pack() -> pa.RecordBatch:
            ids = np.concatenate([*held, np.zeros(0, np.int32)])
            counts = np.bincount(ids, minlength=len(number))
            row = [[part << 32 | n], [names], [np.array(ends, np.int32).tobytes()], [ids.astype(np.int32).tobytes()], [list(number)], [counts]]
            kinds = [pa.int64(), pa.list_(arrow), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [f.name for f in schema])

        for b in batches:
            arrow = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    found = _words(text)
                    held.append(np.fromiter(map(number.__getitem__, found), dtype=np.int32, count=len(found)))
                    size += len(found)
                names.append(doc)
                ends.append(size)
                if size >= tokens:
                    yield pack()
                    held, names, ends, size, n = [], [], [], 0, n + 1
                    number.clear()
        if names:
            yield pack()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def most_frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """The ``most`` most frequent words of (word, n), of equals those with the least hash; most frequent first.

    Histograms of counts, and of the hashes of words tied at the cut, find where
    they end, so that the driver is sent these words and a few that share the
    last hash bucket.
    """
    hist = counts.groupBy("n").agg(F.count("*").alias("words")).toPandas().sort_values("n", ascending=False)
    reach = hist["words"].cumsum().to_numpy()
    bucket = F.shiftrightunsigned(F.xxhash64("word"), 44)
    held = counts
    if len(reach) and reach[-1] > most:
        at = int(np.searchsorted(reach, most))
        least, before = int(hist["n"].iloc[at]), int(reach[at - 1]) if at else 0
        tied = counts.where(F.col("n") == least).groupBy(bucket.alias("b")).agg(F.count("*").alias("words")).toPandas().sort_values("b")
        cut = int(tied["b"].iloc[int(np.searchsorted(tied["words"].cumsum().to_numpy(), most - before))])
        held = counts.where((F.col("n") > least) | ((F.col("n") == least) & (bucket <= cut)))
    order = held.withColumn("h", F.xxhash64("word")).toPandas()
    order["h"] = order["h"].to_numpy().view(np.uint64)
    return order.sort_values(["n", "h", "word"], ascending=[False, True, True], kind="stable").head(most)[["word", "n"]]


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(m: np.ndarray) -> float:
    """Of class bigrams, less what no clustering changes."""
    return float(_phi(m).sum() - _phi(m.sum(axis=1)).sum() - _phi(m.sum(axis=0)).sum())


def _gain(m: np.ndarray, a: int, right: np.ndarray, left: np.ndarray, own: float, phi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of moving a word of class ``a`` to each class, up to a constant, and ``m`` without the word; ``own`` counts the word beside itself, ``phi`` is that of ``m``."""
    base = m.copy()
    base[a] -= right
    base[:, a] -= left
    base[a, a] -= own
    rows, cols = base.sum(axis=1), base.sum(axis=0)
    held = _phi(m) if phi is None else phi.copy()
    held[a], held[:, a] = _phi(base[a]), _phi(base[:, a])
    # row b gains right, column b gains left, cell (b, b) gains both and own
    gain = (_phi(base + right[None, :]) - held).sum(axis=1) + (_phi(base + left[:, None]) - held).sum(axis=0)
    d = np.diag(base)
    gain += _phi(d + right + left + own) - _phi(d + right) - _phi(d + left) + _phi(d)
    gain -= _phi(rows + right.sum() + own) + _phi(cols + left.sum() + own) - _phi(rows) - _phi(cols)
    # every other row gains left, every other column right
    for grown in (_phi(rows + left) - _phi(rows), _phi(cols + right) - _phi(cols)):
        gain -= grown.sum() - grown
    gain += _phi(rows + right.sum() + own) - _phi(rows + right.sum() + own + left)
    gain += _phi(cols + left.sum() + own) - _phi(cols + left.sum() + own + right)
    return gain, base


def exchange(counts: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each word from their bigram counts; the likelihood never falls from one move to the next."""
    n = len(counts)
    k = max(1, min(classes, n))
    c = np.arange(n) % k
    one = np.eye(k)[c]
    w = counts.astype(np.float64)
    m = one.T @ w @ one
    for _ in range(rounds):
        moved = 0
        for i in range(n):
            a = c[i]
            right = np.bincount(c, weights=w[i], minlength=k)
            left = np.bincount(c, weights=w[:, i], minlength=k)
            own = w[i, i]
            right[a] -= own
            left[a] -= own
            gain, base = _gain(m, a, right, left, own)
            b = int(np.argmax(gain))
            if b != a and gain[b] <= gain[a] + 1e-9 * abs(gain[a]):
                b = a
            base[b] += right
            base[:, b] += left
            base[b, b] += own
            m, c[i] = base, b
            moved += b != a
        if not moved:
            break
    return c


def _packed(name: str, *kinds: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.LongType()), *(T.StructField(k, T.BinaryType()) for k in kinds)])


def _cut(part: np.ndarray, cols: dict[str, np.ndarray], name: str) -> pa.RecordBatch:
    """A row for each value of ``part``, with its entries of the columns packed."""
    order = np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")  # two bytes are sorted by digits
    part = part[order]
    start = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(start, len(part))
    out = [pa.array(part[start].astype(np.int64), pa.int64())]
    for c in cols.values():
        c = c[order]
        out.append(pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((ends * c.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c))]))
    return pa.RecordBatch.from_arrays(out, [name, *cols])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    bits, kind = int(n.max()).bit_length(), keys.dtype
    if int(keys.max()).bit_length() + bits < 64:  # both in one number, which is sorted in place
        both = keys.astype(np.int64) << bits | n
        both.sort()
        keys, n = (both >> bits).astype(kind), both & ((1 << bits) - 1)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _inside(ends: bytes, size: int) -> np.ndarray:
    """Whether a token and the next one are of one text."""
    same = np.ones(max(0, size - 1), dtype=bool)
    e = np.frombuffer(ends, np.int32)
    same[e[(e > 0) & (e < size)] - 1] = False
    return same


def neighbours(coded: DataFrame, words: list[str], tokens: int) -> DataFrame:
    """Blocks of the bigrams among ``words``, all of a word's in one block: its number, and of each side how many others it has, which, and counts.

    Others follow the word on side 0 and precede it on side 1; a pass that needs
    one side reads no other.  Counts are added up by pair first, so that no task
    gets what all others found of a frequent word, and then gathered by word.
    """
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast(pa.array(words, pa.string()))
    many = partitions_for(spark, tokens, 4_000_000)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        keys, sums, held, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

        def fold():
            k = np.concatenate([keys, *(x[0] for x in held)])
            return _summed(k, np.concatenate([sums, *(x[1] for x in held)]))

        for b in batches:
            for ends, ids, own in zip(*(b.column(i) for i in range(3)), strict=True):
                seq = _head_ids(head, own)[np.frombuffer(ids.as_py(), np.int32)]
                x, y = seq[:-1], seq[1:]
                good = (x >= 0) & (y >= 0) & _inside(ends.as_py(), len(seq))
                u, c = np.unique(x[good].astype(np.uint32) << np.uint32(16) | y[good].astype(np.uint32), return_counts=True)
                held.append((u, c.astype(np.int64)))
                size += len(u)
                if size > 2_000_000:
                    keys, sums = fold()
                    held, size = [], 0
                    if len(keys) > 4_000_000:
                        yield out(keys, sums)
                        keys, sums = keys[:0], sums[:0]
        if held or len(keys):
            yield out(*fold())

    def out(keys, sums):
        return _cut((keys.astype(np.uint64) * _SPREAD >> np.uint64(33)).astype(np.int64) % many, {"pair": keys, "n": sums}, "part")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n = _flat(batches, {"pair": np.uint32, "n": np.int64})
        k, n = _summed(k, n)
        x, y = (k >> np.uint32(16)).astype(np.uint16), (k & np.uint32(0xFFFF)).astype(np.uint16)
        for side, w, o in ((0, x, y), (1, y, x)):
            if len(w):
                yield _cut((w.astype(np.uint64) * _SPREAD >> np.uint64(33)).astype(np.int64) % many, {"word": w, "side": np.full(len(w), side, np.uint8), "other": o, "n": n}, "part")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, side, o, n = _flat(batches, {"word": np.uint16, "side": np.uint8, "other": np.uint16, "n": np.int64})
        order = np.lexsort((o, side, w))
        w, side, o, n = w[order], side[order], o[order], n[order]
        start = np.flatnonzero(np.diff(w.astype(np.int64), prepend=-1))[::1024].tolist()
        for i, j in zip(start, [*start[1:], len(w)], strict=True):
            first = np.flatnonzero(np.diff(w[i:j].astype(np.int64), prepend=-1))
            row = [w[i:j][first]]
            for s in (0, 1):
                on = side[i:j] == s
                times = n[i:j][on]
                row += [np.add.reduceat(on, first, dtype=np.int32), o[i:j][on], times.astype(np.uint32) if times.max(initial=0) < 1 << 32 else times]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in row], list(_BLOCKS))

    found = coded.select("ends", "ids", "words").mapInArrow(pieces, _packed("part", "pair", "n"))
    sides = found.repartitionById(many, F.col("part").cast("int")).select("pair", "n").mapInArrow(both, _packed("part", "word", "side", "other", "n"))
    return sides.repartitionById(many, F.col("part").cast("int")).select("word", "side", "other", "n").mapInArrow(blocks, T.StructType([T.StructField(c, T.BinaryType()) for c in _BLOCKS]))


def _head_ids(head: pa.Array, words: pa.ListScalar) -> np.ndarray:
    """The number of each word in the head, -1 if it is not there."""
    return pc.index_in(words.values, value_set=head.cast(words.values.type)).fill_null(-1).to_numpy(zero_copy_only=False)


def _flat(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> list[np.ndarray]:
    got: dict[str, list[bytes]] = {k: [] for k in kinds}
    for b in batches:
        for k in kinds:
            got[k] += b.column(k).to_pylist()
    return [np.frombuffer(b"".join(got[k]), dtype=d) for k, d in kinds.items()]


_BLOCKS = ("word", "many0", "other0", "n0", "many1", "other1", "n1")


def _entries(b: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    """Of every block the words and, for each side that was read, how many others each has, these and their counts."""
    for word, *sides in zip(*(c.to_pylist() for c in b.columns), strict=True):
        row = [np.frombuffer(word, np.uint16)]
        for many, other, n in zip(sides[::3], sides[1::3], sides[2::3], strict=True):
            row += [np.frombuffer(many, np.int32), np.frombuffer(other, np.uint16), np.frombuffer(n, np.uint32 if len(n) == 2 * len(other) else np.int64)]
        yield row


def class_bigrams(blocks: DataFrame, named: np.ndarray, k: int) -> np.ndarray:
    """Bigrams by class, of the head's words that have one of ``k``."""
    shared = blocks.sparkSession.sparkContext.broadcast(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, of = np.zeros((k + 1) ** 2), shared.value.astype(np.int64)
        for b in batches:
            for w, many, o, n in _entries(b):
                m += np.bincount(np.repeat(of[w] * (k + 1), many) + of[o], weights=n, minlength=len(m))
        m = m.reshape(k + 1, k + 1)[:k, :k].ravel()
        cell = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(m[cell].astype(np.int64), pa.int64())], ["cell", "n"])

    out = _square(blocks.select(*_BLOCKS[:4]).mapInArrow(run, "cell bigint, n bigint"), k * k).reshape(k, k)
    shared.unpersist()
    return out


def _square(cells: DataFrame, size: int) -> np.ndarray:
    m = np.zeros(size)
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    m[got["cell"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    return m


def _moves(m: np.ndarray, seen: np.ndarray, own: np.ndarray, now: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Classes after moves that each raise the likelihood by itself, of words with (words, 2, k) bigrams beside classes; k: none so far."""
    k = len(m)
    soft = m + 0.5
    pmi = np.log(soft * soft.sum() / (soft.sum(axis=1)[:, None] * soft.sum(axis=0)[None, :]))
    score = seen[:, 0] @ pmi.T + seen[:, 1] @ pmi
    best, total = score.argmax(axis=1), seen.sum(axis=(1, 2))
    free = free & (total > 0)
    phi = _phi(m)
    for i in np.flatnonzero(free & (now < k) & (total >= EXACT)):
        gain = _gain(m, now[i], seen[i, 0], seen[i, 1], own[i], phi)[0]
        best[i] = int(np.argmax(gain))
        if gain[best[i]] <= gain[now[i]] + 1e-9 * abs(gain[now[i]]):
            best[i] = now[i]
    held = score[np.arange(len(now)), np.minimum(now, k - 1)]
    rare = (total < EXACT) & (now < k)
    moved = free & (best != now) & ~(rare & (score.max(axis=1) <= held + 1e-9 * np.abs(held)))
    return np.where(moved, best, now)


def proposals(blocks: DataFrame, named: np.ndarray, m: np.ndarray, sweep: int) -> np.ndarray:
    """``named`` after moves: at sweep 0 of words without a class, later of every other word."""
    k = len(m)
    shared = blocks.sparkSession.sparkContext.broadcast((named, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, m = shared.value
        for b in batches:
            for words, *sides in _entries(b):
                free = of[words] == k
                if sweep:
                    free |= (words + sweep) % 2 == 0
                u = words[free]
                if not len(u):
                    continue
                now, seen = of[u].astype(np.int64), np.zeros((len(u), 2, k + 1))
                for s, many, o, n in zip((0, 1), sides[::3], sides[1::3], sides[2::3], strict=True):
                    use = np.repeat(free, many)
                    o, n, place = o[use], n[use], np.repeat(np.arange(len(u)), many[free])
                    seen[:, s] = np.bincount(place * (k + 1) + of[o], weights=n, minlength=seen[:, s].size).reshape(len(u), k + 1)
                    self = o == u[place]
                    own = np.bincount(place[self], weights=n[self], minlength=len(u))  # on both sides the same
                    seen[np.arange(len(u)), s, now] -= own
                after = _moves(m, seen[:, :, :k], own, now, np.ones(len(u), dtype=bool))
                yield pa.RecordBatch.from_arrays([pa.array([u[after != now].tobytes()], pa.binary()), pa.array([after[after != now].astype(np.int16).tobytes()], pa.binary())], ["word", "class"])

    out = named.copy()
    for r in blocks.mapInArrow(run, "word binary, class binary").collect():  # some numbers of the head, packed
        out[np.frombuffer(r[0], dtype=np.uint16)] = np.frombuffer(r[1], dtype=np.int16)
    shared.unpersist()
    return out


def sweeps(blocks: DataFrame, named: np.ndarray, k: int, most: int = SWEEPS) -> np.ndarray:
    """Classes of the head from those of its first words; class ``k`` stays for words that are beside none with a class."""
    m = class_bigrams(blocks, named, k)
    while not np.array_equal(placed := proposals(blocks, named, m, 0), named):
        named, m = placed, class_bigrams(blocks, placed, k)
    for sweep in range(1, most + 1):
        moved = proposals(blocks, named, m, sweep)
        after = class_bigrams(blocks, moved, k)
        if likelihood(after) <= likelihood(m):
            break
        named, m = moved, after
    return named


_LIST = T.ArrayType(T.StringType())


def tail_words(coded: DataFrame, words: list[str], named: np.ndarray, k: int, parts: int) -> DataFrame:
    """Blocks of the words outside the head: (words, count), bigrams (at, cell, n) and places in chunks (owner, chunk, local, times).

    ``at`` and ``owner`` number the block's words; a cell is a class that
    follows, or k and a class that precedes.
    """
    shared = coded.sparkSession.sparkContext.broadcast((pa.array(words, pa.string()), named))
    spread = T.StructType([T.StructField("word", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("local", T.IntegerType()), T.StructField("times", T.LongType()), T.StructField("beside", T.BinaryType())])
    packed = ("count", "at", "cell", "n", "owner", "chunk", "local", "times")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, of = shared.value
        for b in batches:
            for chunk, ends, ids, own, counts in zip(*(b.column(i) for i in range(5)), strict=True):
                head_of, seq = _head_ids(head, own), np.frombuffer(ids.as_py(), np.int32)
                rest = np.flatnonzero(head_of < 0)
                if not len(rest):
                    continue
                c = np.where(head_of >= 0, of[head_of], k)[seq]
                new, inside = head_of[seq] < 0, _inside(ends.as_py(), len(seq))
                right = np.flatnonzero(new[:-1] & (c[1:] < k) & inside)
                left = np.flatnonzero(new[1:] & (c[:-1] < k) & inside) + 1
                key = np.concatenate([seq[right].astype(np.int64) * 2 * k + c[right + 1], seq[left].astype(np.int64) * 2 * k + k + c[left - 1]])
                u, n = np.unique(key, return_counts=True)
                at = np.searchsorted(u // (2 * k), rest)
                stop = np.searchsorted(u // (2 * k), rest, side="right")
                if len(rest):  # entries lie word after word, as do the words of the rest
                    blob = u % (2 * k) << 40 | n
                    edge = (np.append(at, stop[-1]) * 8).astype(np.int32)
                    beside = pa.Array.from_buffers(pa.binary(), len(rest), [None, pa.py_buffer(edge), pa.py_buffer(blob.astype(np.int64))])
                    place = pa.array(rest)
                    yield pa.RecordBatch.from_arrays([own.values.take(place), pa.array(np.full(len(rest), chunk.as_py()), pa.int64()), pa.array(rest.astype(np.int32)), counts.values.take(place), beside], [f.name for f in spread])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def pack(t: pa.Table) -> Iterator[pa.RecordBatch]:
            coded = t.column("word").combine_chunks().dictionary_encode()
            code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            chunk, local, times = (t.column(c).to_numpy() for c in ("chunk", "local", "times"))
            beside = t.column("beside").to_pylist()
            flat = np.frombuffer(b"".join(beside), np.int64)
            key = np.repeat(code, np.fromiter(map(len, beside), np.int64, len(beside)) // 8) << 16 | flat >> 40
            key, n = _summed(key, flat & ((1 << 40) - 1))
            order = np.argsort(code, kind="stable")
            for i in range(0, len(names), _BLOCK):
                j = min(i + _BLOCK, len(names))
                a, z = np.searchsorted(key >> 16, (i, j))
                r = order[slice(*np.searchsorted(code[order], (i, j)))]
                owner = (code[r] - i).astype(np.int32)
                cols = [np.bincount(owner, weights=times[r], minlength=j - i).astype(np.int64), ((key[a:z] >> 16) - i).astype(np.int32), (key[a:z] & 0xFFFF).astype(np.int32), n[a:z], owner, chunk[r], local[r], times[r]]
                yield pa.RecordBatch.from_arrays([pa.array([names.slice(i, j - i).to_pylist()], pa.list_(pa.string())), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols)], ["words", *packed])

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size > 200_000:
                t = pa.Table.from_batches(held).combine_chunks()
                cut = int(np.argmax(pc.equal(t.column("word"), t.column("word")[-1]).to_numpy()))  # the last word may go on
                if cut:
                    yield from pack(t.slice(0, cut))
                held, size = t.slice(cut).to_batches(), t.num_rows - cut
        if size:
            yield from pack(pa.Table.from_batches(held))

    found = coded.select("chunk", "ends", "ids", "words", "counts").mapInArrow(pieces, spread)
    schema = T.StructType([T.StructField("words", _LIST), *(T.StructField(c, T.BinaryType()) for c in packed)])
    return found.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(gather, schema)


_TAIL_KINDS = {"count": np.int64, "at": np.int32, "cell": np.int32, "n": np.int64, "owner": np.int32, "chunk": np.int64, "local": np.int32, "times": np.int64}


def _tail_classes(row: dict, ms: list[np.ndarray]) -> np.ndarray:
    """Class of each word of a block after a sweep under each matrix; the same wherever it is worked out."""
    k, u = len(ms[0]), len(row["count"])
    seen = np.bincount(row["at"].astype(np.int64) * 2 * k + row["cell"], weights=row["n"], minlength=u * 2 * k).reshape(u, 2, k)
    now = np.full(u, k)
    for m in ms:
        now = _moves(m, seen, np.zeros(u), now, np.ones(u, dtype=bool))
    return now


def _tail_rows(b: pa.RecordBatch, names: list[str]) -> Iterator[dict]:
    for row in zip(*(b.column(c) for c in names), strict=True):
        yield {c: x.values if c == "words" else np.frombuffer(x.as_py(), _TAIL_KINDS[c]) for c, x in zip(names, row, strict=True)}


def tail_totals(tail: DataFrame, ms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the words of the tail add to the class bigrams, and their number and counts by class."""
    k = len(ms[0])
    shared = tail.sparkSession.sparkContext.broadcast(ms)
    names = ["count", "at", "cell", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, types, mass = np.zeros((k + 1) * 2 * k), np.zeros(k + 1), np.zeros(k + 1)
        for b in batches:
            for row in _tail_rows(b, names):
                now = _tail_classes(row, shared.value)
                m += np.bincount(now[row["at"]] * 2 * k + row["cell"], weights=row["n"], minlength=len(m))
                types += np.bincount(now, minlength=k + 1)
                mass += np.bincount(now, weights=row["count"], minlength=k + 1)
        all_ = np.concatenate([m, types, mass])
        cell = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(all_[cell].astype(np.int64), pa.int64())], ["cell", "n"])

    got = _square(tail.select(*names).mapInArrow(run, "cell bigint, n bigint"), 2 * k * (k + 1) + 2 * (k + 1))
    shared.unpersist()
    m = got[: 2 * k * (k + 1)].reshape(k + 1, 2, k)[:k]
    types, mass = got[2 * k * (k + 1) :].reshape(2, k + 1)
    return m[:, 0] + m[:, 1].T, types, mass


def tail_table(tail: DataFrame, ms: list[np.ndarray]) -> DataFrame:
    """(word, n, class) of every word outside the head."""
    shared = tail.sparkSession.sparkContext.broadcast(ms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _tail_rows(b, ["words", "count", "at", "cell", "n"]):
                yield pa.RecordBatch.from_arrays([row["words"], pa.array(row["count"]), pa.array(_tail_classes(row, shared.value).astype(np.int32))], ["word", "n", "class"])

    return tail.mapInArrow(run, "word string, n bigint, class int")


def _returned(tail: DataFrame, ms: list[np.ndarray]) -> DataFrame:
    """(chunk, local, class, n): classes and counts of the tail's words, packed for each chunk that has them."""
    shared = tail.sparkSession.sparkContext.broadcast(ms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def pack() -> pa.RecordBatch:
            chunk, local, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            return _cut(chunk, {"local": local, "class": c, "n": n}, "chunk")

        for b in batches:
            for row in _tail_rows(b, ["count", "at", "cell", "n", "owner", "chunk", "local"]):
                now = _tail_classes(row, shared.value)
                held.append((row["chunk"], row["local"], now[row["owner"]].astype(np.int16), row["count"][row["owner"]]))
                size += len(row["owner"])
                if size > 1_000_000:
                    yield pack()
                    held, size = [], 0
        if held:
            yield pack()

    return tail.mapInArrow(run, _packed("chunk", "local", "class", "n"))


@dataclass
class BrownModel:
    """``words`` are the head, ``n`` its counts and ``classes`` its classes; ``log_mass`` the log of each class's counts
    with what is added; ``step`` log P(class | class before), its last row for a text's start; ``likelihood`` has the
    likelihood of class bigrams before and after each sweep over the tail; ``tail``: (word, n, class) of all other words."""

    words: list[str]
    n: np.ndarray
    classes: np.ndarray
    log_mass: np.ndarray
    step: np.ndarray
    likelihood: list[float]
    tail: DataFrame | None


def _classed(coded: DataFrame, words: list[str], n: np.ndarray, named: np.ndarray, log_mass: np.ndarray, back: DataFrame | None) -> DataFrame:
    """(docs, ends, classes, emit): the class of every token, and the sum of log emissions of every text."""
    shared = coded.sparkSession.sparkContext.broadcast((pa.array(words, pa.string()), n, named, log_mass))
    kind = coded.schema["docs"]
    schema = T.StructType([T.StructField("chunk", T.LongType()), kind, T.StructField("ends", T.BinaryType()), T.StructField("classes", T.BinaryType()), T.StructField("rest", T.BinaryType()), T.StructField("emit", T.BinaryType())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, n, of, log_mass = shared.value
        emit = np.log(n + EMISSION) - log_mass[of]
        for b in batches:
            for chunk, docs, ends, ids, own in zip(*(b.column(i) for i in range(5)), strict=True):
                head_of, seq = _head_ids(head, own), np.frombuffer(ids.as_py(), np.int32)
                if len(head):
                    c, e = np.where(head_of >= 0, of[head_of], -1).astype(np.int16), np.where(head_of >= 0, emit[head_of], 0.0)
                else:
                    c, e = np.full(len(head_of), -1, np.int16), np.zeros(len(head_of))
                tokens = c[seq]
                row = [chunk.as_py(), docs, ends.as_py(), tokens.tobytes(), seq[tokens < 0].tobytes(), _per_text(e[seq], ends.as_py()).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([docs.as_py()], b.schema.field(1).type), *(pa.array([x], pa.binary()) for x in row[2:])], [f.name for f in schema])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_mass = shared.value[3]
        for b in batches:
            for r, docs in zip(b.select(["ends", "classes", "rest", "emit", "back"]).to_pylist(), b.column("docs"), strict=True):
                c, rest = np.frombuffer(r["classes"], np.int16).copy(), np.frombuffer(r["rest"], np.int32)
                emit = np.frombuffer(r["emit"], np.float64)
                if len(rest):
                    local, of, n = (np.frombuffer(b"".join(x[k] for x in r["back"]), d) for k, d in (("local", np.int32), ("class", np.int16), ("n", np.int64)))
                    size = int(max(local.max(), rest.max())) + 1
                    class_of, logs = np.zeros(size, np.int16), np.zeros(size)
                    class_of[local], logs[local] = of, np.log(n + EMISSION) - log_mass[of]
                    e = np.zeros(len(c))
                    e[c < 0] = logs[rest]
                    c[c < 0] = class_of[rest]
                    emit = emit + _per_text(e, r["ends"])
                yield pa.RecordBatch.from_arrays([pa.array([docs.as_py()], b.schema.field("docs").type), *(pa.array([x], pa.binary()) for x in (r["ends"], c.tobytes(), emit.tobytes()))], ["docs", "ends", "classes", "emit"])

    out = coded.select("chunk", "docs", "ends", "ids", "words").mapInArrow(first, schema)
    if back is None:
        return out.select("docs", "ends", "classes", "emit")
    per = back.groupBy("chunk").agg(F.collect_list(F.struct("local", "class", "n")).alias("back"))
    done = T.StructType([kind, *(T.StructField(c, T.BinaryType()) for c in ("ends", "classes", "emit"))])
    return out.join(per, "chunk", "left").mapInArrow(second, done)


def _per_text(x: np.ndarray, ends: bytes) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(x)])
    e = np.frombuffer(ends, np.int32)
    return sums[e] - sums[np.concatenate([[0], e[:-1]]).astype(np.int64)] if len(e) else np.zeros(0)


def _steps(classes: bytes, ends: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's class and the one before it in its text, or ``start``."""
    c = np.frombuffer(classes, np.int16).astype(np.int64)
    before = np.concatenate([[start], c[:-1]]) if len(c) else c
    e = np.frombuffer(ends, np.int32)
    before[e[e < len(c)]] = start
    return before, c


def train(docs: DataFrame, scratch: Scratch, classes: int | None = None, core: int = CORE, head: int = HEAD, chunk: int = CHUNK) -> tuple[BrownModel, DataFrame]:
    """The model of all of ``docs``, and its texts as classes."""
    spark = docs.sparkSession
    coded = scratch.save(chunks(docs, chunk), "chunks")
    counts = coded.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n"))
    counts = scratch.save(counts, "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("types")).first()
    top = most_frequent(counts, min(head, HEAD))
    scratch.drop("words")
    words, n = top["word"].tolist(), top["n"].to_numpy(dtype=np.float64)
    if classes is None:
        classes = max(CLASSES, round(total["types"] ** GROWTH))
        core = max(core, 12 * classes)
    k0 = min(core, len(words))
    k = max(1, min(classes, k0))
    named = np.full(len(words), k, dtype=np.int16)  # class k: beside no word
    blocks = scratch.save(neighbours(coded, words, total["n"]), "neighbours")
    if k0:
        first = _core_counts(blocks, k0)
        named[:k0] = exchange(first, k)
        if len(words) > k0:
            named = sweeps(blocks, named, k)
    m = class_bigrams(blocks, named, k)
    types, mass = np.bincount(named, minlength=k + 1).astype(np.float64), np.bincount(named, weights=n, minlength=k + 1)
    ms, back, tail, reached = [m], None, None, [likelihood(m)]
    if total["types"] > len(words):
        parts = partitions_for(spark, total["types"] - len(words), 50_000)
        tail = scratch.save(tail_words(coded, words, named, k, parts), "tail")
        more, t, c = tail_totals(tail, ms)
        reached.append(likelihood(m + more))
        for _ in range(TAIL_SWEEPS):
            after = tail_totals(tail, [*ms, m + more])
            if (value := likelihood(m + after[0])) <= reached[-1]:
                break
            ms, (more, t, c) = [*ms, m + more], after
            reached.append(value)
        types, mass = types + t, mass + c
        back = _returned(tail, ms)
    scratch.drop("neighbours")
    log_mass = np.log(mass + EMISSION * np.maximum(types, 1))
    texts = scratch.save(_classed(coded, words, n, named, log_mass, back), "texts")
    scratch.drop("chunks")
    kk = k + 1

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((kk + 1) * kk, dtype=np.int64)
        for b in batches:
            for c, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                before, now = _steps(c, e, kk)
                sums += np.bincount(before * kk + now, minlength=len(sums))
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(sums[cell], pa.int64())], ["cell", "n"])

    t = _square(texts.select("classes", "ends").mapInArrow(transitions, "cell bigint, n bigint"), (kk + 1) * kk).reshape(kk + 1, kk)
    # a class without words gets no mass
    prior = np.where(types > 0, t.sum(axis=0) + 1, 0)
    prior = prior / max(1.0, prior.sum())
    with np.errstate(divide="ignore"):
        step = np.log((t + PRIOR * prior[None, :]) / (t.sum(axis=1, keepdims=True) + PRIOR))
    return BrownModel(words, n, named, log_mass, step, reached, None if tail is None else tail_table(tail, ms)), texts


def _core_counts(blocks: DataFrame, k0: int) -> np.ndarray:
    """Bigrams of the first ``k0`` words of the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, many, o, n in _entries(b):
                w = np.repeat(w, many)
                use = (w < k0) & (o < k0)
                yield pa.RecordBatch.from_arrays([pa.array(w[use].astype(np.int64) * k0 + o[use], pa.int64()), pa.array(n[use], pa.int64())], ["cell", "n"])

    return _square(blocks.select(*_BLOCKS[:4]).mapInArrow(run, "cell bigint, n bigint"), k0 * k0).reshape(k0, k0)


def brown_lm(docs: DataFrame, classes: int | None = None, core: int = CORE, head: int = HEAD) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every row under the model of the whole table.

    A text without words, null or empty, has 0 words, log_prob 0 and a null
    perplexity.  Repeated rows count and are scored each.  Words tied at the end
    of the head are taken by hash; an empty table gives no rows; only doc_id and
    text are read.
    """
    scratch = Scratch(docs.sparkSession, "brown")
    model, texts = train(docs, scratch, classes, core, head)
    shared = docs.sparkSession.sparkContext.broadcast(model.step)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perplexity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = shared.value
        for b in batches:
            for docs, e, c, emit in zip(*(b.column(i) for i in range(4)), strict=True):
                ends = np.frombuffer(e.as_py(), np.int32)
                p = _per_text(step[_steps(c.as_py(), e.as_py(), len(step) - 1)], e.as_py()) + np.frombuffer(emit.as_py(), np.float64)
                n = np.diff(ends, prepend=0).astype(np.int64)
                p = np.where(n > 0, p, 0.0)
                ppl = pa.array(np.exp(-p / np.maximum(n, 1)), mask=n == 0)
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(n), pa.array(p), ppl], ["doc_id", "n_words", "log_prob", "perplexity"])

    return texts.mapInArrow(run, schema)
