"""Documents that arrive in chunks: any chunking gives the sketch of the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions import kernels as K


class WordScanner:
    """Word shingles of a text written in chunks.

    Only what follows the last ASCII byte that parts tokens is held back, and
    the last w - 1 token hashes.
    """

    def __init__(self, w: int, carry: bytes = b"", tail: np.ndarray | None = None):
        if w <= 0:
            raise ValueError("w must be positive")
        self.w, self.carry, self.done = w, carry, False
        self.tail = np.zeros(0, np.uint64) if tail is None else tail

    def write(self, chunk: bytes) -> np.ndarray:
        """Shingles that the chunk completes."""
        if self.done:
            raise ValueError("the scanner is finished")
        data = self.carry + chunk
        raw = np.frombuffer(data, dtype=np.uint8)
        letter = (raw >= 128) | ((raw >= 48) & (raw <= 57)) | ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122))
        cuts = np.flatnonzero(~letter)
        if not len(cuts):
            self.carry = data
            return np.zeros(0, np.uint64)
        at = int(cuts[-1]) + 1
        self.carry = data[at:]
        return self._fold(data[:at])

    def finish(self) -> np.ndarray:
        if self.done:
            raise ValueError("the scanner is finished")
        self.done = True
        return self._fold(self.carry)

    def _fold(self, data: bytes) -> np.ndarray:
        h = np.concatenate([self.tail, K.token_hashes(K.as_text(data))])
        n = len(h) - self.w + 1
        self.tail = h[max(0, len(h) - self.w + 1) :] if self.w > 1 else h[:0]
        if n <= 0:
            return np.zeros(0, np.uint64)
        acc = np.uint64(K.MIX_INIT)
        for j in range(self.w):
            acc = K.mix(acc, h[j : j + n])
        return acc


def blocks_of(value: str | bytes, w: int, size: int, step: int = 4096) -> Iterator[np.ndarray]:
    """Word shingles in blocks of ``size``, the last one shorter; the text is scanned only as far as blocks are taken."""
    if size <= 0:
        raise ValueError("size must be positive")
    scan, raw, held = WordScanner(w), K.as_bytes(value), np.zeros(0, np.uint64)
    for at in range(0, len(raw) + step, step):
        held = np.concatenate([held, scan.write(raw[at : at + step]) if at < len(raw) else scan.finish()])
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
        if at >= len(raw):
            break
    if len(held):
        yield held


def word_blocks(c: Column, w: int, size: int, most: int | None = None) -> Column:
    """Array of blocks of a text's word shingles, of all of it or as far as ``most`` blocks go."""
    if w <= 0 or size <= 0:
        raise ValueError("w and size must be positive")

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.LongType())))
    def run(column: pa.Array) -> pa.Array:
        got = [None if t is None else [b.view(np.int64).tolist() for b in islice(blocks_of(t, w, size), most)] for t in column.to_pylist()]
        return pa.array(got, pa.list_(pa.list_(pa.int64())))

    return run(c)


def sketch_chunks(chunks: DataFrame, w: int = 3, k: int = 128, seed: int = 0) -> DataFrame:
    """(doc_id, sig) of rows (doc_id, chunk_seq, chunk), taken in order; null chunks are empty.

    Chunks pass sorted through a scanner: neither a document nor its chunks are
    ever held as a whole.
    """
    schema = T.StructType([chunks.schema["doc_id"], T.StructField("sig", T.ArrayType(T.LongType()))])
    rows = chunks.select("doc_id", "chunk_seq", F.col("chunk").cast("binary").alias("chunk")).repartition("doc_id").sortWithinPartitions("doc_id", "chunk_seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held, doc, kind = None, None, None, None

        def end(ids: list, sigs: list) -> None:
            ids.append(doc)
            sigs.append(np.minimum(held, K.minhash(scan.finish(), k, seed)).view(np.int64))

        pack = lambda ids, sigs: pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sigs, pa.list_(pa.int64()))], schema.names)
        for b in batches:
            kind, ids, sigs = b.schema.field(0).type, [], []
            for x, chunk in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if scan is None or x != doc:
                    if scan is not None:
                        end(ids, sigs)
                    scan, held, doc = WordScanner(w), K.minhash(np.zeros(0, np.uint64), k, seed), x
                held = np.minimum(held, K.minhash(scan.write(chunk or b""), k, seed))
            if ids:
                yield pack(ids, sigs)
        if scan is not None:
            ids, sigs = [], []
            end(ids, sigs)
            yield pack(ids, sigs)

    return rows.mapInArrow(run, schema)


def sketch_stream(chunks: DataFrame, w: int = 3, k: int = 128, seed: int = 0, ttl_ms: int | None = None, running: bool = False) -> DataFrame:
    """(doc_id, sig, n_chunks) from a stream of (doc_id string, chunk_seq, chunk, last), once a document's last chunk came.

    Chunks of a micro-batch are taken by chunk_seq; batches are taken as they
    come.  With ``ttl_ms`` a document without a chunk for so long is given as it
    stands.  With ``running`` every micro-batch also gives the signature of what
    each of its documents has so far, as if it ended there, and a column
    ``done``; the document goes on.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, tail, sig, n = state.get if state.exists else (b"", [], [], 0)
        scan = WordScanner(w, bytes(carry), np.array(tail, dtype=np.int64).view(np.uint64))
        held = np.array(sig, dtype=np.int64).view(np.uint64) if len(sig) else K.minhash(np.zeros(0, np.uint64), k, seed)
        last = state.hasTimedOut
        if not last:
            pdf = pd.concat(list(pdfs)).sort_values("chunk_seq", kind="stable")
            for chunk in pdf["chunk"]:
                held = np.minimum(held, K.minhash(scan.write(bytes(chunk or b"")), k, seed))
            n, last = n + len(pdf), bool(pdf["last"].any())
        if last:
            state.remove()
        else:
            state.update((scan.carry, scan.tail.view(np.int64).tolist(), held.view(np.int64).tolist(), n))
            if ttl_ms:
                state.setTimeoutDuration(ttl_ms)
        if last or running:
            whole = np.minimum(held, K.minhash(WordScanner(w, scan.carry, scan.tail).finish(), k, seed))
            yield pd.DataFrame({"doc_id": [key[0]], "sig": [whole.view(np.int64).tolist()], "n_chunks": [n]} | ({"done": [last]} if running else {}))

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("doc_id").applyInPandasWithState(step, "doc_id string, sig array<bigint>, n_chunks bigint" + ", done boolean" * running, "carry binary, tail array<bigint>, sig array<bigint>, n bigint", "append", timeout)
