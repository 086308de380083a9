"""Exact histogram of encoded lengths, and what suffix sums over it answer."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space beyond this are cut out and encoded by themselves: the pattern's look-ahead overflows the encoder's stack on very long ones.
LONG_RUN = 1000
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG = re.compile(_SPACE + "{%d,}" % LONG_RUN)


@lru_cache(maxsize=4)
def encoder_of(raw: bytes):
    """Encoder out of a vocabulary file's content."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(vocabulary: str = VOCABULARY):
    return encoder_of(Path(vocabulary).read_bytes())


def length(text: str, encoding) -> int:
    """Exact encoded length of a whole text.

    A run of white space is one piece less its last character, which begins the
    next piece, or one piece as a whole at the end of the text.  Long runs are
    therefore cut out there, which changes no piece.
    """
    encode, n, at = encoding.encode_ordinary, 0, 0
    if len(text) >= LONG_RUN:
        for m in _LONG.finditer(text):
            end = m.end() - (m.end() < len(text))
            n += len(encode(text[at : m.start()])) + len(encoding._core_bpe.encode_single_piece(text[m.start() : end].encode()))
            at = end
    return n + len(encode(text[at:] if at else text))


def count_tokens(texts: Iterable[str | None], encoding) -> list[int | None]:
    """Exact encoded length of each whole text; null for null."""
    return [None if text is None else length(text, encoding) for text in texts]


def _shipped(docs: DataFrame, vocabulary: str):
    """The vocabulary file's content, sent to the executors, which need no such file."""
    return docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens) of every row; texts are read whole, nulls stay null."""
    raw = _shipped(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder_of(raw.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(count_tokens(batch.column(0).to_pylist(), encoding), pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens bigint")


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, docs): documents by exact encoded length; null texts are left out, empty ones have length 0.

    Repeated rows count each, documents of one length share a row, and texts of
    any length and content are encoded whole.
    """
    raw = _shipped(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, seen = encoder_of(raw.value), {}
        for batch in batches:
            got = count_tokens(batch.column(0).to_pylist(), encoding)
            values, n = np.unique(np.array([x for x in got if x is not None], dtype=np.int64), return_counts=True)
            for v, c in zip(values.tolist(), n.tolist(), strict=True):
                seen[v] = seen.get(v, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "docs"])

    return docs.select("text").mapInArrow(run, "n_tokens bigint, docs bigint").groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per distinct length L, ascending, with what it answers as a context limit.

    ``docs_longer`` documents exceed L; ``tokens_total`` is the corpus total;
    ``tokens_at_limit`` is the total when every document is cut to L;
    ``tokens_lost`` the difference; ``share_at_most`` the quantile of L.  The
    window has one partition: the histogram has a row per distinct length, not
    per document.  An empty histogram gives no rows.
    """
    w = Window.orderBy("n_tokens")
    to, all_ = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, d = F.col("n_tokens"), F.col("docs")
    out = hist.select(
        "n_tokens", "docs",
        F.sum(d).over(to).alias("docs_at_most"), F.sum(d).over(all_).alias("docs_total"),
        F.sum(n * d).over(to).alias("tokens_at_most"), F.sum(n * d).over(all_).alias("tokens_total"),
    )
    out = out.withColumn("docs_longer", F.col("docs_total") - F.col("docs_at_most"))
    out = out.withColumn("tokens_at_limit", F.col("tokens_at_most") + n * F.col("docs_longer"))
    out = out.withColumn("tokens_lost", F.col("tokens_total") - F.col("tokens_at_limit"))
    return out.withColumn("share_at_most", F.col("docs_at_most") / F.col("docs_total"))


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """(docs_longer, tokens_at_limit, tokens_total) for any limit, also one that no document has.

    For a limit below every length all documents are cut to it; without
    documents there is no row.
    """
    kept = F.when(F.col("n_tokens") <= limit, F.col("n_tokens") * F.col("docs")).otherwise(F.col("docs") * limit)
    longer = F.when(F.col("n_tokens") > limit, F.col("docs")).otherwise(0)
    out = sums.agg(F.sum(longer).alias("docs_longer"), F.sum(kept).alias("tokens_at_limit"), F.sum(F.col("n_tokens") * F.col("docs")).alias("tokens_total"))
    return out.where(F.col("tokens_total").isNotNull())


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """(n_tokens): the smallest length that at least the share ``q`` of documents don't exceed."""
    return sums.where(F.col("share_at_most") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The whole table of :func:`suffix_sums` for ``docs``."""
    return suffix_sums(histogram(docs, vocabulary))
