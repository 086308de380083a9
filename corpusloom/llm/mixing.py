"""Mixing sources to target weights under a curriculum that changes over training.

Each source s has a weight schedule w_s(t), linear between knots on [0, 1], the
weights adding up to 1 at every t.  Its integral W_s(t) is the share of all
training tokens that s has given by time t.  A document of s before which c
tokens of s stand is due when T * W_s(t) = c; solving that quadratic for t gives
its training position T * t, and a range sort by position gives the order.

T is the least total for which every document is used: the source that is
scarcest in demand is used once, others are gone through again (``epoch`` 1, 2,
...) until the training ends, so that the mixture meets its weights throughout
and no document is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, small

#: Knots (t, kind): tokens^1, ^3/4 and ^1/2 of each source, so small sources gain weight as training goes on.
KNOTS = ((0.0, "natural"), (0.5, "tempered"), (1.0, "flat"))
SEED = "mix-1"
#: Documents that one bucket of the running sum is planned for.
BUCKET_ROWS = 20_000

_UNITS = {"natural": "CAST(n AS BIGINT)", "tempered": "CAST(floor(sqrt(n * sqrt(n))) AS BIGINT)", "flat": "CAST(floor(sqrt(n)) AS BIGINT)"}
#: Tokens of a text: a quarter of its UTF-8 bytes, rounded up.
TOKENS = "CAST(ceil(coalesce(octet_length({bytes}), 0) / 4.0) AS BIGINT)"


def schedule(totals: DataFrame, knots: tuple = KNOTS) -> DataFrame:
    """Segments of each source's schedule from its tokens ``n``.

    (source_key, n, seg, t0, t1, w0, slope, c0, c1): on [t0, t1] the weight is
    w0 + slope * (t - t0), and W goes from c0 to c1.  Sources without tokens get
    weight 0.  Any other schedule of this form can be given to :func:`plan`.
    """
    units = totals.select("source_key", F.col("n").cast("double").alias("x"), "n")
    for i, (_, kind) in enumerate(knots):
        units = units.withColumn(f"u{i}", F.expr(_UNITS[kind].replace("n", "x")))
    sums = units.agg(*[F.sum(f"u{i}").cast("double").alias(f"s{i}") for i in range(len(knots))])
    w = units.crossJoin(F.broadcast(sums))
    for i in range(len(knots)):
        w = w.withColumn(f"w{i}", F.when(F.col(f"s{i}") > 0, F.col(f"u{i}").cast("double") / F.col(f"s{i}")).otherwise(0.0))
    c, segments = F.lit(0.0), []
    for i in range(len(knots) - 1):
        t0, t1 = knots[i][0], knots[i + 1][0]
        after = c + (F.col(f"w{i}") + F.col(f"w{i + 1}")) * F.lit((t1 - t0) / 2)
        segments.append(F.struct(F.lit(i).alias("seg"), F.lit(t0).alias("t0"), F.lit(t1).alias("t1"), F.col(f"w{i}").alias("w0"), ((F.col(f"w{i + 1}") - F.col(f"w{i}")) / F.lit(t1 - t0)).alias("slope"), c.alias("c0"), after.alias("c1")))
        c = after
    return w.select("source_key", "n", F.explode(F.array(*segments)).alias("s")).select("source_key", "n", "s.*")


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))


def plan(docs: DataFrame, knots: tuple = KNOTS, seed: str = SEED) -> DataFrame:
    """The training order of ``docs``: (position, t, epoch, doc_id, source, tokens), sorted by position.

    Within a source documents stand in the order of md5(seed, doc_id), ties by
    doc_id and tokens.  ``position`` is in tokens, rounded to thousandths, as is
    ``t`` to 9 digits; ties in position are in order of source, doc_id and epoch.
    A null source is a source of its own.  Null and empty texts have 0 tokens
    and stand, in epoch 0 and each later one, where the next document does; the
    documents of a source without any tokens come at position 0, once.  Repeated
    rows are documents of their own.  An empty table gives no rows; doc_id, source
    and text alone are read, and a null doc_id stands as the word null in the order.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    base = docs.select(
        "doc_id", "source", _source_key().alias("source_key"),
        F.expr(TOKENS.format(bytes="text")).alias("tokens"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("key"),
    )
    base = scratch.save(base, "base")
    rows = base.count()
    digits = max(1, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16))) if rows > BUCKET_ROWS else 1
    base = base.withColumn("bucket", F.substring("key", 1, digits))
    buckets = scratch.save(base.groupBy("source_key", "bucket").agg(F.sum("tokens").alias("m")), "buckets")
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("source_key", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    segments = scratch.save(schedule(buckets.groupBy("source_key").agg(F.sum("m").alias("n")), knots), "segments")
    ends = segments.where(F.col("seg") == len(knots) - 2)
    total = ends.agg(F.coalesce(F.max(F.when(F.col("c1") > 0, F.col("n") / F.col("c1"))), F.lit(0.0)).alias("total"))
    within = Window.partitionBy("source_key", "bucket").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("c", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    placed = placed.join(offsets, ["source_key", "bucket"]).withColumn("c", F.col("c") + F.col("offset"))
    # a source's last tokens are due at t = 1, where its demand ends
    ends = ends.crossJoin(F.broadcast(total)).select("source_key", "n", "total", (F.col("total") * F.col("c1")).alias("demand"))
    ends = ends.withColumn("rounds", F.greatest(F.lit(1), F.when(F.col("n") > 0, F.ceil(F.col("demand") / F.col("n"))).otherwise(1)).cast("int"))
    due = placed.join(ends, "source_key").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    due = due.withColumn("at", (F.col("c") + F.col("epoch") * F.col("n")).cast("double"))
    due = due.where((F.col("epoch") == 0) | (F.col("at") < F.col("demand")))
    due = due.withColumn("share", F.when(F.col("total") > 0, F.col("at") / F.col("total")).otherwise(0.0))
    seg = segments.select(F.col("source_key").alias("k"), "seg", "t0", "t1", "w0", "slope", "c0", "c1")
    last = F.col("seg") == len(knots) - 2
    first = F.col("seg") == 0
    inside = (F.col("source_key") == F.col("k")) & ((F.col("share") >= F.col("c0")) | first) & ((F.col("share") < F.col("c1")) | last)
    d = F.greatest(F.col("share") - F.col("c0"), F.lit(0.0))
    root = F.sqrt(F.greatest(F.col("w0") * F.col("w0") + F.lit(2.0) * F.col("slope") * d, F.lit(0.0)))
    t = F.when(d > 0, F.least(F.col("t1"), F.col("t0") + F.lit(2.0) * d / (F.col("w0") + root))).otherwise(F.col("t0"))
    out = due.join(small(seg), inside).withColumn("t", t)
    out = out.select(F.round(F.col("t") * F.col("total"), 3).alias("position"), F.round("t", 9).alias("t"), F.col("epoch"), "doc_id", "source", "tokens")
    return out.orderBy("position", "source", "doc_id", "epoch")


def _sql(docs: str) -> str:
    """DuckDB SQL for :func:`plan` with the default knots over a relation ``docs``."""
    tokens = TOKENS.format(bytes="encode(text)")
    return f"""
WITH base AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, {tokens} AS tokens,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM {docs}),
cum AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY k ORDER BY key, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM base),
u AS (SELECT k, sum(tokens)::BIGINT AS n, sum(tokens)::BIGINT AS u0, floor(sqrt(sum(tokens)::DOUBLE * sqrt(sum(tokens)::DOUBLE)))::BIGINT AS u1, floor(sqrt(sum(tokens)::DOUBLE))::BIGINT AS u2 FROM base GROUP BY k),
w AS (SELECT k, n, CASE WHEN s0 > 0 THEN u0::DOUBLE / s0 ELSE 0 END AS w0, CASE WHEN s1 > 0 THEN u1::DOUBLE / s1 ELSE 0 END AS w1, CASE WHEN s2 > 0 THEN u2::DOUBLE / s2 ELSE 0 END AS w2
      FROM u, (SELECT sum(u0)::DOUBLE AS s0, sum(u1)::DOUBLE AS s1, sum(u2)::DOUBLE AS s2 FROM u)),
g AS (SELECT *, (w0 + w1) * 0.25::DOUBLE AS c1, (w0 + w1) * 0.25::DOUBLE + (w1 + w2) * 0.25::DOUBLE AS c2 FROM w),
e AS (SELECT g.*, total, total * c2 AS demand, greatest(1, CASE WHEN n > 0 THEN ceil(total * c2 / n) ELSE 1 END)::INT AS rounds
      FROM g, (SELECT coalesce(max(CASE WHEN c2 > 0 THEN n::DOUBLE / c2 END), 0) AS total FROM g)),
due AS (SELECT * FROM (SELECT cum.*, e.* EXCLUDE (k), unnest(range(rounds))::INT AS epoch FROM cum JOIN e USING (k)) WHERE epoch = 0 OR (c + epoch * n)::DOUBLE < demand),
seg AS (SELECT *, CASE WHEN total > 0 THEN (c + epoch * n)::DOUBLE / total ELSE 0 END AS share FROM due),
d AS (SELECT *, CASE WHEN share < c1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS ta, CASE WHEN share < c1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS tb, CASE WHEN share < c1 THEN w0 ELSE w1 END AS wa,
         CASE WHEN share < c1 THEN (w1 - w0) / 0.5::DOUBLE ELSE (w2 - w1) / 0.5::DOUBLE END AS slope, greatest(share - CASE WHEN share < c1 THEN 0 ELSE c1 END, 0) AS x FROM seg),
r AS (SELECT *, CASE WHEN x > 0 THEN least(tb, ta + 2.0::DOUBLE * x / (wa + sqrt(greatest(wa * wa + 2.0::DOUBLE * slope * x, 0)))) ELSE ta END AS tt FROM d)
SELECT round(tt * total, 3) AS position, round(tt, 9) AS t, epoch, doc_id, source, tokens FROM r
"""


ORACLE = _sql("documents")
