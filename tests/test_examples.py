"""End to end: short corpora whose results are known."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import udfs as U
from corpusloom.functions.columns import Config
from corpusloom.operators import cluster, sketches
from corpusloom.operators.sketcher import Sketcher
from corpusloom.session import ship


def docs(spark, texts):
    ship(spark)
    return spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(texts)], "id string, seq int, text string")


def test_similarity(spark):
    fox = "the quick brown fox {} over the lazy dog"
    df = spark.createDataFrame([(fox.format("jumps"), fox.format("leaps")), ("", ""), ("one two", fox.format("jumps"))], "a string, b string")
    got = df.select(Sketcher().similarity(F.col("a"), F.col("b")).alias("s"), Sketcher().containment(F.col("a"), F.col("b")).alias("c")).collect()
    assert round(got[0].s, 2) == 0.42 and got[0].c > 0.4
    assert [r.s for r in got[1:]] == [r.c for r in got[1:]] == [0.0, 0.0]


def test_query(spark):
    sk = Sketcher()
    held = docs(spark, [("doc1", "the quick brown fox jumps over the lazy dog every single morning"), ("doc2", "an entirely unrelated document about locality sensitive hashing")])
    asked = docs(spark, [("q", "the quick brown fox jumps over the lazy dog every single evening")])
    assert [r.id for r in sk.query(sk.index(held), asked).collect()] == ["doc1"]
    assert round(sk.verified_query(held, asked, 0.5).first().similarity, 2) == pytest.approx(0.8, abs=0.12)
    with pytest.raises(ValueError):
        Sketcher(Config(bands=0, rows=0)).index(held)


def test_dedup_clusters(spark):
    base = "the city council voted last night to approve the new marina expansion project"
    held = docs(spark, [("orig", base), ("repost", "FWD: " + base), ("unrelated", "our weekly gardening column returns with advice on pruning roses in late summer"), ("repost2", base + " wow")])
    pairs = Sketcher().similarity_join(held, 0.5)
    got = cluster.clusters(held, pairs).collect()
    assert sorted((r.rep, len(r.members) - 1) for r in got) == [("orig", 2), ("unrelated", 0)]


def test_distinct_words(spark):
    held = docs(spark, [("a", "one two three four five six seven"), ("b", "six seven eight nine ten eleven twelve")])
    words = held.select(F.explode(U.token_hashes(F.col("text"))).alias("h"))
    assert round(sketches.hll_estimate(sketches.hll_registers(words, [], "h", 14), [], 14).first().estimate) == 12
