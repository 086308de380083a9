import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import columns as C
from corpusloom.functions import kernels as K
from corpusloom.functions import sql
from corpusloom.functions import udfs as U
from corpusloom.operators import lsh, sketches, winnow
from corpusloom.sources import index_tables
from corpusloom.streaming.incremental import hll_stream, minhash_union_stream

A = "revenue climbed twelve percent across every region during the first quarter of the year"
B = "we note that revenue climbed twelve percent across every region, said the board"


def test_register(spark):
    names = sql.register(spark)
    assert "cl_sketch" in names
    spark.createDataFrame([(1, A), (2, B), (3, None)], "id int, t string").createOrReplaceTempView("d")
    got = {r.id: r for r in spark.sql("SELECT id, cl_sketch(t, 3, 16, 0) s, cl_simhash(t, 3) f, cl_word_hashes(t, 2) w, cl_band_keys(cl_sketch(t, 3, 16, 0), 4, 4) b FROM d").collect()}
    assert got[1].s == K.minhash(K.words(A, 3), 16, 0).view(np.int64).tolist() and got[1].f & K.MASK == K.simhash(K.words(A, 3))
    assert got[2].b == K.band_keys(K.minhash(K.words(B, 3), 16, 0), 4, 4).view(np.int64).tolist() and got[3].w is None
    union = spark.sql("SELECT cl_minhash_union(cl_sketch(t, 3, 16, 0)) u FROM d").first().u
    assert union == np.minimum(K.minhash(K.words(A, 3), 16, 0), K.minhash(K.words(B, 3), 16, 0)).view(np.int64).tolist()
    assert spark.sql("SELECT s.* FROM d, LATERAL cl_shingles(t, 3) s WHERE id = 1").count() == len(K.words(A, 3))
    w = spark.sql("SELECT w.* FROM d, LATERAL cl_winnow(t, 8, 6) w WHERE id = 1").collect()
    assert [r.pos for r in w] == K.winnow(K.char(A, 8), 6).tolist()
    fp = spark.sql("SELECT cl_simhash_agg(s.hash, 1L) f FROM d, LATERAL cl_shingles(t, 3) s WHERE id = 1").first().f
    assert fp & K.MASK == K.simhash(K.words(A, 3))


def test_names_for_estimates_and_bytes(spark):
    names = sql.register(spark)
    assert {"cl_jaccard", "cl_containment", "cl_cardinality", "cl_distance", "cl_hll", "cl_unmarshal_signature", "cl_word_blocks"} <= set(names)
    df = spark.createDataFrame([(A, B, 1), (A, A, 2), ("", "", None)], "a string, b string, v long")
    df.select(U.sketch(F.col("a"), 2, 32).alias("a"), U.sketch(F.col("b"), 2, 32).alias("b"), U.simhash_text(F.col("a"), 2).alias("f"), U.simhash_text(F.col("b"), 2).alias("g"), "v").createOrReplaceTempView("e")
    got = spark.sql("SELECT cl_jaccard(a, b) j, cl_containment(a, b) c, cl_cardinality(a) n, cl_distance(f, g) d, cl_cosine(f, g) s, cl_is_empty(a) e, cl_unmarshal_signature(cl_marshal_signature(a, 7), 32, 7) = a r, cl_decode_fingerprint(cl_marshal_fingerprint(f)) = f q FROM e").collect()
    want = spark.table("e").select(C.jaccard(F.col("a"), F.col("b")), C.containment(F.col("a"), F.col("b")), C.cardinality(F.col("a")), C.distance(F.col("f"), F.col("g")), C.cosine_estimate(F.col("f"), F.col("g")), C.is_empty(F.col("a"))).collect()
    assert [tuple(r)[:6] for r in got] == [tuple(r) for r in want] and all(r.r and r.q for r in got)
    for bad in ("cl_unmarshal_signature(cl_marshal_signature(a, 7), 16, 7)", "cl_unmarshal_signature(cl_marshal_signature(a, 7), 32, 8)", "cl_jaccard(a, slice(b, 1, 3))"):
        with pytest.raises(Exception, match="signature"):
            spark.sql(f"SELECT {bad} FROM e").collect()
    spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") % 700).alias("v")).createOrReplaceTempView("h")
    est = spark.sql("SELECT cl_hll_estimate(cl_hll_union(s)) u FROM (SELECT cl_hll(v, 12) s FROM h GROUP BY g)").first()
    whole = sketches.hll_estimate(sketches.hll_registers(spark.table("h"), [], "v", 12), [], 12).first().estimate
    assert est.u == pytest.approx(whole)
    cells = spark.sql("SELECT c.idx, max(c.rho) rho FROM (SELECT cl_hll_cell(v, 12) c FROM h) GROUP BY c.idx")
    assert {tuple(r) for r in cells.collect()} == {tuple(r) for r in sketches.hll_registers(spark.table("h"), [], "v", 12).collect()}
    with pytest.raises(Exception, match="precisions"):
        spark.sql("SELECT cl_hll_union(s) FROM (SELECT cl_hll(v, 8) s FROM h UNION ALL SELECT cl_hll(v, 9) FROM h)").collect()
    spark.createDataFrame([(1, A)], "id int, t string").createOrReplaceTempView("d1")
    blocks = spark.sql("SELECT b.* FROM d1, LATERAL cl_word_blocks(t, 2, 5) b ORDER BY block").collect()
    assert sum((r.hashes for r in blocks), []) == K.words(A, 2).view(np.int64).tolist() and len(blocks[0].hashes) == 5


def test_overlaps_table_function(spark):
    sql.register(spark)
    pairs = spark.createDataFrame([(1, A, B), (2, A, A), (3, A, None)], "pair int, a string, b string")
    pairs.createOrReplaceTempView("p")
    got = {tuple(r) for r in spark.sql("SELECT pair, o.* FROM p, LATERAL cl_overlaps(a, b, 8, 6) o").collect()}
    assert got == {tuple(r) for r in winnow.overlaps(pairs, 8, 6).collect()} and got


def test_index_tables(spark, tmp_path):
    s = spark.createDataFrame([(1, A), (2, B), (3, A)], "id int, t string").select("id", F.col("id").alias("seq"), U.sketch(F.col("t"), 3, 16).alias("sig"))
    index = lsh.band_table(s, 4, 4)
    index_tables.write_bands(index, str(tmp_path / "bands"))
    back = index_tables.read_index(spark, str(tmp_path / "bands")).select(*index.columns)
    key = lambda d: {tuple(r) for r in d.collect()}
    assert key(lsh.index_query(back, s, 4, 4)) == key(lsh.index_query(index, s, 4, 4))
    f = winnow.fingerprints(spark.createDataFrame([(1, A), (2, B)], "id int, text string"), 8, 6)
    index_tables.write_postings(f, str(tmp_path / "post"))
    assert key(winnow.matches(index_tables.read_index(spark, str(tmp_path / "post")), f, 8)) == key(winnow.matches(f, f, 8))
    assert {r.id for r in index_tables.ids(index).collect()} == {1, 2, 3}


def test_streams_equal_batch(spark, tmp_path):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), (F.col("id") % 90).alias("v"), U.sketch(F.format_string("a b c %d", "id"), 2, 8).alias("sig"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, f in (("hll_s", lambda d: hll_stream(d, ["g"], "v", 8)), ("mh_s", lambda d: minhash_union_stream(d, ["g"]))):
        q = f(src()).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert {tuple(r) for r in spark.table(name).collect()} == {tuple(r) for r in f(df).collect()}
