import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import columns as C
from corpusloom.functions import kernels as K
from corpusloom.functions import udfs as U
from corpusloom.operators import cluster, lsh, sketches, streams, winnow
from corpusloom.plans import registry
from corpusloom.session import BATCH_BYTES, bound_batches, ship
from corpusloom.streaming.chunks import WordScanner, sketch_chunks
from corpusloom.streaming.incremental import dedup_batches


@pytest.fixture(scope="module")
def texts(spark):
    ship(spark)
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta", "theta"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    rows += [(i + 40, t) for i, t in rows[:5]] + [(90, None), (91, ""), (92, "two words"), (93, "x" * 5000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "id long, text string").withColumn("seq", F.col("id"))


def test_udfs_match_kernels(docs, texts):
    t = F.col("text")
    got = {r.id: r for r in docs.select("id", U.words(t, 3).alias("w"), U.char(t, 8).alias("c"), U.sketch(t, 3, 16).alias("s"), U.simhash_text(t).alias("f"), U.char_runes(t, 3).alias("r")).collect()}
    for i, text in texts:
        r = got[i]
        if text is None:
            assert r.w is r.c is r.s is r.f is r.r is None
            continue
        assert r.w == K.words(text, 3).view(np.int64).tolist()
        assert r.c == K.char(text, 8).view(np.int64).tolist()
        assert r.r == K.char_runes(text, 3).view(np.int64).tolist()
        assert r.s == K.minhash(K.words(text, 3), 16, 0).view(np.int64).tolist()
        assert r.f & K.MASK == K.simhash(K.words(text, 3))


def test_batches_to_workers_are_bounded(spark, sf):
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    registry.QUERIES["simhash_text"](spark, sf)
    size = F.arrow_udf("long")(lambda c: pa.array([c.nbytes] * len(c), pa.int64()))
    held = spark.range(3000).coalesce(1).select(size(F.repeat(F.lit("abcd efgh "), 500)).alias("n")).agg(F.max("n")).first()[0]
    assert held <= BATCH_BYTES + 3 * 5000
    spark.conf.set(key, "4k")
    bound_batches(spark)
    assert spark.conf.get(key) == "4k"
    spark.conf.unset(key)


def test_columns(spark):
    ship(spark)
    df = spark.createDataFrame([("one two three four", "one two three five"), ("", ""), ("a b c", "")], "a string, b string")
    df = df.select(U.sketch(F.col("a"), 1, 64).alias("a"), U.sketch(F.col("b"), 1, 64).alias("b"))
    a, b = F.col("a"), F.col("b")
    rows = df.select(C.jaccard(a, b), C.similarity(a, b), C.containment(a, b), C.cardinality(a), C.text_containment(a, b), C.is_empty(C.union_signature(a, b))).collect()
    assert 0.3 < rows[0][0] < 0.9 and rows[0][0] == rows[0][1]
    assert rows[1][0] == 1.0 and rows[1][1] == 0.0 and rows[1][3] == 0.0 and rows[1][5]
    assert rows[2][1] == rows[2][4] == 0.0 and not rows[2][5]
    with pytest.raises(Exception, match="slots"):
        df.select(C.jaccard(a, F.slice(b, 1, 3))).collect()


def brute_pairs(sigs, least, bands, rows):
    keys = {i: K.band_keys(s, bands, rows) for i, s in sigs.items()}
    return {(a, b, float((sigs[a] == sigs[b]).mean())) for a in sigs for b in sigs if a < b and (keys[a] == keys[b]).any() and (sigs[a] == sigs[b]).mean() >= least}


def test_similarity_join_and_queries(docs, texts):
    s = docs.select("id", "seq", U.sketch(F.col("text"), 2, 32).alias("sig"))
    sigs = {i: K.minhash(K.words(t, 2), 32, 0) for i, t in texts if t is not None}
    want = brute_pairs(sigs, 0.3, 8, 4)
    joined = lsh.similarity_join(s, 8, 4, 0.3).cache()
    assert {tuple(r) for r in lsh.spread(joined).collect()} == want
    first = {}
    for i, x in sorted(sigs.items()):
        first.setdefault(x.tobytes(), i)
    rep = {i: first[x.tobytes()] for i, x in sigs.items()}
    assert {tuple(r) for r in joined.collect()} == {(a, b, j) for a, b, j in want if rep[a] == a and rep[b] == b} | {(rep[i], i, 1.0) for i in sigs if rep[i] != i}
    assert joined.count() < len(want)
    got = {(r.query, r.id, r.similarity) for r in lsh.verified_query(s, s, 8, 4, 0.3).collect()}
    assert {(a, b, j) for a, b, j in got if a < b} == want
    index = lsh.band_table(s, 8, 4)
    asked = {(r.query, r.id) for r in lsh.index_query(index, s, 8, 4).collect()}
    assert {(a, b) for a, b, _ in brute_pairs(sigs, 0, 8, 4)} == {(a, b) for a, b in asked if a < b}
    st = lsh.stats(index).first()
    assert st.ids == len(sigs) and st.entries == 8 * len(sigs)
    gone = lsh.remove(index, docs.where("id < 10").select("id"))
    assert lsh.stats(gone).first().ids == len([i for i in sigs if i >= 10])
    assert lsh.stats(index.where("false")).first().entries == 0
    short = [i for i, t in texts if t is not None and not len(K.words(t, 2))]
    assert short and lsh.stats(lsh.band_table(s, 8, 4, drop_empty=True)).first().ids == len(sigs) - len(short)


def test_verified_readd_replaces(spark):
    ship(spark)
    rows = [(1, "a", "one two three"), (2, "a", "four five six"), (3, "b", "one two three")]
    s = spark.createDataFrame(rows, "seq int, id string, text string").select("seq", "id", U.sketch(F.col("text"), 1, 16).alias("sig"))
    q = s.where("seq = 3")
    assert [r.id for r in lsh.verified_query(s, q, 4, 4, 0.9).collect()] == ["b"]


def test_forest(docs, texts):
    s = docs.select("id", "seq", U.sketch(F.col("text"), 2, 16).alias("sig"))
    sigs = {i: K.minhash(K.words(t, 2), 16, 0).tolist() for i, t in texts if t is not None}
    got = {}
    for r in lsh.forest_query(lsh.forest_table(s, 4, 4), s, 4, 4, 5).collect():
        got.setdefault(r.query, []).append((r.rank, r.id))

    def best(q, x):
        out = []
        for t in range(4):
            a, b = q[4 * t : 4 * t + 4], x[4 * t : 4 * t + 4]
            d = next((i for i in range(4) if a[i] != b[i]), 4)
            if d:
                out.append((-d, t, b))
        return min(out, default=None)

    for q, sig in sigs.items():
        want = sorted((best(sig, x), i) for i, x in sigs.items() if best(sig, x))[:5]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]


@pytest.mark.parametrize("d", [1, 2, 3])
def test_hamming_exact(spark, d):
    rng = random.Random(d)
    base = 0xDEADBEEFCAFEF00D
    fps = [base]
    for _ in range(60):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randrange(0, 4)):
            x ^= 1 << b
        fps.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "id int, fp long").withColumn("seq", F.col("id"))
    want = {(a, b, (fps[a] ^ fps[b]).bit_count()) for a in range(61) for b in range(a + 1, 61) if (fps[a] ^ fps[b]).bit_count() <= d}
    assert {tuple(r) for r in lsh.spread(lsh.hamming_join(df, d), "distance", 0).collect()} == want
    assert {tuple(r) for r in lsh.spread(lsh.hamming_join(df, d, 0), "distance", 0).collect()} == want
    assert all(m.bit_count() == 32 or d == 3 and 31 <= m.bit_count() <= 33 for m in lsh.wide_masks(d))
    got = {(r.query, r.id) for r in lsh.hamming_query(lsh.hamming_table(df, d), df, d).collect()}
    assert {(a, b) for a, b in got if a < b} == {(a, b) for a, b, _ in want}
    with pytest.raises(ValueError):
        lsh.hamming_table(df, 4)


def test_aggregated_sketches(docs, texts):
    h = docs.withColumn("g", F.col("id") % 3).select("g", F.explode_outer(U.words(F.col("text"), 2)).alias("h"))
    by = {g: np.concatenate([K.words(t, 2) for i, t in texts if t is not None and i % 3 == g]) for g in range(3)}
    got = {r.g: r.sig for r in sketches.minhash_agg(h.repartition(7), ["g"], k=16).collect()}
    assert got == {g: K.minhash(x, 16, 0).view(np.int64).tolist() for g, x in by.items()}
    fp = {r.g: r.fp & K.MASK for r in sketches.simhash_agg(h, ["g"]).collect()}
    assert fp == {g: K.simhash(x) for g, x in by.items()}
    regs = sketches.hll_registers(h, ["g"], "h", 8)
    back = sketches.hll_from_bytes(sketches.hll_bytes(regs, ["g"], 8), ["g"])
    assert {tuple(r) for r in back.drop("p").collect()} == {tuple(r) for r in regs.select("g", "idx", "rho").collect()}
    both = sketches.hll_merge(regs.where("g = 0"), regs.where("g = 1").withColumn("g", F.col("g") * 0), ["g"])
    union = sketches.hll_registers(h.where("g < 2").withColumn("g", F.lit(0).cast("long")), ["g"], "h", 8)
    assert {tuple(r) for r in both.collect()} == {tuple(r) for r in union.collect()}


def test_hll_precision_and_empty(spark, tmp_path):
    a, b = (sketches.hll_registers(spark.range(100), [], "id", p) for p in (8, 9))
    with pytest.raises(ValueError, match="precision 9"):
        sketches.hll_merge(a, b, [])
    with pytest.raises(ValueError, match="precision 8"):
        sketches.hll_estimate(a, [], 10)
    with pytest.raises(ValueError, match="precision 8"):
        sketches.hll_bytes(sketches.hll_merge(a, a, []), [], 10)
    a.write.parquet(str(tmp_path / "r"))
    with pytest.raises(ValueError, match="precision"):
        sketches.hll_merge(b, spark.read.parquet(str(tmp_path / "r")), [])
    assert sketches.hll_estimate(a.where("false"), [], 8).collect()[0].estimate == 0.0
    assert sketches.hll_estimate(a.where("false").withColumn("g", F.lit(1)), ["g"], 8).count() == 0


def test_union_agg(docs, texts):
    s = docs.select((F.col("id") % 3).alias("g"), U.sketch(F.col("text"), 2, 16).alias("sig")).repartition(5)
    want = {g: np.minimum.reduce([K.minhash(K.words(t, 2), 16, 0) for i, t in texts if t is not None and i % 3 == g]).view(np.int64).tolist() for g in range(3)}
    assert {r.g: r.sig for r in sketches.union_agg(s, ["g"]).collect()} == want
    assert sketches.union_agg(s.drop("g"), []).first().sig == np.minimum.reduce([np.array(x).view(np.uint64) for x in want.values()]).view(np.int64).tolist()


def test_space_saving_in_batches(spark):
    """Groups and a stream without keys, with evictions, against the sketch itself; counts of items with and without a counter."""
    rng = random.Random(3)
    rows = [(i, i % 2 if i % 5 else None, int(rng.paretovariate(0.6)) % 60 if i % 11 else None, i % 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "at int, g int, x int, w int").repartition(6)

    def brute(keep):
        s = streams.SpaceSaving(7)
        for r in rows:
            if keep(r) and r[2] is not None:
                s.add(r[2], r[3])
        return s

    whole = streams.space_saving(df, [], "x", ["at"], 7, "w")
    s = brute(lambda r: True)
    assert [(r.item, r["count"], r.err, r.total) for r in whole.collect()] == [(*t, s.n) for t in s.top()]
    got = {}
    for r in streams.space_saving(df, ["g"], "x", ["at"], 7, "w").collect():
        got.setdefault(r.g, []).append((r.item, r["count"], r.err, r.total))
    assert got == {g: [(*t, b.n) for t in b.top()] for g in (0, 1, None) for b in [brute(lambda r, g=g: r[1] == g)]}
    asked = spark.range(62).select(F.col("id").cast("int").alias("item"))
    assert {(r.item, r["count"], r.err, r.tracked) for r in streams.space_saving_count(whole, asked, 7).collect()} == {(i, *s.count(i), i in s.held) for i in range(62)}
    assert streams.space_saving(df.where("false"), [], "x", ["at"], 7).count() == 0


def test_winnow_is_not_bounded_by_default(spark):
    text = "ab" * 300
    f = winnow.fingerprints(spark.createDataFrame([(1, text), (2, text)], "id int, text string"), 4, 3)
    shared = {r.id: r.n for r in f.join(f.select("hash", F.col("id").alias("q")), "hash").where("q = 1").groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert min(shared.values()) > 1000
    whole, few = winnow.matches(f, f, 4), winnow.matches(f, f, 4, 100)
    assert whole.count() > few.count() > 0


def test_hll_bound(spark):
    est = sketches.hll_estimate(sketches.hll_registers(spark.range(50_000), [], "id", 12), [], 12).first()[0]
    assert abs(est / 50_000 - 1) < 3 * 1.04 / 64


def brute_matches(q, d, k, w):
    hq, hd = K.char(q, k), K.char(d, k)
    fq, fd = K.winnow(hq, w).tolist(), K.winnow(hd, w).tolist()
    on = {(j, p - x) for j, x in enumerate(fq) for p in fd if hq[x] == hd[p]}
    out = set()
    for j, diag in on:
        if (j - 1, diag) not in on:
            e = j
            while (e + 1, diag) in on:
                e += 1
            out.add((fq[j], fq[j] + diag, fq[e] - fq[j] + k))
    return out


def test_winnow(docs, texts):
    f = winnow.fingerprints(docs, 6, 4)
    held = [(i, t) for i, t in texts if t]
    got = {}
    for r in winnow.matches(f, f, 6).collect():
        got.setdefault((r.query, r.id), set()).add((r.qpos, r.dpos, r.len))
    for i, a in held[:12]:
        for j, b in held[:12]:
            assert got.get((i, j), set()) == brute_matches(a, b, 6, 4)
    df = {r.hash: r.docs for r in winnow.doc_freq(f).collect()}
    sets = {i: {int(K.char(t, 6)[p].view(np.int64)) for p in K.winnow(K.char(t, 6), 4)} for i, t in held}
    assert df == {h: sum(h in s for s in sets.values()) for s in sets.values() for h in s}
    native = winnow.select_minima(docs.select("id", F.posexplode(U.char(F.col("text"), 6)).alias("pos", "h")), 4)
    assert {tuple(r) for r in native.collect()} == {(r.id, r.pos, r.hash) for r in f.collect()}
    assert winnow.cover(f, f, 6, 10**6, 1).count() == 0


def test_winnow_cap_and_wire_story(spark):
    ship(spark)
    a = "The city council approves the marina expansion project after a seven to two vote on Tuesday night."
    b = "Breaking: council approves the marina expansion project after a seven to two votes, sources say."
    pairs = spark.createDataFrame([(1, a, b)], "pair int, a string, b string")
    span = winnow.overlaps(pairs, 8, 6).first()
    assert a.encode()[span.pos_a : span.pos_a + span.len] == b.encode()[span.pos_b : span.pos_b + span.len]
    rep = spark.createDataFrame([(1, "abababab" * 200, "abababab" * 200)], "pair int, a string, b string")
    assert winnow.overlaps(rep, 8, 6, limit=100).count() <= 100


def test_space_saving():
    s = streams.SpaceSaving(2)
    for x in "aabc":
        s.add(x)
    assert s.top() == [("a", 2, 0), ("c", 2, 1)] and s.count("b") == (2, 2)
    rng = random.Random(1)
    items = [int(rng.paretovariate(0.8)) for _ in range(5000)]
    truth = {x: items.count(x) for x in set(items)}
    whole, left, right = (streams.SpaceSaving(20) for _ in range(3))
    for i, x in enumerate(items):
        whole.add(x)
        (left if i < 2000 else right).add(x)
    left.merge(right)
    for sk in (whole, left):
        assert sk.n == 5000
        for x, c, e in sk.top():
            assert c - e <= truth[x] <= c
        assert all(x in sk.held for x, n in truth.items() if n > 5000 / 10)
    with pytest.raises(ValueError):
        streams.SpaceSaving(0)


def test_stream_operators(spark):
    ship(spark)
    m = spark.range(10000).select("id", F.format_string("msg-%04d", "id").alias("m"))
    got = [r.item for r in streams.reservoir(m, [], "m", ["id"], 3, 1).orderBy("slot").collect()]
    assert got == ["msg-3058", "msg-9269", "msg-6440"]
    few = streams.reservoir(m.where("id < 2"), [], "m", ["id"], 3, 1).orderBy("slot").collect()
    assert [r.item for r in few] == ["msg-0000", "msg-0001"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "a", "b", "c", None])], "o int, x string")
    assert {(r.item, r["count"], r.err, r.total) for r in streams.space_saving(df, [], "x", ["o"], 2).collect()} == {("a", 2, 0, 4), ("c", 2, 1, 4)}
    z = spark.range(4000).select(F.floor(F.log(F.col("id") + 1) * 3).alias("x")).repartition(5)
    truth = {r.x: r.n for r in z.groupBy("x").agg(F.count("*").alias("n")).collect()}
    for r in streams.space_saving_merged(z, "x", 8).collect():
        assert r["count"] - r.err <= truth[r.item] <= r["count"]
    with pytest.raises(ValueError):
        streams.reservoir(m, [], "m", [], 3, 1)


def test_clusters(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(160)]
    comp = {i: i for i in range(200)}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        comp[max(a, b)] = min(a, b)
    e = spark.createDataFrame([*edges, (None, 3)], "a int, b int")
    want = {i: find(i) for e in edges for i in e}
    assert {r.id: r.root for r in cluster.connected_components(e).collect()} == want
    ids = spark.createDataFrame([("m", 0), ("n", 1), ("q", 2), ("o", 3), ("p", 4)], "id string, seq int")
    links = spark.createDataFrame([("m", "n"), ("o", "p"), ("p", "m")], "a string, b string")
    assert [r.members for r in cluster.clusters(ids, links).orderBy("rep").collect()] == [["m", "n", "o", "p"], ["q"]]
    assert cluster.connected_components(links.where("false")).count() == 0
    labels = spark.createDataFrame([("m", "m"), ("n", "m")], "id string, rep string")
    asked = spark.createDataFrame([("m", "n"), ("m", "z")], "a string, b string")
    assert [r.same for r in cluster.same(labels, asked).orderBy("b").collect()] == [True, False]


@pytest.mark.parametrize("size", [1, 3, 17, 1 << 20])
@pytest.mark.parametrize("w", [1, 3])
def test_scanner(size, w):
    raw = ("Résumé, façade-naïve 𝐀x KK_y the quick brown fox " * 5).encode() + b"\xfftail"
    scan = WordScanner(w)
    parts = [scan.write(raw[i : i + size]) for i in range(0, len(raw), size)] + [scan.finish()]
    assert np.concatenate(parts).tolist() == K.words(raw, w).tolist()
    with pytest.raises(ValueError):
        scan.write(b"x")


def test_word_blocks(spark):
    from corpusloom.streaming.chunks import blocks_of, word_blocks

    ship(spark)
    text = "Résumé, façade-naïve 𝐀x KK_y the quick brown fox " * 300
    for raw in (text, text.encode(), "one two", "", b"\xff" * 5000 + b" a b c"):
        whole = K.words(raw, 3)
        for size in (1, 7, 256, 10**6):
            got = list(blocks_of(raw, 3, size, 97))
            assert [len(b) for b in got] == [min(size, len(whole) - i) for i in range(0, len(whole), size)]
            assert np.array_equal(np.concatenate([whole[:0], *got]), whole)
    scanned = blocks_of("a b c d " * 10**6, 2, 5)
    assert next(scanned).tolist() == K.words("a b c d " * 3, 2)[:5].tolist()
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [r.b for r in df.select(word_blocks(F.col("t"), 3, 100, 2).alias("b")).collect()]
    assert got == [K.words(text, 3)[:200].view(np.int64).reshape(2, 100).tolist(), None, []]
    with pytest.raises(ValueError):
        word_blocks(F.col("t"), 0, 1)


def _run(stream, mode, name, path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path / name)).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_streaming_space_saving_and_reservoir(spark, tmp_path):
    from corpusloom.streaming.incremental import reservoir_stream, space_saving_stream

    ship(spark)
    rng = random.Random(8)
    rows = [(i, i % 2, f"x{int(rng.paretovariate(0.6)) % 40}") for i in range(600)]
    df = spark.createDataFrame(rows, "at int, g int, x string")
    for part in range(3):
        df.where(F.floor(F.col("at") / 200) == part).coalesce(1).write.parquet(str(tmp_path / f"in/part={part}"))
    paths = sorted(p for p in (tmp_path / "in").rglob("*.parquet"))
    for n, p in enumerate(sorted(paths, key=lambda p: p.parent.name)):
        os.utime(p, (1_700_000_000 + n, 1_700_000_000 + n))
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    newest = lambda t: spark.createDataFrame(t.collect(), t.schema)
    last = lambda t: newest(t).join(newest(t).groupBy("g").agg(F.max("version").alias("version")), ["g", "version"])
    held = last(_run(space_saving_stream(source(), "g", "x", ["at"], 6), "update", "tops", tmp_path))
    want = streams.space_saving(df, ["g"], "x", ["at"], 6)
    assert {(r.g, r.item, r["count"], r.err, r.total) for r in held.collect()} == {(r.g, r.item, r["count"], r.err, r.total) for r in want.collect()}
    got = last(_run(reservoir_stream(source(), "g", "x", ["at"], 5, 9), "update", "samples", tmp_path))
    assert {(r.g, r.slot, r.item) for r in got.collect()} == {(r.g, r.slot, r.item) for r in streams.reservoir(df, ["g"], "x", ["at"], 5, 9).collect()}


def test_signature_of_a_running_document(spark, tmp_path):
    """After each micro-batch, the signature of the text so far; the document goes on as if none had been asked for."""
    from corpusloom.streaming.chunks import sketch_stream

    ship(spark)
    parts = ["one two th", "ree four fi", "ve six seven"]
    schema = "doc_id string, chunk_seq int, chunk binary, last boolean"
    for n, x in enumerate(parts):
        spark.createDataFrame([("a", n, bytearray(x.encode()), n == 2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    for p in (tmp_path / "in").rglob("*.parquet"):
        t = 1_700_000_000 + int(p.parent.name)
        os.utime(p, (t, t))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = _run(sketch_stream(src, 2, 16, running=True), "append", "running", tmp_path).collect()
    want = [K.minhash(K.words("".join(parts[: i + 1]), 2), 16, 0).view(np.int64).tolist() for i in range(3)]
    assert [(r.n_chunks, r.sig, r.done) for r in sorted(got, key=lambda r: r.n_chunks)] == [(i + 1, want[i], i == 2) for i in range(3)]


def test_scratch_is_removed(spark):
    from pathlib import Path

    from corpusloom.sources import scratch

    path = scratch.new_folder(spark, "t")
    spark.range(3).write.parquet(path)
    there = Path(path.removeprefix("file:"))
    assert there.exists()
    scratch.delete(spark, path)
    assert not there.exists()


def test_chunks_batch_and_stream(spark, tmp_path):
    from corpusloom.streaming.chunks import sketch_stream

    ship(spark)
    text = "Résumé of the quick brown fox, jumping over the lazy dog again and again".encode()
    rows = [("a", i // 7, bytearray(text[i : i + 7]), i + 7 >= len(text)) for i in range(0, len(text), 7)] + [("b", 0, bytearray(b"one two three four"), True)]
    schema = "doc_id string, chunk_seq int, chunk binary, last boolean"
    df = spark.createDataFrame(rows, schema)
    want = {"a": K.minhash(K.words(text, 3), 16, 0).view(np.int64).tolist(), "b": K.minhash(K.words(b"one two three four", 3), 16, 0).view(np.int64).tolist()}
    assert {r.doc_id: r.sig for r in sketch_chunks(df, 3, 16).collect()} == want
    for part, cond in enumerate(["chunk_seq < 4", "chunk_seq >= 4"]):
        df.where(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del part
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = sketch_stream(src, 3, 16).writeStream.format("memory").queryName("sk").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.doc_id: r.sig for r in spark.table("sk").collect()} == want


def test_dedup_batches(spark, tmp_path):
    ship(spark)
    a = "one two three four five six seven eight nine ten"
    sink = dedup_batches(str(tmp_path / "ix"), 0.5)
    sink(spark.createDataFrame([(1, 1, a), (2, 2, "nothing alike at all here friend")], "id int, seq int, text string"), 0)
    sink(spark.createDataFrame([(3, 3, a), (4, 4, a + " eleven")], "id int, seq int, text string"), 1)
    sink(spark.createDataFrame([(3, 3, a), (4, 4, a + " eleven")], "id int, seq int, text string"), 1)
    got = {(r.id, r.earlier) for r in spark.read.parquet(str(tmp_path / "ix/pairs")).collect()}
    assert (3, 1) in got and (4, 3) in got and all(x > y for x, y in got) and not any(2 in p for p in got)


def test_best_overlaps(spark):
    ship(spark)
    rng = random.Random(8)
    sets = {i: sorted(rng.sample(range(60), rng.randrange(0, 25))) for i in range(120)} | {200: list(range(60)), 201: list(range(60))}
    index = spark.createDataFrame(list(sets.items()), "id long, hashes array<bigint>").repartition(5)
    want = {}
    for q in [*range(0, 120, 5), 200]:
        shared = {i: len({*sets[q]} & {*s}) for i, s in sets.items() if i != q}
        i = min(shared, key=lambda i: (-shared[i], i))
        if shared[i]:
            want[q] = (i, shared[i])
    for block in (1 << 20, 100):
        got = winnow.best_overlaps(index, index.where("id % 5 = 0 AND id <> 201"), block).collect()
        assert {r.query: (r.id, r.shared) for r in got} == want
    assert winnow.best_overlaps(index, index.where("false")).count() == 0


def test_overlaps_of_periodic_texts(spark):
    """Texts that repeat one line share as many matches as the product of their lengths; rows of matches took gigabytes."""
    ship(spark)
    a, b = "some line of text again. " * 4000, "more. " + "some line of text again. " * 4000
    spans = {(r.pos_a, r.pos_b, r.len) for r in winnow.overlaps(spark.createDataFrame([(1, a, b)], "pair int, a string, b string"), 8, 6).collect()}
    assert any(n > 99_000 for _, _, n in spans) and len(spans) > 7000
    for x, y in (("xyzzy " * 40 + "end of it all", "so " + "xyzzy " * 30 + "end of it"), ("abc" * 50, "abcab" * 40), ("", "some words here"), ("one and only one text", "nothing like that 1234")):
        assert {tuple(r) for r in K.overlap_spans(x, y, 6, 4).tolist()} == {(p, q, n) for q, p, n in brute_matches(y, x, 6, 4)}


def test_forest_with_a_prefix_that_all_share(spark):
    """20,000 queries and entries under one prefix: 400 million pairs, if all were compared."""
    rng = random.Random(9)
    keys = {i: [7, rng.randrange(-2, 2), rng.randrange(-40, 40)] for i in range(20_000)} | {20_000 + i: [7, 1, 50 + i] for i in range(3)}
    sigs = spark.createDataFrame([(i, i, k) for i, k in keys.items()], "id long, seq long, sig array<bigint>")
    again = spark.createDataFrame([(5, 30_000 + j, [7, 0, -60 + j]) for j in range(9)], "id long, seq long, sig array<bigint>")
    got = {}
    for r in lsh.forest_query(lsh.forest_table(sigs.unionByName(again), 1, 3), sigs, 1, 3, 4).where("query % 4001 = 0 OR query >= 20000").collect():
        got.setdefault(r.query, []).append((r.rank, r.id, r.depth))
    held = [(k, i, i) for i, k in keys.items()] + [([7, 0, -60 + j], 30_000 + j, 5) for j in range(9)]
    for q in [*range(0, 20_000, 4001), 20_000, 20_001, 20_002]:
        best = {}
        for k, seq, i in held:
            d = next((n for n in range(3) if k[n] != keys[q][n]), 3)
            at = (-d, [x & K.MASK for x in k], seq, i)
            best[i] = min(best.get(i, at), at)
        want = sorted(best.values())[:4]
        assert sorted(got[q]) == [(n + 1, x[3], -x[0]) for n, x in enumerate(want)]


def test_winnow_of_texts(docs, texts):
    """The same rows as over fingerprints, with ids once or again; no fingerprint goes through a join."""
    again = docs.unionByName(docs.where("id < 20").withColumn("text", F.reverse("text")))
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    for d in (docs, again, docs.where("false")):
        f = winnow.fingerprints(d, 6, 4)
        assert rows(winnow.doc_freq_texts(d, 6, 4)) == rows(winnow.doc_freq(f))
    f = winnow.fingerprints(docs, 6, 4)
    for n, run in ((1, 0), (3, 2), (4, 2)):
        assert rows(winnow.cover_texts(docs, 6, 4, n, run)) == rows(winnow.cover(f, f, 6, n, run))
    twice = docs.unionByName(docs.where("id < 20"))
    assert rows(winnow.cover_texts(twice, 6, 4, 3, 2)) == rows(winnow.cover(*[winnow.fingerprints(twice, 6, 4)] * 2, 6, 3, 2))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "ord#" not in plan(winnow.cover_texts(docs, 6, 4, 3, 2))
    f = f.where("id <> 93")  # matches itself at 25 million places
    few, many = plan(winnow.matches(f, f, 6)), winnow.matches(f.unionByName(f), f, 6)
    assert "strategy=broadcast" in few and few.count("Aggregate") == 1  # no posting is shuffled before it matches
    assert rows(many) == rows(winnow.matches(f, f, 6))
