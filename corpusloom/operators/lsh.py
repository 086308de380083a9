"""Banded, verified, prefix-forest and Hamming indexes as tables and joins.

An index is a DataFrame: adding is a union, removing an anti-join, a query a
join.  ``seq`` is the order of insertion.  Texts without shingles share every
band key; ``drop_empty`` leaves them out of a join.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import columns as C
from corpusloom.functions import udfs as U
from corpusloom.sources.scratch import written


def band_table(sigs: DataFrame, bands: int, rows: int, id: str = "id", seq: str = "seq", sig: str = "sig", drop_empty: bool = False) -> DataFrame:
    """(band, key, seq, id), a row per band of each signature; rows with a null id or signature are left out.

    With ``drop_empty`` so are empty sets, which all share every key and would be one quadratic bucket per band.
    """
    held = sigs.where(F.col(id).isNotNull() & F.col(sig).isNotNull())
    if drop_empty:
        held = held.where(~C.is_empty(F.col(sig)))
    keys = held.select(F.col(seq).alias("seq"), F.col(id).alias("id"), U.band_keys(F.col(sig), bands, rows).alias("keys"))
    return keys.select(F.posexplode("keys").alias("band", "key"), "seq", "id")


def index_query(index: DataFrame, queries: DataFrame, bands: int, rows: int) -> DataFrame:
    """(query, id, rank): ids that agree with a query (id, sig) in some band, by first such band, then insertion."""
    asked = queries.select(F.col("id").alias("query"), U.band_keys(F.col("sig"), bands, rows).alias("keys")).select("query", F.posexplode("keys").alias("band", "key"))
    hit = asked.join(index, ["band", "key"]).groupBy("query", "id").agg(F.min(F.struct("band", "seq")).alias("first"))
    w = Window.partitionBy("query").orderBy("first.band", "first.seq", "id")
    return hit.select("query", "id", F.row_number().over(w).alias("rank"))


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without every entry of the ids."""
    return index.join(ids.select("id").distinct(), "id", "left_anti").select(*index.columns)


def stats(index: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row: (ids, buckets, entries, max_bucket)."""
    key = key or ["band", "key"]
    sizes = index.groupBy(*key).agg(F.count("*").alias("n"))
    buckets = sizes.agg(F.count("*").alias("buckets"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.coalesce(F.max("n"), F.lit(0)).alias("max_bucket"))
    return index.agg(F.countDistinct("id").alias("ids")).crossJoin(buckets)


def latest(sigs: DataFrame) -> DataFrame:
    """Of entries (seq, id, sig) with the same id, the last one added."""
    return sigs.groupBy("id").agg(F.max_by(F.struct("seq", "sig"), "seq").alias("x")).select("x.seq", "id", "x.sig")


def verified_query(sigs: DataFrame, queries: DataFrame, bands: int, rows: int, least: float = 0.0) -> DataFrame:
    """(query, id, similarity, rank): banded candidates with at least the similarity, best first, then by id."""
    held = latest(sigs)
    pairs = index_query(band_table(held, bands, rows), queries, bands, rows).select("query", "id")
    known = held.select("id", F.col("sig").alias("_sig"))
    asked = queries.select(F.col("id").alias("query"), F.col("sig").alias("_query_sig"))
    scored = pairs.join(known, "id").join(asked, "query").select("query", "id", C.jaccard(F.col("_query_sig"), F.col("_sig")).alias("similarity")).where(F.col("similarity") >= least)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(w))


def classes(df: DataFrame, value: str = "sig") -> DataFrame:
    """(id, seq, rep, value): the class of rows with equal signatures or fingerprints, by its least id.

    Classes are told by 128 bits of the value.  Rows with a null id or value are
    left out.  Sketches are worked out once, into the shared folder.
    """
    held = df.where(F.col("id").isNotNull() & F.col(value).isNotNull())
    held = written(held.select("id", "seq", value, F.xxhash64(value).alias("_k1"), F.xxhash64(F.lit(1), value).alias("_k2")), "classes")
    least = held.groupBy("_k1", "_k2").agg(F.min("id").alias("rep"))
    return held.join(least, ["_k1", "_k2"]).select("id", "seq", "rep", value)


def representatives(classed: DataFrame, value: str = "sig") -> DataFrame:
    """(seq, id, value): one row for each class, its least id's."""
    return classed.where(F.col("id") == F.col("rep")).select("seq", "id", value)


def similarity_join(sigs: DataFrame, bands: int, rows: int, least: float, drop_empty: bool = False) -> DataFrame:
    """(a, b, similarity): near pairs among classes of equal signatures, and each class's members.

    Pairs are of the least ids of two classes that share a band and reach the
    similarity, a < b; every other member b of a class has one row with the
    class's least id as a and similarity 1.  So a group of copies costs its
    members and not its pairs, and no link between unlike signatures is lost:
    see :func:`spread` for all pairs of ids.
    """
    held = sigs if "seq" in sigs.columns else sigs.withColumn("seq", F.lit(0))
    if drop_empty:
        held = held.where(~C.is_empty(F.col("sig")))
    classed = written(classes(held), "classed")
    reps = representatives(classed)
    keys = written(reps.select("id", F.posexplode(U.band_keys(F.col("sig"), bands, rows)).alias("band", "key")), "keys")
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    keys = keys.join(shared, ["band", "key"])
    pairs = keys.select("band", "key", F.col("id").alias("a")).join(keys.select("band", "key", F.col("id").alias("b")), ["band", "key"]).where("a < b").select("a", "b").distinct()
    pairs = pairs.join(reps.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(reps.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    near = pairs.select("a", "b", C.jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= least).distinct()
    copies = classed.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    return near.unionByName(copies)


def spread(pairs: DataFrame, value: str = "similarity", same: float | int = 1.0) -> DataFrame:
    """(a, b, value): all pairs of ids out of the pairs of a join; quadratic in the copies of a text."""
    classed = pairs.where(F.col(value) == same).select("a", "b")
    member = classed.select(F.col("b").alias("id"), F.col("a").alias("rep"))
    reps = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(member.select("id"), "id", "left_anti").select("id", F.col("id").alias("rep"))
    all_ = member.unionByName(reps)
    across = pairs.where(F.col(value) != same).select("a", "b", value).unionByName(reps.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(same).alias(value)))
    out = across.join(all_.select(F.col("id").alias("x"), F.col("rep").alias("a")), "a").join(all_.select(F.col("id").alias("y"), F.col("rep").alias("b")), "b")
    return out.where("a <> b OR x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), value)


def forest_table(sigs: DataFrame, trees: int, depth: int) -> DataFrame:
    """(tree, key, seq, id): each tree's stretch of the signature."""
    if trees <= 0 or depth <= 0:
        raise ValueError("trees and depth must be positive")
    part = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice(F.col("sig"), t * depth + 1, depth))
    return sigs.where("id IS NOT NULL AND sig IS NOT NULL").select("seq", "id", F.posexplode(part).alias("tree", "key")).select("tree", "key", "seq", "id")


def _shared(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x == y)
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, F.size(a)).otherwise(at - 1).cast("int")


def forest_query(forest: DataFrame, queries: DataFrame, trees: int, depth: int, k: int) -> DataFrame:
    """(query, id, depth, rank): up to k ids by longest common prefix, then tree, then key, then insertion.

    Under each prefix of a tree only its first entries are kept, enough for any
    query: before the k-th id fewer than k others were met, so 2k - 1 entries of
    a tree's level have it, and as many more those that go deeper with the query.
    So a prefix that most entries share costs a query no more than another.  An
    id that was added r times counts r times in these numbers.
    """
    m = (2 * k - 1) * max(1, forest.where("tree = 0").groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    asked = forest_table(queries.select(F.lit(0).alias("seq"), "id", "sig"), trees, depth).select("tree", F.col("key").alias("qkey"), F.col("id").alias("query"))
    ordered = F.transform("key", lambda v: C.unsigned(v))
    prefix = lambda key, d: F.slice(key, 1, d)
    first = lambda df, d, most: df.withColumn("_r", F.row_number().over(Window.partitionBy("tree", prefix("u", d)).orderBy("u", "seq", "id"))).where(F.col("_r") <= most).drop("_r")
    kept = written(first(forest.select("tree", ordered.alias("u"), "seq", "id"), depth, m), "forest")
    levels = [kept.withColumn("d", F.lit(depth))]
    for d in range(depth - 1, 0, -1):
        levels.append(first(kept, d, 2 * m).withColumn("d", F.lit(d)))
        kept = first(kept, d, m) if d > 1 else kept
    entries = reduce(DataFrame.unionByName, levels)
    entries = entries.groupBy("tree", "d", prefix("u", F.col("d")).alias("prefix")).agg(F.collect_list(F.struct("u", "seq", "id")).alias("entries"))
    asked = asked.select("query", "tree", F.transform("qkey", lambda v: C.unsigned(v)).alias("qu"))
    asked = asked.select("query", "tree", "qu", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("d")).withColumn("prefix", prefix("qu", F.col("d")))
    on = asked.join(entries, ["tree", "d", "prefix"]).select("query", "tree", "qu", "d", F.explode("entries").alias("e"))
    on = on.where(_shared(F.col("qu"), F.col("e.u")) == F.col("d")).select("query", "tree", "d", "e.u", "e.seq", "e.id")
    near = Window.partitionBy("query").orderBy(F.desc("d"), "tree", "u", "seq", "id")
    best = on.withColumn("at", F.row_number().over(near)).groupBy("query", "id").agg(F.min(F.struct("at", "d")).alias("m"))
    w = Window.partitionBy("query").orderBy("m.at")
    return best.select("query", "id", F.col("m.d").alias("depth"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


#: (shift, width) of each block, by greatest distance.
BLOCKS = {1: ((0, 32), (32, 32)), 2: ((0, 22), (22, 21), (43, 21)), 3: ((0, 16), (16, 16), (32, 16), (48, 16))}


def hamming_table(fps: DataFrame, d: int) -> DataFrame:
    """(block, key, seq, fp, id): two fingerprints within d agree in some block."""
    if d not in BLOCKS:
        raise ValueError("the distance must be 1, 2 or 3")
    keys = F.array(*[F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in BLOCKS[d]])
    return fps.where("id IS NOT NULL AND fp IS NOT NULL").select(F.posexplode(keys).alias("block", "key"), "seq", "fp", "id")


#: Distinct fingerprints beyond which a join goes over keys of 32 bits: with 16 its chance pairs grow as rows squared over 65,536.
WIDE_ROWS = 1 << 21


def wide_masks(d: int) -> list[int]:
    """Masks of half the bits: of 2d blocks every choice of d, one of which two fingerprints within d agree in."""
    ends = [round(64 * i / (2 * d)) for i in range(2 * d + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [sum(c) for c in combinations(blocks, d)]


def wide_table(fps: DataFrame, d: int) -> DataFrame:
    """(block, key, seq, fp, id) like :func:`hamming_table`, with more tables of longer keys."""
    if d not in BLOCKS:
        raise ValueError("the distance must be 1, 2 or 3")
    signed = [m - (1 << 64) if m >> 63 else m for m in wide_masks(d)]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])
    return fps.where("id IS NOT NULL AND fp IS NOT NULL").select(F.posexplode(keys).alias("block", "key"), "seq", "fp", "id")


def hamming_query(index: DataFrame, queries: DataFrame, d: int) -> DataFrame:
    """(query, id, distance, rank): exactly the ids within d, by first agreeing block, then insertion."""
    asked = hamming_table(queries.select(F.lit(0).alias("seq"), "fp", "id"), d).select("block", "key", F.col("fp").alias("qfp"), F.col("id").alias("query"))
    hit = asked.join(index, ["block", "key"]).withColumn("distance", C.distance(F.col("qfp"), F.col("fp"))).where(F.col("distance") <= d)
    best = hit.groupBy("query", "id").agg(F.min(F.struct("block", "seq", "distance")).alias("m"))
    w = Window.partitionBy("query").orderBy("m.block", "m.seq", "id")
    return best.select("query", "id", F.col("m.distance").alias("distance"), F.row_number().over(w).alias("rank"))


def hamming_join(fps: DataFrame, d: int, wide_rows: int = WIDE_ROWS) -> DataFrame:
    """(a, b, distance): pairs within d of the least ids of classes of equal fingerprints, a < b, and, at distance 0, each class's other members b.

    Beyond ``wide_rows`` classes the tables have longer keys; the pairs are the same.
    """
    held = fps if "seq" in fps.columns else fps.withColumn("seq", F.lit(0))
    classed = written(classes(held, "fp"), "classed")
    reps = representatives(classed, "fp")
    t = written((wide_table if reps.count() > wide_rows else hamming_table)(reps, d), "blocks")
    shared = t.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1").select("block", "key")
    t = t.join(shared, ["block", "key"])
    a, b = t.select("block", "key", F.col("fp").alias("fa"), F.col("id").alias("a")), t.select("block", "key", F.col("fp").alias("fb"), F.col("id").alias("b"))
    near = a.join(b, ["block", "key"]).where("a < b").withColumn("distance", C.distance(F.col("fa"), F.col("fb"))).where(F.col("distance") <= d).select("a", "b", "distance").distinct()
    copies = classed.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance")).distinct()
    return near.unionByName(copies)
