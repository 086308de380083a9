"""Registered queries over the sketching operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import columns as C
from corpusloom.functions import udfs as U
from corpusloom.functions.columns import Config
from corpusloom.functions.unicode15 import UNICODE_VERSION
from corpusloom.operators import cluster, lsh, sketches, streams, winnow
from corpusloom.operators.sketcher import Sketcher
from corpusloom.plans import oracle as O
from corpusloom.session import bound_batches
from corpusloom.sources import index_tables
from corpusloom.sources.scratch import new_folder, written

K, W = 8, 6  # winnowing: bytes of a window, windows
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bound_batches(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), "text", "lang")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("item_id").alias("seq"), "text")


def _sigs(df: DataFrame, k: int) -> DataFrame:
    return df.select("id", "seq", U.sketch(F.col("text"), 3, k).alias("sig"))


def _fps(df: DataFrame) -> DataFrame:
    return df.select("id", "seq", U.simhash_text(F.col("text"), 3).alias("fp"))


#: Searches ask for every row whose id is divisible by 20, among all rows.
_ASKED = "id % 20 = 0"


def _search(classed: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(index, queries): the first of each class of equal sketches, and the rows asked for; sketched once."""
    classed = written(classed, "classed")
    return lsh.representatives(classed, value), classed.where(_ASKED).select("seq", "id", value)


_SH = O.shingles("documents", "doc_id")
_SIG16 = f"WITH {_SH}, {O.signatures(16, ids='(SELECT doc_id AS id FROM documents)')}"
_SIG128 = f"WITH {_SH}, {O.signatures(128, ids='(SELECT doc_id AS id FROM documents)')}"
_ITEM = f"WITH {O.shingles('benchmark', 'item_id')}, {O.signatures(128, ids='(SELECT item_id AS id FROM benchmark)')}"
_CLASS = "cl AS (SELECT id, sig, min(id) OVER (PARTITION BY sig) AS rep FROM sigs), rp AS (SELECT id, sig FROM cl WHERE id = rep)"
_FP = f"WITH {_SH}, {O.simhash()}, allf AS (SELECT d.doc_id AS id, coalesce(fp, 0::UBIGINT) AS fp FROM documents d LEFT JOIN fps ON fps.id = d.doc_id)"
_CH = O.char8("benchmark", "item_id")
_WF = f"WITH {_CH}, {O.winnow(W)}"


# --- shingles


@query(f"SELECT doc_id, len({O.TOKENS})::BIGINT AS n_tokens, greatest(len({O.TOKENS}) - 2, 0)::BIGINT AS n_shingles, greatest(octet_length(encode(text)) - 7, 0)::BIGINT AS n_windows, greatest(length(text) - 7, 0)::BIGINT AS n_runes FROM documents")
def shingle_counts(spark, sf_dir):
    """Tokens, word shingles, byte windows and code point windows of each document."""
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        F.col("id").alias("doc_id"), F.size(U.tokens(t)).cast("long").alias("n_tokens"), F.size(U.words(t, 3)).cast("long").alias("n_shingles"),
        F.greatest(F.octet_length("text") - 7, F.lit(0)).cast("long").alias("n_windows"), F.greatest(F.length("text") - 7, F.lit(0)).cast("long").alias("n_runes"),
    )


@query(f"WITH {_CH} SELECT id, pos, {O.signed('h')} AS h FROM ch")
def char_hashes(spark, sf_dir):
    return _items(spark, sf_dir).select("id", F.posexplode(U.char(F.col("text"), 8)).alias("pos", "h"))


@query(f"WITH r AS (SELECT conv_id, turn, unnest(range(0, length(text) - 7))::INT AS pos, unnest(list_transform(range(1, length(text) - 6), lambda i: substr(text, i, 8))) AS tok FROM conversations), th AS (SELECT * FROM {O.token_hash('(SELECT DISTINCT tok FROM r)')}) SELECT conv_id, turn, pos, {O.signed('hash')} AS h FROM r JOIN th USING (tok)")
def char_rune_hashes(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(U.char_runes(F.col("text"), 8)).alias("pos", "h"))


@query(f"WITH tk AS (SELECT doc_id AS id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (SELECT doc_id, {O.TOKENS} AS toks FROM documents)), th AS (SELECT * FROM {O.token_hash('(SELECT DISTINCT tok FROM tk)')}) SELECT id, (pos - 1)::INT AS pos, {O.signed('hash')} AS h FROM tk JOIN th USING (tok)")
def token_hashes(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", F.posexplode(U.token_hashes(F.col("text"))).alias("pos", "h"))


@query(f"WITH {_SH} SELECT id, (pos - 1)::INT AS pos, {O.signed('h')} AS h FROM sh")
def word_shingles(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", F.posexplode(U.words(F.col("text"), 3)).alias("pos", "h"))


# --- MinHash


@query(f"{_SIG16} SELECT id, slot::INT AS slot, {O.signed('v')} AS v FROM slots")
def minhash_sketch(spark, sf_dir):
    return _sigs(_docs(spark, sf_dir), 16).select("id", F.posexplode("sig").alias("slot", "v"))


@query(f"{_SIG16} SELECT lang, slot::INT AS slot, {O.signed('min(v)')} AS v FROM slots JOIN documents ON doc_id = id GROUP BY lang, slot")
def minhash_union(spark, sf_dir):
    """Signature of all texts of a language, as the union of their signatures."""
    sigs = _docs(spark, sf_dir).select("lang", U.sketch(F.col("text"), 3, 16).alias("sig"))
    return sketches.union_agg(sigs, ["lang"]).select("lang", F.posexplode("sig").alias("slot", "v"))


@query(f"{_SIG16} SELECT lang, slot::INT AS slot, {O.signed('min(v)')} AS v FROM slots JOIN documents ON doc_id = id GROUP BY lang, slot")
def minhash_update(spark, sf_dir):
    """The same out of exploded shingles, folded in each task before the shuffle."""
    h = _docs(spark, sf_dir).select("lang", F.explode_outer(U.words(F.col("text"), 3)).alias("h"))
    return sketches.minhash_agg(h, ["lang"], k=16).select("lang", F.posexplode("sig").alias("slot", "v"))


def _card(sig: str, k: int) -> str:
    total = f"list_reduce(list_prepend(0.0::DOUBLE, list_transform({sig}, lambda x: x::DOUBLE / 18446744073709551616.0::DOUBLE)), lambda s, x: s + x)"
    return f"CASE WHEN len(list_filter({sig}, lambda x: x <> {2**64 - 1}::UBIGINT)) = 0 THEN 0.0::DOUBLE ELSE {k}.0::DOUBLE / {total} - 1 END"


@query(f"{_SIG128} SELECT id, round({_card('sig', 128)}, 6) AS cardinality FROM sigs")
def minhash_cardinality(spark, sf_dir):
    return _sigs(_docs(spark, sf_dir), 128).select("id", F.round(C.cardinality(F.col("sig")), 6).alias("cardinality"))


_PAIRS = f"""{_ITEM}, card AS (SELECT id, sig, {_card("sig", 128)} AS c FROM sigs),
pr AS (SELECT a.id AS a, b.id AS b, a.c AS ca, b.c AS cb, {O.same("a.sig", "b.sig", 128)} AS j FROM card a, card b WHERE a.id % 20 = 0)
SELECT a, b, CASE WHEN ca = 0 OR cb = 0 THEN 0.0::DOUBLE ELSE j END AS similarity, j AS jaccard, round(j / (1 + j) * (ca + cb), 6) AS intersection,
  round(CASE WHEN ca <= 0 THEN 0.0::DOUBLE ELSE greatest(least(j / (1 + j) * (ca + cb) / ca, 1.0::DOUBLE), 0.0::DOUBLE) END, 6) AS containment FROM pr"""


@query(_PAIRS)
def item_pairs(spark, sf_dir):
    """Benchmark items asked for against all items, estimated: the one-against-many comparison."""
    s = written(_sigs(_items(spark, sf_dir), 128), "items")
    a, b = s.where(_ASKED).select(F.col("id").alias("a"), F.col("sig").alias("x")), s.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.crossJoin(b).select("a", "b", C.similarity(x, y).alias("similarity"), C.jaccard(x, y).alias("jaccard"), F.round(C.intersection_cardinality(x, y), 6).alias("intersection"), F.round(C.containment(x, y), 6).alias("containment"))


# --- SimHash


@query(f"{_FP} SELECT id, {O.signed('fp')} AS fp FROM allf")
def simhash_text(spark, sf_dir):
    return _fps(_docs(spark, sf_dir)).select("id", "fp")


@query(f"""WITH {O.shingles("documents", "doc_id")}, sums AS (SELECT lang, {", ".join(f"sum(CASE WHEN (h >> {i}) & 1 = 1 THEN n_chars ELSE -n_chars END) > 0 AS b{i}" for i in range(64))} FROM sh JOIN documents ON doc_id = id GROUP BY lang),
f AS (SELECT lang, ({" + ".join(f"CASE WHEN b{i} THEN {1 << i}::UHUGEINT ELSE 0::UHUGEINT END" for i in range(64))})::UBIGINT AS fp FROM sums) SELECT lang, {O.signed("fp")} AS fp FROM f""")
def simhash_weighted(spark, sf_dir):
    """Fingerprint of each language's shingles, weighted by the length of their document."""
    d = _read(spark, sf_dir, "documents").select("lang", "n_chars", F.explode(U.words(F.col("text"), 3)).alias("h"))
    return sketches.simhash_agg(d, ["lang"], weight=F.col("n_chars"))


@query(f"WITH {O.shingles('benchmark', 'item_id')}, {O.simhash()} SELECT a.id AS a, b.id AS b, bit_count(xor(a.fp, b.fp))::INT AS distance, round(cos(bit_count(xor(a.fp, b.fp)) * (pi() / 64)), 9) AS cosine FROM fps a, fps b WHERE a.id <> b.id AND a.id % 20 = 0")
def simhash_distance(spark, sf_dir):
    """Fingerprints of the items asked for against all others."""
    f = written(_fps(_items(spark, sf_dir)), "items")
    a, b = f.where(_ASKED).select(F.col("id").alias("a"), F.col("fp").alias("x")), f.select(F.col("id").alias("b"), F.col("fp").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", C.distance(x, y).alias("distance"), F.round(C.cosine_estimate(x, y), 9).alias("cosine"))


# --- LSH


@query(f"{_SIG16}, {O.bands(4, 4)} SELECT id, band, {O.signed('key')} AS key FROM bk")
def band_keys(spark, sf_dir):
    return lsh.band_table(_sigs(_docs(spark, sf_dir), 16), 4, 4).select("id", "band", "key")


@query(f"{_SIG16}, {_CLASS} SELECT id, rep FROM cl")
def signature_classes(spark, sf_dir):
    """The class of every document: the least id with the same signature."""
    return lsh.classes(_sigs(_docs(spark, sf_dir), 16)).select("id", "rep")


@query(f"{_SIG16}, {_CLASS}, {O.bands(4, 4)}, h AS (SELECT q.id AS query, x.id AS id, min(struct_pack(band := q.band, seq := x.id)) AS first FROM bk q JOIN bk x USING (band, key) WHERE q.id % 20 = 0 AND x.id IN (SELECT id FROM rp) GROUP BY ALL) SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY first.band, first.seq, id)::INT AS rank FROM h")
def lsh_candidates(spark, sf_dir):
    """Classes of signatures that agree in some band with the documents asked for."""
    index, asked = _search(lsh.classes(_sigs(_docs(spark, sf_dir), 16)), "sig")
    return lsh.index_query(lsh.band_table(index, 4, 4), asked, 4, 4)


_STATS = "SELECT (SELECT count(DISTINCT id) FROM {t}) AS ids, count(*) AS buckets, sum(n)::BIGINT AS entries, max(n) AS max_bucket FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})"


@query(f"{_SIG16}, {O.bands(4, 4)} " + _STATS.format(t="bk", k="band, key"))
def lsh_stats(spark, sf_dir):
    return lsh.stats(lsh.band_table(_sigs(_docs(spark, sf_dir), 16), 4, 4))


@query(f"{_SIG16}, {O.bands(4, 4)} SELECT band, {O.signed('key')} AS key, id FROM bk WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def lsh_remove(spark, sf_dir):
    """The band table without the documents labelled toxic."""
    t = lsh.band_table(_sigs(_docs(spark, sf_dir), 16), 4, 4)
    return lsh.remove(t, _read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))).select("band", "key", "id")


@query(f"{_SIG16}, {_CLASS}, {O.bands(4, 4)}, h AS (SELECT DISTINCT q.id AS query, x.id AS id FROM bk q JOIN bk x USING (band, key) WHERE q.id % 20 = 0 AND x.id IN (SELECT id FROM rp)), v AS (SELECT query, h.id, {O.same('a.sig', 'b.sig', 16)} AS similarity FROM h JOIN sigs a ON a.id = query JOIN sigs b ON b.id = h.id) SELECT query, id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id)::INT AS rank FROM v WHERE similarity >= 0.5")
def verified_neighbors(spark, sf_dir):
    """Classes of signatures at least half like the documents asked for."""
    index, asked = _search(lsh.classes(_sigs(_docs(spark, sf_dir), 16)), "sig")
    return lsh.verified_query(index, asked, 4, 4, 0.5)


_NEAR = f"{_SIG128}, {_CLASS}, {O.bands(16, 8)}, h AS (SELECT DISTINCT x.id AS a, y.id AS b FROM (SELECT * FROM bk WHERE id IN (SELECT id FROM rp)) x JOIN (SELECT * FROM bk WHERE id IN (SELECT id FROM rp)) y USING (band, key) WHERE x.id < y.id), np AS (SELECT a, b, {O.same('x.sig', 'y.sig', 128)} AS similarity FROM h JOIN sigs x ON x.id = a JOIN sigs y ON y.id = b), ne AS (SELECT a, b, similarity FROM np WHERE similarity >= 0.5 UNION ALL SELECT rep, id, 1.0::DOUBLE FROM cl WHERE id <> rep)"


@query(f"{_NEAR} SELECT a, b, similarity FROM ne")
def near_duplicate_pairs(spark, sf_dir):
    """Flagship: classes of equal signatures whose estimated Jaccard similarity is at least one half, and each class's members."""
    return lsh.similarity_join(_sigs(_docs(spark, sf_dir), 128), 16, 8, 0.5)


@query("SELECT k, target::DOUBLE AS target, b AS bands, k // b AS rows, round(th, 12) AS threshold FROM (SELECT k, target, b, pow(1.0 / b, 1.0 / (k // b)) AS th, row_number() OVER (PARTITION BY k, target ORDER BY round(abs(pow(1.0 / b, 1.0 / (k // b)) - target), 15), b DESC) AS r FROM (VALUES (128, 0.5), (128, 0.8), (100, 0.7), (64, 0.3)) t(k, target), (SELECT unnest(range(1, 129))::INT AS b) WHERE k % b = 0) WHERE r = 1")
def lsh_params(spark, sf_dir):
    rows = [(k, t, *C.params(k, t)) for k, t in ((128, 0.5), (128, 0.8), (100, 0.7), (64, 0.3))]
    return spark.createDataFrame([(k, t, b, r, round(C.threshold(b, r), 12)) for k, t, b, r in rows], "k int, target double, bands int, rows int, threshold double")


_LCP = "CASE " + " ".join(f"WHEN qk[1:{n}] = k[1:{n}] THEN {n}" for n in (4, 3, 2, 1)) + " ELSE 0 END"


@query(f"{_SIG16}, {_CLASS}, ft AS (SELECT id, t AS tree, sig[t * 4 + 1 : t * 4 + 4] AS k FROM sigs, (SELECT unnest(range(4))::INT AS t)), m AS (SELECT q.id AS query, x.id AS id, q.tree, q.k AS qk, x.k AS k FROM ft q JOIN ft x ON q.tree = x.tree AND q.k[1] = x.k[1] WHERE q.id % 20 = 0 AND x.id IN (SELECT id FROM rp)), b AS (SELECT query, id, min(struct_pack(d := -({_LCP}), tree := tree, k := k, seq := id)) AS f FROM m GROUP BY ALL), r AS (SELECT query, id, -f.d AS depth, row_number() OVER (PARTITION BY query ORDER BY f.d, f.tree, f.k, f.seq)::INT AS rank FROM b) SELECT query, id, depth::INT AS depth, rank FROM r WHERE rank <= 5")
def forest_topk(spark, sf_dir):
    """The five classes nearest to the documents asked for by shared prefix, of 4 trees of depth 4."""
    index, asked = _search(lsh.classes(_sigs(_docs(spark, sf_dir), 16)), "sig")
    return lsh.forest_query(lsh.forest_table(index, 4, 4), asked, 4, 4, 5)


_FCLASS = "fc AS (SELECT id, fp, min(id) OVER (PARTITION BY fp) AS rep FROM allf), fr AS (SELECT id, fp FROM fc WHERE id = rep)"


@query(f"{_FP}, {_FCLASS} SELECT x.id AS a, y.id AS b, bit_count(xor(x.fp, y.fp))::INT AS distance FROM fr x, fr y WHERE x.id < y.id AND bit_count(xor(x.fp, y.fp)) <= 3 UNION ALL SELECT rep, id, 0 FROM fc WHERE id <> rep")
def hamming_within_3(spark, sf_dir):
    """Classes of equal fingerprints within 3 bits, and each class's members."""
    return lsh.hamming_join(_fps(_docs(spark, sf_dir)), 3)


_BLOCK = "CASE block WHEN 0 THEN fp & 65535 WHEN 1 THEN (fp >> 16) & 65535 WHEN 2 THEN (fp >> 32) & 65535 ELSE fp >> 48 END"
_HT = f"{_FP}, ht AS (SELECT id, fp, block, {_BLOCK} AS key FROM allf, (SELECT unnest(range(4))::INT AS block))"


@query(f"{_HT}, {_FCLASS}, hq AS (SELECT q.id AS query, x.id AS id, min(q.block) AS block, any_value(bit_count(xor(q.fp, x.fp)))::INT AS distance FROM ht q JOIN ht x USING (block, key) WHERE q.id % 20 = 0 AND x.id IN (SELECT id FROM fr) AND bit_count(xor(q.fp, x.fp)) <= 3 GROUP BY ALL) SELECT query, id, distance, row_number() OVER (PARTITION BY query ORDER BY block, id)::INT AS rank FROM hq")
def hamming_query(spark, sf_dir):
    """Classes of fingerprints within 3 bits of the documents asked for."""
    index, asked = _search(lsh.classes(_fps(_docs(spark, sf_dir)), "fp"), "fp")
    return lsh.hamming_query(lsh.hamming_table(index, 3), asked, 3)


@query(f"{_HT} " + _STATS.format(t="ht", k="block, key"))
def hamming_stats(spark, sf_dir):
    return lsh.stats(lsh.hamming_table(_fps(_docs(spark, sf_dir)), 3), ["block", "key"])


# --- winnowing


@query(f"{_WF} SELECT id, ord, pos, {O.signed('h')} AS hash FROM wf")
def winnow_fingerprints(spark, sf_dir):
    return winnow.fingerprints(_items(spark, sf_dir), K, W)


@query(f"{_WF} SELECT id, pos, {O.signed('h')} AS h FROM wf")
def winnow_window(spark, sf_dir):
    """The same selection by a sliding window in the JVM."""
    return winnow.select_minima(_items(spark, sf_dir).select("id", F.posexplode(U.char(F.col("text"), K)).alias("pos", "h")), W)


@query(f"{_WF} SELECT {O.signed('h')} AS hash, count(DISTINCT id) AS docs FROM wf GROUP BY h")
def winnow_doc_freq(spark, sf_dir):
    return winnow.doc_freq(winnow.fingerprints(_items(spark, sf_dir), K, W))


@query(f"{_WF}, n AS (SELECT a.id AS query, b.id AS id, count(*) AS shared FROM (SELECT DISTINCT id, h FROM wf) a JOIN (SELECT DISTINCT id, h FROM wf) b USING (h) GROUP BY ALL) SELECT query, id, shared, row_number() OVER (PARTITION BY query ORDER BY shared DESC, id)::INT AS rank FROM n")
def winnow_overlap_counts(spark, sf_dir):
    f = winnow.fingerprints(_items(spark, sf_dir), K, W)
    return winnow.overlap_counts(f, f)


_ISLES = "d AS (SELECT DISTINCT query, id, j, qpos, dpos, dpos - qpos AS diag FROM m), g AS (SELECT *, j - row_number() OVER (PARTITION BY query, id, diag ORDER BY j) AS isle FROM d)"


@query(f"{_WF}, m AS (SELECT q.id AS query, x.id AS id, q.ord AS j, q.pos AS qpos, x.pos AS dpos FROM wf q JOIN wf x USING (h)), {_ISLES} SELECT query, id, min(qpos) AS qpos, min(dpos) AS dpos, (max(qpos) - min(qpos) + {K})::INT AS len FROM g GROUP BY query, id, diag, isle")
def winnow_matches(spark, sf_dir):
    f = winnow.fingerprints(_items(spark, sf_dir), K, W)
    return winnow.matches(f, f, K)


_CHD = O.char8("documents", "doc_id")
_WFD = f"WITH {_CHD}, {O.winnow(W)}, wfd AS MATERIALIZED (SELECT * FROM wf)"
_WFI = _CH.replace("ch AS", "chi AS", 1) + ", " + O.winnow(W).replace("FROM ch)", "FROM chi)").replace("wm AS", "wmi AS").replace("FROM wm", "FROM wmi").replace("wf AS", "wfi AS")


@query(f"{_WFD}, {_WFI}, m AS (SELECT q.id AS query, x.id AS id, q.ord AS j, q.pos AS qpos, x.pos AS dpos FROM wfi q JOIN wfd x USING (h)), {_ISLES} SELECT query, id, min(qpos) AS qpos, min(dpos) AS dpos, (max(qpos) - min(qpos) + {K})::INT AS len FROM g GROUP BY query, id, diag, isle")
def winnow_matches_documents(spark, sf_dir):
    """Passages of benchmark items in documents."""
    return winnow.matches(winnow.fingerprints(_docs(spark, sf_dir), K, W), winnow.fingerprints(_items(spark, sf_dir), K, W), K)


_BEST = """dt AS (SELECT text, min(doc_id) AS rep FROM documents GROUP BY text), qd AS (SELECT doc_id, rep FROM documents JOIN dt USING (text) WHERE doc_id % 20 = 0),
sn AS (SELECT qd.doc_id AS query, b.id AS id, count(*) AS shared FROM (SELECT DISTINCT id, h FROM wfd) a JOIN qd ON a.id = qd.doc_id JOIN (SELECT DISTINCT id, h FROM wfd WHERE id IN (SELECT rep FROM dt)) b ON a.h = b.h WHERE b.id <> qd.rep GROUP BY ALL),
pr AS (SELECT query AS y, id AS x FROM sn QUALIFY row_number() OVER (PARTITION BY query ORDER BY shared DESC, id) = 1)"""


@query(f"{_WFD}, {_BEST}, m AS (SELECT pr.y AS query, 0 AS id, b.ord AS j, b.pos AS qpos, a.pos AS dpos FROM pr JOIN wfd b ON b.id = pr.y JOIN wfd a ON a.id = pr.x AND a.h = b.h), {_ISLES} SELECT query AS pair, min(dpos) AS pos_a, min(qpos) AS pos_b, (max(qpos) - min(qpos) + {K})::INT AS len FROM g GROUP BY query, diag, isle")
def winnow_overlaps(spark, sf_dir):
    """Aligned spans of each document asked for and the other text that shares most fingerprints with it."""
    d = _docs(spark, sf_dir).where("text IS NOT NULL")
    same = d.groupBy("text").agg(F.min("id").alias("rep"))
    index = written(same.where("rep IS NOT NULL").select(F.col("rep").alias("id"), U.winnow_set(F.col("text"), K, W).alias("hashes")), "fingerprints")
    asked = written(d.where(_ASKED).join(same, "text").select(F.col("id").alias("query"), "rep"), "asked")
    best = winnow.best_overlaps(index, index.join(asked.select(F.col("rep").alias("id")), "id", "left_semi"))
    best = asked.join(best.select(F.col("query").alias("rep"), F.col("id").alias("other")), "rep").select("query", "other")
    texts = lambda name, at: d.select(F.col("id").alias(at), F.col("text").alias(name))
    pairs = best.join(texts("a", "other"), "other").join(texts("b", "query"), "query")
    return winnow.overlaps(written(pairs.select(F.col("query").alias("pair"), "a", "b"), "pairs"), K, W)


@query(f"{_WFD} SELECT {O.signed('h')} AS hash, count(DISTINCT id) AS docs FROM wfd GROUP BY h")
def winnow_doc_freq_documents(spark, sf_dir):
    return winnow.doc_freq_texts(_docs(spark, sf_dir), K, W)


@query(f"{_WFD} SELECT id, ord, pos, {O.signed('h')} AS hash FROM wfd")
def winnow_fingerprints_documents(spark, sf_dir):
    return winnow.fingerprints(_docs(spark, sf_dir), K, W)


@query(f"{_WF}, df AS (SELECT h, count(DISTINCT id) AS n FROM wf GROUP BY h), q AS (SELECT id, ord, pos FROM wf JOIN df USING (h) WHERE n >= 2), r AS (SELECT *, ord - row_number() OVER (PARTITION BY id ORDER BY ord) AS isle FROM q) SELECT id, min(pos) AS pos, (max(pos) + {K} - min(pos))::INT AS len FROM r GROUP BY id, isle HAVING count(*) >= 2")
def winnow_cover(spark, sf_dir):
    f = winnow.fingerprints(_items(spark, sf_dir), K, W)
    return winnow.cover(f, f, K, 2, 2)


@query(f"{_WFD}, df AS (SELECT h, count(DISTINCT id) AS n FROM wfd GROUP BY h), q AS (SELECT id, ord, pos FROM wfd JOIN df USING (h) WHERE n >= 3), r AS (SELECT *, ord - row_number() OVER (PARTITION BY id ORDER BY ord) AS isle FROM q) SELECT id, min(pos) AS pos, (max(pos) + {K} - min(pos))::INT AS len FROM r GROUP BY id, isle HAVING count(*) >= 5")
def winnow_cover_documents(spark, sf_dir):
    """Boilerplate: runs of at least 5 fingerprints that stand in at least 3 documents."""
    return winnow.cover_texts(_docs(spark, sf_dir), K, W, 3, 5)


# --- summaries


def _hll_sql(regs: str, keys: str, p: int) -> str:
    m, comma, by = float(1 << p), f"{keys}, " if keys else "", f"GROUP BY {keys}" if keys else ""
    raw = f"({0.7213 / (1 + 1.079 / m) * m * m!r}::DOUBLE / (s + {m} - n))"
    return f"WITH {regs}, t AS (SELECT {comma}sum(pow(2.0::DOUBLE, -rho)) AS s, count(*) AS n FROM regs {by}) SELECT {comma}round(CASE WHEN {raw} <= {2.5 * m} AND n < {m} THEN {m}::DOUBLE * ln({m}::DOUBLE / ({m}::DOUBLE - n)) ELSE {raw} END, 6) AS estimate FROM t"


@query(f"WITH {O.hll('events', 'user_id', 14)} SELECT idx, rho FROM regs")
def hll_registers(spark, sf_dir):
    return sketches.hll_registers(_read(spark, sf_dir, "events"), [], "user_id", 14).select("idx", "rho")


@query(_hll_sql(O.hll("events", "user_id", 12, "event_type"), "event_type", 12))
def hll_by_group(spark, sf_dir):
    r = sketches.hll_registers(_read(spark, sf_dir, "events"), ["event_type"], "user_id", 12)
    return sketches.hll_estimate(r, ["event_type"], 12).select("event_type", F.round("estimate", 6).alias("estimate"))


@query(_hll_sql(O.hll("(SELECT l_partkey AS v FROM lineitem UNION ALL SELECT p_partkey FROM part)", "v", 14), "", 14))
def hll_merge(spark, sf_dir):
    a = sketches.hll_registers(_read(spark, sf_dir, "lineitem"), [], "l_partkey", 14)
    b = sketches.hll_registers(_read(spark, sf_dir, "part"), [], "p_partkey", 14)
    return sketches.hll_estimate(sketches.hll_merge(a, b, []), [], 14).select(F.round("estimate", 6).alias("estimate"))


@query(f"WITH {O.hll('events', 'user_id', 4, 'event_type')}, r AS (SELECT event_type, i, coalesce(rho, 0) AS rho FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT unnest(range(16))::INT AS i) LEFT JOIN regs ON regs.event_type = events.event_type AND idx = i) SELECT event_type, '010304' || string_agg(lpad(hex(rho), 2, '0'), '' ORDER BY i) AS data FROM r GROUP BY event_type".replace("(SELECT DISTINCT event_type FROM events)", "(SELECT DISTINCT event_type FROM events) events").replace("SELECT event_type, i,", "SELECT events.event_type, i,"))
def hll_marshal(spark, sf_dir):
    r = sketches.hll_registers(_read(spark, sf_dir, "events"), ["event_type"], "user_id", 4)
    return sketches.hll_bytes(r, ["event_type"], 4).select("event_type", F.hex("data").alias("data"))


@query("SELECT 0.0::DOUBLE AS estimate FROM (SELECT count(*) FROM events WHERE user_id IS NULL) WHERE true")
def hll_empty(spark, sf_dir):
    """The estimate of a stream without values is 0."""
    none = _read(spark, sf_dir, "events").where("user_id IS NULL")
    return sketches.hll_estimate(sketches.hll_registers(none, [], "user_id", 12), [], 12)


@query("SELECT event_type AS item, count(*) AS count, 0::BIGINT AS err, sum(count(*)) OVER ()::BIGINT AS total FROM events GROUP BY event_type")
def topk_exact(spark, sf_dir):
    """SpaceSaving with a counter for every item is an exact count."""
    return streams.space_saving(_read(spark, sf_dir, "events"), [], "event_type", ["event_id"], 1000)


_CAP = 10
# one row a step: (n, items, counts, errs, seqs); p: place of the item, v: of the least and oldest counter
_DROP = "list_transform(list_filter(range(1, len(items) + 1), lambda i: i <> v), lambda i: {}[i])"
_SAVING = f"""WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS n, s_nationkey AS x FROM supplier),
st AS (SELECT 0::BIGINT AS n, []::INT[] AS items, []::BIGINT[] AS counts, []::BIGINT[] AS errs, []::BIGINT[] AS seqs
UNION ALL SELECT m, CASE WHEN p > 0 THEN items WHEN len(items) < {_CAP} THEN list_append(items, x) ELSE list_append({_DROP.format("items")}, x) END,
  CASE WHEN p > 0 THEN list_transform(counts, lambda c, i: CASE WHEN i = p THEN c + 1 ELSE c END) WHEN len(items) < {_CAP} THEN list_append(counts, 1) ELSE list_append({_DROP.format("counts")}, counts[v] + 1) END,
  CASE WHEN p > 0 THEN errs WHEN len(items) < {_CAP} THEN list_append(errs, 0) ELSE list_append({_DROP.format("errs")}, counts[v]) END,
  CASE WHEN p > 0 THEN seqs WHEN len(items) < {_CAP} THEN list_append(seqs, m) ELSE list_append({_DROP.format("seqs")}, m) END
FROM (SELECT st.*, s.n AS m, x, coalesce(list_position(items, x), 0) AS p, list_position(list_transform(counts, lambda c, i: c * 1000000000 + seqs[i]), list_min(list_transform(counts, lambda c, i: c * 1000000000 + seqs[i]))) AS v FROM st JOIN s ON s.n = st.n + 1)),
held AS (SELECT unnest(items) AS item, unnest(counts) AS count, unnest(errs) AS err, n AS total FROM st WHERE n = (SELECT count(*) FROM s))"""


@query(f"{_SAVING} SELECT item, count, err, total FROM held")
def topk_evicting(spark, sf_dir):
    """Ten counters for the 25 nations of suppliers: newcomers take over the least, oldest counter."""
    return streams.space_saving(_read(spark, sf_dir, "supplier"), [], "s_nationkey", ["s_suppkey"], _CAP)


@query(f"{_SAVING} SELECT n_nationkey AS item, coalesce(count, fl) AS count, coalesce(err, fl) AS err, count IS NOT NULL AS tracked FROM nation LEFT JOIN held ON item = n_nationkey, (SELECT CASE WHEN count(*) >= {_CAP} THEN min(count) ELSE 0 END AS fl FROM held)")
def topk_count(spark, sf_dir):
    """Count and error of every nation, whether it has a counter or not."""
    items = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("item"))
    return streams.space_saving_count(written(topk_evicting(spark, sf_dir), "held"), items, _CAP)


@query("SELECT user_id AS item, count(*) AS lower, count(*) AS upper FROM events GROUP BY user_id HAVING count(*) > (SELECT count(*) FROM events) / 200")
def topk_bounds(spark, sf_dir):
    """Users with more than one in 200 events are all held by 400 merged counters: what these say is at least and at most, or the truth where it is within."""
    e = _read(spark, sf_dir, "events")
    held = streams.space_saving_merged(e, "user_id", 400)
    truth, all_ = e.groupBy(F.col("user_id").alias("item")).agg(F.count("*").alias("n")), e.agg(F.count("*").alias("total"))
    heavy = truth.crossJoin(all_).where(F.col("n") * 200 > F.col("total")).join(held, "item", "left")
    return heavy.select("item", F.when(F.col("count").isNotNull(), F.greatest("n", F.col("count") - F.col("err"))).alias("lower"), F.when(F.col("count").isNotNull(), F.least("n", "count")).alias("upper"))


def _reservoir_sql(table: str, keys: str, item: str, order: str, k: int, seed: int) -> str:
    from corpusloom.functions.kernels import GAMMA

    part, comma = (f"PARTITION BY {keys} ", f"{keys}, ") if keys else ("", "")
    steps = [("m", f"greatest(n, {k}) - {k}"), ("z0", O.add(O.mul("m::UBIGINT", GAMMA), seed)), *O.finalizer("z0", "z")]
    steps.append(("slot", f"CASE WHEN n <= {k} THEN n - 1 ELSE (z::UHUGEINT * n::UHUGEINT // {O.M})::BIGINT END"))
    rows = f"(SELECT {comma}{item} AS item, row_number() OVER ({part}ORDER BY {order}) AS n FROM {table})"
    return f"SELECT {comma}slot, arg_max(item, n) AS item FROM {O.chain(rows, steps)} WHERE slot < {k} GROUP BY {comma}slot"


@query(_reservoir_sql("orders", "", "o_orderkey", "o_orderkey", 100, 42))
def reservoir_sample(spark, sf_dir):
    return streams.reservoir(_read(spark, sf_dir, "orders"), [], "o_orderkey", ["o_orderkey"], 100, 42)


@query(_reservoir_sql("events", "event_type", "event_id", "event_id", 10, 7))
def reservoir_by_group(spark, sf_dir):
    return streams.reservoir(_read(spark, sf_dir, "events"), ["event_type"], "event_id", ["event_id"], 10, 7)


# --- clusters


_CLUSTERS = f"{_NEAR}, e AS (SELECT a, b FROM ne), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r(x, y) AS (SELECT x, x FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)".replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{_CLUSTERS} SELECT x AS id, min(y) AS rep FROM r GROUP BY x")
def clusters(spark, sf_dir):
    """Clusters of near duplicates; the representative is the member that came first."""
    roots = cluster.connected_components(near_duplicate_pairs(spark, sf_dir))
    return roots.select("id", F.col("root").alias("rep"))


@query(f"{_CLUSTERS}, k AS (SELECT x AS id, min(y) AS rep FROM r GROUP BY x) SELECT coalesce(rep, doc_id) AS rep, count(*) AS members, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM documents LEFT JOIN k ON id = doc_id GROUP BY ALL")
def cluster_members(spark, sf_dir):
    """All clusters, singletons included, members in order of insertion."""
    ids = _docs(spark, sf_dir).select("id", "seq")
    out = cluster.clusters(ids, near_duplicate_pairs(spark, sf_dir))
    return out.select("rep", F.size("members").cast("long").alias("members"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("ids"))


# --- bytes


def _le(x: str, n: int = 8) -> str:
    h = f"lpad(hex({x}), {2 * n}, '0')"
    return "(" + " || ".join(f"substr({h}, {2 * i + 1}, 2)" for i in reversed(range(n))) + ")"


@query(f"{_SIG16} SELECT id, '01011000' || '0000000000000000' || string_agg({_le('v')}, '' ORDER BY slot) AS data FROM slots GROUP BY id")
def marshal_signature(spark, sf_dir):
    return _sigs(_docs(spark, sf_dir), 16).select("id", F.hex(U.marshal_signature(F.col("sig"), 0)).alias("data"))


@query(f"{_FP} SELECT id, '0102' || {_le('fp')} AS data FROM allf")
def marshal_fingerprint(spark, sf_dir):
    return _fps(_docs(spark, sf_dir)).select("id", F.hex(U.marshal_fingerprint(F.col("fp"))).alias("data"))


@query(f"{_SIG16}, {O.simhash()}, allf AS (SELECT d.doc_id AS id, coalesce(fp, 0::UBIGINT) AS fp FROM documents d LEFT JOIN fps ON fps.id = d.doc_id) SELECT slots.id, slot::INT AS slot, {O.signed('v')} AS v, 5::BIGINT AS seed, {O.signed('fp')} AS fp FROM slots JOIN allf ON allf.id = slots.id")
def decode_roundtrip(spark, sf_dir):
    """What comes back from the bytes of signatures and fingerprints."""
    d = _docs(spark, sf_dir).select("id", U.sketch(F.col("text"), 3, 16).alias("sig"), U.simhash_text(F.col("text")).alias("fp"))
    d = d.select("id", U.decode_signature(U.marshal_signature(F.col("sig"), 5)).alias("s"), U.decode_fingerprint(U.marshal_fingerprint(F.col("fp"))).alias("fp"))
    return d.select("id", F.posexplode("s.sig").alias("slot", "v"), F.col("s.seed").alias("seed"), "fp")


@query(f"{_SIG16} SELECT id, slot::INT AS slot, {O.signed('v')} AS v FROM slots")
def unmarshal_signature(spark, sf_dir):
    """Signatures out of bytes, of 16 slots and seed 0 as is asked for; others are an error."""
    d = _docs(spark, sf_dir).select("id", U.marshal_signature(U.sketch(F.col("text"), 3, 16), 0).alias("data"))
    return d.select("id", F.posexplode(U.unmarshal_signature(F.col("data"), 16, 0)).alias("slot", "v"))


@query(f"{_ITEM}, card AS (SELECT id, sig, {_card('sig', 128)} AS c FROM sigs), pr AS (SELECT a.id, a.c AS ca, b.c AS cb, {O.same('a.sig', 'b.sig', 128)} AS j FROM card a JOIN card b ON b.id = a.id + 1) SELECT id, round(ca, 6) AS cardinality, j AS jaccard, round(CASE WHEN ca <= 0 THEN 0.0::DOUBLE ELSE greatest(least(j / (1 + j) * (ca + cb) / ca, 1.0::DOUBLE), 0.0::DOUBLE) END, 6) AS containment FROM pr")
def sql_estimates(spark, sf_dir):
    """Estimates of each benchmark item and the next one, by their SQL names."""
    from corpusloom.functions import sql

    sql.register(spark)
    items = _items(spark, sf_dir)
    q = "SELECT a.id, round(cl_cardinality(a.s), 6) AS cardinality, cl_jaccard(a.s, b.s) AS jaccard, round(cl_containment(a.s, b.s), 6) AS containment FROM (SELECT id, cl_sketch(text, 3, 128, 0) AS s FROM {items}) a JOIN (SELECT id, cl_sketch(text, 3, 128, 0) AS s FROM {items}) b ON b.id = a.id + 1"
    return spark.sql(q, items=items)


# --- chunks


@query(f"WITH RECURSIVE whole AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id), {O.shingles('whole', 'conv_id')}, {O.signatures(16, ids='(SELECT conv_id AS id FROM whole)')} SELECT id AS conv_id, slot::INT AS slot, {O.signed('v')} AS v FROM slots".replace("WITH RECURSIVE", "WITH"))
def chunked_sketch(spark, sf_dir):
    """Signature of each conversation, its turns taken as chunks of one document."""
    from corpusloom.streaming.chunks import sketch_chunks

    c = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_seq"), F.col("text").cast("binary").alias("chunk"))
    return sketch_chunks(c, 3, 16, 0).select(F.col("doc_id").alias("conv_id"), F.posexplode("sig").alias("slot", "v"))


@query(f"WITH {_SH} SELECT id, ((pos - 1) // 64)::INT AS block, ((pos - 1) % 64)::INT AS at, {O.signed('h')} AS h FROM sh WHERE pos <= 192")
def word_blocks(spark, sf_dir):
    """The first three blocks of 64 shingles of each document; the rest is not scanned."""
    from corpusloom.streaming.chunks import word_blocks as blocks

    b = _docs(spark, sf_dir).select("id", F.posexplode(blocks(F.col("text"), 3, 64, 3)).alias("block", "hashes"))
    return b.select("id", "block", F.posexplode("hashes").alias("at", "h"))


# --- the same through other doors: bytes, stored indexes, lifecycles, the sketcher


@query(ORACLE_SQL["word_shingles"])
def word_shingles_bytes(spark, sf_dir):
    """Word shingles of texts as bytes."""
    return _docs(spark, sf_dir).select("id", F.posexplode(U.words(F.encode("text", "UTF-8"), 3)).alias("pos", "h"))


@query(ORACLE_SQL["char_hashes"])
def char_hashes_bytes(spark, sf_dir):
    return _items(spark, sf_dir).select("id", F.posexplode(U.char(F.encode("text", "UTF-8"), 8)).alias("pos", "h"))


@query(ORACLE_SQL["char_rune_hashes"])
def char_rune_hashes_bytes(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(U.char_runes(F.encode("text", "UTF-8"), 8)).alias("pos", "h"))


@query(ORACLE_SQL["band_keys"])
def stored_index(spark, sf_dir):
    """The band table after it was written as an index and read again."""
    path = new_folder(spark, "index")
    index_tables.write_bands(lsh.band_table(_sigs(_docs(spark, sf_dir), 16), 4, 4), path)
    return index_tables.read_index(spark, path).select("id", "band", "key")


@query("SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def index_ids(spark, sf_dir):
    """Ids of an index, after some were removed."""
    toxic = _read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return index_tables.ids(lsh.remove(lsh.band_table(_sigs(_docs(spark, sf_dir), 16), 4, 4), toxic))


@query(f"{_SIG16}, last AS (SELECT id % 50 AS id, max(id) AS seq FROM sigs GROUP BY 1) SELECT last.id, seq, slot::INT AS slot, {O.signed('v')} AS v FROM last JOIN slots ON slots.id = last.seq")
def verified_add(spark, sf_dir):
    """Signatures of a verified index in which ids were added again: the last one stands."""
    s = _sigs(_docs(spark, sf_dir), 16).withColumn("id", F.col("id") % 50)
    return lsh.latest(s).select("id", "seq", F.posexplode("sig").alias("slot", "v"))


@query(f"{_SIG16} SELECT tree, count(*) AS entries, count(DISTINCT sig[tree * 4 + 1 : tree * 4 + 4]) AS keys FROM sigs, (SELECT unnest(range(4))::INT AS tree) WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY tree")
def forest_remove(spark, sf_dir):
    """Entries and keys of each tree of a forest without the documents labelled toxic."""
    toxic = _read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    left = lsh.remove(lsh.forest_table(_sigs(_docs(spark, sf_dir), 16), 4, 4), toxic)
    return left.groupBy("tree").agg(F.count("*").alias("entries"), F.countDistinct("key").alias("keys"))


@query(f"{_WF}, ix AS (SELECT * FROM wf WHERE id % 3 <> 0) SELECT count(DISTINCT id) AS ids, count(*) AS entries, count(DISTINCT h) AS hashes FROM ix")
def winnow_remove(spark, sf_dir):
    """Size of a fingerprint index after a third of its ids were removed."""
    f = written(winnow.fingerprints(_items(spark, sf_dir), K, W), "fingerprints")
    left = winnow.remove(f, f.where("id % 3 = 0"))
    return left.agg(F.countDistinct("id").alias("ids"), F.count("*").alias("entries"), F.countDistinct("hash").alias("hashes"))


@query(f"{_WF}, m0 AS (SELECT q.id AS query, x.id AS id, q.ord AS j, q.pos AS qpos, x.pos AS dpos, row_number() OVER (PARTITION BY q.id ORDER BY q.ord, x.id, x.pos) AS r FROM wf q JOIN wf x USING (h)), m AS (SELECT * FROM m0 WHERE r <= 25), {_ISLES} SELECT query, id, min(qpos) AS qpos, min(dpos) AS dpos, (max(qpos) - min(qpos) + {K})::INT AS len FROM g GROUP BY query, id, diag, isle")
def winnow_matches_bounded(spark, sf_dir):
    """Passages out of the first 25 matches of each query, for those who want a bound."""
    f = written(winnow.fingerprints(_items(spark, sf_dir), K, W), "fingerprints")
    return winnow.matches(f, f, K, 25)


_LABELS = f"{_CLUSTERS}, lb AS (SELECT x AS id, min(y) AS rep FROM r GROUP BY x)"


@query(f"{_LABELS} SELECT doc_id AS id, coalesce(rep, -1) AS rep, rep IS NOT NULL AS known FROM documents LEFT JOIN lb ON lb.id = doc_id")
def cluster_find(spark, sf_dir):
    """The representative of every document, -1 where no cluster knows it."""
    return cluster.find(clusters(spark, sf_dir), _docs(spark, sf_dir)).withColumn("rep", F.coalesce("rep", F.lit(-1)))


@query(f"{_LABELS} SELECT d.doc_id AS a, d.doc_id + 1 AS b, coalesce(x.rep = y.rep, false) AS same FROM documents d LEFT JOIN lb x ON x.id = d.doc_id LEFT JOIN lb y ON y.id = d.doc_id + 1")
def cluster_same(spark, sf_dir):
    """Whether each id and the next one are of one cluster."""
    return cluster.same(clusters(spark, sf_dir), _docs(spark, sf_dir).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))


@query(f"{_SIG128}, {O.bands(16, 8)} " + _STATS.format(t="(SELECT bk.* FROM bk JOIN sigs USING (id) WHERE list_min(sig) < 18446744073709551615)", k="band, key"))
def sketcher_index(spark, sf_dir):
    """Size of the index of a sketcher as it comes, without texts that have no shingles."""
    return lsh.stats(Sketcher().index(_docs(spark, sf_dir), drop_empty=True))


@query("SELECT '15.0.0' AS unicode, 3 AS w, 128 AS k, 0::BIGINT AS seed, 16 AS bands, 8 AS rows")
def defaults(spark, sf_dir):
    """Version of the tables and the configuration as it comes."""
    c = Config()
    return spark.createDataFrame([(UNICODE_VERSION, c.w, c.k, c.seed, c.bands, c.rows)], "unicode string, w int, k int, seed bigint, bands int, rows int")
