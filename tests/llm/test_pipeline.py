import gc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontam, exact_dedup, langid, mixing, simhash_dedup
from corpusloom.llm.common import table
from corpusloom.session import BATCH_BYTES


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, sf, tmp_path):
    """Each stage on what the one before it kept, against the operator's own report."""
    docs = table(spark, sf, "documents")
    start = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        before = ids(docs)
        if name == "language_id":
            want = sorted(r.doc_id for r in langid.language_id(docs).collect() if r.accepted)
        elif name == "exact_dedup":
            lost = {r.doc_id for r in exact_dedup.report(docs).collect() if r.doc_id != r.keep_id}
            want = [i for i in before if i not in lost]
            assert len(want) == docs.select("text").distinct().count()
        elif name == "near_dedup":
            lost = {r.doc_id for r in simhash_dedup.groups(docs).collect() if r.doc_id != r.keep_id}
            want = [i for i in before if i not in lost]
        elif name == "decontamination":
            lost = {r.doc_id for r in decontam.matches(docs, table(spark, sf, "benchmark")).collect()}
            want = [i for i in before if i not in lost]
            assert lost
        else:
            assert name == "mixing" and k == len(corpus_pipeline.STAGES) - 1
            assert {tuple(r) for r in out.collect()} == {tuple(r) for r in mixing.plan(docs).collect()}
            assert set(ids(out)) == set(before)
            break
        assert ids(out) == want and out.columns == start
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and [r.position for r in out] == sorted(r.position for r in out)


def test_empty(spark, sf):
    docs = table(spark, sf, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


EXTRA = ["bucket", "digest", "keep_id", "key", "n", "s", "doc", "more", "kind", "h", "part", "position", "epoch", "_lost_id", "_lost_key", "_hit_key", "rank", "root", "predicted", "chunk"]


def test_stages_on_odd_rows(spark, sf):
    """Nulls anywhere, empty and very long texts, repeated rows, shared ids and clashing columns, through every stage."""
    text = "the cat sat on the mat while rain fell over the harbour and nobody spoke about it at all "
    item = table(spark, sf, "benchmark").first().text
    long = " ".join(f"{text}{i}" for i in range(3000))
    made = [(1, None), (2, ""), (3, " \n"), (4, "!!"), (5, text), (5, text), (6, text), (7, text + "again"), (8, long), (9, long), (None, text), (None, "a clean one of its own, without an id, on quite another subject altogether"), (10, item), (10, "shares its id with a contaminated row, and says nothing that any benchmark has"), (None, item)]
    df = spark.createDataFrame([(i, t, "en" if n % 2 else None, "web" if n % 3 else None, len(t or "")) for n, (i, t) in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA:
        df = df.withColumn(c, F.lit(c))
    kept = lambda d: sorted((str(r.doc_id), str(r.text)[:40], len(r.text or "")) for r in d.collect())
    own = lambda *at: sorted((str(made[i][0]), str(made[i][1])[:40], len(made[i][1] or "")) for i in at)
    want = {
        "language_id": own(*range(4, 15)),
        "exact_dedup": own(0, 1, 2, 3, 4, 7, 8, 11, 12, 13),
        "near_dedup": own(0, 1, 2, 3, 4, 8, 11, 12, 13),
        "decontamination": own(*range(12), 13),
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        if name in want:
            assert out.columns == df.columns and kept(out) == want[name], name
        else:
            got = out.collect()
            assert len({(r.doc_id, r.source, r.tokens) for r in got}) >= 10 and sum(r.epoch == 0 for r in got) == len(made)
        assert stage(spark, df.where("false"), sf).count() == 0


@pytest.mark.parametrize("name", ["language_id", "exact_dedup", "near_dedup", "decontamination"])
def test_stages_bound_batches_to_workers(spark, sf, name):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    dict(corpus_pipeline.STAGES)[name](spark, table(spark, sf, "documents").limit(20), sf)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    held = spark.range(3000).coalesce(1).select(F.repeat(F.lit("abcd efgh "), 500)).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    spark.conf.unset(key)
    assert held <= BATCH_BYTES + 3 * 5000


def test_a_segment_goes_without_the_collector():
    gc.collect()
    gc.disable()
    try:
        held = decontam._Segment()
        held.add(1, ["a", "b", "a"])
        assert len(held.rows("0")["seg"]) == 3
        del held
        assert gc.collect() == 0
    finally:
        gc.enable()
