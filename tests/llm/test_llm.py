"""Every operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import random
import re._constants as sre
import re._parser as sre_parser
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import brown_lm, chat_trees, decontam, exact_dedup, langid, license_scan, mixing, queries, simhash_dedup, substring_dedup, token_lengths
from corpusloom.llm.common import Scratch, row_key, table

#: Columns that clash with the operators' own names.
EXTRA = ["bucket", "digest", "keep_id", "key", "n", "s", "doc", "kind", "h", "part", "position", "epoch", "_lost_id", "rank", "predicted"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents with clashing extra columns; rows are (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "web", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for c in EXTRA:
        df = df.withColumn(c, F.lit(c))
    return df


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(random.Random(f"w{i}").choices("abcdefghiklmnorstu", k=2 + i % 7)) for i in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


LONG = prose(99, 30_000)
EDGE = [(1, None), (2, ""), (3, ""), (4, " \n\t "), (5, "!!! ..."), (6, "one"), (7, prose(1, 80)), (8, prose(1, 80)), (8, prose(1, 80)), (9, LONG), (10, LONG), (None, prose(2, 60)), (None, prose(2, 60)), (11, None, None, None), (12, prose(3, 70), None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, EDGE).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, EDGE).where("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(map(tuple, pdf[cols].astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, duck, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(queries.ORACLE_SQL[name]).df())


# --- 1


def brute_licenses(text):
    flat = " ".join(text.lower().split())
    found = []
    for r in license_scan.rules():
        if any(k in flat for k in r.keywords):
            found += [(r.priority, m.start(), m.end(), r.license) for m in r.pattern.finditer(text) if m.end() > m.start()]
    found.sort(key=lambda d: (d[0], d[1] - d[2], d[1]))
    kept = []
    for d in found:
        if not any(k[1] <= d[1] and d[2] <= k[2] for k in kept):
            kept.append(d)
    return {(s, e, n) for _, s, e, n in kept}


def test_license_rules():
    assert len(license_scan.rules()) >= 200
    got = license_scan.detect("This work is licensed under the GNU General\nPublic License, version 3. (c) 2020")
    assert [(d.rule.license, d.rule.tier) for d in got] == [("work-licensed", "hint"), ("GPL-3.0", "grant"), ("copyright-sign", "hint")]
    assert [d.rule.license for d in license_scan.detect("SPDX-License-Identifier: MIT")] == ["SPDX-MIT"]
    assert license_scan.detect("nothing to see") == []


def sample_match(rng, seq):
    """A random text that a parsed expression matches, as far as its look-arounds allow."""
    out = ""
    for op, arg in seq:
        if op == sre.LITERAL:
            out += rng.choice((chr(arg).lower(), chr(arg).upper())) if chr(arg).isascii() else chr(arg)
        elif op == sre.IN:
            kind, value = rng.choice(arg)
            out += {sre.LITERAL: lambda v: chr(v), sre.RANGE: lambda v: chr(rng.randint(*v)), sre.NEGATE: lambda v: "x", sre.CATEGORY: lambda v: rng.choice(" \n\t") if v == sre.CATEGORY_SPACE else "7"}[kind](value)
        elif op in (sre.ANY, sre.NOT_LITERAL):
            out += "x"
        elif op == sre.SUBPATTERN:
            out += sample_match(rng, arg[3])
        elif op == sre.BRANCH:
            out += sample_match(rng, rng.choice(arg[1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            out += "".join(sample_match(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
    return out


def test_license_keywords_are_implied():
    """The prefilter tries a rule on whatever its expression matches."""
    rng, hit, missed = random.Random(3), set(), []
    for r in license_scan.rules():
        parsed = sre_parser.parse(r.pattern.pattern, r.pattern.flags)
        for _ in range(60):
            text = sample_match(rng, parsed)
            if r.pattern.search(text):
                hit.add(r.rule_id)
                if not any(k in license_scan._flat(text) for k in r.keywords):
                    missed.append((r.license, text))
    assert len(hit) == len(license_scan.rules()) and missed == []


def test_license_scan_brute_without_prefilter(docs):
    spelled = ["MIT licence", "Licensed under the EUPL, version 1.2", "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation", "under the same license as the original", "see the licence file", "This work is licenced", "may not be copied", "without prior consent"]
    for text in [*spelled, *(r.text for r in docs.select("text").limit(200).collect())]:
        found = [license_scan.Detection(*m.span(), r) for r in license_scan.rules() for m in r.pattern.finditer(text) if m.end() > m.start()]
        kept = []
        for d in sorted(found, key=lambda d: (d.rule.priority, d.start - d.end, d.start)):
            if not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        assert set(license_scan.detect(text)) == set(kept)
    assert [[d.rule.license for d in license_scan.detect(t)] for t in spelled] == [["MIT"], ["EUPL-1.2"], ["GPL-copy"], ["same-terms"], ["see-license"], ["work-licensed"], ["no-redistribution"], ["permission-required"]]


def test_license_scan(spark, docs, edge, empty):
    planted = frame(spark, [(1, "Released under the MIT License. Released under the MIT License."), (1, "Released under the MIT License. Released under the MIT License."), (2, LONG + "\nAll rights\treserved."), (3, "Licensed under CC BY-NC 4.0."), (4, None), (None, "see LICENSE file")])
    got = license_scan.license_scan(planted).collect()
    assert sorted((r.doc_id or 0, r.license) for r in got) == [(0, "see-license"), *[(1, "MIT")] * 4, (2, "all-rights-reserved"), (3, "CC-BY-NC-4.0")]
    want = {(r.doc_id, *d) for r in docs.select("doc_id", "text").collect() for d in brute_licenses(r.text)}
    assert {(r.doc_id, r.start, r.end, r.license) for r in license_scan.license_scan(docs).collect()} == want
    assert license_scan.license_scan(edge).count() == license_scan.license_scan(empty).count() == 0


def test_license_suppression():
    """Against comparing all pairs, with equal intervals, equal starts and equal ends; and on a megabyte of licence sentences."""
    rng, rules = random.Random(5), license_scan.rules()
    for _ in range(200):
        found = [license_scan.Detection(s, s + rng.randrange(1, 9), rules[rng.randrange(4)]) for s in (rng.randrange(12) for _ in range(rng.randrange(30)))]
        found.sort(key=lambda d: (d.rule.priority, d.start - d.end, d.start))
        kept = []
        for d in found:
            if not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        assert license_scan.uncontained(found) == kept
    one = "Released under the MIT License. All rights reserved. "
    began = time.perf_counter()
    got = license_scan.detect(one * 20_000)
    assert len(got) == 20_000 * len(license_scan.detect(one)) and time.perf_counter() - began < 60


# --- 2


def test_mixing(spark, docs, edge, empty):
    got = mixing.plan(docs).toPandas()
    assert set(got.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert got.position.is_monotonic_increasing
    # tokens of each source up to any time follow the integral of its weight
    seg = mixing.schedule(got[got.epoch == 0].groupby("source").tokens.sum().reset_index().pipe(lambda d: spark.createDataFrame([(f"s{s}", int(n)) for s, n in d.to_numpy()], "source_key string, n long"))).toPandas()
    total = max(g.n.iloc[0] / g.c1.max() for _, g in seg.groupby("source_key"))
    for s, g in seg.groupby("source_key"):
        own = got["source"] == s[1:]
        for t in (0.25, 0.5, 0.75):
            part = g[(g.t0 <= t) & (t <= g.t1)].iloc[0]
            due = total * (part.c0 + part.w0 * (t - part.t0) + part.slope * (t - part.t0) ** 2 / 2)
            assert abs(got[own & (got.t < t)].tokens.sum() - due) <= got[own].tokens.max()
    again = mixing.plan(edge).toPandas()
    assert len(again[again.epoch == 0]) == len(EDGE)
    assert mixing.plan(empty).count() == 0
    void = mixing.plan(frame(spark, [(1, None), (2, "", None, None)]))
    assert sorted((r.doc_id, r.position, r.epoch) for r in void.collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


# --- 3


def test_cuckoo_filter():
    rng = random.Random(0)
    keys = [rng.randbytes(16) for _ in range(3000)]
    f = exact_dedup.CuckooFilter(2)
    assert not any(f.insert(k) for k in keys)
    assert f.resizes > 0 and all(f.contains(k) for k in keys) and f.insert(keys[0])
    assert all(f.delete(k) for k in keys[:1500]) and f.contains(keys[0]) and f.delete(keys[0])
    assert not any(f.contains(k) for k in keys[:1500]) and all(f.contains(k) for k in keys[1500:])
    assert not f.delete(keys[0])
    g = exact_dedup.CuckooFilter.from_row(*f.to_row(0)[1:])
    assert g.stored == f.stored and all(g.contains(k) for k in keys[1500:])
    same = [b"\x07\x00" + bytes(6) + rng.randbytes(8) for _ in range(40)]  # one fingerprint, one home
    h = exact_dedup.CuckooFilter(2)
    for k in same:
        h.insert(k)
    assert all(h.contains(k) for k in same) and h.log_size < 12
    assert all(h.delete(k) for k in same[:30]) and all(h.contains(k) for k in same[30:])


def test_cuckoo_index(spark, edge, empty):
    live = {t for _, t, *_ in EDGE if t is not None}
    ix = exact_dedup.build_index(edge, 3).cache()
    assert exact_dedup.lookup(ix, edge, 3).count() == len(live)
    more = frame(spark, [(50, "new text"), (51, "one"), (52, None)])
    ix2 = exact_dedup.insert(ix, more, 3).cache()
    assert {r.copies for r in exact_dedup.lookup(ix2, more, 3).collect()} == {1, 2}
    ix3 = exact_dedup.delete(ix2, more, 3)
    assert exact_dedup.lookup(ix3, more, 3).collect()[0].copies == 1
    assert exact_dedup.delete(ix, edge, 3).count() == 0
    assert exact_dedup.build_index(empty, 3).count() == 0


def test_exact_dedup(edge, empty, docs):
    kept = exact_dedup.exact_dedup(edge)
    assert kept.columns == edge.columns
    got = kept.select("doc_id", "text").collect()
    assert sorted(r.text for r in got if r.text is not None) == sorted({t for _, t, *_ in EDGE if t is not None})
    assert [r.text for r in got].count(None) == 2
    assert {r.doc_id for r in got} == {1, 2, 4, 5, 6, 7, 9, None, 11, 12}
    rep = {(r.doc_id, r.keep_id, r.copies_of_id) for r in exact_dedup.report(edge).collect()}
    assert rep == {(2, 2, 1), (3, 2, 1), (7, 7, 1), (8, 7, 2), (9, 9, 1), (10, 9, 1), (None, None, 2)}
    assert exact_dedup.exact_dedup(empty).count() == exact_dedup.report(empty).count() == 0


# --- 4


def test_chat_trees(spark):
    # a question with two answers, one of them followed up, and a turn of a lost parent
    m = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 2.0), ("t", 4, 3, "user", "more", 0.0), ("t", 5, 4, "assistant", None, None), ("t", 6, 77, "user", "orphan", 0.0), ("u", 1, 2, "a", "x", 1.0), ("u", 2, 1, "b", "y", 1.0)]
    df = spark.createDataFrame(m, "tree string, node int, parent int, role string, text string, score double")
    got = {(r.root, r.leaf): (r["rank"], r.depth, r.score, r.text) for r in chat_trees.format_branches(df, 5).collect()}
    assert got == {
        (1, 5): (1, 4, 2.0, "<|user|>\nq\n<|end|>\n<|assistant|>\ngood\n<|end|>\n<|user|>\nmore\n<|end|>\n<|assistant|>\n\n<|end|>\n"),
        (1, 2): (2, 2, 1.0, "<|user|>\nq\n<|end|>\n<|assistant|>\nbad\n<|end|>\n"),
        (6, 6): (1, 1, 0.0, "<|user|>\norphan\n<|end|>\n"),
    }
    assert chat_trees.format_branches(df, 1).count() == 2
    deep = spark.createDataFrame([("d", i, i - 1 if i else None, "r", f"{i}", 1.0) for i in range(300)], df.schema)
    assert tuple(chat_trees.branches(deep).first()) == ("d", 299, 0, 300, 300.0)
    assert chat_trees.format_branches(deep).first().text == "".join(f"<|r|>\n{i}\n<|end|>\n" for i in range(300))
    assert chat_trees.branches(df.where("false")).count() == chat_trees.format_branches(df.where("false")).count() == 0


def test_branches_brute(spark):
    """Random trees with circles, against following every pointer."""
    rng, m = random.Random(6), []
    for tree in range(12):
        n = rng.choice((1, 2, 3, 17, 60))
        for i in range(n):
            parent = rng.choice((None, rng.randrange(n), i - 1 if i else None, i - 1 if i else None, 999))
            m.append((tree, i, parent, f"r{i % 3}", prose(i, 3), rng.choice((None, float(rng.randrange(4))))))
    m += [(50, i, (i + 1) % 5, "r", "c", 1.0) for i in range(5)] + [(50, 9, 2, "r", "tail", 1.0)]
    df = spark.createDataFrame(m, "tree int, node int, parent int, role string, text string, score double")
    want, by, answered = collections.defaultdict(list), {(x[0], x[1]): x for x in m}, {(x[0], x[2]) for x in m}
    for x in m:
        path, at = [x], x
        while (x[0], x[1]) not in answered and (at[0], at[2]) in by and len(path) < 100:
            at = by[at[0], at[2]]
            path.insert(0, at)
        if (x[0], x[1]) not in answered and len(path) < 100:
            want[x[0], path[0][1]].append((-sum(p[5] or 0 for p in path), -len(path), x[1], "".join(f"<|{p[3]}|>\n{p[4]}\n<|end|>\n" for p in path)))
    ranked = {(*k, *x, i) for k, v in want.items() for i, x in enumerate(sorted(v), 1)}
    assert {(r.tree, r.root, -r.score, -r.depth, r.leaf, r.text, r["rank"]) for r in chat_trees.format_branches(df).collect()} == ranked
    assert {(r.tree, r.root, r.leaf) for r in chat_trees.format_branches(df, 2).collect()} == {(x[0], x[1], x[4]) for x in ranked if x[6] <= 2}


def test_chat_trees_sql(spark, duck, empty):
    """Branches, alternative replies, ties, nulls, repeated rows, a very long text and clashing columns, against the SQL."""
    rng, t = random.Random(9), []
    for c in range(40):
        for turn in range(rng.randrange(1, 9)):
            for _ in range(rng.choice((1, 1, 1, 2, 3))):
                t.append((c, turn * rng.choice((1, 1, 2)), rng.choice(("user", "assistant", "assistant", "tool", None)), rng.choice((prose(rng.randrange(5), 3), "", None))))
    t += t[:20] + [(99, 0, "user", LONG), (99, 1, "assistant", LONG), (99, 1, "assistant", "short"), (99, 2, "user", LONG), (None, 0, "user", "x"), (98, None, "user", "x")]
    df = spark.createDataFrame(t, "conv_id long, turn long, role string, text string")
    for x in ("root", "leaf", "path", "depth", "rank", "node", "tree", "parent", "alt", "score"):
        df = df.withColumn(x, F.lit("clash"))
    got = chat_trees.chat_trees(df).toPandas()
    one = df.where("conv_id < 40").select(F.lit(1).cast("long").alias("conv_id"), (F.col("turn") + 20 * F.col("conv_id")).alias("turn"), "role", "text")  # a conversation over many ranges
    tree = lambda n: {(r.tree, *r.node, r.parent and tuple(r.parent), r.role, r.text) for r in chat_trees.reply_tree(one, n).collect()}
    assert tree(1) == tree(9) == tree(60) and len(tree(9)) > 200
    assert rows(chat_trees.chat_trees(df, ranges=13).toPandas()) == rows(got)
    held = df.select("conv_id", "turn", "role", "text").toPandas()
    c = duckdb.connect()
    c.register("held", held)
    c.sql("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM held")
    assert rows(got) == rows(c.sql(chat_trees.ORACLE).df())
    assert (got["rank"] > 1).any() and (got.leaf_alt > 0).any() and got.text.str.len().max() > 2 * len(LONG)
    assert chat_trees.chat_trees(df.where("false")).count() == 0


def test_reply_tree(spark):
    t = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "cc"), (2, 0, None, None), (2, 0, "user", "tie"), (None, 1, "user", "x"), (3, None, "user", "x")]
    df = spark.createDataFrame(t, "conv_id int, turn int, role string, text string").withColumn("tree", F.lit("clash")).withColumn("parent", F.lit(9))
    got = {(r.tree, *r.node): (r.parent and tuple(r.parent), r.role, r.score) for r in chat_trees.reply_tree(df).collect()}
    assert got == {(1, 0, 0): (None, "system", 0.0), (1, 1, 0): ((0, 0), "user", 0.0), (1, 2, 0): ((0, 0), "user", 0.0), (1, 3, 0): ((2, 0), "assistant", 2.0), (2, 0, 0): (None, "none", 0.0), (2, 0, 1): (None, "user", 0.0)}
    assert {(r.conv_id, r.leaf, r.leaf_alt) for r in chat_trees.chat_trees(df, 3).collect()} == {(1, 1, 0), (1, 3, 0), (2, 0, 0), (2, 0, 1)}


# --- 5


def test_exchange_never_worse():
    rng = np.random.default_rng(0)
    w = rng.poisson(1.0, (14, 14)).astype(float)
    c, best = np.arange(14) % 4, None
    score = lambda c: brown_lm.likelihood(np.eye(4)[c].T @ w @ np.eye(4)[c])
    for _ in range(5):
        for i in range(14):
            v = [score(np.where(np.arange(14) == i, b, c)) for b in range(4)]
            if max(v) > v[c[i]] + 1e-9:
                c[i] = int(np.argmax(v))
        best = score(c)
    got = brown_lm.exchange(w, 4, 5)
    assert score(got) == pytest.approx(best) and got.tolist() == c.tolist()


def brown_words(model):
    """word -> (n, class, log emission) of all words."""
    rows = list(zip(model.words, model.n.tolist(), model.classes.tolist(), strict=True)) + [tuple(r) for r in (model.tail.collect() if model.tail else [])]
    assert len({w for w, *_ in rows}) == len(rows)
    return {w: (n, c, np.log(n + brown_lm.EMISSION) - model.log_mass[c]) for w, n, c in rows}


def brown_score(model, known, words):
    before, total = len(model.step) - 1, 0.0
    for w in words:
        _, c, e = known[w]
        total += model.step[before, c] + e
        before = c
    return total


def test_brown_lm(spark, edge, empty):
    split = lambda t: simhash_dedup.WORD.findall((t or "").lower())
    words = collections.Counter(w for _, t, *_ in EDGE for w in split(t))
    for head, chunk in ((1 << 16, 1 << 19), (100, 5000)):
        model, _ = brown_lm.train(edge, Scratch(spark, "t"), 4, 20, head, chunk)
        known = brown_words(model)
        assert {w: n for w, (n, *_) in known.items()} == words
        assert (model.tail is None) == (head > len(words)) and sorted(model.n.tolist(), reverse=True) == sorted(words.values(), reverse=True)[: len(model.n)]
        # both factors are distributions
        for row in np.exp(model.step[[i for i in range(len(model.step)) if np.isfinite(model.step[i]).any()]]):
            assert row.sum() == pytest.approx(1)
        for c in {c for _, c, _ in known.values()}:
            assert sum(np.exp(e) for _, x, e in known.values() if x == c) == pytest.approx(1)
    got = brown_lm.brown_lm(edge, classes=4, core=20, head=100).collect()
    want = [(i, len(split(t)), brown_score(model, known, split(t))) for i, t, *_ in EDGE]
    assert len(got) == len(want)
    for r, (i, n, p) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_words)), sorted(want, key=lambda r: (str(r[0]), r[1])), strict=True):
        assert (r.doc_id, r.n_words) == (i, n) and r.log_prob == pytest.approx(p) and (r.perplexity is None) == (n == 0)
        assert n == 0 or r.perplexity == pytest.approx(np.exp(-p / n))
    assert brown_lm.brown_lm(empty).count() == 0
    assert brown_lm.brown_lm(frame(spark, [(1, None), (2, "")])).where("n_words = 0").count() == 2
    assert brown_lm.brown_lm(frame(spark, [(1, "one")])).first().n_words == 1


def test_brown_every_word_has_its_own(spark):
    """More words than the head: each has its class by exchange, all by brute force, wherever chunks end."""
    texts = [prose(i, 120, 900) for i in range(40)] + [None, "", "lonely"]
    split = [simhash_dedup.WORD.findall((t or "").lower()) for t in texts]
    df = frame(spark, list(enumerate(texts)))
    model, coded = brown_lm.train(df, Scratch(spark, "t"), 5, 30, 200)
    known = brown_words(model)
    again = brown_lm.train(df.repartition(3), Scratch(spark, "t"), 5, 30, 200, 400)[0]
    assert brown_words(again) == known and np.array_equal(again.step, model.step)
    beside = {w for ws in split for p in zip(ws[:-1], ws[1:], strict=True) for w, o in (p, p[::-1]) if o in set(model.words)}
    assert len(known) > 500 and {w for w, (_, c, _) in known.items() if c == 5} == set(known) - beside >= {"lonely"}
    got = {d: np.frombuffer(r.classes, np.int16)[a:b].tolist() for r in coded.collect() for d, a, b in zip(r.docs, [0, *np.frombuffer(r.ends, np.int32)], np.frombuffer(r.ends, np.int32), strict=False)}
    assert got == {d: [known[w][1] for w in ws] for d, ws in enumerate(split)}
    # transitions, and class bigrams of the head, by brute force
    t = np.zeros((7, 6))
    m = np.zeros((5, 5))
    head = dict(zip(model.words, model.classes.tolist(), strict=True))
    pairs = [p for ws in split for p in zip(ws[:-1], ws[1:], strict=True)]
    for ws in split:
        for x, y in zip([6, *[known[w][1] for w in ws]], [known[w][1] for w in ws], strict=False):
            t[x, y] += 1
    for x, y in pairs:
        if x in head and y in head and head[x] < 5 and head[y] < 5:
            m[head[x], head[y]] += 1
    prior = np.where([any(c == k for _, c, _ in known.values()) for k in range(6)], t.sum(axis=0) + 1, 0)
    prior = prior / prior.sum()
    assert np.allclose(np.exp(model.step), (t + brown_lm.PRIOR * prior) / (t.sum(axis=1, keepdims=True) + brown_lm.PRIOR))
    assert model.likelihood[0] == pytest.approx(brown_lm.likelihood(m))
    # the tail: bigrams beside classes, a first class by the derivative, then a sweep that is kept if the likelihood rises
    tail = sorted(set(known) - set(head))
    seen = np.zeros((len(tail), 2, 5))
    place = {w: i for i, w in enumerate(tail)}
    for x, y in pairs:
        if x in place and head.get(y, 5) < 5:
            seen[place[x], 0, head[y]] += 1
        if y in place and head.get(x, 5) < 5:
            seen[place[y], 1, head[x]] += 1

    def whole(c):
        out = m.copy()
        for i, a in enumerate(c):
            if a < 5:
                out[a] += seen[i, 0]
                out[:, a] += seen[i, 1]
        return out

    free = np.ones(len(tail), dtype=bool)
    c = [brown_lm._moves(m, seen, np.zeros(len(tail)), np.full(len(tail), 5), free)]
    c.append(brown_lm._moves(whole(c[0]), seen, np.zeros(len(tail)), c[0], free))
    reached = [brown_lm.likelihood(whole(x)) for x in c]
    assert model.likelihood[1:] == pytest.approx([reached[0], *[x for x in reached[1:] if x > reached[0]]])
    assert [known[w][1] for w in tail] == c[int(reached[1] > reached[0])].tolist()
    # sweeps over the head raise the likelihood
    chunked = brown_lm.chunks(df, 700)
    blocks = brown_lm.neighbours(chunked, model.words, 3).cache()
    assert np.array_equal(brown_lm.class_bigrams(blocks, model.classes, 5), m)
    start = np.where(np.arange(200) < 30, np.arange(200) % 5, 5).astype(np.int16)
    few, most = (brown_lm.likelihood(brown_lm.class_bigrams(blocks, brown_lm.sweeps(blocks, start, 5, n), 5)) for n in (0, 4))
    assert most > few


def test_brown_moves_raise_the_likelihood():
    """A frequent word moves to its best class by the likelihood itself."""
    rng = np.random.default_rng(4)
    m = rng.poisson(40.0, (4, 4)).astype(float)
    seen = rng.poisson(60.0, (6, 2, 4)).astype(float)
    for i in range(6):
        place = lambda base, c: base + np.eye(4)[c][:, None] * seen[i, 0][None] + seen[i, 1][:, None] * np.eye(4)[c][None]  # noqa: B023, E731
        for now in range(4):
            value = [brown_lm.likelihood(place(m, c)) for c in range(4)]
            got = brown_lm._moves(place(m, now), seen[i : i + 1], np.zeros(1), np.array([now]), np.array([True]))
            assert value[got[0]] == pytest.approx(max(value))


def test_brown_words_are_those_of_the_pattern():
    """Of every code point, alone, between letters and at the end of a word, in ASCII and other texts."""
    for last in (0x80, 0x110000):
        codes = [chr(c) for c in range(last) if not 0xD800 <= c < 0xE000]
        for text in (" ".join(codes), "x".join(codes), " ".join(f"A{c}" for c in codes), "".join(codes)):
            assert brown_lm._words(text) == simhash_dedup.WORD.findall(text.lower())
    assert brown_lm._words("") == []


def test_brown_sums_of_any_size():
    """Keys and counts too large for one number are added up as others are."""
    rng = np.random.default_rng(3)
    for kind, most, count in ((np.uint32, 1 << 32, 9), (np.int64, 1 << 34, 1 << 29), (np.int64, 1 << 34, 1 << 40)):
        keys = rng.choice(rng.integers(0, most, 50), 400).astype(kind)
        n = rng.integers(1, count, 400)
        want = collections.Counter()
        for x, c in zip(keys.tolist(), n.tolist(), strict=True):
            want[x] += c
        got = brown_lm._summed(keys, n)
        assert got[0].dtype == kind and got[0].tolist() == sorted(want) and got[1].tolist() == [want[x] for x in sorted(want)]


def test_brown_work_of_a_pass(spark):
    """The head's bigrams take some 6 bytes on each side, and come apart as they were counted; a move costs three logs of the matrix."""
    texts = [prose(i, 120, 900) for i in range(40)]
    split = [simhash_dedup.WORD.findall(t.lower()) for t in texts]
    words = sorted({w for ws in split for w in ws})
    pairs = collections.Counter(p for ws in split for p in zip(ws[:-1], ws[1:], strict=True))
    blocks = brown_lm.neighbours(brown_lm.chunks(frame(spark, list(enumerate(texts))), 700), words, 3)
    held = sum(len(x) for r in blocks.collect() for x in r if isinstance(x, (bytes, bytearray)))
    assert 0 < held <= 12 * len(pairs) + 10 * len(words)
    got = collections.Counter()
    for b in blocks.toArrow().to_batches():
        for w, *sides in brown_lm._entries(b):
            for s in (0, 1):
                many, other, n = sides[3 * s : 3 * s + 3]
                for x, y, c in zip(np.repeat(w, many).tolist(), other.tolist(), n.tolist(), strict=True):
                    got[(s, words[x], words[y])] = c
    assert got == {(s, *p[:: 1 - 2 * s]): c for p, c in pairs.items() for s in (0, 1)}
    large = pa.RecordBatch.from_arrays([pa.array([np.array(x, k).tobytes()]) for x, k in (([7], np.uint16), ([2], np.int32), ([3, 9], np.uint16), ([1 << 40, 5], np.int64))], list("wmon"))
    assert [x.tolist() for x in next(brown_lm._entries(large))] == [[7], [2], [3, 9], [1 << 40, 5]]
    logs, phi = [], brown_lm._phi
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(brown_lm, "_phi", lambda x: logs.append(x.size) or phi(x))
        brown_lm._gain(np.full((50, 50), 9.0), 3, np.ones(50), np.ones(50), 1.0)
    assert sum(logs) <= 3.5 * 50 * 50


def test_brown_head(spark):
    """Ties at the end of the head are taken by hash, and no more words are sent than fit it."""
    df = spark.createDataFrame([(f"w{i}", 5 if i < 3 else 2 if i < 400 else 1) for i in range(500)], "word string, n long")
    for most in (1, 3, 10, 399, 400, 450, 500, 900):
        got = brown_lm.most_frequent(df, most)
        want = sorted((-r.n, r.h & (1 << 64) - 1, r.word) for r in df.withColumn("h", F.xxhash64("word")).collect())[:most]
        assert got["word"].tolist() == [w for _, _, w in want]
    assert len(brown_lm.most_frequent(df.where("false"), 5)) == 0


def test_brown_prefers_fluent(docs):
    """Shuffles of a text score below the text."""
    model, _ = brown_lm.train(docs, Scratch(docs.sparkSession, "t"))
    known, rng, better, n = brown_words(model), np.random.default_rng(1), 0, 0
    for r in docs.where("lang = 'en'").limit(40).collect():
        words = simhash_dedup.WORD.findall(r.text.lower())
        if len(words) > 50:
            n += 1
            better += brown_score(model, known, words) > brown_score(model, known, rng.permutation(words).tolist())
    assert better / n > 0.6


# --- 6


def brute_spans(pairs, span):
    c = collections.Counter()
    words = [(i, (t or "").split()) for i, t in pairs]
    for _, w in words:
        c.update(tuple(w[i : i + span]) for i in range(len(w) - span + 1))
    out = set()
    for i, w in words:
        cover = np.zeros(len(w) + 2, dtype=int)
        for x in range(len(w) - span + 1):
            if c[tuple(w[x : x + span])] > 1:
                cover[x + 1 : x + 1 + span] = 1
        at = np.flatnonzero(np.diff(cover))
        out |= {(i, int(a), int(b)) for a, b in zip(at[::2], at[1::2], strict=True)}
    return out


def spans(df, *a):
    return {(r.doc_id, r.start_word, r.end_word) for r in substring_dedup.repeated_spans(df, *a).collect()}


def test_repeated_spans(spark, docs, edge, empty):
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert spans(docs) == brute_spans(pairs, 50)
    assert spans(edge) == brute_spans([(r[0], r[1]) for r in EDGE], 50)
    assert spans(empty) == set()
    rng = random.Random(4)
    base = [prose(i, 90, 60).split() for i in range(6)]
    made = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            b = rng.choice(base)
            a = rng.randrange(0, 80)
            parts += b[a : a + rng.randrange(1, 60)]
        made.append((i, " ".join(parts)))
    made += [(100, "a b c " * 40), (101, "x " * 120), (102, "x " * 70)]
    assert spans(frame(spark, made), 12, 4, 4) == brute_spans(made, 12)
    with pytest.raises(ValueError):
        substring_dedup.repeated_spans(docs, 20)


# --- 7


def test_covering_masks():
    rng = random.Random(2)
    for r in (1, 3, 8):
        m = simhash_dedup.masks(r)
        assert len(m) == 2 ** (r + 1) - 1
        for _ in range(2000):
            x = sum(1 << b for b in rng.sample(range(64), r))
            assert (np.uint64(x) & m == 0).any()
        for fours in (True, False):
            shared, tables = simhash_dedup.mask_groups(r, fours)
            assert sorted(t for t in tables.ravel().tolist() if t >= 0) == list(range(len(m)))
            assert all(s and s & ~m[t] == 0 for s, group in zip(shared, tables, strict=True) for t in group if t >= 0)


def brute_members(df, radius=simhash_dedup.RADIUS, bits=simhash_dedup.PAIR_BITS):
    """(row, row kept) among rows (id is null, doc_id, key), by comparing all pairs."""
    sk = [r for r in simhash_dedup.sketches(df).collect() if r.s is not None]
    comp = list(range(len(sk)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    grouped = set()
    mask = (1 << 64) - 1
    for i, a in enumerate(sk):
        for j, b in enumerate(sk[i + 1 :], i + 1):
            if ((a.s ^ b.s) & mask).bit_count() <= radius and ((a.v1 ^ b.v1) & mask).bit_count() + ((a.v2 ^ b.v2) & mask).bit_count() <= bits:
                grouped |= {i, j}
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    name = lambda r: (r.doc_id is None, r.doc_id or 0, bytes(r.key))
    least = {}
    for i in grouped:
        least[find(i)] = min(name(sk[i]), least.get(find(i), (True, 1 << 62, b"")))
    return [(name(sk[i]), least[find(i)]) for i in sorted(grouped)]


def brute_groups(df, *a):
    return {tuple(None if r[0] else r[1] for r in pair) for pair in brute_members(df, *a)}


def test_simhash_twos(docs, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "FOURS_ROWS", 0)
    assert {tuple(r) for r in simhash_dedup.groups(docs).collect()} == brute_groups(docs)


def test_simhash_groups(spark, docs, edge, empty):
    for df in (docs, edge):
        assert {tuple(r) for r in simhash_dedup.groups(df).collect()} == brute_groups(df)
    kept = simhash_dedup.near_dedup(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted([1, 2, 3, 4, 5, 6, 7, 9, 0, 11, 12])
    assert simhash_dedup.groups(empty).count() == simhash_dedup.near_dedup(empty).count() == 0
    rng = random.Random(8)
    made = []
    for i in range(25):
        w = prose(1000 + i, 250).split()
        made.append((i, " ".join(w)))
        for _ in range(5):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        made.append((100 + i, " ".join(w).upper()))
    got = dict(tuple(r) for r in simhash_dedup.groups(frame(spark, made)).collect())
    assert sum(got.get(100 + i) == i for i in range(25)) >= 23
    assert all(k in (i, i - 100) for i, k in got.items())


def test_simhash_rows_not_ids(spark):
    """Ids shared by unlike texts, null ids and repeated rows."""
    a, near, b, c = prose(1, 200), prose(1, 200) + " end", prose(2, 200), prose(3, 200)
    made = [(3, a), (5, near), (5, b), (7, c), (None, b + " x"), (None, c), (None, None), (8, ""), (None, prose(4, 90)), (9, prose(5, 90)), (9, prose(5, 90)), (None, prose(6, 90)), (None, prose(6, 90) + " y")]
    df = frame(spark, made).withColumn("_lost_key", F.lit("clash")).withColumn("root", F.lit(1))
    assert {tuple(r) for r in simhash_dedup.groups(df).collect()} == {(3, 3), (5, 3), (5, 5), (None, 5), (7, 7), (None, 7), (9, 9), (None, None)}
    lost = {x[2] for x, k in brute_members(df) if x != k}
    keyed = {(r.doc_id, r.text): bytes(r.key) for r in df.select("doc_id", "text", row_key(df).alias("key")).collect()}
    got = sorted((str(r.doc_id), str(r.text)) for r in simhash_dedup.near_dedup(df).collect())
    assert got == sorted({(str(i), str(t)) for i, t in made if keyed[(i, t)] not in lost})
    assert len(got) == 8


def test_simhash_hot_buckets(spark):
    """A bucket of one template, of one SimHash with unlike word pairs, and small ones, against all pairs; large ones in time."""
    rng = np.random.default_rng(3)
    m = simhash_dedup.masks()
    flip = lambda x, n: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64))

    def made(n, wide):
        base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
        s = np.array([flip(base[i % 3], rng.integers(0, 6)) if i % 4 else base[i % 3] for i in range(n)], dtype=np.uint64)
        v = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64) if wide else np.array([[flip(np.uint64(9), 3), np.uint64(i % 7)] for i in range(n)], dtype=np.uint64)
        return s, v

    def components(pairs, n):
        c = np.arange(n)
        for x, y in pairs:
            c[c == max(c[x], c[y])] = min(c[x], c[y])
        return c.tolist()

    for n, wide in ((40, False), (400, False), (400, True), (700, False)):
        s, v = made(n, wide)
        near = (np.bitwise_count(s[:, None] ^ s[None]) <= 8) & (np.bitwise_count(v[:, None] ^ v[None]).sum(axis=2) <= simhash_dedup.PAIR_BITS)
        t = np.repeat(np.arange(len(m)), n)
        ends = simhash_dedup.bucket_edges(t, np.tile(s, len(m)), np.tile(v, (len(m), 1)), np.tile(np.arange(n), len(m)))
        # ids of a component get its least id, so that components compare by label
        assert components(zip(*map(np.ndarray.tolist, ends), strict=True), n) == components(np.argwhere(near).tolist(), n)
    for wide in (False, True):
        s, v = made(30_000, wide)
        s[:] = s[0] if wide else s
        began = time.perf_counter()
        simhash_dedup.bucket_edges(np.full(len(s), int(wide)), s, v, np.arange(len(s)))
        assert time.perf_counter() - began < 30


# --- 8


def test_langid_held_out(docs):
    rows = [(r.text.encode(), r.lang) for r in docs.collect() if len(r.text) > 60]
    model = langid.train([t for t, _ in rows[::2]], [x for _, x in rows[::2]])
    held = rows[1::2]
    name, _, good = langid.identify([t.decode() for t, _ in held], model)
    assert np.mean([a == b for a, (_, b) in zip(name, held, strict=True)]) > 0.95 and np.mean(good) > 0.98


def test_langid_rejects(docs):
    """Unlabelled languages and junk go, labelled text and texts too short to tell stay."""
    rows = [(r.text.encode(), r.lang) for r in docs.collect()]
    model = langid.train([t for t, _ in rows], [x for _, x in rows])
    assert 0 < model.reject < 1 and model.classes == ["de", "en", "es", "fr"]
    alien = [
        "Warszawa jest stolicą i największym miastem Polski, położonym nad Wisłą we wschodniej części kraju, gdzie mieszka wielu ludzi",
        "Helsinki on Suomen pääkaupunki ja maan suurin kaupunki, joka sijaitsee Uudenmaan maakunnassa ja jossa asuu yli puoli miljoonaa ihmistä",
        "Москва является столицей России и самым большим городом страны, расположенным на реке Москве в центральной части",
        "İstanbul Türkiye'nin en kalabalık şehridir ve ülkenin ekonomik, tarihî ve kültürel merkezi olarak bilinir",
        "q8Zk3LmPx0VbN7yWc2RtGh5JdSaFeUi9OoTlKjHgFdSaQwErTyUiOpZxCvBnMq1W2e3R4t5Y6u7I8o9P0aSdFgHjKlZx",
        "deadbeef00c0ffee1234567890abcdefdeadbeef00c0ffee1234567890abcdefdeadbeef00c0ffee1234567890abcdef",
        "xkqz vwpj gfhd zzqx kjwv pqxz mnbv cxzl kjhg fdsq wrtp sdfg hjkl zxcv bnmq wrtp sdfg hjkl zxcv bnmp",
    ]
    assert sum(langid.identify(alien, model)[2]) == 0
    rng = np.random.default_rng(5)
    long = [t[:600] for t, _ in rows if len(t) > 300]
    assert np.mean(langid.identify([langid.noise(t, rng).decode("utf-8", "replace") for t in long], model)[2]) < 0.05
    assert langid.identify(["xq", "zzqx kjwv", "7", None, ""], model)[2] == [True, True, False, False, False]
    assert langid.train([b"the cat sat"] * 5, ["en"] * 5).reject == 1.0


def test_langid_features_brute():
    model = langid.train([b"the cat sat on the mat " * 9, "straße über öl ".encode() * 12], ["a", "b"])
    x, size = langid.windows("the öl mat".encode() * 60)
    assert size.sum() == len("the öl mat".encode()) * 60
    got = model.features(x)
    for n, row in enumerate(x):
        want = []
        for w, p in zip(langid.WIDTHS, model.filters, strict=True):
            want += list(np.max([sum(p[j, row[t + j]] for j in range(w)) for t in range(len(row) - w + 1)], axis=0))
        assert np.allclose(got[n], np.maximum(np.array(want) + model.bias, 0), atol=1e-4)


def test_langid_fits_on_whatever_is_labelled(spark):
    """Few labels among many rows, a rare language, rows without ids: the size of the table does not matter."""
    said = {"en": "the cat sat on the mat and ", "de": "straße über öl und mehr ", "el": "γλώσσα και λόγος "}
    labelled = [(i, said[x] + prose(i, 5), x) for i, x in enumerate(["en"] * 12 + ["de"] * 7)] + [(None, said["el"], "el")] * 3
    junk = [(i, prose(i, 4), None) for i in range(100, 3100)]
    small, large = (langid.fit(frame(spark, r), 10) for r in (labelled, labelled + junk))
    assert small.classes == large.classes == ["de", "el", "en"]
    assert all(np.array_equal(a, b) for a, b in zip(small.filters, large.filters, strict=True)) and np.array_equal(small.out, large.out)
    skewed = [(i, said["en"] + prose(i, 5), "en") for i in range(4000)] + [(i, said["el"] + prose(i, 2), "el") for i in range(4000, 4002)]
    assert langid.fit(frame(spark, skewed), 60).classes == ["el", "en"]
    assert [langid.shares(n, 100, 5) for n in ({}, {"a": 9}, {"a": 9, "b": 500, "c": 500}, {str(i): 50 for i in range(40)})] == [5, 9, 46, 5]


def test_language_id(spark, docs, edge, empty):
    mixed = docs.select("doc_id", "text", "lang").unionByName(edge.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    got = langid.language_id(mixed).collect()
    assert len(got) == docs.count() + len(EDGE)
    assert all(not r.accepted and r.predicted is None for r in got if r.lang is None and r.doc_id in (1, 2, 3, 4, 5))
    assert np.mean([r.accepted for r in got if r.lang]) > 0.99
    assert langid.keep_identified(docs).columns == docs.columns and langid.keep_identified(empty).count() == 0
    assert langid.language_id(empty).count() == 0
    unnamed = frame(spark, [(1, "words", None), (2, None, None), (3, "", None)])
    assert [(r.doc_id, r.accepted) for r in langid.language_id(unnamed).orderBy("doc_id").collect()] == [(1, True), (2, False), (3, False)]
    assert [r.doc_id for r in langid.keep_identified(unnamed).collect()] == [1]


# --- 9


def test_token_lengths(docs, edge, empty):
    encode = token_lengths.encoder().encode_ordinary
    for df in (docs, edge):
        n = [len(encode(r.text)) for r in df.select("text").collect() if r.text is not None]
        sums = token_lengths.token_lengths(df).cache()
        assert {(r.n_tokens, r.docs) for r in sums.collect()} == set(collections.Counter(n).items())
        for r in sums.collect():
            assert r.tokens_at_limit == sum(min(x, r.n_tokens) for x in n) and r.docs_longer == sum(x > r.n_tokens for x in n)
        for limit in (0, 1, 57, 10**6):
            assert tuple(token_lengths.at_limit(sums, limit).first()) == (sum(x > limit for x in n), sum(min(x, limit) for x in n), sum(n))
        for q in (0.1, 0.5, 1.0):
            assert token_lengths.quantile(sums, q).first()[0] == sorted(n)[int(np.ceil(q * len(n))) - 1]
    assert token_lengths.token_lengths(empty).count() == token_lengths.at_limit(token_lengths.token_lengths(empty), 9).count() == 0


def test_token_lengths_of_any_run(spark):
    """Runs that the encoder can take give its own lengths; longer ones don't stop the job."""
    own = token_lengths.encoder()
    for space in (" ", "\n", "\t", "\r\n", "\u00a0", "\u3000 ", " \n\x85"):
        for n in (999, 1000, 1001, 5000):
            for text in (space * n, space * n + "x", "a" + space * n, "a" + space * n + " b", "1" + space * n + "2" + space * n + "!", "\x1c" + space * n + "\x1f"):
                assert token_lengths.length(text, own) == len(own.encode_ordinary(text))
    for text in ("a" * 200_000, "=" * 50_000, "7" * 50_000, "\u4e2d\u6587" * 20_000):
        assert token_lengths.length(text, own) == len(own.encode_ordinary(text))
    million = 1_000_000
    huge = ["\n" * million + "x", " " * million + "x", "x" + " " * million, "x" * million, "\t \n" * million]
    piece = lambda t: len(own._core_bpe.encode_single_piece(t.encode()))
    want = [piece("\n" * (million - 1)) + 2, piece(" " * (million - 1)) + 1, 1 + piece(" " * million), piece("x" * million), piece("\t \n" * million)]
    assert [token_lengths.length(t, own) for t in huge] == want
    got = token_lengths.histogram(frame(spark, list(enumerate(huge)))).collect()
    assert {(r.n_tokens, r.docs) for r in got} == set(collections.Counter(want).items())


# --- 10


def brute_phrases(pairs, items, n=13):
    out = set()
    for d, t in pairs:
        w = decontam.terms_of(t)
        for i, s in items:
            a = decontam.terms_of(s)
            if not a:
                continue
            need = min(n, len(a))
            for shift in range(-len(a) + 1, len(w)):
                run = 0
                for j in range(len(a) + 1):
                    if j < len(a) and 0 <= shift + j < len(w) and w[shift + j] == a[j]:
                        run += 1
                    else:
                        if run >= need:
                            out.add((d, i, shift + j - run, j - run, run))
                        run = 0
    return out


def brute_near(pairs, items):
    freq = collections.Counter(t for _, x in pairs for t in decontam.terms_of(x))
    out = set()
    for i, s in items:
        a = decontam.terms_of(s)
        rare = sorted(set(a), key=lambda t: (freq[t], t))[: decontam.RAREST]
        if not rare:
            continue
        need = decontam.SHARE * len(rare) if len(rare) == decontam.RAREST else len(rare)
        for d, t in pairs:
            w, place = decontam.terms_of(t), []
            for x in range(len(w) + 1):
                last = {}
                if x < len(w) and w[x] in rare:
                    for y in range(max(0, x - int(decontam.SPREAD * len(a)) + 1), x + 1):
                        if w[y] in rare:
                            last[w[y]] = y
                f = min(last.values()) if len(last) >= need else None
                if place and (x == len(w) or f is not None and f > place[-1][3]):
                    m, span, f0, _ = max(place, key=lambda p: p[:3])
                    out.add((d, i, -f0, 1 - span, m))
                    place = []
                if f is not None:
                    place.append((len(last), f - x, -f, x))
    return out


def test_decontamination(spark, empty):
    items = [(i, prose(5000 + i, 20 + 3 * i)) for i in range(6)] + [(6, "seven words only stand in this"), (7, "too short"), (8, None), (9, ""), (6, "seven words only stand in this")]
    rng, made = random.Random(3), []
    for i in range(40):
        w = prose(i, 120).split()
        if i % 3 == 0:
            a = (items[i % 7][1]).split()
            cut = a[rng.randrange(0, 4) :]
            if i % 2:
                cut = [x if rng.random() > 0.1 else "edited" for x in cut]
            w[60:60] = cut
        made.append((i, " ".join(w).upper() if i % 4 == 0 else ", ".join(w)))
    made += [(50, None), (51, ""), (3, made[3][1]), (52, LONG + " " + items[2][1]), (None, items[1][1]), (53, items[2][1] + " " + prose(1, 200) + " " + items[2][1]), (54, "it was much too short"), (55, "short, far too; too"), (56, "stand seven in words only this"), (57, items[0][1]), (57, prose(77, 90)), (None, prose(78, 90))]
    df, bench = frame(spark, made), spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(1)).withColumn("kind", F.lit("x"))
    got = decontam.matches(df, bench).collect()
    phrases = {(r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_tokens) for r in got if r.kind == "phrase"}
    assert phrases == brute_phrases(made, items) and len(phrases) > 10
    near = {(r.doc_id, r.item_id, r.doc_start, r.n_tokens, r.matched) for r in got if r.kind == "proximity"}
    assert near == brute_near(made, items) and len(near) > 5
    long = [x for x in items if len(decontam.terms_of(x[1])) >= decontam.LEAST]
    numbered = [(n, t) for n, (_, t) in enumerate(made)]
    hit = {n for n, *_ in brute_phrases(numbered, long) | brute_near(numbered, long)}
    assert {(54, 7), (53, 2), (None, 1)} <= {(r.doc_id, r.item_id) for r in got}
    assert sum(r.doc_id == 53 and r.kind == "proximity" and r.item_id == 2 for r in got) == 2
    kept = decontam.decontaminate(df, bench)
    text = lambda rows: sorted((str(i), str(t)) for i, t in rows)
    assert kept.columns == df.columns and text((r.doc_id, r.text) for r in kept.collect()) == text(x for n, x in enumerate(made) if n not in hit)
    left = {(r.doc_id, r.text) for r in kept.collect()}
    assert (57, prose(77, 90)) in left and (57, items[0][1]) not in left and (None, prose(78, 90)) in left and (None, items[1][1]) not in left and any(i == 54 for i, _ in left)
    assert decontam.matches(empty, bench).count() == decontam.matches(df, bench.where("false")).count() == 0
    assert decontam.decontaminate(empty, bench).count() == 0


def test_index_segments(spark, docs):
    """Small segments give the same matches, and the index holds every token."""
    ix = decontam.build_index(docs, 2000).cache()
    n = sum(len(decontam.terms_of(r.text)) for r in docs.collect())
    held = sum(int(np.frombuffer(r.counts, dtype=np.int32).sum()) for r in ix.where("block >= 0").select("counts").collect())
    assert held == n and ix.select("seg").distinct().count() > 5
    items = [(1, docs.first().text)]
    schema = decontam.match_schema(docs, docs.select(F.col("doc_id").alias("item_id")))
    items = [(1, decontam.terms_of(docs.first().text))]
    a = {tuple(r) for r in decontam.search_index(ix, items, schema).collect()}
    b = {tuple(r) for r in decontam.search_index(decontam.build_index(docs), items, schema).collect()}
    assert a == b and a
