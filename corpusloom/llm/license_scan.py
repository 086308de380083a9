"""Licence detection by ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.license_rules import RULES, TIERS


class Rule(NamedTuple):
    rule_id: int
    license: str
    tier: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules; priority is the tier's place, then the rule's place in the list."""
    out = []
    for line in RULES.strip().splitlines():
        name, tier, words, body = line.split(";", 3)
        k = len(out)
        pattern = re.compile(body.replace("\\ ", " ").replace(" ?", r"\s*").replace(" ", r"\s+"), re.IGNORECASE | re.ASCII | re.MULTILINE)
        out.append(Rule(k, name, tier, TIERS.index(tier) * 1000 + k, tuple(words.split(",")), pattern))
    return tuple(out)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a, by = ahocorasick.Automaton(), {}
    for r in rules():
        for w in r.keywords:
            by.setdefault(_flat(w), []).append(r.rule_id)
    for w, ids in by.items():
        a.add_word(w, tuple(ids))
    a.make_automaton()
    return a


_RUNS = re.compile(r"[ \t\n\r\f\v]+")


def _flat(text: str) -> str:
    """Lower case with single spaces, so that keywords are found across line ends."""
    t = text.lower().replace("\n", " ")
    return _RUNS.sub(" ", t) if "  " in t or any(c in t for c in "\t\r\f\v") else t


class Detection(NamedTuple):
    start: int
    end: int
    rule: Rule


def uncontained(found: list[Detection]) -> list[Detection]:
    """Of detections in order of strength those that lie in no stronger one; n log n by prefix maxima of ends over starts (a Fenwick tree)."""
    starts = sorted({d.start for d in found})
    rank = {s: i + 1 for i, s in enumerate(starts)}
    ends, kept = [-1] * (len(starts) + 1), []
    for d in found:
        i, far = rank[d.start], -1
        while i:
            far = max(far, ends[i])
            i &= i - 1
        if far < d.end:
            kept.append(d)
            i = rank[d.start]
            while i < len(ends):
                ends[i] = max(ends[i], d.end)
                i += i & -i
    return kept


def detect(text: str) -> list[Detection]:
    """Detections that no stronger one contains, in order of place.

    Detections are taken by priority (equal rules: the longer, then the earlier
    first); one whose interval lies within that of a detection already taken is
    suppressed, so that of equal intervals the one of the first rule stays.
    Intervals that merely overlap both stay.
    """
    ids = sorted({i for _, hit in _automaton().iter(_flat(text)) for i in hit})
    if not ids:
        return []
    found = [Detection(*m.span(), rules()[i]) for i in ids for m in rules()[i].pattern.finditer(text) if m.end() > m.start()]
    found.sort(key=lambda d: (d.rule.priority, d.start - d.end, d.start))
    return sorted(uncontained(found), key=lambda d: (d.start, d.end, d.rule.priority))


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, tier, rule_id, start, end, matched), a row per detection.

    ``start`` and ``end`` count characters of the whole text from 0.  Repeated
    rows report their detections each; null and empty texts and texts without a
    detection give no row, nor does an empty table.  A null doc_id is reported
    as null.  Ties are settled by :func:`detect`; columns other than doc_id and
    text are not read, whatever their names.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("license", T.StringType()), T.StructField("tier", T.StringType()), T.StructField("rule_id", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("matched", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for d in detect(text):
                    at.append(i)
                    rows.append((d.rule.license, d.rule.tier, d.rule.rule_id, d.start, d.end, text[d.start : d.end]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [f.name for f in schema])

    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, schema)
