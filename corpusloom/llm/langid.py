"""Language identification by a byte convolutional network trained here in numpy.

Filters of several widths run over one-hot bytes, each keeps its maximum over a
window, and a softmax layer reads the maxima.  A text is cut into windows of
fixed length that cover all of its bytes; its class probabilities are the mean
over windows, weighted by the bytes in each.

One class more stands for no language at all.  It is trained on what the labelled
texts turn into when their letters are exchanged or shuffled, and on random
characters.  A text is rejected where this class is likelier than for any of the
labelled rows held back from training, by half the distance to certainty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import bound_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Labelled rows that the classifier is fitted on, shared by the languages; rows that each gives in any case, if it has them.
TRAIN_ROWS, LANG_ROWS = 1500, 50
TRAIN_WINDOWS = 8000
#: Bytes of text that are looked at together.
PART_BYTES = 1 << 21
EPOCHS = 4
#: Windows of no language for each one of a language, and their least bytes: shorter texts say too little against one.
NOISE, NOISE_BYTES = 0.34, 48
#: One in so many labelled rows is held back to set the bound; with fewer than the second number of them nothing is rejected.
HOLD_BACK, HELD_LEAST = 5, 20


@dataclass
class ByteCNN:
    classes: list[str]
    filters: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    reject: float = 1.0  # texts that are of no language with more than this probability are rejected

    def __post_init__(self):
        self._tables = None

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses to byte pairs, so that a position costs three lookups."""
        if self._tables is None:
            w2, w3, w4 = self.filters
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
            head = np.concatenate([pair(w2[0], w2[1]), pair(w3[0], w3[1]), pair(w4[0], w4[1])], axis=1).astype(np.float32)
            self._tables = head, w3[2].astype(np.float32), pair(w4[2], w4[3]).astype(np.float32)
        return self._tables

    def features(self, x: np.ndarray) -> np.ndarray:
        """(n, filters) maxima of (n, WINDOW) bytes, a block of windows at a time."""
        head, third, tail = self.tables()
        f = FILTERS
        out = np.empty((len(x), 3 * f), dtype=np.float32)
        for at in range(0, len(x), 32):
            b = x[at : at + 32].astype(np.intp)
            code = (b[:, :-1] << 8) | b[:, 1:]
            r = head.take(code, axis=0)
            out[at : at + 32, :f] = r[:, :, :f].max(axis=1)
            out[at : at + 32, f : 2 * f] = (r[:, :-1, f : 2 * f] + third.take(b[:, 2:], axis=0)).max(axis=1)
            out[at : at + 32, 2 * f :] = (r[:, :-2, 2 * f :] + tail.take(code[:, 2:], axis=0)).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text in rows of WINDOW, the last filled with zeros, and the bytes in each row."""
    n = -(-len(raw) // WINDOW)
    x = np.zeros(n * WINDOW, dtype=np.uint8)
    x[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    size = np.full(n, WINDOW)
    if n:
        size[-1] = len(raw) - (n - 1) * WINDOW
    return x.reshape(n, WINDOW), size


_ALPHABETS = tuple(np.frombuffer(a, np.uint8) for a in (bytes(range(33, 127)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"0123456789abcdef", bytes(range(97, 123)) + b"      ", bytes(range(128, 256)) + b"  "))


def noise(raw: bytes, rng: np.random.Generator) -> bytes:
    """What a text becomes without its language: letters exchanged one for another, characters shuffled, or random ones."""
    kind = int(rng.integers(0, 3))
    if kind == 0:
        to = np.arange(256, dtype=np.uint8)
        small = rng.permutation(np.arange(97, 123))
        to[97:123], to[65:91] = small, small - 32
        return to[np.frombuffer(raw, np.uint8)].tobytes()
    if kind == 1:
        text = raw.decode("utf-8", "replace")
        return "".join(text[i] for i in rng.permutation(len(text)).tolist()).encode()
    return rng.choice(_ALPHABETS[int(rng.integers(0, len(_ALPHABETS)))], len(raw)).tobytes()


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> ByteCNN | None:
    """Adam on cross-entropy, classes weighted alike; None without any labelled text."""
    classes = sorted(set(labels))
    if not classes:
        return None
    held = texts[::HOLD_BACK] if len(texts) >= HOLD_BACK * HELD_LEAST else []
    if held and set(labels) == {x for i, x in enumerate(labels) if i % HOLD_BACK}:
        texts, labels = ([x for i, x in enumerate(of) if i % HOLD_BACK] for of in (texts, labels))
    rng = np.random.default_rng(seed)
    rows, ys, each = [], [], max(1, TRAIN_WINDOWS // max(1, len(texts)))

    def window(part: bytes, c: int) -> None:
        row = np.zeros(WINDOW, dtype=np.uint8)
        row[: min(WINDOW, len(part))] = np.frombuffer(part[:WINDOW], dtype=np.uint8)
        rows.append(row)
        ys.append(c)

    for raw, label in zip(texts, labels, strict=True):
        for _ in range(min(each, 1 + len(raw) // 64)):
            n = WINDOW if rng.random() < 0.5 else int(rng.integers(12, WINDOW + 1))
            at = int(rng.integers(0, max(1, len(raw) - n + 1)))
            window(raw[at : at + n], classes.index(label))
            if len(raw) >= NOISE_BYTES and rng.random() < NOISE:
                n = int(rng.integers(NOISE_BYTES, WINDOW + 1))
                at = int(rng.integers(0, max(1, len(raw) - n + 1)))
                window(noise(raw[at : at + n], rng), len(classes))
    x, y = np.array(rows), np.array(ys)
    k = len(classes) + 1
    params = [rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS]
    params += [np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, k)), np.zeros(k)]
    weight = len(y) / (k * np.maximum(1, np.bincount(y, minlength=k)))
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, batch = 0, 64
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for start in range(0, len(y), batch):
            pick = order[start : start + batch]
            b, t = x[pick].astype(np.intp), y[pick]
            best, where = [], []
            for w, p in zip(WIDTHS, params[:3], strict=True):
                r = sum(p[j].take(b[:, j : WINDOW - w + 1 + j], axis=0) for j in range(w))
                arg = r.argmax(axis=1)
                where.append(arg)
                best.append(np.take_along_axis(r, arg[:, None, :], 1)[:, 0])
            pre = np.concatenate(best, axis=1) + params[3]
            h = np.maximum(pre, 0)
            z = h @ params[4] + params[5]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(t)), t] -= 1
            q *= weight[t][:, None] / len(t)
            dh = (q @ params[4].T) * (pre > 0)
            grads = []
            for i, (w, arg) in enumerate(zip(WIDTHS, where, strict=True)):
                g, d = np.zeros_like(params[i]), dh[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    byte = np.take_along_axis(b, arg + j, axis=1)
                    np.add.at(g[j], (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), d)
                grads.append(g)
            grads += [dh.sum(axis=0), h.T @ q, q.sum(axis=0)]
            step += 1
            for p, g, a, c in zip(params, grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                c += 0.001 * (g * g - c)
                p -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
    model = ByteCNN(classes, params[:3], params[3].astype(np.float32), params[4].astype(np.float32), params[5].astype(np.float32))
    if held:
        model.reject = (1 + float(_of_texts(held, model)[:, -1].max())) / 2
    return model


def _of_texts(raws: list[bytes], model: ByteCNN) -> np.ndarray:
    """(texts, classes) mean probabilities of texts with a byte at least, the last column for no language."""
    pairs = [windows(r) for r in raws]
    p = model.probabilities(np.concatenate([p[0] for p in pairs])) * np.concatenate([p[1] for p in pairs])[:, None]
    starts = np.concatenate([[0], np.cumsum([len(p[0]) for p in pairs])[:-1]]).astype(np.int64)
    return np.add.reduceat(p, starts, axis=0) / np.array([len(r) for r in raws])[:, None]


def _least_hashes(keyed: DataFrame, most: int) -> DataFrame:
    """(lang, h): the ``most`` least distinct hashes of each language within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs, h = b.column(0).dictionary_encode(), b.column(1).to_numpy()
            code = langs.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            for lang, own in zip(langs.dictionary.to_pylist(), np.split(h[order], np.cumsum(np.bincount(code))[:-1]), strict=True):
                held[lang] = np.unique(np.concatenate([held[lang], own]) if lang in held else own)[:most]
        names = [x for x, own in held.items() for _ in own]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([*held.values(), np.zeros(0, np.int64)]), pa.int64())], ["lang", "h"])

    return keyed.mapInArrow(run, "lang string, h bigint")


def shares(held: dict[str, int], rows: int, least: int = LANG_ROWS) -> int:
    """The most rows of one language: as many as fill ``rows`` in all, and ``least`` in any case."""
    left, many = rows, sorted(held.values())
    for i, n in enumerate(many):
        if n * (len(many) - i) >= left:
            return max(least, -(-left // (len(many) - i)))
        left -= n
    return max([least, *many])


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> ByteCNN | None:
    """Fit on the labelled rows with text, picked by a hash of doc_id and text; repeated rows count once.

    Languages share ``train_rows`` evenly: what one has too few rows for goes to
    the others, and each gives LANG_ROWS if it has them, even where that makes
    more than ``train_rows``; languages are taken to be thousands at most.  Neither unlabelled rows nor the size of the table
    matter, and every language with a labelled row is a class.
    """
    bound_batches(docs.sparkSession)
    h = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("train"))
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select(F.col("lang").cast("string").alias("lang"), h.alias("h"), "text")
    most = max(train_rows, LANG_ROWS)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    near = _least_hashes(rows.select("lang", "h"), most).distinct().withColumn("place", place).where(F.col("place") <= most).toPandas()
    share = shares(near.groupby("lang").size().to_dict(), train_rows)
    near = near[near["place"] <= share]
    if not len(near):
        return None
    cut = docs.sparkSession.createDataFrame(near.groupby("lang", as_index=False)["h"].max().rename(columns={"h": "cut"}), "lang string, cut bigint")
    picked = rows.join(F.broadcast(cut), "lang").where(F.col("h") <= F.col("cut")).groupBy("lang", "h").agg(F.min("text").alias("text")).toPandas().sort_values(["h", "lang", "text"])
    return train([t.encode() for t in picked["text"]], picked["lang"].tolist())


def _in_parts(raws: list[bytes], model: ByteCNN) -> Iterator[np.ndarray]:
    """Rows of :func:`_of_texts`, some megabytes of text (or one text) at a time."""
    first, size = 0, 0
    for i, r in enumerate(raws):
        size += len(r)
        if size > PART_BYTES or i + 1 == len(raws):
            yield from _of_texts(raws[first : i + 1], model)
            first, size = i + 1, 0


def identify(texts: list[str | None], model: ByteCNN | None) -> tuple[list, list, list]:
    """Likeliest language, its probability among the languages, and whether the text is accepted.

    Texts without a letter (also null and empty ones) have no language: null,
    null, False.  Without a model, texts with a letter are accepted unnamed.  A
    text of NOISE_BYTES or more is rejected where it is of no language with more
    than ``model.reject``.
    """
    raws = [t.encode() if t is not None and any(map(str.isalpha, t)) else b"" for t in texts]
    name: list = [None] * len(texts)
    sure: list = [None] * len(texts)
    good = [bool(r) and model is None for r in raws]
    held = [i for i, r in enumerate(raws) if r]
    if model is None or not held:
        return name, sure, good
    for i, row in zip(held, _in_parts([raws[i] for i in held], model), strict=True):
        best = int(row[:-1].argmax())
        name[i], sure[i] = model.classes[best], round(float(row[best] / max(row[:-1].sum(), 1e-12)), 6)
        good[i] = len(raws[i]) < NOISE_BYTES or bool(row[-1] <= model.reject)
    return name, sure, good


def language_id(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, lang, predicted, confidence, accepted) for every row, repeated rows each.

    ``lang`` is the label as given, null or not; it is used to fit only.  Null
    and empty texts and texts without a letter are not accepted and have no
    prediction.  Of classes tied the first by name is predicted.  An empty table
    gives no rows; a table without labels accepts texts with a letter, unnamed.
    """
    model = fit(docs, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, sure, good = identify(b.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(name, pa.string()), pa.array(sure, pa.float64()), pa.array(good, pa.bool_())], ["doc_id", "lang", "predicted", "confidence", "accepted"])

    kinds = {f.name: f.dataType for f in docs.schema}
    schema = T.StructType([T.StructField("doc_id", kinds["doc_id"]), T.StructField("lang", kinds["lang"]), T.StructField("predicted", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return docs.select("doc_id", "lang", "text").mapInArrow(run, schema)


def keep_identified(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that :func:`language_id` accepts, with all columns, whatever their names.

    Null and empty texts and texts without a letter go; repeated rows go or stay
    together.  Without a labelled row every text with a letter stays.  An empty
    table stays one.
    """
    model = fit(docs, train_rows)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = identify(b.column(at).to_pylist(), model)[2]
            yield b if all(good) else b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
