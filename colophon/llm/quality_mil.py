"""Quality classifier: attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages of PASSAGE words. Every passage is encoded (a learned layer over measured
word and passage features), gated attention weights say how much each passage counts, and the weighted
representation is scored. Only documents are labelled; encoder, attention and classifier are learned
together from document labels by Adam on the logistic loss, with numpy, on the driver.

Training takes a bounded sample: about TRAIN_DOCUMENTS labelled documents, chosen by a hash of their
doc_id among those whose crc32(doc_id as text) mod 5 is not 0. Scoring is one map over all documents with
the model (some 10 kB) in the closure: no shuffle, whole texts.

Defined results: a null or empty text is one passage of zero features and gets the score of that;
documents with equal texts get equal scores; of labelled rows with one doc_id one is learnt from; without
usable labels every score is 0.5, with labels of one class only it is 0.99 or 0.01; an empty table gives an
empty table. Labels, lang, source and doc_id are never features.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.word_cache import WordCache, worker_cache

PASSAGE, TRAIN_DOCUMENTS, THRESHOLD, FOLDS = 96, 4000, 0.3, 5
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, SEED = 24, 12, 30, 64, 0.01, 7
WORD_FEATURES, HASH_FEATURES = 12, 8
FEATURES = WORD_FEATURES + HASH_FEATURES + 3
_SYMBOLS = frozenset("#*$%&|<>")


def _word_features(b: bytes) -> bytes:
    w = b.decode("utf-8", "replace")
    n = len(w)
    letters = [c for c in w if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    v = [
        min(n, 24) / 12,
        float(len(letters) > 1 and upper == len(letters)),
        float(bool(letters) and w[0].isupper() and upper == 1),
        sum(c.isdigit() for c in w) / n,
        min(3, sum(c in _SYMBOLS for c in w)) / 2,
        min(3, w.count("!")) / 2,
        float(w[-1] == "?"),
        float(w[-1] in ".!?…。"),
        float(w[-1] in ",;:"),
        float(not letters),
        float(not w.isascii()),
        float("@" in w or "://" in w or "www." in w),
    ]
    bits = hashlib.blake2b(b.lower(), digest_size=1).digest()[0]
    v += [(1.0 if bits >> k & 1 else -1.0) / 2 for k in range(HASH_FEATURES)]
    return np.array(v, np.float32).tobytes()


def passage_features(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """A row of features for each passage of each text; one row of zeros for a text without words."""
    cache = worker_cache("quality", lambda: WordCache(_word_features, limit=60_000))
    width = WORD_FEATURES + HASH_FEATURES
    for text in texts:
        words = (text or b"").split()
        n = len(words)
        if not n:
            yield np.zeros((1, FEATURES), np.float32)
            continue
        starts = np.arange(0, n, PASSAGE)
        each = np.frombuffer(b"".join(map(cache.__getitem__, words)), np.float32).reshape(n, width)
        cache.turn()
        sizes = np.diff(np.append(starts, n))[:, None].astype(np.float32)
        mean = np.add.reduceat(each, starts, 0) / sizes
        extra = np.empty((len(starts), 3), np.float32)
        for i, a in enumerate(starts):
            p = words[a : a + PASSAGE]
            extra[i] = len(set(p)) / len(p), sum(map(bytes.__eq__, p[1:], p)) / len(p), len(p) / PASSAGE
        yield np.hstack([mean, extra])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(m: dict, x: np.ndarray, starts: np.ndarray) -> dict:
    h = np.tanh(((x - m["mean"]) / m["scale"]) @ m["w"] + m["b"])
    t, g = np.tanh(h @ m["v"]), _sigmoid(h @ m["u"])
    e = (t * g) @ m["a"]
    counts = np.diff(np.append(starts, len(x)))
    top = np.repeat(np.maximum.reduceat(e, starts), counts)
    w = np.exp(e - top)
    w /= np.repeat(np.add.reduceat(w, starts), counts)
    z = np.add.reduceat(w[:, None] * h, starts, 0)
    return {"h": h, "t": t, "g": g, "w": w, "z": z, "counts": counts, "p": _sigmoid(z @ m["c"] + m["d"])}


def train(bags: list[np.ndarray], labels: list[int]) -> dict:
    """The model as a dict of arrays; a dict with 'constant' where there is nothing to learn from."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return {"constant": 0.5 if not len(y) else 0.99 if y[0] else 0.01}
    rng = np.random.default_rng(SEED)
    every = np.vstack(bags)
    m = {
        "mean": every.mean(0),
        "scale": every.std(0) + 1e-2,
        "w": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)),
        "b": np.zeros(HIDDEN),
        "v": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, ATTENTION)),
        "u": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, ATTENTION)),
        "a": rng.normal(0, 1 / np.sqrt(ATTENTION), ATTENTION),
        "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        "d": np.zeros(1),
    }
    names = ["w", "b", "v", "u", "a", "c", "d"]
    first, second, step = {k: np.zeros_like(m[k]) for k in names}, {k: np.zeros_like(m[k]) for k in names}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            x = np.vstack([bags[j] for j in at])
            starts = np.concatenate([[0], np.cumsum([len(bags[j]) for j in at])[:-1]])
            f = _forward(m, x, starts)
            out = (f["p"] - y[at]) / len(at)
            dz = np.repeat(out[:, None] * m["c"], f["counts"], 0)
            dw = (dz * f["h"]).sum(1)
            de = f["w"] * (dw - np.repeat(np.add.reduceat(f["w"] * dw, starts), f["counts"]))
            dt, dg = de[:, None] * m["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * m["a"] * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["w"][:, None] * dz + dt @ m["v"].T + dg @ m["u"].T) * (1 - f["h"] ** 2)
            grads = {
                "w": ((x - m["mean"]) / m["scale"]).T @ dh + 1e-4 * m["w"],
                "b": dh.sum(0),
                "v": f["h"].T @ dt,
                "u": f["h"].T @ dg,
                "a": (f["t"] * f["g"]).T @ de,
                "c": f["z"].T @ out + 1e-4 * m["c"],
                "d": np.array([out.sum()]),
            }
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in names:
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.001 * (grads[k] ** 2 - second[k])
                m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def scores(model: dict, bags: list[np.ndarray]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(bags), model["constant"])
    if not bags:
        return np.zeros(0)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    return _forward(model, np.vstack(bags), starts)["p"]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def fit(documents: DataFrame, labels: DataFrame) -> dict:
    """A model from the bounded sample of labelled documents outside the held-out fold."""
    usable = labels.select(F.col("doc_id").alias("l_id"), "quality").filter("quality IS NOT NULL AND l_id IS NOT NULL").filter(~held_out(F.col("l_id")))
    known = usable.groupBy("l_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, TRAIN_DOCUMENTS / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("l_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [x.astype("<f4").tobytes() for x in passage_features(_texts(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], ["doc_id", "quality", "bag"])

    # the sample has about TRAIN_DOCUMENTS rows of two numbers, whatever the number of labels
    joined = documents.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))
    rows = joined.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text").mapInArrow(measure, "doc_id long, quality int, bag binary")
    # a doc_id of many rows counts once
    rows = sorted(rows.groupBy("doc_id").agg(F.min(F.struct("bag", "quality")).alias("b")).select("doc_id", "b.*").collect())
    return train([np.frombuffer(r["bag"], "<f4").reshape(-1, FEATURES) for r in rows], [int(r["quality"] > 0) for r in rows])


def _texts(column: pa.Array, rows: int = 256) -> Iterator[bytes | None]:
    """The texts of an Arrow column as bytes, few at a time: they are never all held as objects."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).cast(pa.binary()).to_pylist()


def _batch_scores(model: dict, column: pa.Array) -> np.ndarray:
    out, bags, held = [], [], 0
    for bag in passage_features(_texts(column)):
        bags.append(bag)
        held += len(bag)
        if held >= 5_000:
            out.append(scores(model, bags))
            bags, held = [], 0
    return np.concatenate([*out, scores(model, bags)])


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    model = fit(rows, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_batch_scores(model, batch.column(1)), pa.float64())], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier takes for good, all columns."""
    model, at = fit(documents, labels), documents.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_batch_scores(model, batch.column(at)) >= THRESHOLD, pa.bool_()))

    return documents.mapInArrow(good, documents.schema)
