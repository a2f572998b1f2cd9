"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

Words are runs of letters and digits, or runs of one punctuation mark. The features of a text are its words and
pairs of neighbours (a word that repeats its neighbour makes one pair for all words), hashed into 2**BITS places; a text's vector holds each feature's share of all, times SCALE, and
its score is the logistic function of the sparse dot product with the weights. Training takes one text at a time on
the driver, from a sample of at most MAX_TRAIN labelled rows (those whose ids have the least hashes); the weights
have a fixed size, whatever the corpus, and are broadcast. Scoring reads whole texts and never the labels, the
language, the source or the id.

Defined results: null and empty texts have no features and get the score of the bias alone. Labels that are null
are left out; of repeated labels of one id the greatest counts. With no labelled row in the training part every
score is 0.5. Rows are scored independently; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import map_arrow, materialize, text_of, text_slices, trim_driver, utf8, work_path
from tesela.llm.wordhash import LOWER, SPACE, byte_class, mix, segments, words

BITS = 20
SCALE = 10.0
#: Labelled rows that training takes at most.
MAX_TRAIN = 5_000
#: Bytes of text that training takes at most, and that come to the driver.
MAX_TRAIN_BYTES = 128 << 20
EPOCHS = 3

#: The pair of a word with itself, whichever the word.
REPEAT = np.uint64(0xA5A5A5A5A5A5A5A5)

#: Letters, digits and bytes from 0x80 on are one class; every punctuation mark is a class of its own.
KINDS = np.minimum(np.arange(256), 127).astype(np.uint8) + 2
KINDS[byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))] = 1
KINDS[SPACE] = 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the texts in data, and the bounds of each text's features."""
    _, _, h, bounds = words(data, offsets, KINDS, LOWER)
    n = len(h)
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if n else h
    if n:
        pair[h[:-1] == h[1:]] = REPEAT
    place = np.empty(2 * n, np.int64)
    shift = np.uint64(64 - BITS)
    place[0::2] = h >> shift
    place[1 : 2 * n - 1 : 2] = pair >> shift
    place[2 * n - 1 :] = 0
    keep = np.ones(2 * n, bool)
    ends = bounds[1:][np.diff(bounds) > 0]
    keep[2 * ends - 1] = False  # no pair reaches into the next text
    sizes = np.maximum(2 * np.diff(bounds) - 1, 0)
    return place[keep], np.concatenate([[0], np.cumsum(sizes)])


class Ftrl:
    """Follow the regularised leader, with per-coordinate rates."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (_logistic(w @ x) - label) * x
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def train(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights of the features, and the bias last."""
    model, bias = Ftrl(), 1 << BITS
    rows = []
    for a, b, data, offsets in text_slices(texts):
        place, bounds = features(data, offsets)
        for i in range(b - a):
            at, count = np.unique(place[bounds[i] : bounds[i + 1]], return_counts=True)
            rows.append((np.append(at, bias).astype(np.int32), count.astype(np.int32)))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, count = rows[i]
            model.learn(at, np.append(count * (SCALE / max(1, count.sum())), 1.0), labels[i])
    del rows
    return model.weights(slice(None)).astype(np.float32)


def sample_labelled(
    docs: DataFrame, labels: DataFrame, label: str, train_on: Column, limit: int, id_column="doc_id", text_column="text"
) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of at most limit labelled ids; train_on tells which ids of labels may be used.

    Ids are taken in the order of their hashes, as long as their texts have MAX_TRAIN_BYTES together. Of rows that repeat
    an id the greatest text counts.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & train_on)
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    found = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("text").alias("text"), F.first("label").alias("label"))
    found = materialize(found, work_path(docs.sparkSession, "labelled"))
    sizes = found.select("id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("id"), "id").toArrow()
    whole = np.cumsum(sizes.column("size").to_numpy()) <= MAX_TRAIN_BYTES
    if not whole.all():
        taken = docs.sparkSession.createDataFrame(sizes.filter(pa.array(whole)).select(["id"]))
        found = found.join(F.broadcast(taken), "id")
    found = found.select("id", "text", "label").toArrow()
    order = np.argsort(found.column("id").to_numpy(), kind="stable")
    found = found.take(pa.array(order))
    return utf8(found.column("text")), found.column("label").to_numpy()


def score(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of each row of docs; docs needs no other column."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    source = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score_texts(texts, model.value))], names=["doc_id", "score"]
            )

    return map_arrow(source, run, f"doc_id {id_type}, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float, text_column: str = "text") -> DataFrame:
    """The rows of docs whose score is threshold or more, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(utf8(batch.column(at)), model.value) >= threshold))

    return map_arrow(docs, run, docs.schema)


def score_texts(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(texts))
    for a, b, data, offsets in text_slices(texts):
        place, bounds = features(data, offsets)
        total = segments(weights[place].astype(np.float64), bounds, np.add, 0.0)
        out[a:b] = _logistic(total * SCALE / np.maximum(1, np.diff(bounds)) + weights[-1])
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str, train_on: Column, limit: int = MAX_TRAIN) -> np.ndarray:
    texts, marks = sample_labelled(docs, labels, label, train_on, limit)
    weights = train(texts, marks)
    del texts, marks
    trim_driver(docs.sparkSession)
    return weights
