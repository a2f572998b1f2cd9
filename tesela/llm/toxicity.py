"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its words and the first PREFIXES bytes of longer words, as 64-bit hashes, each present or not.
The model is w0 + sum of w_i + sum over pairs of <v_i, v_j>, so that an insult near a mention of a group can weigh
more than both apart. Only terms that the training sample shows to matter take part: the TERMS terms of greatest
chi-squared with the label that at least MIN_ROWS sample rows have, and the PAIR_TERMS next ones by chi-squared within
the rows that hold one of the STRONG greatest: a term that matters only in a pair shows nothing alone. All other terms
have no weight: fitted over every hashed term, the model learned the sample by heart (README). The sample holds at most MAX_TRAIN labelled rows
(those whose ids have the least hashes), so the model has a fixed size and is broadcast. Scoring reads whole texts
and never the labels, the language, the source or the id.

Defined results: null and empty texts have no terms and get the score of w0. Null labels are left out; of repeated
labels of one id the greatest counts. With no labelled row in the training part every score is 0.5. Rows are scored
independently; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import map_arrow, text_of, text_slices, utf8
from tesela.llm.quality import _logistic, sample_labelled
from tesela.llm.wordhash import LOWER, NOT_ALNUM, kinds_of, mix, segments, words

PREFIXES = (4, 5)
TERMS = 4096
#: Terms chosen within the rows that hold one of the STRONG terms.
PAIR_TERMS = 256
STRONG = 64
MIN_ROWS = 3
FACTORS = 8
#: Labelled rows that training takes at most.
MAX_TRAIN = 8_000
EPOCHS = 8

_KINDS = kinds_of(NOT_ALNUM)


class Machine(NamedTuple):
    terms: np.ndarray  # sorted hashes
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of the texts in data, and the number of each term's text."""
    starts, ends, h, bounds = words(data, offsets, _KINDS, LOWER)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    hashes, rows = [h], [row]
    folded = LOWER[data].astype(np.uint64)
    for size in PREFIXES:
        longer = np.flatnonzero(ends - starts > size)
        code = np.full(len(longer), size, np.uint64)
        for k in range(size):
            code = code << np.uint64(8) | folded[starts[longer] + k]
        hashes.append(mix(code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)))
        rows.append(row[longer])
    return np.concatenate(hashes), np.concatenate(rows)


def present(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct known terms of each text, as indexes into known, and their bounds by text."""
    h, row = terms(data, offsets)
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    hit = known[at] == h if len(known) else np.zeros(len(h), bool)
    pair = np.unique(row[hit].astype(np.int64) << 32 | at[hit])
    return pair & 0xFFFFFFFF, np.searchsorted(pair >> 32, np.arange(len(offsets)))


def choose_terms(texts: pa.Array, labels: np.ndarray, limit: int = TERMS, pairs: int = PAIR_TERMS) -> np.ndarray:
    """The terms of greatest chi-squared with the label, in all rows and in those that hold a strong term."""
    seen, at = [], []
    for a, _, data, offsets in text_slices(texts):
        h, row = terms(data, offsets)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        seen.append(h[new])
        at.append(a + row[new])
    if not seen:
        return np.zeros(0, np.uint64)
    found, where = np.unique(np.concatenate(seen), return_inverse=True)
    rows = np.concatenate(at)

    def greatest(gain: np.ndarray, most: int) -> np.ndarray:
        best = np.argsort(-gain, kind="stable")[:most]
        return best[gain[best] > 0]

    best = greatest(_chi_squared(where, labels[rows], len(found), labels), limit)
    strong = np.zeros(len(labels), bool)
    strong[rows[np.isin(where, best[:STRONG])]] = True
    inside = strong[rows]
    gain = _chi_squared(where[inside], labels[rows[inside]], len(found), labels[strong])
    gain[best] = -1.0
    return np.sort(found[np.concatenate([best, greatest(gain, pairs)])])


def _chi_squared(where: np.ndarray, marks: np.ndarray, size: int, labels: np.ndarray) -> np.ndarray:
    """Chi-squared of each of size terms with the label, -1 for those of under MIN_ROWS rows."""
    n, n1 = len(labels), int(labels.sum())
    count = np.bincount(where, minlength=size).astype(float)
    ones = np.bincount(where, weights=marks, minlength=size)
    usual = count * n1 / max(n, 1)
    spread = usual * (1 - n1 / max(n, 1)) * (1 - count / max(n, 1)) + 1e-9
    return np.where(count >= MIN_ROWS, (ones - usual) ** 2 / spread, -1.0)


def train(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Machine:
    """Stochastic gradients with AdaGrad rates, one text at a time."""
    known = choose_terms(texts, labels)
    rng = np.random.default_rng(seed)
    bias, linear = 0.0, np.zeros(len(known))
    factors = rng.normal(0, 0.01, (len(known), FACTORS))
    g_bias, g_linear, g_factors = 1e-8, np.full(len(known), 1e-8), np.full(factors.shape, 1e-8)
    rows: list[np.ndarray] = []
    for _, _, data, offsets in text_slices(texts):
        at, bounds = present(data, offsets, known)
        rows += [at[bounds[i] : bounds[i + 1]] for i in range(len(offsets) - 1)]
    rate, decay = 0.1, 1e-4
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            w, v = linear[at], factors[at]
            total = v.sum(axis=0)
            error = _logistic(bias + w.sum() + 0.5 * (total @ total - (v * v).sum())) - labels[i]
            g_bias += error * error
            bias -= rate * error / np.sqrt(g_bias)
            step = error + decay * w
            g_linear[at] += step * step
            linear[at] = w - rate * step / np.sqrt(g_linear[at])
            step = error * (total - v) + decay * v
            g_factors[at] += step * step
            factors[at] = v - 0.3 * rate * step / np.sqrt(g_factors[at])
    return Machine(known, bias, linear, factors)


def score_texts(texts: pa.Array, model: Machine) -> np.ndarray:
    out = np.empty(len(texts))
    for a, b, data, offsets in text_slices(texts):
        at, bounds = present(data, offsets, model.terms)
        total = model.bias + segments(model.linear[at], bounds, np.add, 0.0)
        for f in range(model.factors.shape[1]):
            v = model.factors[at, f]
            total += 0.5 * (segments(v, bounds, np.add, 0.0) ** 2 - segments(v * v, bounds, np.add, 0.0))
        out[a:b] = _logistic(total)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str, train_on: Column, limit: int = MAX_TRAIN) -> Machine:
    texts, marks = sample_labelled(docs, labels, label, train_on, limit)
    return train(texts, marks)


def score(docs: DataFrame, model: Machine, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(score_texts(utf8(batch.column(1)), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    return map_arrow(source, run, f"doc_id {id_type}, score double")
