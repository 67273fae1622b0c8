"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelltrail.llm.common import LOWER, Hasher, mixed, runs_of_words, text_steps, word_bytes, word_places
from shelltrail.llm.sampling import labelled_sample

#: Words, pairs of neighbours, and pairs with one or two words between them.
SHAPES = ((0,), (0, 1), (0, 2), (0, 3))
#: Bytes of a word's beginning that count as a word too: languages that inflect have few equal words.
STEMS = (4, 5, 6)
SEPARATORS = [b for b in range(128) if not chr(b).isalnum() and chr(b) != "'"]
BITS = 20


def features(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature below 2**BITS) of every n-gram and skip-gram of lower-cased words, and of longer words' stems."""
    lowered = LOWER[data]
    starts, ends, row = word_places(lowered, offsets, inside)
    prefix = hasher.prefix(lowered)
    words = hasher.between(prefix, starts, ends)
    found = [runs_of_words(words, row, shape) for shape in SHAPES]
    for size in STEMS:
        long = np.flatnonzero(ends - starts > size)
        found.append((mixed(hasher.between(prefix, starts[long], starts[long] + size) + np.uint64(size)), row[long]))
    return np.concatenate([r for _, r in found]), (np.concatenate([h for h, _ in found]) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate learning rates and L1 sparsity; the intercept is not penalised."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> float:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        return p


def fit(sample: DataFrame, epochs: int = 6, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, intercept), non-zero weights only, from a bounded sample of (doc_id, text, label).

    Online learning is a sequence of updates, so the sample is read by one task; its size is the caller's parameter. The
    distinct features of a document count once, however often and wherever they occur.
    """

    def learn(batches):
        hasher, inside = Hasher(seed), word_bytes(SEPARATORS)
        examples = []
        for batch in batches:
            labels, ids = batch.column("label").to_pylist(), batch.column("doc_id").to_pylist()
            for first, last, data, offsets in text_steps(batch.column("text")):
                row, at = features(data, offsets, hasher, inside)
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(1, last - first))
                for i, own in enumerate(np.split(at[order], cuts)):
                    examples.append((ids[first + i], labels[first + i], np.append(np.unique(own), 1 << BITS).astype(np.int32)))
        examples.sort(key=lambda x: x[0])
        model, random = Ftrl(1 << BITS), np.random.default_rng(seed)
        for _ in range(epochs):
            for i in random.permutation(len(examples)):
                model.learn(examples[i][2], examples[i][1])
        weights = model.weights(np.arange((1 << BITS) + 1))
        kept = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(weights[kept])], names=["feature", "weight"])

    rows = sample.select("doc_id", "text", "label").coalesce(1).mapInArrow(learn, "feature long, weight double").toPandas()
    plain = rows[rows.feature < 1 << BITS]
    return plain.feature.to_numpy(np.int64), plain.weight.to_numpy(np.float64), float(rows.weight[rows.feature == 1 << BITS].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.3, seed: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row from its whole text. Null and empty texts score the intercept.

    The weights, at most 2**BITS, are broadcast; rows are independent, nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        at, weights, intercept = held.value
        dense = np.zeros(1 << BITS)
        dense[at] = weights
        hasher, inside = Hasher(seed), word_bytes(SEPARATORS)
        for batch in batches:
            sums = np.full(batch.num_rows, intercept)
            for first, last, data, offsets in text_steps(batch.column(1)):
                row, found = features(data, offsets, hasher, inside)
                known = dense[found] != 0
                once = np.unique(row[known] << BITS | found[known])
                sums[first:last] += np.bincount(once >> BITS, dense[once & ((1 << BITS) - 1)], last - first)
            scores = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(apply, f"doc_id {kind}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, learned, fit_rows: int = 12_000, threshold: float = 0.3) -> DataFrame:
    """Fits on at most `fit_rows` labelled rows for which `learned` holds, and scores all documents.

    Without any labelled row every document scores 0.5.
    """
    return score(docs, fit(labelled_sample(docs, labels, "toxic", learned, fit_rows)), threshold)
