"""Quality: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelltrail.llm.common import FEWER_BYTES, LOWER, Hasher, runs_of_words, text_steps, tidy, word_bytes, word_places
from shelltrail.llm.sampling import labelled_sample

PASSAGE_WORDS = 64
BUCKETS = 64
HIDDEN, GATE = 32, 16


def _class(chars: bytes) -> np.ndarray:
    held = np.zeros(256, np.float32)
    held[list(chars)] = 1
    return held


#: Shares of these byte classes among a passage's bytes.
CLASSES = np.stack([
    _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789"), _class(bytes(range(128, 256))),
    _class(b" "), _class(b"\n\r\t"), _class(b".,;:?"), _class(b"!"), _class(b"'\"()-"), _class(b"#$%&*@^~+=_\\/"), _class(b"|<>{}[]`"),
])
STATISTICS = len(CLASSES) + 9
WIDTH = STATISTICS + BUCKETS


def passages(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, features) of the passages of all texts in a step, PASSAGE_WORDS words each; an empty text has one of zeros.

    Features: byte classes, word lengths, case, how much of the passage occurs again in the document, hashed words.
    """
    rows = len(offsets) - 1
    starts, ends, row = word_places(data, offsets, inside)
    words = hasher.between(hasher.prefix(LOWER[data]), starts, ends)
    first = np.searchsorted(row, np.arange(rows), "left")
    counts = np.diff(np.append(first, len(row)))
    pieces = np.maximum(1, -(-counts // PASSAGE_WORDS))
    base = np.concatenate([[0], np.cumsum(pieces)])
    owner = np.repeat(np.arange(rows), pieces)
    of_word = base[row] + (np.arange(len(row)) - first[row]) // PASSAGE_WORDS
    total = int(base[-1])
    out = np.zeros((total, WIDTH), np.float32)
    if not len(row):
        return owner, out
    n = np.bincount(of_word, minlength=total).astype(np.float32)
    per_word = np.maximum(n, 1)

    def mean(values) -> np.ndarray:
        return np.bincount(of_word, values, total) / per_word

    full = np.flatnonzero(n)
    begin = starts[np.searchsorted(of_word, full, "left")]
    begin = np.where(np.diff(owner[full], prepend=-1) != 0, offsets[owner[full]], begin)
    end = np.minimum(np.append(begin[1:], offsets[-1]), offsets[owner[full] + 1])
    cuts = np.stack([begin, end], 1).ravel()
    padded = np.append(data, np.uint8(0))
    for k, held in enumerate(CLASSES):
        out[full, k] = np.add.reduceat(held[padded], cuts)[::2] / (end - begin)
    length = (ends - starts).astype(np.float32)
    k = len(CLASSES)
    out[:, k] = np.log1p(n) / 4
    out[:, k + 1] = mean(np.minimum(length, 40)) / 10
    out[:, k + 2] = np.sqrt(np.maximum(mean(np.minimum(length, 40) ** 2) / 100 - out[:, k + 1] ** 2, 0))
    upper = CLASSES[0][data]
    out[:, k + 3] = mean(upper[starts])
    out[:, k + 4] = mean(upper[starts] * upper[np.minimum(starts + 1, ends - 1)])
    letter = CLASSES[0] + CLASSES[1] + CLASSES[3]
    out[:, k + 5] = mean(1 - letter[data[ends - 1]])
    out[:, k + 6] = mean(1 - letter[data[starts]])
    out[:, k + 7] = (n - _again(words ^ _spread(of_word), of_word, total)) / per_word
    triples, at = runs_of_words(words, row, (0, 1, 2))
    inner = np.flatnonzero(row[:-2] == row[2:]) if len(row) > 2 else np.zeros(0, np.int64)
    out[:, k + 8] = _again(triples ^ _spread(at), of_word[inner], total) / per_word
    bucket = (words >> np.uint64(58)).astype(np.int64)
    bag = np.bincount(of_word * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS)
    out[:, STATISTICS:] = np.sqrt(bag / per_word[:, None])
    return owner, out


def _spread(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _again(keys: np.ndarray, of: np.ndarray, total: int) -> np.ndarray:
    """How many of each passage's keys occur more than once."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return np.bincount(of, counts[inverse] > 1, total)


class Attention:
    """h = relu(W x + b); a = softmax(w . (tanh(V h) * sigmoid(U h))) over a document's passages; score = sigmoid(c . sum(a h) + d)."""

    NAMES = ("W", "b", "V", "U", "w", "c", "d")

    def __init__(self, seed: int = 3):
        random = np.random.default_rng(seed)
        draw = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
        self.p = {"W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, first: np.ndarray, of: np.ndarray) -> dict:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * g) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, first)[of])
        a /= np.add.reduceat(a, first)[of]
        z = np.add.reduceat(a[:, None] * h, first)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y}

    def gradients(self, f: dict, of: np.ndarray, label: np.ndarray) -> dict:
        p, n = self.p, len(label)
        s = (f["y"] - label) / n
        dz = s[:, None] * p["c"]
        dh = f["a"][:, None] * dz[of]
        da = (f["h"] * dz[of]).sum(1)
        weighted = np.bincount(of, f["a"] * da, n)
        de = f["a"] * (da - weighted[of])
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (f["h"] > 0)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ s, "d": np.array([s.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int, rate: float = 0.01, decay: float = 1e-4, batch: int = 64, seed: int = 3) -> None:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0).astype(np.float64), every.std(0).astype(np.float64) + 1e-3
        random, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = random.permutation(len(bags))
            for low in range(0, len(order), batch):
                some = order[low : low + batch]
                sizes = np.array([len(bags[i]) for i in some])
                first, of = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(some)), sizes)
                f = self.forward(np.concatenate([bags[i] for i in some]), first, of)
                step += 1
                for k, g in self.gradients(f, of, labels[some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    pace = rate * (1 - epoch / epochs) + 1e-4
                    self.p[k] -= pace * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * self.p[k])

    def packed(self) -> bytes:
        return np.concatenate([self.mean, self.scale, *[self.p[k].ravel() for k in self.NAMES]]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Attention:
        model, flat = cls(), np.frombuffer(data, np.float64)
        model.mean, model.scale, at = flat[:WIDTH], flat[WIDTH : 2 * WIDTH], 2 * WIDTH
        for k in cls.NAMES:
            size = model.p[k].size
            model.p[k] = flat[at : at + size].reshape(model.p[k].shape)
            at += size
        return model


def fit(sample: DataFrame, epochs: int = 20, seed: int = 3) -> bytes:
    """The packed model from a bounded sample of (doc_id, text, label), fitted in one task; its size is the caller's parameter.

    A sample without rows gives the model at its random start.
    """

    def learn(batches):
        hasher, inside = Hasher(seed, FEWER_BYTES), word_bytes()
        bags = []
        for batch in batches:
            labels, ids = batch.column("label").to_pylist(), batch.column("doc_id").to_pylist()
            for first, last, data, offsets in text_steps(batch.column("text"), FEWER_BYTES):
                owner, found = passages(data, offsets, hasher, inside)
                for i, own in enumerate(np.split(found, np.searchsorted(owner, np.arange(1, last - first)))):
                    bags.append((ids[first + i], labels[first + i], own))
        bags.sort(key=lambda x: x[0])
        model = Attention(seed)
        if bags:
            model.fit([x[2] for x in bags], np.array([x[1] for x in bags], float), epochs)
        yield pa.RecordBatch.from_arrays([pa.array([model.packed()], pa.binary())], names=["model"])

    models = sample.select("doc_id", "text", "label").coalesce(1).mapInArrow(tidy(learn), "model binary").collect()
    return bytes(models[0].model) if models else Attention(seed).packed()


def score(docs: DataFrame, model: bytes, threshold: float = 0.3, seed: int = 3) -> DataFrame:
    """The columns of `docs` with `_quality` (score) and `_predicted` for every row from all passages of its text.

    Null and empty texts are one passage of zeros. Rows are independent, nothing is shuffled; a model has a fixed size.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        scorer, hasher, inside = Attention.unpacked(held.value), Hasher(seed, FEWER_BYTES), word_bytes()
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, last, data, offsets in text_steps(batch.column("text"), FEWER_BYTES):
                owner, found = passages(data, offsets, hasher, inside)
                scores[first:last] = scorer.forward(found, np.searchsorted(owner, np.arange(last - first)), owner)["y"]
            columns = [*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_quality", "_predicted"])

    added = [T.StructField("_quality", T.DoubleType()), T.StructField("_predicted", T.IntegerType())]
    return docs.mapInArrow(tidy(apply), T.StructType([*docs.schema.fields, *added]))


def quality_model(docs: DataFrame, labels: DataFrame, learned, fit_rows: int = 8_000) -> bytes:
    """Fitted on at most `fit_rows` labelled documents for which `learned` holds."""
    return fit(labelled_sample(docs, labels, "quality", learned, fit_rows))
