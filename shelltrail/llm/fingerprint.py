"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelltrail.llm.common import LOWER, STEP_BYTES, Hasher, mixed, steps, word_bytes, word_places

#: Samples per signature; the standard error of a likeness is at most 1 / (2 sqrt(SAMPLES)).
SAMPLES = 64
#: (row, term) pairs that are sampled at once.
BLOCK = 1 << 11


class Sampler:
    """Signatures whose rate of equal places is, in the mean, the generalised Jaccard similarity of the weighted terms.

    Terms are lower-cased words, weights their counts. For each place k and term x, drawn from a hash of both: r and c
    from Gamma(2, 1), b uniform. With weight S, t = floor(ln S / r + b), y = exp(r (t - b)), a = c / (y exp(r)); place k
    holds the (x, t) of least a, as 16 bits. Texts without words have the signature of zeros.
    """

    def __init__(self, samples: int = SAMPLES, seed: int = 17):
        self.samples, self.hasher, self.inside = samples, Hasher(seed), word_bytes()
        self.seeds = mixed(np.arange(1, 3 * samples + 1, dtype=np.uint64) + np.uint64(seed << 32)).reshape(3, samples)

    def _uniform(self, terms: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Two uniform draws in (0, 1) per term and place, from the upper and the lower half of one hash."""
        x = terms[:, None] ^ self.seeds[which]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        halves = x.view(np.uint32).reshape(*x.shape, 2) >> np.uint32(8)
        uniform = halves.astype(np.float32)
        uniform += np.float32(0.5)
        uniform *= np.float32(2.0**-24)
        return uniform[..., 1], uniform[..., 0]

    def draws(self, terms: np.ndarray) -> np.ndarray:
        """For each term and place: 1 / r, r, b and ln c + r b - r. In blocks that stay in the cache."""
        out = np.empty((len(terms), 4, self.samples), np.float32)
        for low in range(0, len(terms), 256):
            some = terms[low : low + 256]
            u, v = self._uniform(some, 0)
            r = -np.log(u * v)
            u, v = self._uniform(some, 1)
            level = np.log(-np.log(u * v))
            b, _ = self._uniform(some, 2)
            level += r * b
            level -= r
            rows = out[low : low + 256]
            rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = 1 / r, r, b, level
        return out

    def signatures(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.samples), np.uint16)
        sizes = np.array([len(x) for x in texts], np.int64)
        places = np.concatenate([[0], np.cumsum(sizes)])
        for first, last in steps(places, 2 * STEP_BYTES):
            data = LOWER[np.frombuffer(b"".join(texts[first:last]), np.uint8)]
            offsets = places[first : last + 1] - places[first]
            starts, ends, row = word_places(data, offsets, self.inside)
            if len(starts):
                terms, term = np.unique(self.hasher.between(self.hasher.prefix(data), starts, ends), return_inverse=True)
                pairs, weights = np.unique(row * len(terms) + term, return_counts=True)
                self._sample(out[first:last], terms, pairs // len(terms), pairs % len(terms), np.log(weights).astype(np.float32))
        return out

    def _sample(self, out: np.ndarray, terms: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Fills the rows of `out`. Terms stand in the order of their hashes, so equal texts meet ties alike."""
        draws = self.draws(terms)
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        ends = np.append(heads[1:], len(row))
        i = 0
        while i < len(heads):
            j = max(i + 1, int(np.searchsorted(ends, heads[i] + BLOCK, "right")))
            at, own = term[heads[i] : ends[j - 1]], row[heads[i] : ends[j - 1]]
            drawn = draws[at]
            t = weight[heads[i] : ends[j - 1], None] * drawn[:, 0]
            t += drawn[:, 2]
            np.floor(t, out=t)
            a = drawn[:, 3] - drawn[:, 1] * t
            cuts = heads[i:j] - heads[i]
            least = np.minimum.reduceat(a, cuts, axis=0)
            which = np.repeat(np.arange(j - i), np.diff(np.append(cuts, len(at))))
            pair, place = np.divmod(np.flatnonzero(a == least[which]), self.samples)
            sample = mixed(terms[at[pair]] ^ (t[pair, place].astype(np.int64).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
            out[own[pair], place] = (sample >> np.uint64(48)).astype(np.uint16)
            i = j

    def likeness(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return (one == other).mean(axis=1)


def packed(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u2").tobytes()).decode()


def fingerprints(docs: DataFrame, samples: int = SAMPLES, seed: int = 17) -> DataFrame:
    """doc_id, fingerprint for every row of `docs`, from its whole text; null counts as empty. Nothing is shuffled."""

    def sign(batches):
        sampler = Sampler(samples, seed)
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            signs = pa.array([packed(s) for s in sampler.signatures(texts)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signs], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """_bucket, _guest, doc_id, text, in partitions sorted so that a document's next by descending id is the next row.

    Ids are cut into `buckets` ranges. The first document of each range goes to the range before it as well, as a guest
    behind its last row, and the first of all goes behind the last of all. So one shuffle of the texts is enough, and no
    task sees more than its ranges. The driver sees two numbers per range. Equal ids come by text, null ids are left out.
    """
    ids = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    number = F.col("doc_id").cast("double")
    cuts = sorted(set(ids.agg(F.percentile_approx(number, shares, 100 * buckets)).first()[0] or [0.0]))
    ranges = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_number", outputCol="_range", handleInvalid="keep")
    placed = ranges.transform(ids.withColumn("_number", F.col("doc_id").cast("double"))).select(F.col("_range").cast("int").alias("_bucket"), "doc_id", "text")
    tops = sorted(placed.groupBy("_bucket").agg(F.max("doc_id").alias("top")).collect())
    # The last row of range i is followed by the top of range i - 1; the last of the lowest by the top of the highest.
    guests = [(tops[i - 1].top, tops[i]._bucket) for i in range(len(tops))]
    guest = docs.sparkSession.createDataFrame(guests, "_top long, _to int")
    copies = placed.join(F.broadcast(guest), F.col("doc_id") == F.col("_top")).select(F.col("_to").alias("_bucket"), F.lit(True).alias("_guest"), "doc_id", "text")
    every = placed.select("_bucket", F.lit(False).alias("_guest"), "doc_id", "text").union(copies)
    return every.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "_guest", F.desc("doc_id"), "text")


def edited_likeness(docs: DataFrame, samples: int = SAMPLES, seed: int = 17, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per document.

    The edited text is the text with its last floor(n / 3) code points replaced by as many of the next document's first
    (or all it has). The next of the last document is the first; a single document follows itself. Two texts without
    words are alike, one without words is unlike any other.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(rows: list[tuple], sampler: Sampler):
        """Rows (id, text) of which each but the last, or the last by its guest, is followed by its next document."""
        texts = [text for _, text in rows]
        edited = [text[: len(text) - len(text) // 3] + after[: len(text) // 3] for text, after in zip(texts, texts[1:])]
        n = len(edited)
        # Side by side, as a text and its edited form share most draws.
        both = sampler.signatures([x.encode() for pair in zip(texts, edited) for x in pair] + [texts[n].encode()] * (len(texts) > n))
        signs, changed = both[0::2], both[1::2]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in rows[:n]], pa.int64()),
                pa.array([len(x) for x in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array([packed(s) for s in signs[:n]], pa.string()),
                pa.array([packed(s) for s in changed], pa.string()),
                pa.array(sampler.likeness(signs[:n], changed)),
                pa.array(sampler.likeness(signs[:n], signs[1:])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def walk(batches):
        sampler = Sampler(samples, seed)
        held: list[tuple] = []
        bucket, size, ended = None, 0, False
        for batch in batches:
            for of, guest, doc_id, text in zip(*(column.to_pylist() for column in batch.columns)):
                if of != bucket:
                    bucket, held, size, ended = of, [], 0, False
                if ended:
                    continue  # a second guest has the same id as the first
                held.append((doc_id, text))
                size += len(text)
                ended = guest
                if (size > 1 << 20 or ended) and len(held) > 1:
                    yield compare(held, sampler)
                    held, size = held[-1:], 0

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, buckets).mapInArrow(walk, schema)
