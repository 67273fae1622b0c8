"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelltrail.llm.common import text_steps, written
from shelltrail.llm.lookup import Lookup
from shelltrail.llm.sampling import first_per

#: Bytes of context; with the byte itself a key of at most eight bytes.
ORDER = 4


def context_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it, zeros before a text's begin, as one number; the byte itself is lowest."""
    keys = data.astype(np.uint64)
    wide = keys.copy()
    for back in range(1, ORDER + 1):
        shifted = np.zeros_like(keys)
        shifted[back:] = keys[:-back]
        for ahead in range(back):
            at = offsets[:-1] + ahead
            shifted[at[at < offsets[1:]]] = 0
        wide |= shifted << np.uint64(8 * back)
    return wide


def low(keys: np.ndarray, order: int) -> np.ndarray:
    """The key with `order` bytes of context only."""
    return keys & np.uint64((1 << (8 * (order + 1))) - 1)


def count_contexts(sample: DataFrame) -> DataFrame:
    """lang, key, n: how often each byte follows each context of ORDER bytes, from (lang, text)."""

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            found: dict[str, list] = {}
            for first, last, data, offsets in text_steps(batch.column("text")):
                keys, row = context_keys(data, offsets), np.repeat(np.arange(last - first), np.diff(offsets))
                mine = langs[first:last]
                for lang in set(mine):
                    found.setdefault(lang, []).append(keys[(mine == lang)[row]])
            for lang, parts in found.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "key", "n"])

    return sample.select("lang", "text").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen context trees of all languages, merged: one lookup gives a byte's code length in every language.

    In a context seen n times with d different bytes, a byte seen c times costs -log2(c / (n + d)); any other byte pays
    the escape -log2(d / (n + d)) and what it costs in the context that is one byte shorter. A context never seen
    costs no escape. Below the empty context every byte costs eight bits.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray, longest: np.ndarray | None = None):
        """`longest` is the order up to which a row counts, ORDER if not given."""
        self.langs, size, rows = langs, len(langs), (lang, key, n)
        self.symbols, self.costs, self.contexts, self.escapes = [], [], [], []
        for order in range(ORDER + 1):
            lang, key, n = rows if longest is None else (column[longest >= order] for column in rows)
            pair, inverse = np.unique(np.stack([lang.astype(np.uint64), low(key, order)]), axis=1, return_inverse=True)
            of, own = pair[0].astype(np.int64), pair[1]
            count = np.bincount(inverse.ravel(), n)
            contexts, at = np.unique(own >> np.uint64(8), return_inverse=True)
            cell = at * size + of
            total = np.bincount(cell, count, len(contexts) * size)
            kinds = np.bincount(cell, minlength=len(contexts) * size)
            escape = np.where(kinds > 0, np.log2(np.maximum(total + kinds, 1)) - np.log2(np.maximum(kinds, 1)), 0)
            symbols, place = np.unique(own, return_inverse=True)
            # What a byte costs that this order does not hold for a language: its escape and the shorter contexts.
            index = Lookup(contexts)
            cost = self.cost(symbols, order - 1) + escape.reshape(len(contexts), size)[index.find(symbols >> np.uint64(8))]
            cost[place, of] = np.log2(total[cell] + kinds[cell]) - np.log2(count)
            self.symbols.append(Lookup(symbols))
            self.costs.append(cost.astype(np.float32))
            self.contexts.append(index)
            self.escapes.append(escape.reshape(len(contexts), size).astype(np.float32))

    def cost(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Code length of each key's byte, by language."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        left = np.arange(len(keys))
        for k in range(order, -1, -1):
            if not len(left):
                return out
            own = low(keys[left], k)
            at = self.symbols[k].find(own)
            known = at >= 0
            out[left[known]] += self.costs[k][at[known]]
            left, own = left[~known], own[~known]
            context = self.contexts[k].find(own >> np.uint64(8))
            seen = context >= 0
            out[left[seen]] += self.escapes[k][context[seen]]
        out[left] += 8
        return out


def fit(docs: DataFrame, learned: Column, fit_docs: int = 400, least: int = 2) -> ContextTrees:
    """Trees from at most `fit_docs` documents of each language. A byte seen fewer than `least` times after a context of
    ORDER bytes is left out there, and counts in all shorter contexts; a language with one learned byte has a tree.

    The tables that reach the driver grow with the number of languages and the sample, not with the corpus.
    """
    known = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & learned).dropDuplicates(["doc_id"])
    picked = F.broadcast(written(first_per(known, "lang", fit_docs), "language-sample"))
    sample = docs.select("doc_id", "text").join(picked, "doc_id")
    kept = F.col("n") >= least
    key = F.when(kept, F.col("key")).otherwise(F.col("key").bitwiseAND(F.lit((1 << (8 * ORDER)) - 1)))
    longest = F.when(kept, ORDER).otherwise(ORDER - 1)
    counts = count_contexts(sample).groupBy("lang", key.alias("key"), longest.alias("longest")).agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counts.lang))
    number = {name: i for i, name in enumerate(langs)}
    columns = counts.lang.map(number).to_numpy(np.int64), counts.key.to_numpy(np.int64).astype(np.uint64), counts.n.to_numpy(np.float64)
    return ContextTrees(langs, *columns, counts.longest.to_numpy(np.int64))


def predict(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """doc_id, lang_pred, score: the language whose tree codes the whole text shortest, and its share if each language
    is as likely as its code length says.

    Null texts, texts without a letter, and every text where no language was learned are `und` with score 0. Equal
    lengths go to the first language by name. Rows are independent, nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(trees))

    def apply(batches):
        trees = pickle.loads(held.value)
        limit = max(1 << 14, (1 << 22) // max(1, len(trees.langs)))
        for batch in batches:
            letters = np.array(batch.column("letters").to_pylist(), bool)
            found, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for first, last, data, offsets in text_steps(batch.column("text"), min(limit, 1 << 20)):
                if not trees.langs or not len(data):
                    continue
                keys, bits = context_keys(data, offsets), np.zeros((last - first, len(trees.langs)))
                row = np.repeat(np.arange(last - first), np.diff(offsets))
                for low_ in range(0, len(keys), limit):
                    cost, own = trees.cost(keys[low_ : low_ + limit]), row[low_ : low_ + limit]
                    cuts = np.flatnonzero(np.diff(own, prepend=-1))
                    bits[own[cuts]] += np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)
                best = bits.argmin(1)
                share = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
                found[first:last] = np.array(trees.langs, object)[best]
                scores[first:last] = share
            found[~letters], scores[~letters] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", letters).mapInArrow(apply, f"doc_id {kind}, lang_pred string, score double")
