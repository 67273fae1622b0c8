"""Toxicity, language and quality: held-out accuracy on the sample tables, plain versions of the parts, odd rows."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelltrail.llm import common, language, quality, queries, toxicity

SF = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")
ODD = [None, "", " \n", "\x00", "a", "é" * 5000, "word " * 30_000, "!!! ???", "日本語", "A b"]


def odd(spark, labels=()):
    docs = spark.createDataFrame([(i, t, None, "x", 1.0) for i, t in enumerate(ODD)] + [(3, "a", "en", "x", 2.0)], "doc_id long, text string, lang string, label string, score double")
    return docs, spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")


def held_out(frame, labels, label):
    rows = frame.filter("held_out").join(labels.select("doc_id", label), "doc_id").collect()
    hits = Counter((r[label], r.predicted) for r in rows)
    return hits[1, 1] / (hits[1, 1] + hits[1, 0]), hits[0, 0] / (hits[0, 0] + hits[0, 1])


@needs_data
def test_held_out_toxicity_and_quality(spark):
    labels = common.table(spark, SF, "labels")
    caught, spared = held_out(queries.op1_toxicity(spark, SF), labels, "toxic")
    assert caught > 0.85 and spared > 0.98
    kept, refused = held_out(queries.op5_quality(spark, SF), labels, "quality")
    assert kept > 0.98 and refused > 0.95


@needs_data
def test_held_out_language(spark):
    found = queries.op2_language(spark, SF).filter("held_out").join(common.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99


def test_odd_rows(spark):
    docs, none = odd(spark)
    _, some = odd(spark, [(0, 0, 1), (3, 1, 0), (4, 1, 0), (6, 0, 1), (6, 1, 1), (None, 1, 1), (7, None, None), (99, 1, 0)])
    for labels in (none, some):
        scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, F.lit(True)).collect()}
        assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores.values()) and scores[0] == scores[1] == scores[2]
        rows = quality.score(docs, quality.quality_model(docs, labels, F.lit(True))).collect()
        assert len(rows) == len(ODD) + 1 and rows[0].label == "x" and all(0 <= r._quality <= 1 for r in rows)
    assert toxicity.toxicity(docs.limit(0), none, F.lit(True)).count() == 0
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0).select("doc_id", "text", F.lit(1).alias("label")))).count() == 0
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, language.fit(docs, F.lit(True), least=1)).collect()}
    assert found[0] == found[1] == found[2] == found[7] == ("und", 0.0) and found[4] == ("en", 1.0) and found[6][0] == "en"
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs, F.lit(False))).collect()} == {"und"}


def test_code_lengths_equal_a_plain_walk(spark):
    texts = {"a": "abracadabra abba", "b": "babble bubble babb", "c": "cccc"}
    sample = spark.createDataFrame(list(texts.items()), "lang string, text string")
    counts = language.count_contexts(sample).toPandas()
    langs = sorted(texts)
    trees = language.ContextTrees(langs, counts.lang.map(langs.index).to_numpy(), counts.key.to_numpy().astype(np.uint64), counts.n.to_numpy(float))

    def bits(lang, text):
        data, total = b"\0" * language.ORDER + text.encode(), 0.0
        learned = b"\0" * language.ORDER + texts[lang].encode()
        for i in range(language.ORDER, len(data)):
            for order in range(language.ORDER, -2, -1):
                if order < 0:
                    total += 8
                    break
                after = Counter(learned[j : j + 1] for j in range(language.ORDER, len(learned)) if learned[j - order : j] == data[i - order : i])
                n, d = sum(after.values()), len(after)
                if after[data[i : i + 1]]:
                    total += math.log2((n + d) / after[data[i : i + 1]])
                    break
                total += math.log2((n + d) / d) if n else 0
        return total

    for text in ("abra", "babble", "xyz é", "ccab" * 20):
        data = np.frombuffer(text.encode(), np.uint8)
        got = trees.cost(language.context_keys(data, np.array([0, len(data)]))).sum(0)
        assert got == pytest.approx([bits(lang, text) for lang in langs], rel=1e-4)


def test_attention_gradients():
    rng = np.random.default_rng(2)
    model, x, first, of, y = quality.Attention(), rng.standard_normal((7, quality.WIDTH)), np.array([0, 2, 3]), np.array([0, 0, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, first, of)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    found = model.gradients(model.forward(x, first, of), of, y)
    for name, g in found.items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        kept = model.p[name][at]
        model.p[name][at] = kept + 1e-5
        up = loss()
        model.p[name][at] = kept - 1e-5
        down = loss()
        model.p[name][at] = kept
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_passages_of_a_document_do_not_depend_on_its_neighbours():
    hasher, inside = common.Hasher(3), common.word_bytes()
    texts = [b"", b"one two. Three " * 40, b"x", b" \n ", b"A!! B!! " * 100, b" "]

    def features(some):
        offsets = np.cumsum([0, *map(len, some)])
        return quality.passages(np.frombuffer(b"".join(some), np.uint8), offsets, hasher, inside)

    owner, together = features(texts)
    assert owner.tolist() == [0, 1, 1, 2, 3, 4, 4, 4, 4, 5]
    for i, text in enumerate(texts):
        assert np.allclose(together[owner == i], features([text])[1], atol=1e-6)


def test_sparse_weights_follow_the_definition():
    model, seen = toxicity.Ftrl(4, alpha=0.5, beta=1, l1=0.1, l2=0.2), []
    z, n = [0.0] * 5, [0.0] * 5
    for at, y in [([0, 4], 1), ([0, 1, 4], 0), ([0, 4], 1), ([2, 4], 1)] * 5:
        def weight(i):
            l1 = 0 if i == 4 else 0.1
            return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1 + math.sqrt(n[i])) / 0.5 + 0.2)

        w = {i: weight(i) for i in at}
        p = 1 / (1 + math.exp(-sum(w.values())))
        seen.append((model.learn(np.array(at), y), p))
        for i in at:
            g = p - y
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert all(a == pytest.approx(b) for a, b in seen)


def test_a_language_with_one_short_document_is_learned(spark):
    """At the production default of `least`: nothing of a short text comes twice, all of it counts in short contexts."""
    texts = [(i, f"the cat number {i} sat on the mat", "en") for i in range(40)] + [(40, "zażółć", "pl"), (41, "x", "xx")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    trees = language.fit(docs, F.lit(True))
    assert trees.langs == ["en", "pl", "xx"]
    found = {r.doc_id: r.lang_pred for r in language.predict(docs, trees).collect()}
    assert found == {i: lang for i, _, lang in texts}
    every = language.fit(docs, F.lit(True), least=1)
    for order in range(language.ORDER):
        assert np.array_equal(trees.costs[order], every.costs[order]) and np.array_equal(trees.escapes[order], every.escapes[order])
    alone = language.fit(docs.filter("lang = 'xx'"), F.lit(True))
    assert [r.lang_pred for r in language.predict(docs.filter("doc_id = 40"), alone).collect()] == ["xx"]
