"""The rate of equal samples next to generalised Jaccard similarity, and the next document."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from shelltrail.llm import fingerprint


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / sum((a | b).values())


def test_collisions_are_generalised_jaccard():
    rng = random.Random(5)
    sampler = fingerprint.Sampler(samples=4000)
    for share in (0.1, 0.5, 0.9):
        words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(300)]
        other = [w if rng.random() < share else f"v{rng.randrange(200)}" for w in words]
        a, b = " ".join(words), " ".join(other)
        one, two = sampler.signatures([a.encode(), b.encode()])
        assert (one == two).mean() == pytest.approx(jaccard(a, b), abs=0.035)


def test_equal_texts_in_any_company():
    texts = [f"{i} common words Here {i % 7} words".encode() for i in range(500)] + [b"", b" \n", b"x" * 3_000_000, b"w " * 5]
    together = fingerprint.Sampler().signatures(texts)
    for i in (0, 77, 499, 500, 501, 502, 503):
        assert (fingerprint.Sampler().signatures([texts[i]])[0] == together[i]).all()
    assert not together[500].any() and not together[501].any()


@pytest.mark.parametrize(("n", "buckets"), [(57, 5), (3, 8), (1, 4), (40, 1)])
def test_edited_texts(spark, n, buckets):
    rng = random.Random(n)
    texts = {i * 37 - 20: "".join(rng.choice("aé 🙂b ") for _ in range(rng.randint(0, 90))) for i in range(n)}
    texts[-20] = None
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, fingerprint string").repartition(4)
    got = {r.doc_id: r for r in fingerprint.edited_likeness(docs, buckets=buckets).collect()}
    order = sorted(texts, reverse=True)
    sampler = fingerprint.Sampler()
    assert set(got) == set(texts)
    for i, doc_id in enumerate(order):
        text, after = texts[doc_id] or "", texts[order[(i + 1) % n]] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        own, changed, following = sampler.signatures([x.encode() for x in (text, edited, after)])
        row = got[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == fingerprint.packed(own) and row.edited_fingerprint == fingerprint.packed(changed)
        assert row.near_edited == np.mean(own == changed) and row.near_next == np.mean(own == following)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b d"), (2, None), (None, "x")], "doc_id long, text string")
    assert sorted(r.doc_id for r in fingerprint.edited_likeness(docs, buckets=3).collect()) == [1, 1, 2]
    assert fingerprint.edited_likeness(docs.limit(0), buckets=3).count() == 0
    assert fingerprint.fingerprints(docs).count() == 4
