"""Removed bytes next to a plain search over all strings."""

import hashlib
import random
from collections import Counter

import pytest

from shelltrail.llm import repeats


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = [False] * (len(d) + 1)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                cover[i : i + length] = [True] * length
        kept = bytes(b for b, c in zip(d, cover) if not c)
        runs = sum(1 for i in range(len(d)) if cover[i] and not (i and cover[i - 1]))
        out.append((len(d), len(d) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.randint(1, 160))) for _ in range(25)]
    passage = " ".join(word() for _ in range(45))
    texts = list(base)
    for t in base[:12]:
        words = t.split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
        i = rng.randrange(len(t) + 1)
        texts.append(t[:i] + passage + t[i:])
    texts += [base[0]] * 3 + [None, "", "a" * 700, "ab" * 260, passage * 2, passage[:-1] + "!", "z" * 199, "z" * 200, "y" * 201]
    return texts


@pytest.mark.parametrize(("seed", "length", "gram", "block"), [(1, 200, 64, 4096), (2, 60, 20, 4096), (3, 60, 20, 3), (4, 40, 40, 4096), (5, 30, 8, 2)])
def test_equals_a_plain_search(spark, monkeypatch, seed, length, gram, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    texts = fixture(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.repeat_digest(docs, length, gram).collect()}
    assert got == dict(enumerate(plain(texts, length)))


def test_small_batches_and_repeated_rows(spark):
    texts = fixture(7)
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[1] + "x"), (2, texts[2])] + [(3, t) for t in texts[3:]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted(map(repr, (tuple(r) for r in repeats.repeat_digest(docs, 60, 20).collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(repr((i, *p)) for (i, _), p in zip(rows, plain([t for _, t in rows], 60)))


def test_texts_without_repeats(spark):
    docs = spark.createDataFrame([(1, "é" * 10 + "b" * 40, "k"), (2, "c" + "b" * 40, "k"), (3, None, "k")], "doc_id long, text string, _x string")
    out = {r.doc_id: (r.text, r._x) for r in repeats.without_repeats(docs, 40, 10).collect()}
    assert out == {1: ("é" * 10, "k"), 2: ("c", "k"), 3: (None, "k")}
    assert repeats.without_repeats(docs.limit(0), 40, 10).count() == 0


def test_copies_are_judged_in_one_pass(spark):
    """What is removed does not depend on a later scan cutting the rows into the batches of the first."""
    texts = fixture(8)
    texts += [texts[3] + " " + "q" * 30] * 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = repeats.repeat_digest(docs, 60, 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        got = {r.doc_id: tuple(r)[1:] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == dict(enumerate(plain(texts, 60)))


def test_no_task_holds_a_large_bucket(spark, monkeypatch, tmp_path):
    """Members of a common passage with other surroundings each: more than BLOCK of them never meet in one task's memory,
    and a row that repeats brings its bytes once a batch."""
    monkeypatch.setattr(repeats, "BLOCK", 8)
    plain_refined, seen = repeats._refined, tmp_path / "seen"
    seen.mkdir()

    def watched(length, gram):
        refine = plain_refined(length, gram)

        def run(batches):
            batches = list(batches)
            buckets = Counter(b for batch in batches for b in batch.column("bucket").to_pylist())
            (seen / str(random.random())).write_text(str(max(buckets.values(), default=0)))
            return refine(iter(batches))

        return run

    monkeypatch.setattr(repeats, "_refined", watched)
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    texts = ["".join(rng.choice("ijklmnop ") for _ in range(70)) + line + "".join(rng.choice("ijklmnop ") for _ in range(70)) for _ in range(60)]
    rows = [*enumerate(texts), *[(None, texts[0] + "x")] * 30, *[(None, "y" + line)] * 30]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(repr, (tuple(r) for r in repeats.repeat_digest(docs, 60, 20).collect())))
    assert got == sorted(repr((i, *p)) for (i, _), p in zip(rows, plain([t for _, t in rows], 60)))
    assert max(int(f.read_text()) for f in seen.iterdir()) <= 8
