"""Components next to comparing all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelltrail.llm import jaccard


def plain(texts):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdE") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(30):
        words = [word() for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 14, 30, 60, 120, 300]))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            near = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                near[rng.randrange(len(near))] = word()
            cut = rng.randint(0, len(near) // 5)
            texts.append("\t".join(near[cut:]).upper() if rng.random() < 0.3 else " ".join(near[cut:] if rng.random() < 0.5 else near[: len(near) - cut]))
        if rng.random() < 0.5:
            texts.append(" ".join(passage[: rng.randint(40, 60)] + words[: rng.randint(0, 12)]))
    return texts + [None, "", " \n", "one", "One", "a b c d", "a b c d e", "x\x0by", texts[0], texts[0]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed):
    texts = fixture(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_components(docs).collect()}
    assert got == plain(texts)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 13, 20, 26, 27, 28, 80, 81, 100, 240, 243, 700, 729, 3000]:
        for round_ in range(40):
            shared = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            extra = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            total = size * 4 // 3
            mine = rng.integers(0, total - size + 1)
            a, b = np.sort(np.append(shared, extra[:mine])), np.sort(np.append(shared, extra[mine : total - size]))
            hot = np.sort(rng.choice(a, len(a) * (round_ % 5) // 4, replace=False))
            found, of = jaccard.signatures([a, b], hot)
            assert set(found[of == 0]) & set(found[of == 1]), (size, len(a), len(b))
            alone, _ = jaccard.signatures([b], hot)
            assert sorted(alone) == sorted(found[of == 1])


@pytest.mark.parametrize("together, columns, rare", [(1 << 17, 2048, 1 / 256), (40, 7, 0.01), (40, 7, 1), (300, 3, 0)])
def test_similar_in_columns(monkeypatch, together, columns, rare):
    for name, value in (("TOGETHER", together), ("COLUMNS", columns), ("RARE", rare)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(2)
    names = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    base = [set(rng.integers(0, 60, 30).tolist()) for _ in range(6)]
    sets = [x - set(rng.integers(0, 60, rng.integers(0, 9)).tolist()) or {1} for x in base for _ in range(5)]
    arrays = [np.sort(names[list(x)]) for x in sets]
    assert jaccard.intersections(arrays, arrays[:7]).tolist() == [[len(x & y) for y in sets[:7]] for x in sets]
    want = [[100 * len(x & y) >= 75 * len(x | y) for y in sets] for x in sets]
    assert jaccard.similar(arrays, arrays).tolist() == want


def pa_batches(signature, node, size):
    return [pa.RecordBatch.from_arrays([pa.array(signature[i : i + size], pa.int64()), pa.array(node[i : i + size], pa.int64())], names=["signature", "node"]) for i in range(0, len(node), size)]


@pytest.mark.parametrize("run", [4, 1 << 16])
def test_shared_signatures(monkeypatch, run):
    monkeypatch.setattr(jaccard, "RUN", run)
    rng = random.Random(4)
    rows = sorted((rng.randint(0, 12) ** 2, rng.randint(0, 9)) for _ in range(200)) + [(999, 1), (999, 1)]
    for size in (1, 2, 7, 500):
        got = [tuple(row.values())[:2] for batch in jaccard._shared(iter(pa_batches(*zip(*rows), size))) for row in batch.to_pylist()]
        once = sorted(set(rows))
        assert got == [r for r in once if sum(x[0] == r[0] for x in once) > 1]


def test_sketches_lose_nothing_and_tell_unlike_sets_apart():
    rng = np.random.default_rng(8)
    sets = []
    for size in [1, 2, 5, 16, 31, 32, 33, 60, 64, 65, 127, 128, 129, 500, 3000]:
        shared = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for more in (0, 1, size // 8, size // 7, size // 6, size // 5, size // 3):
            sets.append(np.unique(np.append(shared, rng.integers(0, 1 << 63, more, dtype=np.uint64))))
            sets.append(shared[: size - more] if more < size else shared)
    sets = [np.sort(x) for x in sets]
    sizes, sketches = np.array([len(x) for x in sets]), [jaccard.sketch(x) for x in sets]
    may = jaccard.maybe_similar([sizes, sizes[:70]], [sketches, sketches[:70]])
    exact = np.array([[4 * len(np.intersect1d(x, y)) >= 3 * len(np.union1d(x, y)) for y in sets[:70]] for x in sets])
    assert not (exact & ~may).any() and may.sum() < 1.5 * exact.sum()
    apart = [np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in rng.integers(100, 1000, 200)]
    sizes, sketches = np.array([len(x) for x in apart]), [jaccard.sketch(x) for x in apart]
    assert (jaccard.maybe_similar([sizes, sizes], [sketches, sketches]) == np.eye(200, dtype=bool)).all()


@pytest.mark.parametrize("own", [60, 120])
def test_sets_of_unlike_texts_stay_at_home(spark, monkeypatch, own):
    seen = []
    plain_links = jaccard.links_in_blocks

    def links(asked, sets):
        seen.append(sets.count())
        return plain_links(asked, sets)

    monkeypatch.setattr(jaccard, "links_in_blocks", links)
    texts = unlike(300, random.Random(9), passage=60, own=own)
    texts += [texts[0] + " more", texts[1] + " and more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.similarity_components(docs).collect()}
    assert got == {i: {300: 0, 301: 1}.get(i, i) for i in range(302)}
    assert max(seen) <= 4


def unlike(count, rng, passage=0, own=120):
    """Texts that share a passage of their own each and nothing else."""
    common = " ".join(f"c{i}" for i in range(passage))
    return [common + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(own)) for _ in range(count)]


def counted(spark, monkeypatch, texts):
    """(components, rows that were compared in the last step)."""
    seen = []
    plain_units = jaccard.open_units

    def units(*tables):
        asked = plain_units(*tables)
        seen.append(jaccard._spread(asked.withColumn("n", F.lit(100))).count())
        return asked

    monkeypatch.setattr(jaccard, "open_units", units)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.similarity_components(docs).collect()}
    return got, seen[0]


def test_a_common_passage_makes_no_pairs(spark, monkeypatch):
    texts = unlike(2000, random.Random(5), passage=60)
    got, rows = counted(spark, monkeypatch, texts)
    assert all(i == c for i, c in got.items()) and rows < 2 * len(texts)


def test_a_family_of_near_copies(spark, monkeypatch):
    rng = random.Random(6)
    original = [f"o{i}" for i in range(150)]
    texts = [" ".join(original)]
    for n in range(700):  # from one word changed to most shingles changed
        copy = list(original)
        for at in rng.sample(range(150), 1 + n % 12):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    got, rows = counted(spark, monkeypatch, texts)
    assert got == {i: c for i, (_, c) in plain(texts).items()}
    assert rows < 8 * len(texts) and 1 < len(set(got.values())) < len(texts)


@pytest.mark.parametrize("name, value", [("BLOCK_NODES", 3), ("BLOCK_ELEMENTS", 100), ("MOST_CLUSTERS", 1), ("HOT_IN", 2)])
def test_small_blocks(spark, monkeypatch, name, value):
    monkeypatch.setattr(jaccard, name, value)
    texts = fixture(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_components(docs).collect()} == plain(texts)


def test_sets_with_half_a_hash_in_common(spark, monkeypatch):
    whole = jaccard.set_hashes
    monkeypatch.setattr(jaccard, "set_hashes", lambda elements: (whole(elements)[0] % 3, whole(elements)[1]))
    texts = fixture(5)[:60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_components(docs).collect()} == plain(texts)


def test_odd_tables(spark):
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 2), (5, "q r s t u v w", 3), (9, "q r s t u v w", 4), (None, "a b c d e f", 5), (None, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component long")
    got = sorted((tuple(r) for r in jaccard.similarity_components(docs).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (5, 3, 5), (9, 3, 5), (None, 2, 5), (None, 0, None)], key=str)
    assert jaccard.similarity_components(docs.limit(0)).count() == 0
