"""Links, components and recall next to all cosines."""

import numpy as np

from shelltrail.llm import embeddings


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)) * 2
    near, short = embeddings.nearest_e8(x), embeddings.shortest_vectors()
    assert len(np.unique(short, axis=0)) == 240 and np.allclose((short**2).sum(1), 2)
    assert np.all((near.sum(1) % 2 == 0)) and (((x - near) ** 2).sum(1) <= 1 + 1e-9).all()
    assert np.all(((x - near) ** 2).sum(1)[:, None] <= ((x[:, None] - near[:, None] - short) ** 2).sum(2) + 1e-9)


def plain(ids, labels, vectors, least=0.93):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    link = (unit @ unit.T >= least) & (labels[:, None] == labels)
    np.fill_diagonal(link, False)
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(link, comp, np.iinfo(np.int64).max).min(1))
        if (new == comp).all():
            return link, comp
        comp = new


def fixture(n=1500, width=64):
    rng = np.random.default_rng(7)
    v = rng.standard_normal((n, width))
    for i in range(0, n, 3):
        base = v[rng.integers(0, n)]
        cosine = rng.uniform(0.90, 0.99)
        side = rng.standard_normal(width)
        side -= side @ base / (base @ base) * base
        v[i] = base / np.linalg.norm(base) * cosine + side / np.linalg.norm(side) * np.sqrt(1 - cosine**2)
    v[100:160] = v[100]
    v[200:400] = v[200] + 0.1 * rng.standard_normal((200, width)) / 8 * np.linalg.norm(v[200])
    return np.arange(n) * 7 + 3, rng.integers(0, 3, n) * (np.arange(n) >= 400), v.astype(np.float32)


def test_recall_and_components(spark, monkeypatch):
    ids, labels, vectors = fixture()
    link, comp = plain(ids, labels, vectors.astype(np.float64))
    rows = list(zip(ids.tolist(), vectors.tolist(), labels.tolist(), ["x"] * len(ids)))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}
    found, there = sum(r.n_links for r in got.values()), int(link.sum())
    assert len(got) == len(ids) and 0.99 * there <= found <= there
    assert all(got[i].n_links <= n for i, n in zip(ids.tolist(), link.sum(1).tolist()))
    assert sum(got[i].component_id == c for i, c in zip(ids.tolist(), comp.tolist())) >= 0.99 * len(ids)
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    again = {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}
    assert again == got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [2.0, 4.0], 0), (4, [1.0, 2.0], 1), (5, [1.0, 2.0], None), (6, None, 0), (7, [0.0, 0.0], 0), (8, [1.0, None], 0),
        (9, [1.0, nan], 0), (10, [1.0, inf], 0), (11, [], 0), (12, [1.0, 2.0, 0.0], 0), (None, [1.0, 2.0], 0), (13, [5.0, 5.0], 2), (13, [5.0, 5.0], 2), (14, [3e38, 3e38], 3), (15, [1e-38, 1e-38], 3),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(frame).collect()), key=str)
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)]
    expected = [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), *alone, (None, 0, None, False), (13, 1, 13, True), (13, 1, 13, True), (14, 1, 14, True), (15, 1, 14, False)]
    assert got == sorted(expected, key=str)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0
