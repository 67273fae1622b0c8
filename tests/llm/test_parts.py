"""Helpers that several operators share."""

import random
import re

import numpy as np
import pyarrow as pa

from shelltrail.llm import common
from shelltrail.llm.graph import components
from shelltrail.llm.lookup import Lookup


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)]
    links += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(7, 7), (None, 3), (5000, 5001), (5001, 5000)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_do_not_cross_texts():
    texts = ["", "a", "b c", "\t d\ne ", "", "f", "gh"]
    column = pa.array([None, *texts])
    for limit in (1, 3, 100):
        found = []
        for first, last, data, offsets in common.text_steps(column, limit):
            starts, ends, row = common.word_places(data, offsets, common.word_bytes())
            found += [(first + r, bytes(data[s:e]).decode()) for s, e, r in zip(starts, ends, row)]
        assert found == [(i + 1, w) for i, t in enumerate(texts) for w in re.findall(r"\S+", t)]
    sliced = column.slice(2, 3)
    assert [(int(o[-1])) for _, _, _, o in common.text_steps(sliced)] == [sum(len(t) for t in texts[1:4])]


def test_hashes_are_of_content():
    hasher = common.Hasher(5, longest=4)
    data = np.frombuffer(b"xxhello..hello", np.uint8)
    prefix = hasher.prefix(data)
    one, two, three = hasher.between(prefix, np.array([2, 9, 3]), np.array([7, 14, 8]))
    assert one == two != three


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    found = Lookup(keys).find(np.concatenate([keys[::-1], keys + np.uint64(1 << 50)]))
    assert (found[: len(keys)] == np.arange(len(keys))[::-1]).all() and (found[len(keys) :] == -1).all()
    assert (Lookup(np.zeros(0, np.uint64)).find(keys) == -1).all()
