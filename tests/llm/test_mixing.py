"""Water-filling next to a plain loop, and the mixture's rows."""

import pytest
from pyspark.sql import functions as F

from shelltrail.llm import mixing


def filled_by_loop(sizes, max_epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > max_epochs * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            target[s] = float(max_epochs * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 5, "c": 900, None: 10}, {"a": 10}, {"b": 3, "a": 3, "Z": 3, "é": 3}, {"a": 0, "b": 7}, {"a": 0}, {"x": 1, "y": 1, "z": 10**6, "w": 2},
])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(mixing.cycled_weights(frame)).collect()}
    assert got == pytest.approx(filled_by_loop(sizes))


def test_word_count(spark):
    texts = [None, "", " ", "a", " a", "a ", "a  b\t\n c d", "\x0b\x0c\r"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in frame.select(mixing.word_count(F.col("text"))).collect()] == [0, 0, 0, 1, 1, 1, 3, 0]


ROWS = [(i, "w " * (i % 40 + 1), "hot" if i % 3 else f"s{i % 5}", i) for i in range(600)] + [(600, None, None, 0), (601, "", "s1", 0), (7, "w w", "hot", 0)]
SCHEMA = "doc_id long, text string, source string, target long"


def test_plan_and_rows_agree(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    plan = mixing.mixing_plan(docs).collect()
    assert len(plan) == len(ROWS) and all(0 <= r.taken <= 3 * r.size for r in plan)
    taken, target = {}, {}
    for r in plan:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 40 for s in taken)
    rows = mixing.mix(docs)
    assert rows.columns == docs.columns
    words = rows.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert {r.source: r.n for r in words.collect()} == {s: n for s, n in taken.items() if n}


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mixing_plan(docs).count() == 0 and mixing.mix(docs).count() == 0
