"""Each stage next to a brute-force version, on its own input."""

import os
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from shelltrail.llm import bpe, jaccard, mixing, quality, repeats
from shelltrail.llm.common import fold, table, tidy
from test_jaccard import plain as components
from test_repeats import plain as repeated

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of each stage and the output of the last, written and read again."""
    docs = table(spark, SF, "documents")
    # Copies, a null text, a null source and a column with a clashing name.
    more = docs.limit(5).withColumn("doc_id", F.col("doc_id") + 10_000).union(docs.limit(1).select(F.lit(20_000).cast("long"), F.lit(None).cast("string"), "lang", F.lit(None).cast("string"), "n_chars"))
    docs, seen = docs.union(more).withColumn("size", F.lit("x")), []
    # Names that the stages use themselves, or that need quoting.
    for name in ("node", "_kept", "_quality", "_predicted", "_spans", "_node", "_of", "_mix_size", "_mix_copy", "_other_0", "component", "a.b"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        docs.write.parquet(path)
        seen.append(spark.read.parquet(path))
        docs = stage(spark, seen[-1], SF)
    return [*seen, docs.cache()]


def test_names_and_columns(stages):
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "mixing", "encoding"]
    assert all(frame.columns == stages[0].columns for frame in stages[:-1])


def test_quality_rejects_what_its_model_rejects(spark, stages):
    before, after = stages[0], {r.doc_id for r in stages[1].collect()}
    plain = before.select("doc_id", "text")
    model = quality.quality_model(plain, table(spark, SF, "labels"), fold("doc_id", 5) != 0)
    assert after == {r.doc_id for r in quality.score(plain, model).collect() if r._quality >= 0.3}
    assert 0 < len(after) < before.count()


def test_one_of_each_group_stays(stages):
    before = sorted((r.doc_id, r.text) for r in stages[1].collect())
    found = components([t for _, t in before])
    assert sorted(r.doc_id for r in stages[2].collect()) == [before[i][0] for i, (_, c) in found.items() if c == i]


def test_repeats_are_cut(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    removed = dict(zip(before, repeated(list(before.values()), 200)))
    after = {r.doc_id: r for r in stages[3].collect()}
    assert set(after) == set(before)
    for doc_id, text in before.items():
        left = after[doc_id].text
        assert len((left or "").encode()) <= removed[doc_id][0] - removed[doc_id][1] and after[doc_id].n_chars == (None if left is None else len(left))
        assert removed[doc_id][1] or left == text


def test_mixture(stages):
    plan = {r.doc_id: r for r in mixing.mixing_plan(stages[3]).collect()}
    rows, words = Counter(), Counter()
    for r in stages[4].collect():
        rows[r.doc_id] += 1
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert all(words[i] == r.taken and rows[i] == r.whole + (r.part > 0) for i, r in plan.items())


def test_encoding(stages):
    machine = bpe.Transducer(bpe.vocabulary("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=machine.ranks, special_tokens={})
    expected = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in stages[4].collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in stages[5].collect()) == expected


def test_run(spark, stages):
    got = pipeline.run(spark, SF)
    assert got.columns == stages[-1].columns and got.count() > 0


def test_no_rows(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def workers_of_a_task(plan: str) -> int:
    """The most Python operators that one task of a physical plan runs, each of which has a worker of its own."""
    above, most = [], 0
    for line in plan.splitlines():
        node = line.lstrip(" :+-")
        depth = len(line) - len(node)
        above = [x for x in above if x[0] < depth]
        n = 0 if "Exchange" in node.split(" ")[0] else (above[-1][1] if above else 0) + ("MapInArrow" in node)
        above.append((depth, n))
        most = max(most, n)
    return most


def test_a_task_has_one_python_worker(spark, stages, monkeypatch):
    kind, seen = type(stages[0]), []
    plain = kind.mapInArrow

    def watched(self, *args, **named):
        out = plain(self, *args, **named)
        seen.append(workers_of_a_task(out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(kind, "mapInArrow", watched)
    for (_, stage), docs in zip(pipeline.STAGES, stages):
        stage(spark, docs, SF)
    assert len(seen) > len(pipeline.STAGES) and set(seen) == {1}


def test_steps_of_a_worker_are_small(spark, monkeypatch):
    """What numpy holds at once over a batch of 3 MB, beside the batch itself."""
    empty = spark.createDataFrame([], "doc_id long, node long, text string")
    works = []
    monkeypatch.setattr(type(empty), "mapInArrow", lambda self, work, schema: works.append(work))
    jaccard._sets(empty)
    jaccard._signature_rows(empty, np.zeros(0, np.uint64), frozenset())
    repeats._suffixes(empty, 200, 64)
    quality.score(empty, quality.Attention().packed())
    random = np.random.default_rng(1)
    texts = ["".join(map(chr, random.choice([32, *range(97, 123)], 3000))) for _ in range(1000)]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["doc_id", "node", "text"])
    for work in works:
        tracemalloc.start()
        rows = sum(out.num_rows for out in work(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and most < 48e6
    assert len(works) == 4


def test_a_worker_gives_back_what_is_free(spark, stages, monkeypatch):
    def held():
        with open("/proc/self/smaps_rollup") as file:
            return sum(int(line.split()[1]) for line in file if line.startswith("Anonymous:")) / 1000

    pins = []

    def work(batches):
        blocks = [bytearray(2000) for _ in range(100_000)]
        pins.append(bytearray(2000))  # behind all of them
        yield len(blocks)

    before = held()
    assert list(tidy(work)(iter([]))) == [100_000]
    assert held() - before < 50

    # Every Python operator of the pipeline is such a one.
    kind, seen = type(stages[0]), []
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, work, schema: seen.append(work.__qualname__) or plain(self, work, schema))
    for (_, stage), docs in zip(pipeline.STAGES, stages):
        stage(spark, docs, SF)
    assert len(seen) > len(pipeline.STAGES) and set(seen) == {tidy(work).__qualname__}
