"""Helpers that several operators share: folds, written intermediate tables, and words as arrays of numbers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelltrail.session import Folder, scratch_path

#: Bytes of text that one numpy step looks at; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: The same in the operators of the pipeline: a step holds some ten numbers a byte, beside an executor that is full.
FEWER_BYTES = 1 << 18

SPACES = b" \t\n\x0b\x0c\r"

#: Rows of a record batch, which JVM and worker hold at the same time. Texts are large, so fewer than Spark's own number.
BATCH_ROWS = 4000


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` on record batches in a worker that gives back what is free: before, what tables of an earlier stage took, and
    after, what `work` has used. An executor's workers live on, and what they keep is missing in the stages that follow.
    """

    def run(batches):
        given_back()
        try:
            yield from work(batches)
        finally:
            given_back()

    return run


def given_back() -> None:
    """Free memory of this process goes back to the machine: Arrow's, and where the C library can do it that of all else."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: Tables written inside each `settled` that runs, innermost last.
_WRITTEN: list[list[str]] = []


def written(frame: DataFrame, label: str) -> DataFrame:
    """`frame` as a table in the shared folder: cuts the lineage, survives lost executors, is worked out once.

    What executors still hold of the shuffles behind it is not needed any more. Spark removes it when the driver's collector
    has found the finished plans, which may take half an hour by itself.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    frame.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(frame.schema).parquet(path)


def settled(spark: SparkSession, label: str, work: Callable[[], DataFrame]) -> DataFrame:
    """What `work` gives, as a written table; the tables that were written on the way to it are removed."""
    _WRITTEN.append([])
    try:
        frame = work()
        path = scratch_path(spark, label)
        frame.write.parquet(path)
        spark.sparkContext._jvm.System.gc()
    finally:
        for old in _WRITTEN.pop():
            Folder(spark, old).delete()
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return spark.read.schema(frame.schema).parquet(path)


def leaves_no_tables(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on a DataFrame, its first argument, whose result is settled."""

    @functools.wraps(operator)
    def settling(docs: DataFrame, *args, **named) -> DataFrame:
        return settled(docs.sparkSession, operator.__name__.replace("_", "-"), lambda: operator(docs, *args, **named))

    return settling


def shielded(docs: DataFrame, names: Iterable[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`work` on `docs`, of which it may use the columns `names`: all others go by names that clash with nothing, and get
    theirs back after."""
    inner = {c: c if c in names else f"_other_{i}" for i, c in enumerate(docs.columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    out = work(docs.select(*[quoted(c).alias(name) for c, name in inner.items()]))
    return out.select(*[F.col(name).alias(c) for c, name in inner.items()])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held, offsets


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts together stay within `limit` bytes."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def text_steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) for each step over a column of texts."""
    data, offsets = text_bytes(column)
    for first, last in steps(offsets, limit):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of substrings from one pass of prefix sums modulo 2**64; equal bytes have equal hashes anywhere."""

    def __init__(self, seed: int = 1, longest: int = STEP_BYTES):
        random = np.random.default_rng(seed)
        self.byte = random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(random.integers(0, 1 << 60)) * 8 + 3
        self.reach(longest)

    def reach(self, n: int) -> None:
        powers = np.full(n + 1, self.base, np.uint64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        inverse = np.full(n + 1, pow(self.base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.powers):
            self.reach(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.powers[: len(data)], out=sums[1:])
        return sums

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.inverse[start])


def word_bytes(separators: Iterable[int] = SPACES) -> np.ndarray:
    """Which bytes belong to words."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_places(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; no word crosses from one text into the next."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = inside[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | border[1:n]
    ends[:-1] &= ~word[1:] | border[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


MULTIPLIERS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def runs_of_words(words: np.ndarray, row: np.ndarray, places: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at `places` after each word, with their rows: (0, 1) are pairs, (0, 2) pairs with a gap."""
    reach = places[-1]
    if len(words) <= reach:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - reach
    total = np.full(n, np.uint64(sum(1 << p for p in places)), np.uint64)
    for p in places:
        total = total + words[p : p + n] * MULTIPLIERS[p]
    same = row[:n] == row[reach:]
    return mixed(total[same]), row[:n][same]
