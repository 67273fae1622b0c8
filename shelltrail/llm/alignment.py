"""Alignment of two tokenizers over a corpus, with a fast path for tokens that both of them have.

Where a token of A and a token of B both end, the bytes are cut into groups. Most groups are one token of each with the
same bytes; an array made beforehand says which id of B has the bytes of an id of A, so such a group is one number, and the
corpus counts them in a vector as long as A's vocabulary. Only the pairs of other groups are shuffled.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelltrail.llm.common import leaves_no_tables, written

#: Segments a worker remembers (the older half goes when they are too many; 450 bytes each), and the longest in characters.
MOST_SEGMENTS = 320_000
LONGEST_SEGMENT = 40
#: Unknown segments that are read in one go, and the first character that only A's own library may classify.
ROW_SEGMENTS = 2048
QUICK_BELOW = "\u0250"
#: Characters of text whose segments are looked at in one go, and of a long text the segments in one go.
STEP_CHARS = 1 << 20
AT_ONCE = 1 << 14
#: Array entries after which a record batch goes out.
ENTRIES_OUT = 1 << 17
#: Pairs looked up without a shuffle, the most frequent ones. Of what is left no pair has more than 1 / HOT of all links.
HOT = 1 << 17

#: A segment begins with a space after something that is no white space. Neither tokenizer has a token across that border.
SEGMENTS = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
#: A pair as one number.
SHIFT = 32


def tokenizer_file(name_or_path: str) -> bytes:
    """The content of a file of the installed public tokenizers by name, or of any by path."""
    if os.sep not in name_or_path:
        import public_tokenizers

        name_or_path = public_tokenizers.path(name_or_path)
    with open(name_or_path, "rb") as file:
        return file.read()


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as letters from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class Pair:
    """The two tokenizers, the bytes of their entries, and which id of B has the bytes of an id of A (-1: none)."""

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first, self.second = Tokenizer.from_buffer(first), sentencepiece.SentencePieceProcessor(model_proto=second)
        self.first.encode_special_tokens = True
        letters, special = byte_of_letter(), self.first.get_added_tokens_decoder()
        self.a_bytes: list[bytes] = [b""] * (max(self.first.get_vocab().values()) + 1)
        for entry, i in self.first.get_vocab().items():
            self.a_bytes[i] = entry.encode() if i in special else bytes(letters[c] for c in entry)
        model, ids = self.second, range(self.second.get_piece_size())
        self.b_bytes = [self._piece_bytes(model, i) for i in ids]
        self.lone_space = model.piece_to_id("▁")
        places: dict[bytes, int] = {}
        for i in sorted(ids, key=model.is_byte):  # a piece comes before a byte that says the same
            if self.b_bytes[i]:
                places.setdefault(self.b_bytes[i], i)
        self.quick = self._ranked(first, letters)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.words = self._words()
        self.identity = np.array([places.get(data, -1) if i not in special else -1 for i, data in enumerate(self.a_bytes)], np.int64)

    @staticmethod
    def _piece_bytes(model, i: int) -> bytes:
        if model.is_byte(i):
            return bytes((int(model.id_to_piece(i)[1:-1], 16),))
        return b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace("▁", " ").encode()

    def _ranked(self, first: bytes, letters: dict[str, int]):
        """A as ranks, where its merges stand in the order of their ids and it splits texts by the public pattern; else None.
        The same ids, for texts of letters on whose classes all libraries agree, in less time."""
        import public_tokenizers
        import tiktoken

        whole = json.loads(first)
        model, splits = whole["model"], whole["pre_tokenizer"] or {}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        single = [i for entry, i in model["vocab"].items() if len(entry) == 1]
        plain = splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space") and not whole["normalizer"]
        if not plain or model.get("ignore_merges") or merged != sorted(set(merged)) or sorted(single) != list(range(256)) or merged[0] < 256:
            return None
        made = {*single, *merged}
        ranks = {bytes(letters[c] for c in entry): i for entry, i in model["vocab"].items() if i in made}
        return tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of segments, each of which begins with a space: A reads it whole, B adds the space itself."""
        a = [found.ids for found in self.first.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.second.encode([segment[1:] for segment in segments], num_threads=1)
        return [(x, y if segment != " " else [self.lone_space]) for segment, x, y in zip(segments, a, b)]

    def _words(self) -> list[str]:
        """An id and what follows it: of A a comma or, as a group's last, a bar; of B a comma, a semicolon, or a line's end."""
        ends = [(self.a_bytes, ","), (self.a_bytes, "|"), (self.b_bytes, ","), (self.b_bytes, ";"), (self.b_bytes, "\n")]
        self.follow = np.cumsum([0, *(len(side) for side, _ in ends)])
        return [f"{i}{end}" for side, end in ends for i in range(len(side))]

    def aligned(self, segments: list[str]) -> list[tuple | None]:
        """What `align` gives for each segment. Segments are read in rows of them, as one text each; one that ends in white
        space, or whose row does not have its bytes, is read by itself."""
        out: dict[str, tuple | None] = {}
        alone = [segment for segment in segments if segment[-1].isspace() or len(segment) > LONGEST_SEGMENT]
        joined = [segment for segment in segments if not (segment[-1].isspace() or len(segment) > LONGEST_SEGMENT)]
        quick = [segment for segment in joined if max(segment) < QUICK_BELOW] if self.quick else []
        slow = [segment for segment in joined if max(segment) >= QUICK_BELOW] if self.quick else joined
        for some, encode in ((quick, self._quick_ids), (slow, self._ids)):
            for low in range(0, len(some), ROW_SEGMENTS):
                row = some[low : low + ROW_SEGMENTS]
                found = self._aligned_row(row, encode)
                if found is None:
                    alone += row
                else:
                    out.update(zip(row, found))
        for segment, (a, b) in zip(alone, self.encode(alone) if alone else ()):
            out[segment] = self.align(segment, a, b)
        return [out[segment] for segment in segments]

    def _ids(self, text: str) -> list[int]:
        return self.first.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _quick_ids(self, text: str) -> list[int]:
        return self.quick.encode_ordinary(text)

    def _aligned_row(self, segments: list[str], encode) -> list[tuple] | None:
        text = "".join(segments)
        data = text.encode()
        a, b = encode(text), self.second.encode(text[1:])
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        ends = ends[np.append(True, ends[1:] != ends[:-1])]
        a_of, b_of = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        cut = (a_ends[a_of] == ends) & (b_ends[b_of] == ends)
        group_ends = ends[cut]
        stops = np.cumsum([len(segment.encode()) for segment in segments])
        last = np.searchsorted(group_ends, stops)  # the last group of each segment
        if (group_ends[last] != stops).any():
            return None
        group = np.searchsorted(group_ends, ends)
        linked_a, linked_b = a[a_of], b[b_of]
        regular = (np.bincount(group)[group] == 1) & (self.identity[linked_a] == linked_b)
        segment = np.searchsorted(last, group)

        n = len(segments)
        a_group, b_group = np.searchsorted(group_ends, a_ends), np.searchsorted(group_ends, b_ends)
        a_final, b_final = (np.append(x[1:] != x[:-1], True) for x in (a_group, b_group))
        closes = np.zeros(len(group_ends), bool)
        closes[last] = True
        codes = np.concatenate([a + self.follow[a_final.astype(int)], b + self.follow[2 + b_final + (b_final & closes[b_group])]])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        lines = "".join(map(self.words.__getitem__, codes[order].tolist())).split("\n")
        counts = [np.bincount(np.searchsorted(last, x), minlength=n).tolist() for x in (a_group, b_group, np.arange(len(group_ends)), group)]
        sides = []
        for values, mask in ((linked_a, regular), (linked_a << SHIFT | linked_b, ~regular)):
            places = np.append(0, np.cumsum(np.bincount(segment[mask], minlength=n))).tolist()
            flat = values[mask].tolist()
            sides.append([tuple(flat[i:j]) for i, j in zip(places, places[1:])])
        return list(zip(*counts, lines, *sides))

    def align(self, segment: str, a: list[int], b: list[int]) -> tuple | None:
        """(tokens of A, of B, groups, links, groups as text, ids of A in one-to-one groups, other pairs), or None if the
        tokens do not have the segment's bytes."""
        a_bytes, b_bytes, identity, data = self.a_bytes, self.b_bytes, self.identity, segment.encode()
        if b"".join([a_bytes[i] for i in a]) != data or b"".join([b_bytes[i] for i in b]) != data:
            return None
        groups, regular, pairs, links = [], [], [], 0
        i = j = begun_a = begun_b = 0
        end_a, end_b = len(a_bytes[a[0]]), len(b_bytes[b[0]])
        while True:
            links += 1
            if end_a == end_b:
                if i == begun_a and j == begun_b and identity[a[i]] == b[j]:
                    regular.append(a[i])
                    groups.append(f"{a[i]}|{b[j]}")
                else:
                    pairs.append(a[i] << SHIFT | b[j])
                    groups.append(",".join(map(str, a[begun_a : i + 1])) + "|" + ",".join(map(str, b[begun_b : j + 1])))
                i, j = i + 1, j + 1
                if i == len(a):
                    return len(a), len(b), len(groups), links, ";".join(groups), tuple(regular), tuple(pairs)
                begun_a, begun_b = i, j
                end_a += len(a_bytes[a[i]])
                end_b += len(b_bytes[b[j]])
            else:
                pairs.append(a[i] << SHIFT | b[j])
                if end_a < end_b:
                    i += 1
                    end_a += len(a_bytes[a[i]])
                else:
                    j += 1
                    end_b += len(b_bytes[b[j]])


class Aligner:
    """Aligned segments, from memory where they were seen before."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def segments(self, found: list[str]) -> dict[str, tuple | None]:
        """Every segment of `found` with what `Pair.align` gives for it."""
        known, before = self.known, self.before
        out, missing = {}, []
        for segment in set(found):
            if segment in known:
                out[segment] = known[segment]
            elif segment in before:
                out[segment] = known[segment] = before[segment]
            else:
                missing.append(segment)
        for segment, aligned in zip(missing, self.pair.aligned(missing)):
            out[segment] = aligned
            if len(segment) <= LONGEST_SEGMENT:
                known[segment] = aligned
        if len(known) > MOST_SEGMENTS // 2:
            self.before, self.known = known, {}
        return out


class Sums:
    """What one document comes to."""

    def __init__(self):
        self.counts, self.digest, self.semicolon, self.whole = [0, 0, 0, 0], hashlib.sha256(), "", True
        self.regular: Counter = Counter()
        self.pairs: Counter = Counter()

    def add(self, aligned: list[tuple | None]) -> None:
        if None in aligned:
            self.whole = False
        if not self.whole or not aligned:
            return
        for n in range(4):
            self.counts[n] += sum([x[n] for x in aligned])
        self.digest.update((self.semicolon + ";".join([x[4] for x in aligned])).encode())
        self.semicolon = ";"
        for counter, n in ((self.regular, 5), (self.pairs, 6)):
            counter.update(itertools.chain.from_iterable([x[n] for x in aligned]))

    def row(self) -> tuple:
        if not self.whole or not self.semicolon:
            return 0, 0, 0, 0, "", {}, {}
        return (*self.counts, self.digest.hexdigest(), self.regular, self.pairs)


def text_steps(texts: pa.Array):
    """(first row, last row, segments of all rows) of runs of short texts; a long text comes alone, in parts of its segments,
    rows being its own each time."""
    first, rows, size = 0, [], 0
    for place, text in enumerate(texts):
        text = text.as_py() or ""
        if len(text) > STEP_CHARS:
            if rows:
                yield first, rows
            found = SEGMENTS.finditer(" " + text)
            while some := [match.group() for match in itertools.islice(found, AT_ONCE)]:
                yield place, [some]
            first, rows, size = place + 1, [], 0
            continue
        rows.append(SEGMENTS.findall(" " + text) if text else [])
        size += len(text)
        if size > STEP_CHARS:
            yield first, rows
            first, rows, size = place + 1, [], 0
    if rows:
        yield first, rows


def _ragged(counters: list[Counter], keys: pa.DataType) -> tuple[pa.Array, pa.Array]:
    ends = np.cumsum([0, *map(len, counters)], dtype=np.int32)
    flat = pa.array(list(itertools.chain.from_iterable(counters)), keys)
    numbers = pa.array(list(itertools.chain.from_iterable(c.values() for c in counters)), pa.int64())
    return pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, numbers)


NAMES = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a_ids", "a_counts", "pairs", "pair_counts"]
DIGEST = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
DIGEST_NAMES = NAMES[:7]


def aligned_documents(docs: DataFrame, first: bytes, second: bytes) -> DataFrame:
    """A row per row of `docs`: a number of its own, doc_id, counts, the digest of its groups, the ids of A in one-to-one
    groups with how often (`a_ids`, `a_counts`), and all other linked pairs (`pairs`, an id of A << 32 | the id of B)."""
    held = docs.sparkSession.sparkContext.broadcast({"first": first, "second": second})

    def build(batches):
        from pyspark import TaskContext

        shared = held.value
        aligner = shared.get("aligner") or shared.setdefault("aligner", Aligner(Pair(shared["first"], shared["second"])))
        number = itertools.count(TaskContext.get().partitionId() << 40)

        def out(batch, start, sums):
            rows = [s.row() for s in sums]
            columns = [pa.array(list(itertools.islice(number, len(rows))), pa.int64()), batch.column("doc_id").slice(start, len(rows))]
            columns += [pa.array([row[n] for row in rows], pa.int64()) for n in range(4)]
            columns += [pa.array([row[4] for row in rows], pa.string())]
            columns += [*_ragged([row[5] for row in rows], pa.int32()), *_ragged([row[6] for row in rows], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=NAMES)

        for batch in batches:
            sums, start, held_entries = [], 0, 0
            for place, rows in text_steps(batch.column("text")):
                known = aligner.segments(list(itertools.chain.from_iterable(rows)))
                for n, found in enumerate(rows, place - start):
                    if n == len(sums):
                        sums.append(Sums())
                    before = len(sums[n].regular) + len(sums[n].pairs)
                    sums[n].add([known[x] for x in found])
                    held_entries += len(sums[n].regular) + len(sums[n].pairs) - before
                if held_entries > ENTRIES_OUT and len(sums) > 1:  # the last may go on
                    yield out(batch, start, sums[:-1])
                    start, sums = start + len(sums) - 1, sums[-1:]
                    held_entries = len(sums[0].regular) + len(sums[0].pairs)
            if sums:
                yield out(batch, start, sums)

    schema = DIGEST + ", a_ids array<int>, a_counts array<long>, pairs array<long>, pair_counts array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, schema)


def regular_counts(aligned: DataFrame, vocabulary: int) -> DataFrame:
    """a, n: one-to-one groups of each id of A, from one vector per task."""

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            ids, numbers = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("a_ids", "a_counts"))
            np.add.at(total, ids, numbers)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], names=["a", "n"])

    return aligned.select("a_ids", "a_counts").mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def exploded(frame: DataFrame, *keep: str) -> DataFrame:
    """pair, n: a row per distinct pair of a document."""
    zipped = F.explode(F.arrays_zip("pairs", "pair_counts")).alias("z")
    return frame.filter(F.size("pairs") > 0).select(*keep, zipped).select(*keep, F.col("z.pairs").alias("pair"), F.col("z.pair_counts").alias("n"))


def pair_counts(aligned: DataFrame, identity: np.ndarray) -> DataFrame:
    """pair, n, best: how many links of the corpus hold a pair, and whether no pair of its id of B is held by more."""
    spark = aligned.sparkSession
    same = [(a, int(b)) for a, b in enumerate(identity.tolist()) if b >= 0]
    names = F.broadcast(spark.createDataFrame(same, "a long, b long"))  # at most as long as A's vocabulary
    regular = regular_counts(aligned, len(identity)).join(names, "a").select((F.shiftleft("a", SHIFT).bitwiseOR(F.col("b"))).alias("pair"), "n")
    counts = regular.union(exploded(aligned)).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1)), "pair-counts")
    most = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))  # at most as long as B's vocabulary
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


@leaves_no_tables
def tokenizer_alignment(docs: DataFrame, first: bytes, second: bytes, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a row per row of `docs`.

    A (`first`, a tokenizers file) reads a space and the text, B (`second`, a sentencepiece model) the text; special tokens
    are plain text. Two tokens are linked if their byte ranges overlap. `n_best` counts the links whose pair is linked as
    often in the corpus as any pair of its id of B, `count_sum` sums over the links how often their pair is linked.
    Texts that are null or empty, or whose tokens do not have their bytes (a U+2581), have no tokens: zeros and ''.
    Repeated rows count each for itself, null ids stay, other columns are not read.

    The text is tokenized once, into a written table of ids and counts. Vectors as long as a vocabulary and the `hot` most
    frequent pairs are broadcast; the links of rarer pairs, of which none is frequent, find their counts by a join.
    """
    spark = docs.sparkSession
    identity = Pair(first, second).identity
    aligned = written(aligned_documents(docs, first, second), "aligned")
    counts = written(pair_counts(aligned, identity), "pair-counts")
    is_regular = spark.createDataFrame([(int(a << SHIFT | b),) for a, b in enumerate(identity.tolist()) if b >= 0], "pair long")
    regular = counts.join(F.broadcast(is_regular), "pair", "left_semi").toPandas()
    frequent = counts.orderBy(F.desc("n"), "pair").limit(hot).toPandas().sort_values("pair")
    at = regular.pair.to_numpy(np.int64) >> SHIFT
    vectors = {"n": np.zeros(len(identity), np.int64), "best": np.zeros(len(identity), bool)}
    vectors["n"][at], vectors["best"][at] = regular.n, regular.best
    vectors |= {"pair": frequent.pair.to_numpy(np.int64), "pair_n": frequent.n.to_numpy(np.int64), "pair_best": frequent.best.to_numpy(bool)}
    held = spark.sparkContext.broadcast(vectors)

    def score(batches):
        v = held.value
        for batch in batches:
            rows = batch.num_rows
            lists = {c: batch.column(c) for c in ("a_ids", "pairs")}
            owner = {c: np.repeat(np.arange(rows), x.value_lengths().to_numpy()) for c, x in lists.items()}
            a, pair = (x.flatten().to_numpy(zero_copy_only=False) for x in lists.values())
            a_n, pair_n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("a_counts", "pair_counts"))
            total, best = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            np.add.at(total, owner["a_ids"], a_n * v["n"][a])
            np.add.at(best, owner["a_ids"], a_n * v["best"][a])
            place = np.minimum(np.searchsorted(v["pair"], pair), max(len(v["pair"]) - 1, 0))
            there = v["pair"][place] == pair if len(v["pair"]) else np.zeros(len(pair), bool)
            np.add.at(total, owner["pairs"][there], (pair_n * v["pair_n"][place])[there] if there.any() else 0)
            np.add.at(best, owner["pairs"][there], (pair_n * v["pair_best"][place])[there] if there.any() else 0)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner["pairs"][~there], minlength=rows))]).astype(np.int32)
            rare = [pa.ListArray.from_arrays(ends, pa.array(x[~there])) for x in (pair, pair_n)]
            columns = [*(batch.column(c) for c in DIGEST_NAMES), pa.array(best), pa.array(total), *rare]
            yield pa.RecordBatch.from_arrays(columns, names=[*DIGEST_NAMES, "n_best", "count_sum", "pairs", "pair_counts"])

    scored = written(aligned.mapInArrow(score, DIGEST + ", n_best long, count_sum long, pairs array<long>, pair_counts array<long>"), "scored")
    known = exploded(scored, "row").join(counts.withColumnRenamed("n", "count"), "pair")
    rare = known.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n"))).alias("best"), F.sum(F.col("n") * F.col("count")).alias("total"))
    out = scored.drop("pairs", "pair_counts").join(rare, "row", "left")
    n_best, count_sum = (F.col(c) + F.coalesce(more, F.lit(0)) for c, more in (("n_best", F.col("best")), ("count_sum", F.col("total"))))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", n_best.alias("n_best"), count_sum.alias("count_sum"), "groups_sha256")
