"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes."""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelltrail.llm.common import FEWER_BYTES, Hasher, leaves_no_tables, mixed, shielded, text_steps, tidy, written

#: Bytes of a repeated string, and of the q-grams that make the initial buckets.
LENGTH, GRAM = 200, 64
#: Members of a bucket whose strings one task compares at once; the strings of larger buckets
#: are dealt by their hash.
BLOCK = 1 << 14
SUFFIX = ["bucket", "refined", "node", "start", "lead", "size"]
#: What is asked about: bytes around a suffix, a string of a large bucket, or a span that is settled.
ASKED = ["kind", "bucket", "node", "start", "stop", "lead", "open", "context"]
CONTEXT, STRING, SPAN = 0, 1, 2
#: Members of large buckets whose equal strings combine before they travel.
COMBINED = 1 << 12
SEED = 41


def sampled_suffixes(prefix: np.ndarray, offsets: np.ndarray, hasher: Hasher, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a step whose q-gram has the least hash of some string of `length` bytes, the leftmost of equals, and
    the hashes. The choice depends on the string alone, so equal strings choose the same offset."""
    n = int(offsets[-1])
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    grams = hasher.between(prefix, at, at + gram)
    low = np.uint64(max(21, n.bit_length()))
    least = ((grams >> low) << low) | at.astype(np.uint64)
    width, reach = length - gram + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: reach - width], least[width - reach :])
    inside = np.ones(len(least), bool)
    for end in offsets[1:-1]:
        inside[max(0, end - length + 1) : end] = False
    least = least[inside]
    chosen = least[np.flatnonzero(np.diff(least, prepend=np.uint64(1 << 63)))] & ((np.uint64(1) << low) - np.uint64(1))
    chosen = np.unique(chosen.astype(np.int64))
    return chosen, grams[chosen]


def surroundings(chosen: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of all bytes that strings of `length` bytes around each chosen q-gram can cover."""
    row = np.searchsorted(offsets, chosen, "right") - 1
    return row, np.maximum(offsets[row], chosen - (length - gram)), np.minimum(offsets[row + 1], chosen + length)


def _suffixes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """bucket, refined, node, start, lead, size per sampled suffix, at most two of a refined bucket per batch, so that
    copies combine before they travel. The others of a batch repeat those two and need no more than their span: they
    have null for bucket, refined and lead, and are joined where they touch. Both kinds come from one look at a batch
    and have to be written before they part, as a second look may find the rows in other batches.

    `bucket` is the q-gram. `refined` is the string of all that can be covered around it, left and right of it.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int32())

    def sample(batches):
        hasher = Hasher(SEED, FEWER_BYTES)
        for batch in batches:
            found, nodes = [], batch.column("node").to_numpy()
            for first, _, data, offsets in text_steps(batch.column("text"), FEWER_BYTES):
                prefix = hasher.prefix(data)
                chosen, bucket = sampled_suffixes(prefix, offsets, hasher, length, gram)
                row, begin, end = surroundings(chosen, offsets, length, gram)
                around = hasher.between(prefix, begin, end)
                left, right = (chosen - begin).astype(np.uint64), (end - chosen).astype(np.uint64)
                refined = mixed(around ^ (left << np.uint64(32)) ^ right)
                found.append((bucket, refined, nodes[first + row], begin - offsets[row], chosen - begin, end - begin))
            if not found:
                continue
            bucket, refined, node, begin, left, size = (np.concatenate(c) for c in zip(*found))
            key = bucket ^ mixed(refined)
            order = np.argsort(key, kind="stable")
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[order[1:]] == key[order[:-1]]
            twice = np.zeros(len(key), bool)
            twice[2:] = same[1:-2] & same[2:-1] if len(key) > 2 else False
            keep, rest = np.sort(order[~twice]), np.sort(order[twice])
            columns = [bucket[keep].view(np.int64), refined[keep].view(np.int64), node[keep], begin[keep], left[keep], size[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], names=SUFFIX)
            if len(rest):
                # Spans of a document stand in order here: those that touch are joined before they travel.
                node, begin, end = node[rest], begin[rest], (begin + size)[rest]
                heads = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (begin[1:] > end[:-1]) | (begin[1:] < begin[:-1])))
                none, start = [None] * len(heads), begin[heads]
                columns = [none, none, node[heads], start, none, end[np.append(heads[1:], len(rest)) - 1] - start]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=SUFFIX)

    return docs.select("node", "text").mapInArrow(tidy(sample), "bucket long, refined long, node long, start int, lead short, size int")


def _neighbours(batches):
    """Over rows sorted by (bucket, refined): those whose bucket has another row, with `whole` true if that holds for the
    refined bucket too, and `ask` true for the rows that have to be compared further: those alone in their refined bucket,
    and where two refined buckets meet a member of each. Only the next row is looked at, so a bucket may have any size."""
    held = None

    def judged(rows: pa.Table, last: bool):
        bucket, refined = rows.column("bucket").to_numpy(), rows.column("refined").to_numpy()
        same_bucket, same = np.zeros(len(bucket) + 1, bool), np.zeros(len(bucket) + 1, bool)
        same_bucket[1:-1] = bucket[1:] == bucket[:-1]
        same[1:-1] = same_bucket[1:-1] & (refined[1:] == refined[:-1])
        whole = same[1:] | same[:-1]
        meets = (same_bucket & ~same)[1:] | (same_bucket & ~same)[:-1]
        keep = whole | meets
        # The first row was judged with the batch before, the last one will be with the next.
        keep[0] &= first
        keep[-1] &= last
        out = rows.filter(pa.array(keep)).select(SUFFIX)
        return out.append_column("whole", pa.array(whole[keep])).append_column("ask", pa.array(meets[keep]))

    # Each batch is judged with the last two rows before it: one to be judged now, one that it is compared with.
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rows = table if held is None else pa.concat_tables([held, table])
        if rows.num_rows >= 2:
            yield from judged(rows, False).to_batches()
            first = False
            held = rows.slice(rows.num_rows - 2)
        else:
            held = rows
    if held is not None:
        yield from judged(held, True).to_batches()


def _asked(asked: DataFrame, docs: DataFrame, length: int, gram: int) -> DataFrame:
    """kind, bucket, node, start, stop, lead, open, context: for an asked suffix the bytes around it, or if its bucket is
    `large` a narrow row for each string around it, whose `bucket` is the string's own hash; `open` if it still needs
    another of its kind. Equal strings combine before they travel: a block of members sends one of each, and those it has
    twice are settled by that and sent as spans.

    Rows of `docs` that repeat in a batch bring theirs once: they only bear witness, as copies of a row have nothing
    open. Rows of a node are alike and stand in order of the node, with what is asked in order, so a task that runs again
    makes the same blocks.
    """
    names = ("bucket", "start", "lead", "size", "whole", "large")
    lists = asked.groupBy("node").agg(F.array_sort(F.collect_set(F.struct(*names))).alias("asked"))
    kinds = (pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.bool_(), pa.binary())

    def cut(batches):
        last, hasher = None, Hasher(SEED, FEWER_BYTES)
        for batch in batches:
            if not batch.num_rows:
                continue
            few, many, nodes = [], [], batch.column("node").to_numpy()
            new = np.append(nodes[0] != last, nodes[1:] != nodes[:-1])
            last = nodes[-1]
            for i in np.flatnonzero(new):
                node, data, wanted = int(nodes[i]), batch.column("text")[i].as_py().encode(), batch.column("asked")[i]
                for bucket, start, lead, size, whole, large in zip(*(wanted.values.field(c).to_pylist() for c in names)):
                    (many if large else few).append((CONTEXT, bucket, node, start, None, lead, not whole, data[start : start + size]))
                    if len(few) == COMBINED:
                        yield of(zip(*few))
                        few = []
                    if len(many) == COMBINED:
                        yield from strings(of(zip(*many)), hasher)
                        many = []
            if few:
                yield of(zip(*few))
            if many:
                yield from strings(of(zip(*many)), hasher)

    def of(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=ASKED)

    def strings(batch: pa.RecordBatch, hasher: Hasher):
        table = pa.Table.from_batches([batch])
        keys, members = string_keys(table, hasher, length, gram), _members(table)
        node, start, stop = _repeated(keys, members, length)
        none = [None] * len(node)
        yield of((np.full(len(node), SPAN), node, node, start, stop, none, none, none))
        node, start, lead, open_ = members
        key, first, counts = np.unique(keys, return_index=True, return_counts=True)
        key, first, counts = key[key > 0], first[key > 0], counts[key > 0]
        member, offset = np.divmod(first, keys.shape[1])
        begin, none = (start + lead)[member].astype(np.int64) - offset, [None] * len(key)
        yield of((np.full(len(key), STRING), key.view(np.int64), node[member], begin, none, none, open_[member] & (counts == 1), none))

    schema = "kind byte, bucket long, node long, start int, stop int, lead short, open boolean, context binary"
    rows = docs.join(lists, "node").select("node", "text", "asked").sortWithinPartitions("node")
    return rows.mapInArrow(tidy(cut), schema)


def string_keys(rows: pa.Table, hasher: Hasher, length: int, gram: int) -> np.ndarray:
    """(member, offset) hash of bucket, offset and the string that begins `offset` bytes before the q-gram, 0 where there
    is none."""
    width = length - gram + 1
    data = rows.column("context").combine_chunks()
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    places = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    held = np.frombuffer(data.buffers()[2], np.uint8)[places[0] : places[-1]] if places[-1] else np.zeros(0, np.uint8)
    places -= places[0]
    prefix = hasher.prefix(held)
    begin = (places[:-1] + rows.column("lead").to_numpy())[:, None] - np.arange(width)
    good = (begin >= places[:-1, None]) & (begin + length <= places[1:, None])
    begin = np.where(good, begin, 0)
    out = np.zeros(begin.shape, np.uint64)
    out[good] = hasher.between(prefix, begin[good], begin[good] + length)
    key = mixed(rows.column("bucket").to_numpy().view(np.uint64))[:, None] + np.arange(1, width + 1, dtype=np.uint64)
    return np.where(good, mixed(out ^ mixed(key)) | np.uint64(1), np.uint64(0))


def _members(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """node, start, lead and open of contexts."""
    return *(rows.column(c).to_numpy() for c in ("node", "start", "lead")), rows.column("open").to_numpy().astype(bool)


def _repeated(keys: np.ndarray, members: tuple, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, start, stop of the strings that occur again among `keys`, for members that are open."""
    node, start, lead, open_ = members
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = (counts[inverse].reshape(keys.shape) > 1) & (keys > 0) & open_[:, None]
    member, offset = np.nonzero(again)
    begin = (start + lead)[member].astype(np.int64) - offset
    # Strings of one member that begin next to each other are one span; offsets count backwards.
    head = np.ones(len(member), bool)
    head[1:] = (member[1:] != member[:-1]) | (begin[:-1] != begin[1:] + 1)
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(member)) - 1 if len(heads) else heads
    return node[member[heads]], begin[tails], begin[heads] + length


def _refined(length: int, gram: int):
    """mapInArrow over contexts sorted by bucket: spans (node, start, stop) of the strings of `length` bytes that occur in
    another member of the bucket, string by string. Holds one bucket at a time, so for buckets of bounded size."""

    def refine(batches):
        hasher = Hasher(SEED, FEWER_BYTES)
        keys, rows, last = [], [], None

        def spans() -> pa.RecordBatch:
            found = _repeated(np.concatenate(keys), tuple(np.concatenate(c) for c in zip(*rows)), length)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["node", "start", "stop"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for low in range(0, table.num_rows, 1024):
                some = table.slice(low, 1024)
                found, values, bucket = string_keys(some, hasher, length, gram), _members(some), some.column("bucket").to_numpy()
                changes = np.flatnonzero(np.diff(bucket)) + 1
                if last is not None and bucket[0] != last:
                    changes = np.append(0, changes)
                if len(changes):
                    # All before the last change are whole buckets.
                    cut = int(changes[-1])
                    if cut or keys:
                        keys.append(found[:cut])
                        rows.append(tuple(v[:cut] for v in values))
                        yield spans()
                    keys, rows = [found[cut:]], [tuple(v[cut:] for v in values)]
                else:
                    keys.append(found)
                    rows.append(values)
                last = bucket[-1]
        if keys:
            yield spans()

    return refine


def _met(length: int):
    """mapInArrow over strings sorted by their hash: spans (node, start, stop) of the open ones that have another of it.
    Only the next row is looked at, so there may be any number of equal ones."""

    def spans(rows: pa.Table, first: bool, last: bool) -> pa.RecordBatch:
        same = _beside(rows.column("bucket").to_numpy())
        # The first row was judged with the batch before, the last one will be with the next.
        same[0] &= first
        same[-1] &= last
        same &= rows.column("open").to_numpy().astype(bool)
        start = rows.column("start").to_numpy()[same].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows.column("node").to_numpy()[same]), pa.array(start), pa.array(start + length)], names=["node", "start", "stop"])

    def meet(batches):
        # Each batch is judged with the last two rows before it: one to be judged now, one that it is compared with.
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch.select(["bucket", "node", "start", "open"])])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows >= 2:
                yield spans(held, first, False)
                first, held = False, held.slice(held.num_rows - 2)
        if held is not None:
            yield spans(held, first, True)

    return meet


def _beside(key: np.ndarray) -> np.ndarray:
    """Which of sorted keys have an equal next to them."""
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    return same[1:] | same[:-1]


def _judged(length: int, gram: int):
    """mapInArrow over rows of `_asked` sorted by kind and bucket: spans (node, start, stop)."""
    judges = {CONTEXT: _refined(length, gram), STRING: _met(length)}

    def pieces(batches):
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)]])
            yield from ((int(kinds[a]), batch.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:]) if b > a)

    def judge(batches):
        for kind, run in groupby(pieces(batches), lambda piece: piece[0]):
            if kind in judges:
                yield from judges[kind](piece for _, piece in run)
            else:
                for _, piece in run:
                    columns = [piece.column("node"), piece.column("start").cast(pa.int64()), piece.column("stop").cast(pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "start", "stop"])

    return judge


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """node, start, stop (in bytes) of spans that together cover exactly the bytes of strings of `length` bytes that also
    start anywhere else. `docs` has node and text (not null); rows of the same node have the same text.

    Suffixes are sampled: of every string of `length` bytes the q-gram of least hash is taken, about 2 of (length - q).
    The initial buckets are the q-grams. A bucket with one member is done: no string around it occurs twice. The others
    are refined by what stands at the offsets before and behind. First by all of it at once: members that still share
    their bucket repeat every string around the q-gram. Those left alone, and one or two members of each refined bucket
    that meets another, are refined by each offset on its own, from bytes brought for them only. A bucket of up to BLOCK
    such members is refined by one task; of a larger one the strings are dealt by their hash, a narrow row each.
    """
    sampled = written(_suffixes(docs, length, gram), "sampled-suffixes")
    met = sampled.filter("bucket is not null").repartition("bucket").sortWithinPartitions("bucket", "refined")
    schema = "bucket long, refined long, node long, start int, lead short, size int, whole boolean, ask boolean"
    shared = written(met.mapInArrow(tidy(_neighbours), schema), "shared-suffixes")
    span = ("node", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("size")).cast("long").alias("stop"))
    whole = shared.filter("whole").select(*span).union(sampled.filter("bucket is null").select(*span))
    asked = shared.filter("ask")
    # How many large buckets there are grows with the corpus, so Spark chooses the join.
    large = written(asked.groupBy("bucket").count().filter(F.col("count") > BLOCK).select("bucket"), "large-buckets")
    asked = asked.join(large.withColumn("large", F.lit(True)), "bucket", "left").fillna(False, ["large"])
    ready = _asked(asked, docs, length, gram).repartition("bucket").sortWithinPartitions("kind", "bucket")
    found = ready.mapInArrow(tidy(_judged(length, gram)), "node long, start long, stop long")
    return whole.union(found)


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    heads = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return list(zip(starts[heads].tolist(), reach[np.append(heads[1:], len(starts)) - 1].tolist()))


def with_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows of `docs` (doc_id, text, others with no clashing names, see `shielded`) with `_spans`: what of the text's UTF-8 bytes is to be removed.

    A row is named by 64 bits of its id and text. So rows may repeat, each is then a copy of the other, and ids may
    repeat or be null. Null texts are empty. Texts shorter than `length` lose nothing.
    """
    node = F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))
    spans = repeated_spans(docs.select(node.alias("node"), F.coalesce("text", F.lit("")).alias("text")), length, gram)
    lists = spans.groupBy(F.col("node").alias("_of")).agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    return docs.withColumn("_node", node).join(lists, F.col("_node") == F.col("_of"), "left").select(*docs.columns, "_spans")


def cut_out(text: str | None, spans: pa.Scalar) -> tuple[bytes, bytes, int]:
    """The text's bytes, those left, and the number of removed runs."""
    data = (text or "").encode()
    if not spans.is_valid or not len(spans.values):
        return data, data, 0
    runs = merged(spans.values.field("start").to_numpy(), spans.values.field("stop").to_numpy())
    kept, at = [], 0
    for start, stop in runs:
        kept.append(data[at:start])
        at = stop
    return data, b"".join([*kept, data[at:]]), len(runs)


@leaves_no_tables
def repeat_digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of `docs`."""

    def digest(batches):
        for batch in batches:
            rows = [cut_out(text.as_py(), spans) for text, spans in zip(batch.column("text"), batch.column("_spans"))]
            sizes = [len(data) for data, _, _ in rows]
            columns = [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array([n - len(kept) for n, (_, kept, _) in zip(sizes, rows)], pa.int64()),
                pa.array([runs for _, _, runs in rows], pa.int64()),
                pa.array([hashlib.sha256(kept).hexdigest() for _, kept, _ in rows], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_spans(docs.select("doc_id", "text"), length, gram)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(digest), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows of `docs` with the repeated bytes cut out of `text`. Bytes of a character that a cut has split are left
    out as well; a null text stays null."""

    def cut(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text"), batch.column("_spans")):
                _, kept, runs = cut_out(text.as_py(), spans)
                texts.append(kept.decode(errors="ignore") if runs else text.as_py())
            names = [n for n in batch.schema.names if n != "_spans"]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    return shielded(docs, ("doc_id", "text"), lambda inner: with_spans(inner, length, gram).mapInArrow(tidy(cut), inner.schema))
