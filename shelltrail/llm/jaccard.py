"""N-gram Jaccard join by PartEnum signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelltrail.llm.common import FEWER_BYTES, LOWER, Hasher, leaves_no_tables, mixed, runs_of_words, text_steps, tidy, word_bytes, word_places, written
from shelltrail.llm.graph import components

SHINGLE = 5
#: Similarity intersection / union >= 3 / 4, in whole numbers.
OVER, UNDER = 3, 4
#: Sizes of a band go up to RATIO times its lower end; its domain has a group per GROUP elements of its largest set, and a
#: group PARTS partitions, of which signatures cover all but one.
RATIO, GROUP, PARTS = 2, 6, 3
#: Documents looked at, how many of those a shingle is in for it to be frequent, and how many frequent shingles are kept.
HOT_SAMPLE, HOT_IN, HOT_MOST = 10_000, 3, 200_000
#: Nodes and elements that stand on one side when sets are compared in blocks; a larger set is a block of its own.
BLOCK_NODES, BLOCK_ELEMENTS = 1024, 1 << 20
#: Elements of two blocks that are looked at together, columns that are multiplied at once, and how rare among the pairs of two
#: blocks those of a column are for these to be counted one by one.
TOGETHER, COLUMNS, RARE = 1 << 17, 2048, 1 / 256
#: Rows of one signature that are counted together.
RUN = 1 << 16
#: A signature that more clusters share is compared as a whole, not cluster by cluster.
MOST_CLUSTERS = 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, inside: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text in a step, as 64-bit hashes."""
    rows = len(offsets) - 1
    lowered = LOWER[data]
    starts, ends, row = word_places(lowered, offsets, inside)
    words = hasher.between(hasher.prefix(lowered), starts, ends)
    hashes, of = runs_of_words(words, row, tuple(range(SHINGLE)))
    cuts = np.searchsorted(of, np.arange(rows + 1))
    sets = [distinct(hashes[low:high]) for low, high in zip(cuts[:-1], cuts[1:])]
    counts = np.bincount(row, minlength=rows)
    for n in range(1, SHINGLE):  # a text of fewer words is one shingle
        short = np.flatnonzero(counts[row] == n)
        whole, owner = runs_of_words(words[short], row[short], tuple(range(n)))
        for element, i in zip(whole + np.uint64(n), owner):
            sets[i] = np.array([element], np.uint64)
    return sets


def distinct(hashes: np.ndarray) -> np.ndarray:
    hashes = np.sort(hashes)
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])] if len(hashes) > 1 else hashes


def set_hashes(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that are equal for equal sets."""
    one = mixed(elements + np.uint64(1)).sum(dtype=np.uint64)
    two = mixed(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def bands(sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which sets, their band, its groups, most differences) of the bands in which sets meet their partners, two at most.

    Partners have between 3/4 and 4/3 of a set's size, and two sets meet in the band of the larger one: a set's own, or the
    next. With |A| + |B| = n an intersection of at least 3 n / 7 is needed, so at most n / 7 elements are in one only.
    """
    band = np.zeros(len(sizes), np.int64)
    low = 1
    while (sizes >= low * RATIO).any():
        low *= RATIO
        band += sizes >= low
    high = np.power(RATIO, band + 1, dtype=np.int64)
    largest = sizes * UNDER // OVER
    own = np.arange(len(sizes))
    more = np.flatnonzero(largest >= high)
    groups = np.maximum(1, high // GROUP)
    return [
        (own, band, groups, (sizes + np.minimum(largest, high - 1)) // 7),
        (more, band[more] + 1, np.maximum(1, high[more] * RATIO // GROUP), (sizes[more] + largest[more]) // 7),
    ]


def enumerated(elements: np.ndarray, owner: np.ndarray, band: np.ndarray, groups: np.ndarray, most: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, their owners, which owners are safe) of sets whose elements stand together, owners in order.

    The domain is cut into groups by hash and each group into PARTS partitions. A signature is what a set has in a group
    without one of its partitions; those of nothing are left out. Two sets that differ in at most one element of a group
    agree without the partition it is in. To lose every signature of a group takes two differences, or one if the set has
    elements in one partition of it only. So a set needs the groups in order until it would take more than `most`
    differences to lose them all; of two sets, the one that needs fewer groups shares one of their signatures with the other.
    A set that runs out of groups is not safe: it may share nothing with a similar set that is not safe either.
    """
    hashed = mixed(elements + np.uint64(salt * 0x9E37))
    cell = ((hashed >> np.uint64(32)) * (groups[owner] * PARTS).astype(np.uint64)) >> np.uint64(32)
    key = (owner.astype(np.uint64) << np.uint64(40)) | cell
    order = np.argsort(key, kind="stable")
    key, hashed = key[order], hashed[order]
    safe = np.zeros(len(groups), bool)
    if not len(key):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), safe
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    values, key = np.add.reduceat(hashed, heads), key[heads]
    cell = (key & np.uint64((1 << 40) - 1)).astype(np.int64)
    group, part = np.divmod(cell, PARTS)
    holder = (key >> np.uint64(40)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (holder[1:] != holder[:-1])))
    filled = np.diff(np.append(first, len(group)))
    group, holder = group[first], holder[first]
    cost = np.minimum(filled, 2)
    reach = np.cumsum(cost)
    starts = np.searchsorted(holder, np.arange(len(groups)))
    reach -= np.append(0, reach)[starts][holder]
    safe[holder[reach > most[holder]]] = True
    taken = reach - cost <= most[holder]
    inside = np.zeros((len(first), PARTS), np.uint64)
    inside[np.repeat(np.arange(len(first)), filled), part] = values
    rest = np.add.reduceat(values, first)[:, None] - inside
    alone = (filled == 1)[:, None] & (inside != 0)
    place = (group[:, None] * PARTS + np.arange(PARTS)).astype(np.uint64) + ((band[holder].astype(np.uint64) << np.uint64(40)) + np.uint64(salt << 60))[:, None]
    there = taken[:, None] & ~alone
    return mixed(rest + mixed(place))[there], np.broadcast_to(holder[:, None], there.shape)[there], safe


def signatures(sets: list[np.ndarray], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, which set each is of): sets of similarity 3/4 or more share at least one. Sets are of distinct elements.

    Elements in `hot` are left out first: two sets differ no more in the rest of the domain. A set that is not safe without
    them is enumerated once more with all its elements, and one that is not safe then either has each element for a
    signature. So of two similar sets that share none without `hot` both are enumerated again, and so on.
    """
    found, owners = [], []
    sizes = np.array([len(x) for x in sets], np.int64)
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    at = np.minimum(np.searchsorted(hot, every), max(len(hot) - 1, 0))
    rare = hot[at] != every if len(hot) else np.ones(len(every), bool)
    of_set = np.repeat(np.arange(len(sets)), sizes)
    for which, band, groups, most in bands(sizes):
        chosen = np.flatnonzero(np.isin(of_set, which))
        if not len(chosen):
            continue
        owner = np.searchsorted(which, of_set[chosen])
        kept = rare[chosen]
        found_here, of, safe = enumerated(every[chosen[kept]], owner[kept], band, groups, most, 1)
        found.append(found_here)
        owners.append(which[of])
        again = ~safe[owner]
        found_here, of, safe_too = enumerated(every[chosen[again]], owner[again], band, groups, most, 2)
        found.append(found_here)
        owners.append(which[of])
        single = again & ~safe_too[owner]
        found.append(mixed(every[chosen[single]] + (band[owner[single]].astype(np.uint64) << np.uint64(40)) + np.uint64(3)))
        owners.append(which[owner[single]])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def sketch(elements: np.ndarray) -> bytes:
    """Whether a set has an odd number of elements in each cell; cells are low bits of the elements, two or more an element.

    Two sets differ in at least as many elements as their sketches in bits. The sketch of half as many cells is the first half
    xor the second.
    """
    cells = max(64, 1 << (2 * len(elements) - 1).bit_length())
    odd = np.bincount((elements & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def maybe_similar(sizes: list[np.ndarray], sketches: list[list[bytes]]) -> np.ndarray:
    """Which sets of one side may be similar to which of the other: all that are, and few others.

    Similar sets differ in at most a seventh of their sizes' sum. So their sketches have equal or neighbouring lengths.
    """
    n, m = sizes
    lengths = [np.array([len(x) for x in side]) for side in sketches]
    out = np.zeros((len(n), len(m)), bool)
    for length in np.unique(lengths[0]):
        one = np.flatnonzero(lengths[0] == length)
        for other in (length // 2, length, 2 * length):
            two = np.flatnonzero(lengths[1] == other)
            if not len(two):
                continue
            sides = [np.frombuffer(b"".join([side[i] for i in which]), "<u8").reshape(len(which), -1) for side, which in zip(sketches, (one, two))]
            cells = min(x.shape[1] for x in sides)
            a, b = (x if x.shape[1] == cells else x[:, :cells] ^ x[:, cells:] for x in sides)
            total = n[one][:, None] + m[two]
            apart = np.abs(n[one][:, None] - m[two])
            near = 7 * apart <= total
            if near.any():
                apart = np.zeros(near.shape, np.int64)
                for k in range(cells):
                    apart += np.bitwise_count(a[:, k, None] ^ b[:, k])
                near &= 7 * apart <= total
            out[np.ix_(one, two)] = near
    return out


def node_of(one: int, two: int, clashes: frozenset) -> int:
    """A set's name: half of its hash, or both halves where different sets share the one."""
    return one ^ two if one in clashes else one


def _sets(docs: DataFrame, elements: bool = False, clashes: frozenset = frozenset()) -> DataFrame:
    """Per document doc_id, n_shingles, h1, h2 and the sketch; with `elements` instead node, n and the elements of each
    non-empty set."""

    def build(batches):
        hasher, inside = Hasher(29, FEWER_BYTES), word_bytes()
        for batch in batches:
            ids = batch.column("doc_id")
            for first, _, data, offsets in text_steps(batch.column("text"), FEWER_BYTES):
                sets = shingle_sets(data, offsets, hasher, inside)
                hashes = [set_hashes(x) if len(x) else (0, 0) for x in sets]
                sizes = [len(x) for x in sets]
                if elements:
                    there = [i for i, n in enumerate(sizes) if n]
                    values = [pa.array([node_of(*hashes[i], clashes) for i in there], pa.int64()), pa.array([sizes[i] for i in there], pa.int64())]
                    columns = [*values, pa.array([sets[i].astype("<u8").tobytes() for i in there], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "elements"])
                else:
                    halves = [pa.array([h[k] for h in hashes], pa.int64()) for k in (0, 1)]
                    sketches = pa.array([sketch(x) if len(x) else None for x in sets], pa.binary())
                    columns = [ids.slice(first, len(sets)), pa.array(sizes, pa.int64()), *halves, sketches]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "h1", "h2", "sketch"])

    schema = "node long, n long, elements binary" if elements else "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(build), schema)


def _signature_rows(docs: DataFrame, hot: np.ndarray, clashes: frozenset) -> DataFrame:
    """signature, node: a row per signature of each set, once per equal set of a batch."""
    frequent = docs.sparkSession.sparkContext.broadcast(hot)

    def build(batches):
        hasher, inside, hot = Hasher(29, FEWER_BYTES), word_bytes(), frequent.value
        for batch in batches:
            seen: set[int] = set()
            for _, _, data, offsets in text_steps(batch.column("text"), FEWER_BYTES):
                sets, nodes = [], []
                for elements in shingle_sets(data, offsets, hasher, inside):
                    node = node_of(*set_hashes(elements), clashes) if len(elements) else None
                    if node is not None and node not in seen:
                        seen.add(node)
                        sets.append(elements)
                        nodes.append(node)
                if sets:
                    found, of = signatures(sets, hot)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.array(nodes, np.int64)[of])], names=["signature", "node"])

    return docs.select("text").mapInArrow(tidy(build), "signature long, node long")


def _shared(batches):
    """Over (signature, node) in order: signature, node, size of the signatures that different nodes have, a row per node.

    `size` counts the nodes, of very many in runs; it only tells which nodes come first.
    """

    def grouped(signature, node):
        heads = np.flatnonzero(np.append(True, signature[1:] != signature[:-1]))
        size = np.repeat(np.diff(np.append(heads, len(signature))), np.diff(np.append(heads, len(signature))))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (signature[size > 1], node[size > 1], size[size > 1])], names=["signature", "node", "size"])

    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        signature, node = (np.concatenate([old, batch.column(c).to_numpy()]) for old, c in zip(held, ("signature", "node")))
        if not len(signature):
            continue
        new = np.append(True, (signature[1:] != signature[:-1]) | (node[1:] != node[:-1]))
        signature, node = signature[new], node[new]
        # The last signature may go on; a run of RUN nodes, which are four at least, goes out but for the last two of them.
        begins = int(np.searchsorted(signature, signature[-1]))
        cut = begins if len(signature) - begins < RUN else len(signature) - 2
        yield grouped(signature[:cut], node[:cut])
        held = signature[cut:], node[cut:]
    if len(held[0]):
        yield grouped(*held)


def hot_shingles(docs: DataFrame, sample: int = HOT_SAMPLE, least: int = HOT_IN, most: int = HOT_MOST) -> np.ndarray:
    """The `most` most frequent shingles of those in at least `least` of `sample` documents, which are picked by a hash of
    the id. Results do not depend on them."""
    picked = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(31)), "doc_id").limit(sample)
    some = docs.select("doc_id", "text").join(F.broadcast(written(picked.distinct(), "hot-sample")), "doc_id")

    # Not one more Python operator over `_sets`: a task with two has two workers, which executors keep for the stages after.
    def build(batches):
        hasher, inside = Hasher(29, FEWER_BYTES), word_bytes()
        for batch in batches:
            for _, _, data, offsets in text_steps(batch.column("text"), FEWER_BYTES):
                elements = np.concatenate([*shingle_sets(data, offsets, hasher, inside), np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array(elements.view(np.int64))], names=["e"])

    every = some.select("text").mapInArrow(tidy(build), "e long")
    counts = every.groupBy("e").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "e").limit(most)
    return np.sort(counts.toPandas().e.to_numpy(np.int64).view(np.uint64))


def intersections(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of `one` has in common with each of `other`; sets are sorted, their elements hashes.

    Elements are looked at in ranges, TOGETHER at a time. A column, the sets that have an element, counts for all pairs of
    the two sides: rare columns pair by pair, the others as products of 0/1 rows.
    """
    both = np.zeros((len(one), len(other)))
    ranges = 1 + sum(len(x) for sets in (one, other) for x in sets) // TOGETHER
    edges = (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64)
    cuts = [[np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in sets] for sets in (one, other)]
    for r in range(ranges):
        sides = []
        for sets, places in zip((one, other), cuts):
            parts = [x[c[r] : c[r + 1]] for x, c in zip(sets, places)]
            values, owner = np.concatenate(parts), np.repeat(np.arange(len(sets)), [len(x) for x in parts])
            order = np.argsort(values, kind="stable")
            sides.append((values[order], owner[order]))
        common = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
        if not len(common):
            continue
        (n, a), (m, b) = (_columns(*side, common) for side in sides)
        rare = n * m <= max(1, RARE * both.size)
        column = np.flatnonzero(rare)
        if len(column):
            starts = [np.concatenate([[0], np.cumsum(counts)]) for counts in (n, m)]
            pairs = n[column] * m[column]
            of = np.repeat(column, pairs)
            place = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            i, j = a[starts[0][of] + place // m[of]], b[starts[1][of] + place % m[of]]
            both += np.bincount(i * len(other) + j, minlength=both.size).reshape(both.shape)
        for low in range(0, len(common), COLUMNS):
            dense = np.flatnonzero(~rare[low : low + COLUMNS])
            if len(dense):
                both += _zero_one(n, a, low, dense, len(one)) @ _zero_one(m, b, low, dense, len(other)).T
    return both


def _columns(values: np.ndarray, owner: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many sets have each element of `common`, and these sets, column by column."""
    at = np.searchsorted(common, values)
    there = common[np.minimum(at, len(common) - 1)] == values
    return np.bincount(at[there], minlength=len(common)), owner[there]


def _zero_one(counts: np.ndarray, owner: np.ndarray, low: int, columns: np.ndarray, rows: int) -> np.ndarray:
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((rows, min(COLUMNS, len(counts) - low)), np.float32)
    held = owner[starts[low] : starts[low + out.shape[1]]]
    out[held, np.repeat(np.arange(out.shape[1]), counts[low : low + out.shape[1]])] = 1
    return out[:, columns]


def similar(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Which sets of `one` are similar to which of `other`."""
    both = intersections(one, other)
    n, m = (np.array([len(x) for x in sets], np.float64) for sets in (one, other))
    return UNDER * both >= OVER * (n[:, None] + m - both)


def spanning(pairs, parts: list[list[int]]) -> list[int]:
    """Which of `pairs` of places join parts that the ones before leave apart; `parts` names the part of each place."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (i, j) in enumerate(pairs):
        a, b = find(parts[0][i]), find(parts[1][j])
        if a != b:
            root[a] = b
            kept.append(k)
    return kept


def _blocks(batches, names: tuple[str, ...]):
    """Over rows in order of unit, x, y: of each block its unit and the rows of either side, as tuples of the columns `names`."""
    sides, last = ([], []), None
    for batch in batches:
        key = zip(*(batch.column(c).to_pylist() for c in ("unit", "x", "y", "side")))
        for (unit, x, y, side), row in zip(key, zip(*(batch.column(c).to_pylist() for c in names))):
            if (unit, x, y) != last:
                if last is not None:
                    yield last[0], sides
                sides, last = ([], []), (unit, x, y)
            sides[side].append(row)
    if last is not None:
        yield last[0], sides


def _hopeful(batches):
    """Over rows (unit, x, y, side, of, node, part, n, sketch) in order: unit, side (`of`), node, part of those that may be
    similar to one of another part in the block."""
    for unit, sides in _blocks(batches, ("of", "node", "part", "n", "sketch")):
        both = [sides[0], sides[1] or sides[0]]
        if not both[0]:
            continue
        parts, sizes = ([np.array([row[k] for row in side], np.int64) for side in both] for k in (2, 3))
        near = maybe_similar(sizes, [[row[4] for row in side] for side in both])
        near &= parts[0][:, None] != parts[1]
        found = [side[i] for k, side in enumerate(both[: 1 + bool(sides[1])]) for i in np.flatnonzero(near.any(axis=1 - k))]
        if found:
            of, node, part = ([row[k] for row in found] for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([unit] * len(of)), pa.array(of, pa.int32()), pa.array(node), pa.array(part)], names=["unit", "side", "node", "part"])


def _links(batches):
    """Over rows (unit, x, y, side, node, part, elements) in order: links a, b between sets of different parts, as many as
    it takes to join what belongs together in a block. Side 0 meets side 1; without a side 1 it meets itself."""
    for _, sides in _blocks(batches, ("node", "part", "elements")):
        if not sides[0] or (not sides[1] and len(sides[0]) < 2):
            continue
        nodes, parts = ([[row[k] for row in side] for side in sides] for k in range(2))
        sets = [[np.frombuffer(row[2], "<u8") for row in side] for side in sides]
        if not sides[1]:
            nodes[1], parts[1], sets[1] = nodes[0], parts[0], sets[0]
        found = np.argwhere(similar(sets[0], sets[1]) & (np.array(parts[0])[:, None] != np.array(parts[1]))).tolist()
        kept = [found[k] for k in spanning(found, parts)]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([nodes[side][pair[side]] for pair in kept], pa.int64()) for side in (0, 1)], names=["a", "b"])


def _pieces(rows: str, elements: str) -> Column:
    return F.greatest(F.ceil(F.col(rows) / BLOCK_NODES), F.ceil(F.col(elements) / BLOCK_ELEMENTS), F.lit(1)).cast("int")


def _spread(asked: DataFrame) -> DataFrame:
    """unit, x, y, side, of, node, part: every row of `asked` (unit, side, node, part, n) in the blocks in which it meets others;
    `of` is its side in `asked`.

    The nodes of a side are dealt to blocks by their hash. Each block of side 0 meets each of side 1; of a unit with one
    side only, blocks meet each other once and themselves. A node is in as many blocks as its unit has on the other side.
    """
    side = F.col("side")
    sizes = asked.groupBy("unit").agg(
        *(F.count(F.when(side == k, 1)).alias(f"n{k}") for k in (0, 1)), *(F.coalesce(F.sum(F.when(side == k, F.col("n"))), F.lit(0)).alias(f"e{k}") for k in (0, 1))
    )
    cut = sizes.select("unit", _pieces("n0", "e0").alias("p0"), F.when(F.col("n1") > 0, _pieces("n1", "e1")).alias("p1"))
    dealt = asked.join(cut, "unit").withColumn("block", F.pmod(F.xxhash64("node"), F.when(side == 0, F.col("p0")).otherwise(F.col("p1"))).cast("int"))
    block = F.col("block")

    def place(x, y, side):
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(side).alias("side"))

    def count(end):
        return F.filter(F.sequence(F.lit(0), end), lambda i: i < end)

    two_sided = F.when(side == 0, F.transform(count(F.col("p1")), lambda y: place(block, y, 0))).otherwise(F.transform(count(F.col("p0")), lambda x: place(x, block, 1)))
    later = F.transform(F.filter(count(F.col("p0")), lambda y: y >= block), lambda y: place(block, y, 0))
    earlier = F.transform(count(block), lambda x: place(x, block, 1))
    places = F.when(F.col("p1").isNotNull(), two_sided).otherwise(F.concat(later, earlier))
    rows = dealt.select("unit", side.alias("of"), "node", "part", F.explode(places).alias("at"))
    return rows.select("unit", "at.x", "at.y", "at.side", "of", "node", "part")


def _in_blocks(asked: DataFrame, nodes: DataFrame, content: tuple[str, ...], work, schema: str) -> DataFrame:
    """`work` on the blocks of `asked` (unit, side, node, part), each row with the columns `content` of its node."""
    key = ["unit", "x", "y"]
    rows = _spread(asked.join(nodes.select("node", "n"), "node")).join(nodes.select("node", *content), "node")
    ready = rows.select(*key, "side", "of", "node", "part", *content).repartition(*key).sortWithinPartitions(*key, "side")
    return ready.mapInArrow(tidy(work), schema)


def hopeful(asked: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows of `asked` (unit, side, node, part) that may be similar to a node of another part that they meet: all of those
    that are. Their sketches travel once for each block."""
    unit = f"unit {asked.schema['unit'].dataType.simpleString()}, side int, node long, part long"
    return _in_blocks(asked, sketches, ("n", "sketch"), _hopeful, unit).distinct()


def links_in_blocks(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a, b of similarity 3/4 or more between nodes of different parts that meet in a unit of `asked` (unit, side, node,
    part): enough of them to join all that belongs together. Sets travel once for each block, pairs never do."""
    return _in_blocks(asked, sets, ("elements",), _links, "a long, b long")


def stars(met: DataFrame) -> DataFrame:
    """node, centre: of each signature the node that is in the largest signatures is the centre; of the centres a node meets,
    it gets the one it shares most signatures with. The original of a family of copies is the centre of most."""
    weight = met.groupBy("node").agg(F.sum("size").alias("weight"))
    centre = met.join(weight, "node").groupBy("signature").agg(F.max_by("node", F.struct("weight", "node")).alias("centre"), F.max("weight").alias("weight"))
    with_centre = met.join(centre, "signature").filter("node <> centre")
    shared = with_centre.groupBy("node", "centre").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))
    return shared.groupBy("node").agg(F.max_by("centre", F.struct("n", "weight", "centre")).alias("centre"))


def open_units(met: DataFrame, near: DataFrame, found: DataFrame) -> DataFrame:
    """unit, side, node, part of what is still to be compared: nodes that share a signature and are in different components.

    Nodes with the same centre are a cluster. A unit is: what a cluster has outside its largest component, whose nodes meet
    each other; these and that component; a cluster and the nodes of smaller clusters that share a signature with one of its
    nodes; or, where more than MOST_CLUSTERS clusters share a signature, that signature. So rows grow with nodes and
    clusters, not with pairs of nodes.
    """
    centres = near.select(F.col("centre").alias("c")).distinct()
    cluster = met.select("node").distinct().join(near, "node", "left").join(centres, F.col("node") == F.col("c"), "left")
    cluster = cluster.select("node", F.when(F.col("c").isNotNull(), F.col("node")).otherwise(F.col("centre")).alias("cluster"))
    cluster = cluster.withColumn("cluster", F.coalesce("cluster", "node"))
    named = written(cluster.join(found, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("part")), "clusters")
    rows = met.select("signature", "node").join(named, "node")
    spans = rows.groupBy("signature").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"), F.bit_xor("node").alias("s1"), F.bit_xor(F.xxhash64("node")).alias("s2"))
    # Signatures that the same nodes share say the same: one of them is enough.
    once = spans.filter("low < high").groupBy("n", "s1", "s2").agg(F.min("signature").alias("signature")).select("signature")
    rows = written(rows.join(once, "signature", "left_semi"), "open-signatures")

    groups = rows.groupBy("signature", "cluster").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
    there = written(rows.select("cluster", "node", "part").distinct(), "open-nodes")
    sizes = there.groupBy("cluster").agg(F.count("*").alias("size"))
    groups = written(groups.join(sizes, "cluster"), "open-groups")
    many = groups.groupBy("signature").agg(F.count("*").alias("k"), F.min("low").alias("s_low"), F.max("high").alias("s_high"))
    crowded = many.filter(F.col("k") > MOST_CLUSTERS).select("signature")
    unit = lambda kind, column: F.concat(F.lit(kind), F.col(column).cast("string")).alias("unit")
    whole = rows.join(crowded, "signature", "left_semi").select(unit("s", "signature"), F.lit(0).alias("side"), "node", "part")

    calm = groups.join(crowded, "signature", "left_anti")
    within = calm.filter("low < high").select("signature", "cluster")
    inside = written(rows.join(within, ["signature", "cluster"], "left_semi").select("cluster", "node", "part").distinct(), "inner-nodes")
    most = inside.groupBy("cluster", "part").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    inside = inside.join(most, "cluster")
    others = inside.filter("part <> main").select(unit("c", "cluster"), F.lit(0).alias("side"), "node", "part")
    joined = inside.select(unit("m", "cluster"), (F.col("part") != F.col("main")).cast("int").alias("side"), "node", "part")
    inner = others.union(joined)
    host = calm.select("signature", F.col("cluster").alias("host"), F.struct("size", "cluster").alias("h_rank"), F.col("low").alias("h_low"), F.col("high").alias("h_high"))
    guest = calm.select("signature", "cluster", F.struct("size", "cluster").alias("rank"), "low", "high")
    apart = (F.col("h_low") != F.col("high")) | (F.col("h_high") != F.col("low"))
    visits = host.join(guest, "signature").filter((F.col("rank") < F.col("h_rank")) & apart).select("signature", "cluster", "host")
    visits = written(visits, "visits")
    guests = rows.join(visits, ["signature", "cluster"]).select("host", "node", "part").distinct()
    visited = visits.select("signature", F.col("host").alias("cluster")).distinct()
    hosts = rows.join(visited, ["signature", "cluster"], "left_semi").select("cluster", "node", "part").distinct()
    cross = hosts.select(unit("h", "cluster"), F.lit(0).alias("side"), "node", "part").union(guests.select(unit("h", "host"), F.lit(1).alias("side"), "node", "part"))
    return whole.union(inner).union(cross)


@leaves_no_tables
def similarity_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links of similarity 3/4 or more.

    1. Equal sets are one node, named by a hash of the set; copies in a batch give their signatures once.
    2. Nodes that share a signature stand next to each other after one shuffle of (signature, node). Each is first
       compared with one node, its centre; so that a family of copies is one component before its members would meet.
    3. Nodes of different components that share a signature are compared, all of them, cluster by cluster in blocks of
       sets. So no link between components is missed, and links inside a component need not be listed.
    Before either comparison the nodes meet with their sketches, a thirtieth of a set. Only sets of nodes that may be similar
    to one they meet are built anew from the texts and travel.
    Texts without words, null ones too, have no shingles and link with nothing. Rows that share an id share their links;
    a null id links with nothing that has no other row. The order of words and lines that repeat does not matter.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    member = written(_sets(docs), "members")
    full = member.filter("n_shingles > 0")
    # Different sets with the same first half of their hash: less than one pair in 10^9 documents.
    clashes = frozenset(row.h1 for row in full.groupBy("h1").agg(F.min("h2").alias("x"), F.max("h2").alias("y")).filter("x <> y").select("h1").collect())
    node = F.when(F.col("h1").isin(*clashes), F.col("h1").bitwiseXOR(F.col("h2"))).otherwise(F.col("h1")) if clashes else F.col("h1")
    full = full.withColumn("node", node)
    named = full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    nodes = written(named.filter(F.col("doc_id").isNotNull()), "nodes")
    full = full.select("doc_id", "node")

    rows = _signature_rows(docs.filter(F.col("doc_id").isNotNull()), hot_shingles(docs), clashes)
    met = written(rows.repartition("signature").sortWithinPartitions("signature", "node").mapInArrow(tidy(_shared), "signature long, node long, size long"), "signatures")

    def links_of(asked):
        may = written(hopeful(asked, nodes), "hopeful")
        ids = written(may.select("node").distinct().join(nodes, "node").select("node", F.col("doc_id").alias("_doc")), "hopeful-nodes")
        texts = docs.join(ids, F.col("doc_id") == F.col("_doc"), "left_semi")
        # An id may stand for several texts; the set's own name tells which one is meant.
        built = _sets(texts, elements=True, clashes=clashes).join(ids.select("node"), "node", "left_semi")
        sets = written(built.dropDuplicates(["node"]), "sets")
        return written(links_in_blocks(may, sets), "links")

    near = written(stars(met), "stars")
    star = near.select(F.col("centre").cast("string").alias("unit"), F.lit(1).alias("side"), "node", F.col("node").alias("part"))
    middle = near.select("centre").distinct().select(F.col("centre").cast("string").alias("unit"), F.lit(0).alias("side"), F.col("centre").alias("node"), F.col("centre").alias("part"))
    links = links_of(middle.union(star))
    asked = written(open_units(met, near, components(links)), "open-units")
    found = components(links.union(links_of(asked)))

    # Components are named by sets so far; the smallest id of theirs is the name asked for.
    parts = nodes.join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    ids = parts.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    parts = parts.join(ids, "component").select("node", "component_id")
    # Rows that share an id share their links: their components are one.
    shared = full.join(parts.select(F.col("node").alias("k"), F.col("component_id").alias("c")), F.col("node") == F.col("k"))
    pooled = components(shared.select(F.col("doc_id").alias("a"), F.col("c").alias("b")).filter(F.col("a") != F.col("b")))
    every = member.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, node).alias("k"))
    out = every.join(parts.select("node", F.col("component_id").alias("c")), F.col("k") == F.col("node"), "left").drop("node")
    out = out.withColumn("c", F.coalesce("c", "doc_id")).join(pooled, F.col("c") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "c").alias("component_id"))
