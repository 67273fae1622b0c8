"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points in several tables."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelltrail.llm.common import mixed, written
from shelltrail.llm.graph import components

#: Tables, neighbouring cells probed in each, and the size of a cell in units of the distance of unit vectors.
TABLES, PROBES, CELL = 16, 3, 0.6
#: Members of a cell that are compared in one go; larger cells are cut into pairs of blocks.
BLOCK = 2048


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all +-1/2 with an even number of minus signs."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for signs in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = signs
            found.append(v)
    found += [np.array(v) / 2 for v in itertools.product((1.0, -1.0), repeat=8) if np.prod(v) > 0]
    return np.array(found)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 = D8 and D8 + 1/2, row by row."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(1) % 2)
        gap = y[odd] - near[odd]
        worst = np.abs(gap).argmax(1)
        near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
        return near

    whole, half = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


class Lattice:
    def __init__(self, width: int, tables: int = TABLES, probes: int = PROBES, cell: float = CELL, seed: int = 23):
        random = np.random.default_rng([seed, width])
        self.probes, self.vectors, scale = probes, shortest_vectors(), np.sqrt(max(width, 8) / 8) / cell
        self.planes = [(np.linalg.qr(random.standard_normal((width, 8)))[0] if width >= 8 else np.linalg.qr(random.standard_normal((8, width)))[0].T) * scale for _ in range(tables)]
        self.shift = random.random((tables, 8))
        self.odd = mixed(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)

    def keys(self, points: np.ndarray, table: int, salt: np.ndarray) -> np.ndarray:
        whole = (points * 2).astype(np.int64).astype(np.uint64)
        return mixed((whole * self.odd).sum(-1, dtype=np.uint64) + mixed(salt + np.uint64(table + 1)))

    def cells(self, unit: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cell per table, and the neighbouring cells nearest to the point, for unit vectors."""
        homes = np.zeros((len(unit), len(self.planes)), np.uint64)
        near = np.zeros((len(unit), len(self.planes), self.probes), np.uint64)
        for t, plane in enumerate(self.planes):
            x = unit @ plane + self.shift[t]
            home = nearest_e8(x)
            homes[:, t] = self.keys(home, t, salt)
            order = np.argsort(-((x - home) @ self.vectors.T), axis=1, kind="stable")[:, : self.probes]
            near[:, t] = self.keys(home[:, None, :] + self.vectors[order], t, salt[:, None])
        return homes, near


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the lists, all components in a row as doubles)."""
    lengths = np.diff(column.offsets.to_numpy())
    return lengths, column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def hashed(vectors: DataFrame, tables: int, probes: int, cell: float, seed: int) -> DataFrame:
    """node, vector, homes, cells: cells holds each table's home cell and the probed ones."""

    def decode(batches):
        lattices: dict[int, Lattice] = {}
        for batch in batches:
            column = batch.column("vector")
            lengths, flat = _units(column)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            labels = np.array(batch.column("salt").to_pylist(), np.int64).astype(np.uint64)
            for width in np.unique(lengths):
                own = np.flatnonzero(lengths == width)
                lattice = lattices.setdefault(int(width), Lattice(int(width), tables, probes, cell, seed))
                unit = flat[starts[own][:, None] + np.arange(width)]
                unit /= np.abs(unit).max(1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                homes, near = lattice.cells(unit, mixed(labels[own] * np.uint64(2) + np.uint64(int(width) << 32)))
                rows = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").take(rows),
                        column.take(rows),
                        pa.array(list(homes.view(np.int64)), pa.list_(pa.int64())),
                        pa.array(list(near.reshape(len(own), -1).view(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["node", "vector", "homes", "near"],
                )

    salted = vectors.select("node", "vector", F.xxhash64("label").alias("salt"))
    return salted.mapInArrow(decode, "node long, vector array<double>, homes array<long>, near array<long>")


def _links_of_cells(least: float):
    """mapInArrow over rows sorted by (cell, i, j): links of at least `least` between members, homes with homes or probes."""

    def compare(cells: np.ndarray, i: int, j: int, block, probe, node, unit, homes):
        one = np.flatnonzero(~probe)
        for low in range(0, len(one), 256):
            some = one[low : low + 256]
            a, b = np.nonzero(unit[some] @ unit.T >= least)
            a = some[a]
            # Of a cell cut into blocks, this group sees only pairs of block i with block j.
            good = (node[a] != node[b]) & (((block[a] == i) & (block[b] == j)) | ((block[a] == j) & (block[b] == i)))
            good &= probe[b] | (node[a] < node[b])
            a, b = a[good], b[good]
            together = homes[a] == homes[b]
            met = together.any(1)
            # Two homes report in the first table where they meet; a probe only where homes never meet.
            first = met & (homes[a, together.argmax(1)] == cells)
            keep = np.where(probe[b], ~met, first)
            a, b = a[keep], b[keep]
            yield np.minimum(node[a], node[b]), np.maximum(node[a], node[b])

    def find(batches):
        def groups():
            held = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
                keys = np.stack([held.column(c).to_numpy() for c in ("cell", "i", "j")], 1)
                cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
                if len(cuts):
                    yield held.slice(0, int(cuts[-1])), cuts[:-1]
                    held = held.slice(int(cuts[-1]))
            if held is not None and held.num_rows:
                yield held, np.zeros(0, np.int64)

        for table, cuts in groups():
            if not table.num_rows:
                continue
            table = table.combine_chunks()
            node, probe, block, cell, i, j = (table.column(c).to_numpy() for c in ("node", "probe", "block", "cell", "i", "j"))
            probe = probe.astype(bool)
            chunks = [table.column(c).chunk(0) for c in ("vector", "homes")]
            lengths, flat = _units(chunks[0])
            starts = np.concatenate([[0], np.cumsum(lengths)])
            homes = chunks[1].flatten().to_numpy().reshape(len(node), -1)
            found = []
            for low, high in zip(np.append(0, cuts), np.append(cuts, len(node))):
                unit = flat[starts[low] : starts[high]].reshape(high - low, -1)
                unit = unit / np.abs(unit).max(1, keepdims=True)
                unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                found += compare(cell[low], i[low], j[low], block[low:high], probe[low:high], node[low:high], unit, homes[low:high])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 1)], names=["a", "b"])

    return find


def near_links(vectors: DataFrame, least: float = 0.93, tables: int = TABLES, probes: int = PROBES, cell: float = CELL, seed: int = 23) -> DataFrame:
    """Links (a, b), a < b, of cosine >= `least` between rows (node, label, vector) of equal label.

    Cells with one member are dropped on narrow rows; vectors travel to the others only. A cell of more than BLOCK
    members is cut into blocks by a hash of the node, each pair of blocks is a group of its own, so a group is bounded
    and no pair is lost. Candidates are compared where they meet and only links leave the task.
    """
    held = written(hashed(vectors, tables, probes, cell, seed), "lattice")
    homes = held.select("node", F.explode("homes").alias("cell"), F.lit(False).alias("probe"))
    members = homes.union(held.select("node", F.explode("near").alias("cell"), F.lit(True).alias("probe")))
    busy = members.groupBy("cell").agg(F.count("*").alias("n"), F.sum((~F.col("probe")).cast("int")).alias("homes")).filter("n > 1 AND homes > 0")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    crowd = (
        members.join(busy.select("cell", "n"), "cell")
        .select("node", "cell", "probe", mine.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("node", "cell", "probe", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    rows = crowd.join(held.select("node", "vector", "homes"), "node").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return rows.mapInArrow(_links_of_cells(least), "a long, b long").distinct()


def near_duplicates(rows: DataFrame, least: float = 0.93, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", **lattice) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Equal vectors of a label are one node first, so copies are counted, not paired. A row whose id, label or vector is
    null, or whose vector is empty, zero or holds a null, NaN or infinity, links with nothing; its component is its own
    id and a null id is not kept. Rows that share an id pool their links. Vectors of different lengths never link.
    """
    sizes = F.transform(vector, lambda x: F.abs(x.cast("double")))
    finite = ~F.exists(sizes, lambda x: x.isNull() | F.isnan(x) | (x == float("inf")))
    good = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(sizes, lambda x: x > 0)
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), F.col(label)).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    able = named.filter(F.col("label").isNotNull())
    nodes = written(able.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "vectors")
    links = written(near_links(nodes, least, **lattice), "vector-links")
    copies = nodes.groupBy("node").agg(F.max("copies").alias("copies"))
    both = links.union(links.select("b", "a"))
    degree = both.join(copies, F.col("b") == F.col("node")).groupBy("a").agg(F.sum("copies").alias("degree"))
    of = nodes.join(degree, F.col("node") == F.col("a"), "left").drop("a").join(components(links).withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
    known = of.select(
        F.col("label").alias("n_label"),
        F.col("vector").alias("n_vector"),
        (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    joined = named.join(known, (F.col("label") == F.col("n_label")) & (F.col("vector") == F.col("n_vector")), "left")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
