"""Embedding near-duplicates: vectors hashed to cells of the E8 lattice in several tables, cosine checked in each cell.

A table projects the unit vector to BLOCKS times eight dimensions, shifts it and decodes each block to the nearest point of E8.
A vector lies in the cell of its points and probes the PROBES cells whose point is next nearest; vectors meet where one lies in
a cell that the other lies in or probes.  At cosine 0.9 two vectors meet in about 0.39 of the tables, so some 5 in 100,000 such
pairs meet in none of 20, and far fewer above; vectors of cosine 0 meet in some 2 of 10,000.

Equal vectors are collapsed first.  Cells are shuffled as keys with a signature of SIGNS signs; vectors without a near
signature in their cell go no further (a linked pair differs in so many signs once in 10^9).  Cells of many vectors are cut
into blocks, and pairs of blocks are compared by matrix products.  No pair becomes a row: a block yields for each vector how
many it links with there and the least one reached.  A pair that meets repeatedly counts in the first table where it does;
projections are integers, so that every task decodes a vector alike.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.components import components
from vacantia.llm.shared import joined_by_share, written
from vacantia.llm.words import mix

COSINE = 0.9
TABLES = 20
BLOCKS = 2
PROBES = 4
SPREAD = 0.2  # standard deviation of a projected coordinate between two unit vectors at the threshold
BLOCK_ROWS = 1024  # of one cell, compared with one such block
BATCH = 2048  # vectors hashed at once
SIGNS = 128
MOST_SIGNS = 6.5  # standard deviations above the signs in which a pair at the threshold differs on average
SMALL = 32  # cells of up to so many rows are compared together
_STEPS = 1 << 20  # a coordinate of a unit vector is rounded to one in so many
_SCALE = 1 << 30


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for row, (i, j, a, b) in zip(whole, pairs):
        row[i], row[j] = a, b
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate([whole, halves[(halves < 0).sum(axis=1) % 2 == 0]])


SHORTEST = _shortest()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points of even sum (last axis of eight)."""
    out = np.rint(x)
    rest = x - out
    far = np.abs(rest).argmax(axis=-1)[..., None]
    odd = out.sum(axis=-1, keepdims=True) % 2
    step = np.where(np.take_along_axis(rest, far, -1) >= 0, 1.0, -1.0) * odd
    np.put_along_axis(out, far, np.take_along_axis(out, far, -1) + step, -1)
    return out


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8: of the integer points of even sum, or of those moved by a half."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=-1) <= ((x - b) ** 2).sum(axis=-1)
    return np.where(nearer[..., None], a, b)


@dataclass(frozen=True)
class Lattice:
    """Settings of the tables; equal settings give equal cells everywhere."""

    tables: int = TABLES
    blocks: int = BLOCKS
    probes: int = PROBES
    spread: float = SPREAD
    cosine: float = COSINE

    @functools.lru_cache(maxsize=16)  # noqa: B019
    def projection(self, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Integer projections, shifts, and the multipliers that hash a cell's points and its neighbours' differences."""
        rng = np.random.default_rng([20240917, dimensions])
        each = self.blocks * 8
        deviation = self.spread / np.sqrt(2 - 2 * self.cosine) * _SCALE / _STEPS
        matrix = np.rint(rng.normal(0, deviation, (dimensions, self.tables * each)))
        shift = rng.integers(0, 1 << 20, self.tables * each) / float(1 << 18)
        multiply = rng.integers(0, 1 << 63, (self.tables, self.blocks, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        twice = (2 * SHORTEST).astype(np.int64).view(np.uint64)
        moves = (multiply[:, :, None, :] * twice).sum(axis=-1, dtype=np.uint64).reshape(self.tables, -1)
        return matrix, shift, multiply, moves

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(vector, table, 1 + probes): 64-bit cells, the own one first.  All sums are exact, whatever their order."""
        n, dimensions = unit.shape
        matrix, shift, multiply, moves = self.projection(dimensions)
        out = np.empty((n, self.tables, 1 + self.probes), np.uint64)
        salt = mix(np.arange(1, self.tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dimensions))
        for a in range(0, n, BATCH):
            x = (np.rint(unit[a:a + BATCH] * _STEPS) @ matrix / _SCALE + shift).reshape(-1, self.tables, self.blocks, 8)
            point = nearest_point(x)
            linear = ((2 * point).astype(np.int64).view(np.uint64) * multiply).sum(axis=(2, 3), dtype=np.uint64)
            out[a:a + BATCH, :, 0] = mix(linear + salt)
            if self.probes:
                near = ((x - point) @ SHORTEST.T).reshape(len(x), self.tables, -1)
                best = np.argpartition(-near, self.probes - 1, axis=-1)[..., :self.probes]
                for t in range(self.tables):
                    out[a:a + BATCH, t, 1:] = mix(linear[:, t, None] + moves[t][best[:, t]] + salt[t])
        return out


    @functools.lru_cache(maxsize=16)  # noqa: B019
    def planes(self, dimensions: int) -> np.ndarray:
        return np.random.default_rng([20240918, dimensions]).normal(size=(dimensions, SIGNS))

    def signatures(self, unit: np.ndarray) -> np.ndarray:
        """(vector, 2): SIGNS signs of random projections."""
        return np.packbits(unit @ self.planes(unit.shape[1]) > 0, axis=1).view(np.uint64)

    def most_signs(self) -> int:
        share = np.arccos(self.cosine) / np.pi
        return int(SIGNS * share + MOST_SIGNS * np.sqrt(SIGNS * share * (1 - share)))


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square overflows or vanishes."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key and the vector's doubles as bytes; null for vectors that link with nothing."""
    for batch in batches:
        out = []
        for vector in batch.column(1):
            values = vector.values
            if values is None or values.null_count or not len(values):
                out.append(None)
                continue
            x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 becomes 0.0
            out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vector"])


def _grouped(vectors: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of the vectors of each length."""
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(vectors[i] for i in at), np.float64).reshape(len(at), size // 8)


def _in_cells(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            vectors = batch.column(1).to_pylist()
            for a in range(0, len(vectors), BATCH):
                for at, rows in _grouped(vectors[a:a + BATCH]):
                    unit = unit_vectors(rows)
                    cells, signs = lattice.cells(unit), lattice.signatures(unit).view(np.int64)
                    each = cells.shape[1] * cells.shape[2]
                    own = np.zeros(cells.shape, bool)
                    own[:, :, 0] = True
                    table = np.broadcast_to(np.arange(cells.shape[1], dtype=np.int8)[None, :, None], cells.shape)
                    columns = (cells.ravel().view(np.int64), np.repeat(node[a:][at], each), own.ravel(), table.ravel(),
                               np.repeat(signs[:, 0], each), np.repeat(signs[:, 1], each))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "node", "own", "table", "signs0", "signs1"])
    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal first three columns, with the starts of the runs and the end."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
        cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
        if held and tuple(keys[:, 0]) != last:
            cuts = np.concatenate([[0], cuts])
        if len(cuts):
            yield _with_starts([*held, batch.slice(0, cuts[-1])])
            held = []
        held.append(batch.slice(cuts[-1] if len(cuts) else 0))
        last = tuple(keys[:, -1])
    if held:
        yield _with_starts(held)


def _with_starts(batches: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    keys = np.stack([table.column(i).to_numpy() for i in range(3)])
    return table, np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1, [table.num_rows]])


def _near_signs(signs: np.ndarray, own: np.ndarray, first: np.ndarray, second: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Rows with another row of their run that is near by signature; one of the two lies in the cell, and their blocks meet."""
    near = np.zeros(len(own), bool)
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    sizes = np.diff(starts)
    small = np.flatnonzero(sizes[group] <= SMALL)
    for d in range(1, int(min(SMALL, sizes.max(initial=0)))):
        a, b = small[:-d], small[d:]
        ok = (group[a] == group[b]) & (own[a] | own[b]) & (first[a] & second[b] | second[a] & first[b])
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(signs[a] ^ signs[b]).sum(axis=1, dtype=np.int64) <= most
        near[a[ok]] = near[b[ok]] = True
    for g in np.flatnonzero(sizes > SMALL):
        at = np.arange(starts[g], starts[g + 1])
        lying = at[own[at]]
        for k in range(0, len(lying), 256):
            a = lying[k:k + 256]
            close = np.bitwise_count(signs[a, None] ^ signs[None, at]).sum(axis=2, dtype=np.int64) <= most
            close &= (a[:, None] != at) & (first[a, None] & second[at] | second[a, None] & first[at])
            near[a] |= close.any(axis=1)
            near[at] |= close.any(axis=0)
    return near


def _promising(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = lattice.most_signs()
        for table, starts in _whole_groups(batches):
            flags = [table[c].to_numpy(zero_copy_only=False) for c in ("own", "first", "second")]
            signs = np.stack([table["signs0"].to_numpy(), table["signs1"].to_numpy()], axis=1).view(np.uint64)
            yield from table.drop_columns(["signs0", "signs1"]).filter(pa.array(_near_signs(signs, *flags, starts, most))).to_batches()
    return run


def _meets(cells: np.ndarray, a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    """Whether the vectors at places a and b meet in a table."""
    x, y = cells[a, table], cells[b, table]
    return (x[:, 0] == y[:, 0]) | (x[:, :1] == y[:, 1:]).any(axis=1) | (y[:, :1] == x[:, 1:]).any(axis=1)


def _first_meeting(cells: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, probing: bool) -> np.ndarray:
    """Which pairs count here: in no earlier table, and, of two vectors that probe each other's cell, once.

    `probing`: a probes the cell of b.
    """
    at = np.arange(len(a))
    for t in range(table):
        at = at[~_meets(cells, a[at], b[at], t)]
    if probing:
        x, y = cells[a[at], table], cells[b[at], table]
        back = (x[:, :1] == y[:, 1:]).any(axis=1)
        at = at[~back | (node[a[at]] < node[b[at]])]
    return at


def _least_connected(n: int, a: np.ndarray, b: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each of n places the least node that the links reach."""
    least = node.copy()
    while True:
        low = np.minimum(least[a], least[b])
        now = least.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        if (now == least).all():
            return now
        least = now


def _cell_links(lattice: Lattice, node, weight, vectors, first, second, own, table) -> list[np.ndarray]:
    """Node, links (weighted by copies) and least node reached, of one pair of blocks of a cell.

    `first`, `second`: whether a row belongs to the first, the second block; both if a block meets itself.
    """
    found = [np.empty(0, np.int64)] * 3
    for at, rows in _grouped(vectors):
        if len(at) < 2 or not own[at].any():
            continue
        unit, places = unit_vectors(rows), np.arange(len(at))
        f, s, o = first[at], second[at], own[at]
        heres, theres = [], []
        # own rows of one block with own ones of the other, then probing rows with own ones, either way round
        for x, y, probing in ((f & o, s & o, False), (f & ~o, s & o, True), (s & ~o & ~f, f & o, True)):
            px, py = places[x], places[y]
            if not len(px) or not len(py):
                continue
            i, j = np.nonzero(unit[px] @ unit[py].T >= lattice.cosine)
            i, j = px[i], py[j]
            kept = node[at][i] != node[at][j]
            if not probing:
                kept &= (node[at][i] < node[at][j]) | ~(f[j] & s[i])  # a block with itself sees a pair twice
            heres.append((i[kept], j[kept], probing))
        if not any(len(h[0]) for h in heres):
            continue
        cells, nodes, weights = lattice.cells(unit), node[at], weight[at]
        for i, j, probing in heres:
            k = _first_meeting(cells, nodes, i, j, table, probing)
            theres.append((i[k], j[k]))
        i, j = np.concatenate([x[0] for x in theres]), np.concatenate([x[1] for x in theres])
        if not len(i):
            continue
        links = np.bincount(i, weights[j], len(at)) + np.bincount(j, weights[i], len(at))
        least = _least_connected(len(at), i, j, nodes)
        hit = np.flatnonzero(links)
        found = [np.concatenate([x, y]) for x, y in zip(found, (nodes[hit], links[hit].astype(np.int64), least[hit]))]
    return found


def _compared(lattice: Lattice):
    """Links of the runs of rows with equal cell and pair of blocks; rows come sorted by them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches):
            node, copies, which = (table[c].to_numpy() for c in ("node", "copies", "table"))
            own, first, second = (table[c].to_numpy(zero_copy_only=False) for c in ("own", "first", "second"))
            for a, b in zip(starts[:-1], starts[1:]):
                vectors = table["vector"].slice(a, b - a).to_pylist()
                out = _cell_links(lattice, node[a:b], copies[a:b], vectors, first[a:b], second[a:b], own[a:b], int(which[a]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["node", "links", "least"])
    return run


def _links(known: DataFrame, lattice: Lattice, block_rows: int) -> DataFrame:
    """(node, links, least) partial results of all cells, of a written table (node, vector, copies)."""
    kinds = "cell long, node long, own boolean, table byte, signs0 long, signs1 long"
    cells = written(known.select("node", "vector").mapInArrow(_in_cells(lattice), kinds), "cells")
    busy = cells.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("own").alias("owned")).where((F.col("n") > 1) & (F.col("owned") > 0))
    rows = joined_by_share(cells, written(busy.select("cell", "n"), "busy-cells"), "cell", "n")
    parts = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("cell", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node", "own", "table",
                       (F.col("part") <= F.col("other")).alias("first"), (F.col("part") >= F.col("other")).alias("second"), "signs0", "signs1")
    keys = ["cell", "low", "high"]
    near = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _promising(lattice), "cell long, low int, high int, node long, own boolean, table byte, first boolean, second boolean")
    met = written(near, "near-cells").join(known, "node").select(*keys, "node", "own", "table", "first", "second", "copies", "vector")
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compared(lattice), "node long, links long, least long")


def near_vectors(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", lattice: Lattice = Lattice(),
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, n_links, component_id, kept: one row per row of `vectors` with a key, and one per row without.

    Two vectors of one length are linked if their cosine reaches the threshold and they meet in a table; equal ones always are.
    Null, empty and zero vectors and those with null or non-finite entries link with nothing, nor does a row without a key;
    these are their own component (null key: null) and kept.  Repeated rows count as vectors of their own.  Other columns
    are not read.  An empty table gives no rows.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector")).mapInArrow(_packed, f"id {kind}, vector binary")
    rows = written(rows, "vectors")
    linked = F.col("id").isNotNull() & F.col("vector").isNotNull()
    classes = rows.where(linked).groupBy("vector").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"))
    known = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    partial = written(_links(known.select("node", "vector", "copies"), lattice, block_rows), "vector-links")
    counted = partial.groupBy("node").agg(F.sum("links").alias("links"))
    joined = written(components(partial.select(F.col("node").alias("a"), F.col("least").alias("b"))), "vector-components")
    least = (joined.join(known.select("node", "least_id"), "node").groupBy("component")
             .agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")))
    named = joined_by_share(joined, written(least, "least-ids"), "component", "n").select("node", "component_id")
    found = known.join(counted, "node", "left").join(named, "node", "left").select(
        "vector", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    met = joined_by_share(rows.where(linked), written(found, "vector-results"), "vector", "copies").select("id", "n_links", "component_id")
    alone = rows.where(~linked).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return met.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
