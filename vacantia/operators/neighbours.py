"""Nearest neighbours by cells: exact search that skips cells which cannot matter, and approximate search by inverted lists.

Centres are fitted to a bounded sample by k-means; every vector lies in the cell of its nearest centre.  For a query q and
a vector x in the cell of centre c with radius r, q·x <= q·c + |q| r.  Exact search first looks at the cells
of largest q·c that together hold enough rows, which gives each query its kth score so far, and then only at the cells whose bound
reaches it.  Approximate search stops after `probes` cells.

Cells and the queries that ask for them are cut into blocks of bounded rows, so a cell with a third of all vectors is no
single task; a vector is copied once for each block of queries that ask for its cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.operators.vectors import block_sides, matrix, nearest, ranked, scan_blocks, searchable
from vacantia.session import ensure_checkpoint_dir

SAMPLE_ROWS = 50_000
MAX_CELLS = 4096
BLOCK_ROWS = 16_384
SLACK = 1e-8  # scores are compared after rounding to nine digits


@dataclass(frozen=True)
class Cells:
    """Centres of the cells, a row each: at most MAX_CELLS, so they can be broadcast."""

    centres: np.ndarray

    def products(self, queries: np.ndarray) -> np.ndarray:
        if len(queries) and queries.shape[1] != self.centres.shape[1]:
            raise ValueError(f"queries have {queries.shape[1]} dimensions, the cells have {self.centres.shape[1]}")
        return queries @ self.centres.T

    def order(self, queries: np.ndarray) -> np.ndarray:
        """The cells of each query, most promising first."""
        return np.argsort(-self.products(queries), axis=1, kind="stable")

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of the nearest centre and the distance to it."""
        own = np.argmin((self.centres ** 2).sum(axis=1) - 2 * self.products(rows), axis=1)
        return own, np.sqrt(((rows - self.centres[own]) ** 2).sum(axis=1))


def fit_cells(vectors: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> Cells:
    """Centres of about sqrt(rows of the sample) cells, from at most `sample_rows` vectors of lowest hash.

    The sample decides what is skipped, never what is found by exact search.  An empty table gives no cells.
    """
    rows = vectors.select("embedding").dropna()
    sample = rows.withColumn("_h", F.xxhash64("embedding")).orderBy("_h").limit(sample_rows)
    points = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).checkpoint()
    n = points.count()
    if not n:
        return Cells(np.zeros((0, 0)))
    k = min(cells or math.ceil(math.sqrt(n)), MAX_CELLS, n)
    if k < 2:
        return Cells(np.array([r["features"].toArray() for r in points.collect()]).mean(axis=0, keepdims=True))  # one or two rows
    model = KMeans(k=k, seed=1, maxIter=15).fit(points)
    return Cells(np.array(model.clusterCenters()))


def build_index(corpus: DataFrame, cells: Cells) -> DataFrame:
    """The corpus with `cell` and `distance` to its centre: the inverted lists, to be stored if they are searched repeatedly.

    Rows without a vector are left out.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(cells)

    @F.arrow_udf("struct<cell:int,distance:double>")
    def assign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            own, distance = shared.value.assign(matrix(batch)) if len(batch) else (np.empty(0, int), np.empty(0))
            yield pa.StructArray.from_arrays([pa.array(own.astype(np.int32)), pa.array(distance)], names=["cell", "distance"])

    rows = corpus.dropna(subset=["embedding"]).withColumn("_place", assign("embedding"))
    return rows.select(*corpus.columns, F.col("_place.cell").alias("cell"), F.col("_place.distance").alias("distance"))


def _cell_stats(index: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and radius of every cell."""
    size, radius = np.zeros(cells, np.int64), np.zeros(cells)
    for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect():  # MAX_CELLS rows at most
        size[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    return size, radius


def _asking(queries: DataFrame, choose, further: str | None = None) -> DataFrame:
    """The queries with `cell`, a row for each cell that `choose` (matrix and, if named, a further column) lists for them."""
    @F.arrow_udf("array<int>")
    def chosen(embedding: pa.Array) -> pa.Array:
        return pa.array([x.tolist() for x in choose(matrix(embedding))] if len(embedding) else [], pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def chosen_by(embedding: pa.Array, other: pa.Array) -> pa.Array:
        found = choose(matrix(embedding), other.to_numpy(zero_copy_only=False)) if len(embedding) else []
        return pa.array([x.tolist() for x in found], pa.list_(pa.int32()))

    listed = chosen("embedding") if further is None else chosen_by("embedding", further)
    return queries.select("query_id", "embedding", F.explode(listed).alias("cell"))


def block_shapes(asked: DataFrame, size: np.ndarray, block_rows: int) -> DataFrame:
    """(cell, query_blocks, cell_blocks) of the cells that are asked for: how often their vectors and their queries are copied."""
    rows = [(r["cell"], math.ceil(r["count"] / block_rows), math.ceil(int(size[r["cell"]]) / block_rows))
            for r in asked.groupBy("cell").count().collect()]  # MAX_CELLS rows at most
    return asked.sparkSession.createDataFrame(rows, "cell int, query_blocks long, cell_blocks long")


def _scan_cells(asked: DataFrame, index: DataFrame, size: np.ndarray, id_columns: list[str], k: int, exclude: bool, block_rows: int) -> DataFrame:
    shapes = F.broadcast(block_shapes(asked, size, block_rows).where("cell_blocks > 0"))
    asks, holds = block_sides(asked, index, id_columns, [], [])
    zero = F.lit(0).cast("bigint")
    left = asked.join(shapes, "cell").select(
        "cell", F.pmod(F.xxhash64("query_id"), "query_blocks").alias("_row"), F.explode(F.sequence(zero, F.col("cell_blocks") - 1)).alias("_column"), *asks)
    right = index.join(shapes, "cell").select(
        "cell", F.explode(F.sequence(zero, F.col("query_blocks") - 1)).alias("_row"),
        F.pmod(F.xxhash64(*id_columns), "cell_blocks").alias("_column"), *holds)
    return scan_blocks(left.unionByName(right), ["cell", "_row", "_column"], id_columns, k, exclude, [], [])


def nearest_in_cells(queries: DataFrame, index: DataFrame, cells: Cells, id_columns: list[str], k: int, exclude_same_id: bool = False,
                     probes: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top k rows of the index per query: query_id, id columns, raw_score and rank; exact without `probes`.

    Queries and rows without id or vector take no part.  The first pass is kept by checkpoint(), since the second starts
    from its scores.
    """
    ensure_checkpoint_dir(index.sparkSession)
    count = len(cells.centres)
    queries, kept = searchable(queries, index, id_columns, [], ["cell", "distance"])
    if k <= 0 or not count:
        return nearest(queries, kept, id_columns, 0)
    shared = index.sparkSession.sparkContext.broadcast(cells)
    size, radius = _cell_stats(kept, count)
    rows = kept.select(*id_columns, "embedding", "cell")

    def first_cells(q: np.ndarray) -> list[np.ndarray]:
        order = shared.value.order(q)
        if probes is not None:
            return list(order[:, :probes])
        enough = (np.cumsum(size[order], axis=1) < k + exclude_same_id).sum(axis=1) + 1
        return [o[:n] for o, n in zip(order, enough)]

    def scan(asked: DataFrame) -> DataFrame:
        return _scan_cells(asked, rows, size, id_columns, k, exclude_same_id, block_rows)

    found = ranked(scan(_asking(queries, first_cells)), id_columns, k)
    if probes is not None:
        return found
    found = found.checkpoint()
    least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("raw_score")).alias("least"))

    def further_cells(q: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
        product = shared.value.products(q)
        bound = product + np.sqrt((q ** 2).sum(axis=1, keepdims=True)) * radius + SLACK
        wanted = (bound >= np.nan_to_num(least.astype(float), nan=-np.inf)[:, None]) & (size > 0)
        out = []
        for w, seen in zip(wanted, first_cells(q)):
            w[seen] = False
            out.append(np.flatnonzero(w))
        return out

    waiting = queries.join(least, "query_id", "left")
    more = scan(_asking(waiting, further_cells, "least"))
    return ranked(found.drop("rank").unionByName(more), id_columns, k)


def choose_probes(queries: DataFrame, index: DataFrame, cells: Cells, id_columns: list[str], k: int, exclude_same_id: bool = False,
                  target: float = 0.95, sample_queries: int = 256) -> int:
    """The least number of cells that hold `target` of the exact neighbours of at most `sample_queries` queries of lowest hash."""
    sample = queries.select("query_id", "embedding").dropna().orderBy(F.xxhash64("query_id")).limit(sample_queries)
    asked = {r["query_id"]: r["embedding"] for r in sample.collect()}
    truth = nearest(sample, index, id_columns, k, exclude_same_id, payload=["cell"]).select("query_id", "cell").collect()  # k for each
    if not truth:
        return 1
    ids = sorted(asked)
    place = {i: n for n, i in enumerate(ids)}
    order = cells.order(np.array([asked[i] for i in ids], np.float64))
    position = np.argsort(order, axis=1)
    depth = np.sort([position[place[r["query_id"]], r["cell"]] for r in truth])
    return int(depth[math.ceil(target * len(depth)) - 1]) + 1


def recall(found: DataFrame, truth: DataFrame, id_columns: list[str]) -> DataFrame:
    """One row: how many of the true neighbours were found, and the share (1 where there are none)."""
    keys = ["query_id", *id_columns]
    both = truth.select(*keys).join(found.select(*keys, F.lit(1).alias("_hit")), keys, "left")
    counts = both.agg(F.count("*").alias("neighbours"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("found"))
    return counts.withColumn("recall", F.when(F.col("neighbours") > 0, F.col("found") / F.col("neighbours")).otherwise(F.lit(1.0)))
