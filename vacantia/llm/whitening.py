"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

With X the centred rows, each step takes the left vector u = Xv - (last beta)(last u) and then Xᵀu, in one pass over the
rows: Spark multiplies blocks of rows and sums one vector of the length of a row, whatever their number.  A left vector is
as long as the table, so it is kept by its coefficients, u = Xw, and made again block by block; left and right vectors are
orthogonalised twice against all earlier ones.  The right singular vectors of the small bidiagonal matrix turn the right
vectors into components, its singular values are the deviations along them.  As many steps as dimensions make it exact, also
with equal deviations, where a single start vector needs restarts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import written

COMPONENTS = 8
STEPS_OF_ONE = 1024
SHIFT = 100_000
BLOCK = 4096  # rows of a stored block
NOTHING = 1e-12  # a deviation of this share of the largest counts as none


def fixed_rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and x of every row whose vector has entries, none of them null or non-finite: x = floor(1024 c) + 100000 as longs."""
    c = F.col(vector)
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(c.isNotNull() & (F.size(c) > 0) & finite)
    return rows.select(F.col(key).alias("id"), F.transform(c, lambda e: F.floor(e.cast("double") * STEPS_OF_ONE).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column as the rows of a matrix; a length of its own is an error."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths cannot be whitened together")
    values = column.flatten().to_numpy()
    return values.reshape(len(lengths), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            x = _matrix(batch.column(0).slice(a, BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([x.sum(axis=0)])],
                                             names=["n", "dimensions", "x", "sums"])


@dataclass
class Whitening:
    """Counts and exact sums of the fit rows, the components as columns, their variances and the total variance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean, whose whole part is taken off exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)², exactly; values beyond a long are an error."""
        most = int(np.abs(x - np.array([s // self.n for s in self.sums], np.int64)).max(initial=0)) + 1
        if self.n * int(np.abs(x).max(initial=0)) < 1 << 62 and (self.n * most) ** 2 * x.shape[1] < 1 << 62:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(axis=1)
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        if max(exact) >= 1 << 63:
            raise OverflowError("a deviation does not fit a long")
        return np.array(exact, np.int64)


def _summed(blocks: DataFrame, dimensions: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of f(block of x), a vector; each task hands on one, Spark adds them by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0):
                part = f(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dimensions))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "value"])

    rows = blocks.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()  # one number a place
    out = np.zeros(len(rows))
    for r in rows:
        out[r["place"]] = r["value"]
    return out


def _orthogonal(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            vector = vector - (other @ vector) * other
    return vector


def bidiagonalised(product: Callable[[np.ndarray], np.ndarray], dimensions: int, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors V (columns) and upper bidiagonal B with X V = U B and orthonormal U, from w -> Xᵀ(Xw).

    Where the vectors found so far span an invariant space, the next one starts anew, orthogonal to them.
    """
    steps = dimensions if steps is None else min(steps, dimensions)
    rng = np.random.default_rng(20241001)

    def fresh(right: list[np.ndarray]) -> np.ndarray:
        v = _orthogonal(rng.normal(size=dimensions), right)
        return v / np.linalg.norm(v)

    right: list[np.ndarray] = []
    left: list[tuple[np.ndarray, np.ndarray]] = []  # w and Xᵀu of the left vectors u = Xw
    b = np.zeros((steps, steps))
    v, beta, largest = fresh(right), 0.0, 0.0
    for k in range(steps):
        right.append(v)
        w = v - beta * left[-1][0] if left and beta else v
        g = product(w)
        for _ in range(2):
            for other, turned in left:
                c = other @ g
                w, g = w - c * other, g - c * turned
        alpha = float(np.sqrt(max(w @ g, 0.0)))
        largest = max(largest, alpha, beta)
        if alpha <= NOTHING ** 0.5 * largest * 1e-2 or alpha == 0:
            alpha, w, g = 0.0, np.zeros(dimensions), np.zeros(dimensions)
        else:
            w, g = w / alpha, g / alpha
        left.append((w, g))
        b[k, k] = alpha
        rest = _orthogonal(g - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        if beta <= 1e-13 * largest or alpha == 0:
            beta = 0.0
        if k + 1 < steps:
            v = rest / beta if beta else fresh(right)
            b[k, k + 1] = beta
    return np.stack(right, axis=1), b


def fit(fixed: DataFrame, components: int = COMPONENTS, steps: int | None = None) -> tuple[Whitening, float] | None:
    """The whitening of a frame (x: array of longs), and the largest entry by which the whitened covariance misses the identity.

    None for an empty frame.  At most `components` directions, fewer where the rows span fewer.  `steps` below the number
    of dimensions trades exactness for passes over the rows.
    """
    kinds = "n long, dimensions int, x binary, sums array<long>"
    blocks = written(fixed.select("x").mapInArrow(_blocks, kinds), "whitening-blocks")
    shape = blocks.agg(F.sum("n").alias("n"), F.min("dimensions").alias("least"), F.max("dimensions").alias("most")).first()
    if not shape["n"]:
        return None
    if shape["least"] != shape["most"]:
        raise ValueError("vectors of different lengths cannot be whitened together")
    n, d = shape["n"], shape["most"]
    sums = [0] * d
    for r in blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect():
        sums[r["pos"]] = int(r["s"])
    plain = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)

    def product(w: np.ndarray) -> np.ndarray:
        def turned(x: np.ndarray) -> np.ndarray:
            centred = plain.centred(x)
            u = centred @ w
            return u @ centred
        return _summed(blocks, d, turned)

    right, b = bidiagonalised(product, d, steps)
    _, deviations, turn = np.linalg.svd(b)
    found = min(components, int((deviations > NOTHING ** 0.5 * deviations[0]).sum()) if deviations[0] > 0 else 0)
    directions = np.linalg.qr(right @ turn.T[:, :found])[0] if found else np.zeros((d, 0))
    total = float(_summed(blocks, d, lambda x: np.array([(plain.centred(x) ** 2).sum()]))[0]) / n
    white = Whitening(n, sums, directions, deviations[:found] ** 2 / n, total)
    if not found:
        return white, 0.0
    mean = _summed(blocks, d, lambda x: white.whitened(x).sum(axis=0)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        z = white.whitened(x) - mean
        return (z.T @ z).ravel()

    covariance = _summed(blocks, d, spread).reshape(found, found) / n
    return white, float(np.abs(covariance - np.eye(found)).max())


def _projected(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white, error = shared.value
        k = len(white.variances)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = _matrix(part.column(1))
                rows = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), white.n)),
                    pa.array(white.deviations(x)[rows]), pa.array(white.whitened(x).ravel()), pa.array(np.tile(white.variances / white.total, len(x))),
                    pa.array(np.full(len(rows), error))], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, steps: int | None = None) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row per vector and component, from 1 by falling variance.

    Null and empty vectors and those with null or non-finite entries are left out; vectors of different lengths are an error.
    Repeated rows and rows with a null key count and are returned; other columns are not read.  Directions without variance have no
    rows, so equal vectors, a single one and an empty table give none.  Of components with equal variance any rotation may come.
    """
    kind = vectors.schema[key].dataType.simpleString()
    fixed = fixed_rows(vectors, key, vector)
    names = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(fixed, components, steps)
    if found is None or not len(found[0].variances):
        return vectors.sparkSession.createDataFrame([], names.replace("id ", f"`{key}` ", 1))
    shared = vectors.sparkSession.sparkContext.broadcast(found)  # a few vectors of the length of a row
    return fixed.mapInArrow(_projected(shared), names).withColumnRenamed("id", key)
