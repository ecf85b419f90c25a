"""Vectors: text embedding, integrity checks and exact nearest neighbours by inner product.

Exact search hashes both sides into blocks of bounded bytes, and every pair of blocks is one group.  A group keeps the
best k corpus rows of each of its queries and sends nothing else to the shuffle.  The corpus is copied once for each block
of queries, so not at all for a table of questions.  Where the number of queries is known, as for all postings against all,
a task holds a block of them and the whole corpus passes it packet by packet, so that k rows of a query leave its task and
not k for each block of the corpus.  `neighbours` has the forms that skip cells.

Scores are compared after rounding to nine digits, equal scores by id, so results do not depend on blocks.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vacantia.functions import text

DIMENSIONS = 256
MAX_BLOCK_BYTES = 128 << 20
TILE_CELLS = 1_000_000
ROUNDING = 1e-8  # scores are compared after rounding to nine digits
COUNTED_ROWS = 512  # rows of counts that a task holds at once
FOUND_ROWS = 1 << 20  # rows that a block of queries returns at once
PACKET_ROWS = 8192  # corpus rows that pass a block of queries at once
TILE_QUERIES = 256  # queries of a block whose scores with a packet are held at once
HELD_BYTES = 64 << 20  # best rows and vectors of the queries that a task holds while the corpus passes

Encoder = Callable[[list[str]], np.ndarray]


LATIN = 0x250  # the code points below are letters or numbers, or not, alike in every version of Unicode
_SHORT_WORD = np.ones(0x800, bool)  # code points of at most two bytes
_SHORT_WORD[:LATIN] = [chr(i) == "_" or unicodedata.category(chr(i))[0] in "LN" for i in range(LATIN)]
_BYTE_WORD = np.ones(256, bool)
_BYTE_WORD[:128] = _SHORT_WORD[:128]


def _marked_words(rows: DataFrame, column: str) -> DataFrame:
    """The rows with `_marked`, the lower-case text in which every code point from LATIN on belongs to a word.

    What is a word beyond LATIN is left to the JVM, as in `text.word_list`: such texts come with a space between their words.
    One string a row; a list of words costs the transfer to Python several times as much.
    """
    rows = rows.withColumn("_marked", F.coalesce(F.lower(F.col(column)), F.lit("")))
    beyond = (F.octet_length("_marked") > F.length("_marked")) & F.col("_marked").rlike(r"[^\x00-\x{24f}]")
    return rows.withColumn("_marked", F.when(beyond, F.regexp_replace("_marked", text.NOT_WORD + "+", " ")).otherwise(F.col("_marked")))


def _found_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row and bytes of every word of marked texts."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buf = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    word = _BYTE_WORD[buf]
    lead = np.flatnonzero(buf & 0xE0 == 0xC0)
    word[lead] = word[lead + 1] = _SHORT_WORD[(buf[lead].astype(np.int64) & 31) << 6 | buf[lead + 1] & 63]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = at[:-1][at[:-1] < len(buf)]
    begins[first] = word[first]
    kept = np.compress(word, buf)
    ends = np.append(np.flatnonzero(np.compress(word, begins)), len(kept))
    found = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept)])
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(np.flatnonzero(begins), at))), found


def _word_cells(texts: pa.Array, dimensions: int) -> np.ndarray:
    """Row times dimensions plus bucket of every word (hashed bag of words); a word is hashed once in a batch."""
    row, found = _found_words(texts)
    coded = found.dictionary_encode()
    if not len(coded.dictionary):
        return np.empty(0, np.int64)
    at, data = np.frombuffer(coded.dictionary.buffers()[1], np.int64).tolist(), coded.dictionary.buffers()[2].to_pybytes()
    md5 = partial(hashlib.md5, usedforsecurity=False)
    digests = b"".join([md5(data[at[i]:at[i + 1]]).digest() for i in range(len(coded.dictionary))])
    parts = np.frombuffer(digests, np.uint8).reshape(-1, 16)[:, :3].astype(np.int64)
    buckets = (parts @ np.array([1 << 16, 1 << 8, 1])) % dimensions
    return row * dimensions + buckets[coded.indices.to_numpy()]


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _as_lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.astype(np.float32, copy=False).reshape(-1)))


def _dense_counts(dimensions: int):
    @F.arrow_udf("array<float>")
    def dense(texts: pa.Array) -> pa.Array:
        cells, rows = _word_cells(texts, dimensions), len(texts)
        found = np.empty((rows, dimensions), np.float32)
        for top in range(0, rows, COUNTED_ROWS):  # the cells are in the order of the rows
            some = min(COUNTED_ROWS, rows - top)
            first, last = np.searchsorted(cells, [top * dimensions, (top + some) * dimensions])
            counts = np.bincount(cells[first:last] - top * dimensions, minlength=some * dimensions).reshape(some, dimensions)
            found[top:top + some] = _unit_rows(counts.astype(np.float64))
        return _as_lists(found)

    return dense


def _sparse_counts(dimensions: int):
    @F.arrow_udf("array<struct<bucket:int,weight:float>>")
    def sparse(texts: pa.Array) -> pa.Array:
        rows = len(texts)
        cells, counts = np.unique(_word_cells(texts, dimensions), return_counts=True)
        row = cells // dimensions
        norms = np.sqrt(np.bincount(row, counts * counts, rows))
        values = pa.StructArray.from_arrays([pa.array((cells % dimensions).astype(np.int32)), pa.array((counts / norms[row]).astype(np.float32))], names=["bucket", "weight"])
        return pa.ListArray.from_arrays(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32), values)

    return sparse


def text_weights(rows: DataFrame, column: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """The default embedding as a table: a row for each bucket that a text has, with `bucket` and `weight`, in place of the text.

    Texts without words have no row.
    """
    rest = [F.col(c) for c in rows.columns if c != column]
    return _marked_words(rows, column).select(*rest, F.inline(_sparse_counts(dimensions)(F.col("_marked"))))


def embed_texts(
    rows: DataFrame,
    column: str,
    load_encoder: Callable[[], Encoder] | None = None,
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """Add `embedding`, a unit-length array<float> of the text column.

    `load_encoder` is called once per Python worker batch stream and returns a function from a list of texts
    to a matrix; without it a hashed bag of words is used, whose words are hashed once in a batch.
    """
    if load_encoder is None:
        # Said to be nondeterministic, or a filter on the embedding would be moved below it with a second evaluation.
        return _marked_words(rows, column).withColumn("embedding", _dense_counts(dimensions).asNondeterministic()(F.col("_marked"))).drop("_marked")

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = load_encoder()
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            yield _as_lists(_unit_rows(np.asarray(encoder(texts), dtype=np.float64)))

    return rows.withColumn("embedding", encode(F.col(column)))


def vector_integrity(vectors: DataFrame, id_column: str = "job_id") -> DataFrame:
    """One row: rows, distinct ids, smallest and largest dimension, and whether the table can be searched."""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    per_id = vectors.groupBy(id_column).agg(
        F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high")
    )
    totals = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("vector_count"),
        F.count(id_column).alias("id_count"),
        F.coalesce(F.min("low"), F.lit(0)).alias("min_dimension"),
        F.coalesce(F.max("high"), F.lit(0)).alias("max_dimension"),
    )
    good = (
        (F.col("vector_count") > 0)
        & (F.col("vector_count") == F.col("id_count"))
        & (F.col("min_dimension") == F.col("max_dimension"))
        & (F.col("min_dimension") > 0)
    )
    return totals.withColumn("is_valid", good)


def check_vectors(vectors: DataFrame, id_column: str = "job_id") -> DataFrame:
    """The vectors, or an error when they are empty, repeated or of unequal length."""
    found = vector_integrity(vectors, id_column).first()
    if found["vector_count"] == 0:
        raise ValueError("embedding data is empty")
    if not found["is_valid"]:
        raise ValueError(f"embedding data is inconsistent: {found.asDict()}")
    return vectors


def require_known(targets: DataFrame, vectors: DataFrame, id_column: str = "job_id") -> DataFrame:
    """The targets, or an error when one has no vector."""
    unknown = targets.select(id_column).join(vectors.select(id_column), id_column, "left_anti").first()
    if unknown is not None:
        raise KeyError(f"no vector for {id_column} {unknown[0]}")
    return targets


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; the caller has left out nulls.  An error if they are empty or of different lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths[0] < 1 or (lengths != lengths[0]).any()):
        raise ValueError(f"vectors have between {lengths.min()} and {lengths.max()} dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(column) else 0)


class Best:
    """Best k corpus rows of each of a tile of queries over the corpus tiles seen so far."""

    def __init__(self, k: int, queries: int, id_count: int):
        self.k, self.queries = k, queries
        self.least = np.full(queries, -np.inf)  # the kth best score so far; lower ones cannot matter
        self.query, self.score = np.empty(0, np.int64), np.empty(0, np.float64)
        self.ids = [np.empty(0, np.int64) for _ in range(id_count)]
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: list[np.ndarray]) -> None:
        """`scores` is queries x corpus rows of one tile; -inf marks a pair to leave out."""
        if scores.shape[1] > self.k:
            place = scores.shape[1] - self.k
            kth = np.partition(scores, place, axis=1)[:, place]
            self.least = np.maximum(self.least, kth)
        row, column = np.nonzero((scores >= self.least[:, None]) & (scores > -np.inf))
        self.keep(row, scores[row, column], [values[column] for values in ids])

    def keep(self, row: np.ndarray, scores: np.ndarray, ids: list[np.ndarray]) -> None:
        """Pairs that may matter, by their query."""
        self.parts.append((row, scores, ids))
        self.held += len(row)
        if self.held > 4 * self.k * self.queries:
            self.settle()

    def settle(self) -> None:
        query = np.concatenate([self.query, *(p[0] for p in self.parts)])
        score = np.concatenate([self.score, *(p[1] for p in self.parts)])
        ids = [np.concatenate([old, *(p[2][i] for p in self.parts)]) for i, old in enumerate(self.ids)]
        order = np.lexsort([*reversed(ids), -score, query])
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        order, query, place = order[place < self.k], query[place < self.k], place[place < self.k]
        self.query, self.score, self.ids = query, score[order], [values[order] for values in ids]
        last = place == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], self.score[last])
        self.parts, self.held = [], 0


def _scan(
    queries: np.ndarray, corpus: np.ndarray, ids: list[np.ndarray], own: np.ndarray | None, k: int,
    labels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None,
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Query row, score and ids of the best k of each query; tiles of queries outside, of the corpus inside.

    `labels` holds for each label which queries want one, which they want, and what the corpus rows have.
    """
    width = max(1, min(len(corpus), max(1024, 20 * k)))
    height = max(1, TILE_CELLS // width)
    found = []
    for top in range(0, len(queries), height):
        tile = queries[top : top + height]
        best = Best(k, len(tile), len(ids))
        for left in range(0, len(corpus), width):
            part = [values[left : left + width] for values in ids]
            scores = tile @ corpus[left : left + width].T
            for asks, want, have in labels or []:
                other = want[top : top + height, None] != have[None, left : left + width]
                scores[asks[top : top + height, None] & other] = -np.inf
            if left:  # only scores that reach the kth one so far are rounded and looked at
                row, column = np.nonzero(scores >= (best.least - ROUNDING)[:, None])
                if len(row) <= scores.size // 8:
                    score, mine = np.round(scores[row, column], 9), [values[column] for values in part]
                    good = (score >= best.least[row]) & (score > -np.inf)
                    if own is not None:
                        good &= own[top + row] != mine[0]
                    best.keep(row[good], score[good], [values[good] for values in mine])
                    continue
            scores = np.round(scores, 9)
            if own is not None:
                scores[own[top : top + height, None] == part[0][None, :]] = -np.inf
            scores[np.isnan(scores)] = -np.inf
            best.add(scores, part)
        best.settle()
        found.append((best.query + top, best.score, best.ids))
    if not found:
        return np.empty(0, np.int64), np.empty(0), [np.empty(0, np.int64) for _ in ids]
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]),
            [np.concatenate([f[2][i] for f in found]) for i in range(len(ids))])


def _places(mask: np.ndarray) -> np.ndarray:
    """Flat places of the true cells of a sparse mask; eight cells are looked at together."""
    flat = mask.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    which, byte = np.nonzero(flat.reshape(-1, 8)[some])
    return some[which] * 8 + byte


class Passing:
    """Best k corpus rows of each query of a block, over corpus rows that pass in packets.

    Scores are first computed in single precision.  Only pairs that reach a query's kth score so far, less the most by which
    single precision may be wrong, are computed in double precision, and only those scores are kept and compared.
    """

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int, id_count: int, exclude: bool):
        self.queries, self.query_ids, self.k, self.exclude = queries, query_ids, k, exclude
        with np.errstate(over="ignore", invalid="ignore"):
            self.single = queries.astype(np.float32)
            self.norms = np.sqrt((queries * queries).sum(axis=1))
        self.score = np.full((len(queries), k), -np.inf)
        self.ids = [np.zeros((len(queries), k), np.int64) for _ in range(id_count)]
        self.least = np.full(len(queries), -np.inf)  # the kth best score so far; lower ones cannot matter
        self.waiting: dict[int, list[tuple]] = {}  # pairs not yet among the best, by the first query of their tile
        self.counts: dict[int, int] = {}

    def meet(self, corpus: np.ndarray, ids: list[np.ndarray]) -> None:
        """A packet of corpus rows passes all queries."""
        if not len(corpus) or not len(self.queries):
            return
        if corpus.shape[1] != self.queries.shape[1]:
            raise ValueError(f"queries have {self.queries.shape[1]} dimensions, the corpus has {corpus.shape[1]}")
        with np.errstate(over="ignore", invalid="ignore"):
            longest = np.sqrt((corpus * corpus).sum(axis=1)).max()
            largest = longest * self.norms.max()
            single = bool(np.isfinite(largest) and largest < 1e30)  # else a product may be beyond single precision
            wide = (corpus.astype(np.float32) if single else corpus).T
        slack = (corpus.shape[1] + 4) * 2.0 ** -23 * longest * self.norms + 1e-30 if single else np.zeros(len(self.queries))
        left = self.single if single else self.queries
        own = np.argsort(ids[0], kind="stable") if self.exclude else None
        for top in range(0, len(self.queries), TILE_QUERIES):
            rows = slice(top, min(top + TILE_QUERIES, len(self.queries)))
            with np.errstate(over="ignore", invalid="ignore"):
                scores = left[rows] @ wide
            if own is not None:
                self._leave_out(scores, rows, ids[0], own)
            bound = self.least[rows] - ROUNDING - slack[rows]
            place = None
            if np.isfinite(bound).all():
                place = _places(scores >= self._below(bound, scores.dtype)[:, None])
            if place is None or len(place) > scores.size // 16:
                scores[np.isnan(scores)] = -np.inf
                if scores.shape[1] > self.k:
                    kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
                    bound = np.fmax(bound, kth - ROUNDING - 2 * slack[rows])
                bound = self._below(bound, scores.dtype)[:, None]
                place = np.flatnonzero((scores >= bound) & (scores > -np.inf))
            self._keep(top, rows, place // scores.shape[1], place % scores.shape[1], corpus, ids)

    @staticmethod
    def _below(bound: np.ndarray, kind: np.dtype) -> np.ndarray:
        return np.nextafter(bound.astype(kind), np.array(-np.inf, kind))

    def _leave_out(self, scores: np.ndarray, rows: slice, ids: np.ndarray, order: np.ndarray) -> None:
        """No query meets the corpus rows of its own id."""
        mine, held = self.query_ids[rows], ids[order]
        first, last = np.searchsorted(held, mine), np.searchsorted(held, mine, side="right")
        for row in np.flatnonzero(last > first):
            scores[row, order[first[row]:last[row]]] = -np.inf

    def _keep(self, top: int, rows: slice, row: np.ndarray, column: np.ndarray, corpus: np.ndarray, ids: list[np.ndarray]) -> None:
        least, queries = self.least[rows], self.queries[rows]
        for at in range(0, len(row), 1 << 16):
            r, c = row[at:at + (1 << 16)], column[at:at + (1 << 16)]
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.round(np.einsum("ij,ij->i", queries[r], corpus[c]), 9)
            good = (score >= least[r]) & (score > -np.inf)
            if not good.any():
                continue
            self.waiting.setdefault(top, []).append((r[good], score[good], [values[c[good]] for values in ids]))
            self.counts[top] = self.counts.get(top, 0) + int(good.sum())
        if self.counts.get(top, 0) > self.k * len(queries):
            self._settle(top)

    def _settle(self, top: int) -> None:
        """The pairs of a tile that wait join its best ones."""
        parts = self.waiting.pop(top, [])
        if not parts:
            return
        self.counts[top] = 0
        k, rows = self.k, slice(top, min(top + TILE_QUERIES, len(self.queries)))
        height = rows.stop - rows.start
        row = np.concatenate([p[0] for p in parts])
        order = np.argsort(row, kind="stable")
        row = row[order]
        place = k + np.arange(len(row)) - np.searchsorted(row, row)
        width = int(place.max()) + 1
        score = np.full((height, width), -np.inf)
        score[:, :k], score[row, place] = self.score[rows], np.concatenate([p[1] for p in parts])[order]
        ids = []
        for i, old in enumerate(self.ids):
            values = np.zeros((height, width), np.int64)
            values[:, :k], values[row, place] = old[rows], np.concatenate([p[2][i] for p in parts])[order]
            ids.append(values)
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        kth = np.take_along_axis(score, best, 1).min(axis=1)
        tied = np.flatnonzero(((score >= kth[:, None]).sum(axis=1) > k) & (kth > -np.inf))
        if len(tied):  # of equal scores those of the lowest ids
            best[tied] = np.lexsort([*(values[tied] for values in reversed(ids)), -score[tied]], axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(score, best, 1)
        for old, values in zip(self.ids, ids):
            old[rows] = np.take_along_axis(values, best, 1)
        self.least[rows] = kth

    def found(self) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
        """Query ids, ids, scores and ranks (1 is best), some queries at once."""
        for top in range(0, len(self.queries), TILE_QUERIES):
            self._settle(top)
            rows = slice(top, top + TILE_QUERIES)
            order = np.lexsort([*(values[rows] for values in reversed(self.ids)), -self.score[rows]], axis=1)
            score = np.take_along_axis(self.score[rows], order, 1)
            there = score > -np.inf
            rank = np.broadcast_to(np.arange(1, self.k + 1, dtype=np.int32), score.shape)
            query = np.broadcast_to(self.query_ids[rows][:, None], score.shape)
            yield query[there], [np.take_along_axis(values[rows], order, 1)[there] for values in self.ids], score[there], rank[there]


EXPANSION = 16  # bytes of vectors in a task for a byte that the optimizer expects of their source
BROADCAST_QUERY_BYTES = 8 << 20  # queries expected to be no larger are broadcast, and the corpus is not shuffled
MOST_ESTIMATED = 64  # blocks for each core, beyond which the rows are counted instead


def estimated_bytes(rows: DataFrame) -> int:
    """The optimizer's estimate; it runs no job."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _block_count(rows: DataFrame, block_rows: int | None, least: int) -> int:
    """Blocks of bounded bytes, `least` at least.  Rows are counted only if a block size is given or the estimate is too vague.

    Every row of the other side is copied once for each block, so `block_rows` makes blocks smaller only up to `least` blocks
    or as many as the bytes need, whichever is more: copies do not grow with the rows otherwise.
    """
    parallelism = rows.sparkSession.sparkContext.defaultParallelism
    if block_rows is None:
        blocks = math.ceil(estimated_bytes(rows) * EXPANSION / MAX_BLOCK_BYTES)
        if blocks <= MOST_ESTIMATED * parallelism:
            return max(blocks, least)
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    needed = math.ceil(found["n"] * 8 * max(found["width"] or 1, 1) / MAX_BLOCK_BYTES)
    return max(needed, min(least, math.ceil(found["n"] / (block_rows or 1024))), 1)


def _best_rows(q: pa.Table, c: pa.Table, id_columns: list[str], k: int, exclude: bool, labels: list[str], payload: list[str]) -> pa.Table:
    """The best k corpus rows `c` of each query in `q`, with score and payload."""
    query_ids = q.column("query_id").to_numpy()
    ids = [c.column(name).to_numpy() for name in id_columns]
    wide, narrow = matrix(q.column("embedding")), matrix(c.column("embedding"))
    if len(wide) and len(narrow) and wide.shape[1] != narrow.shape[1]:
        raise ValueError(f"queries have {wide.shape[1]} dimensions, the corpus has {narrow.shape[1]}")
    if not len(wide) or not len(narrow):
        wide, narrow, ids = wide[:0].reshape(0, 1), narrow[:0].reshape(0, 1), [values[:0] for values in ids]
    row, score, found = _scan(wide, narrow, [*ids, np.arange(len(narrow))], query_ids if exclude else None, k,
                              [(pc.is_valid(q.column(n)).to_numpy(), pc.fill_null(q.column(n), 0).to_numpy(),
                                pc.fill_null(c.column(n), 0).to_numpy()) for n in labels] if len(narrow) else None)
    place = pa.array(found[-1])
    return pa.table([pa.array(query_ids[row], pa.int64()), *[pa.array(v, pa.int64()) for v in found[:-1]], pa.array(score),
                     *[c.column(name).take(place) for name in payload]], names=["query_id", *id_columns, "raw_score", *payload])


def _found_schema(id_columns: list[str], payload: list[T.StructField]) -> T.StructType:
    return T.StructType([T.StructField("query_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in id_columns],
                         T.StructField("raw_score", T.DoubleType()), *[T.StructField(f.name, f.dataType) for f in payload]])


def _block_rows(block: pa.Table, id_columns: list[str], k: int, exclude: bool, labels: list[str], payload: list[str]) -> Iterator[pa.RecordBatch]:
    """The best rows of a block, some queries at once: a query returns up to k rows, and those of all would be many times the block."""
    q, c = (block.filter(mine) for mine in (block.column("_asks"), pc.invert(block.column("_asks"))))
    some = max(256, FOUND_ROWS // k)
    for top in range(0, len(q), some):
        yield from _best_rows(q.slice(top, some), c, id_columns, k, exclude, labels, payload).combine_chunks().to_batches()


def scan_blocks(blocks: DataFrame, keys: list[str], id_columns: list[str], k: int, exclude: bool, labels: list[str], payload: list[str]) -> DataFrame:
    """The best k corpus rows of each query in every group of `keys`; query rows have `_asks`, corpus rows the ids."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _block_rows(pa.Table.from_batches(batches), id_columns, k, exclude, labels, payload)

    return blocks.groupBy(*keys).applyInArrow(scan, _found_schema(id_columns, [blocks.schema[name] for name in payload]))


def packed(rows: DataFrame, name: str, regroup: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch | pa.Table]] = iter) -> DataFrame:
    """A row for each Arrow batch of the rows, which holds the batch as one binary value.  `regroup` may form other batches."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(batches):
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as stream:
                    stream.write(batch)
                value = sink.getvalue()
                ends = pa.py_buffer(np.array([0, value.size], np.int32))
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), 1, [None, ends, value])], names=[name])

    return rows.mapInArrow(pack, T.StructType([T.StructField(name, T.BinaryType())]))


def unpacked(value: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all()


def best_of_each(found: pa.Table, id_columns: list[str], k: int) -> pa.Table:
    """The best k rows of each query."""
    order = [("query_id", "ascending"), ("raw_score", "descending"), *[(c, "ascending") for c in id_columns]]
    found = found.take(pc.sort_indices(found, sort_keys=order, null_placement="at_start"))
    query = found.column("query_id").to_numpy()
    return found.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < k))


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of PACKET_ROWS."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        while rows >= PACKET_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            yield table.slice(0, PACKET_ROWS).to_batches()[0]
            held, rows = table.slice(PACKET_ROWS).to_batches(), rows - PACKET_ROWS
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _passing_scan(queries: DataFrame, corpus: DataFrame, id_columns: list[str], k: int, exclude: bool, query_rows: int, dimensions: int) -> DataFrame:
    """The ranked best k corpus rows of each query, whose ids are distinct.

    The queries are dealt into blocks of HELD_BYTES, as many for each core.  The corpus is packed where it lies; a packet is
    copied once for each block and passes its task after the queries.
    """
    each = k * 8 * (1 + len(id_columns)) + 12 * max(dimensions, 1)
    cores, blocks = queries.sparkSession.sparkContext.defaultParallelism, math.ceil(query_rows * each / HELD_BYTES)
    blocks = max(1, min(math.ceil(blocks / cores) * cores, math.ceil(query_rows / TILE_QUERIES)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    dealt = queries.select("query_id", "embedding").repartitionById(blocks, block)
    asked = packed(dealt, "_packet", _packets).select(F.spark_partition_id().alias("_block"), F.lit(True).alias("_asks"), "_packet")
    held = packed(corpus.select(*[F.col(c).cast("bigint").alias(c) for c in id_columns], "embedding"), "_packet", _packets)
    copies = held.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(False).alias("_asks"), "_packet")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, passing = [], None
        for batch in batches:
            for asks, packet in zip(batch.column("_asks").to_pylist(), batch.column("_packet")):
                rows = unpacked(packet)
                if asks:
                    asking.append(rows)
                elif asking:
                    if passing is None:
                        q = pa.concat_tables(asking)
                        passing = Passing(matrix(q.column("embedding")), q.column("query_id").to_numpy(), k, len(id_columns), exclude)
                    passing.meet(matrix(rows.column("embedding")), [rows.column(c).to_numpy() for c in id_columns])
        for query, ids, score, rank in passing.found() if passing is not None else ():
            if len(query):
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), *[pa.array(v, pa.int64()) for v in ids], pa.array(score), pa.array(rank)],
                                                 names=["query_id", *id_columns, "raw_score", "rank"])

    together = asked.unionByName(copies).repartitionById(blocks, "_block").sortWithinPartitions("_block", F.col("_asks").desc())
    return together.mapInArrow(scan, _found_schema(id_columns, []).add("rank", T.IntegerType()))


def _broadcast_scan(queries: DataFrame, corpus: DataFrame, id_columns: list[str], k: int, exclude: bool, labels: list[str], payload: list[str]) -> DataFrame:
    """The best k corpus rows of each query in every task.  The corpus stays where it is and meets all queries batch by batch."""
    asked = queries.select("query_id", "embedding", *labels).coalesce(1)
    held = corpus.select(*[F.col(c).cast("bigint").alias(c) for c in id_columns], "embedding", *labels, *payload)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = None, 0
        for batch in batches:
            for q, c in zip(batch.column("_queries"), batch.column("_corpus")):
                found = _best_rows(unpacked(q), unpacked(c), id_columns, k, exclude, labels, payload)
                best = found if best is None else pa.concat_tables([best, found])
                if len(best) > 4 * held:
                    best = best_of_each(best, id_columns, k)
                    held = len(best)
        if best is not None:
            yield from best_of_each(best, id_columns, k).combine_chunks().to_batches()

    met = packed(held, "_corpus").crossJoin(F.broadcast(packed(asked, "_queries")))
    return met.mapInArrow(scan, _found_schema(id_columns, [corpus.schema[name] for name in payload]))


def block_sides(queries: DataFrame, corpus: DataFrame, id_columns: list[str], labels: list[str], payload: list[str]) -> tuple[list[Column], list[Column]]:
    """The columns of query and of corpus rows that `scan_blocks` reads, so that both can be united."""
    no_id = F.lit(None).cast("bigint")
    left = [F.lit(True).alias("_asks"), F.col("query_id"), *[no_id.alias(c) for c in id_columns], *[F.col(c) for c in labels], F.col("embedding"),
            *[F.lit(None).cast(corpus.schema[c].dataType).alias(c) for c in payload]]
    right = [F.lit(False).alias("_asks"), no_id.alias("query_id"), *[F.col(c).cast("bigint").alias(c) for c in id_columns],
             *[F.col(c) for c in labels], F.col("embedding"), *[F.col(c) for c in payload]]
    return left, right


def _blocked_scan(
    queries: DataFrame, corpus: DataFrame, id_columns: list[str], k: int, exclude: bool, block_rows: int | None,
    labels: list[str], payload: list[str], query_blocks: int | None,
) -> DataFrame:
    across = query_blocks or _block_count(queries, block_rows, 1)
    down = _block_count(corpus, block_rows, corpus.sparkSession.sparkContext.defaultParallelism)
    asks, holds = block_sides(queries, corpus, id_columns, labels, payload)
    left = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(across)).alias("_row"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint"))).alias("_column"), *asks)
    right = corpus.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint"))).alias("_row"),
                          F.pmod(F.xxhash64(*id_columns), F.lit(down)).alias("_column"), *holds)
    return scan_blocks(left.unionByName(right), ["_row", "_column"], id_columns, k, exclude, labels, payload)


def ranked(partial: DataFrame, id_columns: list[str], k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("raw_score").desc(), *id_columns)
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    id_columns: list[str],
    k: int,
    exclude_same_id: bool = False,
    block_rows: int | None = None,
    labels: list[str] | None = None,
    payload: list[str] | None = None,
    query_blocks: int | None = None,
    query_rows: int | None = None,
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """Exact top k corpus rows per query: query_id, id columns, raw_score, payload and rank (1 is best).

    `queries` has query_id and embedding, `corpus` the bigint id columns and embedding.  Rows whose id or vector is null
    take no part; vectors of unequal length are an error when the result is read.  `labels` names bigint columns of both
    sides that must be equal where the query's is not null.  `payload` names corpus columns that travel with the vectors.

    A few queries, by the optimizer's size estimate, are broadcast: no vector of the corpus is shuffled then.
    Building the result runs no job: the number of blocks follows the optimizer's size estimate.  With `block_rows` rows are
    counted and blocks are about that small while they are few; `query_blocks` sets the number of those of the queries.
    With `query_rows`, the number of the queries or more, of distinct ids, and `dimensions` a task holds some queries while the
    corpus passes; not with labels or payload.
    """
    queries, corpus = searchable(queries, corpus, id_columns, labels or [], payload or [])
    if k <= 0:
        extra = [T.StructField(c, corpus.schema[c].dataType) for c in payload or []]
        longs = [T.StructField(c, T.LongType()) for c in ("query_id", *id_columns)]
        return corpus.sparkSession.createDataFrame([], T.StructType([*longs, T.StructField("raw_score", T.DoubleType()), *extra, T.StructField("rank", T.IntegerType())]))
    if block_rows is None and query_blocks is None and estimated_bytes(queries) * EXPANSION <= BROADCAST_QUERY_BYTES:
        partial = _broadcast_scan(queries, corpus, id_columns, k, exclude_same_id, labels or [], payload or [])
    elif query_rows is not None and block_rows is None and query_blocks is None and not labels and not payload:
        return _passing_scan(queries, corpus, id_columns, k, exclude_same_id, query_rows, dimensions)
    else:
        partial = _blocked_scan(queries, corpus, id_columns, k, exclude_same_id, block_rows, labels or [], payload or [], query_blocks)
    return ranked(partial, id_columns, k)


def searchable(queries: DataFrame, corpus: DataFrame, id_columns: list[str], labels: list[str], payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns that a search needs, without rows whose id or vector is null."""
    queries = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding", *labels).dropna(subset=["query_id", "embedding"])
    return queries, corpus.select(*id_columns, "embedding", *labels, *payload).dropna(subset=[*id_columns, "embedding"])


def _consistent(vectors: DataFrame, id_column: str) -> tuple[DataFrame, Row]:
    rows = vectors.dropna(subset=[id_column, "embedding"])
    found = vector_integrity(rows, id_column).first()
    if found["vector_count"] and not found["is_valid"]:
        raise ValueError(f"embedding data is inconsistent: {found.asDict()}")
    return rows, found


def consistent_vectors(vectors: DataFrame, id_column: str = "job_id") -> DataFrame:
    """The rows with id and vector, or an error if an id is repeated or lengths differ; an empty table passes."""
    return _consistent(vectors, id_column)[0]


def nearest_jobs(vectors: DataFrame, k: int, targets: DataFrame | None = None, block_rows: int | None = None, cells=None, probes: int | None = None) -> DataFrame:
    """The k nearest postings of each posting, itself excluded: job_id, candidate_id, raw_score, rank.

    A target without a row in `vectors`, repeated ids and vectors of unequal length are errors.  With `cells` (see
    `neighbours`) cells that cannot hold a neighbour are skipped; with `probes` too, only so many cells of each
    posting are looked at and the result is approximate.
    """
    vectors, shape = _consistent(vectors, "job_id")
    if targets is not None:
        require_known(targets, vectors)
    queries = vectors if targets is None else vectors.join(targets.select("job_id"), "job_id", "left_semi")
    queries = queries.withColumnRenamed("job_id", "query_id")
    corpus = vectors.select(F.col("job_id").alias("candidate_id"), "embedding")
    if cells is None:
        asking = shape["vector_count"] if targets is None or block_rows is not None else queries.count()
        found = nearest(queries, corpus, ["candidate_id"], k, exclude_same_id=True, block_rows=block_rows, query_rows=asking,
                        dimensions=shape["max_dimension"])
    else:
        from vacantia.operators import neighbours

        index = neighbours.build_index(corpus, cells)
        found = neighbours.nearest_in_cells(queries, index, cells, ["candidate_id"], k, exclude_same_id=True, probes=probes,
                                            block_rows=block_rows or neighbours.BLOCK_ROWS)
    return found.withColumnRenamed("query_id", "job_id")
