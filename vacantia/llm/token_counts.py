"""Token counts per document by a two-tier lookup on the map side; no pre-token is ever shuffled.

The library's pieces never cross from a letter to a following space, so the encoding of a text is the sequence of the
encodings of its pre-tokens (a run of spaces and what follows up to the next space).  First tier: a broadcast hash
table of the lengths of frequent pre-tokens, found in a bounded sample of documents; it only saves time, every other
pre-token gives the same count through the second tier, a bounded cache in each Python worker in front of the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import words

SAMPLE_DOCUMENTS = 10_000
FREQUENT = 1 << 16
CACHE_ENTRIES = 400_000
_MARK = "▁".encode()
_EMPTY = np.uint64(0)


def _encoder(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def pretoken_starts(buf: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of a buffer whose texts each begin with an added space after a zero byte."""
    space = buf == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    return np.flatnonzero(start | (buf == 0))


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one buffer, each behind a zero byte and the space that the library adds; offset of each."""
    offsets = np.cumsum([0, *(len(t) + 2 for t in texts)])
    return np.frombuffer(b"".join(b"\0 " + t for t in texts), np.uint8), offsets


def piece_lengths(encoder, pretokens: list[bytes]) -> list[int]:
    """Number of pieces of pre-tokens that begin with a space; a lone space is the piece of the space itself."""
    ids = encoder.encode([p[1:].decode() for p in pretokens], num_threads=1)
    return [len(x) if len(p) > 1 else 1 for p, x in zip(pretokens, ids)]


class LengthTable:
    """Open addressing over 64-bit hashes: arrays of keys and lengths, looked up for a whole batch at once."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, probes: int = 12):
        bits = max(4, int(2 * len(hashes)).bit_length())
        self.mask, self.probes = np.uint64((1 << bits) - 1), probes
        self.keys, self.lengths = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint32)
        left = np.flatnonzero(hashes != _EMPTY)
        for probe in range(probes):  # what finds no place is left to the second tier
            at = ((hashes[left] + np.uint64(probe)) & self.mask).astype(np.int64)
            free = np.flatnonzero(self.keys[at] == _EMPTY)
            at, one = np.unique(at[free], return_index=True)
            chosen = left[free[one]]
            self.keys[at], self.lengths[at] = hashes[chosen], lengths[chosen]
            left = np.setdiff1d(left, chosen)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Lengths, 0 where the table has none."""
        out = np.zeros(len(hashes), np.int64)
        left = np.flatnonzero(hashes != _EMPTY)
        for probe in range(self.probes):
            at = ((hashes[left] + np.uint64(probe)) & self.mask).astype(np.int64)
            hit = self.keys[at] == hashes[left]
            out[left[hit]] = self.lengths[at[hit]]
            left = left[~hit & (self.keys[at] != _EMPTY)]
            if not len(left):
                break
        return out


def _count_sample(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for _, texts in words.slices(batch, text):
                for t in texts:
                    for w in t.replace(b"\0", b" ").split(b" "):
                        if w and len(w) < 64:
                            counts[w] = counts.get(w, 0) + 1
        items = [x for x in counts.items() if x[1] > 1]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([x[0] for x in items], pa.binary()),
                                          "n": pa.array([x[1] for x in items], pa.int64())})
    return run


def frequent_table(docs: DataFrame, model_path: str, text: str, sample_documents: int, frequent: int) -> LengthTable:
    """Lengths of the most frequent pre-tokens of a sample of about `sample_documents` documents."""
    rows = docs.count()
    sample = docs.select(text).sample(min(1.0, sample_documents / max(rows, 1)), 7)
    top = (sample.mapInArrow(_count_sample(text), "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "piece").limit(frequent).collect())
    pieces = [b" " + bytes(r.piece) for r in top]
    lengths = np.array(piece_lengths(_encoder(model_path), pieces), np.int64) if pieces else np.empty(0, np.int64)
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum([0, *map(len, pieces)])[:-1].astype(np.int64)
    return LengthTable(words.hash_runs(buf, starts), lengths)


def _counter(table, model_path: str, key: str, text: str, cache_entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tier, cache = _encoder(model_path), table.value, {}
        for batch in batches:
            sizes, counts = [], []
            for _, texts in words.slices(batch, text):
                got = np.zeros(len(texts), np.int64)
                # A literal mark reads as a space to the library and a zero byte would look like a boundary: rare, whole.
                odd = [i for i, t in enumerate(texts) if _MARK in t or b"\0" in t]
                plain = [b"" if t == b"" or _MARK in t or b"\0" in t else t for t in texts]
                buf, offsets = _buffer(plain)
                starts = pretoken_starts(buf)
                hashes = words.hash_runs(buf, starts)
                ends = np.append(starts[1:], len(buf))
                found = tier.find(hashes)
                bounds = buf[starts] == 0
                found[bounds] = 0
                miss = np.flatnonzero((found == 0) & ~bounds)
                if len(miss):
                    keys, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
                    pieces = [buf[starts[i]:ends[i]].tobytes() for i in miss[first]]
                    new = [p for p in pieces if p not in cache]
                    if len(cache) + len(new) > cache_entries:
                        cache.clear()
                        new = pieces
                    cache.update(zip(new, piece_lengths(encoder, new)))
                    found[miss] = np.array([cache[p] for p in pieces], np.int64)[back]
                sums = np.concatenate([[0], np.cumsum(found)])
                at = np.searchsorted(starts, offsets)
                got = sums[at[1:]] - sums[at[:-1]]
                for i, t in enumerate(plain):
                    if not t:
                        got[i] = 0
                for i in odd:
                    got[i] = len(encoder.encode(texts[i].decode()))
                sizes += map(len, texts)
                counts.append(got)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.concatenate(counts) if counts else [], pa.int64())],
                names=[key, "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", limit: int = 4096,
                 sample_documents: int = SAMPLE_DOCUMENTS, frequent: int = FREQUENT,
                 cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens exceed `limit`.

    One row for each input row, repeated rows and null keys included; a null or empty text has no bytes and no tokens.
    Other columns are not read, so their names may clash.  The broadcast table holds at most `frequent` lengths
    (12 bytes in two to four slots each), whatever the input; a worker's cache starts anew at `cache_entries`.
    """
    table = frequent_table(docs, model_path, text, sample_documents, frequent)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(key, text)
            .mapInArrow(_counter(shared, model_path, key, text, cache_entries), f"`{key}` {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
