"""Spelling variants: words one edit apart, found by probing generated edits against broadcast Bloom filters.

The vocabulary is split by word length into shards, each with a blocked Bloom filter.  Every word generates its deletions
(probed in the filter one shorter) and the replacements of a letter by a later one (probed in its own), which forms each near
pair once.  Only edits that a filter lets pass are shuffled, to an equality join with the vocabulary that removes the
false ones.  A word takes the near word of largest count as its form if that count is ten times its own; roots follow
forms by pointer doubling (counts grow tenfold a step, so chains are short and without cycles).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import written
from vacantia.llm.words import mix

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10  # a form is this many times as frequent as its variant
VARIED = 31  # one run in so many loses a code point
LONG = 64  # words from this length on share a shard
BITS_PER_WORD = 16
HASHES = 6
BLOCK_WORDS = 8  # 64-bit words of a block, 512 bits
PIECE = 4096  # blocks that one task fills at once, a quarter of a MB
FILTER_BYTES = 64 << 20  # broadcast at once; a larger vocabulary is probed in several rounds
SEGMENT = 1 << 20
HELD = 1 << 17  # distinct words that a worker counts before it hands them on
PROBES = 1 << 17  # edits tested at once
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
_RANDOM = np.random.default_rng(20240611)
_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_CODES = np.full(256, 255, np.uint8)  # code point to place in LETTERS
_CODES[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


def _pieces(text: str) -> Iterator[str]:
    """The text in parts of bounded size that end between runs; only a longer run makes a longer part."""
    at = 0
    while len(text) - at > SEGMENT:
        end = _BREAK.search(text, at + SEGMENT)
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def _count_words(least: int, varied: int):
    pattern = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        size = 0

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                start = zlib.crc32(f"{key}:".encode())
                for piece in _pieces((text.as_py() or b"").translate(_LOWER).decode("utf-8", "replace")):
                    for word, n in Counter(pattern.findall(piece)).items():
                        h = zlib.crc32(word.encode(), start)
                        if varied and h % varied == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least:
                                continue
                        counts[word] += n
                        size += len(word)
                    if len(counts) > HELD or size > 16 * HELD:
                        yield handed()
                        size = 0
        yield handed()
    return run


def vocabulary(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT, varied: int = VARIED) -> DataFrame:
    """(word, n, length) of all words of at least `least_length` code points found `least_count` times.

    `varied` plants misspellings by a hash of key and run, 0 leaves the runs as they are.  Null and empty texts hold no words;
    a null key counts as an empty one; repeated rows count again; other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_count_words(least_length, varied), "word string, n long")
    found = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    return found.withColumn("length", F.length("word"))


def _shard(length: np.ndarray) -> np.ndarray:
    return np.minimum(length, LONG)


def _coded(words: list[str], length: int) -> np.ndarray:
    """Places in LETTERS of words of one length, a row each."""
    return _CODES[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(len(words), length)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Each length that occurs and the places of its words, at most so many letters at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        step = max(1, (1 << 20) // int(length))
        for a in range(0, len(at), step):
            yield int(length), at[a:a + step]


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _bit(hashes: np.ndarray, i: int) -> np.ndarray:
    """The i-th of a word's bits inside its block, from a second hash."""
    return (hashes >> np.uint64(9 * i)) & np.uint64(511)


def _placed(blocks: dict[int, int]):
    """Shard, piece, block and second hash of every word, and the letters that a batch has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            shard, block, second = (np.empty(len(words), t) for t in (np.int32, np.int64, np.uint64))
            for length, at in _by_length(words):
                coded = _coded([words[i] for i in at], length)
                hashes = mix((_VALUES[coded] * _powers(length)).sum(axis=1, dtype=np.uint64))
                shard[at] = s = min(length, LONG)
                block[at] = _block(hashes, blocks[s]).astype(np.int64)
                second[at] = mix(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(block // PIECE), pa.array(block % PIECE), pa.array(second.view(np.int64))],
                                             names=["shard", "piece", "block", "second"])
    return run


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter piece of each run of rows of one shard and piece."""
    held, bits = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int64()), pa.array([bits.tobytes()], pa.binary())],
                                          names=["shard", "piece", "bits"])

    for batch in batches:
        shard, piece, block, second = (batch.column(i).to_numpy() for i in range(4))
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(piece) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(shard)]):
            if a == b:
                continue
            if held != (shard[a], piece[a]):
                if held is not None:
                    yield row()
                held, bits = (shard[a], piece[a]), np.zeros((PIECE, BLOCK_WORDS), np.uint64)
            for i in range(HASHES):
                bit = _bit(second[a:b].view(np.uint64), i)
                np.bitwise_or.at(bits, (block[a:b], (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    if held is not None:
        yield row()


@dataclass
class Filter:
    """The blocks from `first` on of one shard's filter of `blocks` blocks."""

    blocks: int
    first: int
    bits: np.ndarray

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may belong to words of these blocks."""
        hashes = mix(hashes)
        block = _block(hashes, self.blocks).astype(np.int64) - self.first
        at = np.flatnonzero((block >= 0) & (block < len(self.bits) // BLOCK_WORDS))
        block, second = block[at] * BLOCK_WORDS, mix(hashes[at])
        for i in range(HASHES):
            bit = _bit(second, i)
            hit = np.flatnonzero((self.bits[block + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
            at, block, second = at[hit], block[hit], second[hit]
        return at


def _rounds(blocks: dict[int, int], most: int) -> list[list[tuple[int, int, int]]]:
    """Shards or ranges of their pieces (shard, first, end) that together stay below `most` bytes."""
    room = max(1, most // (PIECE * BLOCK_WORDS * 8))
    rounds, free = [[]], room
    for shard, n in sorted(blocks.items()):
        at, pieces = 0, -(-n // PIECE)
        while at < pieces:
            if not free:
                rounds.append([])
                free = room
            take = min(free, pieces - at)
            rounds[-1].append((shard, at, at + take))
            at, free = at + take, free - take
    return rounds


def _edits(coded: np.ndarray, filters: dict[int, Filter], letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, position, letter or -1 for a deletion) of all edits of words of one length that pass a filter."""
    n, length = coded.shape
    powers = _powers(length)
    terms = _VALUES[coded] * powers
    sums = np.cumsum(terms, axis=1, dtype=np.uint64)
    whole = sums[:, -1]
    shorter, same = filters.get(min(length - 1, LONG)), filters.get(min(length, LONG))
    if shorter is not None:
        hashes = (sums - terms) + (whole[:, None] - sums) * _INVERSE
        fresh = np.ones_like(coded, bool)
        fresh[:, 1:] = coded[:, 1:] != coded[:, :-1]  # the same letter twice gives one deletion
        at = np.flatnonzero(fresh)
        at = at[shorter.passes(hashes.ravel()[at])]
        yield at // length, at % length, np.full(len(at), -1)
    if same is not None and len(letters):
        step = max(1, PROBES // (n * len(letters)))
        for p in range(0, length, step):
            own = coded[:, p:p + step]
            changed = (_VALUES[letters][None, None, :] - _VALUES[own][:, :, None]) * powers[p:p + step][None, :, None] + whole[:, None, None]
            at = np.flatnonzero(letters[None, None, :] > own[:, :, None])
            at = at[same.passes(changed.ravel()[at])]
            word, rest = np.divmod(at, own.shape[1] * len(letters))
            yield word, p + rest // len(letters), letters[rest % len(letters)].astype(np.int64)


def _probed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, letters = shared.value
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for length, at in _by_length(words):
                own = [words[i] for i in at]
                for word, place, letter in _edits(_coded(own, length), filters, letters):
                    if not len(word):
                        continue
                    edited = [(w := own[i])[:p] + (LETTERS[c] if c >= 0 else "") + w[p + 1:] for i, p, c in zip(word.tolist(), place.tolist(), letter.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in word.tolist()], pa.string()), pa.array(counts[at[word]]), pa.array(edited, pa.string())],
                                                     names=["word", "n", "other"])
    return run


def near_pairs(known: DataFrame, *, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n) of all pairs of words one edit apart, each once, of a written vocabulary (word, n, length).

    The filters pass through the driver round by round, each round at most `filter_bytes`; words of lengths that a round
    does not concern are not read in it.
    """
    spark = known.sparkSession
    sizes = {r["shard"]: r["count"] for r in known.groupBy(F.least("length", F.lit(LONG)).alias("shard")).count().collect()}  # LONG rows at most
    blocks = {s: -(-n * BITS_PER_WORD // (BLOCK_WORDS * 64)) for s, n in sizes.items()}
    used = known.select(F.explode(F.split("word", "")).alias("letter")).distinct().collect()  # the letters of LETTERS at most
    letters = np.sort(np.array([LETTERS.index(r["letter"]) for r in used if r["letter"]], np.uint8))
    placed = known.select("word").mapInArrow(_placed(blocks), "shard int, piece long, block long, second long")
    pieces = written(placed.repartition("shard", "piece").sortWithinPartitions("shard", "piece").mapInArrow(_filled, "shard int, piece long, bits binary"), "word-filters")
    found = None
    for parts in _rounds(blocks, filter_bytes):
        filters, lengths = {}, F.lit(False)
        for shard, first, end in parts:
            rows = pieces.where((F.col("shard") == shard) & (F.col("piece") >= first) & (F.col("piece") < end)).collect()  # filter_bytes a round
            bits = np.zeros(((end - first) * PIECE, BLOCK_WORDS), np.uint64)
            for r in rows:
                a = (r["piece"] - first) * PIECE
                bits[a:a + PIECE] = np.frombuffer(r["bits"], np.uint64).reshape(PIECE, BLOCK_WORDS)
            filters[shard] = Filter(blocks[shard], first * PIECE, bits[:min(end * PIECE, blocks[shard]) - first * PIECE].ravel())
            lengths = lengths | ((F.col("length") >= shard) if shard == LONG else F.col("length").isin(shard, shard + 1))
        if filters:
            shared = spark.sparkContext.broadcast((filters, letters))
            positive = known.where(lengths).select("word", "n").mapInArrow(_probed(shared), "word string, n long, other string")
            found = positive if found is None else found.unionByName(positive)
    if found is None:
        return spark.createDataFrame([], "word string, n long, other string, other_n long")
    return found.join(known.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words that have a form, by pointer doubling."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(onward, "root", "left_semi").isEmpty():
            return now
        now = written(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def variants(docs: DataFrame, *, times: int = TIMES, filter_bytes: int = FILTER_BYTES, **options) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary; options as in `vocabulary`.

    Near words are those one inserted, deleted or replaced code point away.  The form is the near word of largest count (ties:
    the smallest by code point) if its count is `times` the word's; else form and form_n are null and the root is the word itself.
    An empty table gives no rows.
    """
    known = written(vocabulary(docs, **options), "vocabulary")
    pairs = near_pairs(known, filter_bytes=filter_bytes)
    sides = F.array(*(F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(c).alias("near_n"))
                      for a, b, c in (("word", "other", "other_n"), ("other", "word", "n"))))
    both = pairs.select(F.inline(sides))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    met = known.select("word", "n").join(best, "word", "left")
    taken = -F.col("best.least") >= times * F.col("n")
    table = written(met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"),
                               F.when(taken, -F.col("best.least")).alias("form_n")), "forms")
    roots = _roots(table.where(F.col("form").isNotNull()))
    return table.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
