"""Benchmark decontamination by pigeonhole edit matching.

An item with error budget k is split into k + 1 pieces: k edits can spoil k of them at most, so every occurrence holds
one piece exactly.  An automaton finds all pieces in every whole text in one pass; each place that a hit implies is
verified with Myers' bit-parallel distance.  Items come in blocks of bounded size, so the automaton never outgrows a task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import shared, words

ERROR_SHARE = 0.08
BLOCK_CHARS = 1_000_000
_GAPS = re.compile(r"[\W_]+")


def normalized(text: str) -> str:
    """Lower case; every run of characters other than letters and digits is one space, none at the ends."""
    return _GAPS.sub(" ", text.lower()).strip()


def budget(length: int, share: float) -> int:
    return int(length * share)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item cut into k + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def best_end(length: int, table: dict[str, int], text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of the text, and the first end where it is reached."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best, end = length, 0
    for i, c in enumerate(text):
        equal = table.get(c, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
        if score < best:
            best, end = score, i + 1
    return best, end


class PieceFinder:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        import ahocorasick

        self.items, self.share = items, share
        self.k = [budget(len(t), share) for _, t in items]
        self.masks = [masks(t) for _, t in items]
        owners = defaultdict(list)
        for i, (_, t) in enumerate(items):
            for offset, piece in pieces(t, self.k[i]):
                owners[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item number, distance, end) of every item within its budget in a normalised text: its best place."""
        if not self.any:
            return []
        places = defaultdict(list)
        for last, (length, own) in self.automaton.iter(text):
            for i, offset in own:
                places[i].append(last + 1 - length - offset)
        out = []
        for i, starts in places.items():
            size, k = len(self.items[i][1]), self.k[i]
            best, end, low, high = k + 1, 0, None, None
            for s in [*sorted(starts), None]:  # places whose windows meet are verified together
                if low is not None and (s is None or s - k > high):
                    a = max(low, 0)
                    distance, at = best_end(size, self.masks[i], text[a:high])
                    if distance < best:
                        best, end = distance, a + at
                    low = None
                    if best == 0:
                        break
                if s is not None:
                    low, high = s - k if low is None else low, s + size + k
            if best <= k:
                out.append((i, best, end))
        return out


def _finder(block, share: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = PieceFinder(block.value, share)
        for batch in batches:
            rows, hits = [], []
            for at, texts in words.slices(batch, text):
                for i, t in enumerate(texts):
                    for hit in finder.find(normalized(t.decode())):
                        rows.append(at + i)
                        hits.append(hit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([finder.items[i][0] for i, _, _ in hits], pa.int64()),
                 pa.array([d for _, d, _ in hits], pa.int64()), pa.array([finder.k[i] for i, _, _ in hits], pa.int64()),
                 pa.array([e for _, _, e in hits], pa.int64())],
                names=[batch.schema.names[0], "item_id", "distance", "budget", "end"])
    return run


def find_items(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", error_share: float = ERROR_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key, item_id, distance, budget, end: a row for each row of `docs` and item found in it, at its best place.

    Both sides are compared in lower case with runs of other characters than letters and digits as one space; `end` is
    a place in that form.  An item of n characters may differ by `error_share` * n edits.  Items and texts that are null
    or empty in that form match nothing; items with a null id are left out; repeated items with one id count once each
    by text, repeated documents each give their rows.  Items are dealt to as many blocks as their total length asks
    for, each broadcast with about `block_chars` characters, and every block passes over all documents.
    """
    kind = docs.schema[key].dataType.simpleString()
    found = [docs.select(key, text).mapInArrow(
        _finder(block, error_share, text), f"`{key}` {kind}, item_id long, distance long, budget long, `end` long")
        for block in item_blocks(items, item_key, item_text, block_chars)]
    return reduce(DataFrame.unionByName, found)


def item_blocks(items: DataFrame, item_key: str, item_text: str, block_chars: int) -> list[Broadcast]:
    """The items, normalised, as broadcasts of about `block_chars` characters each."""
    clean = items.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("words")).dropna()
    total = clean.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    dealt = clean.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    out = []
    for b in range(blocks):
        rows = sorted({(r["item"], normalized(r["words"])) for r in dealt.where(F.col("block") == b).collect()})
        out.append(items.sparkSession.sparkContext.broadcast([r for r in rows if r[1]]))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id",
                      item_text: str = "text", error_share: float = ERROR_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs` in which no item is found, with all their columns; one pass for each block of items."""
    def keeps(block: Broadcast):
        def make():
            finder = PieceFinder(block.value, error_share)
            return lambda texts: np.array([not finder.find(normalized(t.decode())) for t in texts], bool)
        return make

    for block in item_blocks(items, item_key, item_text, block_chars):
        docs = shared.rows_where(docs, text, keeps(block))
    return docs


def contaminated(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """A row per key with a match: key, n_items (distinct) and the best distance."""
    return find_items(docs, items, key=key, **options).groupBy(key).agg(
        F.countDistinct("item_id").alias("n_items"), F.min("distance").alias("distance"))
