"""Keyword search through an index of character sequences, verified on the texts of the candidates.

The index has a row for each sequence of two or three lower-cased characters and block of postings, with the sorted ids of
the postings that hold it.  A posting that contains a keyword holds all of the keyword's sequences, so the lists of a few
rare ones, intersected block by block, contain every posting wanted.  No list is longer than a block, however common its
sequence is.

Texts are dealt to their blocks once.  A task gathers the pairs of sequence and posting of many texts as numbers and passes
them on as partial lists, so that no pair becomes a row; the partial lists of a sequence and block are then joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import search
from vacantia.sources.tables import BucketedTable

SEARCHED = ("title", "description", "cleaned_description")
INDEX_SCHEMA = "gram string, block int, n int, ids array<bigint>"
BLOCKS = 64
RAREST = 4


RUN_CHARS = 1 << 18  # characters whose sequences are sorted at once
RUN_PAIRS = 1 << 22  # pairs of sequence and posting that are gathered for partial lists
POINT_BITS = 21


def _sequences(lowered: Column, size: int) -> Column:
    """All sequences of so many code points."""
    places = F.sequence(F.lit(1), F.length(lowered) - (size - 1))
    found = F.transform(places, lambda i: F.substr(lowered, i, F.lit(size)))
    return F.when(F.length(lowered) >= size, found).otherwise(F.array().cast("array<string>"))


def _text_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, number of the text) of all sequences of two and three code points, each pair once, ordered by sequence.

    A sequence is three fields of 21 bits, code points plus one; the third is 0 where there are only two.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    letters = np.concatenate([[-1], np.flatnonzero(seen)])
    bits, text_bits = int(len(letters) - 1).bit_length(), (len(texts) - 1).bit_length()
    if 3 * bits + text_bits > 63:  # so many different letters that a sequence and a text do not share a number; fits for one text
        half = len(texts) // 2
        (left, first), (right, second) = _text_pairs(texts[:half]), _text_pairs(texts[half:])
        grams, numbers = np.concatenate([left, right]), np.concatenate([first, second + half])
        order = np.argsort(grams, kind="stable")
        return grams[order], numbers[order]
    letter = np.cumsum(seen, dtype=np.int64)[points]
    number = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    pairs = letter[:-1] << (2 * bits) | letter[1:] << bits
    triples = pairs[:-1] | letter[2:]
    keys = np.concatenate([(pairs << text_bits | number[:-1])[number[:-1] == number[1:]],
                           (triples << text_bits | number[:-2])[number[:-2] == number[2:]]])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    code, mask = keys >> text_bits, (1 << bits) - 1
    point = [letters[code >> (place * bits) & mask] + 1 for place in (2, 1, 0)]
    return point[0] << (2 * POINT_BITS) | point[1] << POINT_BITS | point[2], keys & ((1 << text_bits) - 1)


def _gram_texts(grams: np.ndarray) -> list[str]:
    points = np.stack([grams >> (2 * POINT_BITS), grams >> POINT_BITS & ((1 << POINT_BITS) - 1), grams & ((1 << POINT_BITS) - 1)], axis=1)
    held = points > 0
    whole = (points[held] - 1).astype("<u4").tobytes().decode("utf-32-le")
    ends = np.cumsum(held.sum(axis=1)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def _partial_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (gram, block, ids) for batches of (id, block, text); a sequence and block may have several."""
    texts, owners, chars, pairs, gathered = [], [], 0, [], 0

    def sort_texts() -> int:
        grams, numbers = _text_pairs(texts)
        own = np.array(owners, np.int64).reshape(-1, 2)[numbers]
        pairs.append((grams, own[:, 0], own[:, 1]))
        return len(grams)

    def lists() -> Iterator[pa.RecordBatch]:
        grams, ids, blocks = (np.concatenate(column) for column in zip(*pairs))
        for block in np.unique(blocks):
            mine = blocks == block
            gram, held = grams[mine], ids[mine]
            order = np.argsort(gram, kind="stable")
            gram, held = gram[order], held[order]
            starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            offsets = np.append(starts, len(gram)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_gram_texts(gram[starts]), pa.string()), pa.array(np.full(len(starts), block, np.int32)),
                 pa.ListArray.from_arrays(offsets, pa.array(held))], names=["gram", "block", "ids"])

    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()))
        for number, block, value in rows:
            one = value.as_py().decode("utf-8", "replace")
            texts.append(one)
            owners.append((number, block))
            chars += len(one)
            if chars >= RUN_CHARS:
                gathered += sort_texts()
                texts, owners, chars = [], [], 0
            if gathered >= RUN_PAIRS:
                yield from lists()
                pairs, gathered = [], 0
    if texts:
        sort_texts()
    if pairs:
        yield from lists()


def index_keywords(jobs: DataFrame, blocks: int = BLOCKS, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """The index (gram, block, n, ids) of postings with an `id`; null texts count as empty, repeated ids as one.

    A list holds up to 1 / `blocks` of all ids; with some 50,000 ids a block, lists stay well under a megabyte.
    """
    if blocks < 1:
        raise ValueError("an index has at least one block")
    whole = F.concat_ws("\n", *[F.lower(F.col(c)) for c in columns])
    number = F.col("id").cast("bigint")
    held = jobs.filter(F.col("id").isNotNull()).select(
        number.alias("id"), F.pmod(F.xxhash64(number), F.lit(blocks)).cast("int").alias("block"), whole.alias("_text"))
    partial = held.repartition("block").mapInArrow(_partial_lists, "gram string, block int, ids array<bigint>")
    lists = partial.groupBy("gram", "block").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return lists.select("gram", "block", F.size("ids").alias("n"), "ids")


def keyword_grams(spark: SparkSession, keyword: str) -> list[str]:
    """The sequences that a text holding the keyword must have; `%` and `_` match anything and are in none.

    Three characters each, two where the keyword has no three in a row; none if it has no two.  Spark lowers the pattern as
    it lowers the texts.
    """
    runs = F.split(F.lower(F.lit(f"%{keyword}%")), r"(?s)\\.|[%_]")
    found = spark.range(1).select(
        *[F.array_distinct(F.flatten(F.transform(runs, lambda r: _sequences(r, size)))).alias(f"g{size}") for size in (3, 2)]
    ).first()
    return found["g3"] or found["g2"]


def candidates(index: DataFrame, keyword: str, rarest: int = RAREST) -> DataFrame | None:
    """(id, like): the postings whose texts may hold the keyword, with its pattern; None if the index cannot tell.

    Only list lengths are read to choose the rarest sequences; one without any list rules out every posting.
    """
    grams = keyword_grams(index.sparkSession, keyword)
    if not grams:
        return None
    mine = index.filter(F.col("gram").isin(grams))
    sizes = {r["gram"]: r["n"] for r in mine.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    chosen = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[: max(rarest, 1)]
    lists = index.filter(F.col("gram").isin(chosen)).groupBy("block").agg(
        F.collect_list("ids").alias("lists"),
        # An aggregate, not a literal, or the optimizer would test the texts of all postings before the join.
        F.max(F.lit(f"%{keyword}%")).alias("like"),
    )
    common = F.aggregate(F.slice("lists", 2, len(chosen)), F.col("lists")[0], F.array_intersect)
    return lists.filter(F.size("lists") == len(chosen)).select(F.explode(common).alias("id"), "like")


def holding(jobs: DataFrame, index: DataFrame, keyword: str | None, rarest: int = RAREST) -> DataFrame:
    """The postings that `matching(jobs, keyword)` gives, found through the index of these postings.

    Only candidates are compared with the keyword.  Keywords under two characters filter nothing, and those made of
    wildcards alone are compared with every posting.
    """
    keyword = (keyword or "").strip()
    found = candidates(index, keyword, rarest) if len(keyword) >= 2 else None
    if found is None:
        return search.matching(jobs, keyword)
    columns = jobs.columns
    met = jobs.join(found.withColumnsRenamed({"id": "_id", "like": "_like"}), F.col("id") == F.col("_id"))
    tests = " OR ".join(f"{c} ILIKE _like" for c in SEARCHED)
    return met.filter(F.expr(tests)).select(*columns)


def holding_stored(table: BucketedTable, index_table: BucketedTable, keyword: str | None, rarest: int = RAREST) -> DataFrame:
    """`holding` over two bucketed tables, postings by `id` and the index by `gram`: only buckets that matter are read."""
    keyword = (keyword or "").strip()
    grams = keyword_grams(table.spark, keyword) if len(keyword) >= 2 else []
    if not grams:
        return holding(table.read(), index_table.read(buckets=[]), keyword, rarest)
    asked = table.spark.createDataFrame([(g,) for g in grams], "gram string")
    index = index_table.read(buckets=index_table.buckets_of(asked, F.col("gram")))
    found = candidates(index, keyword, rarest)
    return holding(table.read(buckets=table.buckets_of(found, F.col("id"))), index, keyword, rarest)
