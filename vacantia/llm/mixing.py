"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target in words.  A document's expected copies are near its source's factor (target over size): the
whole part of the factor is allocated for certain, the rest is drawn.  Documents are ranked by random odds divided by
inclusion odds, U/(1-U) over p/(1-p), and the first ones are taken until their words come nearest to what the source
still needs: a sample of fixed size with unequal probabilities.  No source is sorted as a whole: the cut is found by
two rounds of histogram sums, and only rows of one cell in a million are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.shared import written

CELLS = 1024
PREFERENCE = 0.5
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, source: str, weights: tuple[float, ...]) -> DataFrame:
    """Weights dealt to the sources in code-point order, null last, repeating.  One row per source is ordered."""
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    return sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
                              .cast("double"))


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds `target` in words: `share` of all words dealt by `_weight`, at most `most` times a source's own words.

    What a full source cannot take goes to the others by weight.  Sources fill up in the order of limit over weight,
    so the full ones are a prefix of that order and one pass of running sums over the small table finds it.
    """
    limit = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(limit / F.col("_weight"), F.col("_place"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = (sources.withColumn("_place", F.xxhash64("_source"))
              .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
              .withColumn("_weights", F.sum("_weight").over(everything))
              .withColumn("_used", F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
              .withColumn("_gone", F.coalesce(F.sum("_weight").over(before), F.lit(0.0))))
    # After the first source that is not full the level only falls, so the highest level of a source not full is it.
    level = (F.col("_total") - F.col("_used")) / (F.col("_weights") - F.col("_gone"))
    full = level * F.col("_weight") >= limit
    levelled = filled.withColumn("_full", full).withColumn("_level", F.max(F.when(~full, level)).over(everything))
    return levelled.select("_source", "source_size", "_liked", F.when(F.col("_full"), limit).otherwise(
        F.coalesce(F.col("_level") * F.col("_weight"), limit)).alias("target"))


def _nearest(rows: DataFrame, level: int) -> DataFrame:
    """Narrows every source to the cell of its histogram in which the words still needed end."""
    cell = F.floor(F.col("_place") * F.lit(float(CELLS ** level))).cast("long")
    rows = rows.withColumn("_cell", cell)
    cells = rows.groupBy("_source", "_cell").agg(F.sum("_size").alias("_in"), F.first("_need").alias("_need"))
    order = Window.partitionBy("_source").orderBy("_cell")
    cells = cells.withColumn("_upto", F.sum("_in").over(order))
    cut = (cells.where(F.col("_upto") >= F.col("_need")).groupBy("_source")
           .agg(F.min(F.struct("_cell", (F.col("_need") - F.col("_upto") + F.col("_in")).alias("_rest"))).alias("_cut")))
    return cut.select("_source", F.col("_cut._cell").alias(f"_cell{level}"), F.col("_cut._rest").alias(f"_rest{level}"))


def _keyed(name: Column) -> Column:
    """A source as a name that is never null."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit(""))


def _small(frame: DataFrame, name: str) -> DataFrame:
    """A table of a row per source, written, and broadcast while it has at most BROADCAST_SOURCES rows."""
    frame = written(frame, name)
    return F.broadcast(frame) if frame.count() <= BROADCAST_SOURCES else frame


def _sized(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    return docs.select("*", _keyed(F.col(source).cast("string")).alias("_source"), word_count(F.col(text)).alias("_size"),
                       F.xxhash64(F.col(key), F.col(text), F.lit(seed)).alias("_hash"))


def _ranked(sized: DataFrame, goals: DataFrame, preference: float) -> DataFrame:
    """Adds the inclusion probability of a further copy and the Pareto rank, as a place between 0 and 1."""
    p = F.col("_part") + F.lit(float(preference)) * F.least("_part", 1 - F.col("_part")) * (_liking() - F.col("_mean"))
    u = (F.shiftrightunsigned("_hash", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    rank = (u / (1 - u)) / (F.col("inclusion") / (1 - F.col("inclusion")))
    return (sized.join(goals, "_source").withColumn("inclusion", p)
            .withColumn("_place", F.when((F.col("inclusion") > 0) & (F.col("_size") > 0), 1 - 1 / (1 + rank))))


def _liking() -> Column:
    return F.col("_size") / (F.col("_size") + F.lit(512.0))


def sampling_plan(sized: DataFrame, weights: tuple[float, ...], share: float, most: float, preference: float) -> DataFrame:
    """A row per source: source_size, target, the certain copies and the place up to which documents get one more."""
    sums = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.sum(_liking() * F.col("_size")).alias("_liked"))
    sums = sums.withColumn("_name", F.when(F.col("_source") != "", F.substring("_source", 2, 1 << 30)))
    goals = targets(cycled_weights(sums, "_name", weights), share, most)
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = (goals.withColumn("_sure", F.floor(factor + F.lit(1e-9)))
             .withColumn("_part", F.greatest(F.lit(0.0), factor - F.col("_sure")))
             .withColumn("_need", F.greatest(F.lit(0.0), F.col("target") - F.col("_sure") * F.col("source_size")))
             .withColumn("_mean", F.coalesce(F.col("_liked") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))).drop("_liked"))
    goals = _small(goals, "mix-goals")
    drawn = (_ranked(sized, goals, preference).where(F.col("_place").isNotNull() & (F.col("_need") > 0))
             .select("_source", "_size", "_place", "_need"))
    first = _small(_nearest(drawn, 1), "mix-cells")
    inner = (drawn.join(first, "_source").where(F.floor(F.col("_place") * float(CELLS)) == F.col("_cell1"))
             .select("_source", "_size", "_place", F.col("_rest1").alias("_need")))
    second = _small(_nearest(inner, 2), "mix-cells")
    edge = inner.drop("_need").join(second, "_source").where(F.floor(F.col("_place") * float(CELLS ** 2)) == F.col("_cell2"))
    # Equal places are one step of the running sum, so repeated rows are all taken or none.
    upto = F.sum("_size").over(Window.partitionBy("_source").orderBy("_place").rangeBetween(Window.unboundedPreceding, 0))
    cuts = (edge.withColumn("_before", upto - F.col("_size") / 2).groupBy("_source")
            .agg(F.max(F.when(F.col("_before") <= F.col("_rest2"), F.col("_place"))).alias("_last"), F.min("_place").alias("_least")))
    # If none of the last cell is taken, the cut is just before its first place.
    cut = F.coalesce("_last", F.col("_least") - F.lit(2.0 ** -53))
    return _small(goals.join(cuts, "_source", "left").withColumn("_cut", F.coalesce(cut, F.lit(-1.0))).drop("_last", "_least"), "mix-plan")


def pareto_mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
               weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1,
               preference: float = PREFERENCE) -> DataFrame:
    """One row per input row: key, size, source, source_size, target, inclusion, copies and taken (words, all copies).

    `preference` makes longer documents likelier within their source's expected words; 0 treats all alike.  Reruns agree,
    since the random numbers are hashes of key and text.  A null source is a source of its own, the last.  Empty and null
    texts have size 0 and only their certain copies.  Repeated rows share their random number and are all taken or none.
    A source without words has target 0.  Only the three named columns are read, so other columns may have any name.
    The table of sources (a row per source) is ordered in one task; documents never are.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(source).alias("_from"))
    sized = written(_sized(rows, "_key", "_text", "_from", seed).select("_key", "_source", "_size", "_hash"), "mix-sizes")
    plan = sampling_plan(sized, weights, share, most, preference)
    copies = _copies()
    return _ranked(sized, plan, preference).select(
        F.col("_key").alias(key), F.col("_size").alias("size"),
        F.when(F.col("_source") != "", F.substring("_source", 2, 1 << 30)).alias("source"),
        "source_size", "target", "inclusion", copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def _copies() -> Column:
    return (F.col("_sure") + F.coalesce((F.col("_place") <= F.col("_cut")).cast("int"), F.lit(0))).cast("long")


def mixed_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
                    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1,
                    preference: float = PREFERENCE) -> DataFrame:
    """The rows of `docs` with all their columns, each as often as the mix takes it."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    named = rows.select("_row", *[F.col("_row").getField(c).alias(n) for c, n in ((key, "_key"), (text, "_text"), (source, "_from"))])
    sized = _sized(named, "_key", "_text", "_from", seed).drop("_key", "_text", "_from")
    narrow = written(sized.select("_source", "_size", "_hash"), "mix-sizes")
    plan = sampling_plan(narrow, weights, share, most, preference)
    taken = _ranked(sized, plan, preference).select("_row", F.explode(F.array_repeat(F.lit(1), _copies().cast("int"))))
    return taken.select("_row.*")
