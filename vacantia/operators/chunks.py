"""Chunks: overlapping passages of each posting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.functions import text

ATTRIBUTES = ["title", "company", "location", "category", "seniority"]


def indexed_text():
    """Cleaned text, else the raw description; null when both are empty."""
    return text.first_filled(F.col("cleaned_description"), F.col("description"))


def chunk_documents(jobs: DataFrame) -> DataFrame:
    """One row per passage, keyed by (job_id, chunk_order).  A projection: no shuffle and no Python."""
    # The outer form keeps the optimizer from adding filters that would chunk every text a second time.
    passages = F.posexplode_outer(text.chunk_text(indexed_text())).alias("chunk_order", "chunk_text")
    cut = jobs.select(F.col("id").alias("job_id"), *ATTRIBUTES, passages).filter("chunk_text IS NOT NULL")
    return cut.withColumn("chunk_length", F.length("chunk_text"))


RANGES_PER_BLOCK = 4096


def with_chunk_ids(chunks: DataFrame, jobs_per_group: int = 65536) -> DataFrame:
    """Add the dense chunk_id in (job_id, chunk_order) order.

    Passages are counted per range of job ids, running totals are kept inside blocks of ranges and over the blocks, and
    a row number counts inside each range.  What one task orders last is a row for each block, some 270 million ids.
    """
    chunks = chunks.withColumn("_range", F.floor(F.col("job_id") / jobs_per_group))
    block = F.floor(F.col("_range") / RANGES_PER_BLOCK)
    totals = chunks.groupBy("_range").count().withColumn("_block", block)

    def before(window):
        return window.rowsBetween(Window.unboundedPreceding, -1)

    blocks = totals.groupBy("_block").agg(F.sum("count").alias("_n"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_n").over(before(Window.orderBy("_block"))), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum("count").over(before(Window.partitionBy("_block").orderBy("_range"))), F.lit(0))
    offsets = totals.withColumn("_within", within).join(blocks, "_block").select("_range", (F.col("_base") + F.col("_within")).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy("job_id", "chunk_order")
    return (
        chunks.join(offsets, "_range")
        .withColumn("chunk_id", F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_range", "_offset")
    )


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """Passages and postings with passages.  Counted per posting first, so the distinct count is a plain count."""
    per_job = chunks.groupBy("job_id").agg(F.count("*").alias("n"))
    return per_job.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"), F.count("*").alias("job_count"))


def replace_chunks(existing: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Existing passages of untouched postings plus the fresh ones."""
    keep = existing.join(touched.select("job_id").distinct(), "job_id", "left_anti")
    return keep.select(fresh.columns).unionByName(fresh)
