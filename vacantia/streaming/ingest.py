"""Incremental ingest and derivation: each micro-batch of snapshot rows is upserted and derived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia.plans.pipeline import Pipeline


def ingest_stream(stream: DataFrame, pipeline: Pipeline, checkpoint: str, derive: bool = True, **trigger) -> StreamingQuery:
    """Start the stream.  A repeated batch changes nothing: its rows are then equal to the stored ones by hash,
    and the derive stages handle only rows still marked as not done."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        if "ordinal" not in batch.columns:
            batch = batch.withColumn("ordinal", F.monotonically_increasing_id())
        pipeline.ingest(batch, source_name=f"batch {batch_id}")
        if derive:
            pipeline.process()
            pipeline.embed()
            pipeline.chunk()

    writer = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
