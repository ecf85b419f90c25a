"""The folder that driver and executors share, for tables that cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import words


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet in the shared folder and read again; it survives lost executors."""
    folder = shared_folder(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def rows_where(docs: DataFrame, text: str, keeps: Callable[[], Callable[[list[bytes]], np.ndarray]]) -> DataFrame:
    """The rows, with all their columns, whose text a mask keeps; `keeps` makes the mask function once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = keeps()
        for batch in batches:
            masks = [keep(texts) for _, texts in words.slices(batch, text)]
            yield batch.filter(pa.array(np.concatenate(masks) if masks else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


SHARES = 2000


def joined_by_share(left: DataFrame, right: DataFrame, key: str, n: str, shares: int = SHARES) -> DataFrame:
    """Inner join with a written table `right` that has one row per key and, as `n`, how often the key occurs on the left.

    Keys with more than one in `shares` of these rows, so at most `shares` keys, are broadcast; the others are shuffled,
    and none of them is large.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * shares > total
    frequent = F.broadcast(right.where(hot))
    common = left.join(frequent, key)
    rest = left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti").join(right.where(~hot), key)
    return common.unionByName(rest)
