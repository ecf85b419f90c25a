"""Sliding-window admission: per key at most N admitted requests within the last W seconds.

A request is rejected when N admitted ones are at most W old; rejected requests are not remembered, so the
decision depends on earlier decisions and no range count gives it.

A key may hold a large share of all rows, so a key is never one group.  Requests are dealt into ranges of (key, time, id),
which cut a large key wherever it has to be.  The state at the end of a range follows from the range alone if its last key
begins there, or if there is a moment where the state does not depend on what came before (`_known_end`); the ranges behind
start from it at once.  Only a range whose one key is over its limit throughout waits for the one before: runs of such
ranges are walked in order, batch by batch, with the at most N times held as the only state.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions import rules, text
from vacantia.session import ensure_checkpoint_dir

MICROS = 1_000_000
ROW_BITS = 33  # a row's number is its range's number and its place in the range, in this many bits


def client_key(forwarded_for: Column, host: Column) -> Column:
    """First address of a forwarded list, else the host, else 'unknown'."""
    listed = F.when(F.length(forwarded_for) > 0, text.strip(F.split_part(forwarded_for, F.lit(","), F.lit(1))))
    return F.coalesce(listed, host, F.lit("unknown"))


def admit(times: np.ndarray, held: list[int], limit: int, window: int) -> tuple[np.ndarray, list[int]]:
    """Decide sorted times given the admitted times still held; jumps over runs of rejections."""
    admitted = np.zeros(len(times), dtype=bool)
    held = list(held)
    i, n = 0, len(times)
    while i < n:
        now = int(times[i])
        held = held[bisect_right(held, now - window - 1):]
        if len(held) < limit:
            admitted[i] = True
            held.append(now)
            i += 1
        elif limit <= 0:
            break
        else:
            i = int(np.searchsorted(times, held[0] + window, side="right"))
    return admitted, held


def _known_end(times: np.ndarray, begin: int, end: int, limit: int, window: int) -> list[int] | None:
    """State at the end of the slice [begin, end) if it follows from the slice alone.

    A request with at most N requests in its last W (itself included) is admitted whatever came before.  At a
    moment when all requests of the last W are of that kind, they are the state.  The end of the slice counts
    as such a moment, so only a slice in which its key is over the limit throughout stays open.
    """
    moments = np.append(times, end)
    place = np.arange(len(moments))
    behind = np.searchsorted(times, moments - window, side="left")
    seen = moments - window >= begin
    sure = (place - behind + 1 <= limit) & seen
    unsure_before = np.concatenate([[0], np.cumsum(~sure)])
    settled = seen & (unsure_before[place] == unsure_before[behind])
    at = np.flatnonzero(settled)
    if len(at) == 0:
        return None
    start = int(at[-1])
    return admit(times[start:], times[behind[start]:start].tolist(), limit, window)[1]


def _key_runs(keys: pa.Array) -> list[tuple[object, int, int]]:
    """(key, start, end) of the runs of equal keys, null being a key like others."""
    if not len(keys):
        return []
    null = np.asarray(keys.is_null())
    other = np.asarray(pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)), False))
    cuts = [0, *(np.flatnonzero(other | (null[1:] != null[:-1])) + 1).tolist(), len(keys)]
    return [(keys[a].as_py(), a, b) for a, b in zip(cuts[:-1], cuts[1:])]


def _summaries(limit: int, window: int, schema: pa.Schema):
    """A row for each range that has requests: its ends, and what of the last key's state they tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, one_key, state, times = None, None, None, True, [], []
        for batch in batches:
            at = batch["at"].to_numpy()
            for key, a, b in _key_runs(batch["key"]):
                if part is None:
                    part, first = batch["row"][0].as_py() >> ROW_BITS, key
                elif key != last:
                    one_key, state, times = False, [], []
                last = key
                if one_key:
                    times.append(at[a:b])
                state = admit(at[a:b], state, limit, window)[1]
        if part is not None:
            known = None
            if limit <= 0:
                known = []
            elif one_key:
                every = np.concatenate(times)
                # Requests of the range before may be as late as the first one here.
                known = _known_end(every, int(every[0]) + 1, int(every[-1]), limit, window)
            row = {"part": part, "first_key": first, "last_key": last, "one_key": one_key, "fresh": state, "known": known}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def _chain_ends(limit: int, window: int):
    """End states of the ranges of each run, whose rows come in order; the first row of a run brings the state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = None, []
        for batch in batches:
            parts, at, held = batch["part"].to_numpy(), batch["at"].to_numpy(), batch["held"]
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            done = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if part is not None and part != parts[a]:
                    done.append((part, state))
                if held[a].is_valid:
                    state = held[a].as_py()
                part = int(parts[a])
                state = admit(at[a:b], state, limit, window)[1]
            yield _ends(done)
        if part is not None:
            yield _ends([(part, state)])

    return run


def _ends(done: list[tuple[int, list[int]]]) -> pa.RecordBatch:
    columns = [pa.array([p for p, _ in done], pa.int64()), pa.array([s for _, s in done], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "walked"])


def _decisions(limit: int, window: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last, state = False, None, []
        for batch in batches:
            at, admitted = batch["at"].to_numpy(), np.zeros(len(batch), dtype=bool)
            for key, a, b in _key_runs(batch["key"]):
                if not begun:
                    begun, state = True, batch["held"][0].as_py() or []
                elif key != last:
                    state = []
                last = key
                admitted[a:b], state = admit(at[a:b], state, limit, window)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["request_id"], pa.array(admitted)], names=names)

    return run


def decide(
    requests: DataFrame,
    key: str,
    time: str,
    request_id: str,
    limit: int = rules.RATE_LIMIT_REQUESTS,
    window_seconds: float = rules.RATE_LIMIT_WINDOW_SECONDS,
    slice_seconds: float | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Requests with `admitted`.  Requests at the same time are taken in id order; a null key is a key like others.

    Requests without a time are not admitted and not remembered.  `parts` is the number of ranges (default: the session's
    shuffle partitions); a task holds the times of one range at most.  `slice_seconds` is kept for older callers and has no
    effect: ranges are bounded by rows, not by time.
    """
    window = int(round(window_seconds * MICROS))
    spark = requests.sparkSession
    ensure_checkpoint_dir(spark)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col(time).cast("timestamp_ntz"))
    rows = requests.select(F.col(key).alias("key"), F.col(request_id).alias("request_id"), micros.alias("at"))
    order = ["key", "at", "request_id"]
    timed = rows.filter("at IS NOT NULL")
    ranges = timed.repartitionByRange(*order) if parts is None else timed.repartitionByRange(parts, *order)
    # The checkpoint fixes ranges and order, which a repeated task could otherwise draw anew.
    dealt = ranges.sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()).checkpoint()

    key_type, id_type = rows.schema["key"].dataType, rows.schema["request_id"].dataType
    state = T.ArrayType(T.LongType())
    told = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("first_key", key_type), T.StructField("last_key", key_type),
        T.StructField("one_key", T.BooleanType()), T.StructField("fresh", state), T.StructField("known", state),
    ])
    arrow = pa.schema([
        ("part", pa.int64()), ("first_key", _arrow_type(timed)), ("last_key", _arrow_type(timed)), ("one_key", pa.bool_()),
        ("fresh", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())),
    ])
    # A row for each range from here on: few enough for one ordered window and for broadcasts.
    by_part = Window.orderBy("part")
    ends = dealt.select("key", "at", "row").mapInArrow(_summaries(limit, window, arrow), told)
    continues = F.coalesce(F.lag(F.lit(True)).over(by_part), F.lit(False)) & F.col("first_key").eqNullSafe(
        F.lag("last_key").over(by_part)
    )
    ends = ends.withColumn("continues", continues)
    ends = ends.withColumn("end", F.when(F.col("one_key") & F.col("continues"), F.col("known")).otherwise(F.col("fresh")))
    settled = F.max(F.when(F.col("end").isNotNull(), F.col("part"))).over(by_part)
    ends = ends.select(
        "part", "continues", "end", F.lag("end").over(by_part).alias("held"), settled.alias("run")
    ).checkpoint()

    first_row = F.shiftleft(F.col("part"), ROW_BITS).alias("row")
    waiting = ends.filter("end IS NULL")
    chained = (
        dealt.select("at", "row", F.shiftright("row", ROW_BITS).alias("part"))
        .join(F.broadcast(waiting.select("part", "run")), "part")
        .join(F.broadcast(waiting.filter("held IS NOT NULL").select(first_row, "held")), "row", "left")
        .repartition("run")
        .sortWithinPartitions("run", "row")
        .select("part", "at", "held")
        .mapInArrow(_chain_ends(limit, window), "part bigint, walked array<bigint>")
    )
    whole = ends.join(F.broadcast(chained), "part", "left").withColumn("end", F.coalesce("end", "walked"))
    starts = whole.select("part", "continues", F.lag("end").over(by_part).alias("held")).filter("continues")
    decided = dealt.join(F.broadcast(starts.select(first_row, "held")), "row", "left").select("key", "request_id", "at", "held")
    result = T.StructType([
        T.StructField("key", key_type), T.StructField(request_id, id_type), T.StructField("admitted", T.BooleanType())
    ])
    untimed = rows.filter("at IS NULL").select("key", F.col("request_id").alias(request_id), F.lit(False).alias("admitted"))
    return decided.mapInArrow(_decisions(limit, window, result.names), result).unionByName(untimed)


def _arrow_type(rows: DataFrame) -> pa.DataType:
    return rows.select("key").limit(0).toArrow().schema.field("key").type
