"""Admission over a stream with the same decisions as the batch form for requests that arrive in time order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vacantia.functions import rules
from vacantia.operators.admission import MICROS, admit

OUTPUT = "key string, request_id bigint, admitted boolean"


def _requests(stream: DataFrame, key: str, time: str, request_id: str) -> DataFrame:
    return stream.select(
        F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("ts"), F.col(request_id).alias("request_id")
    )


def decide_stream(
    stream: DataFrame,
    key: str,
    time: str,
    request_id: str,
    limit: int = rules.RATE_LIMIT_REQUESTS,
    window_seconds: float = rules.RATE_LIMIT_WINDOW_SECONDS,
    delay: str | None = None,
) -> DataFrame:
    """Requests with `admitted`.

    Without `delay` requests are decided as their micro-batch arrives, ordered inside it.  With `delay` they
    wait in the state of their key until the watermark has passed them, so late and unordered requests are
    decided in time order.  A key's state is then dropped once the watermark has passed the last request that it
    holds by the window, since that state admits like none; requests older than the watermark are dropped by Spark
    (`numRowsDroppedByWatermark` counts them).  Without `delay` there is no watermark, so a key keeps at most `limit` times.
    """
    window = int(round(window_seconds * MICROS))
    rows = _requests(stream, key, time, request_id)
    if delay is not None:
        rows = rows.withWatermark("ts", delay)
    rows = rows.withColumn("at", F.unix_micros("ts"))

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting_at, waiting_id = (list(x) for x in state.get) if state.exists else ([], [], [])
        for batch in batches:
            waiting_at.extend(batch["at"].tolist())
            waiting_id.extend(batch["request_id"].tolist())
        at, ids = np.asarray(waiting_at, dtype=np.int64), np.asarray(waiting_id, dtype=np.int64)
        order = np.lexsort((ids, at))
        at, ids = at[order], ids[order]
        ready = len(at)
        if delay is not None:
            ready = int(np.searchsorted(at, state.getCurrentWatermarkMs() * 1000, side="left"))
        admitted, held = admit(at[:ready], held, limit, window)
        held = [int(t) for t in held]
        state.update((held, at[ready:].tolist(), ids[ready:].tolist()))
        if delay is not None:
            watermark = state.getCurrentWatermarkMs()
            due = [int(at[ready])] if ready < len(at) else [held[-1] + window] if held else []
            if due and (ready < len(at) or due[0] // 1000 + 1 > watermark):
                state.setTimeoutTimestamp(max(due[0] // 1000 + 1, watermark + 1))
            else:
                state.remove()
        yield pd.DataFrame({"key": group[0], "request_id": ids[:ready], "admitted": admitted})

    timeout = GroupStateTimeout.NoTimeout if delay is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("key").applyInPandasWithState(
        step, OUTPUT, "held array<bigint>, at array<bigint>, ids array<bigint>", "append", timeout
    )
