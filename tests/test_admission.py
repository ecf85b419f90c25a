import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from vacantia.operators import admission
from vacantia.streaming.admission import decide_stream

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, key string, ts timestamp_ntz"


def loop(rows, limit, window):
    held, result = {}, {}
    for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        queue = held.setdefault(key, deque())
        while queue and (ts - queue[0]).total_seconds() > window:
            queue.popleft()
        result[i] = len(queue) < limit
        if result[i]:
            queue.append(ts)
    return result


def decided(rows):
    return {r["id"]: r["admitted"] for r in rows.collect()}


def traffic(seed, n=3000):
    """One hot key that is always over its limit, bursts, and quiet keys; many equal times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4:
            key, second = "hot", rng.randint(0, 4000)
        elif kind < 0.6:
            key, second = "burst", rng.choice([10, 700, 2500]) + rng.randint(0, 90)
        else:
            key, second = f"k{rng.randint(0, 40)}", rng.randint(0, 4000)
        rows.append((i, key, START + dt.timedelta(seconds=second)))
    return rows


@pytest.mark.parametrize("limit,window,slice_seconds", [(2, 60, 240), (1, 10, None), (20, 60, 500), (3, 0, 100), (2, 60, 10**9)])
def test_equals_a_plain_loop(frame, limit, window, slice_seconds):
    rows = traffic(limit)
    got = decided(admission.decide(frame(rows, SCHEMA), "key", "ts", "id", limit, window, slice_seconds))
    assert got == loop(rows, limit, window)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_one_key_and_one_window_hold_most_rows(frame, parts):
    """90 % of the rows in one key, nearly all of them within one window and many at one time, cut over many ranges."""
    rng = random.Random(11)
    rows = [(i, "hot", START + dt.timedelta(seconds=rng.choice([0, 0, 5, 20, rng.randint(0, 50)]))) for i in range(2600)]
    rows += [(3000 + i, "hot", START + dt.timedelta(seconds=40 + 7 * i)) for i in range(100)]
    rows += [(5000 + i, f"k{i % 7}", START + dt.timedelta(seconds=rng.randint(0, 600))) for i in range(300)]
    for limit, window in ((2, 60), (100, 60), (1, 1)):
        assert decided(admission.decide(frame(rows, SCHEMA), "key", "ts", "id", limit, window, parts=parts)) == loop(rows, limit, window)


def test_no_group_is_collected(frame):
    rows = admission.decide(frame(traffic(1, 50), SCHEMA), "key", "ts", "id", 2, 60)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_nulls_and_empty_tables(frame):
    at = [START + dt.timedelta(seconds=s) for s in range(4)]
    rows = [(1, None, at[0]), (2, None, at[1]), (3, None, at[2]), (4, "", at[0]), (5, "a", None), (6, None, None), (7, "a", at[3])]
    got = decided(admission.decide(frame(rows, SCHEMA), "key", "ts", "id", 2, 60, parts=3))
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True}
    assert decided(admission.decide(frame(rows[:5], SCHEMA), "key", "ts", "id", 0, 60)) == dict.fromkeys(range(1, 6), False)
    assert admission.decide(frame([], SCHEMA), "key", "ts", "id", 2, 60).collect() == []


def test_limit_expiry_and_boundary(frame):
    at = [0, 10, 20, 60, 61, 71]
    rows = [(i, "a", START + dt.timedelta(seconds=s)) for i, s in enumerate(at)] + [(9, "b", START)]
    got = decided(admission.decide(frame(rows, SCHEMA), "key", "ts", "id", 2, 60))
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 9: True}


def test_client_key(frame):
    rows = frame([(" 1.1.1.1 , 2.2.2.2", "h"), ("", "h"), (None, "h"), (None, None)], "f string, h string")
    got = [r[0] for r in rows.select(admission.client_key(F.col("f"), F.col("h"))).collect()]
    assert got == ["1.1.1.1", "h", "h", "unknown"]


LEFT = {}


def run_stream(spark, folder, name, delay):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = decide_stream(stream, "key", "ts", "id", 2, 60, delay)
    query = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    LEFT[name] = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return {r["request_id"]: r["admitted"] for r in spark.table(name).collect()}


def test_stream_in_time_order_equals_batch(spark, frame, tmp_path):
    rows = sorted(traffic(7, 400), key=lambda r: (r[2], r[0]))
    for part in range(4):
        frame(rows[part * 100 : part * 100 + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run_stream(spark, tmp_path / "in", "in_order", None) == loop(rows, 2, 60)


def test_stream_with_delay_sorts_late_requests(spark, frame, tmp_path):
    rows = sorted(traffic(8, 300), key=lambda r: r[2])
    late = rows[:]
    random.Random(1).shuffle(late[:50])
    batches = [rows[100:150] + rows[0:50], rows[50:100] + rows[150:300], [(-1, "end", START + dt.timedelta(days=9))], [(-2, "end", START + dt.timedelta(days=19))]]
    for batch in batches:
        frame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_stream(spark, tmp_path / "in", "late", "2 hours")
    got = {k: v for k, v in got.items() if k >= 0}
    assert got == loop(rows, 2, 60)


def test_idle_keys_leave_the_state(spark, frame, tmp_path):
    rows = [(i, f"k{i % 50}", START + dt.timedelta(seconds=i // 50)) for i in range(200)]
    batches = [rows] + [[(1000 + d, "end", START + dt.timedelta(days=d))] for d in (1, 2, 3)]
    for batch in batches:
        frame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_stream(spark, tmp_path / "in", "idle", "10 minutes")
    assert {k: v for k, v in got.items() if k < 1000} == loop(rows, 2, 60)
    assert max(LEFT["idle"]) == 50 + 1 and LEFT["idle"][-1] == 1
