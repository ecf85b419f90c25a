"""Run log, freshness and latency summaries."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.functions import rules
from vacantia.functions.scores import rounded
from vacantia.sources.tables import path_exists

RUNS_SCHEMA = (
    "run_id string, pipeline_name string, status string, source_name string, input_rows bigint, output_rows bigint, "
    "inserted_rows bigint, updated_rows bigint, skipped_rows bigint, metrics string, error_message string, "
    "started_at timestamp_ntz, finished_at timestamp_ntz"
)

GROUP_SALTS = 64


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class RunLog:
    """Append-only run table: one row when a stage starts and one when it ends; the later row counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, row: dict) -> None:
        names = [f.split()[0] for f in RUNS_SCHEMA.split(", ")]
        self.spark.createDataFrame([tuple(row.get(n) for n in names)], RUNS_SCHEMA).coalesce(1).write.mode(
            "append"
        ).parquet(self.path)

    def start(self, pipeline_name: str, source_name: str | None = None, input_rows: int | None = None) -> dict:
        run = {
            "run_id": uuid.uuid4().hex,
            "pipeline_name": pipeline_name,
            "status": "started",
            "source_name": source_name,
            "input_rows": input_rows,
            "started_at": utc_now(),
        }
        self._append(run)
        return run

    def finish(self, run: dict, status: str, metrics: dict | None = None, error_message: str | None = None, **counts) -> dict:
        finished = utc_now()
        seconds = round((finished - run["started_at"]).total_seconds(), 3)
        done = {
            **run,
            **counts,
            "status": status,
            "metrics": json.dumps({**(metrics or {}), "duration_seconds": seconds}, sort_keys=True),
            "error_message": error_message,
            "finished_at": finished,
        }
        self._append(done)
        return done

    def read(self) -> DataFrame:
        """The latest row of each run; none before the first run."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], RUNS_SCHEMA)
        return current_runs(self.spark.read.schema(RUNS_SCHEMA).parquet(self.path))


def current_runs(rows: DataFrame) -> DataFrame:
    """Latest row of each run."""
    order = Window.partitionBy("run_id").orderBy(F.col("finished_at").desc_nulls_last())
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def latest_runs(runs: DataFrame, n: int = 10, id_column: str = "id") -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col(id_column).desc()).limit(n)


def with_duration(runs: DataFrame) -> DataFrame:
    micros = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at"))
    return runs.withColumn("duration_seconds", rounded(micros / 1000000, 3))


def staleness(generated_at: Column, now: Column) -> tuple[Column, Column]:
    """Age in hours and whether it is above the limit; null where the time is missing or not readable."""
    seconds = F.timestamp_diff("MICROSECOND", generated_at, now) / 1000000
    age = rounded(seconds / 3600, 2)
    return age, age > rules.STALE_AFTER_HOURS


def freshness(runs: DataFrame, now: str) -> DataFrame:
    """Age of the latest good run per pipeline; a pipeline without one is not available."""
    at = F.lit(now).cast("timestamp_ntz")
    latest = runs.groupBy("pipeline_name").agg(
        F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("generated_at")
    )
    age, stale = staleness(F.col("generated_at"), at)
    return latest.select(
        "pipeline_name", F.col("generated_at").isNotNull().alias("available"), stale.alias("stale"), age.alias("age_hours")
    )


def metadata_freshness(metadata: DataFrame, now: str) -> DataFrame:
    """Same for written metadata rows whose time is a text; unreadable text is available with unknown age.

    A time with an offset is an instant and is compared in UTC, like `now`; one without is taken to be in UTC.
    """
    at = F.lit(now).cast("timestamp_ntz")
    text = F.trim("generated_at")
    local = text.try_cast("timestamp").cast("timestamp_ntz")
    instant = F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
    has_offset = text.rlike(r":\d\d(\.\d+)?\s*(Z|UTC|[+-]\d\d(:?\d\d)?)$")
    age, stale = staleness(F.when(has_offset, instant).otherwise(text.try_cast("timestamp_ntz")), at)
    return metadata.select(
        "artifact", F.col("generated_at").isNotNull().alias("available"), stale.alias("stale"), age.alias("age_hours")
    )


def _met(base: DataFrame, sketch: DataFrame, group: str) -> DataFrame:
    """Values with their group's few sketch rows; a hot group is split over salts, each with a copy of the sketch."""
    values = base.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(GROUP_SALTS)).cast("int"))
    copies = sketch.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(GROUP_SALTS - 1))))
    return values.join(copies, [group, "_salt"]).drop("_salt")


def exact_percentiles(
    rows: DataFrame, group: str, value: str, percentiles: dict[str, float], accuracy: int = 10_000
) -> DataFrame:
    """Exact percentiles per group with linear interpolation, without holding a group's values in one task.

    A mergeable sketch gives a narrow value range around each percentile.  One pass counts the values below
    and inside every range; only values inside are then counted per value and ranked.  Where the wanted ranks
    turn out to lie outside, the range is widened to all values of the group, so the result is always exact.
    """
    names = list(percentiles)
    margin = 10.0 / accuracy
    bounds = [max(0.0, p - margin) for p in percentiles.values()] + [min(1.0, p + margin) for p in percentiles.values()]
    outer, group = group, "_g"
    # A struct equals another one with the same null, so rows without a group are a group of their own.
    base = rows.select(F.struct(outer).alias(group), F.col(value).alias("_v")).filter("_v IS NOT NULL")
    sketch = base.groupBy(group).agg(F.percentile_approx("_v", bounds, accuracy).alias("_b"))
    joined = _met(base, sketch, group)

    def low(i: int) -> Column:
        return F.get("_b", F.lit(i))

    def high(i: int) -> Column:
        return F.get("_b", F.lit(i + len(names)))

    counted = joined.groupBy(group).agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col("_v") < low(i)).alias(f"_below{i}") for i in range(len(names))],
        *[F.count_if(F.col("_v").between(low(i), high(i))).alias(f"_inside{i}") for i in range(len(names))],
        *[F.first(low(i)).alias(f"_low{i}") for i in range(len(names))],
        *[F.first(high(i)).alias(f"_high{i}") for i in range(len(names))],
    )
    ranges = []
    for i, name in enumerate(names):
        rank = (F.col("_n") - 1) * F.lit(float(percentiles[name]))
        first, last = F.floor(rank), F.ceil(rank)
        below, inside = F.col(f"_below{i}"), F.col(f"_inside{i}")
        hit = (first >= below) & (last < below + inside)
        ranges.append(
            F.struct(
                F.lit(name).alias("name"),
                first.alias("first"),
                last.alias("last"),
                (rank - first).alias("part"),
                F.when(hit, below).otherwise(0).alias("skip"),
                F.when(hit, F.col(f"_low{i}")).otherwise(float("-inf")).alias("low"),
                F.when(hit, F.col(f"_high{i}")).otherwise(float("inf")).alias("high"),
            )
        )
    wanted = counted.select(group, F.explode(F.array(*ranges)).alias("_r")).select(group, "_r.*")
    inside = _met(base, wanted, group).filter("_v >= low AND _v <= high")
    per_value = inside.groupBy(group, "name", "first", "last", "part", "skip", "_v").agg(F.count("*").alias("_c"))
    running = Window.partitionBy(group, "name").orderBy("_v")
    ranked = per_value.withColumn("_to", F.col("skip") + F.sum("_c").over(running))
    at_first = (F.col("first") >= F.col("_to") - F.col("_c")) & (F.col("first") < F.col("_to"))
    at_last = (F.col("last") >= F.col("_to") - F.col("_c")) & (F.col("last") < F.col("_to"))
    points = (
        ranked.filter(at_first | at_last)
        .groupBy(group, "name", "part")
        .agg(F.max(F.when(at_first, F.col("_v"))).alias("_a"), F.max(F.when(at_last, F.col("_v"))).alias("_b"))
        .withColumn("_p", F.col("_a") + F.col("part") * (F.col("_b") - F.col("_a")))
    )
    found = points.groupBy(group).agg(*[F.max(F.when(F.col("name") == n, F.col("_p"))).alias(n) for n in names])
    return found.select(F.col(f"{group}.{outer}").alias(outer), *names)


def latency_summary(requests: DataFrame) -> DataFrame:
    """Requests, errors, mean and exact p50, p95 and p99 of the latency per endpoint."""
    basic = requests.groupBy("endpoint").agg(
        F.count("*").alias("requests"),
        F.count_if("is_error").alias("errors"),
        F.avg("latency_ms").alias("mean_ms"),
    )
    exact = exact_percentiles(requests, "endpoint", "latency_ms", {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99})
    exact = exact.withColumnRenamed("endpoint", "_endpoint")
    return basic.join(exact, F.col("endpoint").eqNullSafe(F.col("_endpoint")), "left").select(
        "endpoint",
        "requests",
        "errors",
        *[rounded(F.col(c)).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms")],
    )
