"""The whole pipeline: ingest, process, embed, chunk; each stage handles only rows that need it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import chunks as chunk_ops
from vacantia.operators import ingest, process
from vacantia.operators.runs import RunLog, utc_now
from vacantia.operators.vectors import check_vectors, embed_texts
from vacantia.session import written
from vacantia.sources.tables import BucketedTable, VersionedTable

VECTOR_SCHEMA = "job_id bigint, embedding array<float>"
CHUNK_SCHEMA = (
    "job_id bigint, title string, company string, location string, category string, seniority string, "
    "chunk_order int, chunk_text string, chunk_length int, embedding array<float>"
)
METADATA_SCHEMA = "artifact string, generated_at string, job_count bigint, chunk_count bigint, model_name string"
DEFAULT_MODEL = "hashed-bag-of-words"


def embed_jobs(jobs: DataFrame, load_encoder=None) -> DataFrame:
    """Vectors of processed postings that have none yet; rows without text are left out."""
    source = ingest.dirty_rows(jobs, "embed").select(F.col("id").alias("job_id"), chunk_ops.indexed_text().alias("_text"))
    return embed_texts(source.filter("_text IS NOT NULL"), "_text", load_encoder).select("job_id", "embedding")


def fresh_chunks(jobs: DataFrame, load_encoder=None) -> DataFrame:
    """Passages with vectors of processed postings that are not chunked yet."""
    return embed_texts(chunk_ops.chunk_documents(ingest.dirty_rows(jobs, "chunk")), "chunk_text", load_encoder)


def replace_rows(existing: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    keep = existing.join(touched.select("job_id").distinct(), "job_id", "left_anti")
    return keep.select(fresh.columns).unionByName(fresh)


class Pipeline:
    """Tables under one folder: jobs (bucketed by address), vectors and chunks (by job), metadata and the run log.

    A stage reads and rewrites only the buckets that hold rows it has to handle.  Its counters are observed while its
    tables are written, so no stage evaluates its work twice.  With `keep_versions`, older versions are dropped.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        load_encoder=None,
        model_name: str = DEFAULT_MODEL,
        buckets: int = 32,
        keep_versions: int | None = None,
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.load_encoder, self.model_name, self.keep_versions = load_encoder, model_name, keep_versions
        self.jobs = BucketedTable(spark, f"{self.folder}/jobs", ingest.JOBS_SCHEMA, "url", buckets)
        self.vectors = BucketedTable(spark, f"{self.folder}/vectors", VECTOR_SCHEMA, "job_id", buckets)
        self.chunks = BucketedTable(spark, f"{self.folder}/chunks", CHUNK_SCHEMA, "job_id", buckets)
        self.metadata = VersionedTable(spark, f"{self.folder}/metadata", METADATA_SCHEMA)
        self.runs = RunLog(spark, f"{self.folder}/runs")

    def _stage(self, name: str, work: Callable[[], tuple[dict, dict]], source_name: str | None = None) -> dict:
        run = self.runs.start(name, source_name)
        try:
            metrics, counts = work()
        except Exception as error:
            self.runs.finish(run, "failed", error_message=str(error))
            raise
        self.runs.finish(run, "success", metrics, **counts)
        if self.keep_versions is not None:
            for table in (self.jobs, self.vectors, self.chunks):
                table.expire(self.keep_versions)
        return metrics

    def _observed(self, rows: DataFrame, name: str, counters: list[Column]) -> tuple[DataFrame, dict]:
        """The rows written to a folder that the next run overwrites, read again, and aggregates taken on the way."""
        seen, path = Observation(), f"{self.folder}/work/{name}"
        rows.observe(seen, *counters).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), seen.get

    def _note(self, artifact: str, now: str, job_count: int, chunk_count: int | None) -> None:
        row = (artifact, now, job_count, chunk_count, self.model_name)
        new = self.spark.createDataFrame([row], METADATA_SCHEMA)
        self.metadata.write(self.metadata.read().filter(F.col("artifact") != artifact).unionByName(new).coalesce(1))

    def ingest(self, snapshot: DataFrame, full_rebuild: bool = False, version: int | None = None, source_name: str | None = None) -> dict:
        """Upsert a snapshot, which is read once.  A repeated `version` starts from the one before it."""
        def work():
            now, base = str(utc_now()), self.jobs.current(version)

            def stored(buckets):
                return self.jobs.read(base, buckets) if base is not None else self.spark.createDataFrame([], ingest.JOBS_SCHEMA)

            staged, counted = self._observed(ingest.stage(snapshot), "staged", ingest.staged_counters())
            seen = self.jobs.buckets_of(staged.filter("reject_reason IS NULL"), F.col("url"))
            found = ingest.key_actions(stored(seen), staged, full_rebuild)
            actions, acted = self._observed(found, "actions", ingest.action_counters())
            summary = ingest.all_counters(counted, acted)
            touched = self.jobs.buckets_of(actions.filter("action <> 'unchanged'"), F.col("url"))
            summary["full_rebuild"], summary["reset_jobs"] = full_rebuild, 0
            if full_rebuild:
                summary["reset_jobs"] = stored(None).count()
                touched = list(self.jobs.places(base))
            if touched or base is None or version is not None:
                changed = ingest.changed_rows(staged, actions, ingest.top_id(stored(None)), now)
                kept = ingest.kept_rows(stored(touched), actions, full_rebuild)
                self.jobs.replace(kept.unionByName(changed), touched, version)
            counts = {k: summary[k] for k in ("input_rows", "inserted_rows", "updated_rows", "skipped_rows")}
            return summary, {**counts, "output_rows": summary["changed_rows"]}

        return self._stage("ingest_jobs", work, source_name)

    def process(self) -> dict:
        def work():
            pending = F.expr(ingest.DIRTY["process"])
            touched = self.jobs.buckets_of(self.jobs.read().filter(pending), F.col("url"))
            rows = self.jobs.read(buckets=touched).withColumn("_pending", pending)
            done = process.process_postings(rows, str(utc_now()))
            seen = Observation()
            if touched:
                self.jobs.replace(done.observe(seen, *process.summary_columns(F.col("_pending"))), touched)
                summary = seen.get
            else:
                summary = process.process_summary(done).first().asDict()
            n = summary["processed_jobs"]
            return summary, {"output_rows": n, "updated_rows": n}

        return self._stage("process_jobs", work)

    def _dirty(self, stage: str, table: BucketedTable) -> tuple[int, list[int], list[int]]:
        """Rows that a stage has to handle, their buckets of jobs and their buckets of the stage's table; one narrow pass."""
        found = ingest.dirty_rows(self.jobs.read(), stage).agg(
            F.count(F.lit(1)).alias("n"),
            F.collect_set(self.jobs.bucket_of(F.col("url"))).alias("jobs"),
            F.collect_set(table.bucket_of(F.col("id"))).alias("own"),
        ).first()
        return found["n"], found["jobs"], found["own"]

    def embed(self) -> dict:
        def work():
            now = str(utc_now())
            dirty, places, own = self._dirty("embed", self.vectors)
            if ingest.should_rebuild(dirty, self.vectors.current() is not None):
                jobs = self.jobs.read(buckets=places)
                touched = ingest.dirty_rows(jobs, "embed").select(F.col("id").alias("job_id"))
                rows = replace_rows(self.vectors.read(buckets=own), embed_jobs(jobs, self.load_encoder), touched)
                self.vectors.replace(rows, own, verify=check_vectors)
                self.jobs.replace(ingest.stamp_dirty(jobs, "embed", "embedded_at", now), places)
                self._note("job_embeddings", now, self.vectors.read().count(), None)
            return {"embedded_jobs": dirty, "model_name": self.model_name}, {"output_rows": dirty, "updated_rows": dirty}

        return self._stage("build_embeddings", work)

    def served_vectors(self) -> DataFrame:
        """The stored vectors after a check of the whole table; empty, repeated or uneven ones are an error."""
        return check_vectors(self.vectors.read())

    def chunk(self) -> dict:
        def work():
            now = str(utc_now())
            dirty, places, own = self._dirty("chunk", self.chunks)
            if not ingest.should_rebuild(dirty, self.chunks.current() is not None):
                return {"skipped_rebuild": True, "reason": "no_dirty_jobs", "dirty_jobs": 0}, {"output_rows": 0}
            jobs = self.jobs.read(buckets=places)
            touched = ingest.dirty_rows(jobs, "chunk").select(F.col("id").alias("job_id"))
            rows = replace_rows(self.chunks.read(buckets=own), fresh_chunks(jobs, self.load_encoder), touched)
            self.chunks.replace(rows, own)
            self.jobs.replace(ingest.stamp_dirty(jobs, "chunk", "chunked_at", now), places)
            summary = chunk_ops.chunk_summary(self.chunks.read()).first().asDict()
            self._note("chunk_index", now, summary["job_count"], summary["chunk_count"])
            metrics = {"skipped_rebuild": False, "dirty_jobs": dirty, **summary}
            return metrics, {"output_rows": summary["chunk_count"], "updated_rows": dirty}

        return self._stage("build_chunk_index", work)

    def run(self, snapshot: DataFrame, full_rebuild: bool = False) -> dict:
        return {
            "full_rebuild": full_rebuild,
            "ingest": self.ingest(snapshot, full_rebuild),
            "process": self.process(),
            "embeddings": self.embed(),
            "chunk_index": self.chunk(),
        }


def pipeline_summary(existing: DataFrame, snapshot: DataFrame, now: str) -> DataFrame:
    """Summaries of all stages for one snapshot as rows (stage, metric, value).

    The staged snapshot, the actions, and the states after ingest and processing are written once each, as in a real run.
    """
    staged = written(ingest.stage(snapshot), "staged")
    actions = written(ingest.key_actions(existing, staged), "actions")
    changed = ingest.changed_rows(staged, actions, ingest.top_id(existing), now)
    state = written(ingest.kept_rows(existing, actions).unionByName(changed).withColumn("_pending", F.expr(ingest.DIRTY["process"])), "state")
    processed = written(process.process_postings(state, now), "processed")
    counts = ingest.dirty_counts(processed).filter("stage = 'embed'").select(F.col("dirty").cast("double").alias("embedded_jobs"))
    frames = {
        "ingest": ingest.staged_summary(staged, actions),
        "process": processed.agg(*process.summary_columns(F.col("_pending"))),
        "embeddings": counts,
        "chunk_index": chunk_ops.chunk_summary(chunk_ops.chunk_documents(ingest.dirty_rows(processed, "chunk"))),
    }
    result = None
    for stage, frame in frames.items():
        values = frame.select(*[F.col(c).cast("double").alias(c) for c in frame.columns])
        rows = values.unpivot([], values.columns, "metric", "value").select(F.lit(stage).alias("stage"), "metric", "value")
        result = rows if result is None else result.unionByName(rows)
    return result
