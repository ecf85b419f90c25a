"""Postings, questions, logs and vectors derived from the given tables.

The tables hold prose without titles, places or skills, so those are assigned from short phrase lists by
document number.  Every document is used, with its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TITLES = [
    "Senior Machine Learning Engineer", "Backend Developer (Python)", "Data Engineer II", "Nurse",
    "Physical Therapist", "Internal Auditor", None, "  Staff   Software Engineer  ",
    "Lead Analytics Engineer", "jr. web developer", "Cloud Solutions Architect", "Leadership Coach",
    "Principal Data Scientist", "Site Reliability Engineer (SRE)", "Mid-Level Full Stack Developer", "   ",
]
LEVELS = [None, "Entry level", "Mid-Senior level", "Internship", "senior", " Sr ", "", "middle", "PRINCIPAL"]
LOCATIONS = ["Berlin, Germany", "new york, NY", "St. John's, Canada", None, "  ", "MÜNCHEN , Bayern", "aix-en-provence"]
SKILL_PHRASES = [
    "Python, SQL and Docker required.", "We use FastAPI and PostgreSQL on AWS.", "",
    "Apache Spark with Amazon Web Services and Kafka.", "CI/CD, Kubernetes (k8s), Terraform and Go.",
    "React.js, Node.js and TypeScript; JavaScript preferred.",
    "Machine learning with scikit-learn, pandas and NumPy.", None,
    "Data warehouse, dbt and Snowflake; T-SQL.", "Java and REST API design, GitHub.",
    "Business intelligence dashboards in Excel.", "Large language models, RAG and vector search.",
]
TIMES = ["epoch", "2024-01-15 12:30:00", "2023-11-05", "not a date", None, "2024-02-29T23:30:00-05:00", "03/09/2024"]
LANGS = ["en", "fr", "de", "es", None]


PARTITIONS = "spark.vacantia.documentPartitions"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table.  A number set under PARTITIONS deals the documents to so many tasks, for files of one row group."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    wanted = spark.conf.get(PARTITIONS, None) if name == "documents" else None
    return found.repartition(int(wanted)) if wanted else found


def pick(options: list, number: Column) -> Column:
    """The option at number modulo length; written so that one array literal is built per query."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (number % len(options)).cast("int") + 1)


def raw_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Raw form: every tenth posting shares its address with the one before; some have none."""
    d = table(spark, folder, "documents")
    n = F.col("doc_id")
    shared = F.when(n % 10 == 9, n - 1).otherwise(n).cast("string")
    time = pick(TIMES, n)
    return d.select(
        n.cast("string").alias("job_id"),
        F.col("source").alias("company_name"),
        pick(TITLES, n).alias("title"),
        F.col("text").alias("description"),
        pick(LOCATIONS, n).alias("location"),
        pick(LEVELS, n).alias("formatted_experience_level"),
        F.when(time == "epoch", (F.lit(1700000000000) + n * 3600000).cast("string")).otherwise(time).alias(
            "original_listed_time"
        ),
        F.when(n % 13 != 5, F.concat(F.lit("https://jobs.example.com/"), shared)).alias("job_posting_url"),
        F.when(n % 26 != 5, F.concat(F.lit("https://apply.example.com/"), shared)).alias("application_url"),
        pick(SKILL_PHRASES, n).alias("skills_desc"),
        n.alias("ordinal"),
    )


def job_skills(spark: SparkSession, folder: str) -> DataFrame:
    """One row per word of the posting's skill phrase, with repeats."""
    phrase = pick(SKILL_PHRASES, F.col("doc_id"))
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("job_id"),
        F.explode(F.split(F.concat_ws(" ", phrase, phrase), "[ ,;.]")).alias("skill_abr"),
    )


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Incoming snapshot for ingest: one row per document, in document order."""
    n = F.col("doc_id")
    time = pick(TIMES, n)
    shared = F.when(n % 10 == 9, n - 1).otherwise(n).cast("string")
    return table(spark, folder, "documents").select(
        n.alias("ordinal"),
        pick(TITLES, n).alias("title"),
        F.col("source").alias("company"),
        pick(LOCATIONS, n).alias("location"),
        F.col("lang").alias("category"),
        pick(LEVELS, n).alias("seniority"),
        F.concat_ws(" ", F.col("text"), pick(SKILL_PHRASES, n)).alias("description"),
        F.when(time == "epoch", "2024-03-01").otherwise(time).alias("date_posted"),
        F.when(n % 13 != 5, F.concat(F.lit("https://jobs.example.com/"), shared)).alias("url"),
    )


def older_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """What was ingested before: the labelled documents, with another text where the label is bad."""
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("ordinal"), "quality", "toxic")
    changed = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return (
        snapshot(spark, folder)
        .join(labels, "ordinal")
        .withColumn("description", F.when(changed, F.concat(F.lit("Draft. "), "description")).otherwise(F.col("description")))
        .drop("quality", "toxic")
    )


def job_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("job_id"), "embedding")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark texts as questions, with optional filters; some ask for skills or for jobs."""
    n = F.col("item_id")
    lead = pick(["Which postings say: ", "What skills are needed: ", "", "What jobs mention "], n)
    return table(spark, folder, "benchmark").select(
        n.alias("question_id"),
        F.concat(lead, F.col("text")).alias("question"),
        pick(LANGS, n).alias("category"),
        pick([None, "Berlin", "new york"], n).alias("location"),
        F.lit(None).cast("string").alias("seniority"),
    )


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    return table(spark, folder, "events").select(
        "event_id",
        F.col("event_type").alias("endpoint"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("user_id") % 2 == 0, F.concat(user, F.lit(" , 10.0.0.1"))).alias("forwarded_for"),
        F.when(F.col("user_id") % 2 == 1, user).alias("host"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") == "error").alias("is_error"),
    )


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as pipeline runs: errors are failed runs, a run takes `value` seconds."""
    started = F.col("ts").cast("timestamp_ntz")
    finished = F.timestamp_add("MICROSECOND", F.floor(F.col("value") * 1000000), started)
    failed = (F.col("event_type") == "error") | (F.col("value") > 100)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.col("event_type"), F.lit("_stage")).alias("pipeline_name"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.get_json_object("props", "$.k").cast("bigint").alias("output_rows"),
        started.alias("started_at"),
        finished.alias("finished_at"),
    )


def model_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns wrapped in the response shapes of text services, and one unknown shape."""
    text = F.concat(F.lit("  "), F.col("text"), F.lit("\n"))
    shape = (F.col("conv_id") + F.col("turn")) % 5
    body = (
        F.when(shape == 0, F.to_json(F.struct(text.alias("text"))))
        .when(shape == 1, F.to_json(F.struct(text.alias("output"))))
        .when(shape == 2, F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("choices"))))
        .when(
            shape == 3,
            F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"))),
        )
        .otherwise(F.to_json(F.struct(text.alias("unknown"))))
    )
    turns = table(spark, folder, "conversations").filter(F.col("role") == "assistant")
    return turns.select("conv_id", "turn", body.alias("body"))
