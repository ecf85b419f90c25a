"""Prepare: raw postings and job skills to a clean table of technical postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.functions import rules, text

PREPARED_COLUMNS = ["title", "company", "location", "category", "seniority", "description", "date_posted", "url"]


def first_by_key(rows: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """First row per key in file order; the rank limit runs before the shuffle, so a hot key stays cheap."""
    order = Window.partitionBy(key).orderBy(ordinal)
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def skills_per_posting(job_skills: DataFrame) -> DataFrame:
    """Sorted distinct skills of each posting joined by ', '."""
    cleaned = job_skills.select("job_id", text.clean_text(F.col("skill_abr")).alias("skill")).dropna()
    return cleaned.groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_set("skill")), ", ").alias("skills_text"))


def normalize_raw(raw: DataFrame, job_skills: DataFrame, whole_words: bool = False) -> DataFrame:
    """Deduplicated, joined and classified postings before any row is dropped."""
    # Texts are cleaned below the shuffle of the deduplication, so later filters do not repeat the work.
    tidy = raw.select(
        "ordinal",
        "job_id",
        *[text.clean_text(F.col(c)).alias(c) for c in ("title", "location", "description", "skills_desc")],
        text.clean_text(F.col("company_name")).alias("company"),
        F.col("formatted_experience_level").alias("level"),
        text.listed_date(F.col("original_listed_time")).alias("date_posted"),
        F.coalesce(text.clean_text(F.col("job_posting_url")), text.clean_text(F.col("application_url"))).alias("url"),
    )
    joined = first_by_key(tidy, "job_id").join(skills_per_posting(job_skills), "job_id", "left")
    whole = text.blank_to_null(F.concat_ws(" ", "description", "skills_desc", "skills_text"))
    cleaned = joined.withColumn("description", whole).drop("job_id", "skills_desc", "skills_text")
    return cleaned.select(
        "*",
        text.seniority_from_text(
            F.col("level"), F.col("title"), F.col("description"), whole_words=whole_words
        ).alias("seniority"),
        text.category_from_title(F.col("title"), whole_words=whole_words).alias("category"),
        text.is_tech_title(F.col("title"), whole_words=whole_words).alias("is_tech"),
    )


def usable(rows: DataFrame, minimum: int = rules.MIN_PREPARED_DESCRIPTION) -> DataFrame:
    return rows.dropna(subset=["title", "description", "url"]).filter(F.length("description") >= minimum)


def prepare_postings(
    raw: DataFrame, job_skills: DataFrame, max_rows: int | None = None, whole_words: bool = False
) -> DataFrame:
    """Technical postings, newest first, at most `max_rows` (None for all)."""
    rows = first_by_key(usable(normalize_raw(raw, job_skills, whole_words)), "url")
    technical = rows.filter((F.col("category") != "other") | F.col("is_tech"))
    ordered = technical.orderBy(
        F.col("date_posted").desc_nulls_last(),
        F.col("company").asc_nulls_last(),
        F.col("title").asc_nulls_last(),
        (F.col("category") == "other"),
        "ordinal",
    )
    return (ordered if max_rows is None else ordered.limit(max_rows)).select(PREPARED_COLUMNS)


def union_buckets(rows: DataFrame) -> DataFrame:
    """Classified postings, then other technical ones, first of each address; `priority` names the bucket."""
    classified = rows.filter("category <> 'other'").withColumn("priority", F.lit(0))
    fallback = rows.filter("category = 'other' AND is_tech").withColumn("priority", F.lit(1))
    both = classified.unionByName(fallback)
    order = Window.partitionBy("url").orderBy("priority", "ordinal")
    return both.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def label_counts(rows: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per label, null shown as 'None', most frequent first."""
    label = F.coalesce(F.col(column), F.lit("None")).alias("label")
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label")
    return counts if limit is None else counts.limit(limit)


def require_rows(rows: DataFrame) -> DataFrame:
    """Fail when nothing is left to write."""
    if rows.isEmpty():
        raise RuntimeError("no technical postings found; check the input and the title rules")
    return rows
