"""Process: clean the description and tag skills of pending postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import text
from vacantia.functions.scores import rounded
from vacantia.operators.ingest import moment


def process_postings(jobs: DataFrame, now: str, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Pending rows get cleaned text, skills and stamps; other rows pass unchanged.  One projection, no shuffle."""
    pending = F.col("processing_status") == "pending"

    def pick(value, name: str):
        return F.when(pending, value).otherwise(F.col(name))

    cleaned = jobs.withColumn(
        "cleaned_description", pick(text.clean_description(F.col("description")), "cleaned_description")
    )
    return cleaned.withColumns(
        {
            "detected_skills": pick(text.detect_skills(F.col("cleaned_description"), lexicon), "detected_skills"),
            "last_processed_at": pick(moment(now), "last_processed_at"),
            "skills_extracted_at": pick(moment(now), "skills_extracted_at"),
            "processing_status": pick(F.lit("processed"), "processing_status"),
        }
    ).select(jobs.columns)


def summary_columns(among: Column | None = None) -> list[Column]:
    """Aggregates over processed rows, or over those of them where `among` holds."""
    def only(value: Column) -> Column:
        return value if among is None else F.when(among, value)

    skills, one = F.size("detected_skills"), F.lit(1)
    rows = F.count(only(one))
    return [
        rows.alias("processed_jobs"),
        F.count(only(F.when(skills == 0, one))).alias("jobs_without_skills"),
        F.count(only(F.when(F.col("cleaned_description") == "", one))).alias("empty_cleaned_description"),
        F.coalesce(rounded(F.try_divide(F.sum(only(skills)), rows), 3), F.lit(0.0)).alias("avg_skills_per_job"),
    ]


def process_summary(processed: DataFrame) -> DataFrame:
    return processed.agg(*summary_columns())
