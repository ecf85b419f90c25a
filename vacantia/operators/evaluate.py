"""Offline evaluation of recommendations and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import text
from vacantia.functions.scores import rounded
from vacantia.operators.recommend import recommend, searched_postings


def _mean(total: Column, cases: Column) -> Column:
    return F.coalesce(rounded(F.try_divide(total, cases), 3), F.lit(0.0))


def recommendation_cases(
    jobs: DataFrame, vectors: DataFrame, limit: int = 5, sample_size: int | None = None, block_rows: int | None = None
) -> DataFrame:
    """Recommendations found per posting that has skills and a vector; the first `sample_size` by id, or all."""
    jobs = searched_postings(jobs, vectors)
    targets = jobs.filter(F.size("detected_skills") > 0).select(
        F.col("id").alias("job_id"), F.col("title").alias("target_title"), F.size("detected_skills").alias("target_skill_count")
    )
    if sample_size is not None:
        targets = targets.orderBy("job_id").limit(sample_size)
    found = recommend(jobs, vectors, None if sample_size is None else targets, limit, block_rows=block_rows, stored=True)
    counts = found.groupBy("job_id").agg(
        F.count("*").alias("n"), F.count_if(F.size("shared_skills") > 0).alias("shared")
    )
    return targets.join(counts, "job_id", "left").select(
        "job_id",
        "target_title",
        "target_skill_count",
        F.coalesce("n", F.lit(0)).alias("recommendation_count"),
        F.coalesce("shared", F.lit(0)).alias("shared_skill_recommendations"),
    )


def recommendation_summary(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count("*").alias("evaluated_jobs"),
        F.count_if(F.col("recommendation_count") > 0).alias("jobs_with_recommendations"),
        F.count_if(F.col("shared_skill_recommendations") > 0).alias("jobs_with_shared_skills"),
        _mean(F.sum("recommendation_count"), F.count("*")).alias("avg_recommendations_per_job"),
    )


def answer_cases(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Expected keywords found in each answer, with the counts of its sources."""
    joined = cases.select("question_id", "expected_keywords").join(answers, "question_id")
    lowered = F.lower(F.col("answer"))
    return joined.select(
        "question_id",
        "question",
        "expected_keywords",
        text.let(
            lowered, lambda a: F.filter(F.col("expected_keywords"), lambda k: F.contains(a, F.lower(k)))
        ).alias("matched_keywords"),
        F.length("answer").alias("answer_length"),
        F.col("source_count").alias("retrieved_chunk_count"),
        F.col("job_count").alias("retrieved_job_count"),
        "answer",
    ).withColumn(
        "keyword_hit_rate",
        F.coalesce(rounded(F.try_divide(F.size("matched_keywords"), F.size("expected_keywords")), 3), F.lit(0.0)),
    )


def answer_summary(cases: DataFrame) -> DataFrame:
    total = F.count("*")
    return cases.agg(
        total.alias("total_cases"),
        F.count_if(F.col("keyword_hit_rate") > 0).alias("passed_cases"),
        _mean(F.sum("keyword_hit_rate"), total).alias("avg_keyword_hit_rate"),
        _mean(F.sum("retrieved_chunk_count"), total).alias("avg_retrieved_chunk_count"),
        _mean(F.sum("retrieved_job_count"), total).alias("avg_retrieved_job_count"),
    )


def save_evaluation(path: str, summary: DataFrame, cases: DataFrame) -> None:
    """Write summary and cases as JSON with the time of writing."""
    stamp = F.current_timestamp().alias("generated_at")
    summary.select("*", stamp).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    cases.write.mode("overwrite").json(f"{path}/cases")
