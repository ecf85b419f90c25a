"""Recommendations: candidate pool by vectors, then gates, weighted score and ranking, for all targets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.functions import rules, scores
from vacantia.operators.vectors import nearest_jobs
from vacantia.session import written


def _clamped(name: str, value, low, high):
    if value is not None and not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


SHOWN = ("title", "company", "location", "category", "seniority", "url")


def searched_postings(jobs: DataFrame, vectors: DataFrame) -> DataFrame:
    """What recommendations read of the postings that have a vector, written once.

    No other posting can be a target or a candidate.  The texts are not kept, and skills are tagged once, not for each join.
    """
    known = jobs.join(vectors.select(F.col("job_id").alias("id")), "id", "left_semi")
    return written(known.select("id", *SHOWN, "detected_skills"), "postings")


def _pairs(jobs: DataFrame, pool: DataFrame) -> DataFrame:
    """`scored_pairs` with the shared skills in no order.

    The candidate is joined first: then the pairs are shuffled once without labels and once by their target, where they stay
    for the ranking.
    """
    none = F.array().cast("array<string>")
    narrow = jobs.select(
        "id",
        F.coalesce("detected_skills", none).alias("skills"),
        F.size(F.array_distinct(F.coalesce("detected_skills", none))).alias("skill_count"),
        "category",
        "seniority",
        F.coalesce(F.length("title") > 0, F.lit(False)).alias("has_title"),
    )
    target = narrow.select(
        F.col("id").alias("job_id"),
        F.col("skills").alias("t_skills"),
        F.col("skill_count").alias("t_skill_count"),
        F.col("category").alias("t_category"),
        F.col("seniority").alias("t_seniority"),
    )
    candidate = narrow.withColumnRenamed("id", "candidate_id")
    shared = F.size("shared_skills")
    return (
        pool.join(candidate, "candidate_id")
        .join(target, "job_id")
        .withColumn("shared_skills", F.array_intersect("t_skills", "skills"))
        .select(
            "job_id",
            "candidate_id",
            "raw_score",
            "rank",
            "has_title",
            "shared_skills",
            scores.jaccard_of_sizes(shared, F.col("t_skill_count") + F.col("skill_count") - shared).alias("skill_overlap"),
            scores.same_label(F.col("t_category"), F.col("category")).alias("same_category"),
            scores.same_label(F.col("t_seniority"), F.col("seniority")).alias("same_seniority"),
        )
    )


def scored_pairs(jobs: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidate pairs of the pool with shared skills and unrounded scores.

    Only skills and labels are joined here; the display columns follow after the cut to the final rows.
    """
    return _pairs(jobs, pool).withColumn("shared_skills", F.array_sort("shared_skills"))


def recommend(
    jobs: DataFrame,
    vectors: DataFrame,
    targets: DataFrame | None = None,
    limit: int = 5,
    same_category_only: bool = False,
    min_shared_skills: int = 0,
    min_embedding_score: float | None = None,
    pool: int = rules.CANDIDATE_POOL,
    block_rows: int | None = None,
    cells=None,
    probes: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Top `limit` recommendations of each target.  Gates apply after the pool is cut, so fewer may remain.

    `cells` and `probes` choose how the pool is searched, see `nearest_jobs`.  Building the result writes the postings that
    have a vector, see `searched_postings`; with `stored` the jobs are such postings already.
    """
    _clamped("limit", limit, 1, 20)
    _clamped("min_shared_skills", min_shared_skills, 0, 10)
    _clamped("min_embedding_score", min_embedding_score, -1.0, 1.0)
    jobs = jobs if stored else searched_postings(jobs, vectors)
    pairs = _pairs(jobs, nearest_jobs(vectors, pool, targets, block_rows, cells, probes))
    gates = F.col("has_title") & ~F.isnan("raw_score") & (F.size("shared_skills") >= min_shared_skills)
    if same_category_only:
        gates = gates & F.col("same_category")
    if min_embedding_score is not None:
        gates = gates & (F.col("raw_score") >= min_embedding_score)
    ranked = pairs.filter(gates).select(
        "job_id",
        "candidate_id",
        scores.rounded(
            scores.hybrid(F.col("raw_score"), F.col("skill_overlap"), F.col("same_category"), F.col("same_seniority"))
        ).alias("score"),
        scores.rounded(F.col("raw_score")).alias("embedding_score"),
        scores.rounded(F.col("skill_overlap")).alias("skill_overlap_score"),
        "shared_skills",
        "same_category",
        "same_seniority",
        F.col("rank").alias("_pool_rank"),
    )
    order = Window.partitionBy("job_id").orderBy(
        F.col("score").desc(),
        F.col("embedding_score").desc(),
        F.size("shared_skills").desc(),
        F.col("same_category").desc(),
        F.col("same_seniority").desc(),
        "_pool_rank",
    )
    best = ranked.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    best = best.drop("_pool_rank").withColumn("shared_skills", F.array_sort("shared_skills"))
    return best.join(jobs.select(F.col("id").alias("candidate_id"), *SHOWN), "candidate_id")
