"""Search: filtered, sorted pages of postings and lookup by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import text

SORT_COLUMNS = ("date_posted", "title", "company", "location", "category", "seniority")


def _trimmed(value: str | None, lower: bool = False) -> str | None:
    if value is None or not value.strip():
        return None
    return value.strip().lower() if lower else value.strip()


def matching(
    jobs: DataFrame,
    keyword: str | None = None,
    location: str | None = None,
    category: str | None = None,
    seniority: str | None = None,
    skills: str | None = None,
    exact_skills: bool = False,
) -> DataFrame:
    """Postings that contain the given texts, ignoring case.  `%` and `_` in them act as wildcards.

    A skill matches as part of the comma-joined list; `exact_skills` compares whole skills instead.
    """
    wanted = {
        "location": _trimmed(location),
        "category": _trimmed(category, lower=True),
        "seniority": _trimmed(seniority, lower=True),
    }
    # Short columns are tested first; long texts only for rows that are left.
    for name, value in wanted.items():
        if value:
            jobs = jobs.filter(F.col(name).ilike(f"%{value}%"))
    keyword = _trimmed(keyword)
    if keyword and len(keyword) >= 2:
        like = f"%{keyword}%"
        jobs = jobs.filter(
            F.col("title").ilike(like) | F.col("description").ilike(like) | F.col("cleaned_description").ilike(like)
        )
    names = [s.strip() for s in (skills or "").split(",") if s.strip()]
    if names and exact_skills:
        jobs = jobs.filter(F.size(F.array_intersect(F.array(*map(F.lit, names)), "detected_skills")) == len(set(names)))
    elif names:
        jobs = jobs.filter(
            text.let(
                F.array_join("detected_skills", ","),
                lambda joined: reduce(lambda a, b: a & b, [joined.ilike(f"%{n}%") for n in names]),
            )
        )
    return jobs


def search_postings(
    jobs: DataFrame,
    keyword: str | None = None,
    location: str | None = None,
    category: str | None = None,
    seniority: str | None = None,
    skills: str | None = None,
    page: int = 1,
    size: int = 20,
    sort_by: str = "date_posted",
    sort_order: str = "desc",
    exact_skills: bool = False,
    after: tuple[object, int] | None = None,
) -> DataFrame:
    """One page.  Nulls come first when descending and last when ascending; equal keys are ordered by id.

    With `after`, the sort value and id of the last row seen, the page begins behind that row: no earlier row is sorted
    or sent, however deep the page is.
    """
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and size is 1 to 100")
    column = F.col(sort_by if sort_by in SORT_COLUMNS else "date_posted")
    descending = sort_order.lower() == "desc"
    key = column.desc_nulls_first() if descending else column.asc_nulls_last()
    found = matching(jobs, keyword, location, category, seniority, skills, exact_skills)
    if after is not None:
        value, last = after
        same = column.isNull() if value is None else column == F.lit(value)
        if value is None:
            beyond = column.isNotNull() if descending else F.lit(False)
        else:
            beyond = column < F.lit(value) if descending else (column > F.lit(value)) | column.isNull()
        found = found.filter(beyond | (same & (F.col("id") > last)))
    return found.orderBy(key, "id").offset((page - 1) * size).limit(size)


def search_total(jobs: DataFrame, **filters) -> DataFrame:
    return matching(jobs, **filters).agg(F.count("*").alias("total"))


def get_posting(jobs: DataFrame, posting_id: int) -> DataFrame:
    return jobs.filter(F.col("id") == posting_id)


def top_skills(
    jobs: DataFrame, category: str | None = None, seniority: str | None = None, limit: int | None = 10
) -> DataFrame:
    """Most frequent skills, equal counts by name; a limit is kept within 1 to 50, None gives all skills."""
    found = matching(jobs, category=category, seniority=seniority)
    skill = found.select(F.explode_outer("detected_skills").alias("skill")).select(
        text.trim_text(F.col("skill")).alias("skill")
    )
    counts = skill.filter("skill IS NOT NULL").groupBy("skill").agg(F.count("*").alias("count"))
    ordered = counts.orderBy(F.col("count").desc(), "skill")
    return ordered if limit is None else ordered.limit(min(max(limit, 1), 50))


def parse_skills(joined):
    """Distinct skills of a comma-joined text."""
    parts = F.transform(F.split(F.coalesce(joined, F.lit("")), ","), text.strip)
    return F.array_distinct(F.filter(parts, lambda s: s != ""))


