"""Ingest: normalise a snapshot, validate it and upsert it by address with change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.functions import rules, text
from vacantia.session import written

SOURCE_FIELDS = ["category", "company", "date_posted", "description", "location", "seniority", "title", "url"]
DERIVED_FIELDS = {
    "cleaned_description": "string",
    "detected_skills": "array<string>",
    "last_processed_at": "timestamp_ntz",
    "skills_extracted_at": "timestamp_ntz",
    "embedded_at": "timestamp_ntz",
    "chunked_at": "timestamp_ntz",
}
JOBS_SCHEMA = (
    "id bigint, title string, company string, location string, category string, seniority string, "
    "description string, cleaned_description string, detected_skills array<string>, date_posted date, url string, "
    "processing_status string, source_hash string, ingested_at timestamp_ntz, last_processed_at timestamp_ntz, "
    "skills_extracted_at timestamp_ntz, embedded_at timestamp_ntz, chunked_at timestamp_ntz"
)
JOBS_COLUMNS = [field.split()[0] for field in JOBS_SCHEMA.split(", ")]


def moment(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def source_hash() -> Column:
    """SHA-256 over the source fields; each is written with its length, so null, '' and borders differ."""
    parts = []
    for name in SOURCE_FIELDS:
        value = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def normalize(snapshot: DataFrame) -> DataFrame:
    """Normalised source fields, their hash and the row's ordinal."""
    fields = snapshot.select(
        "ordinal",
        text.trim_text(F.col("title")).alias("title"),
        text.trim_text(F.col("company")).alias("company"),
        text.city_of(F.col("location")).alias("location"),
        text.lower_label(F.col("category")).alias("category"),
        text.seniority_label(F.col("seniority")).alias("seniority"),
        text.trim_text(F.col("description")).alias("description"),
        text.parse_date(F.col("date_posted").cast("string")).alias("date_posted"),
        text.trim_text(F.col("url")).alias("url"),
    )
    return fields.withColumn("source_hash", source_hash())


def reject_reason() -> Column:
    """First failing check of a normalised row; null when it is valid."""
    too_short = F.coalesce(F.length("description"), F.lit(0)) < rules.MIN_INGEST_DESCRIPTION
    return (
        F.when(F.col("url").isNull(), "missing_url")
        .when(F.col("title").isNull(), "missing_title")
        .when(too_short, "short_description")
    )


def validate(normalized: DataFrame) -> DataFrame:
    return normalized.withColumn("reject_reason", reject_reason())


def last_per_url(rows: DataFrame) -> DataFrame:
    """Last row of each address.  The rank limit is applied before the shuffle, so a repeated address is cheap."""
    order = Window.partitionBy("url").orderBy(F.col("ordinal").desc())
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def upsert_actions(existing: DataFrame, snapshot: DataFrame, full_rebuild: bool = False) -> DataFrame:
    """One row per valid address of the snapshot with `action` inserted, updated or unchanged, and the known id.

    Only address, id and hash of the existing rows take part, so its texts are not shuffled.
    """
    valid = last_per_url(validate(normalize(snapshot)).filter("reject_reason IS NULL")).drop("reject_reason")
    known = existing.select("url", "id", F.col("source_hash").alias("known_hash"))
    changed = ~F.col("known_hash").eqNullSafe(F.col("source_hash")) | F.lit(full_rebuild)
    return (
        valid.join(known, "url", "left")
        .withColumn("action", F.when(F.col("id").isNull(), "inserted").when(changed, "updated").otherwise("unchanged"))
        .drop("known_hash")
    )


def numbered(rows: DataFrame, key: str, among: Column | None = None, digits: int = 3) -> DataFrame:
    """Add a unique positive `position` per row without a global sort or a second pass.

    The n-th row of hash bucket b gets b + 1 + (n - 1) * 16**digits, so numbers have gaps but do not depend on
    partitions, and a repeated run gives the same ones.  Rows are counted apart per value of `among`.
    """
    bucket = F.conv(F.substring(F.md5(F.col(key)), 1, digits), 16, 10).cast("bigint")
    inside = Window.partitionBy("_bucket", "_among").orderBy(key)
    number = F.col("_bucket") + 1 + (F.row_number().over(inside) - 1).cast("bigint") * 16**digits
    rows = rows.withColumns({"_bucket": bucket, "_among": F.lit(0) if among is None else among})
    return rows.withColumn("position", number).drop("_bucket", "_among")


def reset_derived(rows: DataFrame) -> DataFrame:
    blank = {name: F.lit(None).cast(kind) for name, kind in DERIVED_FIELDS.items()}
    return rows.withColumns({**blank, "processing_status": F.lit("pending")})


def stage(snapshot: DataFrame) -> DataFrame:
    """Normalised, validated rows with a number `_row` of their own, to be written once and then read by column."""
    return validate(normalize(snapshot)).withColumn("_row", F.monotonically_increasing_id())


def key_actions(existing: DataFrame, staged: DataFrame, full_rebuild: bool = False) -> DataFrame:
    """url, _row, id and action of the last valid staged row of each address (equal ordinals: the later row).

    Only addresses, hashes and numbers are read and shuffled, no texts.
    """
    order = Window.partitionBy("url").orderBy(F.col("ordinal").desc(), F.col("_row").desc())
    valid = staged.filter("reject_reason IS NULL").select("url", "ordinal", "_row", "source_hash")
    keys = valid.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1")
    known = existing.select("url", "id", F.col("source_hash").alias("known_hash"))
    changed = ~F.col("known_hash").eqNullSafe(F.col("source_hash")) | F.lit(full_rebuild)
    action = F.when(F.col("id").isNull(), "inserted").when(changed, "updated").otherwise("unchanged")
    return keys.join(known, "url", "left").select("url", "_row", "id", action.alias("action"))


def changed_rows(staged: DataFrame, actions: DataFrame, top: Column, now: str) -> DataFrame:
    """Full job rows for inserted and updated addresses, in state pending; new ids follow `top`.

    Ids are given to the narrow keys; texts join them by row number, so they are in no window.
    """
    changed = numbered(actions.filter("action <> 'unchanged'"), "url", F.col("id").isNull())
    keys = changed.select("_row", F.coalesce("id", F.col("position") + top).alias("id"))
    return reset_derived(staged.join(keys, "_row").withColumn("ingested_at", moment(now))).select(JOBS_COLUMNS)


def top_id(existing: DataFrame) -> Column:
    return existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()


def kept_rows(existing: DataFrame, actions: DataFrame, full_rebuild: bool = False) -> DataFrame:
    """Rows that the upsert leaves; `full_rebuild` resets them."""
    changed = actions.filter("action <> 'unchanged'").select("url")
    kept = existing.join(changed, "url", "left_anti").select(JOBS_COLUMNS)
    return reset_derived(kept).select(JOBS_COLUMNS) if full_rebuild else kept


def upsert_state(existing: DataFrame, snapshot: DataFrame, now: str, full_rebuild: bool = False) -> DataFrame:
    """State after the upsert.  Rows missing from the snapshot stay; `full_rebuild` resets every row.

    The snapshot is normalised and hashed once, into a written table; so are the actions.
    """
    staged = written(stage(snapshot), "staged")
    actions = written(key_actions(existing, staged, full_rebuild), "actions")
    changed = changed_rows(staged, actions, top_id(existing), now)
    return kept_rows(existing, actions, full_rebuild).unionByName(changed)


def _number_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def staged_counters() -> list[Column]:
    """Aggregates over the staged rows."""
    reason = F.col("reject_reason")
    return [
        F.count(F.lit(1)).alias("input_rows"),
        F.count(reason).alias("skipped_rows"),
        *[_number_where(reason == r).alias(r) for r in ("missing_url", "missing_title", "short_description")],
    ]


def action_counters() -> list[Column]:
    """Aggregates over the actions."""
    return [_number_where(F.col("action") == a).alias(f"{a}_rows") for a in ("inserted", "updated", "unchanged")]


def all_counters(staged: dict, acted: dict) -> dict:
    """Counters of one ingest from the aggregates over its staged rows and its actions."""
    changed = acted["inserted_rows"] + acted["updated_rows"]
    duplicates = staged["input_rows"] - staged["skipped_rows"] - changed - acted["unchanged_rows"]
    return {**staged, **acted, "changed_rows": changed, "duplicate_rows": duplicates}


def _counters(checked: DataFrame, acted: DataFrame) -> DataFrame:
    parts = checked.agg(*staged_counters()).unionByName(acted.agg(*action_counters()), allowMissingColumns=True)
    both = parts.agg(*[F.sum(c).alias(c) for c in parts.columns])
    both = both.withColumn("changed_rows", F.col("inserted_rows") + F.col("updated_rows"))
    rest = F.col("input_rows") - F.col("skipped_rows") - F.col("changed_rows") - F.col("unchanged_rows")
    return both.withColumn("duplicate_rows", rest).select(
        "input_rows", "inserted_rows", "updated_rows", "unchanged_rows", "changed_rows", "skipped_rows",
        "missing_url", "missing_title", "short_description", "duplicate_rows",
    )


def ingest_summary(existing: DataFrame, snapshot: DataFrame, full_rebuild: bool = False) -> DataFrame:
    """Counters of one ingest as a single row."""
    return _counters(validate(normalize(snapshot)), upsert_actions(existing, snapshot, full_rebuild))


def staged_summary(staged: DataFrame, actions: DataFrame) -> DataFrame:
    """The same from written staged rows and actions."""
    return _counters(staged, actions)


def stamp_touched(jobs: DataFrame, touched: DataFrame, column: str, now: str) -> DataFrame:
    """Set `column` for the ids in `touched.job_id`."""
    marks = touched.select(F.col("job_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return (
        jobs.join(marks, "id", "left")
        .withColumn(column, F.when(F.col("_hit"), moment(now)).otherwise(F.col(column)))
        .select(jobs.columns)
    )


DIRTY = {
    "process": "processing_status = 'pending'",
    "embed": "processing_status = 'processed' AND embedded_at IS NULL",
    "chunk": "processing_status = 'processed' AND chunked_at IS NULL",
}


def dirty_rows(jobs: DataFrame, stage: str) -> DataFrame:
    """Rows a stage still has to handle: process, embed or chunk."""
    return jobs.filter(DIRTY[stage])


def stamp_dirty(jobs: DataFrame, stage: str, column: str, now: str) -> DataFrame:
    """Set `column` of the rows that a stage had to handle, without a join."""
    return jobs.withColumn(column, F.when(F.expr(DIRTY[stage]), moment(now)).otherwise(F.col(column)))


def dirty_counts(jobs: DataFrame) -> DataFrame:
    """Rows to handle per stage, in one pass, and whether the stage has to run."""
    done = F.col("processing_status") == "processed"
    counts = jobs.agg(
        F.count_if(F.col("processing_status") == "pending").alias("process"),
        F.count_if(done & F.col("embedded_at").isNull()).alias("embed"),
        F.count_if(done & F.col("chunked_at").isNull()).alias("chunk"),
    )
    return counts.unpivot([], ["process", "embed", "chunk"], "stage", "dirty").withColumn(
        "needs_run", F.col("dirty") > 0
    )


def should_rebuild(dirty: int, output_exists: bool) -> bool:
    return dirty > 0 or not output_exists
