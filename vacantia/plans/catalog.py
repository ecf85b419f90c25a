"""Named queries over the given tables: name -> function of (session, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import scores, text
from vacantia.operators import (
    admission,
    answers,
    chunks,
    evaluate,
    ingest,
    keywords,
    neighbours,
    prepare,
    process,
    recommend,
    retrieve,
    runs,
    search,
    vectors,
)
from vacantia.plans import pipeline
from vacantia.session import ensure_checkpoint_dir, written
from vacantia.sources import adapters

NOW = "2024-03-01 00:00:00"
EARLIER = "2024-02-01 00:00:00"
TOP_K = 5
TOP_N = 10
NEWEST_ROWS = 100
ADMIT_LIMIT = 2
ADMIT_WINDOW = 6 * 3600

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


# --- shared inputs ---------------------------------------------------------------------


def pending_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a pending posting whose id is the document number."""
    rows = ingest.normalize(adapters.snapshot(spark, folder)).withColumns(
        {"id": F.col("ordinal"), "ingested_at": ingest.moment(EARLIER)}
    )
    return ingest.reset_derived(rows).select(ingest.JOBS_COLUMNS)


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return process.process_postings(pending_jobs(spark, folder), EARLIER)


def stored_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """State left by ingesting the older snapshot into an empty table; a few rows have lost their hash.

    It stands for a stored table, so it is written once.
    """
    ensure_checkpoint_dir(spark)
    empty = spark.createDataFrame([], ingest.JOBS_SCHEMA)
    state = ingest.upsert_state(empty, adapters.older_snapshot(spark, folder), EARLIER)
    return state.withColumn("source_hash", F.when(~F.endswith("url", F.lit("7")), F.col("source_hash"))).checkpoint()


def job_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.chunk_documents(jobs(spark, folder))


def retrieved(spark: SparkSession, folder: str) -> DataFrame:
    corpus = vectors.embed_texts(job_chunks(spark, folder), "chunk_text")
    return retrieve.retrieve(adapters.questions(spark, folder), corpus, TOP_K)


def searched(spark: SparkSession, folder: str, k: int = TOP_K * 4) -> DataFrame:
    corpus = vectors.embed_texts(job_chunks(spark, folder), "chunk_text")
    asked = retrieve.normalize_questions(adapters.questions(spark, folder))
    return retrieve.search_chunks(asked, corpus, k)


def stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The passages as a stored table, so that a job that reads them repeatedly cuts the texts once."""
    ensure_checkpoint_dir(spark)
    return job_chunks(spark, folder).checkpoint()


def joined(column: str) -> Column:
    return F.array_join(column, ",")


# --- scans and sources -------------------------------------------------------------------


@query
def dedup_first_by_key(spark, folder):
    rows = adapters.raw_postings(spark, folder).select(
        F.col("job_posting_url").alias("url"), "ordinal", "company_name", F.length("description").alias("n_chars")
    )
    return prepare.first_by_key(rows, "url")


@query
def vector_integrity(spark, folder):
    return vectors.vector_integrity(adapters.job_vectors(spark, folder))


# --- scalar expressions ------------------------------------------------------------------


@query
def clean_text(spark, folder):
    d = adapters.table(spark, folder, "documents")
    return d.select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query
def normalize_postings(spark, folder):
    return ingest.normalize(adapters.snapshot(spark, folder)).drop("source_hash", "seniority")


@query
def normalize_seniority(spark, folder):
    s = adapters.snapshot(spark, folder)
    return s.select("ordinal", text.seniority_label(F.col("seniority")).alias("seniority"))


@query
def classify_seniority(spark, folder):
    return adapters.raw_postings(spark, folder).select(
        "job_id",
        text.seniority_from_text(F.col("formatted_experience_level"), F.col("title"), F.col("description")).alias(
            "seniority"
        ),
    )


@query
def classify_category(spark, folder):
    return adapters.raw_postings(spark, folder).select(
        "job_id",
        text.category_from_title(F.col("title")).alias("category"),
        text.is_tech_title(F.col("title")).alias("is_tech"),
    )


@query
def parse_listed_date(spark, folder):
    return adapters.raw_postings(spark, folder).select(
        "job_id", text.listed_date(F.col("original_listed_time")).alias("date_posted")
    )


@query
def clean_description(spark, folder):
    d = adapters.table(spark, folder, "documents")
    return d.select("doc_id", text.clean_description(F.col("text")).alias("cleaned"))


@query
def extract_skills(spark, folder):
    tags = jobs(spark, folder).select(F.col("id").alias("job_id"), F.explode_outer("detected_skills").alias("skill"))
    return tags.filter("skill IS NOT NULL")


@query
def content_hash(spark, folder):
    return ingest.normalize(adapters.snapshot(spark, folder)).select("ordinal", "source_hash")


@query
def skill_jaccard(spark, folder):
    pool = vectors.nearest_jobs(adapters.job_vectors(spark, folder), 5)
    pairs = recommend.scored_pairs(jobs(spark, folder), pool)
    return pairs.select(
        "job_id", "candidate_id", joined("shared_skills").alias("shared_skills"), scores.rounded(F.col("skill_overlap")).alias("jaccard")
    )


@query
def keyword_overlap(spark, folder):
    return searched(spark, folder).select("question_id", "job_id", "chunk_order", "keyword_score")


@query
def split_sentences(spark, folder):
    d = adapters.table(spark, folder, "documents")
    found = d.select("doc_id", F.posexplode_outer(text.sentences(F.col("text"))).alias("position", "sentence"))
    return found.filter("sentence IS NOT NULL")


@query
def chunk_documents(spark, folder):
    return job_chunks(spark, folder)


@query
def question_type(spark, folder):
    q = adapters.questions(spark, folder)
    return q.select("question_id", text.question_type(F.col("question")).alias("question_type"))


@query
def freshness(spark, folder):
    return runs.freshness(adapters.run_log(spark, folder), "2024-02-01 00:00:00")


@query
def prompt_table(spark, folder):
    q = retrieve.normalize_questions(adapters.questions(spark, folder))
    return answers.prompt_table(q, retrieved(spark, folder))


@query
def decode_responses(spark, folder):
    return answers.decode_responses(adapters.model_responses(spark, folder)).drop("body")


# --- filters and predicates ----------------------------------------------------------------


@query
def validate_postings(spark, folder):
    rows = ingest.validate(ingest.normalize(adapters.snapshot(spark, folder)))
    return rows.select("ordinal", "reject_reason", F.col("reject_reason").isNull().alias("is_valid"))


SEARCH = {"keyword": "er", "location": "berlin", "category": "E", "skills": "sql,docker"}
PAGE = ("id", "title", "company", "location", "category", "seniority", "date_posted", "url")


@query
def search_postings(spark, folder):
    return search.search_postings(jobs(spark, folder), **SEARCH).select(*PAGE)


@query
def search_postings_page2(spark, folder):
    found = search.search_postings(
        jobs(spark, folder), keyword="a%e", seniority="senior", page=2, size=25, sort_by="location", sort_order="asc"
    )
    return found.select(*PAGE)


@query
def search_postings_keyset(spark, folder):
    """The same page as `search_postings_page2`, reached from the last row of the page before it."""
    options = {"keyword": "a%e", "seniority": "senior", "size": 25, "sort_by": "location", "sort_order": "asc"}
    table = jobs(spark, folder)
    last = search.search_postings(table, **options).select("location", "id").tail(1)
    after = (last[0]["location"], last[0]["id"]) if last else None
    return search.search_postings(table, **options, after=after).select(*PAGE)


def indexed_jobs(spark: SparkSession, folder: str, keyword: str) -> DataFrame:
    """Postings that hold a keyword, through an index built from all of them; both stand for stored tables."""
    table = written(jobs(spark, folder), "jobs")
    return keywords.holding(table, written(keywords.index_keywords(table), "keywords"), keyword)


@query
def search_postings_indexed(spark, folder):
    found = indexed_jobs(spark, folder, SEARCH["keyword"])
    return search.search_postings(found, **{k: v for k, v in SEARCH.items() if k != "keyword"}).select(*PAGE)


@query
def keyword_matches(spark, folder):
    return indexed_jobs(spark, folder, "IEUX%tion").select("id", "title")


@query
def search_total(spark, folder):
    return search.search_total(jobs(spark, folder), **SEARCH)


@query
def get_posting(spark, folder):
    return search.get_posting(jobs(spark, folder), 42).select(*PAGE, "description", joined("detected_skills").alias("skills"))


@query
def dirty_rows(spark, folder):
    state = stage_states(spark, folder)
    result = None
    for stage in ("process", "embed", "chunk"):
        rows = ingest.dirty_rows(state, stage).select(F.lit(stage).alias("stage"), "id")
        result = rows if result is None else result.unionByName(rows)
    return result


@query
def dirty_counts(spark, folder):
    return ingest.dirty_counts(stage_states(spark, folder))


def stage_states(spark: SparkSession, folder: str) -> DataFrame:
    """Postings in different states: labelled ones are processed, those with a vector also embedded."""
    labelled = adapters.table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("_done"))
    state = pending_jobs(spark, folder).join(labelled, "id", "left")
    state = state.withColumn("processing_status", F.when(F.col("_done"), "processed").otherwise("pending"))
    return ingest.stamp_touched(state.drop("_done"), adapters.job_vectors(spark, folder), "embedded_at", EARLIER)


# --- joins -----------------------------------------------------------------------------------


@query
def upsert_actions(spark, folder):
    found = ingest.upsert_actions(stored_jobs(spark, folder), adapters.snapshot(spark, folder))
    return found.select("ordinal", "url", "id", "action")


@query
def upsert_state(spark, folder):
    state = ingest.upsert_state(stored_jobs(spark, folder), adapters.snapshot(spark, folder), NOW)
    return state.select(
        "id", "title", "company", "location", "category", "seniority", "description", "date_posted", "url",
        "processing_status", "source_hash", "ingested_at",
    )


@query
def upsert_full_rebuild(spark, folder):
    state = ingest.upsert_state(
        process.process_postings(stored_jobs(spark, folder), EARLIER), adapters.snapshot(spark, folder), NOW, full_rebuild=True
    )
    return state.select("id", "url", "processing_status", "cleaned_description", "ingested_at")


@query
def stamp_touched(spark, folder):
    state = ingest.stamp_touched(pending_jobs(spark, folder), adapters.job_vectors(spark, folder), "embedded_at", NOW)
    return state.select("id", "embedded_at")


@query
def knn_topk(spark, folder):
    found = vectors.nearest_jobs(adapters.job_vectors(spark, folder), 10)
    return found.select("job_id", "candidate_id", scores.rounded(F.col("raw_score"), 6).alias("score"), "rank")


@query
def retrieve_topk(spark, folder):
    return searched(spark, folder).select("question_id", "rank", "job_id", "chunk_order", "title", "score", "keyword_score")


@query
def retrieve_topk_sparse(spark, folder):
    """`retrieve_topk` from an inverted index."""
    passages = stored_chunks(spark, folder)
    asked = retrieve.normalize_questions(adapters.questions(spark, folder))
    found = retrieve.search_index(asked, retrieve.index_chunks(passages), passages, TOP_K * 4)
    return found.select("question_id", "rank", "job_id", "chunk_order", "title", "score", "keyword_score")


@query
def knn_topk_cells(spark, folder):
    """`knn_topk` by cells; cells that cannot hold a neighbour are skipped."""
    table = adapters.job_vectors(spark, folder)
    ensure_checkpoint_dir(spark)
    found = vectors.nearest_jobs(table, 10, cells=neighbours.fit_cells(table))
    return found.select("job_id", "candidate_id", scores.rounded(F.col("raw_score"), 6).alias("score"), "rank")


def inverted_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Queries, and their approximate neighbours from so many lists as hold 0.97 of a sample's exact ones."""
    table = adapters.job_vectors(spark, folder)
    ensure_checkpoint_dir(spark)
    cells = neighbours.fit_cells(table)
    queries = table.withColumnRenamed("job_id", "query_id")
    index = neighbours.build_index(table.withColumnRenamed("job_id", "candidate_id"), cells).checkpoint()
    probes = neighbours.choose_probes(queries, index, cells, ["candidate_id"], TOP_N, exclude_same_id=True, target=0.97)
    return queries, neighbours.nearest_in_cells(queries, index, cells, ["candidate_id"], TOP_N, exclude_same_id=True, probes=probes)


@query
def knn_ivf(spark, folder):
    """Approximate neighbours; no SQL counterpart, `knn_ivf_recall` holds them against exact search."""
    found = inverted_lists(spark, folder)[1]
    return found.select(F.col("query_id").alias("job_id"), "candidate_id", scores.rounded(F.col("raw_score"), 6).alias("score"), "rank")


@query
def knn_ivf_recall(spark, folder):
    queries, found = inverted_lists(spark, folder)
    truth = vectors.nearest(queries, queries.withColumnRenamed("query_id", "candidate_id"), ["candidate_id"], TOP_N, exclude_same_id=True)
    return neighbours.recall(found, truth, ["candidate_id"]).select("neighbours", (F.col("recall") >= 0.9).alias("reached"))


APPROXIMATE = {"knn_ivf"}


# --- aggregations ------------------------------------------------------------------------------


@query
def skills_per_posting(spark, folder):
    return prepare.skills_per_posting(adapters.job_skills(spark, folder))


@query
def top_skills(spark, folder):
    return search.top_skills(jobs(spark, folder))


@query
def top_skills_filtered(spark, folder):
    return search.top_skills(jobs(spark, folder), category=" EN ", seniority="senior", limit=500)


@query
def ingest_summary(spark, folder):
    return ingest.ingest_summary(stored_jobs(spark, folder), adapters.snapshot(spark, folder))


@query
def process_summary(spark, folder):
    return process.process_summary(jobs(spark, folder))


@query
def chunk_summary(spark, folder):
    return chunks.chunk_summary(job_chunks(spark, folder))


@query
def category_counts(spark, folder):
    return prepare.label_counts(prepared_all(spark, folder), "category")


@query
def seniority_counts(spark, folder):
    return prepare.label_counts(prepared_all(spark, folder), "seniority", 10)


@query
def top_terms(spark, folder):
    return answers.top_terms(job_chunks(spark, folder), "category", ["job_id", "chunk_order"], "chunk_text", 10)


@query
def eval_recommendations_cases(spark, folder):
    return evaluate.recommendation_cases(jobs(spark, folder), adapters.job_vectors(spark, folder))


@query
def eval_recommendations(spark, folder):
    return evaluate.recommendation_summary(eval_recommendations_cases(spark, folder))


def evaluation_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Expected keywords of a question: its distinct words of nine or more letters."""
    words = F.filter(text.word_set(F.col("question")), lambda w: F.length(w) >= 9)
    return adapters.questions(spark, folder).select("question_id", words.alias("expected_keywords"))


@query
def eval_answers_cases(spark, folder):
    found = evaluate.answer_cases(evaluation_cases(spark, folder), extractive_answers(spark, folder))
    return found.select(
        "question_id", joined("matched_keywords").alias("matched_keywords"), "keyword_hit_rate", "answer_length",
        "retrieved_chunk_count", "retrieved_job_count",
    )


@query
def eval_answers_summary(spark, folder):
    return evaluate.answer_summary(
        evaluate.answer_cases(evaluation_cases(spark, folder), extractive_answers(spark, folder))
    )


@query
def latency_summary(spark, folder):
    return runs.latency_summary(adapters.request_log(spark, folder))


# --- windows, top-k and set operations ------------------------------------------------------------


@query
def rerank(spark, folder):
    return retrieve.rerank(searched(spark, folder)).select("question_id", "job_id", "chunk_order", "final_score", "final_rank")


@query
def dedup_per_job(spark, folder):
    kept = retrieve.limit_per_job(retrieve.rerank(searched(spark, folder)), 2)
    return kept.select("question_id", "job_id", "chunk_order", "final_rank")


@query
def chunk_ids(spark, folder):
    return chunks.with_chunk_ids(stored_chunks(spark, folder), 64).select("job_id", "chunk_order", "chunk_id")


@query
def latest_runs(spark, folder):
    return runs.with_duration(runs.latest_runs(adapters.run_log(spark, folder)))


def prepared_all(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.prepare_postings(adapters.raw_postings(spark, folder), adapters.job_skills(spark, folder), None)


@query
def prepare_postings(spark, folder):
    return prepared_all(spark, folder)


@query
def prepare_newest(spark, folder):
    return prepare.prepare_postings(adapters.raw_postings(spark, folder), adapters.job_skills(spark, folder), NEWEST_ROWS)


@query
def union_buckets(spark, folder):
    rows = prepare.usable(prepare.normalize_raw(adapters.raw_postings(spark, folder), adapters.job_skills(spark, folder)))
    return prepare.union_buckets(rows).select("url", "ordinal", "title", "category", "priority")


def _display(found: DataFrame) -> DataFrame:
    return found.withColumn("shared_skills", joined("shared_skills"))


@query
def recommend_topn(spark, folder):
    return _display(recommend.recommend(jobs(spark, folder), adapters.job_vectors(spark, folder)))


@query
def recommend_filtered(spark, folder):
    return _display(
        recommend.recommend(
            jobs(spark, folder), adapters.job_vectors(spark, folder), limit=10, same_category_only=True,
            min_shared_skills=1, min_embedding_score=0.05,
        )
    )


@query
def retrieve_topk_filtered(spark, folder):
    return retrieved(spark, folder).select(
        "question_id", "position", "job_id", "chunk_order", "title", "location", "category", "final_score"
    )


@query
def retrieve_topk_prefiltered(spark, folder):
    corpus = vectors.embed_texts(job_chunks(spark, folder), "chunk_text")
    return retrieve.retrieve(adapters.questions(spark, folder), corpus, TOP_K, prefilter=True).select(
        "question_id", "position", "job_id", "chunk_order", "title", "location", "category", "final_score"
    )


@query
def knn_topk_blocked(spark, folder):
    found = vectors.nearest_jobs(adapters.job_vectors(spark, folder), 10, block_rows=64)
    return found.select("job_id", "candidate_id", scores.rounded(F.col("raw_score"), 6).alias("score"), "rank")


# --- stateful and composite --------------------------------------------------------------------------


@query
def rate_limit(spark, folder):
    log = adapters.request_log(spark, folder).withColumn(
        "key", admission.client_key(F.col("forwarded_for"), F.col("host"))
    )
    return admission.decide(log, "key", "ts", "event_id", ADMIT_LIMIT, ADMIT_WINDOW)


@query
def incremental_equals_full(spark, folder):
    """Chunks after an incremental run: labelled postings were chunked before, from their older text."""
    full = jobs(spark, folder)
    labels = adapters.table(spark, folder, "labels").select(F.col("doc_id").alias("job_id"), "quality", "toxic")
    stale = labels.filter("quality = 0 OR toxic = 1")
    before = full.join(labels.select(F.col("job_id").alias("id")), "id", "left_semi")
    outdated = before.withColumn("cleaned_description", F.concat(F.lit("draft. "), "cleaned_description")).join(
        stale.select(F.col("job_id").alias("id")), "id", "left_semi"
    )
    unchanged = before.join(stale.select(F.col("job_id").alias("id")), "id", "left_anti")
    existing = chunks.chunk_documents(outdated.unionByName(unchanged.select(outdated.columns)))
    stamped = ingest.stamp_touched(full, unchanged.select(F.col("id").alias("job_id")), "chunked_at", EARLIER)
    dirty = ingest.dirty_rows(stamped, "chunk")
    fresh = chunks.chunk_documents(dirty)
    now = chunks.replace_chunks(existing, fresh, dirty.select(F.col("id").alias("job_id")))
    return now.select("job_id", "chunk_order", "chunk_length", F.md5("chunk_text").alias("chunk_md5"))


@query
def process_postings(spark, folder):
    return jobs(spark, folder).select(
        "id", "cleaned_description", joined("detected_skills").alias("skills"), "processing_status", "last_processed_at"
    )


@query
def pipeline_summary(spark, folder):
    return pipeline.pipeline_summary(stored_jobs(spark, folder), adapters.snapshot(spark, folder), NOW)


@query
def answers_generated(spark, folder):
    corpus = vectors.embed_texts(job_chunks(spark, folder), "chunk_text")
    responses = adapters.model_responses(spark, folder).filter("turn = 1").withColumnRenamed("conv_id", "question_id")
    found = answers.answer(adapters.questions(spark, folder), corpus, responses, TOP_K)
    return found.select("question_id", "question_type", "answer", "generation_mode", "source_count", "job_count")


@query
def extractive_answers(spark, folder):
    asked = retrieve.normalize_questions(adapters.questions(spark, folder))
    return answers.extractive_answers(asked, retrieved(spark, folder))


@query
def embed_norms(spark, folder):
    rows = vectors.embed_texts(jobs(spark, folder).select("id", "cleaned_description"), "cleaned_description")
    wide = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    filled = F.size(F.filter(wide, lambda x: x > 0))
    return rows.select("id", scores.rounded(norm).alias("norm"), filled.alias("filled_buckets"))
