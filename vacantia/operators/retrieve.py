"""Retrieval: passages for a table of questions, filtered, re-ranked and limited per posting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.functions import rules, scores, text
from vacantia.operators.vectors import Best, best_of_each, embed_texts, estimated_bytes, nearest, packed, text_weights, unpacked

UNKNOWN_BYTES = 1 << 60  # the optimizer's estimate of rows it knows nothing of, such as local ones, is beyond
BROADCAST_QUESTION_BYTES = 4 << 20
BUCKET_SALTS = 32
POSTING_ROWS = 1 << 18  # rows of the index that are scored at once
PASSAGE = ["job_id", "chunk_order"]


def normalize_questions(questions: DataFrame, strict: bool = True) -> DataFrame:
    """Trim all inputs, lower-case category and seniority.

    A blank question fails when the row is read; without `strict` it is left out (see `blank_questions`).
    """
    asked = text.trim_text(F.col("question"))
    kept = questions if strict else questions.filter(asked.isNotNull())
    return kept.select(
        "question_id",
        F.coalesce(asked, F.raise_error(F.lit("question cannot be empty")).cast("string")).alias("question"),
        text.lower_label(F.col("category")).alias("category"),
        text.trim_text(F.col("location")).alias("location"),
        text.lower_label(F.col("seniority")).alias("seniority"),
    )


def blank_questions(questions: DataFrame) -> DataFrame:
    """The questions that `strict=False` leaves out, with the reason."""
    blank = questions.filter(text.trim_text(F.col("question")).isNull())
    return blank.select("question_id", F.lit("blank_question").alias("reason"))


FILTERS = ("category", "location", "seniority")


def _label_codes(rows: DataFrame, wanted: bool) -> list[Column]:
    """A number for each filter label; null where a question does not ask for one."""
    found = []
    for name in FILTERS:
        label = text.blank_to_null(F.col(name)) if wanted else F.coalesce(F.col(name), F.lit(""))
        found.append(F.when(label.isNotNull(), F.xxhash64(F.lower(label))).alias(f"_label_{name}"))
    return found


def search_chunks(
    questions: DataFrame, chunks: DataFrame, k: int, load_encoder=None, block_rows: int | None = None, prefilter: bool = False,
    query_blocks: int | None = None,
) -> DataFrame:
    """Top k passages per question with rounded vector and keyword scores.  `chunks` carries `embedding`.

    With `prefilter` only passages that match the question's filters compete for the k places.  The passages are read
    once: what is shown of them travels with their vectors, a copy for each block of questions.
    """
    labels = [f"_label_{name}" for name in FILTERS] if prefilter else []
    asked = questions.select(F.col("question_id").alias("query_id"), "question", *(_label_codes(questions, True) if prefilter else []))
    corpus = chunks.withColumn("chunk_order", F.col("chunk_order").cast("bigint")).select("*", *(_label_codes(chunks, False) if prefilter else []))
    shown = [c for c in chunks.columns if c not in ("job_id", "chunk_order", "embedding")]
    hits = nearest(embed_texts(asked, "question", load_encoder), corpus, ["job_id", "chunk_order"], k, block_rows=block_rows, labels=labels,
                   payload=shown, query_blocks=query_blocks)
    return _with_scores(hits.withColumnRenamed("query_id", "question_id"), questions)


def _with_scores(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Rounded vector and keyword scores of hits that carry `chunk_text` and `raw_score`."""
    words = questions.select("question_id", text.word_set(F.col("question")).alias("_words"))
    return (
        hits.join(words, "question_id")
        .withColumn("score", scores.rounded(F.col("raw_score")))
        .withColumn(
            "keyword_score",
            scores.rounded(scores.overlap_share(F.col("_words"), text.word_set(F.col("chunk_text")))),
        )
        .drop("_words", "raw_score")
    )


def index_chunks(chunks: DataFrame) -> DataFrame:
    """Inverted index of passages by the default embedding: bucket, job_id, chunk_order, weight."""
    ids = chunks.select("job_id", F.col("chunk_order").cast("bigint").alias("chunk_order"), "chunk_text")
    return text_weights(ids, "chunk_text").select("bucket", "job_id", "chunk_order", "weight")


def _passage_starts(rows: pa.Table) -> np.ndarray:
    """Where in rows ordered by passage the next passage begins; null ids are a passage of their own."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for name in PASSAGE:
        for values in (pc.fill_null(rows.column(name), 0).to_numpy(), pc.is_null(rows.column(name)).to_numpy()):
            new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _whole_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of some POSTING_ROWS rows that end where a passage ends."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= POSTING_ROWS:
            whole = pa.Table.from_batches(held)
            last = int(_passage_starts(whole)[-1])
            yield whole.slice(0, last)
            held = whole.slice(last).combine_chunks().to_batches()
            rows = len(whole) - last
    if held:
        yield pa.Table.from_batches(held)


def _score_lists(rows: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The best k passages of each question among those with a common bucket; the postings are added up list by list."""
    starts = _passage_starts(rows)
    passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    ids, question = np.unique(asked.column("question_id").to_numpy(), return_inverse=True)
    width = 1 + max(pc.max(t.column("bucket")).as_py() for t in (rows, asked))

    def lists(owner: np.ndarray, table: pa.Table, weight: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owners and summed weights by bucket, and where a bucket begins."""
        owners = int(owner.max()) + 1
        keys, place = np.unique(table.column("bucket").to_numpy().astype(np.int64) * owners + owner, return_inverse=True)
        return keys % owners, np.bincount(place, table.column(weight).to_numpy().astype(np.float64)), np.searchsorted(keys // owners, np.arange(width + 1))

    held, weight, at = lists(passage, rows, "weight")
    wanted, asked_weight, asked_at = lists(question, asked, "_asked")
    sums = np.zeros((len(ids), len(starts)))
    for bucket in range(width):
        p, q = slice(at[bucket], at[bucket + 1]), slice(asked_at[bucket], asked_at[bucket + 1])
        if p.start < p.stop and q.start < q.stop:
            sums[wanted[q][:, None], held[p]] += asked_weight[q][:, None] * weight[p]
    scores = np.where(sums > 0, np.round(sums, 9), -np.inf)
    first = rows.take(pa.array(starts))
    # Null ids come first among equal scores.
    order = [pc.fill_null(first.column(name), np.iinfo(np.int64).min).to_numpy() for name in PASSAGE]
    best = Best(k, len(ids), len(PASSAGE) + 1)
    best.add(scores, [*order, np.arange(len(starts))])
    best.settle()
    found = first.take(pa.array(best.ids[-1]))
    return pa.table([pa.array(ids[best.query]), *[found.column(name) for name in PASSAGE], pa.array(best.score)], names=["query_id", *PASSAGE, "raw_score"])


def _broadcast_sums(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(job_id, chunk_order, question_id, raw_score): the best k passages of each question in every task, of those with a common bucket."""
    rows = index.select(F.col("job_id").cast("bigint").alias("job_id"), "chunk_order", "bucket", "weight").dropna(subset=["bucket", "weight"])
    ordered = rows.repartition(*PASSAGE).sortWithinPartitions(*PASSAGE)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kept = None, 0
        for batch in batches:
            for lists, questions in zip(batch.column("_index"), batch.column("_questions")):
                found = _score_lists(unpacked(lists), unpacked(questions), k)
                best = found if best is None else pa.concat_tables([best, found])
                if len(best) > 4 * kept:
                    best = best_of_each(best, PASSAGE, k)
                    kept = len(best)
        if best is not None:
            yield from best_of_each(best, PASSAGE, k).combine_chunks().to_batches()

    questions = packed(asked.select(F.col("question_id").cast("bigint").alias("question_id"), "bucket", "_asked").dropna().coalesce(1), "_questions")
    met = packed(ordered, "_index", _whole_passages).crossJoin(F.broadcast(questions))
    return met.mapInArrow(score, "query_id long, job_id long, chunk_order long, raw_score double").select(*PASSAGE, F.col("query_id").alias("question_id"), "raw_score")


def _question_bytes(questions: DataFrame) -> int:
    """The optimizer's estimate, or the length of the questions where it has none."""
    expected = estimated_bytes(questions)
    return expected if expected < UNKNOWN_BYTES else questions.agg(F.sum(F.octet_length("question"))).first()[0] or 0


def search_index(
    questions: DataFrame, index: DataFrame, chunks: DataFrame, k: int, broadcast_bytes: int = BROADCAST_QUESTION_BYTES, salts: int = BUCKET_SALTS
) -> DataFrame:
    """The same rows as `search_chunks`, from an inverted index (see `index_chunks`) instead of vectors.

    Weights of questions and passages meet by equality of their buckets and are summed by question and passage.  While there are
    at most `broadcast_bytes` of questions by the optimizer's estimate (measured where it has none), their weights are broadcast and the index is dealt by passage:
    a task adds up the lists of some thousand passages at once, and no pair of question and passage becomes a row unless it
    is among the best of its task.  Beyond that both sides are shuffled by bucket: rows of the
    index over `salts` salts each, since a bucket may hold most passages, with a copy of the questions' weights per salt.
    Passages without a common word have score 0 and fill the places that are left, by id.
    """
    ids = PASSAGE
    asked = text_weights(questions.select("question_id", "question"), "question").withColumnRenamed("weight", "_asked")
    index = index.withColumn("chunk_order", F.col("chunk_order").cast("bigint"))
    if _question_bytes(questions) <= broadcast_bytes:
        sums = _broadcast_sums(index, asked, 3 * k)
    else:
        salt = F.pmod(F.xxhash64(*ids), F.lit(salts)).cast("int")
        copies = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = index.withColumn("_salt", salt).join(copies, ["bucket", "_salt"])
        product = F.col("weight").cast("double") * F.col("_asked").cast("double")
        sums = met.groupBy(*ids, "question_id").agg(F.round(F.sum(product), 9).alias("raw_score"))
    first = F.broadcast(chunks.select("job_id", F.col("chunk_order").cast("bigint").alias("chunk_order")).dropna().orderBy(*ids).limit(2 * k))  # 2 k rows
    fill = questions.select("question_id").dropna().crossJoin(first).withColumn("raw_score", F.lit(0.0))
    best = Window.partitionBy("question_id").orderBy(F.col("raw_score").desc(), *ids)
    some = sums.unionByName(fill.select(sums.columns)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= 3 * k)
    once = some.groupBy("question_id", *ids).agg(F.max("raw_score").alias("raw_score"))
    hits = once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    shown = chunks.drop("embedding").withColumn("chunk_order", F.col("chunk_order").cast("bigint"))
    return _with_scores(shown.join(F.broadcast(hits) if estimated_bytes(questions) <= broadcast_bytes else hits, ids), questions)


def matches_filters() -> Column:
    """Exact, case-insensitive match of every filter that the question sets."""
    tests = F.lit(True)
    for name in ("category", "location", "seniority"):
        wanted = text.blank_to_null(F.col(f"want_{name}"))
        tests = tests & (wanted.isNull() | (F.lower(wanted) == F.lower(F.coalesce(F.col(name), F.lit("")))))
    return tests


def rerank(hits: DataFrame) -> DataFrame:
    """Weighted score of the rounded inputs; equal scores keep the retrieval order."""
    mixed = F.lit(rules.WEIGHT_RETRIEVAL) * F.col("score") + F.lit(rules.WEIGHT_KEYWORDS) * F.col("keyword_score")
    scored = hits.withColumn("final_score", scores.rounded(mixed))
    order = Window.partitionBy("question_id").orderBy(F.col("final_score").desc(), "rank")
    return scored.withColumn("final_rank", F.row_number().over(order))


def limit_per_job(hits: DataFrame, per_job: int = 2) -> DataFrame:
    """At most `per_job` passages of one posting per question, best first."""
    order = Window.partitionBy("question_id", "job_id").orderBy("final_rank")
    return hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_job).drop("_n")


def retrieve(
    questions: DataFrame, chunks: DataFrame, top_k: int = 3, load_encoder=None, block_rows: int | None = None,
    prefilter: bool = False, strict: bool = True, index: DataFrame | None = None,
) -> DataFrame:
    """Retrieve, filter, re-rank, keep one passage per posting and the top_k of them, per question.

    Filters run after the retrieval cut of 4 x top_k, so fewer than top_k rows may remain; with `prefilter` they run
    before it.  Without `strict` blank questions are left out instead of failing.  With `index` (see `index_chunks`) the
    passages need no vectors; it serves the default embedding without `prefilter`.
    """
    if index is not None and (prefilter or load_encoder):
        raise ValueError("an index serves the default embedding and filters after the cut")
    if not 1 <= top_k <= 10:
        raise ValueError("top_k must be between 1 and 10")
    asked = normalize_questions(questions, strict)
    wants = asked.select(
        "question_id",
        "question",
        *[F.col(c).alias(f"want_{c}") for c in ("category", "location", "seniority")],
    )
    most = top_k * rules.RETRIEVAL_FACTOR
    hits = search_index(asked, index, chunks, most) if index is not None else search_chunks(asked, chunks, most, load_encoder, block_rows, prefilter)
    kept = hits.join(wants, "question_id").filter(matches_filters())
    one_each = limit_per_job(rerank(kept), 1)
    order = Window.partitionBy("question_id").orderBy("final_rank")
    return (
        one_each.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= top_k)
        .drop("want_category", "want_location", "want_seniority")
    )
