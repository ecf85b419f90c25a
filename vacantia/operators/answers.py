"""Answers: extractive texts, prompts for offline inference and decoding of service responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.functions import rules, text
from vacantia.operators.retrieve import normalize_questions, retrieve


def top_terms(texts: DataFrame, group: str, order_columns: list[str], column: str, n: int = 5) -> DataFrame:
    """Most frequent terms per group; equal counts by first appearance in `order_columns` order.

    Counts and first places are combined before the shuffle.  The order columns and the word position are
    packed into one decimal, which keeps the aggregation buffer fixed-size.
    """
    place = F.lit(0).cast("decimal(38,0)")
    for name in order_columns:
        place = (place * F.lit(10**9).cast("decimal(10,0)") + F.col(name).cast("decimal(18,0)")).cast("decimal(38,0)")
    found = F.posexplode_outer(text.term_list(F.col(column))).alias("_at", "term")
    words = texts.select(group, place.alias("_row"), found).filter("term IS NOT NULL")
    first = (F.col("_row") * F.lit(10**9).cast("decimal(10,0)") + F.col("_at")).cast("decimal(38,0)")
    counts = words.groupBy(group, "term").agg(F.count("*").alias("n"), F.min(first).alias("_first"))
    order = Window.partitionBy(group).orderBy(F.col("n").desc(), "_first")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("_first")


def _first_line(hit: Column) -> Column:
    """Title, place and first sentence of a passage."""
    sentence = F.coalesce(F.get(text.answer_sentences(hit["chunk_text"]), 0), hit["chunk_text"])
    title, place = F.coalesce(hit["title"], F.lit("None")), F.coalesce(hit["location"], F.lit("None"))
    return F.concat(F.lit("- "), title, F.lit(" ("), place, F.lit("): "), sentence)


def _frequent(terms: Column, n: int) -> Column:
    """The n most frequent items of a short list, equal counts by first appearance."""
    counted = F.transform(F.array_distinct(terms), lambda t, i: F.struct(
        (-F.size(F.filter(terms, lambda x: x == t))).alias("less"), i.alias("at"), t.alias("term")))
    return F.transform(F.slice(F.array_sort(counted), 1, n), lambda x: x["term"])


def extractive_answers(questions: DataFrame, hits: DataFrame, with_sources: bool = False) -> DataFrame:
    """Answer text per question.  Questions without passages get the fixed text.

    One pass over the hits: the passages of a question, at most top_k, are packed into one list, from which lines, terms
    and counts follow.  `with_sources` keeps the list as `sources`.
    """
    packed = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(
        F.struct("position", "job_id", "title", "location", "chunk_text"))).alias("sources"))
    found = questions.select("question_id", "question").join(packed, "question_id", "left")
    own = F.col("sources")
    # One line per posting and title, at its best passage.
    single = F.filter(own, lambda x, i: ~F.exists(
        F.slice(own, 1, i), lambda y: (y["job_id"] == x["job_id"]) & y["title"].eqNullSafe(x["title"])))
    all_terms = F.flatten(F.transform(own, lambda x: F.coalesce(text.term_list(x["chunk_text"]), F.array().cast("array<string>"))))
    found = found.select("*", F.array_join(F.transform(single, _first_line), "\n").alias("lines"), all_terms.alias("_terms"))
    found = found.withColumn("terms", F.when(F.size("_terms") > 0, F.array_join(_frequent(F.col("_terms"), 6), ", ")))
    kind = text.question_type(F.col("question"))
    themes = F.when(F.col("terms").isNotNull(), F.concat(F.lit(rules.TERMS_PREFIX), "terms", F.lit(".\n")))
    skills = F.concat(F.coalesce(themes, F.lit("")), F.lit(rules.HEADER_EXAMPLES + "\n"), "lines")
    answer = (
        F.when(own.isNull(), rules.NO_ANSWER)
        .when(kind == "skills", skills)
        .when(kind == "jobs", F.concat(F.lit(rules.HEADER_JOBS + "\n"), "lines"))
        .otherwise(F.concat(F.lit(rules.HEADER_GENERAL + "\n"), "lines"))
    )
    jobs = F.array_distinct(F.filter(F.transform(own, lambda x: x["job_id"]), lambda x: x.isNotNull()))
    return found.select(
        "question_id",
        "question",
        kind.alias("question_type"),
        answer.alias("answer"),
        F.lit("extractive").alias("generation_mode"),
        F.when(own.isNull(), 0).otherwise(F.size(own)).cast("bigint").alias("source_count"),
        F.when(own.isNull(), 0).otherwise(F.size(jobs)).cast("bigint").alias("job_count"),
        *([own] if with_sources else []),
    )


def answer(
    questions: DataFrame, chunks: DataFrame, responses: DataFrame | None = None, top_k: int = 3, load_encoder=None,
    prefilter: bool = False, strict: bool = True,
) -> DataFrame:
    """Retrieval and answer in one call, with sources: the decoded response where there is one, else the extract."""
    hits = retrieve(questions, chunks, top_k, load_encoder, prefilter=prefilter, strict=strict)
    extracts = extractive_answers(normalize_questions(questions, strict), hits, with_sources=True)
    return extracts if responses is None else prefer_generated(extracts, responses)


def prompt_table(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Prompt text per question with numbered sources, for inference outside of this library."""
    numbered = F.transform(
        F.array_sort(F.col("chunks")),
        lambda x, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("] "), x["chunk_text"]),
    )
    context = hits.groupBy("question_id").agg(F.collect_list(F.struct("position", "chunk_text")).alias("chunks"))
    return (
        questions.select("question_id", "question")
        .join(context, "question_id")
        .select(
            "question_id",
            F.concat(
                F.lit(rules.PROMPT_HEAD),
                "question",
                F.lit(rules.PROMPT_CONTEXT),
                F.array_join(numbered, "\n\n"),
                F.lit(rules.PROMPT_TAIL),
            ).alias("prompt"),
        )
    )


def response_text(body: Column) -> Column:
    """Answer text of the known response shapes; null for any other, also where the field is no string."""
    parsed = F.try_parse_json(body)

    def string_at(path: str) -> Column:
        field = F.try_variant_get(parsed, path, "variant")
        return F.when(F.schema_of_variant(field) == "STRING", text.strip(F.try_variant_get(parsed, path, "string")))

    paths = ["$.text", "$.output", "$.choices[0].text", "$.choices[0].message.content"]
    return F.coalesce(*[string_at(path) for path in paths])


def decode_responses(responses: DataFrame) -> DataFrame:
    return responses.withColumn("answer", response_text(F.col("body"))).withColumn(
        "is_known_shape", F.col("answer").isNotNull()
    )


def prefer_generated(answers: DataFrame, responses: DataFrame) -> DataFrame:
    """Replace extractive answers by decoded ones where a question has a non-empty response."""
    decoded = responses.select("question_id", text.blank_to_null(response_text(F.col("body"))).alias("_generated"))
    has_sources = F.col("source_count") > 0
    use = has_sources & F.col("_generated").isNotNull()
    return (
        answers.join(decoded, "question_id", "left")
        .withColumn("answer", F.when(use, F.col("_generated")).otherwise(F.col("answer")))
        .withColumn("generation_mode", F.when(use, "llm").otherwise(F.col("generation_mode")))
        .drop("_generated")
    )
