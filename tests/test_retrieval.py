import json

import pytest
from pyspark.sql import functions as F

from vacantia.functions import rules
from vacantia.operators import answers, evaluate, retrieve, vectors

CHUNKS = "job_id long, title string, company string, location string, category string, seniority string, chunk_order int, chunk_text string"
QUESTIONS = "question_id long, question string, category string, location string, seniority string"


@pytest.fixture
def chunks(frame):
    rows = [
        (1, "Backend", "A", "Berlin", "backend", "Mid", 0, "python fastapi services for the backend. second sentence here."),
        (1, "Backend", "A", "Berlin", "backend", "Mid", 1, "python fastapi and more python for backend work"),
        (2, "Data", "B", None, "data", "Senior", 0, "sql reporting and analytics dashboards in berlin"),
        (3, "Ops", "C", "Munich", "", None, 0, "kubernetes clusters terraform pipelines monitoring"),
    ]
    return vectors.embed_texts(frame(rows, CHUNKS), "chunk_text")


def asked(frame, *rows):
    return frame([(i, q, c, l, s) for i, (q, c, l, s) in enumerate(rows)], QUESTIONS)


def test_search_scores(frame, chunks):
    q = asked(frame, ("python fastapi backend", None, None, None))
    hits = {(r["job_id"], r["chunk_order"]): r for r in retrieve.search_chunks(q, chunks, 4).collect()}
    assert len(hits) == 4 and hits[(1, 0)]["keyword_score"] == 1.0 and hits[(2, 0)]["keyword_score"] == 0.0
    same = retrieve.search_chunks(q, chunks, 4, block_rows=2).collect()
    assert sorted(same) == sorted(hits.values())


def test_rerank_and_limit_per_job(frame):
    rows = frame([(1, 1, 0, 1, 0.7, 0.1), (1, 2, 0, 2, 0.6, 0.8), (1, 2, 1, 3, 0.6, 0.8)],
                 "question_id long, job_id long, chunk_order long, rank int, score double, keyword_score double")
    ranked = retrieve.rerank(rows).orderBy("final_rank").collect()
    assert [(r["job_id"], r["chunk_order"], r["final_score"]) for r in ranked] == [(2, 0, 0.64), (2, 1, 0.64), (1, 0, 0.58)]
    assert retrieve.limit_per_job(retrieve.rerank(rows), 1).count() == 2
    assert retrieve.limit_per_job(retrieve.rerank(rows)).count() == 3


def test_retrieve_filters_after_the_cut(frame, chunks):
    q = asked(
        frame,
        ("python backend", None, None, None),
        ("python backend", " Backend ", "BERLIN", "mid"),
        ("python backend", "data", "berlin", None),
        ("kubernetes", None, "munich", None),
    )
    rows = retrieve.retrieve(q, chunks, 2).orderBy("question_id", "position").collect()
    got = {}
    for r in rows:
        got.setdefault(r["question_id"], []).append(r["job_id"])
    assert got[0][0] == 1 and len(got[0]) == 2 and got[1] == [1] and 2 not in got and got[3] == [3]
    with pytest.raises(ValueError):
        retrieve.retrieve(q, chunks, 11)


def test_blank_question_fails(frame, chunks):
    with pytest.raises(Exception, match="question cannot be empty"):
        retrieve.retrieve(asked(frame, ("  ", None, None, None)), chunks).collect()


def test_answers(frame, chunks):
    q = asked(
        frame,
        ("Which backend postings use python?", None, None, None),
        ("What skills are asked?", "data", None, None),
        ("pay in sql", "data", None, None),
        ("nothing", "none", None, None),
    )
    hits = retrieve.retrieve(q, chunks, 1)
    got = {r["question_id"]: r for r in answers.extractive_answers(q, hits).collect()}
    assert got[0]["answer"].startswith(rules.HEADER_JOBS + "\n- Backend (Berlin): python fastapi")
    assert "second sentence" not in got[0]["answer"]
    assert got[1]["answer"] == (
        rules.TERMS_PREFIX + "sql, reporting, analytics, dashboards, berlin.\n" + rules.HEADER_EXAMPLES
        + "\n- Data (None): sql reporting and analytics dashboards in berlin"
    )
    assert got[2]["answer"].startswith(rules.HEADER_GENERAL) and got[2]["source_count"] == 1
    assert got[3]["answer"] == rules.NO_ANSWER and got[3]["source_count"] == 0
    prompt = answers.prompt_table(q, hits).filter("question_id = 1").first()["prompt"]
    assert "Question:\nWhat skills are asked?\n\nContext:\n[Source 1] sql reporting" in prompt


def test_responses(frame):
    bodies = [
        {"text": " a "}, {"output": "b"}, {"choices": [{"text": "c\n"}]}, {"choices": [{"message": {"content": "d"}}]},
        {"text": 5, "output": "e"}, {"choices": []}, {"x": 1},
    ]
    rows = frame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(9, "not json")], "question_id long, body string")
    got = {r["question_id"]: r["answer"] for r in answers.decode_responses(rows).collect()}
    assert [got[i] for i in range(7)] == ["a", "b", "c", "d", "e", None, None] and got[9] is None
    base = frame([(0, "old", "extractive", 1), (5, "old", "extractive", 1), (1, "none", "extractive", 0)],
                 "question_id long, answer string, generation_mode string, source_count long")
    merged = {r["question_id"]: (r["answer"], r["generation_mode"]) for r in answers.prefer_generated(base, rows).collect()}
    assert merged == {0: ("a", "llm"), 5: ("old", "extractive"), 1: ("none", "extractive")}


def test_top_terms_ties_by_first_place(frame):
    rows = frame([("g", 2, "zeta alpha"), ("g", 1, "beta alpha the zeta of"), ("h", 1, "only-one c++")], "g string, o long, t string")
    got = answers.top_terms(rows, "g", ["o"], "t", 3).orderBy("g", "rank").collect()
    assert [(r["g"], r["term"], r["n"]) for r in got] == [
        ("g", "alpha", 2), ("g", "zeta", 2), ("g", "beta", 1), ("h", "only-one", 1)]


def test_answer_evaluation(frame, tmp_path):
    cases = frame([(1, ["Python", "FastAPI", "Rust"]), (2, [])], "question_id long, expected_keywords array<string>")
    texts = frame([(1, "q", "python and fastapi", 3, 2), (2, "q", "", 3, 1)],
                  "question_id long, question string, answer string, source_count long, job_count long")
    got = evaluate.answer_cases(cases, texts)
    rates = {r["question_id"]: (r["matched_keywords"], r["keyword_hit_rate"]) for r in got.collect()}
    assert rates == {1: (["Python", "FastAPI"], 0.667), 2: ([], 0.0)}
    summary = evaluate.answer_summary(got)
    s = summary.first()
    assert (s["total_cases"], s["passed_cases"], s["avg_retrieved_chunk_count"], s["avg_retrieved_job_count"]) == (2, 1, 3.0, 1.5)
    assert evaluate.answer_summary(got.limit(0)).first()["avg_keyword_hit_rate"] == 0.0
    evaluate.save_evaluation(str(tmp_path / "out"), summary, got)
    assert frame([], "a int").sparkSession.read.json(str(tmp_path / "out" / "cases")).count() == 2


def test_recommendation_evaluation(frame):
    jobs = frame(
        [(1, "A", "c", "l", "k", "s", ["python"], "u1"), (2, "B", "c", "l", "k", "s", ["python"], "u2"),
         (3, "C", "c", "l", "k", "s", [], "u3"), (4, "D", "c", "l", "k", "s", ["go"], "u4")],
        "id long, title string, company string, location string, category string, seniority string, detected_skills array<string>, url string")
    v = frame([(i, [1.0, float(i)]) for i in (1, 2, 3)], "job_id long, embedding array<float>")
    cases = evaluate.recommendation_cases(jobs, v)
    assert {r["job_id"]: (r["recommendation_count"], r["shared_skill_recommendations"]) for r in cases.collect()} == {1: (2, 1), 2: (2, 1)}
    summary = evaluate.recommendation_summary(cases).first()
    assert (summary["evaluated_jobs"], summary["jobs_with_shared_skills"], summary["avg_recommendations_per_job"]) == (2, 2, 2.0)
    assert evaluate.recommendation_cases(jobs, v, sample_size=1).count() == 1
    assert evaluate.recommendation_summary(cases.filter(F.lit(False))).first()["avg_recommendations_per_job"] == 0.0


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_by_key_equal_pages_by_offset(frame, order):
    from vacantia.operators import search

    rows = [(i, None if i % 4 == 0 else f"t{i % 3}") for i in range(40)]
    jobs = frame(rows, "id long, title string")
    seen, after = [], None
    while True:
        page = search.search_postings(jobs, size=7, sort_by="title", sort_order=order, after=after).collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        after = (page[-1]["title"], page[-1]["id"])
    by_offset = [r["id"] for n in range(1, 7) for r in search.search_postings(jobs, size=7, sort_by="title", sort_order=order, page=n).collect()]
    assert seen == by_offset and sorted(seen) == list(range(40))


def test_filters_before_the_cut_and_blank_questions(spark, frame):
    rows = [(i, 0, f"t{i}", "c", "Berlin" if i == 9 else "Bonn", "Data", "senior", f"python spark number {i}") for i in range(1, 10)]
    chunks = frame(rows, "job_id long, chunk_order int, title string, company string, location string, category string, seniority string, chunk_text string")
    chunks = vectors.embed_texts(chunks, "chunk_text")
    asked = frame([(1, "python spark number 1", "data", "berlin", None), (2, "  ", None, None, None)],
                  "question_id long, question string, category string, location string, seniority string")
    late = retrieve.retrieve(asked, chunks, 1, strict=False).collect()
    early = retrieve.retrieve(asked, chunks, 1, strict=False, prefilter=True).collect()
    assert [r["job_id"] for r in early] == [9] and [r["job_id"] for r in late] in ([], [9])
    assert [tuple(r) for r in retrieve.blank_questions(asked).collect()] == [(2, "blank_question")]


def test_few_questions_meet_the_corpus_where_it_is(spark, frame, tmp_path):
    texts = [f"python{i % 7} word{i} sql{i % 3} backend number {i}." for i in range(300)]
    rows = [(i, "t", "c", "Berlin", "backend" if i % 2 else "data", None, 0, t) for i, t in enumerate(texts)] + [(None, "t", "c", "x", "y", None, 0, "no id")]
    frame(rows, CHUNKS).repartition(3).write.parquet(str(tmp_path / "chunks"))
    frame([(i, f"python{i} sql{i % 3} {i}", "data" if i % 2 else None, None, None) for i in range(9)], QUESTIONS).write.parquet(str(tmp_path / "questions"))
    passages, q = (spark.read.parquet(str(tmp_path / name)) for name in ("chunks", "questions"))
    corpus = vectors.embed_texts(passages, "chunk_text")
    for prefilter in (False, True):
        few = retrieve.search_chunks(q, corpus, 5, prefilter=prefilter)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" not in plan and plan.count("dense(") == 2  # questions and passages, each embedded once
        assert sorted(few.collect()) == sorted(retrieve.search_chunks(q, corpus, 5, prefilter=prefilter, block_rows=40).collect())
    assert few.count() == 45


def test_passages_cut_their_sentences_once(frame):
    from vacantia.operators import chunks as cutting

    jobs = frame([(1, "a", "b", "c", "d", "e", "one sentence here. and more.", None)],
                 "id long, title string, company string, location string, category string, seniority string, description string, cleaned_description string")
    plan = cutting.chunk_documents(jobs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=[.!?]) ") == 1
