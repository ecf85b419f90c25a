import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacantia.operators import chunks, ingest, process, search
from vacantia.functions import scores

SNAPSHOT = (
    "ordinal long, title string, company string, location string, category string, seniority string, "
    "description string, date_posted string, url string"
)
LONG = "A description that is long enough to pass."
T1, T2 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


def row(i, url, title="Dev", description=LONG, company="c"):
    return (i, title, company, "Berlin, DE", "Backend", "sr", description, "2024-01-01", url)


@pytest.fixture
def empty(frame):
    return frame([], ingest.JOBS_SCHEMA)


def by_url(rows):
    return {r["url"]: r for r in rows.collect()}


def test_hash_tells_null_empty_and_borders_apart(frame):
    schema = ", ".join(f"{c} string" for c in ingest.SOURCE_FIELDS)
    base = ["a"] * 8
    variants = [tuple(base)]
    for value in (None, "", "b"):
        variants.append((value, *base[1:]))
    variants += [("ab", "", *base[2:]), ("a", "b", *base[2:]), ("", "ab", *base[2:])]
    hashes = [r[0] for r in frame(variants + variants[:1], schema).select(ingest.source_hash()).collect()]
    assert len(set(hashes)) == len(variants) and hashes[0] == hashes[-1]


def test_reject_reasons(frame):
    rows = [row(1, None, None), row(2, "u", "  "), row(3, "u", description=" short "), row(4, "u")]
    got = ingest.validate(ingest.normalize(frame(rows, SNAPSHOT))).orderBy("ordinal").collect()
    assert [r["reject_reason"] for r in got] == ["missing_url", "missing_title", "short_description", None]


def test_upsert_cycle(frame, empty):
    first = frame([row(1, "a"), row(2, "b"), row(3, None)], SNAPSHOT)
    state = ingest.upsert_state(empty, first, T1).checkpoint()
    assert state.count() == 2 and state.select("id").distinct().count() == 2
    done = process.process_postings(state, T1).checkpoint()
    second = frame([row(1, "a"), row(2, "b", "Other"), row(3, "c"), row(4, "c", "Last")], SNAPSHOT)
    actions = {r["url"]: r["action"] for r in ingest.upsert_actions(done, second).collect()}
    assert actions == {"a": "unchanged", "b": "updated", "c": "inserted"}
    after = ingest.upsert_state(done, second, T2).checkpoint()
    new, old = by_url(after), by_url(done)
    assert new["a"] == old["a"]
    assert new["b"]["id"] == old["b"]["id"] and new["b"]["title"] == "Other"
    assert new["b"]["processing_status"] == "pending" and new["b"]["cleaned_description"] is None
    assert new["c"]["title"] == "Last" and new["c"]["id"] > max(r["id"] for r in old.values())
    summary = ingest.ingest_summary(done, second).first()
    assert (summary["inserted_rows"], summary["updated_rows"], summary["unchanged_rows"], summary["duplicate_rows"]) == (1, 1, 1, 1)
    again = ingest.upsert_state(after, second, "2024-01-03 00:00:00")
    assert sorted(again.collect()) == sorted(after.collect())


def test_texts_are_read_and_hashed_once(frame, empty):
    """After the staged table is written, numbering and matching use addresses, hashes and row numbers alone."""
    staged = ingest.stage(frame([row(1, "a"), row(1, "a", "Tie"), row(2, "b"), row(3, None)], SNAPSHOT))
    actions = ingest.key_actions(empty, staged)
    assert actions.columns == ["url", "_row", "id", "action"]
    assert sorted(r["url"] for r in actions.collect()) == ["a", "b"]
    state = ingest.upsert_state(empty, frame([row(1, "a"), row(1, "a", "Tie"), row(2, "b")], SNAPSHOT).coalesce(1), T1)
    assert by_url(state)["a"]["title"] == "Tie"
    plan = state._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan
    assert not any("description" in line for line in plan.splitlines() if "Window" in line)


def test_missing_rows_stay_and_null_hash_counts_as_changed(frame, empty):
    state = ingest.upsert_state(empty, frame([row(1, "a"), row(2, "b")], SNAPSHOT), T1)
    state = state.withColumn("source_hash", F.lit(None).cast("string")).checkpoint()
    got = by_url(ingest.upsert_state(state, frame([row(1, "a")], SNAPSHOT), T2))
    assert set(got) == {"a", "b"}
    assert got["a"]["ingested_at"] == dt.datetime(2024, 1, 2) and got["b"]["ingested_at"] == dt.datetime(2024, 1, 1)


def test_full_rebuild_resets_every_row(frame, empty):
    state = ingest.upsert_state(empty, frame([row(1, "a"), row(2, "b")], SNAPSHOT), T1)
    done = process.process_postings(state, T1).checkpoint()
    got = ingest.upsert_state(done, frame([row(1, "a")], SNAPSHOT), T2, full_rebuild=True).collect()
    assert {r["processing_status"] for r in got} == {"pending"} and {r["detected_skills"] for r in got} == {None}


def test_hot_address_with_random_order(frame, empty):
    rows = [row(i, "hot" if i % 3 == 0 else f"u{i}", f"t{i}") for i in range(600)]
    got = by_url(ingest.upsert_state(empty, frame(rows[::-1], SNAPSHOT), T1))
    assert len(got) == 401 and got["hot"]["title"] == "t597"


def test_numbers_are_unique_and_repeatable(frame):
    rows = frame([(f"k{i}",) for i in range(5000)], "k string")
    a = {r["k"]: r["position"] for r in ingest.numbered(rows, "k", digits=1).collect()}
    b = {r["k"]: r["position"] for r in ingest.numbered(rows.repartition(7), "k", digits=1).collect()}
    assert a == b and len(set(a.values())) == 5000 and min(a.values()) >= 1


def test_process_touches_pending_rows_only(frame, empty):
    state = ingest.upsert_state(empty, frame([row(1, "a", description="Python and Docker with café " + LONG)], SNAPSHOT), T1)
    done = process.process_postings(state, T1)
    one = done.first()
    assert one["detected_skills"] == ["docker", "python"] and "café" in one["cleaned_description"]
    assert process.process_postings(done, T2).first() == one
    assert process.process_summary(done).first()["avg_skills_per_job"] == 2.0
    assert process.process_summary(done.limit(0)).first()["avg_skills_per_job"] == 0.0


def test_stage_selection_and_stamps(frame, empty):
    state = process.process_postings(ingest.upsert_state(empty, frame([row(1, "a"), row(2, "b")], SNAPSHOT), T1), T1)
    one = state.filter("url = 'a'").select(F.col("id").alias("job_id"))
    stamped = ingest.stamp_touched(state, one.unionAll(one), "chunked_at", T2).checkpoint()
    assert stamped.count() == 2
    counts = {r["stage"]: (r["dirty"], r["needs_run"]) for r in ingest.dirty_counts(stamped).collect()}
    assert counts == {"process": (0, False), "embed": (2, True), "chunk": (1, True)}
    assert ingest.should_rebuild(0, False) and ingest.should_rebuild(1, True) and not ingest.should_rebuild(0, True)


def test_chunk_rows(frame):
    schema = "id long, title string, company string, location string, category string, seniority string, cleaned_description string, description string"
    rows = [(1, "t", "c", "l", "k", "s", "cleaned " * 10, "raw"), (2, "t", "c", "l", "k", "s", None, "raw text " * 10),
            (3, "t", "c", "l", "k", "s", "", None), (4, "t", "c", "l", "k", "s", "", "tiny")]
    got = chunks.chunk_documents(frame(rows, schema)).orderBy("job_id").collect()
    assert [(r["job_id"], r["chunk_order"], r["chunk_text"][:3]) for r in got] == [(1, 0, "cle"), (2, 0, "raw")]
    assert chunks.chunk_summary(chunks.chunk_documents(frame([], schema))).first()["chunk_count"] == 0


def test_dense_chunk_ids(frame):
    rows = [(j, o) for j in (1, 5, 70000, 200000, -3) for o in range(4)]
    got = chunks.with_chunk_ids(frame(rows, "job_id long, chunk_order int"), 1000).collect()
    assert [r["chunk_id"] for r in sorted(got, key=lambda r: (r["job_id"], r["chunk_order"]))] == list(range(20))


JOBS = "id long, title string, company string, location string, category string, seniority string, description string, cleaned_description string, detected_skills array<string>, date_posted date, url string"


@pytest.fixture
def board(frame):
    day = dt.date
    return frame(
        [
            (1, "Backend Dev", "A", "Berlin", "backend", "Mid", "uses Python", "uses python", ["python", "sql"], day(2024, 1, 3), "u1"),
            (2, "API Dev", "B", "Berlin", "backend", "Mid", "uses Java", "uses java", ["javascript"], None, "u2"),
            (3, "Data Dev", None, "Munich", "data", "Senior", "100% SQL", "100 sql", ["java", "sql"], day(2024, 1, 1), "u3"),
        ],
        JOBS,
    )


def ids(rows):
    return [r["id"] for r in rows.collect()]


def test_search(board):
    find = search.search_postings
    assert ids(find(board)) == [2, 1, 3]
    assert ids(find(board, sort_order="asc")) == [3, 1, 2]
    assert ids(find(board, sort_by="nonsense")) == [2, 1, 3]
    assert ids(find(board, sort_by="company", sort_order="asc")) == [1, 2, 3]
    assert ids(find(board, keyword="PYTHON")) == [1]
    assert ids(find(board, keyword="1%q")) == [3]
    assert ids(find(board, keyword="x")) == [2, 1, 3]
    assert ids(find(board, location=" berl ", category="BACK")) == [2, 1]
    assert ids(find(board, skills="java")) == [2, 3]
    assert ids(find(board, skills="java, sql", exact_skills=True)) == [3]
    assert ids(find(board, page=2, size=2)) == [3]
    assert search.search_total(board, skills="sql").first()["total"] == 2
    assert ids(search.get_posting(board, 2)) == [2] and ids(search.get_posting(board, 9)) == []
    with pytest.raises(ValueError):
        find(board, size=101)


def test_top_skills(board, frame):
    assert [(r["skill"], r["count"]) for r in search.top_skills(board).collect()] == [
        ("sql", 2), ("java", 1), ("javascript", 1), ("python", 1)]
    assert [r["skill"] for r in search.top_skills(board, category="DATA", seniority=" senior", limit=-3).collect()] == ["java"]
    joined = frame([(" a, b,,a ",), (None,)], "s string").select(search.parse_skills(F.col("s"))).collect()
    assert [r[0] for r in joined] == [["a", "b"], []]


def test_rounding_and_jaccard(frame):
    values = [0.0625, 0.03125, 0.66665, 2 / 3, -0.12345, 1e-9]
    got = [r[0] for r in frame([(v,) for v in values], "v double").select(scores.rounded(F.col("v"))).collect()]
    assert got == [0.0625, 0.0312, 0.6666, 0.6667, -0.1234, 0.0]
    sets = frame([(["p", "s", "d"], ["p", "s"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in sets.select(scores.jaccard(F.col("a"), F.col("b"))).collect()] == [2 / 3, 0.0]
