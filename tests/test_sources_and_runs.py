import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.operators import ingest, prepare, runs
from vacantia.plans.pipeline import Pipeline
from vacantia.sources import tables
from vacantia.streaming.ingest import ingest_stream

CSV = '''title,job_id,company_name,description,original_listed_time,job_posting_url,extra,skills_desc
"Data Engineer, senior",1,Acme,"line one
line ""two"" %s",1713397508000.0,http://a,x,
Data Engineer,1,Dup,%s,,http://dup,x,
bad line with too few fields
Nurse,2,Acme,%s,,http://b,x,
Therapist,3,Beta,%s,2024-05-01,,x,sql
SRE,4,Beta,short,2024-05-01,http://d,x,
SRE,5,Beta,%s,2024-05-01,http://a,x,
SRE,6,Alpha,%s,2024-05-01,http://e,x,
'''


@pytest.fixture
def raw_folder(tmp_path):
    long = "long text " * 15
    (tmp_path / "postings.csv").write_text(CSV % ((long,) * 6), encoding="utf-8")
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs" / "job_skills.csv").write_text("job_id,skill_abr\n1,SQL\n1,ETL\n1,SQL\n1,  \n9,X\n")
    return str(tmp_path)


def test_prepare_from_files(spark, raw_folder, tmp_path):
    raw, skills = tables.load_postings(spark, raw_folder), tables.load_job_skills(spark, raw_folder)
    assert raw.filter("job_id IS NOT NULL").count() == 7 and raw.filter("application_url IS NOT NULL").count() == 0
    rows = prepare.prepare_postings(raw, skills).collect()
    assert [(r["title"], r["company"], str(r["date_posted"])) for r in rows] == [
        ("SRE", "Alpha", "2024-05-01"), ("Data Engineer, senior", "Acme", "2024-04-17")]
    assert rows[1]["description"].startswith('line one line "two" long') and rows[1]["description"].endswith("ETL, SQL")
    assert rows[1]["seniority"] == "Senior" and rows[1]["category"] == "data engineering"
    assert prepare.prepare_postings(raw, skills, max_rows=1).count() == 1
    for name in ("prepared", "prepared.parquet"):
        path = str(tmp_path / name)
        tables.write_prepared(prepare.require_rows(prepare.prepare_postings(raw, skills)), path)
        back = tables.load_prepared(spark, path).drop("ordinal").orderBy("company").collect()
        assert [r["description"] for r in back] == [rows[1]["description"], rows[0]["description"]]
    with pytest.raises(RuntimeError):
        prepare.require_rows(prepare.prepare_postings(raw.filter("job_id = '2'"), skills))


def test_short_lines_stay_and_long_lines_go(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n1,A,1\n2,B\n3,C,1,9\n4,D,1\n5,E,1,\n6,"two\nlines",\n7\n')
    got = [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "x.csv"), ["a", "c", "b", "none"]).collect()]
    assert got == [("1", "1", "A", None), ("2", None, "B", None), ("4", "1", "D", None), ("5", "1", "E", None), ("6", None, "two\nlines", None), ("7", None, None, None)]
    (tmp_path / "y.csv").write_text("a,b\n1,A\n2\n3,C,9\n")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "y.csv"), ["a", "b"], one_line=True).collect()] == [("1", "A"), ("2", None)]


def test_latency_of_requests_without_endpoint(frame):
    rows = frame([(None, 2.0, False), (None, 4.0, True), ("a", 1.0, False)], "endpoint string, latency_ms double, is_error boolean")
    got = {r["endpoint"]: tuple(r)[1:] for r in runs.latency_summary(rows).collect()}
    assert got[None] == (2, 1, 3.0, 3.0, 3.9, 3.98) and got["a"] == (1, 0, 1.0, 1.0, 1.0, 1.0)


def test_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_postings(spark, str(tmp_path))
    assert tables.load_job_skills(spark, str(tmp_path)).count() == 0


def test_buckets_keep_classified_first(frame):
    rows = frame([("u", 2, "other", True), ("u", 3, "data engineering", True), ("v", 1, "other", False), ("w", 4, "other", True)],
                 "url string, ordinal long, category string, is_tech boolean")
    got = {r["url"]: (r["ordinal"], r["priority"]) for r in prepare.union_buckets(rows).collect()}
    assert got == {"u": (3, 0), "w": (4, 1)}


@pytest.mark.parametrize("accuracy", [10000, 20, 2])
def test_exact_percentiles(frame, accuracy):
    rng = np.random.default_rng(3)
    groups = {"skewed": rng.lognormal(sigma=3, size=4000), "same": np.full(3000, 7.5), "few": np.array([1.0, 2.0]), "one": np.array([3.0])}
    groups["mixed"] = np.concatenate([np.zeros(900), rng.normal(size=100)])
    rows = frame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None)], "g string, v double")
    wanted = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 0.99, "e": 1.0}
    for r in runs.exact_percentiles(rows, "g", "v", wanted, accuracy).collect():
        expected = np.quantile(groups[r["g"]], list(wanted.values()))
        assert np.allclose([r[n] for n in wanted], expected, rtol=1e-12), r["g"]


def test_run_log(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path / "runs"))
    first = log.start("ingest_jobs", "file", 10)
    assert log.read().first()["status"] == "started"
    log.finish(first, "success", {"n": 1}, output_rows=5)
    log.finish(log.start("process_jobs"), "failed", error_message="boom")
    got = {r["pipeline_name"]: r for r in log.read().collect()}
    assert got["ingest_jobs"]["output_rows"] == 5 and '"duration_seconds"' in got["ingest_jobs"]["metrics"]
    assert got["process_jobs"]["error_message"] == "boom"
    assert runs.latest_runs(log.read(), 1, "run_id").first()["pipeline_name"] == "process_jobs"


def test_run_log_without_runs(spark, tmp_path):
    assert runs.RunLog(spark, str(tmp_path / "none")).read().collect() == []


def test_freshness(frame):
    rows = [("a", "success", dt.datetime(2024, 1, 1, 0)), ("a", "failed", dt.datetime(2024, 1, 2, 12)), ("b", "failed", None),
            ("c", "success", dt.datetime(2024, 1, 1, 23, 30))]
    got = {r["pipeline_name"]: tuple(r)[1:] for r in runs.freshness(
        frame(rows, "pipeline_name string, status string, finished_at timestamp_ntz"), "2024-01-02 01:00:00").collect()}
    assert got == {"a": (True, True, 25.0), "b": (False, None, None), "c": (True, False, 1.5)}
    meta = frame([("x", "2024-01-01T00:00:00"), ("y", "soon"), ("z", None), ("o", "2024-01-01T00:00:00+05:00"), ("h", "2024-01-01T00:00:00+05"), ("u", "2024-01-01T06:00:00Z")], "artifact string, generated_at string")
    got = {r["artifact"]: tuple(r)[1:] for r in runs.metadata_freshness(meta, "2024-01-01 12:00:00").collect()}
    assert got == {"x": (True, False, 12.0), "y": (True, None, None), "z": (False, None, None),
                   "o": (True, False, 17.0), "h": (True, False, 17.0), "u": (True, False, 6.0)}


SNAPSHOT = ("ordinal long, title string, company string, location string, category string, seniority string, "
            "description string, date_posted string, url string")


def snapshot(frame, rows):
    return frame([(i, t, "c", "Berlin", "Backend", "sr", d, "2024-01-01", u) for i, (u, t, d) in enumerate(rows)], SNAPSHOT)


TEXT = "We build services with Python and Docker for many people. "


def chunk_rows(pipeline):
    return sorted((r["job_id"], r["chunk_order"], r["chunk_text"], tuple(r["embedding"])) for r in pipeline.chunks.read().collect())


def test_pipeline_is_incremental(spark, frame, tmp_path):
    one = snapshot(frame, [("a", "A", TEXT), ("b", "B", TEXT * 12), (None, "C", TEXT)])
    p = Pipeline(spark, str(tmp_path / "p"))
    s = p.run(one)
    assert s["ingest"]["inserted_rows"] == 2 and s["process"]["processed_jobs"] == 2 and s["embeddings"]["embedded_jobs"] == 2
    assert s["chunk_index"]["job_count"] == 2 and p.vectors.read().count() == 2
    again = p.run(one)
    assert again["ingest"]["changed_rows"] == 0 and again["process"]["processed_jobs"] == 0 and again["chunk_index"]["skipped_rebuild"]
    two = snapshot(frame, [("a", "A", TEXT), ("b", "B", "Changed. " + TEXT * 3), ("d", "D", TEXT * 2)])
    third = p.run(two)
    assert third["process"]["processed_jobs"] == 2 and third["chunk_index"]["dirty_jobs"] == 2
    before = chunk_rows(p)
    assert p.run(two, full_rebuild=True)["ingest"]["reset_jobs"] == 3
    assert chunk_rows(p) == before and p.vectors.read().count() == 3
    assert {r["artifact"] for r in p.metadata.read().collect()} == {"job_embeddings", "chunk_index"}
    assert p.runs.read().filter("status = 'success'").count() == 16
    with pytest.raises(Exception):
        p.ingest(one.drop("title"))
    assert p.runs.read().filter("status = 'failed'").count() == 1


def test_stream_ingest_equals_batch_and_may_repeat(spark, frame, tmp_path):
    first, second = [("a", "A", TEXT), ("b", "B", TEXT)], [("b", "B2", TEXT), ("c", "C", TEXT)]
    source = str(tmp_path / "in")
    p = Pipeline(spark, str(tmp_path / "p"))

    def drain(checkpoint):
        stream = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(source)
        ingest_stream(stream, p, str(tmp_path / checkpoint)).awaitTermination()

    def state():
        return sorted((r["url"], r["title"], r["processing_status"], r["id"]) for r in p.jobs.read().collect())

    snapshot(frame, first).coalesce(1).write.mode("append").parquet(source)
    drain("c1")
    snapshot(frame, second).coalesce(1).write.mode("append").parquet(source)
    drain("c1")
    now = state()
    assert [(u, t, s) for u, t, s, _ in now] == [("a", "A", "processed"), ("b", "B2", "processed"), ("c", "C", "processed")]
    assert p.chunks.read().select("job_id").distinct().count() == 3
    drain("c1")
    assert state() == now
    batch = ingest.upsert_state(frame([], ingest.JOBS_SCHEMA), snapshot(frame, first), "2024-01-01")
    both = ingest.upsert_state(batch, snapshot(frame, second), "2024-01-02").collect()
    assert sorted((r["url"], r["title"]) for r in both) == [(u, t) for u, t, _, _ in now]


def test_versions_are_complete_or_not_seen(spark, frame, tmp_path):
    t = tables.VersionedTable(spark, str(tmp_path / "t"), "a int")
    assert t.current() is None and t.read().count() == 0
    assert t.write(frame([(1,)], "a int")) == 1 and t.write(frame([(2,)], "a int")) == 2
    (tmp_path / "t" / "v=3").mkdir()
    assert t.current() == 2 and t.read().first()["a"] == 2 and t.read(1).first()["a"] == 1
    assert t.write(frame([(5,)], "a int"), 2) == 2 and t.read().agg(F.sum("a")).first()[0] == 5


def test_buckets_that_are_not_replaced_keep_their_files(spark, frame, tmp_path):
    t = tables.BucketedTable(spark, str(tmp_path / "t"), "k int, v string", "k", 8)
    rows = frame([(i, "old") for i in range(200)], "k int, v string")
    assert t.current() is None and t.read().count() == 0 and set(t.places().values()) == {None}
    t.replace(rows, range(8))
    before = {b: sorted(p.name for p in (tmp_path / "t" / "v=1" / f"_bucket={b}").iterdir()) for b in range(8)}
    one = t.buckets_of(rows.filter("k = 7"), F.col("k"))
    t = tables.BucketedTable(spark, str(tmp_path / "t"), "k int, v string", "k", 5)      # the stored number of buckets counts
    new = t.read(buckets=one).withColumn("v", F.when(F.col("k") == 7, "new").otherwise(F.col("v")))
    assert t.replace(new, one) == 2
    assert sorted(r["k"] for r in t.read().filter("v = 'new'").collect()) == [7] and t.read().count() == 200
    files = t.read().inputFiles()
    for b in set(range(8)) - set(one):
        assert all(any(f.endswith(f"v=1/_bucket={b}/{n}") for f in files) for n in before[b] if n.endswith(".parquet") and n[0] != ".")
    assert t.read(1).filter("v = 'new'").count() == 0
    with pytest.raises(ValueError):
        t.replace(rows, one)
    assert t.current() == 2 and t.read().count() == 200
    assert t.replace(t.read(1, one).limit(0), one, version=2) == 2 and t.places()[one[0]] is None
    assert t.read().count() == 200 - t.read(1, one).count()


def test_old_versions_expire(spark, frame, tmp_path):
    t = tables.BucketedTable(spark, str(tmp_path / "t"), "k int", "k", 4)
    rows = frame([(i,) for i in range(50)], "k int")
    t.replace(rows, range(4))
    for b in (0, 0, 1):
        t.replace(t.read(buckets=[b]), [b])
    assert t.versions() == [1, 2, 3, 4] and t.expire(2) == 2 and t.versions() == [3, 4]
    assert t.read().count() == 50 and t.read(3).count() == 50
    assert not (tmp_path / "t" / "v=2" / "_bucket=0").exists() and (tmp_path / "t" / "v=1" / "_bucket=2").exists()
    with pytest.raises(ValueError):
        t.expire(0)


def test_a_small_snapshot_rewrites_its_buckets_only(spark, frame, tmp_path):
    p = Pipeline(spark, str(tmp_path / "p"), buckets=16, keep_versions=3)
    p.run(snapshot(frame, [(f"u{i}", f"T{i}", TEXT) for i in range(60)]))
    jobs, vectors = p.jobs.places(), p.vectors.places()
    s = p.run(snapshot(frame, [("u5", "Changed", TEXT), ("u6", "T6", TEXT)]))
    assert (s["ingest"]["updated_rows"], s["ingest"]["unchanged_rows"], s["process"]["processed_jobs"]) == (1, 1, 1)
    assert sum(p.jobs.places()[b] != v for b, v in jobs.items()) == 1
    assert sum(p.vectors.places()[b] != v for b, v in vectors.items()) == 1
    assert p.jobs.read().count() == 60 and p.served_vectors().count() == 60 and len(p.jobs.versions()) == 3
    assert p.jobs.read().filter("title = 'Changed'").select("processing_status").first()[0] == "processed"


def test_a_repeated_version_and_an_empty_snapshot(spark, frame, tmp_path):
    p = Pipeline(spark, str(tmp_path / "p"))
    assert p.ingest(snapshot(frame, []))["input_rows"] == 0 and p.jobs.read().count() == 0
    rows = [("a", "A", TEXT), ("a", "A2", TEXT), ("b", "B", "short"), (None, "N", TEXT)]
    for _ in range(2):
        s = p.ingest(snapshot(frame, rows), version=5)
        assert (s["inserted_rows"], s["duplicate_rows"], s["missing_url"], s["short_description"]) == (1, 1, 1, 1)
    assert p.jobs.current() == 5 and p.jobs.read().first()["title"] == "A2"


def test_bad_vectors_are_not_stored(spark, frame, tmp_path):
    def uneven():
        return lambda texts: np.ones((len(texts), 3 if any("changed" in t.lower() for t in texts) else 2))

    p = Pipeline(spark, str(tmp_path / "p"), load_encoder=uneven, buckets=1)
    p.run(snapshot(frame, [("a", "A", TEXT), ("b", "B", TEXT)]))
    with pytest.raises(ValueError):
        p.run(snapshot(frame, [("b", "B", "Changed. " + TEXT)]))
    assert p.served_vectors().count() == 2
    with pytest.raises(ValueError):
        Pipeline(spark, str(tmp_path / "none")).served_vectors()
