import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.operators import neighbours, recommend, retrieve, vectors
from vacantia.session import ensure_checkpoint_dir

SCHEMA = "job_id long, embedding array<double>"


@pytest.fixture(autouse=True)
def folder(spark):
    ensure_checkpoint_dir(spark)


def clustered(rng, groups, each, width=12, noise=0.05):
    centres = rng.normal(size=(groups, width))
    rows = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), each, axis=0)
    rows = rows + rng.normal(scale=noise, size=rows.shape)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def table(frame, matrix):
    return frame([(i + 1, [float(x) for x in v]) for i, v in enumerate(matrix)], SCHEMA)


def rows_of(found):
    return sorted((r["job_id"], r["rank"], r["candidate_id"], round(r["raw_score"], 9)) for r in found.collect())


@pytest.mark.parametrize("block_rows", [neighbours.BLOCK_ROWS, 13])
def test_cells_give_the_exact_neighbours(frame, block_rows):
    rng = np.random.default_rng(1)
    matrix = np.concatenate([clustered(rng, 9, 20), rng.normal(size=(40, 12)), np.repeat(clustered(rng, 1, 1), 70, axis=0), np.zeros((2, 12))])
    v = table(frame, matrix).unionByName(frame([(9001, None), (None, [1.0] * 12)], SCHEMA))
    cells = neighbours.fit_cells(v, 12)
    for k in (1, 5, 400):
        assert rows_of(vectors.nearest_jobs(v, k, cells=cells, block_rows=block_rows)) == rows_of(vectors.nearest_jobs(v, k))
    two = frame([(3,), (200,)], "job_id long")
    assert rows_of(vectors.nearest_jobs(v, 4, two, cells=cells)) == rows_of(vectors.nearest_jobs(v, 4, two))


def test_cells_that_cannot_matter_are_skipped_and_vectors_hardly_copied(frame):
    rng = np.random.default_rng(2)
    matrix = clustered(rng, 20, 40)
    v = table(frame, matrix)
    cells = neighbours.fit_cells(v, 20)
    visits = []
    original = neighbours.block_shapes

    def counted(asked, size, block_rows):
        visits.append(asked.count())
        shapes = original(asked, size, block_rows)
        assert shapes.agg(F.max("query_blocks")).first()[0] in (None, 1)  # one block of queries a cell: no vector is copied
        return shapes

    neighbours.block_shapes = counted
    try:
        found = rows_of(vectors.nearest_jobs(v, 5, cells=cells))
    finally:
        neighbours.block_shapes = original
    assert found == rows_of(vectors.nearest_jobs(v, 5))
    assert sum(visits) < 0.3 * len(matrix) * len(cells.centres)


def test_a_cell_with_most_vectors_is_cut_into_blocks(frame):
    v = table(frame, np.concatenate([np.repeat(np.eye(4)[:1], 90, axis=0), np.eye(4)]))
    cells = neighbours.Cells(np.eye(4))
    index = neighbours.build_index(v, cells)
    size, radius = neighbours._cell_stats(index, 4)
    assert size.tolist() == [91, 1, 1, 1] and radius.tolist() == [0, 0, 0, 0]
    asked = index.select(F.col("job_id").alias("query_id"), "cell")
    assert sorted(tuple(r) for r in neighbours.block_shapes(asked, size, 10).collect()) == [(0, 10, 10), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_inverted_lists_reach_the_recall_that_was_asked_for(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("job_id"), "embedding")
    cells = neighbours.fit_cells(v)
    queries = v.withColumnRenamed("job_id", "query_id")
    index = neighbours.build_index(v.withColumnRenamed("job_id", "candidate_id"), cells).checkpoint()
    truth = vectors.nearest(queries, index, ["candidate_id"], 10, exclude_same_id=True)
    probes = neighbours.choose_probes(queries, index, cells, ["candidate_id"], 10, exclude_same_id=True, target=0.95)
    assert 1 < probes < len(cells.centres)
    found = neighbours.nearest_in_cells(queries, index, cells, ["candidate_id"], 10, exclude_same_id=True, probes=probes)
    got = neighbours.recall(found, truth, ["candidate_id"]).first()
    assert got["neighbours"] == 5000 and 0.9 <= got["recall"] < 1
    few = neighbours.nearest_in_cells(queries, index, cells, ["candidate_id"], 10, exclude_same_id=True, probes=1)
    assert neighbours.recall(few, truth, ["candidate_id"]).first()["recall"] < got["recall"]
    # The scores of what is found are exact.
    both = found.alias("a").join(truth.alias("b"), ["query_id", "candidate_id"])
    assert both.where("a.raw_score <> b.raw_score").count() == 0


def test_empty_and_small_tables(frame):
    empty = frame([], SCHEMA)
    cells = neighbours.fit_cells(empty)
    assert vectors.nearest_jobs(empty, 3, cells=cells).collect() == []
    one = table(frame, np.eye(3)[:1])
    assert vectors.nearest_jobs(one, 3, cells=neighbours.fit_cells(one)).collect() == []
    queries = one.withColumnRenamed("job_id", "query_id")
    index = neighbours.build_index(one.withColumnRenamed("job_id", "candidate_id"), neighbours.fit_cells(one))
    assert neighbours.choose_probes(queries.limit(0), index, neighbours.fit_cells(one), ["candidate_id"], 3) == 1
    assert neighbours.recall(empty.withColumnsRenamed({"job_id": "query_id"}).withColumn("c", F.lit(1)), empty.withColumnsRenamed({"job_id": "query_id"}).withColumn("c", F.lit(1)), ["c"]).first()["recall"] == 1


def test_recommendations_from_cells(frame):
    rng = np.random.default_rng(4)
    v = table(frame, clustered(rng, 4, 10))
    jobs = frame([(i + 1, "t", "c", "l", "k", "s", ["python"], f"u{i}") for i in range(40)],
                 "id long, title string, company string, location string, category string, seniority string, detected_skills array<string>, url string")
    exact = recommend.recommend(jobs, v, limit=3, pool=8)
    assert sorted(recommend.recommend(jobs, v, limit=3, pool=8, cells=neighbours.fit_cells(v, 4)).collect()) == sorted(exact.collect())


def test_repeated_ids_are_an_error(frame):
    with pytest.raises(ValueError):
        vectors.nearest_jobs(frame([(1, [1.0]), (1, [0.5])], SCHEMA), 2)


CHUNKS = "job_id long, title string, company string, location string, category string, seniority string, chunk_order int, chunk_text string"


@pytest.fixture
def passages(frame):
    words = "spark sql python kafka docker airflow pandas scala rust golang".split()
    rng = np.random.default_rng(5)
    rows = [(i // 3, "t", None, "Berlin", "data", "mid", i % 3, " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(90)]
    return frame(rows, CHUNKS)


@pytest.fixture
def asked(frame):
    rows = [(1, "spark and sql"), (2, "docker docker kafka"), (3, "nothing known"), (4, "python!"), (5, "Rust golang scala pandas airflow")]
    return frame([(i, q, None, None, None) for i, q in rows], "question_id long, question string, category string, location string, seniority string")


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "salts": 1}])
@pytest.mark.parametrize("k", [1, 7, 200])
def test_the_index_gives_the_rows_of_the_vectors(passages, asked, options, k):
    columns = ["question_id", "rank", "job_id", "chunk_order", "score", "keyword_score", "chunk_text", "title"]
    exact = retrieve.search_chunks(asked, vectors.embed_texts(passages, "chunk_text"), k).select(columns)
    found = retrieve.search_index(asked, retrieve.index_chunks(passages), passages, k, **options).select(columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, exact.collect()))


def test_retrieval_from_the_index(passages, asked):
    index = retrieve.index_chunks(passages)
    columns = ["question_id", "position", "job_id", "chunk_order", "final_score"]
    exact = retrieve.retrieve(asked, vectors.embed_texts(passages, "chunk_text"), 2).select(columns)
    assert sorted(retrieve.retrieve(asked, passages, 2, index=index).select(columns).collect()) == sorted(exact.collect())
    with pytest.raises(ValueError):
        retrieve.retrieve(asked, passages, 2, index=index, prefilter=True)
    assert retrieve.search_index(asked.limit(0), index, passages, 3).collect() == []
    assert retrieve.search_index(asked, index.limit(0), passages.limit(0), 3).collect() == []


def test_building_a_retrieval_runs_no_job_and_reads_the_texts_once(spark):
    from vacantia.plans import catalog

    def jobs():
        return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").schema
    corpus = vectors.embed_texts(catalog.job_chunks(spark, "/root/testdata/sf0.001"), "chunk_text")
    questions = catalog.adapters.questions(spark, "/root/testdata/sf0.001")
    before = jobs()
    found = retrieve.retrieve(questions, corpus, 5)
    assert jobs() == before
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1


def test_lists_added_up_in_tasks_equal_joined_ones(passages, asked, monkeypatch):
    monkeypatch.setattr(retrieve, "POSTING_ROWS", 40)
    odd = passages.limit(20).unionByName(passages.limit(9).withColumn("job_id", F.lit(None).cast("long")))
    rows = passages.unionByName(odd).repartition(3)  # repeated and null ids
    index = retrieve.index_chunks(rows).checkpoint()
    for k in (1, 7, 200):
        few = retrieve.search_index(asked, index, rows, k, broadcast_bytes=1 << 62)
        assert sorted(map(str, few.collect())) == sorted(map(str, retrieve.search_index(asked, index, rows, k, broadcast_bytes=0).collect()))
    assert "score(_index" in few._jdf.queryExecution().optimizedPlan().toString()
