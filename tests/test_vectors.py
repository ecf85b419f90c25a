import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacantia.functions import text
from vacantia.operators import evaluate, recommend, vectors

SCHEMA = "job_id long, embedding array<float>"


def table(frame, matrix, start=1):
    return frame([(i + start, [float(x) for x in v]) for i, v in enumerate(matrix)], SCHEMA)


def found(rows):
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r["job_id"], r["rank"])):
        got.setdefault(r["job_id"], []).append(r["candidate_id"])
    return got


def brute(matrix, k, start=1):
    m = np.asarray(matrix, dtype=np.float32).astype(np.float64)
    scores = np.round(m @ m.T, 9)
    result = {}
    for i in range(len(m)):
        order = sorted((j for j in range(len(m)) if j != i), key=lambda j: (-scores[i, j], j))
        result[i + start] = [j + start for j in order[:k]]
    return result


def test_small_case(frame):
    v = table(frame, [[1, 0, 0], [0.9, 0.1, 0], [0, 1, 0], [0, 0, 1]])
    assert found(vectors.nearest_jobs(v, 100))[1] == [2, 3, 4]
    assert len(found(vectors.nearest_jobs(v, 2))[1]) == 2
    assert vectors.nearest_jobs(v, 0).count() == 0


@pytest.mark.parametrize("k", [1, 7, 300])
def test_plans_equal_a_full_scan_with_many_copies(frame, k):
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(240, 8))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix[::3] = matrix[0]
    v = table(frame, matrix).repartition(5)
    expected = brute(matrix, k)
    assert found(vectors.nearest_jobs(v, k)) == expected
    assert found(vectors.nearest_jobs(v, k, block_rows=50)) == expected


def test_tiles_do_not_change_the_result(monkeypatch):
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(30, 4)), np.round(rng.normal(size=(9000, 4)), 1)
    c[::3] = c[0]
    whole = vectors._scan(q, c, [np.arange(9000)], None, 5)
    monkeypatch.setattr(vectors, "TILE_CELLS", 700)
    tiled = vectors._scan(q, c, [np.arange(9000)], None, 5)
    scores = np.round(q @ c.T, 9)
    expected = [sorted(range(9000), key=lambda j: (-row[j], j))[:5] for row in scores]
    for found in (whole, tiled):
        assert found[2][0].reshape(30, 5).tolist() == expected


def test_large_block_is_quick():
    rng = np.random.default_rng(2)
    m = rng.normal(size=(8192, 64))
    start = time.perf_counter()
    row, _, _ = vectors._scan(m, m, [np.arange(8192)], None, 200)
    assert len(row) == 8192 * 200 and time.perf_counter() - start < 30


def test_null_and_short_vectors(frame):
    rows = frame([(1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 1.0, 0.0]), (None, [1.0, 0.0, 0.0])], SCHEMA)
    got = {(r["job_id"], r["candidate_id"]): r["raw_score"] for r in vectors.nearest_jobs(rows, 5).collect()}
    assert got == {(1, 3): 0.0, (3, 1): 0.0}
    with pytest.raises(ValueError):
        vectors.nearest_jobs(frame([(1, [1.0, 0.0]), (2, [1.0])], SCHEMA), 5)


def test_targets_and_unknown_id(frame):
    v = table(frame, np.eye(4))
    two = frame([(2,)], "job_id long")
    assert set(found(vectors.nearest_jobs(v, 3, two))) == {2}
    assert vectors.require_known(two, v) is two
    with pytest.raises(KeyError):
        vectors.nearest_jobs(v, 3, frame([(9,)], "job_id long"))
    with pytest.raises(KeyError):
        vectors.require_known(frame([(9,)], "job_id long"), v)


@pytest.mark.parametrize("rows", [[], [(1, [1.0]), (2, [1.0, 2.0])], [(1, [1.0]), (1, [1.0])], [(1, []), (2, [])], [(1, None)]])
def test_bad_vectors(frame, rows):
    with pytest.raises(ValueError):
        vectors.check_vectors(frame(rows, SCHEMA))


def test_embedding_default_and_own_encoder(frame):
    rows = frame([(1, "Spark spark sql"), (2, ""), (3, None)], "id long, t string")
    got = {r["id"]: np.array(r["embedding"]) for r in vectors.embed_texts(rows, "t", dimensions=32).collect()}
    assert len(got[1]) == 32 and np.isclose(np.linalg.norm(got[1]), 1) and not got[2].any() and not got[3].any()
    assert sorted(np.round(got[1][got[1] > 0], 4)) == [0.4472, 0.8944]

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    own = {r["id"]: r["embedding"] for r in vectors.embed_texts(rows, "t", load).collect()}
    assert own[2] == [0.0, 1.0] and np.isclose(np.linalg.norm(own[1]), 1)


JOBS = "id long, title string, company string, location string, category string, seniority string, detected_skills array<string>, url string"


@pytest.fixture
def board(frame):
    return frame(
        [
            (1, "A", "c", "l", "backend", "mid", ["docker", "python"], "u1"),
            (2, "B", "c", "l", "backend", "mid", ["python"], "u2"),
            (3, "C", "c", "l", "data", "senior", ["sql"], "u3"),
            (4, None, "c", "l", "backend", "mid", ["python"], "u4"),
            (5, "E", "c", "l", None, "", None, "u5"),
            (6, "F", "c", "l", "", None, [], "u6"),
        ],
        JOBS,
    )


MATRIX = [[1, 0, 0], [0.9, 0.1, 0], [0, 1, 0], [0.95, 0, 0.05], [0, 0.5, 0.5], [0, 0.4, 0.6]]


def test_recommendations(frame, board):
    v = table(frame, MATRIX)
    rows = recommend.recommend(board, v, frame([(1,), (5,)], "job_id long"), limit=5).collect()
    one = sorted((r for r in rows if r["job_id"] == 1), key=lambda r: r["position"])
    assert [r["candidate_id"] for r in one] == [2, 3, 5, 6]
    assert one[0]["score"] == round(0.7 * 0.9 + 0.2 * 0.5 + 0.1, 4) and one[0]["shared_skills"] == ["python"]
    five = {r["candidate_id"]: r for r in rows if r["job_id"] == 5}
    assert five[6]["same_category"] and five[6]["same_seniority"] and five[6]["skill_overlap_score"] == 0.0


def test_gates_run_after_the_pool_cut(frame, board):
    v = table(frame, MATRIX)
    one = frame([(1,)], "job_id long")

    def picked(**options):
        rows = recommend.recommend(board, v, one, **options).collect()
        return [r["candidate_id"] for r in sorted(rows, key=lambda r: r["position"])]

    assert picked(pool=1) == []
    assert picked(pool=2) == [2]
    assert picked(same_category_only=True) == [2]
    assert picked(min_shared_skills=1) == [2]
    assert picked(min_embedding_score=0.5) == [2]
    assert picked(limit=1) == [2]
    assert picked(block_rows=2) == picked()
    with pytest.raises(ValueError):
        picked(limit=21)


def test_skewed_recommendations_stay_whole(frame):
    """A third of all postings are copies of one text."""
    rng = np.random.default_rng(2)
    m = rng.normal(size=(90, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[::3] = m[0]
    jobs = frame([(i + 1, "t", "c", "l", "k", "s", ["python"], f"u{i}") for i in range(90)], JOBS)
    rows = recommend.recommend(jobs, table(frame, m), limit=3, pool=40, block_rows=20)
    assert rows.groupBy("job_id").count().filter("count = 3").count() == 90
    assert rows.filter(F.col("job_id") == F.col("candidate_id")).count() == 0


def test_small_blocks_do_not_copy_a_table_for_each_of_them(frame, monkeypatch):
    copied, original = [], vectors.scan_blocks

    def counted(blocks, *rest):
        copied.append(blocks.count())
        return original(blocks, *rest)

    monkeypatch.setattr(vectors, "scan_blocks", counted)
    matrix = np.random.default_rng(3).normal(size=(600, 4))
    v = table(frame, matrix)
    assert found(vectors.nearest_jobs(v, 3, block_rows=2)) == brute(matrix, 3)
    assert copied[0] <= 600 * (1 + v.sparkSession.sparkContext.defaultParallelism)  # 600 * 600 with a block for two rows


def test_a_block_returns_its_rows_in_parts(frame, monkeypatch):
    monkeypatch.setattr(vectors, "FOUND_ROWS", 1)  # 256 queries at once
    matrix = np.random.default_rng(6).normal(size=(700, 4))
    v = table(frame, matrix)
    sizes, original = [], vectors._best_rows

    def counted(q, *rest):
        sizes.append(len(q))
        return original(q, *rest)

    monkeypatch.setattr(vectors, "_best_rows", counted)
    block = pa.Table.from_pylist([{"_asks": True, "query_id": i, "candidate_id": None, "embedding": matrix[i].tolist()} for i in range(700)]
                                 + [{"_asks": False, "query_id": None, "candidate_id": i, "embedding": matrix[i].tolist()} for i in range(700)])
    got = vectors._block_rows(block, ["candidate_id"], 5, True, [], [])
    assert sum(len(b) for b in got) == 3500 and max(sizes) == 256
    assert found(vectors.nearest_jobs(v, 5, block_rows=100)) == brute(matrix, 5)


def test_scores_behind_the_first_tile_are_looked_at_only_if_they_can_matter():
    rng = np.random.default_rng(8)
    m = rng.normal(size=(6000, 6))
    m[::5] = m[0]  # many equal scores
    m[7] = np.nan
    ids = np.arange(6000)
    row, score, taken = vectors._scan(m[:60], m, [ids], ids[:60], 10)
    exact = np.round(m[:60] @ m.T, 9)
    for i in range(60):
        order = sorted((j for j in range(6000) if j != i and not np.isnan(exact[i, j])), key=lambda j: (-exact[i, j], j))[:10]
        assert taken[0][row == i].tolist() == order


def test_tasks_find_the_words_that_the_jvm_finds(frame):
    odd = ["", None, "One two_3, ONE", "Ärger über 2½ m² naïve", "x", " ", "áb c", "İstanbul ǅ ɐɐ word", "Привет, мир! 日本語 テキスト", "end\x00of \U0001d49c1 line",
           "K ⅷ — ok", "ß", " nbsp em", "tail", "é", "÷×"]
    rows = frame(list(enumerate(odd)), "id int, body string").coalesce(1)
    marked = vectors._marked_words(rows, "body").select("_marked").toArrow().column(0).combine_chunks()
    for part in (marked, marked.slice(3, 7)):
        row, found = vectors._found_words(part)
        got = [[] for _ in range(len(part))]
        for place, word in zip(row.tolist(), found.to_pylist()):
            got[place].append(word.decode())
        want = [r[0] or [] for r in rows.select(text.word_list(F.col("body"))).collect()]
        assert got == (want if len(part) == len(odd) else want[3:10])


def test_embedding_sends_no_list_of_words_to_python(frame):
    rows = frame([(1, "a b"), (2, "Привет a")], "id int, body string")
    for found in (vectors.embed_texts(rows, "body"), vectors.text_weights(rows, "body")):
        assert "split(" not in found._jdf.queryExecution().executedPlan().toString()
    assert [round(sum(w * w for w in r.embedding), 6) for r in vectors.embed_texts(rows, "body").collect()] == [1, 1]


def test_plain_texts_pass_by_the_expression_for_white_space(frame):
    rows = ["a b", " a  b ", "a\tb", "a b", "é ü", " x", "", None, "a \n b", "x\x85y", "\x1c"]
    got = [r[0] for r in frame([(r,) for r in rows], "t string").select(text.collapse_spaces(F.col("t"))).collect()]
    assert got == ["a b", "a b", "a b", "a b", "é ü", "x", "", None, "a b", "x y", ""]


@pytest.mark.parametrize("k", [1, 7, 300])
def test_a_corpus_that_passes_blocks_of_queries_gives_the_rows_of_a_full_scan(frame, monkeypatch, k):
    monkeypatch.setattr(vectors, "PACKET_ROWS", 40)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 16)
    monkeypatch.setattr(vectors, "HELD_BYTES", 10_000)
    rng = np.random.default_rng(9)
    matrix = rng.normal(size=(240, 8)) * rng.choice([1e-3, 1.0, 1e3], size=(240, 1))
    matrix[::3] = matrix[0]
    v = table(frame, matrix).repartition(5)
    rows = vectors.nearest_jobs(v, k)
    assert found(rows) == brute(matrix, k)
    assert [r["rank"] for r in rows.where("job_id = 4").orderBy("rank").collect()] == list(range(1, min(k, 239) + 1))
    two = frame([(4,), (17,)], "job_id long")
    assert found(vectors.nearest_jobs(v, k, two)) == {i: brute(matrix, k)[i] for i in (4, 17)}


def test_no_more_than_k_rows_of_a_query_leave_its_task(frame, monkeypatch):
    """With a row for each block of the corpus, 600,000 postings had thousands of rows each."""
    def blocked(*_):
        raise AssertionError("k rows for each block of the corpus")

    monkeypatch.setattr(vectors, "scan_blocks", blocked)
    matrix = np.random.default_rng(10).normal(size=(900, 4))
    rows = vectors.nearest_jobs(table(frame, matrix), 5)
    assert found(rows) == brute(matrix, 5)
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()


def test_passing_corpus_with_odd_values():
    rng = np.random.default_rng(11)
    m = rng.normal(size=(2000, 6))
    m[7] = np.nan
    m[8] *= 1e200  # beyond single precision
    m[9] = 0
    m[10:300:3] = m[10] + rng.normal(scale=1e-9, size=(97, 6))  # closer than single precision tells apart
    ids = rng.permutation(2000)
    with np.errstate(all="ignore"):
        exact = np.round(m @ m.T, 9)
    for width in (64, 300, 2000):
        passing = vectors.Passing(m[:320], ids[:320], 10, 1, True)
        for at in range(0, 2000, width):
            passing.meet(m[at:at + width], [ids[at:at + width]])
        parts = list(passing.found())
        query, taken, score, rank = np.concatenate([p[0] for p in parts]), np.concatenate([p[1][0] for p in parts]), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        for i in range(320):
            order = sorted((j for j in range(2000) if j != i and not np.isnan(exact[i, j])), key=lambda j: (-exact[i, j], ids[j]))[:10]
            mine = query == ids[i]
            assert rank[mine].tolist() == list(range(1, len(order) + 1))
            if i != 8:
                assert taken[mine].tolist() == ids[order].tolist()
                assert np.allclose(score[mine], exact[i, order], rtol=1e-12, atol=2e-9)
    with pytest.raises(ValueError):
        vectors.Passing(m[:2], ids[:2], 1, 1, False).meet(m[:, :3], [ids])


@pytest.mark.parametrize("options", [{}, {"limit": 10, "same_category_only": True, "min_shared_skills": 1, "min_embedding_score": 0.05}])
def test_postings_are_tagged_once(spark, frame, options):
    tagged = spark.sparkContext.accumulator(0)

    def tag(i):
        tagged.add(1)
        return ["python", None] if i % 3 else None

    rng = np.random.default_rng(12)
    bare = frame([(i, "t", "c", "l", "ab"[i % 2], "s", f"u{i}") for i in range(1, 81)], JOBS.replace("detected_skills array<string>, ", ""))
    jobs = bare.withColumn("detected_skills", F.udf(tag, "array<string>")("id"))
    v = table(frame, rng.normal(size=(60, 6)))
    rows = recommend.recommend(jobs, v, pool=20, **options)
    got = sorted(rows.collect())
    assert tagged.value <= 80  # 160 with a pass for the targets and one for the candidates
    assert got and got == sorted(recommend.recommend(jobs.localCheckpoint(), v, pool=20, block_rows=20, **options).collect())
    tagged.value = 0
    cases = evaluate.recommendation_cases(jobs, v)
    assert cases.count() == 40 and tagged.value <= 80  # 240 with one more for the cases
    assert evaluate.recommendation_summary(cases).first()["evaluated_jobs"] == 40


def test_pairs_are_scored_alike_from_sizes(frame):
    jobs = frame([(1, "t", "c", "l", "k", "s", ["b", "a", "b", None], "u"), (2, "t", "c", "l", None, "s", [None, "b", "c", "b"], "u"), (3, "t", "c", "l", "", None, None, "u")], JOBS)
    pool = frame([(1, 2, 0.5, 1), (2, 1, 0.5, 1), (1, 3, 0.1, 2), (3, 3, 0.1, 3)], "job_id long, candidate_id long, raw_score double, rank int")
    got = {(r["job_id"], r["candidate_id"]): (r["shared_skills"], r["skill_overlap"]) for r in recommend.scored_pairs(jobs, pool).collect()}
    assert got == {(1, 2): (["b", None], 0.5), (2, 1): (["b", None], 0.5), (1, 3): ([], 0.0), (3, 3): ([], 0.0)}


def test_an_evaluation_writes_its_postings_once(frame, board, monkeypatch):
    written, original = [], recommend.written

    def counted(rows, name):
        written.append(name)
        return original(rows, name)

    monkeypatch.setattr(recommend, "written", counted)
    cases = {r["job_id"]: r["recommendation_count"] for r in evaluate.recommendation_cases(board, table(frame, MATRIX), limit=2).collect()}
    assert cases == {1: 2, 2: 2, 3: 2, 4: 2} and written == ["postings"]
