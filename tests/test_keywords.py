"""The keyword index gives the rows of the plain search and reads less."""

import random

import pytest
from pyspark.sql import functions as F

from vacantia.operators import keywords, search
from vacantia.sources.tables import BucketedTable

SCHEMA = "id bigint, title string, description string, cleaned_description string, category string"
WORDS = ["python", "Spark", "SQL", "data", "Engineer", "ÜBER", "straße", "100%", "a_b", "c++", "ΟΔΟΣ", "node.js", "x", "\U0001f600go"]
ASKED = ["python", "SPARK", "ql", "ta eng", "über", "STRASSE", "straße", "0%", "a_b", "a%b", "c++", "οδος", "ΟΔΟΣ", ".j", "go", "%%", "__", "zzz",
         "x", " data ", "\\_", "\U0001f600", "engineer data", None, ""]


@pytest.fixture(scope="module")
def jobs(spark):
    rng = random.Random(4)
    rows = [(i, *(" ".join(rng.choices(WORDS, k=rng.randint(0, 6))) for _ in range(3)), "c") for i in range(300)]
    rows += [(900, None, None, None, None), (901, "", "", "", ""), (902, "py\nthon", "q" * 20000 + "python", None, "c")]
    return spark.createDataFrame(rows, SCHEMA)


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


@pytest.mark.parametrize("blocks,rarest", [(1, 1), (7, 4)])
def test_same_rows_as_plain_search(jobs, blocks, rarest):
    index = keywords.index_keywords(jobs, blocks).cache()
    for keyword in ASKED:
        got = keywords.holding(jobs, index, keyword, rarest)
        assert got.columns == jobs.columns
        assert ids(got) == ids(search.matching(jobs, keyword)), keyword


def test_lists_are_sorted_and_stay_in_their_block(jobs):
    index = keywords.index_keywords(jobs, 5).collect()
    assert all(r["ids"] == sorted(set(r["ids"])) and r["n"] == len(r["ids"]) for r in index)
    block = {}
    for r in index:
        assert 0 <= r["block"] < 5
        for i in r["ids"]:
            assert block.setdefault(i, r["block"]) == r["block"]
    assert {len(r["gram"]) for r in index if r["gram"].isascii()} == {2, 3}


def test_texts_are_compared_behind_the_join_only(jobs, tmp_path):
    jobs.write.parquet(str(tmp_path / "jobs"))
    stored = jobs.sparkSession.read.parquet(str(tmp_path / "jobs"))
    found = keywords.holding(stored, keywords.index_keywords(stored), "python")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert "_like" in plan[:join + 200] and "%python%" not in plan[:join + 200]


def test_stored_tables_read_the_buckets_that_matter(spark, jobs, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "jobs"), SCHEMA, "id", 16)
    table.replace(jobs, range(16))
    index = BucketedTable(spark, str(tmp_path / "index"), keywords.INDEX_SCHEMA, "gram", 16)
    index.replace(keywords.index_keywords(jobs, 4), range(16))
    for keyword in ASKED:
        assert ids(keywords.holding_stored(table, index, keyword)) == ids(search.matching(jobs, keyword)), keyword
    rare = keywords.holding_stored(table, index, "qpython")
    assert ids(rare) == [902]
    files = rare.inputFiles()
    assert len([f for f in files if "/jobs/" in f]) == 1 and len([f for f in files if "/index/" in f]) < 16


def test_empty_tables_and_bad_arguments(spark, jobs):
    none = jobs.limit(0)
    assert keywords.holding(none, keywords.index_keywords(none), "python").collect() == []
    assert keywords.holding(jobs, keywords.index_keywords(none), "python").collect() == []
    with pytest.raises(ValueError):
        keywords.index_keywords(jobs, 0)
    extra = jobs.withColumn("like", F.lit(1)).withColumn("block", F.lit("b")).withColumn("gram", F.lit("g"))
    assert ids(keywords.holding(extra, keywords.index_keywords(extra), "spark")) == ids(search.matching(jobs, "spark"))


def test_index_is_gathered_in_lists_and_holds_every_sequence(jobs):
    rare = "".join(chr(0x4E00 + i) for i in range(3000)) + "\U0001f600\U0001f601x"
    rows = jobs.unionByName(jobs.sparkSession.createDataFrame([(1000, rare, None, None, "c"), (1001, "a\x00b", None, None, "c")], SCHEMA))
    index = keywords.index_keywords(rows.union(rows), 3)  # every id twice
    expected = {}
    for r in rows.select("id", F.concat_ws("\n", *[F.lower(c) for c in keywords.SEARCHED]).alias("text")).collect():
        for size in (2, 3):
            for i in range(len(r["text"]) - size + 1):
                expected.setdefault(r["text"][i : i + size], set()).add(r["id"])
    got = {}
    for r in index.collect():
        assert not got.setdefault(r["gram"], set()) & set(r["ids"])
        got[r["gram"]] |= set(r["ids"])
    assert got == expected
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row for a pair of sequence and posting


@pytest.mark.parametrize("texts", [[], [""], ["a"], ["ab", "", "abc"], ["".join(chr(i) for i in range(0xE000, 0x19000))] * 3, ["aXbc"] * 40])
def test_pairs_of_texts(texts):
    grams, numbers = keywords._text_pairs(texts)
    got = list(zip(keywords._gram_texts(grams), numbers.tolist()))
    expected = {(t[i : i + s], n) for n, t in enumerate(texts) for s in (2, 3) for i in range(len(t) - s + 1)}
    assert len(got) == len(set(got)) and set(got) == expected
    assert list(grams) == sorted(grams)
