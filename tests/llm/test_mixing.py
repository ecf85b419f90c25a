"""Pareto mixing against the targets worked out by hand, and its edge cases."""

import collections

import pytest
from pyspark.sql import functions as F

from vacantia.llm import mixing

SCHEMA = "doc_id long, text string, source string, _size string, target string"


def rows(n_by_source):
    out, key = [], 0
    for source, n in n_by_source.items():
        for i in range(n):
            out.append((key, "w " * (1 + (i * 7) % 40), source, "x", "y"))
            key += 1
    return out


def water_fill(sizes, weights, share=1.5, most=2.0):
    total, open_, out = share * sum(sizes.values()), dict(weights), {}
    while open_:
        level = (total - sum(out.values())) / sum(open_.values())
        full = [s for s in open_ if level * open_[s] >= most * sizes[s]]
        if not full:
            return out | {s: level * w for s, w in open_.items()}
        for s in full:
            out[s] = most * sizes[s]
            del open_[s]
    return out


def test_targets_and_words(spark, frame):
    docs = frame(rows({"b": 300, "a": 50, None: 80, "c": 10, "Z": 40}), SCHEMA)
    got = mixing.pareto_mix(docs).collect()
    again = mixing.pareto_mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = collections.Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    order = ["Z", "a", "b", "c", None]
    expected = water_fill(sizes, dict(zip(order, (5, 2, 1, 5, 2))))
    assert sum(expected.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert all(r["target"] == pytest.approx(expected[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - expected[s]) <= 20.5  # half of the longest document
        assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2 for r in own)


def test_longer_documents_are_likelier(spark, frame):
    docs = frame([(i, "w " * (1000 if i % 2 else 10), "a", "", "") for i in range(400)] + [(1000 + i, "w " * 500, "b", "", "") for i in range(400)], SCHEMA)
    got = mixing.pareto_mix(docs, weights=(1, 9)).where("source = 'a'").groupBy("size").agg(F.avg("inclusion").alias("p")).collect()
    p = {r["size"]: r["p"] for r in got}
    assert p[1000] > p[10]


def test_edge_cases(spark, frame):
    assert mixing.pareto_mix(frame([], SCHEMA)).collect() == []
    got = mixing.pareto_mix(frame([(1, None, "a", "", ""), (2, "", "a", "", ""), (None, " \n", None, "", "")], SCHEMA)).collect()
    assert {(r["size"], r["taken"], r["target"]) for r in got} == {(0, 0, 0.0)}
    same = [(7, "a b c", "s", "", "")] * 5 + [(None, "x " * 30, "t", "", ""), (None, "y", "t", "", "")]
    got = mixing.pareto_mix(frame(same, SCHEMA)).collect()
    assert len(got) == 7
    assert len({r["copies"] for r in got if r["doc_id"] == 7}) == 1


def test_mixed_documents_repeat_rows(spark, frame):
    docs = frame(rows({"a": 60, "b": 200, None: 30}), SCHEMA)
    copies = {r["doc_id"]: r["copies"] for r in mixing.pareto_mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    found = collections.Counter(r["doc_id"] for r in out.collect())
    assert found == {k: n for k, n in copies.items() if n}


def test_no_python_in_the_plan(spark, frame):
    plan = mixing.pareto_mix(frame(rows({"a": 5}), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
