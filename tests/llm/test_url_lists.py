"""Dated list entries against a plain scan of all entries."""

import datetime as dt
import pathlib

import duckdb
import pytest

from tools.compare import canonical
from vacantia.llm import oracle, queries, url_lists

T = lambda day, hour=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)
CAPTURES = "page_id long, url string, fetched_at timestamp, host string, list_name string"
EVENTS = "list_name string, host string, at timestamp, added boolean, page_id long"


@pytest.fixture
def events(frame):
    return frame([
        ("spam", "bad.com", T(0), True, 0), ("spam", "bad.com", T(100), False, 0), ("spam", "bad.com", T(200), True, 0),
        ("adult", "Sub.Bad.com", T(50, 3), True, 0), ("spam", "x.org", T(5), True, 0), ("spam", "x.org", T(5), False, 0),
        (None, "null.net", T(1), True, 0), ("spam", None, T(1), True, 0), ("spam", "y.org", None, True, 0), ("spam", "y.org", T(1), None, 0),
        ("spam", "bad.com", T(0), True, 0),
    ], EVENTS)


def test_active_at_fetch_time(spark, frame, events):
    cases = [
        ("http://bad.com/a", T(0), "spam"), ("http://bad.com/a", T(-1), ""), ("http://bad.com/a", T(100), ""),
        ("http://bad.com/a", T(99, 23), "spam"), ("https://user@A.sub.bad.com.:80/x", T(60), "adult,spam"),
        ("https://sub.bad.com", T(300), "adult,spam"), ("http://notbad.com", T(60), ""), ("http://x.org", T(6), ""),
        ("http://null.net", T(2), ""), ("nonsense", T(2), ""), ("", T(2), ""), (None, T(2), ""), ("http://bad.com", None, ""),
        ("http://y.org", T(9), ""),
    ]
    captures = frame([(i, u, t, "clash", "clash") for i, (u, t, _) in enumerate(cases)] + [(0, cases[0][0], cases[0][1], "", "")], CAPTURES)
    got = {r["page_id"]: r for r in url_lists.evaluate_captures(captures, events).collect()}
    assert len(got) == len(cases)
    for i, (_, _, lists) in enumerate(cases):
        blocked = bool(lists) or cases[i][0] == "http://null.net"
        assert (got[i]["lists"], got[i]["blocked"]) == (lists, blocked), cases[i]
    assert got[0]["copies"] == 2 and got[1]["copies"] == 1


def test_empty_tables(spark, frame, events):
    none = frame([], CAPTURES)
    assert url_lists.evaluate_captures(none, events).collect() == []
    one = frame([(1, "http://bad.com", T(1), "", "")], CAPTURES)
    assert [r["blocked"] for r in url_lists.evaluate_captures(one, frame([], EVENTS)).collect()] == [False]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for file in pathlib.Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    ours = queries.op6_temporal_url_lists(spark, folder)
    theirs = con.sql(oracle.oracle_sql()["op6_temporal_url_lists"]).to_arrow_table()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.column_names)
    ours = ours.toArrow()
    a, b = (canonical(zip(*[t.column(c).to_pylist() for c in columns])) for t in (ours, theirs))
    assert a == b and len(a) > 0
    assert "Python" not in queries.op6_temporal_url_lists(spark, folder)._jdf.queryExecution().toString()
