"""Several raw files: each with its own header, in the order of their names."""

import pandas as pd

from vacantia.operators import prepare
from vacantia.sources import tables

COLUMNS = ["job_id", "title", "description"]


def put(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def raw_folder(tmp_path):
    folder = tmp_path / "postings.csv"
    put(folder, "part b 2.csv", ["title,job_id,extra,description", 'late,1,x,"two\nlines"', "only here,4,x,d", "late,2,x,d"])
    put(folder, "part a 1.csv", ["job_id,title,description", '1,first,"a, b"', "2,second,", "1,again,c", "3,short"])
    put(folder, "part c 3.csv", ["job_id,description", "5,no title", "1,also late"])
    return folder


def test_files_with_other_headers_equal_pandas(spark, tmp_path):
    folder = raw_folder(tmp_path)
    got = tables.load_postings(spark, str(tmp_path)).orderBy("ordinal").select(*COLUMNS).collect()
    frames = [pd.read_csv(f, dtype=str).reindex(columns=COLUMNS) for f in sorted(folder.iterdir())]
    every = pd.concat(frames).astype(object)
    assert [tuple(r) for r in got] == [tuple(r) for r in every.where(every.notna(), None).itertuples(index=False)]
    rows = tables.load_postings(spark, str(tmp_path))
    assert rows.select("ordinal").distinct().count() == rows.count()
    first = every.drop_duplicates("job_id")
    kept = {r["job_id"]: r["title"] for r in prepare.first_by_key(rows, "job_id", "ordinal").collect()}
    assert kept == dict(zip(first["job_id"], first["title"].where(first["title"].notna(), None)))


def test_rejected_lines_are_a_table(spark, tmp_path):
    folder = raw_folder(tmp_path)
    put(folder, "part d 4.csv", ["job_id,title", "7,fine", "8,too,many", "9,fine,"])
    lost = tables.rejected_lines(spark, str(folder)).collect()
    assert [(r["file"].rsplit("/", 1)[1], r["fields"]) for r in lost] == [("part d 4.csv", ["8", "too", "many"])]
    kept = [r["job_id"] for r in tables.read_csv(spark, str(folder), ["job_id"]).collect()]
    assert "8" not in kept and {"7", "9"} <= set(kept)


def test_many_small_files_keep_their_order(spark, tmp_path):
    folder = tmp_path / "postings.csv"
    for i in range(12):
        put(folder, f"{i:02d}.csv", ["job_id,title" if i % 2 else "title,job_id", *((f"{i},{j}" if i % 2 else f"{j},{i}") for j in range(20))])
    got = tables.load_postings(spark, str(tmp_path)).orderBy("ordinal").select("job_id", "title").collect()
    assert [tuple(map(int, r)) for r in got] == [(i, j) for i in range(12) for j in range(20)]
