"""Records cut in parallel against the reader that takes a file by one task, at split sizes of a few bytes."""

import csv
import io

import numpy as np
import pytest

from tabwright.sources import records
from tabwright.sources.files import FileSpec, bad_records, read_file

SCHEMA = "id int, text string, more string"


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set("spark.sql.files.maxPartitionBytes", str(size)), spark.conf.set("spark.sql.files.openCostInBytes", "1")]
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def written(path, rng, n, end="\n"):
    """A file of n records with quotes, separators and line breaks inside, plain quotes in mid-field, and blank lines."""
    parts = ["plain", 'say "hi"', "a,b", "two\nlines", "three\n\n\nlines", '"', "", "x" * 30, 'q"q', 'tail\n"quoted"\n', "\n", "ä€𝄞"]
    out = io.StringIO()
    out.write(f"id,text,more{end}")
    for i in range(n):
        if rng.random() < 0.1:
            out.write(f'{i},5" pipe,it"s{end}')  # not quoted: these quotes are text
        elif rng.random() < 0.1:
            out.write(end)
        else:
            csv.writer(out, lineterminator=end).writerow([i, "".join(rng.choice(parts, 2)), rng.choice(parts)])
    path.write_bytes(out.getvalue().encode())


@pytest.mark.parametrize("size", [16, 97, 1000])
def test_any_split_gives_the_rows_of_one_task(spark, tmp_path, small_splits, size):
    rng = np.random.default_rng(size)
    for name in "abc":
        written(tmp_path / f"{name}.csv", rng, 40)
    path = str(tmp_path)
    want = rows_of(read_file(spark, FileSpec(path, "csv", SCHEMA)))
    small_splits(size)
    found = records.lines(spark, path)
    assert found.select("file", "block").distinct().count() > 3
    got = rows_of(read_file(spark, FileSpec(path, "csv", SCHEMA, split_above=0)))
    assert len(want) > 90 and got == want


def test_names_types_line_ends_and_bad_records(spark, tmp_path, small_splits):
    small_splits(20)
    (tmp_path / "t.csv").write_bytes('\ufeffid,"the ""name""",x,when,day,yes,none\r\n1,"a\r\nb",1.5,2024-01-02 03:04:05,2024-01-02,true,\r\n\r\n20000000000,c,2,2024-01-02,2024-02-03,FALSE,\r\n'.encode())
    df = read_file(spark, FileSpec(str(tmp_path / "t.csv"), split_above=0))
    assert df.dtypes == [("id", "bigint"), ('the "name"', "string"), ("x", "double"), ("when", "timestamp"), ("day", "date"), ("yes", "boolean"), ("none", "string")]
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in df.orderBy("id").collect()] == [(1, "a\r\nb", 1.5, True, None), (20000000000, "c", 2.0, False, None)]
    (tmp_path / "u.csv").write_text("id,name\n1,Zoë\nx,y\n3,z\n", encoding="utf-8")
    spec = FileSpec(str(tmp_path / "u.csv"), schema="id int, name string", corrupt="_bad", split_above=0)
    assert rows_of(read_file(spark, spec)) == [(1, "Zoë", None), (3, "z", None), (None, "y", "x,y")]
    assert bad_records(read_file(spark, spec), "_bad").first() == (3, 1)


def test_open_end_empty_file_and_no_header(spark, tmp_path, small_splits):
    small_splits(8)
    (tmp_path / "open.tsv").write_text('a\tb\n1\t"x\ny\nz')
    assert [r["value"] for r in records.records(spark, str(tmp_path / "open.tsv"), "\t").orderBy("block", "line").collect()] == ["a\tb", '1\t"x\ny\nz']
    (tmp_path / "n.csv").write_text('1,"p\nq"\n2,r\n')
    assert rows_of(read_file(spark, FileSpec(str(tmp_path / "n.csv"), options={"header": False}, split_above=0))) == [(1, "p\nq"), (2, "r")]
    (tmp_path / "e.csv").write_text("")
    assert records.records(spark, str(tmp_path / "e.csv")).count() == 0


def test_how_a_line_ends():
    for line, outside, inside in [("a,b", 0, 1), ('a,"b', 1, 0), ('"a""', 1, 0), ('""', 0, 1), ('a"b', 0, 0), ('"a"b"c,"', 1, 1), ('x","y', 1, 1), ('x",y', 0, 0)]:
        assert (records.ends_inside(line, False), records.ends_inside(line, True)) == (bool(outside), bool(inside)), line
