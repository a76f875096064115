import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tabwright.llm.exact_dedup import drop_duplicates, heavy_winners, mark_duplicates


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            out.append((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("copies", [3, 200])
def test_groups_as_brute_force(spark, copies):
    rows = [(i, f"a  b{i % 7}\t c") for i in range(40)] + [(100 + i, "hot\n text") for i in range(copies)]
    rows += [(900, None), (901, ""), (902, " "), (903, "hot text"), (904, "é" * 200_000), (905, "é" * 200_000)]
    got = mark_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_repeated_rows_keep_one_and_null_ids_come_last(spark):
    rows = [(5, "x")] * 100 + [(None, "x"), (7, "y"), (7, "y"), (None, "z"), (None, "z")]
    got = mark_duplicates(frame(spark, rows)).where("kept").groupBy("text_sha256").count().collect()
    assert sorted(r["count"] for r in got) == [1, 1, 1]
    assert {r.doc_id for r in drop_duplicates(frame(spark, rows)).collect()} == {5, 7, None}


def test_empty_table_and_clashing_columns(spark):
    assert mark_duplicates(frame(spark, [])).count() == 0
    df = frame(spark, [(1, "a"), (2, "a")]).withColumn("row", F.lit(1)).withColumn("keep_id", F.lit("k")).withColumn("text_sha256", F.lit(2))
    kept = drop_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 1


def test_sketch_finds_every_frequent_digest(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text_sha256"))
    got = heavy_winners(df, tracked=64, heavy=16).collect()
    assert [(r.text_sha256, r.keep_id, r.group_size) for r in got] == [("hot", 0, 20_000)]
