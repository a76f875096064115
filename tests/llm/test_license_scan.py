import re

import pytest
from pyspark.sql import functions as F

from tabwright.llm.license_scan import BASE, COVER, GAP, NOTICES, STRETCH, scan


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


CASES = [
    ("MIT-License, mit license; mit mit license", "mit"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-notice"),
    ("Permission is hereby granted, free of all charge, to any person obtaining one copy of this software and associated documentation files", "mit-text"),  # words put in and changed
    ("permission is hereby granted to nobody", ""), ("Apache\nLicense", "apache"), ("apache licenseé", ""), ("cc by cc by", "cc-by"), ("gnu general general public license", ""),
    ("", ""), (None, ""), ("license", ""), ("x " * 30_000 + "All rights reserved", "all-rights-reserved"), ("the the " * 5_000, ""),
]


def test_labels_spans_and_hard_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("words", F.lit("w"))
    for r in scan(df).collect():
        text, labels = CASES[r.doc_id]
        assert r.labels == labels, text
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert (r.score > 0) == bool(labels) and 0 <= r.score <= 1


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "mit license"), (1, "mit license"), (1, "mit license"), (1, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_base) for r in scan(df).collect()) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert scan(df.limit(0)).count() == 0


def test_only_spark_functions(spark, sf):
    plan = scan(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def brute_notices(text):
    """Labels and best share of the notices: any stretch of allowed length within a run of near diagonals that has enough of the pairs."""
    words, found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()), {}
    for notice, label in NOTICES:
        n = notice.split()
        votes = [(i, p) for i in range(len(words) - 1) for p in range(len(n) - 1) if words[i:i + 2] == n[p:p + 2]]
        runs = []
        for d in sorted({i - p for i, p in votes}):
            if runs and d - runs[-1][-1] <= GAP:
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            inside = [(i, p) for i, p in votes if i - p in run]
            best = max(len({p for i, p in inside if low <= i and i + 2 - low <= len(n) * STRETCH}) for low, _ in inside) / (len(n) - 1)
            if best >= COVER:
                found[label] = max(best, found.get(label, 0))
    return found


FOLLOWING = ["released under the MIT license. The MIT license permits use", "All rights reserved. All rights reserved.", "all rights reserved " * 50,
             "released under the the mit license the mit license", "released under the mit license " * 3, "released under the the mit the mit license",
             "licensed under the apache license version licensed under the apache 2 0", "all rights all rights reserved rights reserved",
             "released the mit license under the mit license license under the mit"]


def test_notices_that_follow_each_other(spark):
    texts = FOLLOWING
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan(df).collect()}
    for i, text in enumerate(texts):
        want = brute_notices(text)
        assert set(got[i].labels.split(",")) - {label for _, label in BASE} - {""} == set(want), text
        assert got[i].score == (1 if got[i].n_base else max(want.values(), default=0)), text
    assert "mit-notice" in got[0].labels and got[1].labels == "all-rights-reserved"


def test_sql_on_the_hard_texts(spark):
    import duckdb

    from tabwright.llm.license_scan import scan_sql
    from tests.compare import difference
    rows = list(enumerate([t for t, _ in CASES] + FOLLOWING + ["all rights reserved " * 50 + "y " * 9 + "released under the the mit license"]))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    clash = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("template", "votes", "label", "passage", "n_words")})
    assert difference(scan(clash), con, scan_sql()) is None
