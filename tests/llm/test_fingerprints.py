import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tabwright.llm import fingerprints as fp
from tests.compare import difference


def lanes(text):
    """Sums of a text by the definition, one paragraph after the other."""
    out = [0] * (fp.LANES + fp.EXACT)
    for p in text.split("\n"):
        digest = hashlib.sha256(p.encode()).hexdigest()
        for j in range(fp.EXACT):
            out[fp.LANES + j] += int(digest[8 * j:8 * j + 8], 16)
        for run in re.findall(fp.RUNS, p):
            code = int(hashlib.md5(run.encode()).hexdigest()[:4], 16)
            out[code % fp.LANES] += -1 if code // fp.LANES % 2 else 1
    return out


def written(v):
    return "".join(f"{x % 2**16:04x}" for x in v[:fp.LANES]) + "".join(f"{x % 2**32:08x}" for x in v[fp.LANES:])


def near(a, b):
    if written(a) == written(b):
        return 1.0
    size = sum(x * x for x in a[:fp.LANES]) + sum(x * x for x in b[:fp.LANES])
    return max(0.0, 1 - sum((x - y) ** 2 for x, y in zip(a[:fp.LANES], b[:fp.LANES])) / size) if size else 0.0


def brute(rows):
    """Result rows for distinct ids."""
    rows = sorted((i, t or "") for i, t in rows)
    out = []
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, c = lanes(t), lanes(edited), lanes(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(a), written(b), near(a, b), near(a, c)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def hard_rows():
    rng = random.Random(5)
    word = lambda: rng.choice(["la", "über", "𝒳y", "on-e", "x" * 300, "a\tb", "e\x0bf", "zz"])
    rows = [(3 * i, "\n".join(" ".join(word() for _ in range(rng.randrange(12))) for _ in range(rng.randrange(8)))) for i in range(60)]
    return rows + [(1, None), (2, ""), (500, "\n"), (501, "\n\n\n"), (502, "one\n"), (503, "\none"), (504, "é" * 50_000), (505, "w " * 40_000), (506, "same"), (507, "same"), (508, "x")]


def test_as_brute_force(spark):
    got = fp.edited_fingerprints(frame(spark, hard_rows()).repartition(5)).collect()
    assert sorted(map(tuple, got)) == brute(hard_rows())


def test_sql_on_the_hard_rows(spark):
    import duckdb
    con = duckdb.connect()
    hard = frame(spark, hard_rows()).toPandas()  # noqa: F841
    con.execute("create table documents as select doc_id::bigint as doc_id, text from hard")
    assert difference(fp.edited_fingerprints(frame(spark, hard_rows())), con, fp.edited_sql()) is None


def test_order_of_paragraphs_does_not_matter_but_each_does(spark):
    texts = {0: "a b c\nd e\nf\nf", 1: "f\nd e\na b c\nf", 2: "f\nd e\na b c", 3: "a b c\nd e\nf f", 4: "a b\nc d e\nf\nf"}
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(frame(spark, list(texts.items()))).collect()}
    assert got[0] == got[1] and len({got[i] for i in (0, 2, 3, 4)}) == 4


def test_paragraphs_go_in_and_out(spark):
    whole, part, rest = "a b c d e\nf g\nh", "f g", "h\na b c d e"
    df = fp.fingerprints(frame(spark, [(0, whole), (1, part), (2, rest)])).groupBy().pivot("doc_id", [0, 1, 2]).agg(F.first("fingerprint"))
    row = df.select("*", fp.deleted(F.col("0"), F.col("1")).alias("less"), fp.inserted(F.col("2"), F.col("1")).alias("more"),
                    fp.likeness(F.col("0"), F.col("2")).alias("near"), fp.likeness(F.col("0"), F.col("0")).alias("same")).first()
    assert row.less == row["2"] and row.more == row["0"] and row.same == 1.0
    assert row.near == pytest.approx(near(lanes(whole), lanes(rest)))


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "p q"), (None, "p q"), (None, "r"), (5, "s t"), (5, "s t"), (5, "u v w x y"), (9, "z")]
    got = fp.edited_fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 3
    once = fp.edited_fingerprints(frame(spark, list(dict.fromkeys(rows)))).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in once}


def test_one_row_no_rows_and_clashing_columns(spark):
    one = fp.edited_fingerprints(frame(spark, [(4, "a b\nc")])).collect()
    assert [tuple(r) for r in one] == brute([(4, "a b\nc")])
    assert fp.edited_fingerprints(frame(spark, [])).count() == 0
    clash = frame(spark, hard_rows()).withColumns({n: F.lit(1) for n in ("a", "t", "rank", "fingerprint", "copies", "_p", "own", "n_chars", "_r")})
    assert sorted(map(tuple, fp.edited_fingerprints(clash).collect())) == brute(hard_rows())


def test_likeness_follows_what_is_shared(spark, sf):
    got = fp.edited_fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).where("n_chars > 300").toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.98 and 0.4 < got.near_edited.mean() < 0.6 and got.near_next.mean() < 0.1
