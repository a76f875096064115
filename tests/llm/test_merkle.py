import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import merkle
from tests.compare import difference

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = list(row)
    if values[3] is not None:
        values[3] += more
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, i):
    """Siblings and the rule to climb, from the definition."""
    out = []
    for level in tree[:-1]:
        run = level[i - i % 2:i - i % 2 + 2]
        out.append((i % 2, [d for k, d in enumerate(run) if k != i % 2]))
        i //= 2
    return out


def climb(d, steps):
    for place, others in steps:
        run = list(others)
        run.insert(place, d)
        d = digest(*run)
    return d


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(levels([leaf(r) for r in groups[g]]))
    top = levels([t[-1][0] for t in trees])
    root, out = (top[-1][0] if names else None), []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            steps = way(trees[k], i) + way(top, k)
            folded = climb(leaf(r, int(hit)), steps)
            out.append((r[0], leaf(r), trees[k][-1][0], root, digest(*[d for _, ds in steps for d in ds]), folded, folded == root))
    return out


def table(n, seed=0):
    rng = random.Random(seed)
    langs = [None, "", "de", "en", "Z", "é", "zz"]
    rows = [(i * 3 + 1, f"s{i % 4}", "en" if i % 3 else rng.choice(langs), rng.choice([None, 5, 99, 10**6]), rng.choice([None, "", "tëxt", "x" * 5_000])) for i in range(n)]
    return rows


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("n, bits", [(0, 12), (1, 2), (37, 1), (300, 3), (300, 12)])
def test_as_brute_force(spark, n, bits):
    got = merkle.manifest(spark.createDataFrame(table(n), SCHEMA).repartition(3), bits=bits)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert result(got) == sorted(brute(table(n)), key=repr)


def test_repeated_rows_null_keys_and_clashing_columns(spark):
    rows = table(20) + [(None, "s", "en", 4, "q")] * 3 + [(None, None, None, None, None)] * 2 + [(4, "s", "en", 1, "a"), (4, "s", "en", 1, "b")] + [table(20)[1]] * 40
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "tree", "index", "leaf", "salt", "_r", "grp", "root", "digest", "block")})
    assert result(merkle.manifest(df, bits=2)) == sorted(brute(rows), key=repr)


def test_tampering_shows_and_only_there(spark):
    rows = [(i, "s", "en", 7, f"t{i}") for i in range(200)]
    got = {r.doc_id: r.verified for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), bits=4).collect()}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 7 != 0) for i in got) and not all(got.values())


def test_sql_on_hard_rows(spark):
    import duckdb
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, lang varchar, n_chars bigint, text varchar)")
    rows = table(90, 3) + [(None, "s", "en", 4, "q"), (-5, None, "de", None, None)]
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    assert difference(merkle.manifest(spark.createDataFrame(rows, SCHEMA), bits=2), con, merkle.manifest_sql()) is None


@pytest.mark.parametrize("n", list(range(1, 35)) + [127, 128, 129, 1_000])
def test_positions_are_completion_order(n):
    order = []

    def finish(level, index):  # a node is written after all below it
        if level:
            for child in (2 * index, 2 * index + 1):
                if child << (level - 1) < n:
                    finish(level - 1, child)
        order.append((level, index))

    finish(merkle.height(n), 0)
    assert [int(merkle.position(n, level, index)) for level, index in order] == list(range(len(order)))
    for level in range(merkle.height(n) + 1):
        own = np.arange(-(-n >> level))
        assert list(merkle.position(n, level, own)) == [order.index((level, i)) for i in own]


def test_a_builders_stretch_has_no_gaps(spark):
    n = 45
    leaves = spark.range(n).select(F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("leaves"), F.col("id").alias("index"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    tiers = merkle.build_log(leaves, bits=3)
    own = tiers[0].groupBy("block").agg((F.max("position") - F.min("position") + 1).alias("span"), F.count("*").alias("n")).collect()
    assert len(tiers) == 2 and all(r.span == r.n for r in own)
    every = [r.position for t in tiers for r in t.collect()]
    assert sorted(every) == list(range(len(every)))
