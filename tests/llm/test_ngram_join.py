import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwright.llm.components import components
from tabwright.llm.ngram_join import drop_near_duplicates, forest, near_duplicates, permutations, shingles, signature, similar


def grams(text, n=5):
    w = (text or "").lower().split()
    return (" ".join(w), {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))


def brute(rows, n=5, threshold=0.8):
    """(class id, links) per row by all pairs."""
    own = [grams(t, n) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            (wi, a), (wj, b) = own[i], own[j]
            if wi == wj or (a and b and len(a & b) >= threshold * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((doc, least[root(i)], links[i]) for i, (doc, _) in enumerate(rows)), key=repr)


def result(df, **options):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(df, **options).collect()), key=repr)


def test_documents_as_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows)
    got = near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == want
    sizes = {}
    for r in got:
        sizes[r.class_id] = sizes.get(r.class_id, 0) + 1
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def near_copies(seed, copies, words=60, edits=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(5000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block,exact_block", [(1024, 512), (16, 8)])
def test_a_large_group_in_blocks(spark, block, exact_block):
    texts = near_copies(1, 90) + near_copies(2, 20, words=12, edits=1) + near_copies(3, 30, words=200, edits=9)
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df, block=block, exact_block=exact_block, recall=1.0) == brute(rows)


def test_prefixes_shorten_until_the_recall(spark, monkeypatch):
    from tabwright.llm import ngram_join
    depths, plain = [], ngram_join.likely_pairs
    monkeypatch.setattr(ngram_join, "likely_pairs", lambda reps, k, *a: depths.append(k) or plain(reps, k, *a))
    df = spark.createDataFrame(list(enumerate(near_copies(5, 40, edits=4))), "doc_id long, text string")
    result(df, recall=0.5)
    assert depths == [7]
    depths.clear()
    result(df, recall=1.0, trees=4)
    assert depths[:3] == [7, 6, 5]


def test_null_empty_short_long_repeated_and_clashing(spark):
    long = " ".join(f"a{i % 997}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \n"), (None, "one two"), (9, "One  two"), (10, "one two three"), (11, long), (12, long + " end"), (13, "x y z v w u"), (13, "x y z v w u"), (None, "q"), (None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("label", F.lit("l")).withColumn("rep", F.lit(0))
    assert result(df) == brute(rows)
    assert near_duplicates(df).where("kept").count() == 6
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0 for r in kept.collect())) == [0, 5, 9, 10, 11, 13]
    assert near_duplicates(df.limit(0)).count() == 0 and drop_near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 400)] + [(500, x) for x in range(501, 560)]
    rng.shuffle(edges)
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: label[x] for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=8), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_similar_as_sets(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    got = similar(arrays, arrays, 0.5)
    assert got.tolist() == [[len(a & b) >= 0.5 * len(a | b) for b in sets] for a in sets]


def test_signatures_estimate_similarity():
    rng = random.Random(0)
    f = permutations(2_000)
    a = " ".join(str(rng.random()) for _ in range(400))
    b = " ".join(a.split()[:300] + [str(rng.random()) for _ in range(100)])
    (_, x), (_, y) = shingles(a), shingles(b)
    truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    same = np.mean(np.frombuffer(signature(x, f), np.uint8) == np.frombuffer(signature(y, f), np.uint8))
    assert abs((same - 1 / 256) / (255 / 256) - truth) < 0.05


def test_forest_labels():
    assert forest(6, np.array([4, 3, 5]), np.array([3, 1, 0])).tolist() == [0, 1, 2, 1, 1, 0]


def test_null_ids_are_told_apart_by_row(spark):
    rows = [(None, t) for i in range(150) for t in [" ".join(f"w{i}x{k}" for k in range(60))] for t in (t, t + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_kept_id", F.lit(1))
    marked = near_duplicates(df)
    assert marked.count() == 300 and marked.where("kept").count() == 150 and marked.agg(F.max("n_links")).first()[0] == 1
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 150
    assert kept.select(F.substring_index("text", " ", 1)).distinct().count() == 150


def test_blocks_of_long_texts_hold_few(spark):
    from tabwright.llm import ngram_join
    base = [f"w{k}" for k in range(3_000)]
    rows = [(i, " ".join(base + [f"end{i}"])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = ngram_join.verified
    try:
        ngram_join.verified = lambda *a: plain(*a, cells=10_000)
        got = near_duplicates(df).collect()
    finally:
        ngram_join.verified = plain
    assert {(r.class_id, r.n_links, r.class_size) for r in got} == {(0, 29, 30)}


def test_nothing_that_grows_with_the_rows_is_broadcast(spark, monkeypatch):
    """Spark's own limit is far above these tables, so any side left to its guess would be broadcast."""
    from tabwright.llm import components as parts
    from tabwright.llm import ngram_join
    plans, plain = [], ngram_join.written

    def seen(df, *a):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *a)

    monkeypatch.setattr(ngram_join, "written", seen)
    monkeypatch.setattr(parts, "written", seen)
    monkeypatch.setattr(ngram_join, "SMALL", 0)
    monkeypatch.setattr(ngram_join, "KEPT", 0)
    rows = list(enumerate(near_copies(7, 20) + near_copies(8, 5)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = drop_near_duplicates(df)
    plans += [d._jdf.queryExecution().executedPlan().toString() for d in (kept, near_duplicates(df))]
    assert kept.count() == sum(doc == least for doc, least, _ in brute(rows))
    assert sum("Join" in p for p in plans) >= 6 and not any("Broadcast" in p for p in plans)
