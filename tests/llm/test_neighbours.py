import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm.neighbours import Cells, chi_square, chi_square_quantile, nearest, search


def brute(rows, every, k):
    """query -> [(id, score)], nearest first, by plain loops over the usable vectors."""
    use = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in use:
        if q % every == 0:
            out[q] = sorted(((-float(np.dot(use[q], use[i])), i) for i in use if i != q))[:k]
    return out


def recall(got, want):
    hits = [len({r.vec_id for r in got if r.query_id == q} & {i for _, i in w}) / max(1, len(w)) for q, w in want.items()]
    return np.mean(hits)


def test_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = brute(rows, 20, 20), nearest(df, part=100).collect()
    assert recall(got, want) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows}
    by_query = {}
    for r in got:
        assert r.vec_id != r.query_id and r.query_id % 20 == 0 and abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-12
        by_query.setdefault(r.query_id, []).append(r)
    assert by_query.keys() == want.keys()
    for found in by_query.values():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and found == sorted(found, key=lambda r: (-r.score, r.vec_id))


def test_recall_on_clusters_with_fewer_leaves_visited():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 8_000)] + 0.15 * rng.normal(size=(8_000, 32))
    ids = np.arange(8_000)
    found, best = search(ids, x, ids[::100], x[::100])
    scores = x[::100] @ x.T
    scores[np.arange(80), ids[::100]] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(set(f) & set(w)) / 20 for f, w in zip(found, want)]) >= 0.9


@pytest.mark.parametrize("skewed", [False, True])
def test_recall_on_clusters_and_skewed_norms(spark, skewed):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 128))
    x = centres[rng.integers(0, 30, 4_000)] + 0.1 * rng.normal(size=(4_000, 128))
    if skewed:
        x *= rng.lognormal(0.0, 1.0, size=(4_000, 1))
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = nearest(df, every=50, block=7).collect(), brute(rows, 50, 20)
    assert recall(got, want) >= 0.95
    # a block of queries, a part of a cell: the same rows whatever their sizes
    again = nearest(df, every=50, part=200, cells=4, confidence=0.999).collect()
    assert recall(again, want) >= 0.99


def test_cells_hold_every_point_and_halve():
    points = np.vstack([np.random.default_rng(0).normal(size=(1_000, 3)), np.zeros((500, 3))])
    cells = Cells(points, 16)
    of = cells.assign(points)
    assert len(set(of)) == 16 and len(set(of[1_000:])) == 1
    assert set(Cells(points[1_000:], 16).assign(points)) == {0}


def test_ties_go_to_smaller_ids_and_copies_are_found(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [float(i % 7), 1.0, 0.0]) for i in range(100)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), part=64, leaf=16).where("query_id in (0, 200)").orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21)) + list(range(20))


@pytest.mark.parametrize("part", [3, 1000])
def test_unusable_vectors_few_candidates_and_clashing_columns(spark, part):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (None, [5.0, 5.0]), (3, [2.0, 1.0]), (4, [-1.0, 0.5]),
            (100, [None, 1.0]), (5, [1.0, 2.0, 3.0]), (6, []), (3, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("score", F.lit(1))
    got = [tuple(r) for r in nearest(df, part=part).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 2.0), (0, 2, 4, -1.0)]
    assert nearest(df.limit(0)).count() == 0


def test_chi_square():
    x = np.random.default_rng(0).chisquare(8, 200_000)
    for p in (0.5, 0.9, 0.95):
        assert abs(np.mean(x <= chi_square_quantile(p, 8)) - p) < 0.005
    assert abs(chi_square(2.0, 2) - (1 - np.exp(-1))) < 1e-12
