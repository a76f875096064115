import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import whitening
from tabwright.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=4):
    """{vec_id: (deviation, whitened)}, explained and n by plain double arithmetic."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in kept}), float)
    n, total = len(x), [int(s) for s in x.sum(axis=0)]
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(v, total)), (np.array(v) - x.mean(axis=0)) @ axes / np.sqrt(values)) for i, v in kept]
    return out, values / np.trace(centred.T @ centred / n), n


def agrees(got, rows):
    want, explained, n = brute(rows)
    by_key = {}
    for r in got:
        by_key.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == 4 * len(want) and {i for i, _, _ in want} == set(by_key)
    sign = np.array([np.sign(by_key[want[0][0]][c + 1].whitened * want[0][2][c]) for c in range(4)])
    for i, deviation, w in want:
        mine = [by_key[i][c + 1] for c in range(4)]
        assert [r.deviation for r in mine] == [deviation] * 4 and {r.n for r in mine} == {n}
        assert np.allclose(np.array([r.whitened for r in mine]) * sign, w, atol=1e-8)
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-9) and all(r.identity_error < 1e-8 for r in mine)


def test_query_by_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    agrees(QUERIES["op12_whitening"](spark, sf).collect(), rows)


def test_copies_count_once_and_bad_rows_go(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in np.float32(rng.normal(size=6) * [9, 5, 3, 2, 1, 1] + 400)]) for i in range(300)]
    rows += [(1_000 + i, rows[0][1]) for i in range(150)]
    bad = [(2_000, None), (2_001, []), (2_002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2_003, [float("nan")] * 6), (2_004, [float("inf")] * 6), (2_005, [1.0] * 5)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(7)
    clash = df.withColumns({"x": F.lit(1), "component": F.lit("a"), "n": F.lit(2), "i": F.lit(0)})
    agrees(whitening.whiten(clash).collect(), rows)


def test_null_and_repeated_ids_each_get_their_own(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i < 5 else 7, [float(c) for c in rng.normal(size=5)]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 160 and got.where("vec_id is null").count() == 20


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25])] * 9])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_axes_than_asked_for(spark):
    rows = [(i, [float(i), 2.0 * i, -1.0 * i]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and len(got) == 20 and got[0].explained == pytest.approx(1.0)


def test_sums_of_extreme_entries_are_exact():
    x = np.array([[2**50, -3], [-(2**50), 5], [2**49 + 1, 1]])
    assert (whitening.exact_product(x) == np.array([[2 * 2**100 + (2**49 + 1) ** 2, -8 * 2**50 + 2**49 + 1], [-8 * 2**50 + 2**49 + 1, 35]], object)).all()


def test_deviation_beyond_a_long_is_null():
    model = whitening.Whitening(10**9, [10**9] * 4, np.ones(4), np.eye(4), 4.0)
    assert model.deviations(np.array([[1, 1, 1, 2], [50, 1, 1, 1]])) == [10**18, None]


@pytest.mark.parametrize("values", [np.linspace(1, 9, 24), [5, 5 + 1e-9, 5 + 2e-9, 5 + 1e-12] + list(np.linspace(1, 2, 20)), [5.0] * 4 + [1.0] * 20, np.logspace(0, -14, 24), [0.0] * 20 + [1.0] * 4])
def test_eigenvectors_of_clustered_values(values):
    q = np.linalg.qr(np.random.default_rng(7).normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    a = q @ np.diag(np.array(values, np.longdouble)) @ q.T
    a = (a + a.T) / 2
    value, x = whitening.eigen(a)
    assert np.abs(a @ x - x * value).max() < 1e-15 and np.abs(x.T @ x - np.eye(len(a))).max() < 1e-17
    assert np.allclose(value.astype(float), np.sort(values)[::-1], atol=1e-14)


def test_corrections_reach_more_than_single_precision():
    m = np.random.default_rng(8).normal(size=(200, 16))
    a = (m.T @ m).astype(np.longdouble)
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    better, _, first = whitening.refine(a / np.abs(a).max(), rough)
    _, _, second = whitening.refine(a / np.abs(a).max(), better)
    assert 1e-12 < first < 1e-4 and second < 100 * first**2 + 1e-17
