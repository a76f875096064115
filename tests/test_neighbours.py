"""Nearest rows, what is built on them, and outlier scores, by brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import nearest, outliers
from tabwright.operators.nearest import nearest_rows, outlier_factors, propagate


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")


def brute(x, k):
    w = np.floor(np.asarray(x) * nearest.UNIT).astype(np.int64)
    d2 = ((w[:, None, :] - w[None, :, :]) ** 2).sum(axis=2)
    return {(i, int(j), int(d2[i, j])) for i in range(len(w)) for j in sorted((j for j in range(len(w)) if j != i), key=lambda j: (d2[i, j], j))[:k]}


def test_one_block_is_exact_with_ties_by_id(spark):
    x = np.random.default_rng(0).integers(0, 4, (80, 3)) / 2
    got = nearest_rows(frame(spark, x), "id", "v", 3, k=7)
    assert {(r.id, r.other, r.d2) for r in got.collect()} == brute(x, 7) and got.groupBy("id").agg(F.max("rank")).distinct().count() == 80


def test_most_neighbours_are_found_across_blocks_and_copies_stay_bounded(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(900, 4)) + 8 * rng.integers(0, 3, (900, 1)), np.ones((400, 4))])
    got = {(r.id, r.other, r.d2) for r in nearest_rows(frame(spark, x).repartition(5), "id", "v", 4, k=5, block=128).collect()}
    want = brute(x[:900], 5)
    near = {}
    for i, _, d in want:
        near[i] = max(near.get(i, 0), d)
    assert len(got) == 5 * 1_300 and sum(d <= near[i] for i, _, d in got if i < 900) > 0.75 * 900 * 5
    assert all(d == 0 for i, _, d in got if i >= 900)


def test_rows_that_take_no_part_and_tiny_tables(spark):
    bad = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [0.0, 0.0])], "id long, v array<double>")
    assert nearest_rows(bad, "id", "v", 2).count() == 0 and nearest_rows(bad.limit(0), "id", "v", 2).count() == 0
    two = nearest_rows(bad.unionByName(frame(spark, [[3.0, 4.0]], 6)), "id", "v", 2).collect()
    assert {(r.id, r.other, r.d2) for r in two} == {(5, 6, 25 * nearest.UNIT**2), (6, 5, 25 * nearest.UNIT**2)}


def test_outlier_factor_as_defined_and_planted_ones_on_top(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(120, 2)), [[9, 9], [-12, 3]], np.zeros((12, 2)) + 4])
    edges = nearest_rows(frame(spark, x), "id", "v", 2, k=5)
    found = {r.id: r for r in outlier_factors(edges).collect()}
    near = {}
    for r in edges.collect():
        near.setdefault(r.id, []).append((r.other, math.sqrt(r.d2)))
    last = {i: max(d for _, d in n) for i, n in near.items()}
    density = {i: 1 / max(np.mean([max(last[j], d) for j, d in n]), 1e-9) for i, n in near.items()}
    for i, n in near.items():
        assert found[i].lof == pytest.approx(np.mean([density[j] for j, _ in n]) / density[i])
    copies = range(122, 134)
    assert all(found[i].lof == pytest.approx(1) for i in copies)
    assert {120, 121} == set(sorted(set(found) - set(copies), key=lambda i: -found[i].lof)[:2])


def test_labels_spread_in_rounds_and_stop(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(60, 2)) + 30])
    edges = nearest_rows(frame(spark, x), "id", "v", 2, k=6)
    seeds = spark.createDataFrame([(i, "a" if i == 0 else "b" if i == 60 else None) for i in range(121)], "id long, label string")
    got = {r.id: r for r in propagate(edges, seeds, "id", "label", 6).collect()}
    assert all(got[i].label == ("a" if i < 60 else "b") for i in range(120)) and got[120].label is None
    assert {i for i, r in got.items() if r.given} == {0, 60}
    assert max(r["round"] for r in got.values()) < 30 and got[0]["round"] == 0


def test_ties_take_the_smaller_label(spark):
    edges = spark.createDataFrame([(0, 1, 4, 1), (0, 2, 4, 1)], "id long, other long, d2 long, rank int")
    seeds = spark.createDataFrame([(0, None), (1, "y"), (2, "x")], "id long, label string")
    assert {r.id: r.label for r in propagate(edges, seeds, "id", "label", 1).collect()} == {0: "x", 1: "y", 2: "x"}


def test_depths_and_scores_row_by_row(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))] + [(9_000, 25.0, -30.0), (9_001, None, 40.0)], "id long, a double, b double")
    model = outliers.fit_isolation_forest(df, ["a", "b"], ["id"], trees=60)
    again = outliers.fit_isolation_forest(df.repartition(9), ["a", "b"], ["id"], trees=60)
    assert (model.cut == again.cut).all() and (model.feature == again.feature).all() and model.sample <= outliers.SAMPLE
    got = {r.id: (r.a, r.b, r.outlier_score) for r in model.transform(df).collect()}

    def depth(x):
        total = 0.0
        for root in model.roots:
            n = root
            while model.feature[n] >= 0:
                n = model.left[n] if x[model.feature[n]] <= model.cut[n] else model.right[n]
            total += model.cut[n]
        return total / len(model.roots)

    usual = 2 * (math.log(model.sample - 1) + np.euler_gamma) - 2 * (model.sample - 1) / model.sample
    for i in list(range(0, 600, 37)) + [9_000, 9_001]:
        a, b, score = got[i]
        assert score == pytest.approx(2 ** (-depth((a or 0.0, b or 0.0)) / usual))
    assert {i for i, _ in sorted(got.items(), key=lambda e: -e[1][2])[:2]} == {9_000, 9_001}


def test_forests_of_few_and_equal_rows(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(10)], "id long, a double")
    assert {round(r.outlier_score, 9) for r in outliers.fit_isolation_forest(df, ["a"], ["id"]).transform(df).collect()} == {0.5}
    none = df.limit(0)
    assert outliers.fit_isolation_forest(none, ["a"], ["id"]).transform(df).select("outlier_score").distinct().count() == 1


def clusters_by_brute_force(x, eps, least):
    """{point: (core, cluster)} by comparing all rows."""
    points = sorted(set(map(tuple, x)))
    rows = np.array([tuple(r) for r in x])
    p = np.array(points)
    near = ((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = np.array([(((rows - q) ** 2).sum(axis=1) <= eps * eps).sum() >= least for q in p])
    label, found = {}, 0
    for i in range(len(p)):
        if core[i] and i not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in label:
                    label[j] = found
                    todo += [k for k in np.flatnonzero(near[j] & core) if k not in label]
            found += 1
    out = {}
    for i, q in enumerate(points):
        around = [label[k] for k in np.flatnonzero(near[i] & core)]
        out[q] = (bool(core[i]), label[i] if core[i] else min(around, default=-1))
    return out


@pytest.mark.parametrize("dims, eps, least", [(1, 0.5, 3), (2, 0.6, 4), (2, 2.0, 10), (3, 1.0, 4)])
def test_density_clusters_by_brute_force(spark, dims, eps, least):
    from tabwright.operators.density import density_clusters
    rng = np.random.default_rng(dims * 10 + least)
    x = np.concatenate([rng.normal(size=(150, dims)), rng.normal(size=(100, dims)) / 3 + 6, rng.uniform(-8, 8, (60, dims)), np.zeros((40, dims)) - 7, rng.integers(-3, 3, (50, dims)) * eps])
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in x] + [(None,) * dims], ", ".join(f"{n} double" for n in names))
    got = {tuple(r[f"x{i}"] for i in range(dims)): (r.core, r.cluster) for r in density_clusters(df, names, eps, least).collect()}
    assert got == clusters_by_brute_force(x, eps, least)


def test_dense_cells_meet_without_pairs_and_clashing_names(spark):
    from tabwright.operators.density import append_density_cluster
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.uniform(0, 1, (3_000, 2)), rng.uniform(0, 1, (3_000, 2)) + [1.3, 0], rng.uniform(0, 1, (2_000, 2)) + [9, 9]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(9_000, None, 1.0)], "cluster long, x0 double, c0 double")
    got = append_density_cluster(df, ["x0", "c0"], 1.0, 5, "found")
    assert got.columns == ["cluster", "x0", "c0", "found"] and got.groupBy("found").count().count() == 3
    assert {r.found for r in got.where("cluster < 6000").collect()} == {0} and got.where("cluster = 9000").first().found is None
    assert append_density_cluster(df.limit(0), ["x0", "c0"], 1.0, 5).count() == 0
