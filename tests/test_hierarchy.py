"""The split tree against two-means on rows in memory, and what must hold of every cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import hierarchy


@pytest.fixture(scope="module")
def points():
    rng = np.random.RandomState(1)
    centres = np.array([[0, 0, 0], [0, 9, 0], [40, 0, 5], [40, 12, 5], [40, 12, 30]], float)
    return np.vstack([c + rng.normal(size=(40, 3)) for c in centres] + [np.repeat([[0.0, 0.0, 0.0]], 30, axis=0)])


@pytest.fixture(scope="module")
def rows(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, a double, b double, c double").repartition(5)


def cost(x):
    return float(((x - x.mean(axis=0)) ** 2).sum())


def two_means(x):
    f = int(np.argmax(x.var(axis=0)))
    left = x[:, f] <= x[:, f].mean()
    for _ in range(hierarchy.PASSES):
        low, high = x[left].mean(axis=0), x[~left].mean(axis=0)
        left = ((x - low) ** 2).sum(axis=1) <= ((x - high) ** 2).sum(axis=1)
    return left


def test_splits_are_two_means_of_the_rows_of_each_node(rows, points):
    tree = hierarchy.fit_split_tree(rows, ["a", "b", "c"], levels=3)
    paths = {r["id"]: r["path"] for r in tree.transform(rows).collect()}
    path = np.array([paths[i] for i in range(len(points))])
    assert path.shape == (230, 4) and (path[:, 0] == 0).all()
    for node in range(len(tree.parent)):
        inside = np.flatnonzero((path == node).any(axis=1))
        assert tree.n[node] == len(inside) and tree.cost[node] == pytest.approx(cost(points[inside]), rel=1e-9, abs=1e-9)
        np.testing.assert_allclose(tree.mean[node], points[inside].mean(axis=0), atol=1e-9)
        if tree.left[node] >= 0:
            left = two_means(points[inside])
            np.testing.assert_array_equal(path[inside, tree.level[node] + 1] == tree.left[node], left)
    assert len({tuple(p) for p in path}) == sum(v < 0 for v in tree.left)


def test_cuts_are_nested_and_costs_fall(spark, rows, points):
    tree = hierarchy.fit_split_tree(rows, ["a", "b", "c"], levels=4)
    leaves = sum(v < 0 for v in tree.left)
    found = [np.array([r["cluster"] for r in tree.cut(rows, k).orderBy("id").collect()]) for k in range(1, leaves + 2)]
    costs = []
    for k, labels in enumerate(found, 1):
        assert len(set(labels)) == min(k, leaves)
        costs.append(sum(cost(points[labels == c]) for c in set(labels)))
        if k > 1:  # every cluster lies inside one of the cut before
            assert all(len(set(found[k - 2][labels == c])) == 1 for c in set(labels))
    assert all(b < a for a, b in zip(costs[:leaves], costs[1:leaves])) and costs[leaves] == costs[leaves - 1]
    # the planted groups are five, and what a cut takes off the cost is the height of its split
    truth = np.concatenate([np.repeat(range(5), 40), np.zeros(30, int)])
    assert len(set(zip(truth, found[4]))) == 5
    nodes = {r["split_rank"]: r for r in tree.nodes(spark).filter("split_rank is not null").collect()}
    assert sorted(nodes) == list(range(1, leaves))
    for k in range(1, leaves):
        assert costs[k - 1] - costs[k] == pytest.approx(nodes[k]["height"], rel=1e-6, abs=1e-6)
    by_level = [sum(r["cost"] for r in tree.nodes(spark).collect() if r["level"] == v or (r["level"] < v and r["height"] == 0)) for v in range(5)]
    assert all(b <= a for a, b in zip(by_level, by_level[1:]))


def test_empty_alike_missing(spark, rows):
    empty = hierarchy.fit_split_tree(rows.limit(0), ["a", "b"])
    assert empty.n == [0] and empty.left == [-1] and empty.cut(rows, 3).select("cluster").distinct().count() == 1
    alike = hierarchy.fit_split_tree(rows.select(F.lit(1e9).alias("a"), F.lit(0.1).alias("b")), ["a", "b"])
    assert alike.n == [230] and alike.nodes(spark).count() == 1
    gaps = spark.createDataFrame([(None,), (float("nan"),), (5.0,), (5.0,)], "a double")
    tree = hierarchy.fit_split_tree(gaps, ["a", "absent"])
    assert sorted(tree.n) == [2, 2, 4] and tree.cut(gaps, 9).groupBy("cluster").count().count() == 2
