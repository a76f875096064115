"""Forests grown from cells, against Spark's own fit."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tabwright.operators import forest, models


def rows(spark, n=600, classes=2):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 60, n), rng.integers(0, 9, n), rng.normal(size=n).round(2)])
    y = (x[:, 0] > 25).astype(float) * (x[:, 1] > 3) + rng.random(n) / 2
    label = np.floor(y * classes / 1.51) if classes else 10 + y
    data = [(Vectors.dense(a), float(b), 2.0 if b == 1.0 else 1.0) for a, b in zip(x.tolist(), label)]
    return spark.createDataFrame(data, ["features", "label", "weight"]).repartition(3)


def tree_nodes(model, tmp_path, spark, name):
    model.write().overwrite().save(f"{tmp_path}/{name}")
    found = spark.read.parquet(f"{tmp_path}/{name}/data").select("treeID", "nodeData.*").toPandas()
    return found.sort_values(["treeID", "id"]).reset_index(drop=True)


def shape(nodes):
    """Depth-first (feature, threshold, prediction, raw count) of one tree, whatever its numbering."""
    at = {r.id: r for r in nodes.itertuples()}

    def walk(i):
        r = at[i]
        here = (r.split["featureIndex"], [round(v, 9) for v in r.split["leftCategoriesOrThreshold"]], round(r.prediction, 6), r.rawCount)
        return [here] if r.leftChild < 0 else [here, *walk(r.leftChild), *walk(r.rightChild)]
    return walk(0)


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_trees_without_bootstrap_are_sparks(spark, tmp_path, classes):
    df = rows(spark, classes=classes).persist()
    kind = RandomForestClassifier if classes else RandomForestRegressor
    est = kind(numTrees=2, maxDepth=5, minInstancesPerNode=4, seed=7, bootstrap=False, featureSubsetStrategy="all", **({"weightCol": "weight"} if classes else {}))
    ours, sparks = forest.fit_forest(est, forest.collapse(df, bool(classes)), df), est.fit(df)
    a, b = tree_nodes(ours, tmp_path, spark, "a"), tree_nodes(sparks, tmp_path, spark, "b")
    assert all(shape(a[a["treeID"] == t]) == shape(b[b["treeID"] == t]) for t in (0, 1))
    assert np.allclose(ours.featureImportances.toArray(), sparks.featureImportances.toArray(), atol=1e-9)
    score = "probability" if classes else "prediction"
    both = ours.transform(df).select("features", F.col(score).alias("a")).join(sparks.transform(df).select("features", F.col(score).alias("b")), "features")
    assert both.count() >= df.count() and all(np.allclose(list(np.atleast_1d(r.a)), list(np.atleast_1d(r.b))) for r in both.collect())
    df.unpersist()


def test_class_trees_do_not_depend_on_partitions(spark, tmp_path):
    df = rows(spark)
    est = RandomForestClassifier(numTrees=12, maxDepth=4, seed=5, weightCol="weight")
    a, b = [tree_nodes(forest.fit_forest(est, forest.collapse(d, True), d), tmp_path, spark, n) for n, d in (("a", df), ("b", df.coalesce(1)))]
    assert a["treeID"].nunique() == 12 and a.drop(columns=["split", "impurityStats"]).equals(b.drop(columns=["split", "impurityStats"]))
    assert a[a["id"] == 0]["rawCount"].nunique() > 6  # every tree draws for itself


def test_forest_is_near_sparks_and_blocks_of_trees(spark, tmp_path, monkeypatch):
    df = rows(spark, 2000, 0).persist()
    est = RandomForestRegressor(numTrees=60, maxDepth=6, seed=5)
    monkeypatch.setattr(forest, "HELD", 20_000)  # a few trees and nodes at once
    ours, sparks = forest.fit_forest(est, forest.collapse(df, False), df), est.fit(df)
    assert ours.getNumTrees == 60 and np.allclose(ours.featureImportances.toArray(), sparks.featureImportances.toArray(), atol=0.05)
    both = ours.transform(df).withColumnRenamed("prediction", "a").join(sparks.transform(df).select("features", F.col("prediction").alias("b")), "features")
    assert both.agg(F.corr("a", "b")).first()[0] > 0.99
    drawn = tree_nodes(ours, tmp_path, spark, "a").query("id == 0")["rawCount"]
    assert abs(drawn.mean() - 2000) < 40 and 25 < drawn.std() < 70
    df.unpersist()


def test_many_cells_are_left_to_spark(spark, monkeypatch):
    df = rows(spark)
    monkeypatch.setattr(forest, "MOST_CELLS", 10)
    found = forest.collapse(df, True)
    assert not len(found.codes)
    est = RandomForestClassifier(numTrees=3, maxDepth=3, seed=5, weightCol="weight")
    assert forest.fit_forest(est, found, df).getNumTrees == 3


def test_poisson_numbers():
    k = forest.poisson_one(np.random.default_rng(1), 400_000)
    assert abs(k.mean() - 1) < 0.01 and abs(k.var() - 1) < 0.02 and abs((k == 0).mean() - np.exp(-1)) < 0.005 and k.max() < 20


def test_runs_share_cells(spark, monkeypatch):
    made = []
    real = forest.collapse
    monkeypatch.setattr(models, "collapse", lambda *a: made.append(1) or real(*a))
    df = rows(spark).select(F.col("weight").alias("a"), (F.col("weight") * F.rand(1)).alias("b"), F.col("label").cast("int").alias("y"))
    found = models.importance_runs(df, ["a", "b"], "y", runs=3, trees=8, depth=3)
    assert found.count() == 6 and len(made) == 1 and found.groupBy("run").agg(F.sum("importance").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0


def test_trials_share_cells(spark, monkeypatch):
    made = []
    real = forest.collapse
    monkeypatch.setattr(models, "collapse", lambda *a: made.append(1) or real(*a))
    df = rows(spark).select(F.rand(1).alias("a"), (F.col("label") + F.rand(2)).alias("b"), F.col("label").cast("int").alias("y"))
    df = df.withColumn("split", F.when(F.col("a") < 0.7, "train").otherwise("val")).persist()
    space = {"n_estimators": models.Range(3, 9, "int"), "max_depth": models.Range(2, 6, "int"), "minInstancesPerNode": models.Range(2, 9, "int")}
    best, params, trials = models.random_search(df, "random_forest", ["a", "b"], "y", trials=3, space=space)
    assert trials.count() == 3 and len(made) == 1
    assert best.stages[-1].getNumTrees == params["n_estimators"] and trials.agg(F.max("value")).first()[0] > 0.9
    df.unpersist()
