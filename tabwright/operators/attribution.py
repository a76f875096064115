"""Path attribution for tree ensembles.

A row's raw score is the root value plus the change of node value along its path;
each change belongs to the feature that was split on. The parts add up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_double, col
from ..session import scratch_path
from .boosting import Boosted
from .models import fill_missing_features

#: nodes of the trees that are sent to the tasks together
NODES = 500_000


def node_arrays(model: PipelineModel, df: DataFrame, limit: int = NODES) -> Iterator[dict]:
    """Node tables of the fitted trees as flat arrays, read from the saved form of the model.

    Each holds trees of about ``limit`` nodes together, one tree at least, so a model of any size is sent piece by piece.
    """
    trees = model.stages[-1]
    spark = df.sparkSession
    path = scratch_path(spark, "trees")
    trees.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold")
    first, held = 0, 0
    sizes = [t.numNodes for t in trees.trees]
    for i, size in enumerate(sizes):
        held += size
        if held >= limit or i == len(sizes) - 1:
            nodes = saved.filter(F.col("treeID").between(first, i)).orderBy("treeID", "id").toPandas()
            yield _arrays(trees, nodes, first, i + 1)
            first, held = i + 1, 0


def _arrays(trees, nodes: pd.DataFrame, first: int, end: int) -> dict:
    """Arrays of the trees from ``first`` to before ``end``."""
    if nodes.empty:
        raise ValueError("the saved model holds no nodes")
    start = nodes.groupby("treeID").cumcount().rsub(np.arange(len(nodes)))  # first row of the node's tree
    start = start.abs().to_numpy()
    left, right = nodes["leftChild"].to_numpy(), nodes["rightChild"].to_numpy()
    leaf = left < 0
    if hasattr(trees, "treeWeights"):
        per_tree = np.asarray(trees.treeWeights, dtype=float)
    else:
        per_tree = np.ones(len(trees.trees))
    forest_classes = "RandomForestClassification" in type(trees).__name__
    if forest_classes:  # each tree votes with its class share
        stats = np.vstack(nodes["impurityStats"].to_numpy())
        value = stats[:, 1] / np.maximum(stats.sum(axis=1), 1e-12)
        per_tree = np.full(len(per_tree), 1.0 / len(per_tree))
    else:
        value = nodes["prediction"].to_numpy(dtype=float)
        if "RandomForest" in type(trees).__name__:
            per_tree = np.full(len(per_tree), 1.0 / len(per_tree))
    cut = np.array([v[0] if len(v) else np.nan for v in nodes["leftCategoriesOrThreshold"]], dtype=float)
    return {
        "roots": np.flatnonzero(nodes["id"].to_numpy() == 0), "weights": per_tree[first:end], "value": value, "leaf": leaf,
        "left": np.where(leaf, 0, left + start), "right": np.where(leaf, 0, right + start),
        "feature": nodes["featureIndex"].to_numpy(), "cut": cut,
    }


def contributions(x: np.ndarray, t: dict) -> tuple[np.ndarray, float]:
    """Per-row, per-feature contributions and the common base value."""
    out = np.zeros_like(x, dtype=float)
    base = 0.0
    rows = np.arange(len(x))
    for root, weight in zip(t["roots"], t["weights"]):
        base += weight * t["value"][root]
        at = np.full(len(x), root)
        while True:
            live = ~t["leaf"][at]
            if not live.any():
                break
            node, who = at[live], rows[live]
            feature = t["feature"][node]
            step = np.where(x[who, feature] <= t["cut"][node], t["left"][node], t["right"][node])
            out[who, feature] += weight * (t["value"][step] - t["value"][node])
            at[live] = step
    return out, base


def tree_attribution(model: PipelineModel, df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows (keys, base, contributions) with one contribution per feature, in feature order."""
    names = list(features)
    rows = fill_missing_features(df, names).select(*[col(k) for k in keys], *names)
    made = []
    for arrays in node_arrays(model, df):
        explain = _explainer(df.sparkSession.sparkContext.broadcast(arrays))
        rows = rows.withColumn(f"_e{len(made)}", explain(*[col(f) for f in names]))
        made.append(F.col(f"_e{len(made)}"))
    base = reduce(lambda a, b: a + b, [e["base"] for e in made])
    parts = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [e["contributions"] for e in made])
    return rows.select(*[col(k) for k in keys], base.alias("base"), parts.alias("contributions"))


def boosted_attribution(model: Boosted, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, base, contributions) of a model for two classes or values, whose trees are at hand already."""
    if len(model.base) > 1:
        raise ValueError("one score per row only")
    leaf = model.trees["feature"] < 0
    arrays = {"roots": model.roots, "weights": np.ones(len(model.roots)), "leaf": leaf, "cut": model.trees["bin"],
              **{k: model.trees[k] for k in ("value", "left", "right", "feature")}}
    explain = _explainer(df.sparkSession.sparkContext.broadcast(arrays))
    x = [F.coalesce(clean_double(f), F.lit(0.0)) if f in df.columns else F.lit(0.0) for f in model.features]
    rows = df.select(*[col(k) for k in keys], explain(*x).alias("_e"))
    return rows.select(*[col(k) for k in keys], (F.col("_e.base") + F.lit(float(model.base[0]))).alias("base"), F.col("_e.contributions").alias("contributions"))


def _explainer(shared):
    @F.pandas_udf("base double, contributions array<double>")
    def explain(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        trees = shared.value
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)  # one column comes alone
            parts, base = contributions(np.column_stack([c.to_numpy(dtype=float) for c in columns]), trees)
            yield pd.DataFrame({"base": base, "contributions": list(parts)})
    return explain


def tree_attribution_global(model: PipelineModel, df: DataFrame, features: Sequence[str], k: int = 20) -> DataFrame:
    """Rows (feature, mean_abs_contribution) of the k strongest features."""
    parts = tree_attribution(model, df, features, [])
    one = parts.agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(f"a{i}") for i in range(len(features))])
    from .aggregates import to_rows
    rows = to_rows(one, [{"feature": F.lit(f), "mean_abs_contribution": F.col(f"a{i}")} for i, f in enumerate(features)])
    return rows.orderBy(F.desc("mean_abs_contribution"), "feature").limit(k)
