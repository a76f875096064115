"""Outlier scores: an isolation forest grown from a bounded sample, scored over all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_double
from .models import SEED
from .splits import key_hash

TREES, SAMPLE = 100, 256


def usual_depth(n):
    """Mean depth at which a search of n values in a random binary tree fails, by which depths are judged."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, np.ndarray]:
    """One tree as flat arrays: at a node a random feature that varies and a random cut below its maximum.

    A leaf has feature -1, and in ``cut`` the depth of its rows: its own, plus what its rows would need to be told apart.
    """
    feature, cut, left, right = [], [], [], []

    def add() -> int:
        feature.append(-1), cut.append(0.0), left.append(0), right.append(0)
        return len(feature) - 1

    todo = [(add(), np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or not len(varied):
            cut[node] = depth + float(usual_depth(len(rows)))
            continue
        f = int(rng.choice(varied))
        at = min(low[f] + rng.random() * (high[f] - low[f]), np.nextafter(high[f], -np.inf))
        small = x[rows, f] <= at
        feature[node], cut[node], left[node], right[node] = f, at, add(), add()
        todo += [(left[node], rows[small], depth + 1), (right[node], rows[~small], depth + 1)]
    return {"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left), "right": np.array(right)}


@dataclass
class IsolationForest:
    """Nodes of all trees side by side; ``roots`` are where trees begin. At most 2 x trees x sample nodes."""

    features: list[str]
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    sample: int

    def depths(self, x: np.ndarray) -> np.ndarray:
        """Mean depth per row, all trees of a row going down side by side."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return self.cut[node].mean(axis=1) if len(self.roots) else np.zeros(len(x))
            down = np.where(x[rows, np.maximum(f, 0)] <= self.cut[node], self.left[node], self.right[node])
            node = np.where(inner, down, node)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2^(-depth / usual depth): near 1 for rows that few cuts isolate, about 0.5 if all rows are alike."""
        usual = float(usual_depth(self.sample))
        return 2.0 ** (-self.depths(x) / usual) if usual > 0 else np.full(len(x), 0.5)

    def transform(self, df: DataFrame, name: str = "outlier_score") -> DataFrame:
        """``df`` with the score of every row; a missing feature counts as 0. The arrays are sent once to each executor."""
        shared, names = df.sparkSession.sparkContext.broadcast(self), self.features

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            model = shared.value
            for columns in batches:
                columns = columns if isinstance(columns, tuple) else (columns,)  # one column comes alone
                x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
                yield pd.Series(np.concatenate([model.scores(x[i:i + 1_000]) for i in range(0, len(x), 1_000)]) if len(x) else [], dtype=float)

        filled = [F.coalesce(clean_double(f), F.lit(0.0)) for f in names]
        return df.withColumn(name, score(*filled))


def fit_isolation_forest(df: DataFrame, features: Sequence[str], keys: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> IsolationForest:
    """Trees on ``sample`` rows each, drawn tree by tree from the trees x sample rows with the smallest hashes of their keys.

    The same rows on any partitioning; equal hashes are ordered by the features. The sample is bounded by the parameters
    and grown where it is collected, each tree down to log2(sample) levels. A smaller table gives smaller samples.
    """
    names = list(features)
    rows = df.select(key_hash(keys, seed).alias("_h"), *[F.coalesce(clean_double(f), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(names)])
    order = ["_h", *[f"x{i}" for i in range(len(names))]]
    chosen = rows.orderBy(*order).limit(trees * sample).collect()  # the sample's size, a parameter
    matrix = np.array([[r[f"x{i}"] for i in range(len(names))] for r in chosen], float).reshape(len(chosen), len(names))
    size = min(sample, len(matrix))
    grown = []
    for t in range(trees if size else 0):
        rng = np.random.default_rng([seed, t])
        own = matrix[rng.choice(len(matrix), size, replace=False)]
        grown.append(grow_tree(own, rng, int(np.ceil(np.log2(max(2, size))))))
    start = np.concatenate([[0], np.cumsum([len(g["feature"]) for g in grown])]).astype(int)
    join = lambda n, shift=False: np.concatenate([g[n] + (s if shift else 0) for g, s in zip(grown, start)]) if grown else np.zeros(0, int)
    return IsolationForest(names, start[:-1], join("feature"), join("cut"), join("left", True), join("right", True), size)
