"""Hierarchical clustering from the top: a tree of two-means splits, with heights, cut at any number of clusters."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_double

LEVELS, PASSES = 4, 20
SLICE = 2_000
#: a node whose spread is below this share of the root's is not split
FLAT = 1e-12


@dataclass
class SplitTree:
    """Nodes in the order they were made, level by level; a leaf has left -1.

    Rows with ``direction . x <= offset`` go left. ``cost`` is the sum of squared distances to the node's mean, and the
    height of a split what it takes off that cost. At most 2^(levels + 1) nodes.
    """

    features: list[str]
    levels: int
    parent: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    direction: list[np.ndarray] = field(default_factory=list)
    offset: list[float] = field(default_factory=list)
    n: list[int] = field(default_factory=list)
    cost: list[float] = field(default_factory=list)
    mean: list[np.ndarray] = field(default_factory=list)

    def add(self, parent: int, level: int) -> int:
        d = len(self.features)
        for part, start in ((self.parent, parent), (self.level, level), (self.left, -1), (self.right, -1), (self.direction, np.zeros(d)),
                            (self.offset, 0.0), (self.n, 0), (self.cost, 0.0), (self.mean, np.zeros(d))):
            part.append(start)
        return len(self.parent) - 1

    def paths(self, x: np.ndarray) -> np.ndarray:
        """The node of every row at each level from the root on; a row in a leaf stays there."""
        left, right = np.array(self.left), np.array(self.right)
        direction, offset = np.array(self.direction), np.array(self.offset)
        node, out = np.zeros(len(x), int), [np.zeros(len(x), int)]
        for _ in range(self.levels):
            side = np.einsum("ij,ij->i", x, direction[node]) <= offset[node]
            node = np.where(left[node] < 0, node, np.where(side, left[node], right[node]))
            out.append(node)
        return np.column_stack(out)

    def height(self, node: int) -> float:
        return self.cost[node] - self.cost[self.left[node]] - self.cost[self.right[node]] if self.left[node] >= 0 else 0.0

    def ranks(self) -> dict[int, int]:
        """Splits numbered from 1 in the order of a cut: always the split with the greatest height that is open, ties to the older node."""
        open_, rank = [(-self.height(0), 0)] if self.left and self.left[0] >= 0 else [], {}
        while open_:
            _, node = heapq.heappop(open_)
            rank[node] = len(rank) + 1
            for child in (self.left[node], self.right[node]):
                if self.left[child] >= 0:
                    heapq.heappush(open_, (-self.height(child), child))
        return rank

    def clusters(self, k: int) -> list[int]:
        """For every node the cluster its rows are in after the first k - 1 splits; there are at most as many as leaves."""
        rank = self.ranks()
        of: list[int] = []
        for node in range(len(self.parent)):
            up = self.parent[node]
            of.append(node if up < 0 or (rank[up] < k and of[up] == up) else of[up])
        return of

    def nodes(self, spark) -> DataFrame:
        """Rows (node, parent, level, n, cost, height, split_rank); a leaf has height 0 and no rank, the root no parent."""
        rank = self.ranks()
        made = [(i, self.parent[i] if i else None, self.level[i], int(self.n[i]), float(self.cost[i]), float(self.height(i)), rank.get(i)) for i in range(len(self.parent))]
        return spark.createDataFrame(made, "node int, parent int, level int, n long, cost double, height double, split_rank int")

    def _path(self, df: DataFrame) -> Column:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<int>")
        def path(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            tree = shared.value
            for columns in batches:
                columns = columns if isinstance(columns, tuple) else (columns,)  # one column comes alone
                x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
                yield pd.Series([p for i in range(0, len(x), SLICE) for p in tree.paths(x[i:i + SLICE])], dtype=object)

        return path(*_filled(df, self.features))

    def transform(self, df: DataFrame, name: str = "path") -> DataFrame:
        """``df`` with the node of every row at each level, the root first."""
        return df.withColumn(name, self._path(df))

    def cut(self, df: DataFrame, k: int, name: str = "cluster") -> DataFrame:
        """``df`` with the cluster of every row, a node, after the first k - 1 splits."""
        return df.withColumn(name, F.array(*[F.lit(c) for c in self.clusters(k)])[F.element_at(self._path(df), -1)])


def _filled(df: DataFrame, features: Sequence[str]) -> list[Column]:
    return [F.coalesce(clean_double(f), F.lit(0.0)) if f in df.columns else F.lit(0.0) for f in features]


def _sums(tree: SplitTree, level: int):
    """A task's sums per node of one level as rows (node, i, s): differences from the node's provisional mean, their squares, the count."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, d = len(tree.parent), len(tree.features)
        mean, total = np.array(tree.mean), np.zeros((nodes, 2 * d + 1))
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                x = batch.iloc[at:at + SLICE].to_numpy(float)
                node = tree.paths(x)[:, level]
                away = x - mean[node]
                for n in np.unique(node):
                    own = away[node == n]
                    total[n] += np.concatenate([own.sum(axis=0), (own ** 2).sum(axis=0), [len(own)]])
        seen = np.flatnonzero(total[:, -1])
        if len(seen):
            yield pd.DataFrame({"node": np.repeat(seen, 2 * d + 1), "i": np.tile(np.arange(2 * d + 1), len(seen)), "s": total[seen].ravel()})
    return run


def _measure(rows: DataFrame, tree: SplitTree, level: int) -> dict[int, np.ndarray]:
    """Sums of all rows per node of a level; one pass, combined map-side, (2 x features + 1) numbers a node."""
    found = rows.mapInPandas(_sums(tree, level), "node int, i int, s double").groupBy("node", "i").agg(F.sum("s").alias("s")).collect()
    out: dict[int, np.ndarray] = {}
    for r in found:
        out.setdefault(r["node"], np.zeros(2 * len(tree.features) + 1))[r["i"]] = r["s"]
    return out


def fit_split_tree(df: DataFrame, features: Sequence[str], levels: int = LEVELS, passes: int = PASSES) -> SplitTree:
    """Every node is split by two-means, all nodes of a level together, one pass over all rows for each move of the means.

    A split starts at the mean of the feature that varies most, the first of equals, so it takes no draw, and ends when no
    mean moves or after ``passes`` passes. Nodes whose rows are all alike are not split. A missing feature counts as 0. An
    empty table gives a root of no rows.
    """
    names = list(features)
    d = len(names)
    rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(_filled(df, names))]).persist()
    tree = SplitTree(names, levels)
    frontier = [tree.add(-1, 0)]
    try:
        tree.mean[0] = np.array([v or 0.0 for v in rows.agg(*[F.avg(f"x{i}") for i in range(d)]).first()], float)
        spread: dict[int, np.ndarray] = {}
        for level in range(levels + 1):
            spread.clear()
            for node, s in _measure(rows, tree, level).items():
                if node in frontier:
                    n, moved = s[-1], s[:d] / s[-1]
                    spread[node] = np.maximum(s[d:-1] - n * moved ** 2, 0.0)
                    tree.n[node], tree.mean[node], tree.cost[node] = int(n), tree.mean[node] + moved, float(spread[node].sum())
            parents = [f for f in frontier if level < levels and tree.n[f] > 1 and tree.cost[f] > FLAT * max(tree.cost[0], np.square(tree.mean[0]).sum() * tree.n[0])]
            if not parents:
                break
            frontier = []
            for p in parents:
                f = int(np.argmax(spread[p]))
                tree.direction[p], tree.offset[p] = np.eye(d)[f], float(tree.mean[p][f])
                tree.left[p], tree.right[p] = tree.add(p, level + 1), tree.add(p, level + 1)
                for child in (tree.left[p], tree.right[p]):
                    tree.mean[child] = tree.mean[p]
                frontier += [tree.left[p], tree.right[p]]
            moving = set(parents)
            for _ in range(passes):
                sums = _measure(rows, tree, level + 1)
                for p in sorted(moving):
                    sides = [(c, sums[c][:d] / sums[c][-1]) for c in (tree.left[p], tree.right[p])]
                    scale = np.sqrt(tree.cost[p] / tree.n[p])
                    if all(np.abs(m).max() <= 1e-12 * scale for _, m in sides):
                        moving.discard(p)
                        continue
                    low, high = [tree.mean[c] + m for c, m in sides]
                    tree.mean[tree.left[p]], tree.mean[tree.right[p]] = low, high
                    tree.direction[p] = high - low
                    tree.offset[p] = float((high - low) @ (high + low) / 2)
                if not moving:
                    break
    finally:
        rows.unpersist()
    return tree
