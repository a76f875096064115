"""Gradient-boosted trees on binned features, grown level by level from sums of gradients.

Rows whose features fall into the same bins have the same score in every round, so they are first collapsed to one cell
with its weight and label sums. A level of a round is one job: tasks sum the gradients of their cells per (tree, node,
feature, bin), the sums meet by (tree, node, feature), and one candidate split per node and reducer reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clean_double
from ..session import cut_lineage
from .models import spread
from .splits import with_weights

ROUNDS, DEPTH, RATE = 300, 6, 0.05
BINS = 64
#: rounds after which the scores of all cells are written, so that a lost executor repeats no more than these
WRITE_EVERY = 10
SLICE = 2_000
L2, LEAST = 1.0, 1.0
#: relative difference that the order of a sum may make; what differs by less counts as equal
SLACK = 1e-9


KINDS = {"feature": np.int32, "bin": np.float64, "left": np.int32, "right": np.int32, "value": np.float64, "gain": np.float64}


@dataclass
class Nodes:
    """Trees as flat arrays; a leaf has feature -1. ``value`` is the score of any node, were it a leaf, ``gain`` what its split gains."""

    feature: list = field(default_factory=list)
    bin: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def add(self, value: float) -> int:
        for part, start in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, value), (self.gain, 0.0)):
            part.append(start)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, at: int, left: float, right: float, gain: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.gain[node] = feature, at, gain
        self.left[node], self.right[node] = self.add(left), self.add(right)
        return self.left[node], self.right[node]

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array(getattr(self, k), t) for k, t in KINDS.items()}


def leaves(x: np.ndarray, trees: dict[str, np.ndarray], roots: np.ndarray) -> np.ndarray:
    """The leaf of every row in every tree, the trees of a row going down side by side."""
    node = np.repeat(np.asarray(roots, np.int32)[None, :], len(x), axis=0)
    rows = np.arange(len(x))[:, None]
    while True:
        f = trees["feature"][node]
        inner = f >= 0
        if not inner.any():
            return node
        down = np.where(x[rows, np.maximum(f, 0)] <= trees["bin"][node], trees["left"][node], trees["right"][node])
        node = np.where(inner, down, node)


def gradients(kind: str, margin: np.ndarray, weight: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss of each cell (rows) in each output (columns).

    ``target`` is the sum of the labels of the cell's rows by weight: of ones, of each class, or of the values.
    """
    w = weight[:, None]
    if kind == "regression":
        return w * margin - target, np.repeat(w, margin.shape[1], axis=1)
    if kind == "binary":
        p = 1.0 / (1.0 + np.exp(-margin))
    else:
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
    return w * p - target, np.maximum(w * p * (1.0 - p), 1e-16)


def node_sums(x: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, bins: int) -> np.ndarray:
    """Sums (node, feature, bin, 2) of the rows whose node is open; ``slot`` is its place or -1."""
    inside = slot >= 0
    x, slot, g, h = x[inside], slot[inside], g[inside], h[inside]
    d = x.shape[1]
    place = ((slot[:, None].astype(np.int64) * d + np.arange(d)) * bins + x).ravel()
    size = nodes * d * bins
    return np.stack([np.bincount(place, np.repeat(v, d), size) for v in (g, h)], axis=-1).reshape(nodes, d, bins, 2)


def best_split(sums: np.ndarray, l2: float = L2, least: float = LEAST) -> tuple[float, int, float, float, float, float]:
    """(gain, bin, g and h left, g and h right) of one node's feature; rows up to the bin go left.

    A side whose second derivatives add up to less than ``least`` is not made. Of equal gains the smallest bin. Without a
    possible split the gain is 0, and the left side holds all.
    """
    left = np.cumsum(sums, axis=0)
    total = left[-1]
    right = total - left
    with np.errstate(all="ignore"):
        gain = left[:, 0] ** 2 / (left[:, 1] + l2) + right[:, 0] ** 2 / (right[:, 1] + l2) - total[0] ** 2 / (total[1] + l2)
    enough = least * (1.0 - SLACK)
    gain = np.where((left[:, 1] >= enough) & (right[:, 1] >= enough), gain, -np.inf)
    top = gain.max()
    at = int(np.argmax(gain >= top - SLACK * abs(top)))
    if not top > SLACK * max(total[0] ** 2 / (total[1] + l2), 1e-300):
        return 0.0, -1, float(total[0]), float(total[1]), 0.0, 0.0
    return float(gain[at]), at, *map(float, left[at]), *map(float, right[at])


@dataclass
class Boosted:
    """Trees of all rounds; in a round one tree per output, round by round. Cuts are values of the features."""

    kind: str
    features: list[str]
    classes: list[float]
    base: np.ndarray
    trees: dict[str, np.ndarray]
    roots: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Scores per output: the base and the leaf values of its trees."""
        if not len(self.roots):
            return np.repeat(self.base[None, :], len(x), axis=0)
        value = self.trees["value"][leaves(x, self.trees, self.roots)]
        return self.base + value.reshape(len(x), -1, len(self.base)).sum(axis=1)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``pred`` and, for two classes, the probability ``p`` of the second; a missing feature counts as 0.

        The arrays are sent once to each executor.
        """
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            model = shared.value
            for columns in batches:
                columns = columns if isinstance(columns, tuple) else (columns,)  # one column comes alone
                x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
                yield pd.Series([m for i in range(0, len(x), SLICE) for m in model.margins(x[i:i + SLICE])], dtype=object)

        margin = score(*[F.coalesce(clean_double(f), F.lit(0.0)) if f in df.columns else F.lit(0.0) for f in self.features])
        if self.kind == "regression":
            return df.withColumn("pred", margin[0])
        if self.kind == "binary":
            p = 1.0 / (1.0 + F.exp(-F.col("p")[0]))
            low, high = [float(c) for c in self.classes]
            return df.withColumn("p", margin).withColumn("p", p).withColumn("pred", F.when(F.col("p") > 0.5, high).otherwise(low))
        best = F.array_position(F.col("pred"), F.array_max("pred")).cast("int") - 1  # equal scores: the smaller class
        return df.withColumn("pred", margin).withColumn("pred", F.get(F.array(*[F.lit(float(c)) for c in self.classes]), best))

    def loss_by_round(self, df: DataFrame, label: str) -> DataFrame:
        """Rows (round, loss): mean log loss or squared error of the labelled rows after each round, in one pass.

        Log loss by class weights balanced in ``df``. Labels that were not learned have no place here. A model without trees gives no rows.
        """
        rows = learnable(df, self.features, label, self.kind).select("label", "weight", *[f"x{i}" for i in range(len(self.features))])
        shared = df.sparkSession.sparkContext.broadcast(self)

        def lost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, total, held = shared.value, np.zeros(0), 0.0
            if not len(model.roots):
                return
            outputs = len(model.base)
            for batch in batches:
                for i in range(0, len(batch), SLICE):
                    part = batch.iloc[i:i + SLICE]
                    x, y, w = part.iloc[:, 2:].to_numpy(float), part["label"].to_numpy(float), part["weight"].to_numpy(float)
                    value = model.trees["value"][leaves(x, model.trees, model.roots)].reshape(len(x), -1, outputs)
                    m = model.base + np.cumsum(value, axis=1)
                    if model.kind == "regression":
                        loss = (y[:, None] - m[:, :, 0]) ** 2
                    elif model.kind == "binary":
                        side = np.where(y == model.classes[1], 1.0, -1.0)[:, None]
                        loss = np.logaddexp(0.0, -side * m[:, :, 0])
                    else:
                        own = np.searchsorted(np.array(model.classes), y)
                        loss = np.logaddexp.reduce(m, axis=2) - m[np.arange(len(x)), :, own]
                    total, held = (w[:, None] * loss).sum(axis=0) + (total if held else 0.0), held + w.sum()
            if held:
                yield pd.DataFrame({"round": np.arange(1, len(total) + 1), "lost": total, "weight": held})

        parts = rows.mapInPandas(lost, "round int, lost double, weight double")
        return parts.groupBy("round").agg((F.sum("lost") / F.sum("weight")).alias("loss"))


    def importances(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits, in feature order; all 0 for a model without splits."""
        inner = self.trees["feature"] >= 0
        gained = np.bincount(self.trees["feature"][inner], self.trees["gain"][inner], len(self.features))
        return dict(zip(self.features, map(float, gained / (gained.sum() or 1.0))))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as one row of arrays, in place of what ``path`` held; `load_boosted` reads it again."""
        row = (self.kind, list(self.features), [float(c) for c in self.classes], self.base.tolist(), self.roots.tolist(), *[self.trees[k].tolist() for k in KINDS])
        spark.createDataFrame([row], SAVED).coalesce(1).write.mode("overwrite").parquet(path)


SAVED = ("kind string, features array<string>, classes array<double>, base array<double>, roots array<int>, "
         "feature array<int>, bin array<double>, left array<int>, right array<int>, value array<double>, gain array<double>")


def load_boosted(spark: SparkSession, path: str) -> Boosted:
    """The model that `Boosted.save` wrote; it scores as before, to the last bit."""
    r = spark.read.schema(SAVED).parquet(path).first()
    trees = {k: np.array(r[k], t) for k, t in KINDS.items()}
    return Boosted(r["kind"], list(r["features"]), list(r["classes"]), np.array(r["base"], float), trees, np.array(r["roots"], np.int32))


def learnable(df: DataFrame, features: Sequence[str], label: str, kind: str) -> DataFrame:
    """Labelled rows as (x0, x1, ..., label, weight): missing and absent features are 0, classes weigh alike, values weigh 1."""
    x = [F.coalesce(clean_double(f), F.lit(0.0)) if f in df.columns else F.lit(0.0) for f in features]
    rows = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)], clean_double(label).alias("label")).filter("label is not null")
    return rows.withColumn("weight", F.lit(1.0)) if kind == "regression" else with_weights(rows, "label")


def bin_cuts(rows: DataFrame, features: int, bins: int = BINS) -> list[np.ndarray]:
    """Increasing cuts per feature, at most ``bins`` - 1, at quantiles of all rows found in one pass; a bin ends with its cut.

    The quantiles come from a sketch, within a quarter of a bin, so they may differ with the partitioning of the rows.
    """
    found = rows.approxQuantile([f"x{i}" for i in range(features)], [i / bins for i in range(1, bins)], 0.25 / bins)
    return [np.unique(np.array(q, float)) for q in found]


def _binned(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([np.searchsorted(c, b.column(i).to_numpy(zero_copy_only=False)) for i, c in enumerate(cuts)]).astype(np.uint8)
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(cuts)
            cell = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([cell, *b.columns[len(cuts):]], ["cell", "label", "weight"])
    return run


def cells(rows: DataFrame, cuts: list[np.ndarray], classes: Sequence[float]) -> DataFrame:
    """One row (cell, weight, target) per distinct tuple of bins, combined map-side.

    ``target`` holds the weight of each of ``classes``; without any, the sum of the labels.
    """
    binned = rows.select(*[f"x{i}" for i in range(len(cuts))], "label", "weight").mapInArrow(_binned(cuts), "cell binary, label double, weight double")
    kinds = [F.sum(F.when(F.col("label") == c, F.col("weight")).otherwise(0.0)) for c in classes] or [F.sum(F.col("weight") * F.col("label"))]
    return binned.groupBy("cell").agg(F.sum("weight").alias("weight"), F.array(*kinds).alias("target"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _cells(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("cell")
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _moved(state: DataFrame, done: dict, roots: np.ndarray, outputs: int) -> DataFrame:
    """Cells with the leaf values of the trees of the last rounds added to their scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                value = done["value"][leaves(_cells(b), done, roots)].reshape(b.num_rows, -1, outputs).sum(axis=1)
                margin = _matrix(b, "margin") + value
                ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * outputs)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(ends, pa.array(margin.ravel()))], ["cell", "weight", "target", "margin"])
    return state.mapInArrow(run, state.schema)


def _summing(kind: str, done: dict, roots: np.ndarray, growing: dict, starts: np.ndarray, slots: np.ndarray, counts: list[int], bins: int):
    """Sums of gradients of a task's cells, one row per (tree, node, feature)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                x, margin = _cells(b), _matrix(b, "margin")
                if len(roots):
                    margin = margin + done["value"][leaves(x, done, roots)].reshape(len(x), -1, margin.shape[1]).sum(axis=1)
                g, h = gradients(kind, margin, b.column("weight").to_numpy(), _matrix(b, "target"))
                slot = slots[leaves(x, growing, starts)]
                part = [node_sums(x, slot[:, t], g[:, t], h[:, t], n, bins) for t, n in enumerate(counts)]
                total = part if total is None else [a + p for a, p in zip(total, part)]
        for t, sums in enumerate(total or []):
            n, d = sums.shape[:2]
            if n:
                node, feature = np.divmod(np.arange(n * d, dtype=np.int32), d)
                flat = np.ascontiguousarray(sums).reshape(n * d, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n * d, t, np.int32)), pa.array(node.astype(np.int32)), pa.array(feature.astype(np.int32)),
                     pa.array([row.tobytes() for row in flat], pa.binary())], ["tree", "node", "feature", "sums"])
    return run


def _splitting(l2: float, least: float):
    """Sums of all tasks added up, then the best split of each (tree, node) among the features at hand."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for t, n, f, raw in zip(batch["tree"], batch["node"], batch["feature"], batch["sums"]):
                sums = np.frombuffer(raw).reshape(-1, 2)
                held[t, n, f] = held[t, n, f] + sums if (t, n, f) in held else sums
        best: dict[tuple[int, int], tuple] = {}
        for (t, n, f), sums in sorted(held.items()):
            found = best_split(sums, l2, least)
            if (t, n) not in best or better(found, f, *best[t, n]):
                best[t, n] = (found, f)
        if best:
            yield pd.DataFrame([(t, n, f, *found) for (t, n), (found, f) in best.items()], columns=["tree", "node", "feature", "gain", "bin", "gl", "hl", "gr", "hr"])
    return run


def better(one: tuple, feature: int, other: tuple, other_feature: int) -> bool:
    """Whether a split gains more; gains that differ by rounding only count as equal, and the smaller feature stays."""
    close = abs(one[0] - other[0]) <= SLACK * max(one[0], other[0])
    return feature < other_feature if close else one[0] > other[0]


SPLITS = "tree int, node int, feature int, gain double, bin int, gl double, hl double, gr double, hr double"


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, kind: str = "binary", rounds: int = ROUNDS, depth: int = DEPTH,
                rate: float = RATE, bins: int = BINS, l2: float = L2, least: float = LEAST) -> Boosted:
    """Trees for two classes (log loss), several (softmax, a tree per class in every round) or values (squared error).

    All labelled rows take part. Classes weigh alike; a missing feature counts as 0. ``bins`` is at most 256. At the driver
    stand the trees, the classes and, per level, one candidate per node and reducer, all bounded by the parameters and the
    number of classes. The scores of all cells are written every ``WRITE_EVERY`` rounds. No labelled row, or one class
    only, gives a model without trees, which predicts 0 or that class.
    """
    names = list(features)
    rows = learnable(df, names, label, kind)
    classes = [] if kind == "regression" else sorted(r[0] for r in rows.select("label").distinct().collect())
    if kind == "binary" and len(classes) > 2:
        raise ValueError("more than two classes: kind='multiclass'")
    outputs = len(classes) if kind == "multiclass" and classes else 1
    if kind != "regression" and len(classes) < 2:
        known = classes or [0.0]
        return Boosted(kind, names, known * 2 if kind == "binary" else known, np.zeros(1), Nodes().arrays(), np.zeros(0, np.int32))
    cuts = bin_cuts(rows, len(names), bins)
    collapsed = cells(rows, cuts, classes[1:] if kind == "binary" else classes)
    state = cut_lineage(spread(cut_lineage(collapsed, "cells")), "cells-spread")
    one = state.agg(F.sum("weight"), *[F.sum(F.col("target")[t]) for t in range(outputs)]).first()
    if not one[0]:
        return Boosted(kind, names, classes, np.zeros(1), Nodes().arrays(), np.zeros(0, np.int32))
    share = np.array(one[1:], float) / one[0]
    base = share if kind == "regression" else np.log(share) if kind == "multiclass" else np.log(share / (1.0 - share))
    state = state.withColumn("margin", F.array(*[F.lit(float(v)) for v in base]))
    reducers = max(1, min(df.sparkSession.sparkContext.defaultParallelism, len(names) * outputs // 32))

    model, roots, recent, recent_roots = Nodes(), [], Nodes(), []
    state = state.persist()
    try:
        for r in range(rounds):
            grown, starts = Nodes(), []
            for _ in range(outputs):
                starts.append(grown.add(0.0))
            frontier = [[s] for s in starts]
            for level in range(depth):
                growing, slots = grown.arrays(), np.full(len(grown.feature), -1, np.int32)
                for nodes in frontier:
                    slots[nodes] = np.arange(len(nodes))
                job = _summing(kind, recent.arrays(), np.array(recent_roots, np.int32), growing, np.array(starts), slots, [len(n) for n in frontier], bins)
                sums = state.mapInArrow(job, "tree int, node int, feature int, sums binary")
                found = sums.repartition(reducers, "tree", "node", "feature").mapInPandas(_splitting(l2, least), SPLITS).collect()
                best: dict[tuple[int, int], tuple] = {}
                for s in sorted(found, key=lambda s: s["feature"]):
                    key, split = (s["tree"], s["node"]), (s["gain"], s["bin"], s["gl"], s["hl"], s["gr"], s["hr"])
                    if key not in best or better(split, s["feature"], *best[key]):
                        best[key] = (split, s["feature"])
                fresh = [[] for _ in starts]
                for (t, n), ((gain, at, gl, hl, gr, hr), feature) in sorted(best.items()):
                    node = frontier[t][n]
                    if level == 0:
                        grown.value[node] = -rate * (gl + gr) / (hl + hr + l2)
                    if at >= 0:
                        fresh[t] += grown.split(node, feature, at, -rate * gl / (hl + l2), -rate * gr / (hr + l2), gain)
                frontier = fresh
                if not any(frontier):
                    break
            for held, its_roots in ((model, roots), (recent, recent_roots)):
                shift = len(held.feature)
                held.feature += grown.feature
                held.bin += grown.bin
                held.value += grown.value
                held.gain += grown.gain
                held.left += [v + shift for v in grown.left]
                held.right += [v + shift for v in grown.right]
                its_roots += [s + shift for s in starts]
            if (r + 1) % WRITE_EVERY == 0 and r + 1 < rounds:
                moved = cut_lineage(_moved(state, recent.arrays(), np.array(recent_roots, np.int32), outputs), "scores")
                state.unpersist()
                state, recent, recent_roots = moved.persist(), Nodes(), []
    finally:
        state.unpersist()

    trees = model.arrays()
    inner = trees["feature"] >= 0
    trees["bin"] = np.array([cuts[f][int(b)] if i and int(b) < len(cuts[f]) else np.inf for f, b, i in zip(trees["feature"], trees["bin"], inner)], float)
    return Boosted(kind, names, classes, base, trees, np.array(roots, np.int32))
