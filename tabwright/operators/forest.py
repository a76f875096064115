"""Random forests on binned features, grown from cells: rows whose features fall into the same bins go down every tree together.

A bootstrap draws each row a Poisson(1) number of times for each tree. Of a cell only the sums of the drawn rows matter:
for classes the draws of n like rows add up to one of Poisson(n), for values each row is drawn by the task that holds it.
Trees are then grown side by side, each from sums per cell. Bins, splits, stops and leaves follow Spark's forests, and the
result is a Spark model. Rows with too many cells to collapse are left to Spark's own fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: most cells that rows collapse to; what a task holds of a tree is a few numbers for each
MOST_CELLS = 1 << 17
#: numbers that a task holds at once, of all trees it draws for or of all nodes it splits
HELD = 1 << 23
#: rows drawn at once, and rows that tell the cuts, as in Spark's fit
DRAWN, TELLING = 1 << 18, 10_000
#: relative difference that the order of a sum may make
SLACK = 1e-12

_P = [math.exp(-1.0) / math.factorial(k) for k in range(20)]
_CDF = np.cumsum(_P)


def _poisson_table() -> np.ndarray:
    """The Poisson(1) number of each 16-bit piece of [0, 1), 255 where a piece holds a step."""
    low = np.searchsorted(_CDF, np.arange(65536) / 65536, "right")
    high = np.searchsorted(_CDF, (np.arange(65536) + 1) / 65536, "left")
    return np.where(low == high, low, 255).astype(np.uint8)


_TABLE = _poisson_table()


def poisson_one(rng: np.random.Generator, n: int) -> np.ndarray:
    """``n`` Poisson(1) numbers: by table, with more bits where 16 do not tell."""
    u = rng.integers(0, 65536, n, np.uint16)
    k = _TABLE[u]
    unsure = np.flatnonzero(k == 255)
    k[unsure] = np.searchsorted(_CDF, (u[unsure] + rng.random(len(unsure))) / 65536, "right")
    return k


def feature_cuts(values: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Middles between neighbouring values: all of them, or those nearest to even steps of weight."""
    distinct, at = np.unique(values, return_inverse=True)
    if len(distinct) <= bins:
        return (distinct[:-1] + distinct[1:]) / 2.0
    counts = np.bincount(at, weight)
    stride, cuts = counts.sum() / bins, []
    target, so_far = stride, counts[0]
    for i in range(1, len(distinct)):
        before, so_far = so_far, so_far + counts[i]
        if abs(before - target) < abs(so_far - target):
            cuts.append((distinct[i - 1] + distinct[i]) / 2.0)
            target += stride
    return np.array(cuts)


@dataclass
class Cells:
    """Bins of the features and the cells that hold rows; for classes also the rows and weight of each cell and class.

    Without ``codes`` the rows do not collapse.
    """

    rows: DataFrame
    cuts: list[np.ndarray]
    codes: np.ndarray
    classes: int
    #: (place of the cell, class, weight of a row, rows)
    counts: list[np.ndarray]
    mean: float = 0.0

    def bins(self) -> np.ndarray:
        """The bin of every cell (rows) in every feature (columns)."""
        out, left = [], self.codes
        for c in reversed(self.cuts):
            left, own = np.divmod(left, len(c) + 1)
            out.append(own)
        return np.column_stack(out[::-1])


def coded(rows: DataFrame, cuts: list[np.ndarray], weighted: bool) -> DataFrame:
    """Rows (code, label, weight): the bins of all features as one number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            code = np.zeros(b.num_rows, np.int64)
            for f, c in enumerate(cuts):
                code = code * (len(c) + 1) + np.searchsorted(c, x[:, f])
            yield pa.RecordBatch.from_arrays([pa.array(code), b.column(1), b.column(2)], ["code", "label", "weight"])

    weight = F.col("weight") if weighted else F.lit(1.0)
    return rows.select(vector_to_array("features").alias("x"), "label", weight.alias("weight")).mapInArrow(run, "code long, label double, weight double")


def collapse(rows: DataFrame, classes: bool, bins: int = 32) -> Cells:
    """Cells of rows (features, label, and weight for classes); empty where there are too many of them."""
    none = Cells(rows, [], np.zeros(0, np.int64), 0, [])
    n = rows.count()
    if not n:
        return none
    bins = min(bins, n)
    share = min(1.0, max(bins * bins, TELLING) / n)
    told = rows.select(vector_to_array("features").alias("x"), F.col("weight") if classes else F.lit(1.0).alias("weight"))
    told = (told if share == 1.0 else told.sample(False, share, 1)).toPandas()
    x, w = np.stack(told["x"].to_numpy()) if len(told) else np.zeros((0, 0)), told["weight"].to_numpy(float)
    if not x.size or np.isnan(x).any():
        return none
    cuts = [feature_cuts(x[:, f], w, bins) for f in range(x.shape[1])]
    if math.prod(len(c) + 1 for c in cuts) >= 1 << 62:
        return none
    known = coded(rows, cuts, classes)
    if not classes:
        found = known.select("code").distinct().limit(MOST_CELLS + 1).toPandas()["code"].to_numpy(np.int64)
        mean = rows.agg(F.avg("label")).first()[0]
        return Cells(rows, cuts, np.sort(found), 0, [], float(mean)) if len(found) <= MOST_CELLS else none
    found = known.groupBy("code", "label", "weight").agg(F.count(F.lit(1)).alias("n")).limit(MOST_CELLS + 1).toPandas()
    if len(found) > MOST_CELLS:
        return none
    found = found.sort_values(["code", "label", "weight"])
    codes, place = np.unique(found["code"].to_numpy(np.int64), return_inverse=True)
    label = found["label"].to_numpy(float)
    if (label < 0).any() or (label != np.floor(label)).any():
        return none
    return Cells(rows, cuts, codes, int(label.max()) + 1, [place, label.astype(np.int64), found["weight"].to_numpy(float), found["n"].to_numpy(np.int64)])


def per_node(strategy: str, features: int, classes: bool, trees: int) -> int:
    """Features that a node may choose from, by the name or share of Spark's parameter."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classes else "onethird"
    known = {"all": features, "sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features))), "onethird": math.ceil(features / 3.0)}
    if strategy in known:
        return known[strategy]
    return min(int(strategy), features) if strategy.isdigit() else math.ceil(float(strategy) * features)


def impurity_of(sums: np.ndarray, classes: bool) -> np.ndarray:
    """Gini impurity of class weights, or variance from (weight, sum, sum of squares), along the last axis."""
    with np.errstate(all="ignore"):
        if classes:
            total = sums.sum(axis=-1)
            return np.where(total > 0, 1.0 - (sums ** 2).sum(axis=-1) / total ** 2, 0.0)
        return np.where(sums[..., 0] > 0, np.maximum(sums[..., 2] / sums[..., 0] - (sums[..., 1] / sums[..., 0]) ** 2, 0.0), 0.0)


def gains(left: np.ndarray, right: np.ndarray, classes: bool) -> np.ndarray:
    """What splits take off the impurity of their node."""
    with np.errstate(all="ignore"):
        if classes:
            wl, wr = left.sum(axis=-1), right.sum(axis=-1)
            parts = (left ** 2).sum(axis=-1) / wl + (right ** 2).sum(axis=-1) / wr - ((left + right) ** 2).sum(axis=-1) / (wl + wr)
            return parts / (wl + wr)
        wl, wr = left[..., 0], right[..., 0]
        return wl * wr / (wl + wr) ** 2 * (left[..., 1] / wl - right[..., 1] / wr) ** 2


def grow(x: np.ndarray, drawn: np.ndarray, sums: np.ndarray, cuts: list[np.ndarray], classes: bool, depth: int, choices: int, least: int,
         rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree from the bins of its cells (rows), the rows drawn of each and their sums, level by level."""
    x, drawn, sums = x[drawn > 0], drawn[drawn > 0], sums[drawn > 0]
    both = np.column_stack([drawn, sums])
    d, bins, width = x.shape[1], max(len(c) for c in cuts) + 1, both.shape[1]
    possible = np.array([[b < len(c) for b in range(bins - 1)] for c in cuts]).reshape(d, bins - 1)
    held = [both.sum(axis=0)[None, :]]
    feature, cut, gain = [np.full(1, -1)], [np.zeros(1, np.int64)], [np.full(1, -1.0)]
    left, right, made = [np.full(1, -1)], [np.full(1, -1)], 1
    open_nodes = np.zeros(1, np.int64)  # places among the nodes of this level
    slot = np.zeros(len(x), np.int64)  # the place of each cell's node among the open ones, or -1
    for _ in range(depth if bins > 1 else 0):
        m = len(open_nodes)
        if not m:
            break
        best, top = np.zeros(m, np.int64), np.full(m, -np.inf)
        step = max(1, HELD // (d * bins * width))
        for low in range(0, m, step):
            high = min(m, low + step)
            inside = np.flatnonzero((slot >= low) & (slot < high))
            base, value = (slot[inside] - low) * d * bins, both[inside]
            table = np.zeros(((high - low) * d * bins, width))
            for f in range(d):
                at = base + f * bins + x[inside, f]
                for s in range(width):
                    table[:, s] += np.bincount(at, value[:, s], len(table))
            upto = np.cumsum(table.reshape(high - low, d, bins, width), axis=2)
            below, above = upto[:, :, :-1], upto[:, :, -1:] - upto[:, :, :-1]
            found = gains(below[..., 1:], above[..., 1:], classes)
            chosen = np.zeros((high - low, d), bool)
            np.put_along_axis(chosen, rng.random((high - low, d)).argsort(axis=1)[:, :choices], True, axis=1)
            allowed = chosen[:, :, None] & possible & (below[..., 0] >= least - 0.5) & (above[..., 0] >= least - 0.5)
            found = np.where(allowed & (found == found), found, -np.inf).reshape(high - low, -1)
            best[low:high], top[low:high] = found.argmax(axis=1), found.max(axis=1)
        own = held[-1][open_nodes]
        splits = np.flatnonzero(top > SLACK * impurity_of(own[:, 1:], classes))
        splits = splits[top[splits] > 0]
        if not len(splits):
            break
        f, b = np.divmod(best[splits], bins - 1)
        at = open_nodes[splits]
        feature[-1][at], cut[-1][at], gain[-1][at] = f, b, top[splits]
        left[-1][at], right[-1][at] = made + 2 * np.arange(len(splits)), made + 2 * np.arange(len(splits)) + 1
        place = np.full(m, -1)
        place[splits] = np.arange(len(splits))
        inner = np.flatnonzero(slot >= 0)
        inner = inner[place[slot[inner]] >= 0]
        p = place[slot[inner]]
        child = 2 * p + (x[inner, f[p]] > b[p])
        n = 2 * len(splits)
        new = np.column_stack([np.bincount(child, both[inner, s], n) for s in range(width)])
        held.append(new)
        for part, start in ((feature, -1), (left, -1), (right, -1), (cut, 0)):
            part.append(np.full(n, start, np.int64))
        gain.append(np.full(n, -1.0))
        made += n
        open_nodes = np.flatnonzero(impurity_of(new[:, 1:], classes) > 2.3e-16)
        again = np.full(n, -1)
        again[open_nodes] = np.arange(len(open_nodes))
        slot = np.full(len(x), -1)
        slot[inner] = again[child]
    return {k: np.concatenate(v) for k, v in (("feature", feature), ("cut", cut), ("gain", gain), ("left", left), ("right", right), ("held", held))}


def pruned(t: dict[str, np.ndarray], prediction: np.ndarray) -> np.ndarray:
    """Merge leaves that predict the same, bottom up, as Spark does. The nodes that stay, in order; children are numbered anew."""
    left, right = t["left"], t["right"]
    for i in range(len(left) - 1, -1, -1):
        a, b = left[i], right[i]
        if a >= 0 and left[a] < 0 and left[b] < 0 and prediction[a] == prediction[b]:
            left[i] = right[i] = t["feature"][i] = -1
            t["gain"][i] = -1.0
    stays = np.zeros(len(left), bool)
    stays[0] = True
    for i in range(len(left)):
        if stays[i] and left[i] >= 0:
            stays[left[i]] = stays[right[i]] = True
    number = np.cumsum(stays) - 1
    for side in (left, right):
        inner = side >= 0
        side[inner] = number[side[inner]]
    return np.flatnonzero(stays)


NODES = ("tree int, id int, prediction double, impurity double, stats array<double>, raw long, gain double, leftChild int, rightChild int, "
         "feature int, threshold array<double>")


def as_rows(tree: int, t: dict[str, np.ndarray], cuts: list[np.ndarray], classes: bool, mean: float) -> pd.DataFrame:
    """The nodes of a tree as Spark keeps them; values were centred while it grew."""
    sums = t["held"][:, 1:]
    if classes:
        prediction = sums.argmax(axis=1).astype(float)
    else:
        prediction = sums[:, 1] / sums[:, 0] + mean
    impurity = impurity_of(sums, classes)
    if not classes:
        sums = np.column_stack([sums[:, 0], sums[:, 1] + mean * sums[:, 0], sums[:, 2] + 2 * mean * sums[:, 1] + mean * mean * sums[:, 0]])
    keep = pruned(t, prediction)
    feature, cut = t["feature"][keep], t["cut"][keep]
    return pd.DataFrame({
        "tree": np.full(len(keep), tree, np.int32), "id": np.arange(len(keep), dtype=np.int32), "prediction": prediction[keep], "impurity": impurity[keep],
        "stats": list(sums[keep]), "raw": np.rint(t["held"][keep, 0]).astype(np.int64), "gain": t["gain"][keep],
        "leftChild": t["left"][keep].astype(np.int32), "rightChild": t["right"][keep].astype(np.int32), "feature": feature.astype(np.int32),
        "threshold": [[float(cuts[f][b])] if f >= 0 else [] for f, b in zip(feature, cut)]})


def class_trees(cells: Cells, trees: int, draws: bool, seed: int, depth: int, choices: int, least: int) -> DataFrame:
    """Nodes of trees that tell classes: each draws from the counts of the cells, whatever task it is grown in."""
    spark = cells.rows.sparkSession
    shared = spark.sparkContext.broadcast((cells.bins(), cells.cuts, cells.counts, cells.classes, len(cells.codes)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, cuts, (place, label, weight, rows), classes, n = shared.value
        for tree in (int(t) for batch in batches for t in batch["id"]):
            rng = np.random.default_rng([seed % (1 << 63), tree])
            k = (rng.poisson(rows) if draws else rows).astype(float)
            sums = np.bincount(place * classes + label, k * weight, n * classes).reshape(n, classes)
            yield as_rows(tree, grow(x, np.bincount(place, k, n), sums, cuts, True, depth, choices, least, rng), cuts, True, 0.0)

    return spark.range(0, trees, 1, min(trees, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, NODES)


def value_trees(cells: Cells, trees: int, draws: bool, seed: int, depth: int, choices: int, least: int) -> DataFrame:
    """Nodes of trees that tell values: tasks draw their rows for each tree and send its sums per cell to where it is grown."""
    spark, n = cells.rows.sparkSession, len(cells.codes)
    shared = spark.sparkContext.broadcast((cells.bins(), cells.cuts, cells.codes, cells.mean))
    block = max(1, HELD // (3 * n))  # trees that a task draws for at once
    known = coded(cells.rows, cells.cuts, False)

    def drawing(first: int, end: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, _, codes, mean = shared.value
            part = TaskContext.get().partitionId()
            rng, total, waiting, count = np.random.default_rng([seed % (1 << 63), first, part]), np.zeros((end - first, 3, n)), [], 0

            def draw():
                at = np.searchsorted(codes, np.concatenate([w[0] for w in waiting]))
                y = np.concatenate([w[1] for w in waiting]) - mean
                squares = y * y
                for t in range(end - first):
                    k = (poisson_one(rng, len(y)) if draws else np.ones(len(y))).astype(float)
                    for s, v in enumerate((k, k * y, k * squares)):
                        total[t, s] += np.bincount(at, v, n)

            for b in batches:
                waiting.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
                count += b.num_rows
                if count >= DRAWN:
                    draw()
                    waiting, count = [], 0
            if count:
                draw()
            for t in range(end - first):
                met = np.flatnonzero(total[t, 0])
                if len(met):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([first + t], pa.int32()), pa.array([part], pa.int32()), pa.array([met.astype(np.int32).tobytes()], pa.binary()),
                         pa.array([total[t][:, met].tobytes()], pa.binary())], ["tree", "part", "met", "sums"])
        return run

    def growing(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        x, cuts, _, mean = shared.value
        total = np.zeros((3, n))
        for _, met, sums in sorted(zip(parts["part"], parts["met"], parts["sums"])):
            total[:, np.frombuffer(met, np.int32)] += np.frombuffer(sums).reshape(3, -1)
        tree, rng = int(key[0]), np.random.default_rng([seed % (1 << 63), 1 << 40, int(key[0])])
        return as_rows(tree, grow(x, total[0], total.T.copy(), cuts, False, depth, choices, least, rng), cuts, False, mean)

    drawn = None
    for first in range(0, trees, block):
        some = known.mapInArrow(drawing(first, min(trees, first + block)), "tree int, part int, met binary, sums binary")
        drawn = some if drawn is None else drawn.unionByName(some)
    return drawn.groupBy("tree").applyInPandas(growing, NODES)


def fit_forest(estimator, cells: Cells, rows: DataFrame):
    """What ``estimator``, one of Spark's two forests, fits on ``rows``, grown from their ``cells`` where there are some."""
    # of parameters set otherwise Spark's own fit takes care
    plain = {"impurity": "gini" if isinstance(estimator, RandomForestClassifier) else "variance", "subsamplingRate": 1.0, "minInfoGain": 0.0,
             "minWeightFractionPerNode": 0.0}
    if not len(cells.codes) or any(estimator.getOrDefault(k) != v for k, v in plain.items()):
        return estimator.fit(rows)
    spark, classes, trees = rows.sparkSession, isinstance(estimator, RandomForestClassifier), estimator.getNumTrees()
    choices = per_node(estimator.getFeatureSubsetStrategy(), len(cells.cuts), classes, trees)
    nodes = (class_trees if classes else value_trees)(cells, trees, estimator.getBootstrap(), estimator.getSeed(), estimator.getMaxDepth(), choices, estimator.getMinInstancesPerNode())
    # the model of a row per class carries all parameters; its trees are put in place
    few = [(Vectors.dense([0.0] * len(cells.cuts)), float(c), 1.0) for c in range(max(cells.classes, 1))]
    path = scratch_path(spark, "forest")
    estimator.fit(spark.createDataFrame(few, ["features", "label", "weight"])).save(path)
    made = nodes.select(F.col("tree").alias("treeID"), F.struct(
        "id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("raw").alias("rawCount"), "gain", "leftChild", "rightChild",
        F.struct(F.col("feature").alias("featureIndex"), F.col("threshold").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split"),
    ).alias("nodeData"))
    made.write.mode("overwrite").parquet(f"{path}/data")
    return (RandomForestClassificationModel if classes else RandomForestRegressionModel).load(path)
