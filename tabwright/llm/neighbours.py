"""Approximate nearest neighbours by inner product: stable projections, a kd-tree over them, and a chi-square stop.

The largest inner product becomes the smallest distance when every vector gets one more component that lifts all to the
same length. Gaussian projections are 2-stable: the squared projected distance of a point at distance d is d^2 times a
chi-square variable with as many degrees of freedom as there are projections. So once every point nearer than r in the
projection has been verified, a point that beats the k-th best distance d was missed with probability 1 - F(r^2 / d^2) at
most. A query takes the leaves of the tree in order of projected distance, verifies their points with the original
vectors, and stops when F reaches the wanted confidence.

The upper levels of the tree are cut on a bounded sample of projections, and every vector is put into one of the resulting
cells, whose exact bounds are then taken over all vectors. A query first searches the cell that is nearest in the projection;
the k-th score found there tells which other cells the test leaves open, and only those it is sent to. A cell of many
vectors is dealt into parts and its queries into blocks, both of bounded size; each part and block has a tree of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

K, EVERY = 20, 20
PROJECTIONS, CONFIDENCE, LEAF = 8, 0.95, 128
#: vectors of a part, and queries of a block
PART, BLOCK = 16_384, 4_096
#: cells, and the vectors (of the smallest hashes) whose projections they are cut on
LEAST_CELLS, MOST_CELLS, SAMPLE = 32, 1_024, 32_768
SEED, SLICE = 7, 1_000


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for j in range(1, degrees // 2):
        term *= x / 2 / j
        total += term
    return 1 - exp(-x / 2) * total


@lru_cache(maxsize=8)
def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < p else (low, mid)
    return high


class Tree:
    """A kd-tree over projected points whose leaves hold at most `leaf` of them, with the bounds of each leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves, stack = [], [np.arange(len(points))]
        while stack:
            at = stack.pop()
            if len(at) <= leaf:
                self.leaves.append(at)
                continue
            own = points[at]
            axis, half = int(np.argmax(own.max(axis=0) - own.min(axis=0))), len(at) // 2
            order = np.argpartition(own[:, axis], half)
            stack += [at[order[:half]], at[order[half:]]]
        self.low = np.array([points[x].min(axis=0) for x in self.leaves])
        self.high = np.array([points[x].max(axis=0) for x in self.leaves])


def distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, boxes): smallest squared distance that a point of the box can have."""
    out = np.zeros((len(q), len(low)))
    for axis in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[:, axis] - q[:, axis, None], q[:, axis, None] - high[:, axis]), 0)
        out += gap * gap
    return out


class Cells:
    """The upper levels of a kd-tree: the largest cell is halved until there are ``count``; equal points stay together."""

    def __init__(self, points: np.ndarray, count: int):
        self.axis, self.cut, self.left, self.right = [-1], [0.0], [0], [0]
        heap = [(-len(points), 0, np.arange(len(points)))]
        cells = 1
        while heap and cells < count:
            _, node, at = heapq.heappop(heap)
            own = points[at]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(at) > 1 else 0
            values = np.sort(own[:, axis])
            if len(at) < 2 or values[0] == values[-1]:
                continue  # all of it equal: one cell, whose vectors are dealt into parts
            half = values[(len(at) - 1) // 2]
            cut = half if half < values[-1] else values[values < values[-1]][-1]
            small = own[:, axis] <= cut
            self.axis[node], self.cut[node] = axis, float(cut)
            self.left[node], self.right[node] = len(self.axis), len(self.axis) + 1
            for part in (at[small], at[~small]):
                heapq.heappush(heap, (-len(part), len(self.axis), part))
                for held, start in ((self.axis, -1), (self.cut, 0.0), (self.left, 0), (self.right, 0)):
                    held.append(start)
            cells += 1

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The cell of every point, named by its node."""
        axis, cut, left, right = map(np.array, (self.axis, self.cut, self.left, self.right))
        node = np.zeros(len(points), int)
        while True:
            inner = axis[node] >= 0
            if not inner.any():
                return node
            small = points[np.arange(len(points)), np.maximum(axis[node], 0)] <= cut[node]
            node = np.where(inner, np.where(small, left[node], right[node]), node)


def directions(dim: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim + 1, projections))


def project(vectors: np.ndarray, most: float, random: np.ndarray) -> np.ndarray:
    """Projections of vectors lifted to the squared length ``most``."""
    norms = np.einsum("nd,nd->n", vectors, vectors)
    return vectors @ random[:-1] + np.sqrt(np.maximum(most - norms, 0))[:, None] * random[-1]


def open_within(scores: np.ndarray, square: np.ndarray, most: float) -> np.ndarray:
    """Squared distance of the k-th best score, a little enlarged so that rounding never hides an equal one; without any infinite."""
    return np.where(np.isfinite(scores), square + most - 2 * scores, np.inf) + 1e-9 * (square + most)


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K, projections: int = PROJECTIONS,
           confidence: float = CONFIDENCE, leaf: int = LEAF, seed: int = SEED, most: float | None = None,
           floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(queries, k) ids and scores of the nearest found, by score and then smaller id; -inf where there are fewer.

    ``floor`` is the k-th score that a query has found elsewhere (-inf: none); what scores less is not looked for.
    """
    if most is None:
        most = np.einsum("nd,nd->n", vectors, vectors).max(initial=0.0)
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    random = directions(vectors.shape[1], projections, seed)
    tree = Tree(project(vectors, most, random), leaf)
    limit = chi_square_quantile(confidence, projections)
    own = [(ids[x], np.ascontiguousarray(vectors[x])) for x in tree.leaves]
    best = np.full((len(queries), k), -np.inf)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    bounds = distances(queries @ random[:-1], tree.low, tree.high)
    order = np.argsort(bounds, axis=1, kind="stable")
    square = np.einsum("nd,nd->n", queries, queries)
    active = np.arange(len(queries))
    for step in range(len(tree.leaves)):
        there = order[active, step]
        kth = np.maximum(best[active, -1], floor[active])
        going = bounds[active, there] <= limit * open_within(kth, square[active], most)
        active, there = active[going], there[going]
        if not len(active):
            break
        by_leaf = np.argsort(there, kind="stable")
        cuts = np.flatnonzero(np.diff(there[by_leaf])) + 1
        for group in np.split(by_leaf, cuts):
            q, (leaf_ids, leaf_vectors) = active[group], own[there[group[0]]]
            # einsum adds each pair's products in one order, whatever the shapes: equal vectors score equal
            score = np.einsum("qd,nd->qn", queries[q], leaf_vectors)
            score[query_ids[q][:, None] == leaf_ids] = -np.inf
            better = (score >= np.maximum(best[q, -1:], floor[q, None])).any(axis=1)
            if not better.any():
                continue
            q = q[better]
            scores = np.concatenate([best[q], score[better]], axis=1)
            owners = np.concatenate([found[q], np.broadcast_to(leaf_ids, (len(q), len(leaf_ids)))], axis=1)
            top = np.lexsort((owners, -scores), axis=1)[:, :k]
            best[q], found[q] = np.take_along_axis(scores, top, 1), np.take_along_axis(owners, top, 1)
    return found, best


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, vector) of the vectors that take part; of rows with the same id, the one whose vector sorts first."""
    v = F.col("vector")
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vector")).where("id is not null and vector is not null")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def matrix(t, dim: int) -> np.ndarray:
    column = t.column("vector")
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(-1, dim), dtype=np.float64)


def nearest(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = EVERY, k: int = K, projections: int = PROJECTIONS,
            confidence: float = CONFIDENCE, leaf: int = LEAF, part: int = PART, block: int = BLOCK, cells: int = LEAST_CELLS, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the ``k`` nearest found, nearest first.

    A vector nearer than the k-th found was missed with a probability below 1 - ``confidence``. Vectors that are null, all
    zero, hold null or non-finite components or have another length than most take no part, nor do rows without an id. Rows
    that repeat an id count once. Ties go to the smaller id. With fewer than ``k`` candidates all are returned. Other columns
    are not read; an empty table gives an empty result. At the driver stand the sample's projections and the cells' bounds,
    at most ``SAMPLE`` and ``MOST_CELLS`` rows.
    """
    spark = df.sparkSession
    rows = written(usable(df, vec_id, embedding), "vectors")
    square = F.aggregate(F.col("vector"), F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.max(square).alias("most"))
    chosen = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if chosen is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, most = chosen["size"], chosen["most"]
    rows = rows.where(F.size("vector") == dim)
    random, limit = directions(dim, projections, seed), chi_square_quantile(confidence, projections)
    axes = [f"p{i}" for i in range(projections)]
    kind = rows.schema["vector"].dataType.simpleString()
    point = "id long, " + ", ".join(f"{a} double" for a in axes)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            yield pa.RecordBatch.from_arrays([b.column("id"), *project(matrix(b, dim), most, random).T], ["id", *axes])

    smallest = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).mapInArrow(projected, point).select(*axes).collect()
    tree = Cells(np.array([tuple(r) for r in smallest], float), min(MOST_CELLS, max(cells, -(-chosen["n"] // part))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            points = project(matrix(b, dim), most, random)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), tree.assign(points).astype(np.int32), *points.T], ["id", "vector", "cell", *axes])

    stored = written(rows.select("id", "vector").mapInArrow(placed, f"id long, vector {kind}, cell int, " + ", ".join(f"{a} double" for a in axes)), "cells")
    boxes = stored.groupBy("cell").agg(F.count("*").alias("n"), *[F.min(a).alias(f"low_{a}") for a in axes], *[F.max(a).alias(f"high_{a}") for a in axes]).orderBy("cell").collect()
    names = np.array([r["cell"] for r in boxes], np.int32)
    low, high = (np.array([[r[f"{side}_{a}"] for a in axes] for r in boxes]) for side in ("low", "high"))
    parts = {r["cell"]: -(-r["n"] // part) for r in boxes}

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            near = distances(matrix(b, dim) @ random[:-1], low, high).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.array(names[near])], ["id", "vector", "home"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            q, kth = matrix(b, dim), b.column("floor").to_numpy(zero_copy_only=False).astype(float)
            kth = np.where(np.isnan(kth), -np.inf, kth)
            left = limit * open_within(kth, np.einsum("nd,nd->n", q, q), most)
            # the home cell stays in, for its other parts
            row, cell = np.nonzero((distances(q @ random[:-1], low, high) <= left[:, None]) | (b.column("home").to_numpy()[:, None] == names))
            for at in range(0, len(row), SLICE):
                take = pa.array(row[at:at + SLICE])
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(take) for n in ("id", "vector", "home", "floor")), pa.array(names[cell[at:at + SLICE]])],
                                                 ["id", "vector", "home", "floor", "cell"])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        floor = right.column("floor").to_numpy().astype(float)
        query_ids = right.column("id").to_numpy()
        found, best = search(left.column("id").to_numpy(), matrix(left, dim), query_ids, matrix(right, dim), k, projections, confidence, leaf, seed, most,
                             np.where(np.isnan(floor), -np.inf, floor))
        ok = np.isfinite(best)
        return pa.table({"query_id": pa.array(query_ids, pa.int64()), "ids": pa.array([f[o] for f, o in zip(found, ok)], pa.list_(pa.int64())),
                         "scores": pa.array([b[o] for b, o in zip(best, ok)], pa.list_(pa.float64()))})

    def searched(pairs: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of queries sent to (cell, part): a part meets its queries block by block."""
        counts = pairs.groupBy("cell", "part").agg(F.count("*").alias("q")).groupBy("cell").agg(F.max("q").alias("q")).collect()
        about = F.broadcast(spark.createDataFrame([(r["cell"], parts[r["cell"]], -(-r["q"] // block)) for r in counts], "cell int, parts int, blocks int"))  # one row a cell
        held = stored.select("id", "vector", "cell").join(about, "cell").select(
            "id", "vector", "cell", part_of(F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        asked = pairs.join(about, "cell").select("id", "vector", "floor", "cell", "part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int").alias("block"))
        local = held.groupBy("cell", "part", "block").cogroup(asked.groupBy("cell", "part", "block")).applyInArrow(work, "query_id long, ids array<long>, scores array<double>")
        return local.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("c")).select("query_id", F.col("c.ids").alias("vec_id"), F.col("c.scores").alias("score"))

    def part_of(count):
        return F.pmod(F.xxhash64("id"), count).cast("int")

    sized = F.broadcast(spark.createDataFrame(sorted(parts.items()), "cell int, parts int"))  # one row a cell
    queries = rows.where(F.col("id") % every == 0).select("id", "vector").mapInArrow(homes, f"id long, vector {kind}, home int")
    queries = queries.join(sized.withColumnRenamed("cell", "home"), "home").select("id", "vector", "home", part_of(F.col("parts")).alias("home_part"))
    queries = written(queries, "queries")
    at_home = written(searched(queries.select("id", "vector", F.lit(None).cast("double").alias("floor"), F.col("home").alias("cell"), F.col("home_part").alias("part"))), "at-home")
    kth = at_home.groupBy(F.col("query_id").alias("_q")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    sent = queries.join(kth, F.col("id") == F.col("_q"), "left").select("id", "vector", "home", "floor").mapInArrow(others, f"id long, vector {kind}, home int, floor double, cell int")
    sent = sent.join(sized, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    here = queries.select(F.col("id").alias("_q"), F.col("home").alias("_cell"), F.col("home_part").alias("_part"))
    sent = sent.join(here, (F.col("id") == F.col("_q")) & (F.col("cell") == F.col("_cell")) & (F.col("part") == F.col("_part")), "left_anti")
    away = searched(written(sent.select("id", "vector", "floor", "cell", "part"), "sent"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = at_home.unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
