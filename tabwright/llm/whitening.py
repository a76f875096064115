"""Embedding whitening: principal axes of the distinct vectors, refined to full double precision.

Components of vectors become whole numbers, 256 to a unit, so counts, sums and the covariance of the distinct vectors
come from exact integer sums over all tasks, whatever the order. Eigenvectors are then found in single precision and
corrected by Ogita and Aishima's iteration, a few matrix products in extended precision: with R = I - X'X and S = X'AX,

    X <- X + X E,  E_ij = (S_ij + l_j R_ij) / (l_j - l_i),  l_i = S_ii / (1 - R_ii),

which doubles the right digits each time. Where eigenvalues are too close for that quotient, E_ij = R_ij / 2 only keeps
the axes orthogonal, and the axes of the whole cluster are turned by a small eigenproblem of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import slices, written

SCALE, COMPONENTS = 256, 4
#: rows whose products are added up at once; whole numbers below `SMALL` then stay exact in a double
ROWS, SMALL = 512, 2**21
#: largest number of corrections; each doubles the right digits of the seven that single precision gives
ROUNDS = 12
#: eigenvalues closer than this share of the largest are a cluster from the start
CLOSE = 1e-9
_WIDE = np.longdouble
_LONG = 2**63


def whole_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x) of the rows that take part, x being floor(256 c) of each entry c as a double, within the range of a long."""
    c = F.col(vector).cast("array<double>")
    fit = F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), c.alias("c")).where(fit).select(
        "vec_id", F.transform("c", lambda v: F.floor(v * SCALE).cast("long")).alias("x"))


def one_width(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The vectors of the most frequent length, the smaller one on ties, and that length; 0 if there is none."""
    sizes = vectors.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), "width").first()
    return (vectors.where(F.size("x") == best.width), best.width) if best else (vectors, 0)


def rows_of(batch: pa.RecordBatch, at: int) -> np.ndarray:
    """A column of lists of one width as a matrix."""
    lists = batch.column(at)
    return np.asarray(lists.flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), np.int64)


def exact_product(x: np.ndarray) -> np.ndarray:
    """x' x of whole numbers, exact: in doubles where all sums fit their 53 bits, else in Python's integers."""
    if len(x) <= ROWS and (not x.size or max(abs(int(x.max())), abs(int(x.min()))) < SMALL):
        d = x.astype(np.float64)
        return (d.T @ d).astype(np.int64).astype(object)
    o = x.astype(object)
    return o.T.dot(o)


def _summed(fit_list: DataFrame, width: int, work) -> np.ndarray:
    """Exact sum over all tasks of what ``work`` gives for a matrix of rows: one row per task and number, combined in Spark.

    ``width`` numbers come to the driver.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for b in slices(batches, ROWS):
            if b.num_rows:
                total = total + work(rows_of(b, 0)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(int(v)) for v in total], pa.string())], ["i", "v"])

    sums = fit_list.select("x").mapInArrow(task, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v"))
    out = np.zeros(width, object)
    for r in sums.collect():
        out[r.i] = int(r.v)
    return out


def covariance(fit_list: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the sums S and the exact covariance (fractions over n^2 as integers): entry = value / n^2.

    Rows are centred at the whole numbers nearest to the mean before they are multiplied, and the rest of the mean, at
    most one half, is taken off exactly.
    """
    sums = _summed(fit_list, width + 1, lambda x: np.concatenate([[len(x)], x.sum(axis=0, dtype=object)]))
    n, total = int(sums[0]), sums[1:]
    if n == 0:
        return 0, total, np.zeros((width, width), object)
    centre = np.array([(2 * int(s) + n) // (2 * n) for s in total], object)
    near = centre.astype(np.int64)

    def work(x):
        # int64 may not hold the difference of extreme values
        inside = x.size == 0 or max(abs(int(x.max())), abs(int(x.min())), int(abs(near).max())) < 2**61
        return exact_product(x - near if inside else x.astype(object) - centre)

    gram = _summed(fit_list, width * width, work).reshape(width, width)
    rest = total - n * centre
    return n, total, n * gram - np.outer(rest, rest)


def wide(numerators: np.ndarray, denominator: int) -> np.ndarray:
    """Fractions in extended precision, rounded once."""
    def one(v):
        high = Fraction(int(v), denominator)
        first = float(high)
        return _WIDE(first) + _WIDE(float(high - Fraction(first)))
    return np.array([one(v) for v in np.asarray(numerators, object).ravel()], _WIDE).reshape(np.shape(numerators))


def refine(a: np.ndarray, x: np.ndarray, least: float = CLOSE) -> tuple[np.ndarray, list[np.ndarray], float]:
    """One Ogita-Aishima correction of the eigenvectors in the columns of ``x``, in the precision of ``a``.

    Returns the vectors by rising eigenvalue, the clusters of eigenvalues that this correction cannot tell apart, and the
    largest correction. Neighbours are in one cluster if they differ by less than the error of S and R, or by ``least``.
    """
    n = len(a)
    r, s = np.eye(n, dtype=a.dtype) - x.T @ x, x.T @ (a @ x)
    value = np.diag(s) / (1 - np.diag(r))
    order = np.argsort(value, kind="stable")
    x, value, r, s = x[:, order], value[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
    error = 2 * (np.linalg.norm((s - np.diag(np.diag(s))).astype(float)) + np.linalg.norm(r.astype(float)) * float(np.abs(value).max()))
    cluster = np.concatenate([[0], np.cumsum(np.diff(value.astype(float)) > max(error, least))])
    apart = cluster[:, None] != cluster[None, :]
    e = np.where(apart, (s + value[None, :] * r) / np.where(apart, value[None, :] - value[:, None], 1), r / 2)
    runs = [np.flatnonzero(cluster == c) for c in np.unique(cluster)]
    return x + x @ e, [run for run in runs if len(run) > 1], float(np.abs(e).max())


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns of a symmetric matrix in extended precision.

    Single precision gives the first vectors. Each round corrects them, then turns the axes of every cluster to those of
    the cluster's own small matrix, from which its mean value is taken off, so that double precision solves it to the
    last bits of the cluster's width. It ends when a round corrects nothing above the last bits of a double.
    """
    size = float(np.abs(a).max()) if a.size else 0.0
    if size == 0.0:
        return np.zeros(len(a), _WIDE), np.eye(len(a), dtype=_WIDE)
    a = a / _WIDE(size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(_WIDE)
    for _ in range(ROUNDS):
        x, clusters, moved = refine(a, x)
        for run in clusters:
            axes, own = x[:, run], np.arange(len(run))
            t = axes.T @ (a @ axes)
            t[own, own] -= np.trace(t) / len(run)
            wide_as = np.abs(t).max()
            if wide_as > 0:
                x[:, run] = axes @ np.linalg.eigh(((t + t.T) / (2 * wide_as)).astype(float))[1].astype(_WIDE)
        if moved < 1e-16:
            break
    for _ in range(2):  # the turns are orthogonal to the precision of doubles only
        x = x + x @ (np.eye(len(a), dtype=_WIDE) - x.T @ x) / 2
    value = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    order = np.argsort(-value, kind="stable")
    return value[order] * _WIDE(size), x[:, order]


@dataclass
class Whitening:
    """A fitted transform: x of ``width`` entries, centred at ``sums`` / ``n``, goes to the columns of ``axes`` over the root of ``values``."""

    n: int
    sums: list[int]
    values: np.ndarray     # eigenvalues of all axes, falling, in doubles
    axes: np.ndarray       # (width, components), in doubles; an axis' largest entry is positive
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> np.ndarray:
        return self.values[:self.axes.shape[1]] / self.trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once: the whole part is taken off before the fraction."""
        whole = np.array([s // self.n for s in self.sums], object)
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])
        small = x.size == 0 or max(abs(int(x.max())), abs(int(x.min()))) < 2**61 and max(map(abs, whole)) < 2**61
        part = x - whole.astype(np.int64) if small else x.astype(object) - whole
        return part.astype(np.float64) - rest

    def transform(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.values[:self.axes.shape[1]]))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n x - S)^2, exact; none where a long does not hold it."""
        squared = sum(s * s for s in self.sums)
        small = x.size == 0 or max(abs(int(x.max())), abs(int(x.min()))) < 2**28 // max(1, self.width)
        lengths = (x * x).sum(axis=1).tolist() if small else [sum(v * v for v in r) for r in x.tolist()]
        biggest = max(map(abs, self.sums), default=0)
        if small and biggest * self.width < 2**34:
            products = (x @ np.array(self.sums, np.int64)).tolist()
        else:
            products = x.astype(object).dot(np.array(self.sums, object)).tolist()
        found = (self.n * self.n * q - 2 * self.n * p + squared for q, p in zip(lengths, products))
        return [v if v < _LONG else None for v in found]


def fit(fit_list: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The transform of the rows (x) of ``fit_list``, one per distinct vector; none without any rows.

    It has at most ``components`` axes, and only those whose eigenvalue is above rounding.
    """
    n, sums, numerators = covariance(fit_list, width) if width else (0, None, None)
    if not n:
        return None
    values, axes = eigen(wide(numerators, n * n))
    trace = float(Fraction(int(np.trace(numerators)), n * n))
    values = values.astype(float)
    keep = min(components, int((values > width * 2.0**-50 * max(values.max(), 0.0)).sum()))
    axes = axes[:, :keep].astype(float)
    if keep:
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(keep)])
    return Whitening(n, [int(s) for s in sums], values, axes, trace)


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity: their means in one pass, then products of centred rows.

    Sums are of doubles scaled to whole numbers of 2^-40, so that they do not depend on the order of tasks.
    """
    k, unit = model.axes.shape[1], 2.0**40

    def rounded(v):
        return np.array([int(round(float(u) * unit)) for u in v.ravel()], object)

    mean = _summed(fit_list, k, lambda x: rounded(model.transform(x).sum(axis=0))).astype(float) / unit / model.n

    def products(x):
        w = model.transform(x) - mean
        return rounded(w.T @ w)

    found = _summed(fit_list, k * k, products).astype(float).reshape(k, k) / unit / model.n
    return float(np.abs(found - np.eye(k)).max())


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row of ``df`` that takes part and per component: vec_id, component, n, deviation, whitened, explained, identity_error.

    A row takes part unless its vector is null, empty, of another length than most, or holds a null or a non-finite entry.
    Entries become x = floor(256 c), at most the ends of a long's range. The axes are those of the distinct vectors' x,
    numbered from 1 by falling eigenvalue, an axis' largest entry positive; equal eigenvalues leave their axes open within
    the plane they share. Axes without any spread give no rows, so one vector, however often it is repeated, or an
    empty table gives an empty result. ``deviation`` is null where a long cannot hold it. Repeated rows, and rows that share or
    lack a vec_id, each get their own. Other columns are not read. Sums are exact for |x| up to 2^50.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors, width = one_width(whole_vectors(df, vec_id, vector))
    fit_list = written(vectors.select("x").distinct(), "fit-list")
    model = fit(fit_list, width, components)
    if model is None or not model.axes.shape[1]:
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(fit_list, model), model.axes.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            if not b.num_rows:
                continue
            x = rows_of(b, 1)
            rows = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(model.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), model.n, np.int64)),
                deviation.take(pa.array(rows)), pa.array(model.transform(x).ravel()), pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(len(rows), error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(work, schema)
