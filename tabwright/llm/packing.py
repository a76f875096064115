"""Packing documents into windows of a fixed number of tokens.

Whole windows of a document are cut off first; what is left of it is its residual. The histogram of residual lengths is
at most ``window`` numbers, whatever the table. Shallow combinations that fill a window exactly (one length up to `DEPTH`
times, and one more length) are the columns of a non-negative least-squares problem whose unknowns are how often each is
used; the rounded solution that the histogram can serve is applied. Residuals left over are packed greedily one after
the other, cut where a window ends. Documents find their place by their rank among those of equal residual length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.bpe import ROWS, load, portions
from tabwright.llm.common import buckets_for, running_start, slices, written

WINDOW = 2048
END = 1
#: times a length may be repeated in one combination
DEPTH = 8
#: steps of the least-squares solver
STEPS = 400


def id_type(vocabulary: int) -> str:
    """The smallest little-endian integer that holds every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenized(df: DataFrame, path: str, end: int | None = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table with a unique ``key``, doc_id, the number of ids ``n`` and the ids of each row, ``end`` after them."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        kind, tail = id_type(bpe.size), b"" if end is None else np.array([end], "<u4").tobytes()
        for b in portions(batches):
            ids = [x + tail for x in bpe.encode_batch(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([np.frombuffer(x, "<u4").astype(kind).tobytes() for x in ids], pa.binary())], ["doc_id", "n", "ids"])

    done = rows.mapInArrow(work, "doc_id long, n long, ids binary")
    return written(done.withColumn("key", F.monotonically_increasing_id()), "tokens")


def combinations(window: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (a, m, b) with m times a and once b filling the window, m up to ``depth``; b is 0 if a alone fills it."""
    found = [(a, m, window - m * a) for a in range(1, window) for m in range(1, min(depth, window // a) + 1)]
    found = [(a, m, b) for a, m, b in found if b != a and not (m == 1 and 0 < b < a)]  # (a, 1, b) is (b, 1, a)
    a, m, b = np.array(found, np.int64).reshape(-1, 3).T
    return a, m, b


def non_negative_least_squares(a, m, b, wanted: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that minimises the squared difference of the lengths used, m x at a and x at b, from ``wanted``: accelerated projected gradient."""
    n = len(wanted)

    def used(x):
        out = np.bincount(a, m * x, n) + np.bincount(b, x, n)
        out[0] = 0
        return out

    def back(r):
        return m * r[a] + np.where(b > 0, r[b], 0)

    v = np.ones(len(a))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = back(used(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(used(v))))
    x = y = np.zeros(len(a))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(used(y) - wanted))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass
class Plan:
    """Where the residual of a given length and rank goes. Bounded by window and depth, not by the table."""

    window: int
    low: list[np.ndarray]       # by length: first rank of each slot
    sequence: list[np.ndarray]  # and that slot's first sequence
    offset: list[np.ndarray]
    planned: np.ndarray         # by length: ranks below this have a slot
    tail: np.ndarray            # by length: where the residuals left over begin in the greedy stream
    sequences: int              # of the slots

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the residual, tokens, sequence, offset) of its pieces."""
        if rank < self.planned[length]:
            at = int(np.searchsorted(self.low[length], rank, "right")) - 1
            return [(0, length, int(self.sequence[length][at]) + rank - int(self.low[length][at]), int(self.offset[length][at]))]
        at, out, done = int(self.tail[length]) + (rank - int(self.planned[length])) * length, [], 0
        while done < length:
            seq, off = divmod(at + done, self.window)
            n = min(length - done, self.window - off)
            out.append((done, n, self.sequences + seq, off))
            done += n
        return out


def plan(histogram: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> Plan:
    """From how many residuals have each length (index 0 unused)."""
    a, m, b = combinations(window, depth)
    left, slots, total = histogram.astype(np.int64).copy(), [[] for _ in range(window)], 0
    planned = np.zeros(window, np.int64)
    if len(a) and left.sum():
        x = non_negative_least_squares(a, m, b, histogram.astype(float))
        for p in np.argsort(-x, kind="stable"):
            count = min(int(x[p] + 0.5), left[a[p]] // m[p], left[b[p]] if b[p] else left[a[p]])
            if count < 1:
                continue
            lengths = [int(a[p])] * int(m[p]) + ([int(b[p])] if b[p] else [])
            offset = 0
            for n in lengths:
                slots[n].append((int(planned[n]), total, offset))
                planned[n] += count
                left[n] -= count
                offset += n
            total += int(count)
    tail = np.concatenate([[0], np.cumsum(left * np.arange(window))[:-1]]).astype(np.int64)
    columns = [[np.array([s[k] for s in own], np.int64) for own in slots] for k in range(3)]
    return Plan(window, *columns, planned, tail, total)


def pack(df: DataFrame, path: str, window: int = WINDOW, end: int = END, depth: int = DEPTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; each id is in one piece.

    A null or empty text is one token, ``end``. Sequences are full but for the last. Rows that repeat are packed each for
    itself; a null doc_id stays null. Other columns are not read. An empty table gives an empty result.
    """
    tokens = tokenized(df, path, end, doc_id, text)
    size = tokens.select("key", (F.col("n") % window).alias("length"), F.floor(F.col("n") / window).alias("full"))
    counts = size.groupBy("length").agg(F.count("*").alias("rows"), F.sum("full").alias("full")).collect()  # `window` rows at most
    histogram = np.zeros(window, np.int64)
    for r in counts:
        histogram[r.length] = r.rows
    rows, full = int(histogram.sum()), sum(r.full for r in counts)
    histogram[0] = 0
    buckets = buckets_for(rows)
    layout = plan(histogram, window, depth)
    ranks = running_start(size.where("length > 0").select("key", "length", F.lit(1).alias("one")), "key", "one", buckets, ["length"], "rank")
    fulls = running_start(size.where("full > 0").select("key", "full"), "key", "full", buckets, name="full_start")
    placed = (tokens.join(ranks.select("key", "rank"), "key", "left").join(fulls.select("key", "full_start"), "key", "left")
              .select("doc_id", "n", "ids", F.col("rank").cast("long").alias("rank"), F.col("full_start").cast("long").alias("full_start")))
    kind = id_type(load(path).size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            out = []
            for doc, n, ids, rank, first in zip(*[c.to_pylist() for c in batch.columns]):
                ids = np.frombuffer(ids, kind).astype("<u4")
                whole, rest = divmod(n, window)
                at = whole * window
                pieces = [(i * window, window, first + i, 0) for i in range(whole)]
                pieces += [(at + s, k, full + seq, off) for s, k, seq, off in (layout.places(rest, rank) if rest else [])]
                out += [(doc, s, k, zlib.crc32(ids[s:s + k].tobytes()), n, seq, off) for s, k, seq, off in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7, COLUMNS)

    return placed.mapInArrow(work, ", ".join(f"{c} long" for c in COLUMNS))


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
