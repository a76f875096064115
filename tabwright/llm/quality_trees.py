"""Quality classifier: gradient-boosted trees on binned document statistics.

Statistics come from whole texts, in Arrow batches. The trees are grown on histograms of a bounded sample of labelled
rows and kept as complete trees flattened into arrays, so scoring a batch is a few array look-ups per level for all trees
at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import kept_rows, slices

#: most labelled rows that the trees are grown on
SAMPLE = 20_000
TREES, DEPTH, BINS = 80, 4, 32
RATE, LEAST_WEIGHT, RIDGE = 0.15, 0.3, 1.0
#: score from which the predicted label is 1
CUT = 0.3

FEATURES = ["log_bytes", "letters", "digits", "upper", "spaces", "newlines", "sentence_marks", "pipes", "symbols", "wide_bytes", "byte_entropy",
            "log_words", "word_bytes", "distinct_words", "longest_word", "log_lines", "distinct_lines", "line_bytes", "words_with_symbols", "short_words"]

_BYTE = np.arange(256)
_CHR = np.array([chr(i) for i in range(128)] + ["x"] * 128)
_LETTER = (np.char.isalpha(_CHR) & (_BYTE < 128)) | (_BYTE >= 128)
_DIGIT, _UPPER = np.char.isdigit(_CHR) & (_BYTE < 128), np.char.isupper(_CHR) & (_BYTE < 128)
_MARK = np.isin(_BYTE, [ord(c) for c in ".,;:!?'\"-"])
_SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_SYMBOL = ~(_LETTER | _DIGIT | _MARK | _SPACE)


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of `FEATURES` per text; an empty or null text is all zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n = len(raw)
        counts = np.bincount(raw, minlength=256)
        words, lines = text.split(), text.split("\n")
        share = counts / n
        seen = share[share > 0]
        distinct = set(words)
        w = max(1, len(words))
        odd = sum(not x[-1].isalnum() and x[-1] not in ".,;:!?'\"-)" for x in words)
        out[i] = [
            np.log1p(n), share[_LETTER].sum(), share[_DIGIT].sum(), share[_UPPER].sum(), share[_SPACE].sum(), share[10], share[_MARK].sum(), share[124],
            share[_SYMBOL].sum(), share[128:].sum(), -(seen * np.log2(seen)).sum(), np.log1p(len(words)), counts[~_SPACE].sum() / w, len(distinct) / w,
            max(map(len, distinct), default=0), np.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines), odd / w,
            sum(len(x) <= 3 for x in words) / w]
    return out


@dataclass
class Trees:
    """Complete trees: node k has children 2k+1 and 2k+2; a value above the threshold goes to the second."""

    feature: np.ndarray    # (trees, 2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray       # (trees, 2^depth)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        t, node, rows = np.arange(trees), np.zeros((len(x), trees), np.int64), np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[t, node - inner].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Fit by Newton steps on the logistic loss, each split from histograms of gradients per feature and bin.

    Without rows, or with one label only, there are no trees and the score is the smoothed share of label 1.
    """
    n, k = x.shape
    p = (y.sum() + 1) / (n + 2)
    inner, leaves, base = 2**depth - 1, 2**depth, float(np.log(p / (1 - p)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(k)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(k)], axis=1)  # bin b: at most edges[b]
    column = np.arange(k) * bins
    z, out = np.full(n, base), ([], [], [])
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        g, h = y - q, q * (1 - q)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (k * bins) + column + binned).ravel()
            gh = [np.bincount(at, np.repeat(v, k), width * k * bins).reshape(width, k, bins) for v in (g, h)]
            (gl, hl), (gt, ht) = [v.cumsum(axis=2) for v in gh], [v.sum(axis=2, keepdims=True) for v in gh]
            gain = gl**2 / (hl + RIDGE) + (gt - gl)**2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            f, b = np.divmod(best, bins)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            for j in np.flatnonzero(good):
                if b[j] < len(edges[f[j]]):
                    feature[first + j], threshold[first + j] = f[j], edges[f[j]][b[j]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        z = z + value[leaf]
        for to, v in zip(out, (feature, threshold, value)):
            to.append(v)
    return Trees(*[np.array(v) for v in out], base)


def held_out(doc_id: str, parts: int):
    """Remainder of the checksum of the id's text, by which rows are kept from learning; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def learn_quality(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from the labelled rows whose id's remainder by 5 is not 0; of those, the ``sample`` with the smallest hashes of their ids."""
    chosen = (labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
              .where(held_out("id", 5) != 0).orderBy(F.xxhash64("id"), "id", "y").limit(sample))
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = statistics(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    found = rows.mapInArrow(work, "id string, y int, x array<double>").orderBy("id", "y", "x").limit(sample).collect()
    return grow(np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([r.y > 0 for r in found], float))


def score_quality(df: DataFrame, model: Trees, doc_id: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, score (0 to 1), predicted.

    Only the text is an input. Null and empty texts are scored by statistics that are all zero, repeated rows alike; a
    null doc_id stays null and counts as not held out. Other columns are not read; an empty table gives an empty result.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out(doc_id, 5) == 0, F.lit(False)).alias("held_out"),
                     F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = model.score(statistics(b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(df: DataFrame, model: Trees, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``df`` with all their columns whose text scores at least ``cut``."""
    return kept_rows(df, text, lambda texts: model.score(statistics(texts)) >= cut)
