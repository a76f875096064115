"""Segments: fitting, choosing their number, appending them, describing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_double, col
from .aggregates import to_rows
from .models import SEED, assembler
from .scoring import fill_missing_features


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return assembler(features).transform(fill_missing_features(df, features))


def elbow(df: DataFrame, features: Sequence[str], ks: Sequence[int] = tuple(range(2, 9)), seed: int = SEED) -> DataFrame:
    """Rows (k, cost, silhouette) of k-means for each number of segments; the rows are kept for all fits."""
    rows = _vectors(df, features).select("features").persist()
    try:
        found = []
        for k in ks:
            model = KMeans(k=k, seed=seed).fit(rows)
            quality = ClusteringEvaluator().evaluate(model.transform(rows))
            found.append((k, float(model.summary.trainingCost), float(quality)))
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(found, "k int, cost double, silhouette double")


def fit_segments(df: DataFrame, features: Sequence[str], k: int, seed: int = SEED) -> KMeansModel:
    return KMeans(k=k, seed=seed).fit(_vectors(df, features))


def append_segment(df: DataFrame, model: KMeansModel, features: Sequence[str], name: str = "segment") -> DataFrame:
    """The table with one more column; a missing feature counts as 0, and the others stay as they are."""
    packed = df.select(F.struct("*").alias("_row"), *[col(f) for f in features])
    return model.transform(_vectors(packed, features)).select("_row.*", F.col("prediction").alias(name))


def cluster_profile(df: DataFrame, segment: str, features: Sequence[str]) -> DataFrame:
    """Rows (segment, feature, n, mean, global_mean, difference) over present values; one scan, then one row per segment."""
    per = df.groupBy(col(segment).alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(clean_double(f)).alias(f"s{i}") for i, f in enumerate(features)],
        *[F.count(clean_double(f)).alias(f"c{i}") for i, f in enumerate(features)])
    rows = to_rows(per, [{"feature": F.lit(f), "total": F.col(f"s{i}"), "present": F.col(f"c{i}")} for i, f in enumerate(features)], keep=["segment", "n"])
    whole = rows.groupBy(F.col("feature").alias("_f")).agg(F.try_divide(F.sum("total"), F.sum("present")).alias("global_mean"))
    mean = F.try_divide(F.col("total"), F.col("present"))
    return rows.join(whole, F.col("feature") == F.col("_f")).select(
        "segment", "feature", "n", mean.alias("mean"), "global_mean", (mean - F.col("global_mean")).alias("difference"))


def principal_components(df: DataFrame, features: Sequence[str], k: int = 2) -> DataFrame:
    """Rows (component, explained, loadings) of the k strongest components."""
    model = PCA(k=k, inputCol="features", outputCol="components").fit(_vectors(df, features))
    loadings = model.pc.toArray()
    rows = [(i + 1, float(v), [float(x) for x in loadings[:, i]]) for i, v in enumerate(model.explainedVariance.toArray())]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, loadings array<double>")
