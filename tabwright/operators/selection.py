"""Feature selection by variance, importance and redundancy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import quantile_values, variances
from .explore import corr_pairs

LOW_VARIANCE, LOW_IMPORTANCE, REDUNDANT = 0.01, 0.001, 0.90


def variance_filter(df: DataFrame, cols: Sequence[str], limit: float = LOW_VARIANCE, ddof: int = 1) -> DataFrame:
    """Rows (column, variance, kept)."""
    return variances(df, cols, ddof).select("column", "variance", (F.col("variance") >= limit).alias("kept"))


def importance_filter(importances: DataFrame, limit: float = LOW_IMPORTANCE) -> DataFrame:
    """Rows (feature, importance) that reach the limit."""
    return importances.filter(F.col("importance") >= limit)


def redundancy_filter(pairs_r: DataFrame, importances: DataFrame, limit: float = REDUNDANT) -> DataFrame:
    """Features to drop: in each pair above the limit the less important one, all pairs judged at once.

    Ties drop the pair's first column, in the order the pairs are given.
    """
    imp = importances.select("feature", "importance")
    close = pairs_r.filter(F.abs("r") > limit)
    both = close.join(imp.withColumnsRenamed({"feature": "column_a", "importance": "imp_a"}), "column_a").join(
        imp.withColumnsRenamed({"feature": "column_b", "importance": "imp_b"}), "column_b")
    loser = F.when(F.col("imp_b") >= F.col("imp_a"), F.col("column_a")).otherwise(F.col("column_b"))
    return both.select(loser.alias("feature")).distinct()


def top_importance(importances: DataFrame, k: int = 20, highlight: float = 0.7) -> DataFrame:
    """The k most important features; the upper part of them is highlighted."""
    top = importances.orderBy(F.desc("importance"), "feature").limit(k)
    cut = quantile_values(top, ["importance"], [highlight])["importance"][0]
    return top.select("feature", "importance", (F.col("importance") >= F.lit(cut)).alias("highlight"))


def selection_report(df: DataFrame, cols: Sequence[str], importances: DataFrame) -> DataFrame:
    """Rows (feature, kept, reason) after all three rules."""
    low = variance_filter(df, cols).filter(~F.col("kept")).select(F.col("column").alias("feature"), F.lit("low variance").alias("reason"))
    usable = importances.join(low, "feature", "left_anti")
    noise = usable.filter(F.col("importance") < LOW_IMPORTANCE).select("feature", F.lit("low importance").alias("reason"))
    useful = importance_filter(usable)
    redundant = redundancy_filter(corr_pairs(df, cols), useful).select("feature", F.lit("redundant").alias("reason"))
    dropped = low.unionByName(noise).unionByName(redundant)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(dropped, "feature", "left").select("feature", F.col("reason").isNull().alias("kept"), "reason")
