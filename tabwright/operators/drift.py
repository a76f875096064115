"""Training snapshots, drift, daily roll-ups and retraining signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import clean_double, col
from .aggregates import quantiles, to_rows

SNAPSHOT_PROBS = {0.05: "p5", 0.25: "p25", 0.75: "p75", 0.95: "p95"}


def _moments(df: DataFrame, features: Sequence[str], ddof: int, prefix: str = "") -> DataFrame:
    std = F.stddev_samp if ddof else F.stddev_pop
    aggs, records = [], []
    for i, f in enumerate(features):
        x = clean_double(f)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), std(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        records.append({"feature": F.lit(f), f"{prefix}n": F.col(f"n{i}"), f"{prefix}mean": F.col(f"m{i}"),
                        f"{prefix}std": F.col(f"s{i}"), f"{prefix}min": F.col(f"lo{i}"), f"{prefix}max": F.col(f"hi{i}")})
    return to_rows(df.agg(*aggs), records)


def fit_snapshot(df: DataFrame, features: Sequence[str], digits: int = 6, ddof: int = 0) -> DataFrame:
    """Rows (feature, n_train, mean, std, min, max, p5, p25, p75, p95)."""
    shape = _moments(df, features, ddof)
    wide = quantiles(df, features, list(SNAPSHOT_PROBS)).groupBy("column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in SNAPSHOT_PROBS.items()])
    joined = shape.join(wide, F.col("feature") == F.col("column"))
    return joined.select("feature", F.col("n").alias("n_train"), *[
        F.round(c, digits).alias(c) for c in ("mean", "std", "min", "max", "p5", "p25", "p75", "p95")])


def detect_drift(live: DataFrame, snapshot: DataFrame, features: Sequence[str], sigma: float = 2.0,
                 alert_on: Sequence[str] | None = None) -> DataFrame:
    """Rows (feature, train_mean, live_mean, delta_sigma, drifted) from one aggregate of the live rows."""
    watched = [f for f in features if f in live.columns and (alert_on is None or f in alert_on)]
    now = to_rows(live.agg(*[F.avg(clean_double(f)).alias(f"m{i}") for i, f in enumerate(watched)]), [
        {"feature": F.lit(f), "live_mean": F.col(f"m{i}")} for i, f in enumerate(watched)])
    return compare_means(now, snapshot, sigma)


def compare_means(now: DataFrame, snapshot: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Add train_mean, delta_sigma and drifted to rows with feature and live_mean; other columns stay in front."""
    keep = [c for c in now.columns if c not in ("feature", "live_mean")]
    joined = snapshot.select("feature", F.col("mean").alias("train_mean"), "std").join(now, "feature")
    spread = F.when(F.col("std") > 1e-9, F.col("std")).otherwise(1e-9)
    delta = F.abs(F.col("live_mean") - F.col("train_mean")) / spread
    return joined.filter("live_mean is not null").select(
        *keep, "feature", "train_mean", "live_mean", delta.alias("delta_sigma"), (delta > sigma).alias("drifted"))


def daily_scoring_report(df: DataFrame, ts: str, p: str, threshold: float, baseline_rate: float, band_pct: float = 10.0) -> DataFrame:
    """Rows (day, predictions, positive_rate, average_score, change_pct, flagged)."""
    s = clean_double(p)
    daily = df.groupBy(F.to_date(col(ts)).alias("day")).agg(
        F.count(F.lit(1)).alias("predictions"), F.avg((s >= threshold).cast("double")).alias("positive_rate"),
        F.avg(s).alias("average_score"))
    change = (F.col("positive_rate") - F.lit(baseline_rate)) / F.lit(baseline_rate) * 100
    return daily.select("*", change.alias("change_pct"), (F.abs(change) > band_pct).alias("flagged"))


def retrain_signal(periods: DataFrame, baseline: float, max_drop: float = 0.05) -> DataFrame:
    """Add ``signal`` to (feature, period, metric, drifted) rows.

    RETRAIN when the metric fell too far, REVIEW when a feature drifted in two
    consecutive periods.
    """
    order = Window.partitionBy("feature").orderBy("period")
    again = F.col("drifted") & F.coalesce(F.lag("drifted").over(order), F.lit(False))
    low = F.lit(baseline) - F.col("metric") > max_drop
    return periods.withColumn("signal", F.when(low, "RETRAIN").when(again, "REVIEW").otherwise("OK"))
