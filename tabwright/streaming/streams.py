"""Continuous forms of scoring, daily roll-ups and drift checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import clean_double, col, decide, risk_tier
from ..operators.aggregates import to_rows
from ..operators.drift import compare_means
from ..operators.scoring import fill_missing_features, validate_rows


def score_stream(stream: DataFrame, features: Sequence[str], probability: Column, threshold: float = 0.5) -> DataFrame:
    """Validate and score each arriving row; invalid rows carry no score. Stateless, so it scales with the input."""
    checked = validate_rows(stream, features)
    scored = fill_missing_features(checked, features).withColumn("_p", F.when(F.col("valid"), probability))
    return scored.withColumns({
        "probability": F.round("_p", 4), "prediction": F.when(F.col("valid"), decide("_p", threshold)),
        "risk_tier": F.when(F.col("valid"), risk_tier("_p")),
    }).drop("_p")


def write_scores(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Good and quarantined rows land in separate partitions of one exactly-once parquet sink."""
    return (
        scored.writeStream.format("parquet").partitionBy("valid").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def daily_rollup(stream: DataFrame, ts: str, p: str, threshold: float, lateness: str = "1 day") -> DataFrame:
    """Predictions, positive rate and average score per day. State is one row per open day."""
    s = clean_double(p)
    rows = stream.withColumn("_ts", col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    daily = rows.groupBy(F.window("_ts", "1 day")).agg(
        F.count(F.lit(1)).alias("predictions"), F.avg((s >= threshold).cast("double")).alias("positive_rate"),
        F.avg(s).alias("average_score"))
    return daily.select(F.to_date("window.start").alias("day"), "predictions", "positive_rate", "average_score")


def weekly_means(stream: DataFrame, ts: str, features: Sequence[str], lateness: str = "1 day") -> DataFrame:
    """Mean of each feature per week from Monday, as rows (period, feature, live_mean). State is one row per open week."""
    rows = stream.withColumn("_ts", col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    # windows count from a Thursday, the first day of the epoch
    weekly = rows.groupBy(F.window("_ts", "7 days", "7 days", "4 days")).agg(*[F.avg(clean_double(f)).alias(f"m{i}") for i, f in enumerate(features)])
    return to_rows(weekly.withColumn("period", F.to_date("window.start").cast("string")), [
        {"feature": F.lit(f), "live_mean": F.col(f"m{i}")} for i, f in enumerate(features)], keep=["period"])


def write_updates(rows: DataFrame, path: str, checkpoint: str, finish: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> StreamingQuery:
    """Write what each micro-batch changes, open days and weeks too, into a folder of its own.

    A repeated batch overwrites its folder and leaves one copy. `latest` reads the current rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        finish(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
        .trigger(availableNow=True).start())


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key that `write_updates` has written."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in {*keys, "batch"}]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return newest.select(*keys, "r.*")


def weekly_drift(stream: DataFrame, ts: str, snapshot: DataFrame, features: Sequence[str], path: str, checkpoint: str, sigma: float = 2.0) -> StreamingQuery:
    """Compare the mean of every week, open ones too, with the training snapshot."""
    return write_updates(weekly_means(stream, ts, features), path, checkpoint, lambda batch: compare_means(batch, snapshot, sigma))
