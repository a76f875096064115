"""Streaming forms drained to the end and compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.drift import fit_snapshot
from ..operators.scoring import linear_probability
from ..session import scratch_path
from ..streaming import streams
from .explore_queries import rounded
from .fixtures import table, with_tables
from .registry import query


def arriving(spark, sf, name):
    """A base table as a stream of its file."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("st1_stream_scoring", """
    select event_id, valid, case when valid then round(1 / (1 + exp(-(0.01e0 * value + (-1e0)))), 4) end as probability,
           case when valid then cast(1 / (1 + exp(-(0.01e0 * value + (-1e0)))) >= 0.5 as int) end as prediction
    from (select event_id, value, event_id % 50 <> 0 as valid from events)""")
def st1(spark, sf):
    stream = arriving(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    scored = streams.score_stream(stream, ["value"], linear_probability({"value": 0.01}, -1.0))
    out = scratch_path(spark, "stream-scores")
    streams.write_scores(scored.drop("errors", "warnings"), f"{out}/rows", f"{out}/progress").awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").withColumn("valid", F.col("valid").cast("boolean"))
    return rows.select("event_id", "valid", "probability", "prediction")


@query("st2_stream_daily_rollup", """
    select cast(cast(ts as date) as string) as day, count(*) as predictions, round(avg(cast(least(value / 200e0, 1) >= 0.3e0 as int)), 6) as positive_rate,
           round(avg(least(value / 200e0, 1)), 6) as average_score
    from events group by cast(ts as date)""")
def st2(spark, sf):
    stream = arriving(spark, sf, "events").withColumn("p", F.least(F.col("value") / 200, F.lit(1.0)))
    out = scratch_path(spark, "stream-days")
    streams.write_updates(streams.daily_rollup(stream, "ts", "p", 0.3), f"{out}/rows", f"{out}/progress").awaitTermination()
    days = streams.latest(spark, f"{out}/rows", ["day"]).withColumn("day", F.col("day").cast("string"))
    return rounded(days, 6, "positive_rate", "average_score")


@query("st3_stream_drift", with_tables("""
    select cast(date_trunc('week', ts) as date)::string as period, 'shifted' as feature, round(avg(shifted), 4) as live_mean,
           abs(avg(shifted) - (select avg(value) from events)) / (select stddev_pop(value) from events) > 0.5 as drifted
    from {events_drift} group by date_trunc('week', ts)"""))
def st3(spark, sf):
    shifted = F.expr("case when ts < date '2024-01-16' then value else value * 3 + 20 end")
    stream = arriving(spark, sf, "events").withColumn("shifted", shifted)
    snapshot = fit_snapshot(table(spark, sf, "events").select(F.col("value").alias("shifted")), ["shifted"])
    out = scratch_path(spark, "stream-drift")
    streams.weekly_drift(stream, "ts", snapshot, ["shifted"], f"{out}/rows", f"{out}/progress", sigma=0.5).awaitTermination()
    found = streams.latest(spark, f"{out}/rows", ["period", "feature"])
    return found.select("period", "feature", F.round("live_mean", 4).alias("live_mean"), "drifted")
