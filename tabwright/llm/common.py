"""Helpers the text operators share: reading tables, batches of rows in Python, row numbers without one big sort."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.session import scratch_path

#: rows that one bucket of `running_start` sorts together
ROWS_PER_BUCKET = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str):
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into small ones, so that what Python holds at a time stays small whatever the texts are."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def let_go() -> None:
    """Give memory that is no longer used back to the system: a Python worker outlives its task and waits for the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def kept_rows(df: DataFrame, text: str, keep: Callable[[list], np.ndarray], rows: int = 256) -> DataFrame:
    """The rows of ``df``, as they are, whose texts ``keep`` marks; whole rows pass through in small Arrow slices."""
    at = df.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows):
            good = keep(b.column(at).cast(pa.string()).to_pylist())
            if good.any():
                yield b.filter(pa.array(good))
        let_go()

    return df.mapInArrow(work, df.schema)


def buckets_for(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET, least: int = 64) -> int:
    """How many hash buckets hold about ``rows_per_bucket`` rows each; follows the table without a limit."""
    return max(least, -(-rows // rows_per_bucket))


def running_start(df: DataFrame, key: str, weight: str, buckets: int, by: list[str] = (), name: str = "first") -> DataFrame:
    """Add the sum of ``weight`` over all rows before this one, within each value of ``by``.

    Rows are ordered by a hash bucket of ``key`` and then by ``key``, which must be unique. Each bucket is summed on its
    own; the totals of the buckets are then accumulated, so no task sees more than one bucket of one ``by`` value.
    """
    by = list(by)
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    totals = spread.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_total"))
    # a second level of groups of buckets keeps the accumulation parallel too
    totals = totals.withColumn("_group", F.floor(F.col("_bucket") / F.lit(1024)).cast("int"))
    inside = Window.partitionBy(*by, "_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    above = (totals.groupBy(*by, "_group").agg(F.sum("_total").alias("_sum"))
             .withColumn("_above", F.coalesce(F.sum("_sum").over(Window.partitionBy(*by, F.lit(0)).orderBy("_group")
                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum"))
    starts = (totals.withColumn("_inside", F.coalesce(F.sum("_total").over(inside), F.lit(0)))
              .join(above, [*by, "_group"]).select(*by, "_bucket", (F.col("_inside") + F.col("_above")).alias("_start")))
    own = Window.partitionBy(*by, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (spread.withColumn("_own", F.coalesce(F.sum(weight).over(own), F.lit(0)))
            .join(starts, [*by, "_bucket"]).withColumn(name, F.col("_own") + F.col("_start")).drop("_bucket", "_own", "_start"))


def by_rows(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the table: both sides are shuffled. Spark takes exploded rows for as many as before, and
    compressed files for the rows they hold, and would send such a side whole through the driver.
    """
    return side.hint("merge")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Like `cut_lineage`, with a codec that keeps the shared folder small."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
