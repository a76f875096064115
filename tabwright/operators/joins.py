"""Joins: enrichment, lookups, semi joins, key alignment, schema comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col

HOT_SHARE = 0.02
SALTS = 64


def left_enrich(df: DataFrame, per_key: DataFrame, key: str, count_col: str | None = None,
                hot_share: float = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """Join per-key aggregates back onto the rows they came from.

    With ``count_col`` (rows per key in ``per_key``) heavy keys are known, and
    their rows are spread over ``salts`` join partitions; at most 1/hot_share
    keys can be heavy, so that list and its copies stay small.
    """
    if count_col is None:
        return df.join(per_key, key, "left")
    total = per_key.agg(F.sum(count_col)).first()[0] or 0
    hot = [r[0] for r in per_key.filter(F.col(count_col) > F.lit(hot_share * total)).select(key).collect()]
    if not hot:
        return df.join(per_key, key, "left")
    is_hot = col(key).isin(hot)
    # the partition tells equal rows apart, and there may be no other column
    spread = F.pmod(F.xxhash64(*[col(c) for c in df.columns], F.spark_partition_id()), F.lit(salts))
    left = df.withColumn("_salt", F.when(is_hot, spread).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = per_key.withColumn("_salt", F.explode(copies.cast("array<bigint>")))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join to a one-row-per-key table; Spark broadcasts it when its size allows."""
    return df.join(dim, key, "left")


def semi_top(df: DataFrame, name: str, top_n: int = 10) -> DataFrame:
    """Rows whose category is among the top_n most frequent."""
    top = (
        df.filter(col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), F.asc(name)).limit(top_n).select(name)
    )
    return df.join(F.broadcast(top), name, "left_semi")  # top_n rows


def by_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Align predictions, labels and attributes on an explicit key."""
    return left.join(right, list(keys), "inner")


def missing_columns(df: DataFrame, required: DataFrame) -> DataFrame:
    """Required feature names (column ``feature``) absent from the input's schema."""
    return required.filter(~F.col("feature").isin(df.columns)).select("feature")


def column_sets(df: DataFrame, required: DataFrame) -> DataFrame:
    """Rows (feature, place) for the columns of ``df`` and the names in ``required`` (column ``feature``).

    ``place`` is "missing" for a required name that is no column, "extra" for a column that nobody requires and "both"
    otherwise. Names count once and are told apart by case; a null name is none.
    """
    own = F.array(*[F.lit(c) for c in df.columns]).cast("array<string>")
    given = required.sparkSession.range(1).select(F.explode(own).alias("feature"), F.lit(1).alias("_own"), F.lit(0).alias("_wanted"))
    wanted = required.filter("feature is not null").select("feature", F.lit(0).alias("_own"), F.lit(1).alias("_wanted"))
    sides = given.unionByName(wanted).groupBy("feature").agg(F.max("_own").alias("_own"), F.max("_wanted").alias("_wanted"))
    return sides.select("feature", F.when(F.col("_own") == 0, "missing").when(F.col("_wanted") == 0, "extra").otherwise("both").alias("place"))
