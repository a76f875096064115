"""Splits, folds, nested subsets and class weights, all decided by key hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import HASH_SPACE, col, portable_hash, row_hash
from .prefix import row_numbers

SPLIT_NAMES = ("train", "val", "test")
SPLIT_FRACTIONS = (0.70, 0.15, 0.15)


def key_hash(keys: str | Sequence[str], seed: int = 42, portable: bool = False) -> Column:
    """Hash on 0 .. 2**32-1; ``portable`` is for one whole-number key and other SQL engines."""
    if portable:
        return portable_hash(keys if isinstance(keys, str) else keys[0], seed)
    return row_hash([keys] if isinstance(keys, str) else list(keys), seed)


def _class_rank(df: DataFrame, keys, label: str, seed: int, portable: bool) -> DataFrame:
    """Add ``_rank``, the place of a row by hash among those of its class, for any number of classes."""
    ties = [F.asc(k) for k in ([keys] if isinstance(keys, str) else list(keys))]
    return row_numbers(df.withColumn("_h", key_hash(keys, seed, portable)), [F.asc("_h"), *ties], "_rank", by=[label]).drop("_h")


def split(df: DataFrame, keys, label: str | None = None, fractions: Sequence[float] = SPLIT_FRACTIONS,
          seed: int = 42, exact: bool = False, portable: bool = False) -> DataFrame:
    """Add a ``split`` column. No shuffle: the hash alone decides.

    ``exact=True`` with a label deals out each class by its own hash ranks, so that
    class shares are met to the row; that takes a sort by ranges.
    """
    bounds = [sum(fractions[:i + 1]) for i in range(len(fractions) - 1)]
    if exact and label:
        sizes = df.groupBy(col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_size"))
        ranked = _class_rank(df, keys, label, seed, portable).join(sizes, col(label).eqNullSafe(F.col("_class")))
        at, limits = F.col("_rank") - 1, [F.lit(b) * F.col("_size") for b in bounds]
    else:
        ranked, at, limits = df, key_hash(keys, seed, portable), [F.lit(int(b * HASH_SPACE)) for b in bounds]
    rule = F.lit(SPLIT_NAMES[len(bounds)])
    for name, limit in reversed(list(zip(SPLIT_NAMES, limits))):
        rule = F.when(at < limit, name).otherwise(rule)
    return ranked.withColumn("split", rule).select(*df.columns, "split")


def folds(df: DataFrame, keys, k: int = 10, seed: int = 42, portable: bool = False, label: str | None = None) -> DataFrame:
    """Add ``fold`` 0..k-1. With a label the rows of each class are dealt out in turn, so folds differ by one at most."""
    if label:
        ranked = _class_rank(df, keys, label, seed, portable)
        return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).select(*df.columns, "fold")
    return df.withColumn("fold", F.floor(key_hash(keys, seed, portable) * F.lit(k) / F.lit(HASH_SPACE)).cast("int"))


def nested_subset(keys, fraction: float, seed: int = 42, portable: bool = False) -> Column:
    """Row belongs to the subset of this size; a smaller subset lies inside a larger one."""
    return key_hash(keys, seed, portable) < F.lit(int(fraction * HASH_SPACE))


def split_report(df: DataFrame, label: str) -> DataFrame:
    """Rows (split, n, positive_rate)."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(col(label).cast("double")).alias("positive_rate"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows (class, n, balanced_weight): n / (classes * class count)."""
    counts = df.filter(col(label).isNotNull()).groupBy(col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return counts.select("class", "n", (
        totals.select(F.col("total") / F.col("k")).scalar() / F.col("n")).alias("balanced_weight"))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """One row (positive_rate, positive_weight, count_ratio) for a 0/1 label."""
    y = col(label).cast("double")
    one = df.agg(F.avg(y).alias("positive_rate"), F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    return one.select(
        "positive_rate", F.try_divide(1 - F.col("positive_rate"), F.col("positive_rate")).alias("positive_weight"),
        F.try_divide(F.greatest("p", "n"), F.least("p", "n")).alias("count_ratio"),
    )


def with_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Attach the balanced class weight to every row; a row without a class weighs 1."""
    weights = class_weights(df, label).select(F.col("class").alias("_class"), F.col("balanced_weight").alias(name))
    joined = df.join(weights, col(label) == F.col("_class"), "left").drop("_class")
    return joined.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(1.0)))
