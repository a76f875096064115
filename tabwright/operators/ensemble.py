"""Voting, weighting, diversity and the final choice between single and combined models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_double, col
from .aggregates import correlations, pairs, to_rows, wide_agg
from .choose import rank_models
from .metrics import roc_auc

OCCAM_GAIN = 0.005


def diversity(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Rows (model_a, model_b, r, verdict) for every pair of score columns."""
    found = correlations(df, pairs(scores))
    return found.select(
        F.col("column_a").alias("model_a"), F.col("column_b").alias("model_b"), "r",
        F.when(F.col("r") > 0.95, "REDUNDANT").when(F.col("r") > 0.85, "MODERATE").otherwise("DIVERSE").alias("verdict"))


def hard_vote(votes: Sequence[str]) -> Column:
    """Plurality of the vote columns, the smallest class on ties."""
    ballot = F.array_sort(F.array(*[col(v) for v in votes]))
    counted = F.transform(F.array_distinct(ballot), lambda c: F.struct(
        (-F.size(F.filter(ballot, lambda v: v == c))).alias("n"), c.alias("c")))
    return F.array_min(counted)["c"]


def soft_vote(scores: Sequence[str]) -> Column:
    """Mean probability."""
    return reduce(lambda a, b: a + b, [clean_double(s) for s in scores]) / F.lit(float(len(scores)))


def soft_vote_class(vectors: Sequence[str]) -> Column:
    """Class with the largest mean probability over per-model probability arrays."""
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [col(v) for v in vectors])
    return (F.array_position(total, F.array_max(total)) - 1).cast("int")


def weighted_mean(weights: Mapping[str, float]) -> Column:
    """Weighted mean of score columns; the weights need not add up to one."""
    total = sum(weights.values())
    return reduce(lambda a, b: a + b, [clean_double(s) * F.lit(w / total) for s, w in weights.items()])


def auc_weights(df: DataFrame, scores: Sequence[str], y: str = "y") -> dict[str, float]:
    """Weight 1 / (1 - AUC) per score column, all of them ranked in one job."""
    long = df.select(col(y).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(s).alias("model"), clean_double(s).alias("p")) for s in scores])).alias("m")).select("y", "m.*")
    return {r["model"]: 1.0 / max(1.0 - r["roc_auc"], 1e-9) for r in roc_auc(long, by=["model"]).collect()}


def rmse_weights(df: DataFrame, preds: Sequence[str], y: str = "y") -> dict[str, float]:
    """Weight 1 / RMSE per prediction column, from one aggregate."""
    found = wide_agg(df, {p: F.sqrt(F.avg(F.pow(clean_double(p) - clean_double(y), 2))) for p in preds})
    return {p: 1.0 / max(e, 1e-9) for p, e in found.items()}


def weight_table(df: DataFrame, y: str, preds: Sequence[str]) -> DataFrame:
    """Rows (model, rmse, weight) with weights adding up to one."""
    one = df.agg(*[F.sqrt(F.avg(F.pow(clean_double(p) - clean_double(y), 2))).alias(f"e{i}") for i, p in enumerate(preds)])
    inverse = [1.0 / F.greatest(F.col(f"e{i}"), F.lit(1e-9)) for i in range(len(preds))]
    total = reduce(lambda a, b: a + b, inverse)
    return to_rows(one, [
        {"model": F.lit(p), "rmse": F.col(f"e{i}"), "weight": inverse[i] / total} for i, p in enumerate(preds)])


def ensemble_table(results: DataFrame) -> DataFrame:
    """Rank (model, kind, score) rows with the gain over the best single model."""
    best = results.filter(F.col("kind") == "individual").agg(F.max("score")).scalar()
    return rank_models(results.withColumn("gain", F.col("score") - best), "score")


def choose_final(results: DataFrame, min_gain: float = OCCAM_GAIN) -> DataFrame:
    """One row: the best single model, unless an ensemble gains strictly more than ``min_gain``."""
    def top(kind):
        return F.min(F.when(F.col("kind") == kind, F.struct((-F.col("score")).alias("o"), "model", "score")))
    one = results.agg(top("individual").alias("i"), top("ensemble").alias("e"))
    gain = F.col("e.score") - F.col("i.score")
    use = F.coalesce(gain > min_gain, F.col("i.model").isNull())
    return one.select(
        F.when(use, F.col("e.model")).otherwise(F.col("i.model")).alias("model"),
        F.when(use, F.col("e.score")).otherwise(F.col("i.score")).alias("score"),
        F.when(use, "ensemble").otherwise("individual").alias("kind"), gain.alias("gain"))


def trust_label(weight) -> Column:
    """How far a meta-model relies on one base model."""
    size = F.abs(col(weight))
    return F.when(size > 1.0, "HIGH TRUST").when(size > 0.3, "MODERATE").otherwise("LOW TRUST")
