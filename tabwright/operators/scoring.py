"""Batch scoring, per-row input validation, linear attribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import clean_double, col, decide, is_missing, risk_tier


def as_number(name: str) -> Column:
    """Double value; NaN and text that is no number count as missing."""
    return F.nanvl(col(name).try_cast("double"), F.lit(None).cast("double"))


def fill_missing_features(df: DataFrame, features: Sequence[str], value: float = 0.0) -> DataFrame:
    """Every feature present and not missing: absent columns are added with the default."""
    made = {}
    for f in features:
        made[f] = F.coalesce(as_number(f), F.lit(value)) if f in df.columns else F.lit(value)
    return df.withColumns(made)


def linear_probability(coefficients: Mapping[str, float], intercept: float = 0.0) -> Column:
    """Logistic score of a linear model as plain column arithmetic."""
    z = reduce(lambda a, b: a + b, [F.lit(w) * col(f) for f, w in coefficients.items()], F.lit(intercept))
    return 1.0 / (1.0 + F.exp(-z))


def top_reasons(weights: Mapping[str, float], k: int = 3, digits: int = 4) -> Column:
    """The k features with the largest |weight x value|, as an array of structs; ties by name."""
    entries = F.array(*[
        F.struct(F.coalesce(-F.abs(F.lit(w) * col(f)), F.lit(0.0)).alias("o"), F.lit(f).alias("feature"),
                 F.round(F.lit(w), digits).alias("importance"), F.round(col(f), digits).alias("value"))
        for f, w in weights.items()
    ])
    return F.transform(F.slice(F.sort_array(entries), 1, k), lambda e: F.struct(e["feature"], e["importance"], e["value"]))


def score_table(df: DataFrame, probability: Column, weights: Mapping[str, float], threshold: float = 0.5,
                version: str = "v1", high: float = 0.70, medium: float = 0.40) -> DataFrame:
    """Add probability, prediction, risk tier, reasons, version and scoring time."""
    raw = df.withColumn("_p", probability)
    return raw.withColumns({
        "prediction": decide("_p", threshold), "probability": F.round("_p", 4), "risk_tier": risk_tier("_p", high, medium),
        "top_reasons": top_reasons(weights), "model_version": F.lit(version), "scored_at": F.current_timestamp(),
    }).drop("_p")


def validate_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``valid``, ``errors`` and ``warnings`` to every row.

    A feature column that is absent or a value that is not a number is an error; a
    missing value is a warning, because scoring fills it with 0.
    """
    absent = [f for f in features if f not in df.columns]
    errors: list[Column] = [F.lit(f"missing feature: {f}") for f in absent]
    warnings: list[Column] = []
    for f in features:
        if f in absent:
            continue
        kind = df.schema[f].dataType
        warnings.append(F.when(is_missing(f, kind), F.lit(f"null value: {f}")))
        if not isinstance(kind, (T.NumericType, T.BooleanType)):
            errors.append(F.when(col(f).isNotNull() & col(f).try_cast("double").isNull(), F.lit(f"non-numeric value: {f}")))
    texts = lambda parts: F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    return df.withColumn("errors", texts(errors)).withColumn("warnings", texts(warnings)).withColumn(
        "valid", F.size("errors") == 0)


def route_invalid(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows)."""
    checked = validate_rows(df, features)
    return checked.filter("valid").drop("errors", "valid"), checked.filter("not valid")


# attribution of linear models ----------------------------------------------

def linear_contributions(coefficients: Mapping[str, float], means: Mapping[str, float]) -> dict[str, Column]:
    """Exact per-row contribution coefficient x (value - mean) per feature."""
    return {f: F.lit(w) * (clean_double(f) - F.lit(means[f])) for f, w in coefficients.items()}


def attribution_global(df: DataFrame, coefficients: Mapping[str, float], k: int = 20) -> DataFrame:
    """Rows (feature, mean_abs_contribution) for the k strongest features of a linear model."""
    from .aggregates import to_rows, wide_agg
    means = wide_agg(df, {f: F.avg(clean_double(f)) for f in coefficients})
    parts = linear_contributions(coefficients, means)
    one = df.agg(*[F.avg(F.abs(c)).alias(f"a{i}") for i, c in enumerate(parts.values())])
    rows = to_rows(one, [{"feature": F.lit(f), "mean_abs_contribution": F.col(f"a{i}")} for i, f in enumerate(parts)])
    return rows.orderBy(F.desc("mean_abs_contribution"), "feature").limit(k)


def attribution_rows(df: DataFrame, coefficients: Mapping[str, float], k: int = 3, background: DataFrame | None = None) -> DataFrame:
    """Add ``reasons``: per row the k largest contributions with their sign kept, against the means of ``background`` (``df`` itself if none)."""
    from .aggregates import wide_agg
    means = wide_agg(df if background is None else background, {f: F.avg(clean_double(f)) for f in coefficients})
    parts = linear_contributions(coefficients, means)
    entries = F.array(*[
        F.struct(F.coalesce(-F.abs(c), F.lit(0.0)).alias("o"), F.lit(f).alias("feature"), clean_double(f).alias("value"), c.alias("contribution"))
        for f, c in parts.items()
    ])
    best = F.slice(F.sort_array(entries), 1, k)
    return df.withColumn("reasons", F.transform(best, lambda e: F.struct(e["feature"], e["value"], e["contribution"])))


def explain_sample(df: DataFrame, coefficients: Mapping[str, float], keys: Sequence[str], n: int = 500, k: int = 3, seed: int = 42, portable: bool = False) -> DataFrame:
    """``reasons`` of n hash-chosen rows (all, if fewer), against the means of all rows of ``df``."""
    from .explore import hash_sample
    return attribution_rows(hash_sample(df, keys, n, seed, portable), coefficients, k, background=df)


def explain_top_row(df: DataFrame, coefficients: Mapping[str, float], p: str, keys: Sequence[str], k: int = 15) -> DataFrame:
    """Reasons of the single highest-scored row, one row per feature."""
    reasons = attribution_rows(df, coefficients, k)
    top = reasons.orderBy(F.desc(p), *[col(x) for x in keys]).limit(1)
    return top.select(*keys, F.col(p).alias("score"), F.posexplode("reasons").alias("rank", "r")).select(
        *keys, "score", (F.col("rank") + 1).alias("rank"), "r.feature", "r.value", "r.contribution")


def representatives(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """One row per band: the highest-scored positive, a middling row, the lowest-scored negative."""
    ident = [col(k) for k in keys]
    pick = lambda cond, order: F.min(F.when(cond, F.struct(order.alias("o"), *ident, col(p).alias("p"))))
    one = df.agg(
        pick(col(y) == 1, -col(p)).alias("high"),
        pick((col(p) > 0.4) & (col(p) < 0.7), F.abs(col(p) - 0.55)).alias("medium"),
        pick(col(y) == 0, col(p)).alias("low"))
    from .aggregates import to_rows
    return to_rows(one, [
        {"band": F.lit(b.upper()), **{k: F.col(f"{b}.{k}") for k in keys}, "p": F.col(f"{b}.p")} for b in ("high", "medium", "low")])


def best_row(df: DataFrame, score: str, keys: Sequence[str]) -> DataFrame:
    """The row with the largest score; the smallest key wins ties."""
    others = [c for c in df.columns if c not in keys and c != score]
    s = F.struct((-col(score)).alias("_o"), *[col(k) for k in keys], *[col(o) for o in others], col(score).alias(score))
    return df.agg(F.min(s).alias("s")).select(*[F.col(f"s.`{c}`").alias(c) for c in df.columns])
