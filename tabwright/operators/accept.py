"""Acceptance checks on score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_double, col
from .aggregates import quantile_values, share, to_rows
from .metrics import multiclass_metrics, roc_auc

# fixed values: verdicts from worst to best
VERDICT_ORDER = ["FAIL", "WARN", "MANUAL_REVIEW_REQUIRED", "PASS", "SKIP"]


def smoke_test(cases: DataFrame, score: str = "score", kind: str = "case_type",
               positive: float = 0.60, negative: float = 0.40) -> DataFrame:
    """Verdict per hand-picked case (obvious positive, obvious negative, borderline)."""
    s = clean_double(score)
    verdict = (
        F.when(col(kind) == "OBVIOUS_POSITIVE", F.when(s >= positive, "PASS").otherwise("FAIL"))
        .when(col(kind) == "OBVIOUS_NEGATIVE", F.when(s <= negative, "PASS").otherwise("FAIL"))
        .otherwise("INFO"))
    return cases.withColumn("verdict", verdict)


def smoke_overall(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("cases"), F.count(F.when(F.col("verdict") == "FAIL", 1)).alias("failures"),
    ).withColumn("verdict", F.when(F.col("failures") > 0, "FAIL").otherwise("PASS"))


def extreme_row_smoke(df: DataFrame, risk: Column, keys: Sequence[str], p: str = "p", k: int = 5, needed: int = 4) -> DataFrame:
    """One row: are the k riskiest rows scored high and the k safest low?"""
    rows = df.select(*[col(x) for x in keys], risk.alias("_risk"), clean_double(p).alias("_p"))
    order = [col(x) for x in keys]
    high = rows.orderBy(F.desc("_risk"), *order).limit(k).agg(F.count(F.when(F.col("_p") > 0.5, 1)).alias("n"))
    low = rows.orderBy(F.asc("_risk"), *order).limit(k).agg(F.count(F.when(F.col("_p") < 0.5, 1)).alias("n"))
    one = high.select(F.col("n").alias("high_right"), low.select("n").scalar().alias("low_right"))
    good = (F.col("high_right") >= needed) & (F.col("low_right") >= needed)
    return one.withColumn("verdict", F.when(good, "PASS").otherwise("FAIL"))


def edge_case_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Five boundary inputs: all missing, ten times the maximum, zeros, -9999 and a lone row."""
    peaks = df.agg(*[F.max(clean_double(c)).alias(c) for c in cols])

    def row(name, value):
        return {"case": F.lit(name), **{c: value(c).cast("double") for c in cols}}

    return to_rows(peaks, [
        row("all_null", lambda c: F.lit(None)), row("extreme_values", lambda c: F.col(f"`{c}`") * 10),
        row("all_zero", lambda c: F.lit(0.0)), row("unseen_category", lambda c: F.lit(-9999.0)),
        row("single_row", lambda c: F.lit(0.0)),
    ])


def edge_verdict(score: str) -> Column:
    s = clean_double(score)
    return F.when(s.isNull(), "FAIL").when(s.isin(0.0, 1.0), "WARN").otherwise("PASS")


def range_check(df: DataFrame, p: str = "p") -> DataFrame:
    """One row: score range, shares at the extremes, verdict."""
    s = clean_double(p)
    one = df.agg(F.min(s).alias("min_p"), F.max(s).alias("max_p"), (share(s < 0.01) * 100).alias("pct_low"),
                 (share(s > 0.99) * 100).alias("pct_high"))
    ok = (F.col("min_p") >= 0) & (F.col("max_p") <= 1)
    return one.withColumn("verdict", F.when(ok, "PASS").otherwise("FAIL"))


def prediction_audit(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """One row: over-confidence and the ratio of called to actual positives."""
    s = clean_double(p)
    one = df.agg(
        F.avg(s).alias("mean_p"), F.stddev_pop(s).alias("std_p"),
        share((s < 0.05) | (s > 0.95)).alias("near_extremes"),
        F.avg(col(y).cast("double")).alias("actual_rate"), share(s >= threshold).alias("called_rate"))
    ratio = F.col("called_rate") / F.greatest(F.col("actual_rate"), F.lit(1e-9))
    warn = (F.col("near_extremes") > 0.90) | (ratio > 2.0) | (ratio < 0.5)
    return one.select("*", ratio.alias("ratio"), F.when(warn, "WARN").otherwise("PASS").alias("verdict"))


def direction_check(df: DataFrame, features: dict[str, int], p: str = "p") -> DataFrame:
    """Rows (feature, mean_high, mean_low, correct): mean score above Q3 against below Q1.

    A sign of +1 expects the score to rise with the feature, -1 to fall.
    """
    names = list(features)
    edges = quantile_values(df, names, [0.25, 0.75])
    s = clean_double(p)
    aggs = []
    for i, c in enumerate(names):
        q1, q3 = edges[c]
        x = clean_double(c)
        aggs += [F.avg(F.when(x > F.lit(q3), s)).alias(f"h{i}"), F.avg(F.when(x < F.lit(q1), s)).alias(f"l{i}")]
    return to_rows(df.agg(*aggs), [
        {"feature": F.lit(c), "mean_high": F.col(f"h{i}"), "mean_low": F.col(f"l{i}"),
         "correct": F.coalesce((F.col(f"h{i}") - F.col(f"l{i}")) * F.lit(features[c]) > 0, F.lit(False))}
        for i, c in enumerate(names)
    ])


def subgroup_fairness(df: DataFrame, segments: Sequence[str], y: str = "y", p: str = "p", threshold: float = 0.5,
                      min_n: int = 30, limit_pct: float = -10.0) -> DataFrame:
    """Rows per subgroup: size, true and called rates, AUC, weighted F1, change against overall, verdict.

    Every row is repeated once per segment column; groups meet only as counts per
    (subgroup, score), so a dominant subgroup is spread like any other.
    """
    called = (clean_double(p) >= threshold).cast("int")
    long = df.select(col(y).cast("int").alias("y"), clean_double(p).alias("p"), called.alias("pred"), F.explode(F.array(*[
        F.struct(F.lit(s).alias("segment"), col(s).cast("string").alias("value")) for s in segments
    ])).alias("g")).select("y", "p", "pred", "g.segment", "g.value").filter("value is not null")
    keys = ["segment", "value"]
    overall = multiclass_metrics(df.select(col(y).cast("int").alias("y"), called.alias("pred"))).select("f1_weighted").scalar()
    sizes = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("true_rate"),
        F.avg(F.col("pred").cast("double")).alias("called_rate"))
    f1 = multiclass_metrics(long, by=keys).select(*keys, F.col("f1_weighted").alias("f1"))
    auc = roc_auc(long, by=keys)
    joined = sizes.join(f1, keys).join(auc, keys, "left").filter(F.col("n") >= min_n)
    delta = (F.col("f1") - overall) / F.greatest(overall, F.lit(1e-9)) * 100
    return joined.select(*keys, "n", "true_rate", "called_rate", "roc_auc", "f1", delta.alias("delta_pct"),
                         F.when(delta < limit_pct, "FLAGGED").otherwise("OK").alias("verdict"))


def uat_report(checks: DataFrame) -> DataFrame:
    """One row: the worst verdict (PASS at best) and the count of each."""
    places = F.create_map(*[F.lit(x) for i, v in enumerate(VERDICT_ORDER) for x in (v, i)])
    best = VERDICT_ORDER.index("PASS")
    worst = F.least(F.min(F.element_at(places, F.col("verdict"))), F.lit(best))
    return checks.agg(
        F.element_at(F.array(*[F.lit(v) for v in VERDICT_ORDER]), worst + 1).alias("overall"),
        *[F.count(F.when(F.col("verdict") == v, 1)).alias(v.lower()) for v in VERDICT_ORDER])


def max_score_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], p: str = "p", limit: float = 1e-6) -> DataFrame:
    """One row: largest absolute score difference of two scorings of the same rows."""
    left = a.select(*keys, clean_double(p).alias("_a"))
    right = b.select(*keys, clean_double(p).alias("_b"))
    one = left.join(right, list(keys), "full").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"),
        F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("unmatched"))
    ok = (F.col("unmatched") == 0) & (F.col("max_difference") < limit)
    return one.withColumn("verdict", F.when(ok, "PASS").otherwise("FAIL"))
