"""Column expressions. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAYS_PER_MONTH = 30.44
EPSILON = 1e-9


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def is_missing(name: str, dtype: T.DataType) -> Column:
    """NULL, and for floating types NaN as well."""
    c = col(name)
    return c.isNull() | F.isnan(c) if isinstance(dtype, (T.DoubleType, T.FloatType)) else c.isNull()


def clean_double(c: str | Column) -> Column:
    """Double value with NaN turned into NULL, so that aggregates skip it."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def as_flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (NULL counts as not holding)."""
    return F.when(condition, 1).otherwise(0)


# ratios and arithmetic ------------------------------------------------------

def safe_ratio(a, b, eps: float = EPSILON) -> Column:
    """a / (b + eps), and 0 where b is 0 or missing."""
    return F.when(col(b) != 0, col(a) / (col(b) + F.lit(eps))).otherwise(F.lit(0.0))


def null_ratio(a, b) -> Column:
    """a / b, and NULL where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x, lo, hi) -> Column:
    """Bound x to [lo, hi]; a missing x stays missing."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.when(clean_double(x).isNotNull(), F.greatest(F.least(col(x), hi), lo))


def utilisation(balance, limit) -> Column:
    return clip(null_ratio(balance, limit), 0.0, 1.0)


def band_ratio(x, lo, hi) -> Column:
    """Position of x between lo and hi, bounded to [0, 1]."""
    return clip(null_ratio(col(x) - col(lo), col(hi) - col(lo)), 0.0, 1.0)


def ratio_sq(a, b) -> Column:
    """a / b squared, e.g. weight over squared height."""
    return null_ratio(a, F.pow(col(b), 2))


def row_sum(cols: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(col(c), F.lit(0))
    return total


def row_cv(cols: Sequence[str]) -> Column:
    """Sample standard deviation over mean across the columns of one row."""
    values = F.filter(F.array(*[clean_double(c) for c in cols]), lambda v: v.isNotNull())
    n = F.size(values)
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), n)
    squares = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    return F.try_divide(F.sqrt(F.try_divide(squares, F.when(n > 1, n - 1))), F.when(mean != 0, mean))


# dates ----------------------------------------------------------------------

def days_since(date, reference) -> Column:
    """Whole calendar days from date to reference; unparseable text gives NULL."""
    reference = reference if isinstance(reference, Column) else F.lit(reference)
    return F.datediff(reference.cast("date"), col(date).try_cast("date"))


def months_since(date, reference) -> Column:
    return F.round(days_since(date, reference) / F.lit(DAYS_PER_MONTH), 1)


def date_parts(name: str, with_hour: bool = False) -> dict[str, Column]:
    """Calendar columns for one date column; Monday is weekday 0."""
    c = col(name)
    parts = {
        f"{name}_year": F.year(c),
        f"{name}_month": F.month(c),
        f"{name}_day": F.dayofmonth(c),
        f"{name}_day_of_week": F.weekday(c),
        f"{name}_is_weekend": as_flag(F.weekday(c) >= 5),
        f"{name}_quarter": F.quarter(c),
    }
    if with_hour:
        parts[f"{name}_hour"] = F.hour(c)
    return parts


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """(sin, cos) of a value on a circle of the given period."""
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


# bins -----------------------------------------------------------------------

def cut(x, edges: Sequence[float], labels: Sequence) -> Column:
    """Right-closed bins (lo, hi]; the lowest edge itself is outside every bin."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need exactly one label per bin")
    x = col(x)
    result = F.when(x <= F.lit(edges[0]), F.lit(None))
    for hi, label in zip(edges[1:], labels):
        result = result.when(x.isNotNull() & (x <= F.lit(float(hi))), F.lit(label))
    return result


def edge_rank(x, interior_edges: Sequence[float]) -> Column:
    """1 + the number of distinct interior edges below x."""
    x = col(x)
    score = F.lit(1)
    for edge in sorted({e for e in interior_edges if e is not None}):
        score = score + as_flag(x > F.lit(edge))
    return F.when(x.isNotNull(), score)


# fixed values: band edges and labels the results must carry
TENURE_EDGES = [0, 6, 12, 24, 60, float("inf")]
TENURE_LABELS = ["0-6m", "6-12m", "1-2yr", "2-5yr", "5yr+"]
BMI_EDGES = [0, 18.5, 25, 30, float("inf")]
BMI_LABELS = ["Underweight", "Normal", "Overweight", "Obese"]
AGE_EDGES = [0, 17, 34, 49, 64, float("inf")]
AGE_LABELS = ["0-17", "18-34", "35-49", "50-64", "65+"]
HIGH_RISK, MEDIUM_RISK = 0.70, 0.40
TIER_ACTIONS = {
    "HIGH": "Immediate personal outreach within 48 hours. Offer: cashback uplift or credit limit increase.",
    "MEDIUM": "Automated personalised email + in-app offer within 7 days.",
    "LOW": "No urgent action required. Include in standard retention newsletter.",
}


def risk_tier(p, high: float = HIGH_RISK, medium: float = MEDIUM_RISK) -> Column:
    """LOW up to ``medium``; a missing probability (NULL or NaN) counts as LOW too."""
    return F.when(clean_double(p) > high, "HIGH").when(clean_double(p) > medium, "MEDIUM").otherwise("LOW")


def action_for(tier) -> Column:
    pairs = [F.lit(v) for kv in TIER_ACTIONS.items() for v in kv]
    return F.element_at(F.create_map(*pairs), col(tier))


def decide(p, threshold: float = 0.5) -> Column:
    return as_flag(clean_double(p) >= F.lit(threshold))


# hashing --------------------------------------------------------------------

HASH_SPACE = 4294967296
KEY_SPACE = 2147483648
HASH_STEP = 2654435761


def portable_hash(key, seed: int = 42) -> Column:
    """Integer hash of a whole-number key that other SQL engines can repeat.

    The key is taken modulo 2**31 first, so that the product fits 64 bits whatever the key.
    """
    return F.pmod((F.pmod(col(key).cast("bigint"), F.lit(KEY_SPACE)) + F.lit(seed)) * F.lit(HASH_STEP), F.lit(HASH_SPACE))


def row_hash(keys: Sequence[str], seed: int = 42) -> Column:
    """Hash of any key columns onto 0 .. 2**32-1, the same on every partitioning."""
    return F.pmod(F.xxhash64(*[col(k) for k in keys], F.lit(seed)), F.lit(HASH_SPACE))


# shape statistics -----------------------------------------------------------

def skew_sample(c) -> Column:
    """Bias-corrected skewness as an aggregate; NULL below three rows."""
    x = clean_double(c)
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))
