"""Encoders and scalers: fitted on aggregates, applied as projections or lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_double, col
from ..session import cut_lineage
from .aggregates import numeric_columns, string_columns, value_shares, wide_agg
from .clean import audit_table, binary_columns
from .joins import left_enrich
from .prefix import row_numbers

ONE_HOT_MAX = 10


def ordinal_code(name: str, order: Sequence[str]) -> Column:
    """Position in a declared order; anything else is -1."""
    pairs = [F.lit(v) for i, level in enumerate(order) for v in (level, i)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(col(name), F.lit(""))), F.lit(-1))


def levels(df: DataFrame, name: str, limit: int) -> list[str]:
    """Sorted distinct values; raises when there are more than ``limit``."""
    rows = df.select(col(name).alias("v")).filter("v is not null").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{name} has more than {limit} values")
    return sorted(r["v"] for r in rows)


def label_encode(df: DataFrame, name: str) -> DataFrame:
    """Codes 0..k-1 (bigint) in sorted order of the values; a missing value has no code.

    The distinct values are ranked by range-partitioned position and looked up by a
    join in which the rows of frequent values are spread out.
    """
    found = df.filter(col(name).isNotNull()).groupBy(col(name).alias("v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = row_numbers(found, [F.col("v")], "_code").select(F.col("v").alias(name), "_n", (F.col("_code") - 1).alias("_code"))
    codes = cut_lineage(ranked, "codes")
    return left_enrich(df, codes, name, count_col="_n").withColumn(name, F.col("_code")).select(*df.columns)


def label_encode_all(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """`label_encode` for every text column."""
    out = df
    for c in string_columns(df, exclude):
        out = label_encode(out, c)
    return out


def one_hot(df: DataFrame, name: str, values: Sequence[str] | None = None, limit: int = ONE_HOT_MAX) -> DataFrame:
    """A 0/1 column per level; the source column goes."""
    values = levels(df, name, limit) if values is None else list(values)
    flags = {f"{name}_{v}": F.coalesce((col(name) == v).cast("int"), F.lit(0)) for v in values}
    return df.withColumns(flags).drop(name)


def frequency_encode(df: DataFrame, name: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Replace a value by its share of the non-missing rows."""
    shares = value_shares(fit_on if fit_on is not None else df, name)
    shares = cut_lineage(shares.select(F.col("value").alias(name), "n", F.col("share").alias("_share")), "shares")
    joined = left_enrich(df, shares.withColumnRenamed("n", "_n"), name, count_col="_n")
    return joined.withColumn(name, F.col("_share")).select(*df.columns)


def encoding_plan(df: DataFrame, target: str | None = None, orders: Mapping[str, Sequence[str]] | None = None,
                  one_hot_max: int = ONE_HOT_MAX) -> dict[str, str]:
    """Method per text column, from one distinct-count aggregate."""
    orders = dict(orders or {})
    cols = string_columns(df, [target] if target else [])
    if not cols:
        return {}
    open_cols = [c for c in cols if c not in orders]
    counts = wide_agg(df, {c: F.count_distinct(col(c)) for c in open_cols}) if open_cols else {}
    plan = {}
    for c in cols:
        if c in orders:
            plan[c] = "ordinal"
        else:
            plan[c] = "binary" if counts[c] == 2 else "one-hot" if counts[c] <= one_hot_max else "frequency"
    return plan


@dataclass
class CategoryEncoder:
    """Encodes every text column by its cardinality, with values learnt at fit time."""

    plan: dict[str, str]
    orders: dict[str, list[str]]
    known: dict[str, list[str]]
    shares: dict[str, DataFrame]

    @classmethod
    def fit(cls, df: DataFrame, target: str | None = None, orders: Mapping[str, Sequence[str]] | None = None,
            exclude: Iterable[str] = ()) -> "CategoryEncoder":
        skip = set(exclude)
        plan = {c: m for c, m in encoding_plan(df, target, orders).items() if c not in skip}
        known = {c: levels(df, c, ONE_HOT_MAX) for c, m in plan.items() if m in ("binary", "one-hot")}
        shares = {
            c: cut_lineage(value_shares(df, c).select(F.col("value").alias(c), F.col("n").alias("_n"), F.col("share").alias("_share")), "shares")
            for c, m in plan.items() if m == "frequency"
        }
        return cls(plan, {c: list(v) for c, v in (orders or {}).items()}, known, shares)

    def apply(self, df: DataFrame) -> DataFrame:
        simple = {}
        for c, method in self.plan.items():
            if method == "ordinal":
                simple[c] = ordinal_code(c, self.orders[c])
            elif method == "binary":
                simple[c] = ordinal_code(c, self.known[c])
        out = df.withColumns(simple) if simple else df
        for c, method in self.plan.items():
            if method == "one-hot":
                out = one_hot(out, c, self.known[c])
            elif method == "frequency":
                out = left_enrich(out, self.shares[c], c, count_col="_n").withColumn(c, F.col("_share")).drop("_n", "_share")
        return out

    def audit(self, df: DataFrame) -> DataFrame:
        return audit_table(df, [("encoding", c, m.upper(), f"{m} by cardinality", None) for c, m in self.plan.items()])


@dataclass
class Standardizer:
    """(x - mean) / population standard deviation; target and 0/1 columns are left alone."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str] | None = None, exclude: Iterable[str] = (),
            keep_binary: bool = True) -> "Standardizer":
        cols = list(cols) if cols is not None else numeric_columns(df, exclude)
        if keep_binary and cols:
            skip = set(binary_columns(df, cols))
            cols = [c for c in cols if c not in skip]
        found = wide_agg(df, {
            f"{k}:{c}": fn(clean_double(c)) for c in cols for k, fn in (("m", F.avg), ("s", F.stddev_pop))
        }) if cols else {}
        # a column without spread is only centred
        return cls({
            c: (found[f"m:{c}"], found[f"s:{c}"] or 1.0) for c in cols if found[f"m:{c}"] is not None
        })

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (clean_double(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()
        }) if self.stats else df

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: col(c) * F.lit(s) + F.lit(m) for c, (m, s) in self.stats.items()})

    def value(self, name: str, x, eps: float = 1e-9) -> Column:
        """One raw value on the fitted scale, guarded against a zero spread."""
        m, s = self.stats[name]
        return (x if isinstance(x, Column) else F.lit(x)) / F.lit(s + eps) - F.lit(m / (s + eps))

    def audit(self, df: DataFrame) -> DataFrame:
        return audit_table(df, [
            ("scaling", c, "STANDARDISED", "zero mean, unit variance", f"mean={m:.4f}, std={s:.4f}")
            for c, (m, s) in self.stats.items()
        ])
