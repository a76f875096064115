"""Cleaning steps. Each one is fitted with aggregates and applied as a projection."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import clean_double, clip, col, is_missing
from .aggregates import modes, numeric_columns, quantile_values, string_columns, wide_agg

AUDIT_SCHEMA = "step string, column string, action string, reason string, value string"

# fixed values: null-share limits of the treatment tiers
TRACE_LIMIT, LOW_LIMIT, MID_LIMIT, HIGH_LIMIT = 0.01, 0.05, 0.20, 0.50

# fixed values: words read as booleans
TRUE_WORDS = ["yes", "true", "1", "y", "t"]
FALSE_WORDS = ["no", "false", "0", "n", "f"]
DATE_HINT = re.compile(r"date|time|dt|year|month|created|updated|timestamp", re.IGNORECASE)


def audit_table(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """Audit rows (step, column, action, reason, value): at most a few per column."""
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], AUDIT_SCHEMA)


def deduplicate(df: DataFrame) -> DataFrame:
    """Distinct full rows. Copies meet map-side first, so one much-copied row costs nothing extra."""
    return df.dropDuplicates()


def dedup_counts(df: DataFrame) -> DataFrame:
    """One row (rows_before, rows_after, removed).

    The copies are counted per row and summed, which takes one scan and one shuffle.
    """
    per_row = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    totals = per_row.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"), F.count(F.lit(1)).alias("rows_after")
    )
    return totals.select("rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("removed"))


def fill_values(df: DataFrame, cols: Iterable[str]) -> dict[str, object]:
    """Median of numeric columns, smallest most frequent value of the others."""
    cols = list(cols)
    numbers = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    others = [c for c in cols if c not in numbers]
    fills: dict[str, object] = {}
    if numbers:
        fills.update({c: v[0] for c, v in quantile_values(df, numbers, [0.5]).items()})
    if others:
        fills.update(modes(df, others))
    return fills


def filled(df: DataFrame, name: str, value) -> Column:
    """The column with missing values replaced; integers widen when the fill is fractional."""
    kind = df.schema[name].dataType
    c = F.nanvl(col(name), F.lit(None)) if isinstance(kind, (T.DoubleType, T.FloatType)) else col(name)
    if isinstance(kind, T.IntegralType) and value is not None:
        return F.coalesce(c.cast("double"), F.lit(value)) if value != int(value) else F.coalesce(c, F.lit(int(value)).cast(kind))
    return F.coalesce(c, F.lit(value).cast(kind))


def impute(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    fills = fill_values(fit_on if fit_on is not None else df, cols)
    return df.withColumns({c: filled(df, c, v) for c, v in fills.items()})


def missing_indicators(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({
        f"{c}_was_missing": is_missing(c, df.schema[c].dataType).cast("int") for c in cols
    })


@dataclass
class NullPolicy:
    """Treatment per column, decided by its share of missing values."""

    actions: dict[str, str] = field(default_factory=dict)
    shares: dict[str, float] = field(default_factory=dict)
    fills: dict[str, object] = field(default_factory=dict)

    # fixed values: action names and their reasons
    REASONS = {
        "DROPPED": "more than half missing",
        "FLAGGED + IMPUTED + INDICATOR": "20-50% missing",
        "IMPUTED + INDICATOR": "5-20% missing",
        "IMPUTED": "1-5% missing",
        "IMPUTED (trace)": "up to 1% missing",
    }

    @staticmethod
    def tier(share: float) -> str | None:
        if share == 0:
            return None
        for limit, action in (
            (HIGH_LIMIT, "DROPPED"), (MID_LIMIT, "FLAGGED + IMPUTED + INDICATOR"),
            (LOW_LIMIT, "IMPUTED + INDICATOR"), (TRACE_LIMIT, "IMPUTED"),
        ):
            if share > limit:
                return action
        return "IMPUTED (trace)"

    @classmethod
    def fit(cls, df: DataFrame, exclude: Iterable[str] = ()) -> "NullPolicy":
        skip = set(exclude)
        fields = [f for f in df.schema if f.name not in skip]
        exprs = {f"m{i}": F.count(F.when(is_missing(f.name, f.dataType), 1)) for i, f in enumerate(fields)}
        found = wide_agg(df, {"rows": F.count(F.lit(1)), **exprs})
        rows = max(found["rows"], 1)
        policy = cls()
        for i, f in enumerate(fields):
            share = found[f"m{i}"] / rows
            action = cls.tier(share)
            if action:
                policy.actions[f.name], policy.shares[f.name] = action, share
        policy.fills = fill_values(df, [c for c, a in policy.actions.items() if a != "DROPPED"])
        return policy

    def apply(self, df: DataFrame) -> DataFrame:
        flagged = [c for c, a in self.actions.items() if "INDICATOR" in a]
        out = missing_indicators(df, flagged) if flagged else df
        out = out.withColumns({c: filled(df, c, v) for c, v in self.fills.items()}) if self.fills else out
        return out.drop(*[c for c, a in self.actions.items() if a == "DROPPED"])

    def plan(self, spark) -> DataFrame:
        """Rows (column, null_share, action)."""
        rows = [(c, float(self.shares[c]), a) for c, a in self.actions.items()]
        return spark.createDataFrame(rows, "column string, null_share double, action string")

    def audit(self, df: DataFrame) -> DataFrame:
        return audit_table(df, [
            ("missing values", c, a, self.REASONS[a], None if self.fills.get(c) is None else str(self.fills[c]))
            for c, a in self.actions.items()
        ])


def binary_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Numeric columns whose present values are all 0 or 1."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return []
    found = wide_agg(df, {c: F.bool_and(clean_double(c).isin(0.0, 1.0)) for c in cols})
    return [c for c in cols if found[c]]


@dataclass
class Winsorizer:
    """Clip to [Q1 - k IQR, Q3 + k IQR]; columns without spread are left alone."""

    bounds: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str] | None = None, k: float = 3.0,
            exclude: Iterable[str] = (), keep_binary: bool = True) -> "Winsorizer":
        cols = list(cols) if cols is not None else numeric_columns(df, exclude)
        if keep_binary and cols:
            skip = set(binary_columns(df, cols))
            cols = [c for c in cols if c not in skip]
        quartiles = quantile_values(df, cols, [0.25, 0.75]) if cols else {}
        return cls({
            c: (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
            for c, (q1, q3) in quartiles.items() if q1 is not None and q3 > q1
        })

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: clip(c, lo, hi) for c, (lo, hi) in self.bounds.items()}) if self.bounds else df

    def counts(self, df: DataFrame) -> dict[str, tuple[int, int]]:
        """Rows clipped at the low and high bound, per column."""
        found = wide_agg(df, {
            f"{side}:{c}": F.count(F.when(test, 1))
            for c, (lo, hi) in self.bounds.items()
            for side, test in (("low", clean_double(c) < lo), ("high", clean_double(c) > hi))
        })
        return {c: (found[f"low:{c}"], found[f"high:{c}"]) for c in self.bounds}

    def audit(self, df: DataFrame) -> DataFrame:
        rows = [
            ("outliers", c, "CLIPPED", f"{low} low, {high} high", f"[{self.bounds[c][0]:.4f}, {self.bounds[c][1]:.4f}]")
            for c, (low, high) in self.counts(df).items() if low + high
        ] if self.bounds else []
        return audit_table(df, rows)


# text columns that hold something else --------------------------------------

def _word(name: str) -> Column:
    return F.lower(F.trim(col(name)))


def bool_value(name: str) -> Column:
    return F.when(_word(name).isin(TRUE_WORDS), True).when(_word(name).isin(FALSE_WORDS), False)


def timestamp_value(name: str) -> Column:
    return F.try_to_timestamp(F.trim(col(name)))


# a plain decimal or scientific number; nothing with a type letter such as 12d or 45f, nor words such as NaN
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def number_value(name: str) -> Column:
    text = F.trim(col(name))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def whole_value(name: str) -> Column:
    """A whole number of any size up to 64 bits, without going through double; 1.0 and 1e3 count as whole too."""
    text = F.trim(col(name))
    number = number_value(name)
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint")), F.when(number == F.floor(number), text.try_cast("decimal(38,10)").try_cast("bigint")),
                      F.when(number == F.floor(number), number.try_cast("bigint")))


def text_kinds(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    """Target type per text column that holds only booleans, dates or numbers.

    All columns are tested in one aggregate; an all-missing column stays text.
    """
    cols = list(cols) if cols is not None else string_columns(df)
    if not cols:
        return {}
    parsed: list[Column] = []
    exprs: dict[str, Column] = {}
    for i, c in enumerate(cols):
        # each text is parsed once, then counted
        parsed += [col(c).isNotNull().alias(f"p{i}"), bool_value(c).isNotNull().alias(f"b{i}"), number_value(c).alias(f"d{i}"), whole_value(c).isNotNull().alias(f"w{i}")]
        present, number = F.col(f"p{i}"), F.col(f"d{i}")
        exprs[f"n{i}"] = F.count(F.when(present, 1))
        exprs[f"b{i}"] = F.bool_and(F.when(present, F.col(f"b{i}")))
        exprs[f"d{i}"] = F.bool_and(F.when(present, number.isNotNull()))
        exprs[f"i{i}"] = F.bool_and(F.when(present, F.col(f"w{i}")))
        if DATE_HINT.search(c):
            parsed.append(timestamp_value(c).isNotNull().alias(f"t{i}"))
            exprs[f"t{i}"] = F.bool_and(F.when(present, F.col(f"t{i}")))
    found = wide_agg(df.select(*parsed), exprs)
    kinds = {}
    for i, c in enumerate(cols):
        if not found[f"n{i}"]:
            continue
        if found[f"b{i}"]:
            kinds[c] = "boolean"
        elif found.get(f"t{i}"):
            kinds[c] = "timestamp"
        elif found[f"d{i}"]:
            kinds[c] = "bigint" if found[f"i{i}"] else "double"
    return kinds


def recast(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    makers = {
        "boolean": bool_value, "timestamp": timestamp_value, "double": number_value,
        "bigint": whole_value,
    }
    return df.withColumns({c: makers[k](c) for c, k in kinds.items()}) if kinds else df


def correct_types(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The recast table and its audit rows."""
    kinds = text_kinds(df)
    rows = [("types", c, "RECAST", f"string to {k}", None) for c, k in kinds.items()]
    return recast(df, kinds), audit_table(df, rows)
