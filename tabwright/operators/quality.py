"""Profiles and integrity checks. Every check is one aggregate over the whole table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import as_flag, clean_double, col, is_missing, skew_sample
from ..session import cut_lineage
from .aggregates import numeric_columns, string_columns, to_rows

# fixed values: name and value patterns that define the column roles
ID_NAME = re.compile(r"\bid\b|_id$|^id", re.IGNORECASE)
DATE_NAME = re.compile(r"date|time|dt|year|month|day", re.IGNORECASE)
ARTEFACT = r"[^\x00-\x7FÀ-ɏ]"


def null_counts(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row with the row count and the missing count of each column."""
    names = df.columns
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count(F.when(is_missing(f.name, f.dataType), 1)).alias(f"m{i}") for i, f in enumerate(df.schema)
    ])
    return one, names


def profile(df: DataFrame) -> DataFrame:
    """Rows (column, dtype, rows, nulls, null_pct)."""
    one, _ = null_counts(df)
    return to_rows(one, [
        {
            "column": F.lit(f.name), "dtype": F.lit(f.dataType.simpleString()), "rows": F.col("rows"),
            "nulls": F.col(f"m{i}"), "null_pct": F.try_divide(F.col(f"m{i}") * F.lit(100.0), F.col("rows")),
        }
        for i, f in enumerate(df.schema)
    ])


def check_nonempty(df: DataFrame) -> DataFrame:
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    return rows.select(
        F.lit("Zero Rows").alias("check"), (F.col("n") > 0).alias("passed"),
        F.when(F.col("n") > 0, F.format_string("%d rows found", "n"))
        .otherwise("FATAL: DataFrame is empty").alias("detail"),
    )


def check_sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Columns with more than ``threshold`` of their values missing."""
    return profile(df).filter(F.col("null_pct") > F.lit(threshold * 100)).select("column", "null_pct")


def check_unparsed_dates(df: DataFrame) -> DataFrame:
    """Rows (column, unparsed, values, parseable) per date-named column.

    Whether a column is still text is in the schema; how many of its values would
    parse comes from one aggregate.
    """
    named = [f for f in df.schema if DATE_NAME.search(f.name)]
    aggs, records = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(named):
        text = isinstance(f.dataType, T.StringType)
        value = F.try_to_timestamp(F.trim(col(f.name))) if text else col(f.name)
        aggs += [F.count(col(f.name)).alias(f"v{i}"), F.count(value).alias(f"p{i}")]
        records.append({"column": F.lit(f.name), "unparsed": F.lit(text), "values": F.col(f"v{i}"), "parseable": F.col(f"p{i}")})
    if not records:
        return df.sparkSession.createDataFrame([], "column string, unparsed boolean, values bigint, parseable bigint")
    return to_rows(df.agg(*aggs), records)


def id_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if ID_NAME.search(c)]


def check_duplicate_keys(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows (column, duplicates): rows that repeat an earlier value, all missing values being one value."""
    keys = list(keys) if keys is not None else id_columns(df)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[
        (F.count_distinct(col(k)) + F.max(as_flag(col(k).isNull()))).alias(f"d{i}") for i, k in enumerate(keys)
    ])
    return to_rows(one, [
        {"column": F.lit(k), "duplicates": F.col("rows") - F.coalesce(F.col(f"d{i}"), F.lit(0))}
        for i, k in enumerate(keys)
    ])


def check_encoding(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows (column, suspect): values holding characters outside Latin text, over the whole column."""
    cols = list(cols) if cols is not None else string_columns(df)
    one = df.agg(*[F.count(F.when(col(c).rlike(ARTEFACT), 1)).alias(f"s{i}") for i, c in enumerate(cols)])
    return to_rows(one, [{"column": F.lit(c), "suspect": F.col(f"s{i}")} for i, c in enumerate(cols)])


def _verdict(one: DataFrame, check: str, hits: Sequence[tuple[str, Column, Column]], ok: str) -> DataFrame:
    """Check row from (column name, is-a-hit, note) triples over a one-row aggregate."""
    notes = F.array_compact(F.array(*[
        F.when(hit, F.concat(F.lit(name), note)) for name, hit, note in hits
    ])) if hits else F.array().cast("array<string>")
    found = one.select(notes.alias("notes"))
    return found.select(
        F.lit(check).alias("check"), (F.size("notes") == 0).alias("passed"),
        F.when(F.size("notes") == 0, ok)
        .otherwise(F.concat(F.lit("WARNING: "), F.array_join("notes", ", "))).alias("detail"),
    )


def integrity_report(df: DataFrame, sparse_limit: float = 0.5) -> DataFrame:
    """Five check rows and an overall row, from one scan for counts and one for distinct keys.

    The two result rows are written, as every check reads them.
    """
    keys, texts = id_columns(df), string_columns(df)
    schema = list(df.schema)
    scan = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.when(is_missing(f.name, f.dataType), 1)).alias(f"m{i}") for i, f in enumerate(schema)],
        *[F.count(F.when(col(c).rlike(ARTEFACT), 1)).alias(f"s{i}") for i, c in enumerate(texts)],
    )
    scan = cut_lineage(scan, "counts")
    rows = F.col("rows")
    none = F.lit("")
    nonempty = scan.select(
        F.lit("Zero Rows").alias("check"), (rows > 0).alias("passed"),
        F.when(rows > 0, F.format_string("%d rows found", rows)).otherwise("FATAL: DataFrame is empty").alias("detail"),
    )
    sparse = _verdict(scan, ">50% Empty Columns", [
        (f.name, F.col(f"m{i}") > rows * F.lit(sparse_limit), none) for i, f in enumerate(schema)
    ], "No columns >50% null")
    dates = _verdict(scan, "Unparsed Date Columns", [
        (f.name, F.lit(True), none) for f in schema if DATE_NAME.search(f.name) and isinstance(f.dataType, T.StringType)
    ], "No unparsed date columns")
    encoding = _verdict(scan, "Encoding Issues", [
        (c, F.col(f"s{i}") > 0, F.format_string(": %d suspect values", f"s{i}")) for i, c in enumerate(texts)
    ], "No encoding artifacts detected")
    if keys:
        wide = df.agg(F.count(F.lit(1)).alias("rows"), *[
            (F.count_distinct(col(k)) + F.max(as_flag(col(k).isNull()))).alias(f"d{i}") for i, k in enumerate(keys)
        ])
        wide = cut_lineage(wide, "keys")
        repeats = [rows - F.coalesce(F.col(f"d{i}"), F.lit(0)) for i in range(len(keys))]
        duplicates = _verdict(wide, "Duplicate Key Candidates", [
            (k, r > 0, F.format_string(": %d duplicates", r)) for k, r in zip(keys, repeats)
        ], "No duplicate keys found")
    else:
        duplicates = _verdict(scan, "Duplicate Key Candidates", [], "No duplicate keys found")
    checks = reduce(DataFrame.unionByName, [nonempty, sparse, dates, duplicates, encoding])
    overall = checks.agg(F.bool_and("passed").alias("ok")).select(
        F.lit("Overall").alias("check"), F.col("ok").alias("passed"),
        F.when(F.col("ok"), "ALL CHECKS PASSED").otherwise("ISSUES DETECTED").alias("detail"),
    )
    return checks.unionByName(overall)


def class_balance(df: DataFrame, target: str, limit: float = 0.2) -> DataFrame:
    """Rows (class, n, share, imbalanced); the shares come from the grouped counts."""
    counts = (
        df.filter(col(target).isNotNull())
        .groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(F.sum("n").alias("t"))
    shares = counts.select("class", "n", (F.col("n") / total.scalar()).alias("share"))
    return shares.withColumn("imbalanced", F.col("share") < F.lit(limit))


def constant_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """Columns with at most one distinct non-missing value.

    Equal minimum and maximum say the same as a distinct count, without a shuffle.
    """
    usable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    one = df.agg(*[
        (F.min(col(c)).isNull() | (F.min(col(c)) == F.max(col(c)))).alias(f"c{i}") for i, c in enumerate(usable)
    ])
    rows = to_rows(one, [{"column": F.lit(c), "constant": F.col(f"c{i}")} for i, c in enumerate(usable)])
    return rows.filter("constant").select("column")


def skew_report(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 3.0, log_hint: float = 1.0) -> DataFrame:
    """Rows (column, skew, extreme, log_hint) with bias-corrected skewness."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    one = df.agg(*[skew_sample(c).alias(f"s{i}") for i, c in enumerate(cols)])
    rows = to_rows(one, [{"column": F.lit(c), "skew": F.col(f"s{i}")} for i, c in enumerate(cols)])
    return rows.select(
        "column", "skew", (F.abs("skew") > limit).alias("extreme"), (F.abs("skew") > log_hint).alias("log_hint")
    )


def data_profile(df: DataFrame, target: str) -> DataFrame:
    """One row: size, feature kinds, class balance, zeros and missing values."""
    features = [f for f in df.schema if f.name != target]
    numbers, texts = numeric_columns(df, [target]), string_columns(df, [target])
    zeros = sum((F.count(F.when(clean_double(c) == 0, 1)) for c in numbers), F.lit(0))
    missing = sum((F.count(F.when(is_missing(f.name, f.dataType), 1)) for f in features), F.lit(0))
    scan = df.agg(F.count(F.lit(1)).alias("n_rows"), zeros.alias("zeros"), missing.alias("missing"))
    counts = df.filter(col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    largest, smallest = (counts.agg(fn("n")).scalar() for fn in (F.max, F.min))
    total = F.col("n_rows").cast("double")
    sized = scan.withColumns({"largest": largest, "smallest": smallest})
    return sized.select(
        "n_rows", F.lit(len(features)).alias("n_features"),
        F.lit(len(numbers)).alias("numeric_features"), F.lit(len(texts)).alias("cat_features"),
        F.try_divide(F.col("largest"), F.col("smallest")).alias("imbalance_ratio"),
        (F.try_divide(F.col("smallest"), total) * 100).alias("minority_pct"),
        F.round(F.try_divide(F.col("zeros") * 100.0, total * F.lit(max(len(numbers), 1))), 1).alias("sparsity_pct"),
        F.round(F.try_divide(F.col("missing") * 100.0, total * F.lit(max(len(features), 1))), 1).alias("missing_pct"),
    )


def check_row_loss(raw: DataFrame, clean: DataFrame, limit: float = 0.7) -> DataFrame:
    """One row saying whether cleaning lost too many rows or left none."""
    before, after = raw.agg(F.count(F.lit(1))).scalar(), clean.agg(F.count(F.lit(1))).scalar()
    base = raw.sparkSession.range(1).select(before.alias("rows_before"), after.alias("rows_after"))
    lost = F.try_divide((F.col("rows_before") - F.col("rows_after")).cast("double"), F.col("rows_before"))
    return base.select(
        "rows_before", "rows_after", lost.alias("lost"),
        ((F.col("rows_after") == 0) | (lost > limit)).alias("blocked"),
    )


def check_beats_dummy(leaderboard: DataFrame, score: str = "auc_val") -> DataFrame:
    """One row: does any model score above every dummy model?"""
    dummy = F.lower("model").contains("dummy")
    best = leaderboard.agg(
        F.max(F.when(dummy, F.col(score))).alias("dummy_score"),
        F.max(F.when(~dummy, F.col(score))).alias("model_score"),
    )
    beats = F.coalesce(F.col("model_score") > F.col("dummy_score"), F.lit(False))
    return best.select("dummy_score", "model_score", (~beats).alias("blocked"))
