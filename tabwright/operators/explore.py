"""Exploratory statistics: the tables behind the charts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalar import as_flag, clean_double, col, is_missing, skew_sample
from ..session import cut_lineage
from .aggregates import corr_with_target, correlations, numeric_columns, pairs, quantiles, to_rows, wide_agg
from .features import recommend_features
from .quality import class_balance, profile
from .splits import key_hash

KDE_CELLS = 1_024


def _range_bin(x: Column, lo: float, width: float, bins: int) -> Column:
    if width <= 0:
        return F.when(x.isNotNull(), 0)
    return F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, name: str, bins: int = 40, by: str | None = None,
              lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Rows (by, bin, lo, hi, n, density) over equal bins from minimum to maximum."""
    x = clean_double(name)
    if lo is None or hi is None:
        found = wide_agg(df, {"lo": F.min(x), "hi": F.max(x)})
        lo, hi = found["lo"], found["hi"]
    keys = [by] if by else []
    if lo is None:
        return df.limit(0).select(*keys, F.lit(0).alias("bin"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"),
                                  F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("density"))
    width = (hi - lo) / bins
    cells = (
        df.filter(x.isNotNull()).groupBy(*keys, _range_bin(x, lo, width, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if by:
        # at most `bins` rows of a class; a missing class is one of its own
        cells, total = cells.withColumn("_total", F.sum("n").over(Window.partitionBy(by))), F.col("_total")
    else:
        total = df.agg(F.count(x)).scalar()
    step = width if width > 0 else 1.0
    return cells.select(
        *keys, "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "n",
        (F.col("n") / (total * F.lit(step))).alias("density"),
    )


def kde(df: DataFrame, name: str, grid: int = 200, by: str | None = None, cells: int = KDE_CELLS) -> DataFrame:
    """Gaussian density on an even grid with Scott's bandwidth: rows (by, x, density).

    Values are first counted in at most ``cells`` bins, so the kernel sum works on
    a bounded table whatever the number of rows.
    """
    x = clean_double(name)
    keys = [by] if by else []
    found = wide_agg(df, {"lo": F.min(x), "hi": F.max(x)})
    lo, hi = found["lo"], found["hi"]
    if lo is None:
        return df.limit(0).select(*keys, F.lit(0.0).alias("x"), F.lit(0.0).alias("density"))
    width = (hi - lo) / cells
    moments = df.filter(x.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp(x).alias("_s"))
    binned = (
        df.filter(x.isNotNull()).groupBy(*keys, _range_bin(x, lo, width, cells).alias("_b"))
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    bandwidth = F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    if by:
        right = moments.select(col(by).alias("_by"), "_n", bandwidth.alias("_h"))
        joined = binned.join(right, col(by).eqNullSafe(F.col("_by"))).drop("_by")
    else:
        joined = binned.withColumn("_n", moments.select("_n").scalar()).withColumn(
            "_h", moments.select(bandwidth).scalar())
    step = (hi - lo) / (grid - 1)
    points = joined.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn(
        "x", F.lit(lo) + F.col("_i") * F.lit(step))
    centre = F.lit(lo) + (F.col("_b") + 0.5) * F.lit(width)
    z = (F.col("x") - centre) / F.col("_h")
    kernel = F.exp(-0.5 * z * z) * F.col("_w") / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))
    return points.groupBy(*keys, "_i", "x").agg(F.sum(kernel).alias("density")).drop("_i")


def violin_stats(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """Rows (column, by, n, min, q1, median, q3, max) per class."""
    aggs = []
    for i, c in enumerate(cols):
        x = clean_double(c)
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    one = df.groupBy(by).agg(*aggs)
    records = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"lo{i}").alias("min"),
                 F.col(f"hi{i}").alias("max")) for i, c in enumerate(cols)
    ])
    ends = one.select(by, F.explode(records).alias("r")).select(by, "r.*")
    quart = quantiles(df, cols, [0.25, 0.5, 0.75], by=[by])
    middle = quart.groupBy(by, "column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    ])
    middle = middle.withColumnRenamed(by, "_by").withColumnRenamed("column", "_column")
    joined = ends.join(middle, col(by).eqNullSafe(F.col("_by")) & (F.col("column") == F.col("_column")))
    return joined.select("column", by, "n", "min", "q1", "median", "q3", "max")


def missing_map(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """Rows (column, null_share, rank, over_limit), most missing first."""
    shares = profile(df).select("column", (F.col("null_pct") / 100.0).alias("null_share"))
    rank = F.row_number().over(Window.orderBy(F.desc("null_share"), F.asc("column")))  # one row per column
    return shares.select("column", "null_share", rank.alias("rank"), (F.col("null_share") > limit).alias("over_limit"))


def missing_sample(df: DataFrame, keys: Sequence[str], n: int = 500, seed: int = 42, portable: bool = False) -> DataFrame:
    """0/1 missing flags of n hash-chosen rows."""
    flags = [is_missing(f.name, f.dataType).cast("int").alias(f.name) for f in df.schema if f.name not in keys]
    return hash_sample(df, keys, n, seed, portable).select(*[col(k) for k in keys], *flags)


def hash_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42, portable: bool = False) -> DataFrame:
    """The n rows with the smallest key hash: a top-n, so nothing is fully sorted."""
    return df.withColumn("_h", key_hash(keys, seed, portable)).orderBy("_h", *[col(k) for k in keys]).limit(n).drop("_h")


def pairplot_sample(df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str], n: int = 5_000) -> DataFrame:
    """Complete rows of the strongest columns for a pair plot."""
    return hash_sample(df.select(*[col(k) for k in keys], *cols, target).dropna(subset=[*cols, target]), keys, n)


def corr_pairs(df: DataFrame, cols: Sequence[str] | None = None, severe: float = 0.85) -> DataFrame:
    """Rows (column_a, column_b, r, abs_r, severe) for a < b in column order."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    found = correlations(df, pairs(cols))
    return found.select("column_a", "column_b", "r", F.abs("r").alias("abs_r"), (F.abs("r") > severe).alias("severe"))


def collinear_pairs(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 0.85) -> DataFrame:
    return corr_pairs(df, cols, limit).filter("severe").select("column_a", "column_b", "r")


def top_correlated(df: DataFrame, cols: Sequence[str], target: str, k: int = 12) -> DataFrame:
    """The k columns most correlated with the target, with the sign of r."""
    found = corr_with_target(df, cols, target).filter("r is not null")
    return found.orderBy(F.desc("abs_r"), "column").limit(k).select(
        "column", "r", "abs_r", F.when(F.col("r") >= 0, "positive").otherwise("negative").alias("direction"))


def key_findings(df: DataFrame, cols: Sequence[str], target: str, top: int = 3) -> DataFrame:
    """Rows (section, item, value) from correlations, collinearity, balance, anomalies and suggestions."""
    cols = list(cols)
    # three reads of the table: all correlations, the shape of each column, the classes
    found = cut_lineage(correlations(df, pairs([*cols, target])), "correlations")
    shape = cut_lineage(df.agg(*[skew_sample(c).alias(f"s{i}") for i, c in enumerate(cols)], *[
        (F.min(col(c)).isNull() | (F.min(col(c)) == F.max(col(c)))).alias(f"c{i}") for i, c in enumerate(cols)]), "shape")
    columns = to_rows(shape, [{"column": F.lit(c), "skew": F.col(f"s{i}"), "constant": F.col(f"c{i}")} for i, c in enumerate(cols)])
    skews = columns.withColumn("extreme", F.abs("skew") > 3.0)
    own = found.filter(F.col("column_b") == target).filter("r is not null").orderBy(F.desc(F.abs("r")), "column_a").limit(top)
    close = found.filter((F.col("column_b") != target) & (F.abs("r") > 0.85))

    def rows(table: DataFrame, section: str, item: Column, value: Column) -> DataFrame:
        return table.select(F.lit(section).alias("section"), item.cast("string").alias("item"),
                            value.cast("double").alias("value"))

    parts = [
        rows(own, "top feature", F.col("column_a"), F.col("r")),
        rows(close, "collinear", F.concat_ws(" ~ ", "column_a", "column_b"), F.col("r")),
        rows(class_balance(df, target), "class share", F.col("class"), F.col("share")),
        rows(columns.filter("constant"), "constant", F.col("column"), F.lit(None)),
        rows(skews.filter("extreme"), "extreme skew", F.col("column"), F.col("skew")),
        rows(recommend_features(df, cols, target, found=found, skews=skews), "suggestion", F.col("suggestion"), F.lit(None)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
