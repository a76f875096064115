"""Running totals over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import clean_double
from ..session import cut_lineage


def bucket_of(order_col: str, edges: Sequence[float]) -> Column:
    """Number of cut points at or below the value: equal values always share a bucket."""
    if not edges:
        return F.lit(0)
    # binary search written as nested CASEs: log2(edges) comparisons per row
    x = clean_double(order_col)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(edges[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(edges))


def _ranged(df: DataFrame, order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """Rows dealt out by ranges of the ordering, with the range as ``_r``; written once, which fixes the ranges.

    The number of ranges is Spark's number of shuffle partitions unless given.
    """
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return cut_lineage(dealt.withColumn("_r", F.spark_partition_id()), "ranges")


def prefix_scan(
    df: DataFrame,
    order_col: str,
    values: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    how: str = "sum",
    ranges: int | None = None,
) -> DataFrame:
    """Collapse ties, then run ``sum`` or ``max`` along the ordering column, of any type that sorts.

    Output: one row per (by..., order value) with each value's own aggregate and
    ``cum_<value>`` including that row. Ties are combined map-side, ranges are
    scanned in parallel, and only one total per range and group is accumulated.
    A missing order value is the smallest one.
    """
    by = list(by)
    fn = {"sum": F.sum, "max": F.max}[how]
    cells = _ranged(df.groupBy(*by, order_col).agg(*[fn(c).alias(n) for n, c in values.items()]), [F.asc(order_col)], ranges)
    order = F.desc if descending else F.asc
    inside = Window.partitionBy(*by, "_r").orderBy(order(order_col))
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = cells.select("*", *[fn(n).over(inside).alias(f"cum_{n}") for n in values])
    totals = cells.groupBy(*by, "_r").agg(*[fn(n).alias(f"_t_{n}") for n in values])
    earlier = Window.partitionBy(*by).orderBy(order("_r")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_r", *[fn(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in values])
    # one row per range and group; Spark's own size threshold decides on broadcasting
    joined = scanned.alias("s").join(offsets.alias("o"), [
        F.col(f"s.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*by, "_r"]
    ], "left")
    combine = (lambda a, b: a + F.coalesce(b, F.lit(0))) if how == "sum" else (lambda a, b: F.greatest(a, b))
    kept = [F.col(f"s.{c}") for c in [*by, order_col, *values]]
    return joined.select(*kept, *[combine(F.col(f"cum_{n}"), F.col(f"_o_{n}")).alias(f"cum_{n}") for n in values])


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Number all rows 1, 2, ... within each value of ``by``, in an order that ends in a unique key.

    Value ranges are numbered in parallel and shifted by the sizes of the ranges
    before them. Writing the ranges fixes which rows each of them holds.
    """
    by = list(by)
    ranged = _ranged(df, order)
    sizes = ranged.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select(*by, "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    placed = ranged.withColumn("_p", F.row_number().over(Window.partitionBy(*by, "_r").orderBy(*order)))
    joined = placed.alias("p").join(offsets.alias("o"), [F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*by, "_r"]])
    return joined.select(*[F.col(f"p.`{c}`") for c in df.columns], (F.col("_p") + F.col("_o")).alias(name))
