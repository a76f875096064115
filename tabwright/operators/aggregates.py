"""Shared aggregation primitives: wide aggregates, exact quantiles, modes, counts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import clean_double, col, skew_sample
from ..session import cut_lineage

EXPRESSIONS_PER_PASS = 100
EXACT_ROWS = 50_000
SKETCH_ACCURACY = 10_000
FINEST_SKETCH = 200_000


def wide_agg(df: DataFrame, exprs: Mapping[str, Column]) -> dict:
    """Evaluate named aggregates in as few scans as possible and return one dict."""
    names = list(exprs)
    result: dict = {}
    for start in range(0, len(names), EXPRESSIONS_PER_PASS):
        chunk = names[start:start + EXPRESSIONS_PER_PASS]
        result.update(df.agg(*[exprs[n].alias(n) for n in chunk]).first().asDict())
    return result


def to_rows(one_row: DataFrame, records: Sequence[Mapping[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """Turn columns of an aggregate into one row per record, without leaving Spark."""
    structs = [F.struct(*[c.alias(n) for n, c in r.items()]) for r in records]
    exploded = one_row.select(F.struct(*[col(k) for k in keep]).alias("_kept") if keep else F.lit(None).alias("_kept"), F.explode(F.array(*structs)).alias("_record"))
    return exploded.select(*[col("_kept").getField(k).alias(k) for k in keep], "_record.*")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


# quantiles ------------------------------------------------------------------

class _Slot:
    """One wanted quantile and the closed value interval known to hold it.

    Each end carries two exact ranks: how many values are below it, and how many
    are not above it.
    """

    def __init__(self, column, prob, n, name):
        self.column, self.prob, self.n, self.name, self.x = column, prob, n, name, F.col(name)
        self.rank = (n - 1) * prob
        self.lo, self.below_lo, self.upto_lo = None, 0, 0
        self.hi, self.below_hi, self.upto_hi = None, n, n
        self.margin = 0.0
        self.value = None

    @property
    def between(self) -> int:
        return self.below_hi - self.upto_lo

    def strictly_inside(self) -> Column:
        above = F.lit(True) if self.lo is None else self.x > F.lit(self.lo)
        under = F.lit(True) if self.hi is None else self.x < F.lit(self.hi)
        return F.when(above & under, self.x)

    def sketch_probs(self) -> list[float]:
        at = (self.rank - self.upto_lo) / max(self.between - 1, 1)
        return [min(max(at - self.margin, 0.0), 1.0), min(max(at + self.margin, 0.0), 1.0)]

    def take(self, a: float, b: float, c: dict) -> None:
        """Move the ends to a and b where the exact ranks show that nothing wanted is cut off."""
        moved = False
        if c["below_a"] <= math.floor(self.rank):
            self.lo, self.below_lo, self.upto_lo, moved = a, c["below_a"], c["upto_a"], True
        if math.ceil(self.rank) < c["upto_b"]:
            self.hi, self.below_hi, self.upto_hi, moved = b, c["below_b"], c["upto_b"], True
        if self.lo is not None and math.ceil(self.rank) < self.upto_lo:
            self.hi, self.below_hi, self.upto_hi = self.lo, self.below_lo, self.upto_lo
        elif self.hi is not None and math.floor(self.rank) >= self.below_hi:
            self.lo, self.below_lo, self.upto_lo = self.hi, self.below_hi, self.upto_hi
        if not moved:
            self.margin *= 2
            if self.margin > 4:
                raise ArithmeticError(f"quantile {self.prob} of {self.column} could not be enclosed")


def _agg_slots(df, slots, make) -> list[dict]:
    """Run several aggregates per slot over the whole table, in chunks."""
    exprs = {f"{i}:{k}": c for i, s in enumerate(slots) for k, c in make(s).items()}
    flat = wide_agg(df, exprs)
    out: list[dict] = [{} for _ in slots]
    for key, value in flat.items():
        i, k = key.split(":")
        out[int(i)][k] = value
    return out


def _ranks(df: DataFrame, slots: Sequence[_Slot], ends: dict) -> list[dict]:
    """How many values lie below and up to the proposed ends of each slot: one scan, each value sought among all ends."""
    points: dict[str, np.ndarray] = {}
    for s in slots:
        points[s.name] = np.union1d(points.get(s.name, []), np.array(ends[id(s)], float))
    names = list(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, len(points[n]) + 1), np.int64) for n in names]
        for b in batches:
            for i, n in enumerate(names):
                v = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                for row, side in enumerate(("right", "left")):
                    total[i][row] += np.bincount(np.searchsorted(points[n], v, side), minlength=len(points[n]) + 1)
        for i, n in enumerate(names):
            below, upto = total[i].cumsum(axis=1)[:, :-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(below), i, np.int32)), pa.array(np.arange(len(below), dtype=np.int32)), pa.array(below), pa.array(upto)],
                                             ["column", "place", "below", "upto"])

    parts = df.select(*names).mapInArrow(run, "column int, place int, below long, upto long")
    found = {(r["column"], r["place"]): (r["below"], r["upto"]) for r in parts.groupBy("column", "place").agg(F.sum("below").alias("below"), F.sum("upto").alias("upto")).collect()}

    def at(s: _Slot, value: float) -> tuple[int, int]:
        return found[names.index(s.name), int(np.searchsorted(points[s.name], value))]

    out = []
    for s in slots:
        (below_a, upto_a), (below_b, upto_b) = [at(s, v) for v in ends[id(s)]]
        out.append({"below_a": below_a, "upto_a": upto_a, "below_b": below_b, "upto_b": upto_b})
    return out


def _picked(df: DataFrame, slots: Sequence[_Slot]) -> list[float]:
    """The quantile of each slot from the values within its ends, ranked in one scan and one short window per slot."""
    names = sorted({s.name for s in slots})
    wanted = [(names.index(s.name), -np.inf if s.lo is None else s.lo, np.inf if s.hi is None else s.hi) for s in slots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.unique(b.column(i).drop_null().to_numpy(zero_copy_only=False), return_counts=True) for i in range(len(names))]
            cut = [(np.searchsorted(each[i][0], lo, "left"), np.searchsorted(each[i][0], hi, "right")) for i, lo, hi in wanted]
            sizes = [max(int(z - a), 0) for a, z in cut]
            if any(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(len(wanted), dtype=np.int32), sizes)), *[
                        pa.array(np.concatenate([each[i][k][a:z] for (i, _, _), (a, z) in zip(wanted, cut) if z > a])) for k in (0, 1)]],
                    ["slot", "value", "n"])

    counts = df.select(*names).mapInArrow(run, "slot int, value double, n long").groupBy("slot", "value").agg(F.sum("n").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("slot").orderBy("value")))
    ranks = df.sparkSession.createDataFrame([(i, math.floor(s.rank) - s.below_lo, math.ceil(s.rank) - s.below_lo) for i, s in enumerate(slots)], "slot int, low long, high long")
    on = lambda r: (F.col(r) >= F.col("upto") - F.col("n")) & (F.col(r) < F.col("upto"))
    hit = upto.join(F.broadcast(ranks), "slot").groupBy("slot").agg(F.max(F.when(on("low"), F.col("value"))).alias("low"), F.max(F.when(on("high"), F.col("value"))).alias("high"))
    found = {r["slot"]: (r["low"], r["high"]) for r in hit.collect()}
    out = []
    for i, s in enumerate(slots):
        low, high = found[i]
        out.append(low if low == high else (math.ceil(s.rank) - s.rank) * low + (s.rank - math.floor(s.rank)) * high)
    return out


def _narrow(df: DataFrame, slots: list[_Slot], ends: dict, exact_rows: int, accuracy: int) -> None:
    """Shrink each slot's interval until few values lie strictly inside it.

    ``ends`` holds a first proposal per slot from a rank sketch. Exact counts decide
    on proposals; where too much is left, a sketch over the open interval proposes
    again. A round is two scans with bounded state. Each end taken over leaves the
    open interval, so every round makes it smaller, and a value repeated in many
    rows goes with one step.
    """
    for s in slots:
        s.margin = 2.0 / accuracy
    while wide := [s for s in slots if s.between > exact_rows]:
        if not ends:
            proposals = _agg_slots(df, wide, lambda s: {
                "q": F.percentile_approx(s.strictly_inside(), s.sketch_probs(), accuracy)
            })
            ends = {id(s): p["q"] for s, p in zip(wide, proposals)}

        for s, c in zip(wide, _ranks(df, wide, ends)):
            s.take(*ends[id(s)], c)
        ends = {}


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    exact: bool = True,
    exact_rows: int = EXACT_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Linear-interpolation quantiles as rows (by..., column, prob, value).

    Up to ``exact_rows`` values per group the built-in ``percentile`` runs directly.
    Beyond that its per-group value map would not fit one task. Of whole columns the
    answer is then first enclosed by sketches and exact counts, and ``percentile``
    sees only the enclosed values; large groups, however many, are ranked together
    in value ranges. Either way the result is exact. ``exact=False`` uses the sketch
    alone. Grouping columns may have any name but column, prob and value.
    """
    by, cols, probs = list(by), list(cols), [float(p) for p in probs]
    keys, x = [f"_k{i}" for i in range(len(by))], [f"_x{i}" for i in range(len(cols))]
    rows = df.select(*[col(b).alias(k) for b, k in zip(by, keys)], *[clean_double(c).alias(v) for c, v in zip(cols, x)])

    def named(found: DataFrame) -> DataFrame:
        return found.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "column", "prob", "value")

    def table(some: DataFrame, fn) -> DataFrame:
        one = some.groupBy(*keys).agg(*[fn(F.col(v)).alias(f"_q{i}") for i, v in enumerate(x)])
        missing = F.lit([None] * len(probs)).cast("array<double>")  # a column without values has no array
        each = F.array(*[F.struct(F.lit(c).alias("column"), F.arrays_zip(F.lit(probs).alias("prob"), F.coalesce(f"_q{i}", missing).alias("value")).alias("_all"))
                         for i, c in enumerate(cols)])
        columns = one.select(*keys, F.explode(each).alias("_c"))
        return columns.select(*keys, "_c.column", F.explode("_c._all").alias("_r")).select(*keys, "column", "_r.prob", "_r.value")

    if not exact:
        return named(table(rows, lambda v: F.percentile_approx(v, probs, accuracy)))
    sizes = rows.groupBy(*keys).agg(*[F.count(v).alias(f"_n{i}") for i, v in enumerate(x)])
    large = sizes.filter(F.greatest(*[F.col(f"_n{i}") for i in range(len(cols))], F.lit(0)) > exact_rows)
    if not by:
        one = sizes.first()
        if max([*one, 0]) <= exact_rows:
            return named(table(rows, lambda v: F.percentile(v, probs)))
        return df.sparkSession.createDataFrame(_column_quantiles(rows, cols, x, list(one), probs, exact_rows, accuracy), "column string, prob double, value double")
    large = cut_lineage(large, "large-groups")  # rows / exact_rows of them at most
    if not large.limit(1).count():
        return named(table(rows, lambda v: F.percentile(v, probs)))
    marked = large.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)])
    few = table(rows.join(marked, same, "left_anti"), lambda v: F.percentile(v, probs))
    return named(few.unionByName(_ranked_quantiles(rows.join(marked, same, "left_semi"), large, keys, cols, x, probs)))


def _column_quantiles(rows: DataFrame, cols: Sequence[str], x: Sequence[str], sizes: Sequence[int], probs: Sequence[float], exact_rows: int, accuracy: int) -> list[tuple]:
    """(column, prob, value) of whole columns by enclosure; one slot per column and probability."""
    # a finer sketch of more rows, so that its proposals mostly hold few enough values at once
    accuracy = max(accuracy, min(8 * max(sizes) // exact_rows, FINEST_SKETCH))
    around = [min(max(p + side * 2.0 / accuracy, 0.0), 1.0) for p in probs for side in (-1, 1)]
    first = rows.agg(*[F.percentile_approx(v, around, accuracy).alias(f"_a{i}") for i, v in enumerate(x)]).first()
    slots = [_Slot(c, p, n, v) for c, v, n in zip(cols, x, sizes) for p in probs]
    ends = {id(s): first[f"_a{i // len(probs)}"][2 * (i % len(probs)):][:2] for i, s in enumerate(slots) if s.n}
    known = [s for s in slots if s.n]
    _narrow(rows, known, ends, exact_rows, accuracy)
    for s, v in zip(known, _picked(rows, known) if known else []):
        s.value = v
    return [(s.column, s.prob, s.value) for s in slots]


def _ranked_quantiles(rows: DataFrame, sizes: DataFrame, keys: Sequence[str], cols: Sequence[str], x: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(keys..., column, prob, value) of groups of any size and number.

    Equal values of a group are counted map-side and summed up along value ranges, so
    a large group is shared by many tasks. Each value then looks up, in its group's
    short table of wanted ranks, whether one falls on it.
    """
    from .prefix import prefix_scan
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(v).alias("value")) for c, v in zip(cols, x)])).alias("_c")
    long = rows.select(*keys, each).select(*keys, "_c.column", "_c.value").filter(F.col("value").isNotNull())
    scanned = prefix_scan(long, "value", {"_n": F.lit(1)}, by=[*keys, "column"])
    of = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n")) for i, c in enumerate(cols)])).alias("_c")
    at = [(F.col("_c.n") - 1) * F.lit(p) for p in probs]
    wanted = F.array(*[F.struct(F.lit(p).alias("prob"), a.alias("at"), F.floor(a).alias("lo"), F.ceil(a).alias("hi")) for p, a in zip(probs, at)])
    targets = sizes.select(*keys, of).select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], F.col("_c.column").alias("_column"), F.col("_c.n").alias("_size"), wanted.alias("_wanted"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(keys)], F.col("column") == F.col("_column"))
    on = lambda r: (r >= F.col("cum__n") - F.col("_n")) & (r < F.col("cum__n"))
    hit = scanned.join(targets, same).select(*keys, "column", "value", "cum__n", "_n", F.explode(F.filter("_wanted", lambda w: on(w["lo"]) | on(w["hi"]))).alias("_w"))
    ends = hit.groupBy(*keys, "column", F.col("_w.prob").alias("prob")).agg(
        F.max(F.when(on(F.col("_w.lo")), F.col("value"))).alias("_lo"), F.max(F.when(on(F.col("_w.hi")), F.col("value"))).alias("_hi"), F.max("_w.at").alias("_at"))
    low, high = F.floor("_at"), F.ceil("_at")
    value = F.when(low == high, F.col("_lo")).otherwise((high - F.col("_at")) * F.col("_lo") + (F.col("_at") - low) * F.col("_hi"))
    found = ends.select(*keys, "column", "prob", value.alias("value"))
    # a group's column without any value still has its rows
    empty = targets.filter("_size = 0").select(*[F.col(f"_t{i}").alias(k) for i, k in enumerate(keys)], F.col("_column").alias("column"),
                                               F.explode(F.lit(list(probs)).cast("array<double>")).alias("prob"), F.lit(None).cast("double").alias("value"))
    return found.unionByName(empty)


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **kw) -> dict[str, list]:
    """Quantiles of whole columns as {column: [value per prob]}; one small result row per pair."""
    found = {(r["column"], r["prob"]): r["value"] for r in quantiles(df, cols, probs, **kw).collect()}
    return {c: [found[(c, float(p))] for p in probs] for c in cols}


# modes, value counts, distinct counts ---------------------------------------

def value_counts(df: DataFrame, name: str, top_n: int | None = 20) -> DataFrame:
    """Rows (value, n) by falling count, value breaking ties; missing values are left out."""
    counts = (
        df.filter(col(name).isNotNull())
        .groupBy(col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("value"))
    )
    return counts.limit(top_n) if top_n else counts


def value_shares(df: DataFrame, name: str) -> DataFrame:
    """Share of the non-missing rows per value; the total is the sum of the counts."""
    counts = (
        df.filter(col(name).isNotNull())
        .groupBy(col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(F.sum("n").alias("total"))
    return counts.select("value", "n", (F.col("n") / total.scalar()).alias("share"))


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on ties.

    Counted per (column, value) first, so a column with many values is spread
    over all tasks and never held in one aggregation buffer.
    """
    result: dict[str, object] = {c: None for c in cols}
    kinds: dict[str, list[str]] = {}
    for c in cols:
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for kind, names in kinds.items():
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in names
        ])).alias("r")).select("r.*").filter(F.col("value").isNotNull())
        if kind in ("double", "float"):
            long = long.filter(~F.isnan("value"))
        counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"))
        for r in best.select("column", "b.value").collect():
            result[r["column"]] = r["value"]
    return result


def n_unique(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Rows (column, n_unique) over non-missing values."""
    fn = F.count_distinct if exact else F.approx_count_distinct
    one = df.agg(*[fn(col(c)).alias(f"u{i}") for i, c in enumerate(cols)])
    return to_rows(one, [{"column": F.lit(c), "n_unique": F.col(f"u{i}")} for i, c in enumerate(cols)])


# numeric summaries ----------------------------------------------------------

def describe_numeric(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> DataFrame:
    """Rows (column, n, mean, median, std, min, max, skew)."""
    std = F.stddev_samp if ddof else F.stddev_pop
    aggs, records = [], []
    for i, c in enumerate(cols):
        x = clean_double(c)
        aggs += [
            F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), std(x).alias(f"std{i}"),
            F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), skew_sample(c).alias(f"skew{i}"),
        ]
        records.append({"column": F.lit(c), **{k: F.col(f"{k}{i}") for k in ("n", "mean", "std", "min", "max", "skew")}})
    shape = to_rows(df.agg(*aggs), records)
    median = quantiles(df, cols, [0.5]).select("column", F.col("value").alias("median"))
    return shape.join(median, "column").select("column", "n", "mean", "median", "std", "min", "max", "skew")


def grouped_median(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """Median per class, and per column the ratio of the largest to the smallest median."""
    medians = quantiles(df, cols, [0.5], by=[by]).select("column", by, F.col("value").alias("median"))
    spread = medians.groupBy("column").agg(
        F.try_divide(F.max("median"), F.when(F.min("median") != 0, F.min("median"))).alias("ratio")
    )
    return medians.join(spread, "column")


def variances(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> DataFrame:
    fn = F.var_samp if ddof else F.var_pop
    one = df.agg(*[fn(clean_double(c)).alias(f"v{i}") for i, c in enumerate(cols)])
    return to_rows(one, [{"column": F.lit(c), "variance": F.col(f"v{i}")} for i, c in enumerate(cols)])


def share(condition: Column) -> Column:
    """Share of rows meeting a condition, as an aggregate."""
    return F.avg(condition.cast("double"))


def pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    """Column pairs i < j."""
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def correlations(df: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows (column_a, column_b, r): Pearson over rows where both are present, from one scan.

    Few pairs are aggregates side by side. More would not fit one aggregate, so each
    row is taken once per first column and correlated with all second columns.
    """
    null = F.lit(None).cast("double")
    if len(wanted) <= EXPRESSIONS_PER_PASS:
        one = df.agg(*[F.corr(clean_double(a), clean_double(b)).alias(f"r{i}") for i, (a, b) in enumerate(wanted)])
        return to_rows(one, [{"column_a": F.lit(a), "column_b": F.lit(b), "r": F.nanvl(F.col(f"r{i}"), null)} for i, (a, b) in enumerate(wanted)])
    first, second = list(dict.fromkeys(a for a, _ in wanted)), list(dict.fromkeys(b for _, b in wanted))
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("column_a"), clean_double(a).alias("x")) for a in first])).alias("s")
    rows = df.select(*[clean_double(b).alias(f"y{j}") for j, b in enumerate(second)], sides)
    each = rows.groupBy("s.column_a").agg(*[F.corr(F.col("s.x"), F.col(f"y{j}")).alias(f"r{j}") for j in range(len(second))])
    found = to_rows(each, [{"column_b": F.lit(b), "r": F.nanvl(F.col(f"r{j}"), null)} for j, b in enumerate(second)], keep=["column_a"])
    partners: dict[str, list[str]] = {}
    for a, b in wanted:
        partners.setdefault(a, []).append(b)
    pair_map = F.create_map(*[x for a, bs in partners.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))])
    return found.filter(F.array_contains(pair_map[F.col("column_a")], F.col("column_b"))).select("column_a", "column_b", "r")


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Rows (column, r, abs_r) against the target."""
    found = correlations(df, [(c, target) for c in cols])
    return found.select(F.col("column_a").alias("column"), "r", F.abs("r").alias("abs_r"))


def crosstab_pct(df: DataFrame, category: str, target: str, top_n: int = 10) -> DataFrame:
    """Row-normalised shares (category, target, n, pct) for the most frequent categories."""
    cells = (
        df.filter(col(category).isNotNull() & col(target).isNotNull())
        .groupBy(col(category).alias("category"), col(target).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    )
    top = (
        cells.groupBy("category").agg(F.sum("n").alias("total"))
        .orderBy(F.desc("total"), "category").limit(top_n)
    )
    joined = cells.join(F.broadcast(top), "category")  # at most top_n rows
    return joined.select("category", "target", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))
