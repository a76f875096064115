"""Model metrics as aggregates over score tables with label y, probability p and decision pred."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import as_flag, clean_double, col, skew_sample
from .aggregates import quantiles, to_rows
from .prefix import bucket_of, prefix_scan


def _scan(df: DataFrame, y: str, p: str, by: Sequence[str] = (), bins: int | None = None,
          ranges: int | None = None) -> DataFrame:
    """Positives and negatives per distinct score with totals from the top score down."""
    score = F.floor(clean_double(p) * bins) / F.lit(bins) if bins else clean_double(p)
    rows = df.select(*[col(b) for b in by], score.alias("score"), col(y).cast("int").alias("y"))
    rows = rows.filter(F.col("score").isNotNull() & F.col("y").isNotNull())
    positive = F.col("y") == 1
    return prefix_scan(
        rows, "score", {"pos": as_flag(positive), "neg": as_flag(~positive)},
        by=by, descending=True, ranges=ranges,
    )


def _auc_expr() -> Column:
    pos, neg, above = (F.col(c).cast("double") for c in ("pos", "neg", "cum_neg"))
    both = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    # negatives ranked above a positive, ties counting half
    wrong = F.sum(pos * above) - F.sum(pos * neg) / 2
    return 1 - F.try_divide(wrong, F.when(both > 0, both))


def _ap_expr() -> Column:
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return F.try_divide(F.sum(F.col("pos") * precision), F.when(F.sum("pos") > 0, F.sum("pos")))


def ranking_metrics(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), **kw) -> DataFrame:
    """Rows (by..., roc_auc, average_precision), ties averaged and steps summed; one shuffle."""
    return _scan(df, y, p, by, **kw).groupBy(*by).agg(
        _auc_expr().alias("roc_auc"), _ap_expr().alias("average_precision"))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), **kw) -> DataFrame:
    return ranking_metrics(df, y, p, by, **kw).select(*by, "roc_auc")


def average_precision(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), **kw) -> DataFrame:
    return ranking_metrics(df, y, p, by, **kw).select(*by, "average_precision")


def _totals(df: DataFrame, y: str, p: str) -> DataFrame:
    usable = df.filter(clean_double(p).isNotNull() & col(y).isNotNull())
    return usable.agg(F.count(F.when(col(y) == 1, 1)).alias("p"), F.count(F.when(col(y) != 1, 1)).alias("n"))


def roc_curve(df: DataFrame, y: str = "y", p: str = "p", bins: int | None = None, **kw) -> DataFrame:
    """Rows (threshold, fpr, tpr): one per distinct score, or per score bin for a bounded table."""
    totals = _totals(df, y, p)
    return _scan(df, y, p, bins=bins, **kw).select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg"), totals.select("n").scalar()).alias("fpr"),
        F.try_divide(F.col("cum_pos"), totals.select("p").scalar()).alias("tpr"),
    )


def best_roc_point(df: DataFrame, y: str = "y", p: str = "p", **kw) -> DataFrame:
    """The point nearest to (0, 1), with AUC and its improvement over chance in percent."""
    curve = roc_curve(df, y, p, **kw)
    gap = F.sqrt(F.pow("fpr", 2) + F.pow(1 - F.col("tpr"), 2))
    best = curve.select(F.struct(gap.alias("distance"), (-F.col("threshold")).alias("_o"), "threshold", "fpr", "tpr").alias("s"))
    point = best.agg(F.min("s").alias("s")).select("s.threshold", "s.fpr", "s.tpr", "s.distance")
    auc = roc_auc(df, y, p, **kw).scalar()
    return point.select("threshold", "fpr", "tpr", "distance", auc.alias("roc_auc"), ((auc - 0.5) / 0.5 * 100).alias("over_chance_pct"))


def pr_curve(df: DataFrame, y: str = "y", p: str = "p", bins: int | None = None,
             only_if_minority_below: float | None = None, **kw) -> DataFrame:
    """Rows (threshold, precision, recall, no_skill, lift); empty when the classes are balanced enough."""
    totals = _totals(df, y, p)
    positives = totals.select("p").scalar()
    base = totals.select(F.try_divide(F.col("p"), F.col("p") + F.col("n"))).scalar()
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    out = _scan(df, y, p, bins=bins, **kw).select(
        F.col("score").alias("threshold"), precision.alias("precision"),
        F.try_divide(F.col("cum_pos"), positives).alias("recall"), base.alias("no_skill"),
    ).withColumn("lift", F.try_divide(F.col("precision"), F.col("no_skill")))
    if only_if_minority_below is None:
        return out
    return out.filter(F.least(F.col("no_skill"), 1 - F.col("no_skill")) < only_if_minority_below)


def pr_summary(df: DataFrame, y: str = "y", p: str = "p", **kw) -> DataFrame:
    """One row (average_precision, no_skill, lift)."""
    ap = average_precision(df, y, p, **kw)
    base = _totals(df, y, p).select(F.try_divide(F.col("p"), F.col("p") + F.col("n")).alias("b")).scalar()
    return ap.select("average_precision", base.alias("no_skill")).withColumn(
        "lift", F.try_divide(F.col("average_precision"), F.col("no_skill")))


# decisions ------------------------------------------------------------------

def confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Rows (actual, predicted, n, row_share); the share is taken over the grouped cells."""
    cells = df.groupBy(col(y).alias("actual"), col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def worst_confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """The off-diagonal cell with the most rows; the first one on ties."""
    cells = confusion(df, y, pred).filter("actual <> predicted")
    best = cells.select(F.struct((-F.col("n")).alias("_o"), "actual", "predicted", "n", "row_share").alias("s"))
    return best.agg(F.min("s").alias("s")).select("s.actual", "s.predicted", "s.n", "s.row_share")


def decision_counts(y: str = "y", pred: str = "pred") -> dict[str, Column]:
    """Aggregates tp, fp, fn, tn."""
    actual, called = col(y) == 1, col(pred) == 1
    return {
        "tp": F.count(F.when(actual & called, 1)), "fp": F.count(F.when(~actual & called, 1)),
        "fn": F.count(F.when(actual & ~called, 1)), "tn": F.count(F.when(~actual & ~called, 1)),
    }


def rates() -> dict[str, Column]:
    """accuracy, precision, recall and f1 from columns tp, fp, fn, tn; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {
        "accuracy": zero(tp + tn, tp + fp + fn + tn), "precision": zero(tp, tp + fp),
        "recall": zero(tp, tp + fn), "f1": zero(2 * tp, 2 * tp + fp + fn),
    }


def binary_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*by).agg(*[c.alias(n) for n, c in decision_counts(y, pred).items()])
    return counts.select(*by, "tp", "fp", "fn", "tn", *[c.alias(n) for n, c in rates().items()])


def class_report(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., class, precision, recall, f1, support) for every class seen or predicted."""
    cells = df.groupBy(*by, col(y).alias("a"), col(pred).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("a").alias("class"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(zero).alias("tp"),
                 F.col("n").alias("support"), zero.alias("called")),
        F.struct(F.col("b").alias("class"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("called")),
    )
    per = cells.select(*by, F.explode(sides).alias("s")).groupBy(*by, F.col("s.class").alias("class")).agg(
        F.sum("s.tp").alias("tp"), F.sum("s.support").alias("support"), F.sum("s.called").alias("called"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, support, called = F.col("tp"), F.col("support"), F.col("called")
    return per.select(
        *by, "class", ratio(tp, called).alias("precision"), ratio(tp, support).alias("recall"),
        ratio(2 * tp, support + called).alias("f1"), "support",
    )


def multiclass_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """One row per group: accuracy and weighted and macro precision, recall, f1."""
    report = class_report(df, y, pred, by)
    total = F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / total
    return report.groupBy(*by).agg(
        weighted("recall").alias("accuracy"),
        *[weighted(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")],
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
    )


def agreement(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """One row (mcc, kappa) for any number of classes, from the confusion cells."""
    cells = df.groupBy(col(y).alias("a"), col(pred).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sides = F.array(
        F.struct(F.col("a").alias("class"), F.col("n").alias("t"), F.lit(0.0).alias("p"),
                 F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0).alias("c")),
        F.struct(F.col("b").alias("class"), F.lit(0.0).alias("t"), F.col("n").alias("p"), F.lit(0.0).alias("c")),
    )
    margins = cells.select(F.explode(sides).alias("s")).groupBy("s.class").agg(
        F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum("s.c").alias("c"))
    one = margins.agg(
        F.sum("t").alias("s"), F.sum("c").alias("c"), F.sum(F.col("t") * F.col("p")).alias("tp"),
        F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    s, c, tp = F.col("s"), F.col("c"), F.col("tp")
    spread = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    return one.select(
        F.coalesce(F.try_divide(c * s - tp, F.when(spread > 0, spread)), F.lit(0.0)).alias("mcc"),
        F.try_divide(c * s - tp, s * s - tp).alias("kappa"),
    )


def mcc(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return agreement(df, y, pred).select("mcc")


def kappa(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return agreement(df, y, pred).select("kappa")


def brier(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.agg(F.avg(F.pow(clean_double(p) - col(y), 2)).alias("brier"))


def calibration(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Rows (bin, n, mean_predicted, positive_share, gap); an edge value is in the lower bin."""
    score = clean_double(p)
    slot = F.greatest(F.ceil(score * bins) - 1, F.lit(0)).cast("int")
    table = df.filter(score.isNotNull()).groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_predicted"),
        F.avg(col(y).cast("double")).alias("positive_share"))
    return table.withColumn("gap", F.abs(F.col("positive_share") - F.col("mean_predicted")))


def calibration_verdict(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    worst = calibration(df, y, p, bins).agg(F.max("gap").alias("max_gap"))
    return worst.select("max_gap", F.when(F.col("max_gap") < 0.05, "trustworthy")
                        .when(F.col("max_gap") < 0.10, "slightly overconfident")
                        .otherwise("not trustworthy").alias("verdict"))


# regression -----------------------------------------------------------------

def regression_errors(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """One row per group: mae, rmse, r2, without the median, so in one pass."""
    a, b = clean_double(y), clean_double(pred)
    err = a - b
    return df.filter(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.try_divide(F.avg(err * err), F.var_pop(a))).alias("r2"))


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """One row: mae, rmse, r2, mape_pct (zero targets left out), median_ae."""
    a, b = clean_double(y), clean_double(pred)
    err = a - b
    pairs = df.filter(a.isNotNull() & b.isNotNull())
    one = pairs.agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.try_divide(F.avg(err * err), F.var_pop(a))).alias("r2"),
        (F.avg(F.when(a != 0, F.abs(err / a))) * 100).alias("mape_pct"))
    median = quantiles(pairs.select(F.abs(err).alias("e")), ["e"], [0.5]).select("value").scalar()
    return one.withColumn("median_ae", median)


def residuals(df: DataFrame, y: str, pred: str, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, fitted, residual, standardised, root_abs_standardised)."""
    err = clean_double(y) - clean_double(pred)
    spread = df.agg(F.stddev_pop(err)).scalar()
    standard = F.col("residual") / (spread + F.lit(1e-9))
    base = df.select(*[col(k) for k in keys], clean_double(pred).alias("fitted"), err.alias("residual"))
    return base.withColumn("standardised", standard).withColumn("root_abs_standardised", F.sqrt(F.abs("standardised")))


def residual_summary(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row: residual skew and verdict, and the slope of the scale-location trend."""
    table = residuals(df, y, pred, [])
    return table.agg(
        skew_sample("residual").alias("skew"),
        F.regr_slope("root_abs_standardised", "fitted").alias("trend_slope"),
    ).withColumn("verdict", F.when(F.abs("skew") < 0.5, "approximately normal").otherwise("skewed"))


def qq_points(df: DataFrame, name: str, k: int = 200) -> DataFrame:
    """Rows (prob, theoretical, sample) for k evenly spaced probabilities."""
    probs = [(i + 0.5) / k for i in range(k)]
    normal = df.sparkSession.createDataFrame(
        [(p, NormalDist().inv_cdf(p)) for p in probs], "prob double, theoretical double")
    sample = quantiles(df, [name], probs).select("prob", F.col("value").alias("sample"))
    return normal.join(sample, "prob")


# thresholds -----------------------------------------------------------------

def thresholds(start: int = 10, stop: int = 90, step: int = 5) -> list[float]:
    """Cut-offs from whole percents, so that no rounding drift builds up."""
    return [i / 100 for i in range(start, stop + 1, step)]


def threshold_sweep(df: DataFrame, y: str = "y", p: str = "p", step: int = 5, skip_empty: bool = False,
                    cuts: Sequence[float] | None = None) -> DataFrame:
    """Rows (threshold, precision, recall, f1, flagged) from one pass over the scores.

    Rows are counted per interval between cut-offs, and each cut-off sums the
    intervals above it.
    """
    cuts = list(cuts) if cuts is not None else thresholds(step=step)
    score = clean_double(p)
    cells = df.filter(score.isNotNull()).groupBy(bucket_of(p, cuts).alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(col(y) == 1, 1)).alias("pos"))
    one = cells.agg(
        F.sum("pos").alias("all_pos"),
        *[F.coalesce(F.sum(F.when(F.col("slot") > j, F.col("n"))), F.lit(0)).alias(f"f{j}") for j in range(len(cuts))],
        *[F.coalesce(F.sum(F.when(F.col("slot") > j, F.col("pos"))), F.lit(0)).alias(f"t{j}") for j in range(len(cuts))],
    )
    table = to_rows(one, [
        {"threshold": F.lit(t), "flagged": F.col(f"f{j}"), "tp": F.col(f"t{j}"), "all_pos": F.col("all_pos")}
        for j, t in enumerate(cuts)
    ])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, flagged, positives = F.col("tp"), F.col("flagged"), F.col("all_pos")
    out = table.select(
        "threshold", ratio(tp, flagged).alias("precision"), ratio(tp, positives).alias("recall"),
        ratio(2 * tp, flagged + positives).alias("f1"), "flagged")
    return out.filter("flagged > 0") if skip_empty else out


def pick_threshold(sweep: DataFrame, recall_floor: float = 0.90, margin: float = 0.10) -> DataFrame:
    """One row: best-F1 cut-off (smallest on ties), its character, and both recall-floor cut-offs."""
    best = F.min(F.struct((-F.col("f1")).alias("o"), "threshold", "precision", "recall", "f1"))
    enough = F.col("recall") >= recall_floor
    one = sweep.agg(
        best.alias("b"), F.min(F.when(enough, F.col("threshold"))).alias("first_recall_threshold"),
        F.max(F.when(enough, F.col("threshold"))).alias("highest_recall_threshold"))
    style = (
        F.when(F.col("b.precision") > F.col("b.recall") + margin, "conservative")
        .when(F.col("b.recall") > F.col("b.precision") + margin, "aggressive").otherwise("balanced"))
    return one.select(
        F.col("b.threshold").alias("best_threshold"), F.col("b.f1").alias("best_f1"),
        F.col("b.precision").alias("best_precision"), F.col("b.recall").alias("best_recall"),
        style.alias("style"), "first_recall_threshold", "highest_recall_threshold")


def percentiles(df: DataFrame, name: str, probs: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    return quantiles(df, [name], probs).select("prob", "value")

