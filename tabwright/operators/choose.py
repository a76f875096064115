"""Problem typing, algorithm choice, leaderboards and verdict rules, all as column rules over tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalar import clean_double, col
from .metrics import binary_metrics, roc_auc

# fixed values: name parts that mark an ordered target
ORDINAL_HINTS = ["rating", "grade", "level", "rank", "score", "tier", "stage"]
MAX_CLASSES = 20


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """One row (target, n_classes, problem_type, ordinal_hint)."""
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    hint = any(w in target.lower() for w in ORDINAL_HINTS)
    x = clean_double(target)
    whole = F.bool_and(x == F.floor(x)) if numeric else F.lit(False)
    one = df.agg(F.count_distinct(x if numeric else col(target)).alias("n"), whole.alias("whole"))
    few = (F.col("n") <= MAX_CLASSES) & F.col("whole")
    many = "ordinal_classification" if hint else "multiclass_classification"
    kind = F.when(F.col("n") == 2, "binary_classification")
    kind = kind.when(few, many).otherwise("regression") if numeric else kind.otherwise("multiclass_classification")
    return one.select(
        F.lit(target).alias("target"), kind.alias("problem_type"),
        F.when(kind != "regression", F.col("n")).alias("n_classes"), F.lit(hint).alias("ordinal_hint"))


@dataclass(frozen=True)
class Choice:
    problem: str
    rule: str
    algorithm: str
    label: str
    params: str
    reason: str


# fixed values: algorithms and their parameters per situation, first match wins;
# each rule is a condition over n_rows, minority_pct and sparsity_pct
CHOICES = [
    Choice("binary_classification", "n_rows < 10000 and minority_pct >= 20", "logistic", "Logistic Regression",
           "max_iter=1000, class_weight=balanced", "small and balanced: a linear baseline is enough"),
    Choice("binary_classification", "n_rows < 10000 and minority_pct < 20", "logistic", "Logistic Regression (balanced)",
           "max_iter=1000, class_weight=balanced", "small and imbalanced: class weights move the boundary"),
    Choice("binary_classification", "n_rows between 10000 and 100000 and minority_pct >= 20", "random_forest",
           "Random Forest", "n_estimators=200, class_weight=balanced", "mid-size and balanced: robust to noise"),
    Choice("binary_classification", "n_rows > 10000 and minority_pct >= 20", "boosted_trees", "Boosted Trees",
           "n_estimators=300, learning_rate=0.05, max_depth=6", "large and balanced: boosting pays off"),
    Choice("binary_classification", "n_rows >= 10000 and minority_pct < 20", "boosted_trees", "Boosted Trees (imbalanced)",
           "n_estimators=300, learning_rate=0.05, max_depth=6, positive weight", "large and imbalanced: weighted boosting"),
    Choice("multiclass_classification", "n_rows < 10000", "logistic", "Logistic Regression (multinomial)",
           "multinomial, max_iter=1000, class_weight=balanced", "small with several classes: multinomial baseline"),
    Choice("multiclass_classification", "n_rows >= 10000", "boosted_trees", "Boosted Trees (multiclass)",
           "n_estimators=300, learning_rate=0.05, num_leaves=63, class_weight=balanced", "large with several classes"),
    Choice("ordinal_classification", "true", "boosted_trees", "Boosted Trees (ordinal)",
           "n_estimators=300, learning_rate=0.05, max_depth=5", "ordered classes as ranked codes"),
    Choice("regression", "n_rows < 50000 and sparsity_pct < 50", "random_forest", "Random Forest Regressor",
           "n_estimators=200", "mid-size and dense: nonlinear without scaling"),
    Choice("regression", "n_rows >= 50000", "boosted_trees", "Boosted Trees Regressor",
           "n_estimators=300, learning_rate=0.05, max_depth=6", "large: boosting scales"),
    Choice("regression", "sparsity_pct >= 50", "huber", "Huber Regression",
           "epsilon=1.35, max_iter=300", "sparse or outlier-prone: robust loss"),
]
BASELINES = {"regression": "dummy_mean, ridge"}
PRIMARY_METRIC = {"binary_classification": "roc_auc", "regression": "r2"}


def select_algorithm(profiles: DataFrame) -> DataFrame:
    """Add the chosen algorithm to profile rows (problem_type, n_rows, minority_pct, sparsity_pct, ...)."""
    kind = F.col("problem_type")

    def pick(field: str) -> Column:
        rule = None
        for c in CHOICES:
            test = (kind == c.problem) & F.expr(c.rule)
            rule = F.when(test, getattr(c, field)) if rule is None else rule.when(test, getattr(c, field))
        return rule

    return profiles.select(
        "*", pick("algorithm").alias("algorithm"), pick("label").alias("label"), pick("params").alias("params"),
        pick("reason").alias("reason"),
        F.when(kind == "regression", BASELINES["regression"]).otherwise("dummy_majority, logistic").alias("baselines"),
        F.when(kind == "binary_classification", PRIMARY_METRIC["binary_classification"])
        .when(kind == "regression", PRIMARY_METRIC["regression"]).otherwise("f1_weighted").alias("primary_metric"),
    )


# leaderboards ---------------------------------------------------------------

LEADERBOARD_COLUMNS = ["model", "auc_train", "auc_val", "f1_val", "recall_val", "precision_val", "gap"]


def evaluate_splits(scored: DataFrame, model: str = "model", y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Leaderboard rows from a long score table (model, split, y, p): every model in one pass per metric."""
    keys = [model, "split"]
    kept = scored.filter(F.col("split").isin("train", "val"))
    auc = roc_auc(kept, y, p, by=keys)
    called = kept.withColumn("_d", (clean_double(p) >= threshold).cast("int"))
    rates = binary_metrics(called, y, "_d", by=keys)
    both = auc.join(rates, keys).groupBy(F.col(model).alias("model")).agg(*[
        F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{n}_{s}")
        for s, c, n in (("train", "roc_auc", "auc"), ("val", "roc_auc", "auc"), ("val", "f1", "f1"),
                        ("val", "recall", "recall"), ("val", "precision", "precision"))
    ])
    return both.withColumn("gap", F.col("auc_train") - F.col("auc_val")).select(*LEADERBOARD_COLUMNS)


def leaderboard(rows: DataFrame, overfit_gap: float = 0.08, leak_margin: float = 0.01) -> DataFrame:
    """Rank by validation score and flag overfitting and leakage. One row per model."""
    rank = F.row_number().over(Window.orderBy(F.desc("auc_val"), F.asc("model")))
    flag = (
        F.when(F.col("auc_val") > F.col("auc_train") + leak_margin, "LEAKAGE")
        .when(F.col("gap") > overfit_gap, "OVERFIT").otherwise("OK"))
    return rows.select("*", rank.alias("rank"), flag.alias("flag"))


def rank_models(rows: DataFrame, score: str = "auc_val") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc("model"))))


def exclude_baseline(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.lower("model").contains("dummy"))


def round_metrics(rows: DataFrame, cols: Sequence[str], digits: int = 4, names: dict[str, str] | None = None) -> DataFrame:
    return rows.withColumns({c: F.round(col(c), digits) for c in cols}).withColumnsRenamed(names or {})


# verdict rules --------------------------------------------------------------

def overfit_verdict(train, test, val=None, rule: str = "general") -> Column:
    """Verdict from train and test scores; ``simple`` also looks at the validation score."""
    train, test = col(train), col(test)
    gap = train - test
    if rule == "simple":
        val = col(val)
        return (
            F.when(train - val > 0.08, "OVERFIT").when(test > train + 0.01, "LEAKAGE")
            .when(train - val < 0, "SUSPICIOUS").otherwise("HEALTHY"))
    return (
        F.when(gap < -0.01, "SUSPECTED DATA LEAKAGE").when(gap < 0.03, "WELL-GENERALIZED")
        .when(gap <= 0.08, "SLIGHT OVERFIT (ACCEPTABLE)").otherwise("OVERFIT"))


def stability_summary(scores: DataFrame, score: str = "roc_auc", by: Sequence[str] = (), limit: float = 0.02) -> DataFrame:
    """Mean, population std and coefficient of variation of repeated scores, with a verdict."""
    one = scores.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    cv = F.try_divide(F.col("std"), F.when(F.col("mean") != 0, F.col("mean")))
    return one.select(*by, "mean", "std", cv.alias("cv"), F.when(cv < limit, "STABLE").otherwise("UNSTABLE").alias("verdict"))


def cv_summary(fold_scores: DataFrame, unstable: float = 0.05) -> DataFrame:
    """Rows (metric, part) with mean, std, min, max over folds from (fold, part, metric, value)."""
    return fold_scores.groupBy("metric", "part").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    ).withColumn("verdict", F.when((F.col("part") == "val") & (F.col("std") > unstable), "UNSTABLE").otherwise("STABLE"))


def feature_stability(importances: DataFrame, top_n: int = 10, min_share: float = 0.5) -> DataFrame:
    """Rows (feature, appearances, share, verdict) from (run, feature, importance)."""
    order = Window.partitionBy("run").orderBy(F.desc("importance"), F.asc("feature"))
    top = importances.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top_n)
    runs = importances.agg(F.count_distinct("run")).scalar()
    seen = top.groupBy("feature").agg(F.count(F.lit(1)).alias("appearances"))
    share = F.col("appearances") / runs
    return seen.select("feature", "appearances", share.alias("share"),
                       F.when(share >= min_share, "STABLE").otherwise("UNSTABLE").alias("verdict"))


def learning_diagnosis(curve: DataFrame, rule: str = "validator") -> DataFrame:
    """One row (final_gap, improving, diagnosis) from a learning curve (step, train_mean, val_mean)."""
    one = curve.agg(
        F.max("step").alias("last"), F.count(F.lit(1)).alias("n"),
        F.max_by("train_mean", "step").alias("train"), F.max_by("val_mean", "step").alias("val"),
        F.sort_array(F.collect_list(F.struct("step", "val_mean"))).alias("all"))  # one entry per curve size
    middle = F.element_at(F.col("all"), (F.floor(F.col("n") / 2) + 1).cast("int"))["val_mean"]
    gap, improving = F.col("train") - F.col("val"), (F.col("val") - middle) > 0.01
    if rule == "trainer":
        text = F.when(gap > 0.08, "overfitting").when(~improving, "high bias").otherwise("learning well")
    else:
        text = (
            F.when((F.col("val") < 0.70) & ~improving, "high bias").when(gap > 0.08, "high variance")
            .when(improving, "benefits from more data").otherwise("converged"))
    return one.select(gap.alias("final_gap"), improving.alias("improving"), text.alias("diagnosis"))


def best_so_far(trials: DataFrame, trial: str = "trial", value: str = "value", **kw) -> DataFrame:
    """Rows (trial, value, best) along the trial number, scanned in parallel ranges."""
    from .prefix import prefix_scan
    found = prefix_scan(trials, trial, {value: col(value)}, how="max", **kw)
    return found.select(trial, value, F.col(f"cum_{value}").alias("best"))
