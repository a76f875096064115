"""Model fitting on pyspark.ml: baselines, linear and tree models, search, curves, stacking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import HASH_SPACE, col
from ..session import cut_lineage
from .aggregates import modes
from .choose import cv_summary
from .forest import Cells, collapse, fit_forest
from .metrics import multiclass_metrics, ranking_metrics, regression_errors, roc_auc
from .scoring import fill_missing_features
from .splits import folds, key_hash, nested_subset, with_weights

SEED = 42
ROWS_PER_PARTITION = 1_000_000
WORTH_A_TASK = 2_000
CLASSIFIERS = {"logistic", "random_forest", "boosted_trees", "linear_svc", "boosted_multiclass", "multinomial"}
MULTICLASS = {"boosted_multiclass", "multinomial"}
FORESTS = {"random_forest", "random_forest_regressor"}


@dataclass
class DummyModel:
    """Majority class (score 0) or mean value, as a literal column."""

    value: object
    regression: bool = False

    @classmethod
    def fit(cls, df: DataFrame, label: str, regression: bool = False) -> "DummyModel":
        if regression:
            return cls(df.agg(F.avg(col(label))).first()[0], True)
        return cls(modes(df, [label])[label])

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("pred", F.lit(self.value))
        return out if self.regression else out.withColumn("p", F.lit(0.0))


def _logistic(weight_sum: float, C: float = 1.0, **kw):
    # the penalty is per unit of weight here, hence 1 / (C * total weight)
    return LogisticRegression(
        regParam=1.0 / (C * max(weight_sum, 1e-12)), standardization=False, weightCol="weight", labelCol="label",
        maxIter=kw.pop("max_iter", 1000), **kw)


def make_estimator(algorithm: str, rows: int, params: Mapping | None = None, label_std: float = 1.0):
    """Estimator for an algorithm name with the default parameters of the choice rules.

    ``rows`` and the label's population standard deviation turn penalties given per
    sum of squares into Spark's, which are per row and per standardised label.
    """
    p = dict(params or {})
    if algorithm == "logistic":
        return _logistic(rows, p.pop("C", 1.0), family="binomial", **p)
    if algorithm == "multinomial":
        return _logistic(rows, p.pop("C", 1.0), family="multinomial", **p)
    if algorithm == "random_forest":
        return RandomForestClassifier(numTrees=p.pop("n_estimators", 200), maxDepth=p.pop("max_depth", 8), seed=p.pop("seed", SEED),
                                      weightCol="weight", labelCol="label", **p)
    if algorithm == "boosted_trees":
        return GBTClassifier(maxIter=p.pop("n_estimators", 300), maxDepth=p.pop("max_depth", 6),
                             stepSize=p.pop("learning_rate", 0.05), seed=SEED, weightCol="weight", labelCol="label", **p)
    if algorithm == "boosted_multiclass":
        inner = GBTClassifier(maxIter=p.pop("n_estimators", 300), maxDepth=p.pop("max_depth", 5),
                              stepSize=p.pop("learning_rate", 0.05), seed=SEED, labelCol="label", **p)
        return OneVsRest(classifier=inner, labelCol="label", weightCol="weight")
    if algorithm == "linear_svc":
        return LinearSVC(weightCol="weight", labelCol="label", maxIter=p.pop("max_iter", 100), **p)
    if algorithm == "random_forest_regressor":
        return RandomForestRegressor(numTrees=p.pop("n_estimators", 200), maxDepth=p.pop("max_depth", 8), seed=p.pop("seed", SEED),
                                     labelCol="label", **p)
    if algorithm == "boosted_regressor":
        return GBTRegressor(maxIter=p.pop("n_estimators", 300), maxDepth=p.pop("max_depth", 6),
                            stepSize=p.pop("learning_rate", 0.05), seed=SEED, labelCol="label", **p)
    if algorithm == "huber":
        return LinearRegression(loss="huber", epsilon=p.pop("epsilon", 1.35), maxIter=p.pop("max_iter", 300), labelCol="label", **p)
    if algorithm == "ridge":
        alpha = p.pop("alpha", 1.0)
        return LinearRegression(elasticNetParam=0.0, regParam=alpha * label_std / max(rows, 1), standardization=False,
                                solver=p.pop("solver", "auto"), labelCol="label", **p)
    raise ValueError(f"unknown algorithm {algorithm!r}")


def is_classifier(algorithm: str) -> bool:
    return algorithm in CLASSIFIERS


def problem_of(algorithm: str) -> str:
    """binary, multiclass or regression."""
    return "multiclass" if algorithm in MULTICLASS else "binary" if algorithm in CLASSIFIERS else "regression"


def prepare(df: DataFrame, features: Sequence[str], label: str, weighted: bool = True) -> DataFrame:
    """Missing features filled with 0, a double ``label``, and balanced class weights."""
    out = fill_missing_features(df.filter(col(label).isNotNull()), features)
    out = out.withColumn("label", col(label).cast("double"))
    return with_weights(out, "label") if weighted else out


def spread(df: DataFrame) -> DataFrame:
    """Even partitions for rows that many iterations will read, however they were stored.

    One per core, more where that keeps each small, and fewer where a task would have next to no rows.
    """
    n = df.count()
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_PARTITION))
    return df.repartition(max(1, min(parts, -(-n // WORTH_A_TASK))))


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features")


def ready(df: DataFrame, algorithm: str, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows as an estimator reads them (features, label, weight), spread evenly, beside the columns to ``keep``.

    Many fits can share them: with stratified folds and subsets the class weights hold for every part.
    """
    weighted = is_classifier(algorithm)
    rows = assembler(features).transform(prepare(df, features, label, weighted))
    return spread(rows.select("features", "label", *(["weight"] if weighted else []), *[c for c in keep if c not in ("features", "label", "weight")]))


def forest_cells(rows: DataFrame, algorithm: str, params: Mapping | None = None) -> Cells | None:
    """Cells that forests on the same `ready` rows can share; none for other algorithms."""
    return collapse(rows, is_classifier(algorithm), int((params or {}).get("maxBins", 32))) if algorithm in FORESTS else None


def fit_ready(rows: DataFrame, algorithm: str, params: Mapping | None = None, cells: Cells | None = None):
    """Fit on rows that are `ready` and kept; balanced weights add up to about the row count."""
    if algorithm in FORESTS:
        return fit_forest(make_estimator(algorithm, 0, params), cells or forest_cells(rows, algorithm, params), rows)
    n, spread_y = rows.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    return make_estimator(algorithm, n, params, spread_y or 1.0).fit(rows)


def with_scores(scored: DataFrame, algorithm: str) -> DataFrame:
    """Add ``pred`` and the probability ``p`` of class 1, missing where the model gives none."""
    p = F.lit(None).cast("double")
    if problem_of(algorithm) == "binary":
        p = positive_probability() if "probability" in scored.columns else 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))
    return scored.withColumns({"pred": F.col("prediction"), "p": p})


def fit(df: DataFrame, algorithm: str, features: Sequence[str], label: str, params: Mapping | None = None) -> PipelineModel:
    """Fit one model; the prepared rows are kept while the iterations run over them."""
    rows = ready(df, algorithm, features, label).persist()
    try:
        return PipelineModel([assembler(features), fit_ready(rows, algorithm, params)])
    finally:
        rows.unpersist()


def positive_probability(name: str = "probability") -> Column:
    return vector_to_array(col(name))[1]


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``pred`` and, where the model gives one, the probability ``p`` of class 1."""
    scored = model.transform(fill_missing_features(df, features))
    made = {"pred": F.col("prediction")}
    if "probability" in scored.columns:
        made["p"] = positive_probability()
    elif "rawPrediction" in scored.columns and not isinstance(model.stages[-1], OneVsRest):
        made["p"] = 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))
    extra = [c for c in ("features", "prediction", "probability", "rawPrediction") if c in scored.columns]
    return scored.withColumns(made).drop(*extra)


def coefficients(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    return dict(zip(features, [float(w) for w in model.stages[-1].coefficients]))


def rf_importance(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 8,
                  regression: bool = False, seed: int = SEED) -> DataFrame:
    """Rows (feature, importance) of a random forest, the values adding up to one."""
    algorithm = "random_forest_regressor" if regression else "random_forest"
    model = fit(df, algorithm, features, label, {"n_estimators": trees, "max_depth": depth, "seed": seed})
    values = model.stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


# search ---------------------------------------------------------------------

@dataclass(frozen=True)
class Range:
    """A search range; ``log`` draws evenly on a log scale."""

    lo: float
    hi: float
    kind: str = "float"
    log: bool = False
    choices: tuple = field(default=())

    def draw(self, rng: np.random.RandomState):
        if self.choices:
            return self.choices[rng.randint(len(self.choices))]
        if self.kind == "int":
            return int(rng.randint(int(self.lo), int(self.hi) + 1))
        if self.log:
            return float(np.exp(rng.uniform(np.log(self.lo), np.log(self.hi))))
        return float(rng.uniform(self.lo, self.hi))


# fixed values: search spaces and trial counts
SEARCH_SPACES = {
    "random_forest": {
        "n_estimators": Range(100, 500, "int"), "max_depth": Range(3, 15, "int"),
        "minInstancesPerNode": Range(2, 20, "int"),
        "featureSubsetStrategy": Range(0, 0, choices=("sqrt", "log2", "0.5")),
    },
    "boosted_trees": {
        "n_estimators": Range(100, 600, "int"), "max_depth": Range(3, 10, "int"),
        "learning_rate": Range(0.01, 0.3, log=True), "subsamplingRate": Range(0.5, 1.0),
        "featureSubsetStrategy": Range(0, 0, choices=("0.5", "0.75", "all")),
    },
    "logistic": {"C": Range(1e-4, 100, log=True)},
    "ridge": {"alpha": Range(1e-3, 100, log=True)},
    "linear_svc": {"regParam": Range(1e-4, 10, log=True)},
    "huber": {"epsilon": Range(1.1, 2.0), "regParam": Range(1e-6, 1, log=True)},
}
SEARCH_SPACES["multinomial"] = SEARCH_SPACES["logistic"]
SEARCH_SPACES["boosted_multiclass"] = SEARCH_SPACES["boosted_trees"]
SEARCH_SPACES["random_forest_regressor"] = SEARCH_SPACES["random_forest"]
SEARCH_SPACES["boosted_regressor"] = SEARCH_SPACES["boosted_trees"]
TRIALS = {"random_forest": 30, "random_forest_regressor": 30, "boosted_trees": 50, "boosted_regressor": 50}
DEFAULT_TRIALS = 20


def judge(scored: DataFrame, algorithm: str) -> float:
    """One number to maximise: ROC-AUC, weighted F1 with several classes, or the negated RMSE."""
    kind = problem_of(algorithm)
    if kind == "binary":
        return BinaryClassificationEvaluator(labelCol="label", numBins=0).evaluate(scored)
    if kind == "multiclass":
        return MulticlassClassificationEvaluator(labelCol="label", metricName="f1").evaluate(scored)
    return -RegressionEvaluator(labelCol="label", metricName="rmse").evaluate(scored)


def random_search(df: DataFrame, algorithm: str, features: Sequence[str], label: str, trials: int | None = None,
                  space: Mapping[str, Range] | None = None, seed: int = SEED):
    """Search on split=train, judged on split=val. Returns (best model, best parameters, trial table).

    The prepared rows are kept for all trials and for the last fit.
    """
    space = dict(space if space is not None else SEARCH_SPACES.get(algorithm, {}))
    rng = np.random.RandomState(seed)
    trials = trials or TRIALS.get(algorithm, DEFAULT_TRIALS)
    rows = ready(df, algorithm, features, label, ["split"]).persist()
    try:
        train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
        cells = None if "maxBins" in space else forest_cells(train, algorithm)
        results, best = [], None
        for i in range(trials):
            params = {k: r.draw(rng) for k, r in space.items()}
            model = fit_ready(train, algorithm, params, cells)
            value = float(judge(model.transform(val), algorithm))
            results.append((i, value, str(sorted(params.items()))))
            if best is None or value > best[0]:
                best = (value, params, model)
    finally:
        rows.unpersist()
    table = df.sparkSession.createDataFrame(results, "trial int, value double, params string")
    return PipelineModel([assembler(features), best[2]]), best[1], table


# curves ---------------------------------------------------------------------

def score_by_part(scored: DataFrame, by: Sequence[str], kind: str = "binary") -> DataFrame:
    """Rows (by..., metric, value) of a score table with y, pred and p.

    binary: ROC-AUC, accuracy and weighted F1; multiclass: accuracy, weighted and
    macro F1; regression: RMSE, MAE and R2.
    """
    by = list(by)
    if kind == "regression":
        return regression_errors(scored, "y", "pred", by).unpivot(by, ["rmse", "mae", "r2"], "metric", "value")
    keyed = scored.withColumn("_y", col("y").cast("int")).withColumn("_d", F.col("pred").cast("int"))
    classes = multiclass_metrics(keyed, "_y", "_d", by=by)
    if kind == "multiclass":
        return classes.unpivot(by, ["accuracy", "f1_weighted", "f1_macro"], "metric", "value")
    rank = ranking_metrics(keyed, "_y", "p", by=by).select(*by, "roc_auc")
    return rank.join(classes.select(*by, "accuracy", "f1_weighted"), by).unpivot(by, ["roc_auc", "accuracy", "f1_weighted"], "metric", "value")


def dealt(df: DataFrame, algorithm: str, label: str, keys, k: int, seed: int) -> DataFrame:
    """Labelled rows with their fold, of equal class shares where there are classes."""
    return folds(df.filter(col(label).isNotNull()), keys, k, seed, label=label if is_classifier(algorithm) else None)


def cross_validate(df: DataFrame, algorithm: str, features: Sequence[str], label: str, keys, k: int = 10,
                   params: Mapping | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(scores per fold and part, summary) for any kind of problem. One fit per fold on rows prepared once.

    Predictions are written before they are judged, so no model runs twice.
    """
    rows = ready(dealt(df, algorithm, label, keys, k, seed), algorithm, features, label, ["fold"]).persist()
    try:
        parts = []
        for i in range(k):
            model = fit_ready(rows.filter(F.col("fold") != i), algorithm, params)
            parts.append(with_scores(model.transform(rows), algorithm).select(
                F.col("label").alias("y"), "p", "pred", F.lit(i).alias("run"),
                F.when(F.col("fold") == i, "val").otherwise("train").alias("part")))
        judged = cut_lineage(reduce(DataFrame.unionByName, parts), "fold-scores")
    finally:
        rows.unpersist()
    scores = score_by_part(judged, ["run", "part"], problem_of(algorithm)).withColumnRenamed("run", "fold")
    found = df.sparkSession.createDataFrame(scores.collect(), scores.schema)  # 3 metrics x k folds x 2 parts
    return found, cv_summary(found)


CURVE_METRIC = {"binary": "roc_auc", "multiclass": "f1_weighted", "regression": "rmse"}


def learning_curve(df: DataFrame, algorithm: str, features: Sequence[str], label: str, keys, steps: int = 10, k: int = 5,
                   params: Mapping | None = None, seed: int = SEED) -> DataFrame:
    """Rows (step, fraction, n, train_mean, train_std, val_mean, val_std) over growing nested subsets.

    The metric is ROC-AUC, weighted F1 or RMSE, by the kind of problem.
    """
    fractions = [0.1 + 0.9 * i / (steps - 1) for i in range(steps)]
    # the subset hash has its own seed, so it is independent of the folds
    place = key_hash(keys, seed + 1)
    marked = dealt(df, algorithm, label, keys, k, seed).withColumn("_place", place)
    rows = ready(marked, algorithm, features, label, ["fold", "_place"]).persist()
    try:
        parts = []
        for s, fraction in enumerate(fractions):
            inside = F.col("_place") < F.lit(int(fraction * HASH_SPACE))
            for i in range(k):
                model = fit_ready(rows.filter((F.col("fold") != i) & inside), algorithm, params)
                scored = with_scores(model.transform(rows.filter((F.col("fold") == i) | inside)), algorithm)
                parts.append(scored.select(
                    F.col("label").alias("y"), "p", "pred", F.lit(s).alias("step"), F.lit(i).alias("run"),
                    F.when(F.col("fold") == i, "val").otherwise("train").alias("part")))
        judged = cut_lineage(reduce(DataFrame.unionByName, parts), "curve-scores")
        one = rows.agg(*[F.count(F.when(F.col("_place") < F.lit(int(f * HASH_SPACE)), 1)).alias(f"n{s}") for s, f in enumerate(fractions)]).first()
    finally:
        rows.unpersist()
    kind = problem_of(algorithm)
    scores = score_by_part(judged, ["step", "run", "part"], kind).filter(F.col("metric") == CURVE_METRIC[kind])
    table = scores.groupBy("step").agg(*[
        fn(F.when(F.col("part") == p, F.col("value"))).alias(f"{p}_{n}")
        for p in ("train", "val") for n, fn in (("mean", F.avg), ("std", F.stddev_pop))])
    found = df.sparkSession.createDataFrame(table.collect(), table.schema)  # one row per step
    about = df.sparkSession.createDataFrame([(s, f, one[s]) for s, f in enumerate(fractions)], "step int, fraction double, n long")
    return about.join(found, "step")


def score_stability(df: DataFrame, algorithm: str, features: Sequence[str], label: str, keys, runs: int = 10,
                    share: float = 0.8, params: Mapping | None = None) -> DataFrame:
    """Rows (seed, roc_auc): fits on hash subsamples, each judged on the rows it did not see."""
    marked = df.filter(col(label).isNotNull()).withColumns({f"_in{seed}": nested_subset(keys, share, seed) for seed in range(runs)})
    rows = ready(marked, algorithm, features, label, [f"_in{seed}" for seed in range(runs)]).persist()
    try:
        parts = []
        for seed in range(runs):
            model = fit_ready(rows.filter(F.col(f"_in{seed}")), algorithm, params)
            scored = with_scores(model.transform(rows.filter(~F.col(f"_in{seed}"))), algorithm)
            parts.append(scored.select(F.col("label").alias("y"), "p", F.lit(seed).alias("seed")))
        judged = cut_lineage(reduce(DataFrame.unionByName, parts), "stability-scores")
    finally:
        rows.unpersist()
    scores = roc_auc(judged, by=["seed"])
    return df.sparkSession.createDataFrame(scores.collect(), scores.schema)  # one row per seed


def importance_runs(df: DataFrame, features: Sequence[str], label: str, runs: int = 10, trees: int = 100, depth: int = 8) -> DataFrame:
    """Rows (run, feature, importance) of forests that differ only in their seed, on rows prepared once."""
    rows = ready(df, "random_forest", features, label).persist()
    try:
        cells, found = forest_cells(rows, "random_forest"), []
        for r in range(runs):
            model = fit_ready(rows, "random_forest", {"n_estimators": trees, "max_depth": depth, "seed": 1000 + r}, cells)
            found += [(r, f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(found, "run int, feature string, importance double")


def boosting_curve(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows (round, loss) of a boosted model on one table."""
    rows = assembler(features).transform(prepare(df, features, label))
    losses = model.stages[-1].evaluateEachIteration(rows) if hasattr(model.stages[-1], "evaluateEachIteration") else []
    return df.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(losses)], "round int, loss double")


# stacking -------------------------------------------------------------------

def oof_predictions(df: DataFrame, bases: Mapping[str, tuple[str, Mapping]], features: Sequence[str], label: str, keys,
                    k: int = 5, seed: int = SEED) -> DataFrame:
    """Every row with one out-of-fold score column per base model."""
    kind = next(iter(bases.values()))[0]
    marked = cut_lineage(dealt(df, kind, label, keys, k, seed), "dealt")
    names = [c for c in marked.columns]
    rows = ready(marked, kind, features, label, [*names]).persist()
    try:
        parts = []
        for i in range(k):
            held = rows.filter(F.col("fold") == i)
            for name, (algorithm, params) in bases.items():
                model = fit_ready(rows.filter(F.col("fold") != i), algorithm, params)
                scored = with_scores(model.transform(held), algorithm)
                score = "p" if problem_of(algorithm) == "binary" else "pred"
                held = scored.withColumnRenamed(score, name).drop("pred", "p", "prediction", "probability", "rawPrediction")
            parts.append(held.select(*names, *bases))
        return cut_lineage(reduce(DataFrame.unionByName, parts), "out-of-fold")
    finally:
        rows.unpersist()


@dataclass
class Stack:
    """Base models refitted on all rows with a meta-model over their scores."""

    models: dict[str, PipelineModel]
    meta: PipelineModel
    features: list[str]

    def weights(self) -> dict[str, float]:
        return coefficients(self.meta, list(self.models))

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for name, model in self.models.items():
            scored = predict(model, out, self.features)
            out = scored.withColumnRenamed("p" if "p" in scored.columns else "pred", name).drop("pred")
        return predict(self.meta, out, list(self.models))


def stack(df: DataFrame, bases: Mapping[str, tuple[str, Mapping]], features: Sequence[str], label: str, keys, k: int = 5,
          regression: bool = False, seed: int = SEED) -> Stack:
    """Fit the meta-model on out-of-fold scores, then refit the bases on everything."""
    held_out = oof_predictions(df, bases, features, label, keys, k, seed)
    meta = fit(held_out, "ridge" if regression else "logistic", list(bases), label)
    full = {name: fit(df, algorithm, features, label, params) for name, (algorithm, params) in bases.items()}
    return Stack(full, meta, list(features))
