"""The whole run from raw rows to a scoring bundle, for a 0/1 target.

Stages hand DataFrames to each other. Tables are written where many passes start:
distinct rows, prepared rows with their split, scores of all models, and the bundle. A blocker stops the run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accept, choose, clean, ensemble, features, metrics, models, quality, selection
from ..operators.aggregates import numeric_columns
from ..operators.drift import fit_snapshot
from ..operators.preprocess import Preprocessor
from ..operators.splits import split
from ..session import cut_lineage, scratch_path
from ..sources.sinks import Bundle, Recipe, save_bundle


class Blocked(RuntimeError):
    """A stage found the run not worth continuing."""


@dataclass
class Settings:
    target: str
    keys: Sequence[str]
    domain: str | None = None
    column_map: Mapping = field(default_factory=dict)
    date_columns: Sequence[str] = ()
    interactions: Sequence[tuple[str, str, str]] = ()
    orders: Mapping[str, Sequence[str]] = field(default_factory=dict)
    segments: Sequence[str] = ()
    params: Mapping[str, Mapping] = field(default_factory=dict)
    importance_trees: int = 100
    search_trials: int = 0
    seed: int = 42
    version: str = "v1"


@dataclass
class Result:
    integrity: DataFrame
    audit: DataFrame
    prepared: DataFrame
    selection: DataFrame
    algorithm: DataFrame
    leaderboard: DataFrame
    scores: DataFrame
    test_metrics: DataFrame
    sweep: DataFrame
    threshold: DataFrame
    verdicts: DataFrame
    final: DataFrame
    acceptance: DataFrame
    bundle: Bundle
    bundle_path: str


def run(raw: DataFrame, s: Settings) -> Result:
    spark = raw.sparkSession

    # ingest and integrity
    integrity = quality.integrity_report(raw)
    rows = cut_lineage(clean.deduplicate(raw.filter(F.col(s.target).isNotNull())), "distinct-rows")
    loss = quality.check_row_loss(raw, rows).first()
    if loss["blocked"]:
        raise Blocked(f"{loss['rows_after']} of {loss['rows_before']} rows left after cleaning")

    # features, split, then cleaning fitted on the training rows alone
    hours = features.varying_hours(rows, [d for d in s.date_columns if d in rows.columns])
    made = features.engineer(rows, s.domain, s.column_map, s.date_columns, s.interactions, hours)
    dates = [c for c, t in made.dtypes if t.startswith(("timestamp", "date"))]
    parted = cut_lineage(split(made.drop(*dates), list(s.keys), s.target, seed=s.seed, exact=True), "split")
    fixed = [*s.keys, "split"]
    cleaner = Preprocessor.fit(parted.filter("split = 'train'"), s.target, s.orders, fixed)
    kept = [F.col(c).alias(f"raw_{c}") for c in s.segments]
    prepared = cut_lineage(cleaner.apply(parted.select("*", *kept)), "prepared")
    segments = [f"raw_{c}" for c in s.segments]

    # feature selection and algorithm
    names = numeric_columns(prepared, [*fixed, s.target, *segments])
    train = prepared.filter("split = 'train'")
    importances = models.rf_importance(train, names, s.target, trees=s.importance_trees)
    chosen = selection.selection_report(train, names, importances)
    used = [r["feature"] for r in chosen.filter("kept").select("feature").collect()] or names
    used = [c for c in names if c in set(used)]
    facts = quality.data_profile(train.select(*used, s.target), s.target)
    algorithm = choose.select_algorithm(facts.withColumn("problem_type", F.lit("binary_classification")))
    primary = algorithm.first()["algorithm"]

    # training: dummy, linear, primary, tuned primary
    fitted: dict[str, PipelineModel] = {"Logistic": models.fit(train, "logistic", used, s.target, s.params.get("logistic"))}
    kinds = {"Logistic": "logistic"}
    if primary != "logistic":
        fitted["Primary"], kinds["Primary"] = models.fit(train, primary, used, s.target, s.params.get(primary)), primary
    if s.search_trials:
        fitted["Tuned"], _, _ = models.random_search(prepared, primary, used, s.target, trials=s.search_trials, seed=s.seed)
        kinds["Tuned"] = primary
    dummy = models.DummyModel.fit(train, s.target)
    attributes = [*s.keys, "split", *segments]
    label = F.col(s.target).cast("int").alias("y")
    parts = [dummy.transform(prepared).select(*attributes, label, F.lit("Dummy Majority").alias("model"), "p")]
    for name, model in fitted.items():
        parts.append(models.predict(model, prepared, used).select(*attributes, label, F.lit(name).alias("model"), "p"))
    scores = cut_lineage(reduce(DataFrame.unionByName, parts), "scores")
    board = choose.leaderboard(choose.evaluate_splits(scores))
    if quality.check_beats_dummy(board).first()["blocked"]:
        raise Blocked("no model scores above the dummy")

    # evaluation and validation
    test = scores.filter("split = 'test' and model <> 'Dummy Majority'")
    auc = metrics.roc_auc(scores.filter("model <> 'Dummy Majority'"), by=["model", "split"])
    wide = auc.groupBy("model").agg(*[F.max(F.when(F.col("split") == p, F.col("roc_auc"))).alias(p) for p in ("train", "val", "test")])
    verdicts = wide.withColumn("verdict", choose.overfit_verdict("train", "test"))
    if not verdicts.filter("verdict <> 'SUSPECTED DATA LEAKAGE'").limit(1).count():
        raise Blocked("every model scores better on unseen rows than on its own: look for leakage")

    # single models against their mean, judged on the test rows
    mean = test.groupBy(*attributes, "y").agg(F.avg("p").alias("p")).withColumn("model", F.lit("Soft Vote"))
    together = test.select("y", "p", "model").unionByName(mean.select("y", "p", "model")) if len(fitted) > 1 else test.select("y", "p", "model")
    contest = metrics.roc_auc(together, by=["model"]).select(
        "model", F.col("roc_auc").alias("score"), F.when(F.col("model") == "Soft Vote", "ensemble").otherwise("individual").alias("kind"))
    final = ensemble.choose_final(contest)
    winner = final.first()["model"]
    served = winner if winner in fitted else contest.filter("kind = 'individual'").orderBy(F.desc("score"), "model").first()["model"]
    own = test.filter(F.col("model") == served)
    decided = own.withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    test_metrics = metrics.binary_metrics(decided)
    sweep = metrics.threshold_sweep(own)
    threshold = metrics.pick_threshold(sweep)
    cut = threshold.first()["best_threshold"]

    # acceptance
    checks = [
        accept.range_check(own).select(F.lit("range").alias("check"), "verdict"),
        accept.prediction_audit(own, threshold=cut).select(F.lit("distribution").alias("check"), "verdict"),
    ]
    edges = models.predict(fitted[served], accept.edge_case_rows(train, used), used)
    checks.append(edges.select(F.concat(F.lit("edge case "), "case").alias("check"), accept.edge_verdict("p").alias("verdict")))
    if segments:
        fair = accept.subgroup_fairness(own, segments, threshold=cut)
        checks.append(fair.agg(F.count(F.when(F.col("verdict") == "FLAGGED", 1)).alias("n")).select(
            F.lit("subgroups").alias("check"), F.when(F.col("n") > 0, "WARN").otherwise("PASS").alias("verdict")))
    acceptance = reduce(DataFrame.unionByName, checks)
    if accept.uat_report(acceptance).first()["overall"] == "FAIL":
        raise Blocked("an acceptance check failed")

    # deployment
    bundle = Bundle(fitted[served], used, s.version, cut, 0.70, 0.40, fit_snapshot(train, used),
                    Recipe(s.domain, dict(s.column_map), list(s.date_columns), [list(i) for i in s.interactions], hours, dates), cleaner)
    path = scratch_path(spark, "bundle")
    save_bundle(bundle, path, spark)
    return Result(integrity, cleaner.audit_rows, prepared, chosen, algorithm, board, scores, test_metrics, sweep, threshold,
                  verdicts, final, acceptance, bundle, path)
