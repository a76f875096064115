"""Where results go: stage tables, leaderboards, snapshots, models, deployment bundles."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import col
from ..operators.boosting import Boosted, load_boosted
from ..operators.features import engineer
from ..operators.models import predict
from ..operators.preprocess import Preprocessor
from ..operators.scoring import fill_missing_features, score_table


def save_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a stage as parquet and return the table read back, which starts a short lineage."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def save_leaderboard(df: DataFrame, path: str) -> None:
    """One CSV file: a leaderboard has one row per model."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_drift_snapshot(snapshot: DataFrame, path: str) -> None:
    """One JSON record per feature."""
    snapshot.coalesce(1).write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


@dataclass(frozen=True)
class Recipe:
    """How features are made from raw rows: the arguments of `engineer`, and the columns that go afterwards."""

    domain: str | None = None
    column_map: Mapping = field(default_factory=dict)
    dates: Sequence[str] = ()
    interactions: Sequence[Sequence[str]] = ()
    hours: Mapping[str, bool] = field(default_factory=dict)
    dropped: Sequence[str] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        made = engineer(df, self.domain, self.column_map, self.dates, [tuple(i) for i in self.interactions], self.hours)
        return made.drop(*self.dropped)


@dataclass(frozen=True)
class Bundle:
    """All that scoring needs: model, features, version, decision threshold, tier limits, snapshot.

    With the recipe and the fitted cleaner it scores raw rows; without them, rows that are cleaned already. The model is
    a pipeline, or boosted trees for two classes.
    """

    model: PipelineModel | Boosted
    features: list[str]
    version: str
    threshold: float
    high: float
    medium: float
    snapshot: DataFrame
    recipe: Recipe | None = None
    cleaner: Preprocessor | None = None


def save_bundle(bundle: Bundle, path: str, spark: SparkSession) -> None:
    boosted = isinstance(bundle.model, Boosted)
    if boosted and bundle.model.kind != "binary":
        raise ValueError("a bundle scores by the probability of one of two classes")
    if boosted:
        bundle.model.save(spark, f"{path}/model")
    else:
        save_model(bundle.model, f"{path}/model")
    recipe = json.dumps(asdict(bundle.recipe)) if bundle.recipe else None
    row = (list(bundle.features), bundle.version, float(bundle.threshold), float(bundle.high), float(bundle.medium), recipe, bundle.cleaner is not None, boosted)
    schema = "features array<string>, version string, threshold double, high double, medium double, recipe string, cleaned boolean, boosted boolean"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    bundle.snapshot.coalesce(1).write.mode("overwrite").parquet(f"{path}/snapshot")
    if bundle.cleaner is not None:
        bundle.cleaner.save(spark, f"{path}/cleaner")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    about: Mapping = spark.read.parquet(f"{path}/about").first().asDict()
    return Bundle(
        model=load_boosted(spark, f"{path}/model") if about.get("boosted") else PipelineModel.load(f"{path}/model"), features=list(about["features"]), version=about["version"],
        threshold=about["threshold"], high=about["high"], medium=about["medium"],
        snapshot=spark.read.parquet(f"{path}/snapshot"), recipe=Recipe(**json.loads(about["recipe"])) if about["recipe"] else None,
        cleaner=Preprocessor.load(spark, f"{path}/cleaner") if about["cleaned"] else None)


def reason_weights(model: PipelineModel | Boosted, features: Sequence[str]) -> dict[str, float]:
    """Coefficients of a linear model, importances of a tree model."""
    if isinstance(model, Boosted):
        return {f: model.importances()[f] for f in features}
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return {f: float(w) for f, w in zip(features, values.toArray())}


def score(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Raw rows with probability, prediction, risk tier, reasons, model version and scoring time.

    Features are made and cleaned as in the run that fitted the bundle; the columns of ``df`` come back as they were.
    Reasons are the features with the largest weight times cleaned value.
    """
    rows = df.withColumn("_raw", F.struct(*[col(c) for c in df.columns]))
    rows = bundle.recipe.apply(rows) if bundle.recipe else rows
    rows = bundle.cleaner.apply(rows) if bundle.cleaner is not None else rows
    # filled again here, as the reasons need the values that the model saw
    rows = rows.select("_raw", *[col(f) for f in bundle.features if f in rows.columns])
    if isinstance(bundle.model, Boosted):
        scored = bundle.model.transform(fill_missing_features(rows, bundle.features))
    else:
        scored = predict(bundle.model, rows, bundle.features)
    made = score_table(scored, F.col("p"), reason_weights(bundle.model, bundle.features), bundle.threshold, bundle.version, bundle.high, bundle.medium)
    return made.select("_raw.*", "probability", "prediction", "risk_tier", "top_reasons", "model_version", "scored_at")
