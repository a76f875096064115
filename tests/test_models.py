import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.operators import attribution, boosting, choose, metrics, models
from tabwright.operators.drift import fit_snapshot
from tabwright.operators.splits import folds, split
from tabwright.plans import workflow
from tabwright.sources import sinks

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    """Label driven by a and b; c is noise. Few positives."""
    rng = np.random.RandomState(0)
    a, b, c = rng.normal(size=(3, 900))
    y = (rng.rand(900) < 1 / (1 + np.exp(-(2.5 * a - 2 * b - 2)))).astype(int)
    rows = [(i, float(x), float(z), float(w), int(t), "x" if i % 2 else "y") for i, (x, z, w, t) in enumerate(zip(a, b, c, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int, seg string")
    return split(df, "id", "y").repartition(4).persist()


def auc(scored):
    return metrics.roc_auc(scored).first()["roc_auc"]


@pytest.mark.parametrize("algorithm,params", [
    ("logistic", {}), ("random_forest", {"n_estimators": 20, "max_depth": 4}), ("boosted_trees", {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.2})])
def test_classifiers_find_the_planted_signal(planted, algorithm, params):
    model = models.fit(planted.filter("split = 'train'"), algorithm, FEATURES, "y", params)
    assert auc(models.predict(model, planted.filter("split <> 'train'"), FEATURES)) > 0.85


def test_balanced_logistic_matches_a_direct_solution(planted):
    rows = planted.collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    y = np.array([r["y"] for r in rows])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    design = np.column_stack([x, np.ones(len(y))])
    beta = np.zeros(4)
    penalty = np.diag([1.0, 1.0, 1.0, 0.0])  # C = 1, free intercept
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-design @ beta))
        grad = design.T @ (w * (p - y)) + penalty @ beta
        hess = design.T @ (design * (w * p * (1 - p))[:, None]) + penalty
        beta -= np.linalg.solve(hess, grad)
    got = models.coefficients(models.fit(planted, "logistic", FEATURES, "y"), FEATURES)
    np.testing.assert_allclose([got[f] for f in FEATURES], beta[:3], rtol=1e-3)


def test_importance_ranks_noise_last(planted):
    got = {r["feature"]: r["importance"] for r in models.rf_importance(planted, FEATURES, "y", trees=20, depth=5).collect()}
    assert min(got, key=got.get) == "c" and sum(got.values()) == pytest.approx(1.0)


@pytest.mark.parametrize("algorithm", ["boosted_trees", "random_forest"])
def test_tree_contributions_add_up_to_the_raw_score(planted, algorithm, monkeypatch):
    model = models.fit(planted, algorithm, FEATURES, "y", {"n_estimators": 6, "max_depth": 4})
    monkeypatch.setattr(attribution.node_arrays, "__defaults__", (40,))  # a few trees at a time
    parts = attribution.tree_attribution(model, planted, FEATURES, ["id"])
    total = parts.select("id", (F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda s, v: s + v)).alias("total"))
    raw = vector_to_array("rawPrediction")[1] if algorithm == "boosted_trees" else vector_to_array("probability")[1]
    both = model.transform(planted).select("id", raw.alias("raw")).join(total, "id")
    assert both.agg(F.max(F.abs(F.col("raw") - F.col("total")))).first()[0] < 1e-9


def test_folds_cover_every_row_once_and_ignore_partitioning(planted):
    one = folds(planted, "id", 5).select("id", "fold")
    other = folds(planted.repartition(13), "id", 5).select("id", "fold")
    assert one.exceptAll(other).isEmpty() and one.count() == 900
    assert one.select("fold").distinct().count() == 5


def test_exact_split_keeps_class_shares(planted):
    parts = split(planted.drop("split"), "id", "y", exact=True)
    rates = {(r["split"], r["y"]): r["n"] for r in parts.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    for label in (0, 1):
        total = sum(n for (_, y), n in rates.items() if y == label)
        assert abs(rates[("train", label)] - 0.7 * total) <= 1


def test_out_of_fold_scores_and_stack(planted):
    bases = {"linear": ("logistic", {}), "forest": ("random_forest", {"n_estimators": 5, "max_depth": 3})}
    held = models.oof_predictions(planted, bases, FEATURES, "y", "id", k=3)
    assert held.count() == 900 and held.filter("linear is null or forest is null").count() == 0
    stacked = models.stack(planted.filter("split = 'train'"), bases, FEATURES, "y", "id", k=3)
    assert auc(stacked.transform(planted.filter("split = 'test'"))) > 0.85
    assert set(stacked.weights()) == {"linear", "forest"}


def test_cross_validation_tables(planted):
    scores, summary = models.cross_validate(planted, "logistic", FEATURES, "y", "id", k=3)
    assert scores.count() == 3 * 2 * 3
    assert {(r["metric"], r["part"]) for r in summary.collect()} == {(m, p) for m in ("roc_auc", "accuracy", "f1_weighted") for p in ("train", "val")}


def test_learning_curve_grows(planted):
    curve = models.learning_curve(planted, "logistic", FEATURES, "y", "id", steps=3, k=2, params={"max_iter": 30})
    rows = sorted(curve.collect(), key=lambda r: r["step"])
    assert [r["step"] for r in rows] == [0, 1, 2] and rows[0]["n"] < rows[1]["n"] < rows[2]["n"] == 900
    assert choose.learning_diagnosis(curve).count() == 1


def test_search_is_repeatable(planted):
    space = {"C": models.Range(0.01, 10, log=True)}
    first = models.random_search(planted, "logistic", FEATURES, "y", trials=3, space=space)
    again = models.random_search(planted, "logistic", FEATURES, "y", trials=3, space=space)
    assert first[1] == again[1] and first[2].count() == 3


def test_regressors(spark):
    rng = np.random.RandomState(2)
    x = rng.rand(400)
    rows = [(float(v), float(3 * v + 1 + e)) for v, e in zip(x, rng.normal(0, 0.05, 400))]
    df = spark.createDataFrame(rows, "x double, y double")
    for algorithm, params in (("ridge", {"alpha": 0.01}), ("huber", {}), ("random_forest_regressor", {"n_estimators": 10, "max_depth": 5}), ("boosted_regressor", {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.3})):
        scored = models.predict(models.fit(df, algorithm, ["x"], "y", params), df, ["x"])
        assert metrics.regression_metrics(scored).first()["r2"] > 0.9, algorithm


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.RandomState(5)
    x = rng.normal(size=(300, 2)) * [1.0, 20.0]
    y = 500 + x @ [30.0, -2.0] + rng.normal(0, 40, 300)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double")
    centred = x - x.mean(axis=0)
    expected = np.linalg.solve(centred.T @ centred + 50 * np.eye(2), centred.T @ (y - y.mean()))
    got = models.coefficients(models.fit(df, "ridge", ["a", "b"], "y", {"alpha": 50.0}), ["a", "b"])
    np.testing.assert_allclose([got["a"], got["b"]], expected, rtol=1e-6)


def test_whole_run(spark, planted):
    settings = workflow.Settings(target="y", keys=["id"], segments=["seg"], importance_trees=10, params={"logistic": {"max_iter": 50}})
    result = workflow.run(planted.drop("split"), settings)
    assert result.leaderboard.filter("rank = 1").first()["model"] == "Logistic"
    assert result.test_metrics.first()["f1"] > 0.5
    assert result.acceptance.filter("verdict = 'FAIL'").count() == 0
    again = sinks.load_bundle(spark, result.bundle_path)
    assert again.features == result.bundle.features and again.threshold == result.bundle.threshold
    assert again.snapshot.count() == len(again.features)
    raw = planted.drop("split")
    scored = sinks.score(raw, again)
    assert scored.columns == [*raw.columns, "probability", "prediction", "risk_tier", "top_reasons", "model_version", "scored_at"]
    own = result.scores.filter("model = 'Logistic'").select("id", F.round("p", 4).alias("p"))
    assert scored.join(own, "id").filter("abs(probability - p) > 1e-9").count() == 0 and scored.count() == own.count()
    assert scored.filter("size(top_reasons) = 0 or model_version <> 'v1'").count() == 0


def test_a_bundle_makes_and_cleans_its_features(spark, tmp_path):
    from tabwright.operators.preprocess import Preprocessor
    rng = np.random.RandomState(9)
    rows = [(i, float(v) if i % 9 else None, f"c{i % 40}", "yes" if i % 3 else "no", f"2024-0{1 + i % 9}-01", int(v > 0)) for i, v in enumerate(rng.normal(size=400))]
    raw = spark.createDataFrame(rows, "id long, x double, city string, flag string, day string, y int").withColumn("day", F.to_date("day"))
    recipe = sinks.Recipe(dates=["day"], interactions=[["x", "id", "multiply"]], hours={"day": False}, dropped=["day"])
    cleaner = Preprocessor.fit(recipe.apply(raw), "y", keys=["id"])
    ready = cleaner.apply(recipe.apply(raw))
    names = [c for c, t in ready.dtypes if t in ("double", "int", "bigint") and c not in ("id", "y")]
    for kind, params in (("logistic", {}), ("random_forest", {"n_estimators": 5, "max_depth": 3})):
        model = models.fit(ready, kind, names, "y", params)
        path = str(tmp_path / kind)
        sinks.save_bundle(sinks.Bundle(model, names, "v2", 0.5, 0.7, 0.4, fit_snapshot(ready, names), recipe, cleaner), path, spark)
        got = sinks.score(raw, sinks.load_bundle(spark, path)).select("id", "probability", "top_reasons")
        own = models.predict(model, ready, names).select("id", F.round("p", 4).alias("p"))
        assert got.join(own, "id").filter("probability = p and size(top_reasons) = 3").count() == 400
    model = boosting.fit_boosted(ready, names, "y", rounds=3, depth=3)
    path = str(tmp_path / "boosted")
    sinks.save_bundle(sinks.Bundle(model, names, "v2", 0.5, 0.7, 0.4, fit_snapshot(ready, names), recipe, cleaner), path, spark)
    got = sinks.score(raw, sinks.load_bundle(spark, path)).select("id", "probability", "top_reasons")
    own = model.transform(ready).select("id", F.round("p", 4).alias("p"))
    assert got.join(own, "id").filter("probability = p and size(top_reasons) = 3").count() == 400
    with pytest.raises(ValueError):
        values = boosting.fit_boosted(ready, names[1:], names[0], "regression", rounds=1, depth=1)
        sinks.save_bundle(sinks.Bundle(values, names[1:], "v2", 0.5, 0.7, 0.4, fit_snapshot(ready, names)), path, spark)


def test_run_stops_when_cleaning_eats_the_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 1)] * 50 + [(2, 2.0, 0)], "id int, x double, y int")
    with pytest.raises(workflow.Blocked):
        workflow.run(df, workflow.Settings(target="y", keys=["id"]))


def test_folds_deal_out_each_class(planted):
    for k in (5, 10):
        dealt = folds(planted, "id", k, label="y").groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()
        for label in (0, 1):
            sizes = [r["n"] for r in dealt if r["y"] == label]
            assert len(sizes) == k and max(sizes) - min(sizes) <= 1


def test_exact_split_with_many_classes(spark):
    df = spark.range(6_000).selectExpr("id", "id % 1500 as c")
    parts = split(df, "id", "c", exact=True).groupBy("c", "split").count()
    assert {(r["split"], r["count"]) for r in parts.collect()} == {("train", 3), ("val", 1)}  # 4 rows a class


def test_every_kind_of_problem_is_validated_and_searched(spark, planted):
    three = planted.withColumn("k", (F.col("a") > 0.5).cast("int") + (F.col("a") > -0.5).cast("int"))
    scores, _ = models.cross_validate(three, "multinomial", FEATURES, "k", "id", k=3, params={"max_iter": 50})
    rows = {(r["metric"], r["part"]): r["value"] for r in scores.collect()}
    assert {m for m, _ in rows} == {"accuracy", "f1_weighted", "f1_macro"} and rows[("accuracy", "val")] > 0.8
    scores, _ = models.cross_validate(planted, "ridge", ["b", "c"], "a", "id", k=3)
    assert {r["metric"] for r in scores.collect()} == {"rmse", "mae", "r2"}
    _, best, trials = models.random_search(three, "multinomial", FEATURES, "k", trials=2)
    assert set(best) == {"C"} and trials.filter("value > 0.5").count() >= 1
    _, _, trials = models.random_search(planted, "ridge", ["b", "c"], "a", trials=2)
    assert trials.filter("value < 0").count() == 2
    assert models.learning_curve(planted, "ridge", ["b", "c"], "a", "id", steps=2, k=2).filter("val_mean > 0").count() == 2
    assert all(a in models.SEARCH_SPACES for a in models.CLASSIFIERS | {"ridge", "huber", "random_forest_regressor", "boosted_regressor"})


def test_segments_and_their_profile(spark):
    from tabwright.operators import cluster
    rng = np.random.RandomState(3)
    rows = [(i, float(c * 10 + e), None if i % 50 == 0 else float(-c * 10 + e)) for i, (c, e) in enumerate(zip(rng.randint(0, 3, 300), rng.normal(0, 0.3, 300)))]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    costs = {r["k"]: (r["cost"], r["silhouette"]) for r in cluster.elbow(df.dropna(), ["a", "b"], [2, 3, 4]).collect()}
    assert costs[2][0] > costs[3][0] and max(costs, key=lambda k: costs[k][1]) == 3
    out = cluster.append_segment(df, cluster.fit_segments(df, ["a", "b"], 3), ["a", "b"])
    assert out.columns == ["id", "a", "b", "segment"] and out.filter("b is null").count() == 6
    profile = cluster.cluster_profile(out, "segment", ["a"]).collect()
    assert sum(r["n"] for r in profile) == 300
    assert sum(r["n"] * r["difference"] for r in profile) == pytest.approx(0, abs=1e-6)
    parts = cluster.principal_components(df.dropna(), ["a", "b"]).collect()
    assert parts[0]["explained"] > 0.9 and len(parts[0]["loadings"]) == 2


def test_few_labels(planted):
    from tabwright.operators import semi
    few, rest = planted.filter("id < 150"), planted.filter("id >= 150")
    model, known = semi.self_train(few, rest, "logistic", FEATURES, "y", confidence=0.9, rounds=2)
    assert known.filter("round > 0").count() > 0 and known.filter("round = 0").count() == few.count()
    assert auc(models.predict(model, rest, FEATURES)) > 0.85
    blended = semi.blend(planted, {"linear": ("logistic", {}), "forest": ("random_forest", {"n_estimators": 5, "max_depth": 3})}, FEATURES, "y")
    assert auc(blended.transform(planted.filter("split = 'test'"))) > 0.85
    nearest = semi.most_uncertain(models.predict(model, rest, FEATURES), "p", ["id"], 10).collect()
    assert len(nearest) == 10 and max(abs(r["p"] - 0.5) for r in nearest) < 0.2


def test_bundle_and_forest_regressor_fit_at_the_defaults(spark, sf, monkeypatch):
    from tabwright.plans.registry import REGISTRY
    import tabwright.plans.model_queries  # noqa: F401

    class Seen(Exception):
        pass

    def seen(df, algorithm, features, label, params=None, *more, **options):
        raise Seen(algorithm, params)

    monkeypatch.setattr(models, "fit", seen)
    for name, algorithm in (("d1_score_bundle", "logistic"), ("m9_random_forest_regressor", "random_forest_regressor")):
        with pytest.raises(Seen) as found:
            REGISTRY[name].run(spark, sf)
        assert found.value.args == (algorithm, None)


def test_refit_best_makes_all_trials(spark, monkeypatch):
    from tabwright.plans import model_queries
    rows = [(i, i % 7, i % 5, i % 3, i % 2, ("train", "val", "test")[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, n_chars long, n_spaces long, n_lines long, toxic int, split string")
    drawn, model = [], models.fit(df, "logistic", model_queries.DOC_FEATURES, "toxic").stages[-1]
    monkeypatch.setattr(model_queries, "docs", lambda *a: df)
    monkeypatch.setattr(models, "forest_cells", lambda *a: None)
    monkeypatch.setattr(models, "judge", lambda *a: 0.5)
    monkeypatch.setattr(models, "fit_ready", lambda rows, algorithm, params, cells: drawn.append(params) or model)
    assert model_queries.m15(spark, None).count() == 60
    assert len(drawn) == models.TRIALS["random_forest"] and all(set(p) == set(models.SEARCH_SPACES["random_forest"]) for p in drawn)
