"""Chosen behaviour where a rule could be read in more than one way."""

import pytest
from pyspark.sql import functions as F

from tabwright.functions import scalar as S
from tabwright.functions.text import classify_goal, classify_source, infer_domain
from tabwright.operators import accept, choose, clean, encode, ensemble, explore, features, history, metrics, quality, scoring
from tabwright.operators.preprocess import Preprocessor


def one(df):
    return df.first().asDict()


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_scheme_is_looked_at_before_the_extension(spark):
    uris = {
        "s3://bucket/x.parquet": "CLOUD", "postgresql://host/db": "DATABASE", "mysql://host/a.csv": "DATABASE", "/data/x.csv": "FILE",
        "x.parquet": "FILE", "https://api.example.org/v1/data.json": "API", "https://docs.google.com/spreadsheets/d/1": "CLOUD",
        " HTTP://HOST/p ": "API", "snowflake://acc/db": "CLOUD", "something": "FILE"}
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    assert by(df.select("u", classify_source("u").alias("k")), "u", "k") == uris


def test_goal_types(spark):
    goals = {
        "Predict churn": ("SUPERVISED", "Classification"), "Forecast revenue": ("SUPERVISED", "Regression"),
        "Segment users": ("UNSUPERVISED", "clustering/anomaly"), "Predict from few labels": ("SEMI-SUPERVISED", None),
        "Detect similar fraud": ("SUPERVISED", "Classification"), "Hello": ("AMBIGUOUS", None)}
    df = spark.createDataFrame([(g,) for g in goals], "g string")
    got = {r["g"]: (r["problem_type"], r["subtype"]) for r in df.select("g", classify_goal("g").alias("k")).select("g", "k.*").collect()}
    assert got == goals


def test_domain_first_match_wins(spark):
    df = spark.createDataFrame([("customer loan",), ("customer cart",), ("salary review",), ("bmi",), ("x",)], "g string")
    assert [r[0] for r in df.select(infer_domain("g")).collect()] == ["financial", "retail", "hr", "health", None]


@pytest.mark.parametrize("share,tier", [
    (0.0, None), (0.01, "IMPUTED (trace)"), (0.011, "IMPUTED"), (0.05, "IMPUTED"), (0.051, "IMPUTED + INDICATOR"), (0.2, "IMPUTED + INDICATOR"),
    (0.21, "FLAGGED + IMPUTED + INDICATOR"), (0.5, "FLAGGED + IMPUTED + INDICATOR"), (0.51, "DROPPED")])
def test_null_tier_limits_are_strict(share, tier):
    assert clean.NullPolicy.tier(share) == tier


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert one(quality.profile(df))["nulls"] == 2
    assert sorted(r[0] for r in clean.impute(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]


def test_integer_column_widens_only_for_a_fractional_fill(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (None, None)], "a int, b int")
    out = clean.impute(df, ["a", "b"])
    assert dict(out.dtypes) == {"a": "double", "b": "int"}
    assert sorted(r["a"] for r in out.collect()) == [1.0, 1.5, 2.0]


def test_text_kinds(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-01", "1.5", "7", "2024-01-01", None, "x"), ("0", "2024-02-30x", "2", "8", "2024-05-01", None, "y")],
        "flag string, start_date string, amount string, n string, created string, empty string, name string")
    assert clean.text_kinds(df) == {"flag": "boolean", "amount": "double", "n": "bigint", "created": "timestamp"}


def test_clipping_leaves_binary_target_and_flat_columns(spark):
    rows = [(float(i % 10), i % 2, 5.0, float(i % 10)) for i in range(99)] + [(1e6, 1, 5.0, 1e6)]
    df = spark.createDataFrame(rows, "x double, b int, flat double, y double")
    w = clean.Winsorizer.fit(df, exclude=["y"])
    assert set(w.bounds) == {"x"}
    assert w.counts(df)["x"] == (0, 1)
    assert one(w.apply(df).agg(F.max("x").alias("x"), F.max("y").alias("y")))["y"] == 1e6


def test_scaling_uses_population_std_and_survives_flat_columns(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "x double, flat double")
    out = encode.Standardizer.fit(df).apply(df)
    assert [(r["x"], r["flat"]) for r in out.orderBy("x").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_cleaning_is_fitted_on_training_rows_only(spark):
    rows = [(i, float(i), "a" if i % 2 else "b", "train") for i in range(100)] + [(1000, 1e9, "c", "test")]
    df = spark.createDataFrame(rows, "id int, x double, c string, split string")
    fitted = Preprocessor.fit(df.filter("split = 'train'"), keys=["id", "split"])
    mean, _ = fitted.scale.stats["x"]
    assert mean == pytest.approx(49.5)
    test = one(fitted.apply(df).filter("split = 'test'"))
    assert test["c"] == -1 and test["x"] < 10


def test_recency_direction(spark):
    rows = [(k, 10.0, f"2024-01-{d:02d}") for k, d in enumerate(range(1, 29))]
    df = spark.createDataFrame(rows, "k int, v double, d string").withColumn("d", F.to_timestamp("d"))
    standard = by(features.rfm(df, "k", "v", "d"), "k", "rfm_r")
    plain = by(features.rfm(df, "k", "v", "d", recency_inverted=False), "k", "rfm_r")
    assert standard[27] == 5 and standard[0] == 1 and plain[27] == 1 and plain[0] == 5


def test_quintiles_with_repeated_edges_do_not_fail(spark):
    df = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 5, "x double")
    scores = {r["x"]: r["s"] for r in df.withColumn("s", features.qcut(df, "x")).distinct().collect()}
    assert scores == {1.0: 1, 2.0: 2}


def test_problem_type_with_whole_numbers(spark):
    df = spark.createDataFrame([(i % 5, i % 2, float(i) / 7, i % 5) for i in range(100)], "grade int, churned int, price double, k int")
    got = {t: one(choose.problem_type(df, t))["problem_type"] for t in df.columns}
    assert got == {"grade": "ordinal_classification", "churned": "binary_classification", "price": "regression", "k": "multiclass_classification"}


def test_choice_rules_have_no_hole(spark):
    rows = [("binary_classification", n, m, s) for n in (9999, 10000, 100000, 100001) for m in (19.9, 20.0) for s in (10.0, 50.0)]
    rows += [("regression", n, None, s) for n in (49999, 50000) for s in (49.0, 50.0)]
    df = spark.createDataFrame(rows, "problem_type string, n_rows long, minority_pct double, sparsity_pct double")
    out = choose.select_algorithm(df)
    assert out.filter("algorithm is null").count() == 0
    pick = lambda n, m: one(out.filter((F.col("n_rows") == n) & (F.col("minority_pct") == m) & (F.col("sparsity_pct") == 10.0)))["label"]
    assert pick(10000, 19.9) == "Boosted Trees (imbalanced)" and pick(100001, 20.0) == "Boosted Trees"
    sparse = one(out.filter("problem_type = 'regression' and n_rows = 50000 and sparsity_pct = 50"))
    assert sparse["label"] == "Boosted Trees Regressor"


def test_simple_model_unless_gain_is_strictly_above_the_limit(spark):
    rows = lambda e: spark.createDataFrame([("a", "individual", 0.5), ("b", "individual", 0.75), ("e", "ensemble", e)], "model string, kind string, score double")
    assert one(ensemble.choose_final(rows(0.7500), 0.25))["model"] == "b"
    assert one(ensemble.choose_final(rows(1.0), 0.25))["model"] == "b"
    assert one(ensemble.choose_final(rows(1.0), 0.2499))["model"] == "e"


def test_both_recall_floor_thresholds_are_reported(spark):
    sweep = spark.createDataFrame(
        [(0.1, 0.2, 1.0, 0.33), (0.2, 0.4, 0.95, 0.56), (0.3, 0.6, 0.91, 0.72), (0.4, 0.8, 0.7, 0.75)],
        "threshold double, precision double, recall double, f1 double")
    got = one(metrics.pick_threshold(sweep))
    assert (got["first_recall_threshold"], got["highest_recall_threshold"], got["best_threshold"]) == (0.1, 0.3, 0.4)


def test_overfit_rules(spark):
    df = spark.createDataFrame([(0.9, 0.9, 0.92), (0.9, 0.88, 0.88), (0.9, 0.85, 0.84), (0.9, 0.7, 0.8), (0.9, 0.91, 0.9)], "tr double, va double, te double")
    rows = df.select(choose.overfit_verdict("tr", "te").alias("g"), choose.overfit_verdict("tr", "te", "va", "simple").alias("s")).collect()
    assert [r["g"] for r in rows] == ["SUSPECTED DATA LEAKAGE", "WELL-GENERALIZED", "SLIGHT OVERFIT (ACCEPTABLE)", "OVERFIT", "WELL-GENERALIZED"]
    assert [r["s"] for r in rows] == ["LEAKAGE", "HEALTHY", "HEALTHY", "OVERFIT", "SUSPICIOUS"]


def test_no_column_is_collinear_with_itself(spark):
    df = spark.createDataFrame([(float(i), float(i * 2), float((i * 7) % 5)) for i in range(30)], "a double, b double, c double")
    assert [(r["column_a"], r["column_b"]) for r in explore.collinear_pairs(df).collect()] == [("a", "b")]


def test_goal_words_are_plain_text(spark):
    runs = spark.createDataFrame([("1", "100% sure", 1), ("2", "a hundred", 2)], "id string, goal string, t int").withColumn("timestamp", F.timestamp_seconds("t"))
    assert [r["id"] for r in history.similar_runs(runs, "what 100%").collect()] == ["1"]
    assert [r["id"] for r in history.similar_runs(runs, "a an it").collect()] == ["2", "1"]


def test_calibration_edges_fall_into_the_lower_bin(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.1), (0, 0.100001), (1, 1.0)], "y int, p double")
    assert sorted(r["bin"] for r in metrics.calibration(df).collect()) == [0, 1, 9]
    assert by(metrics.calibration(df), "bin", "n")[0] == 2


def test_hard_vote_takes_the_smallest_class_on_ties(spark):
    df = spark.createDataFrame([(2, 1, 1), (2, 1, 0), (3, 3, 1)], "a int, b int, c int")
    assert [r[0] for r in df.select(ensemble.hard_vote(["a", "b", "c"])).collect()] == [1, 0, 3]


def test_subgroups_below_the_minimum_are_left_out(spark):
    rows = [(i % 2, 0.9 if i % 2 else 0.1, "big") for i in range(100)] + [(i % 2, 0.1 if i % 2 else 0.9, "bad") for i in range(40)] + [(1, 0.1, "tiny")] * 5
    got = {r["value"]: r["verdict"] for r in accept.subgroup_fairness(spark.createDataFrame(rows, "y int, p double, g string"), ["g"]).collect()}
    assert got == {"big": "OK", "bad": "FLAGGED"}


def test_verdict_rollup_is_worst_first_and_pass_at_best(spark):
    roll = lambda *v: one(accept.uat_report(spark.createDataFrame([(x,) for x in v], "verdict string")))["overall"]
    assert roll("PASS", "WARN", "SKIP") == "WARN" and roll("SKIP") == "PASS" and roll("MANUAL_REVIEW_REQUIRED", "PASS") == "MANUAL_REVIEW_REQUIRED"


def test_row_validation_reports_every_fault(spark):
    df = spark.createDataFrame([("1", 2.0), ("x", None), (None, float("nan"))], "a string, b double")
    rows = scoring.validate_rows(df, ["a", "b"]).collect()
    assert [(r["errors"], r["warnings"], r["valid"]) for r in rows] == [
        ([], [], True), (["non-numeric value: a"], ["null value: b"], False), ([], ["null value: a", "null value: b"], True)]


def test_zero_division_gives_null_or_zero(spark):
    row = one(spark.createDataFrame([(1.0, 0.0)], "a double, b double").select(
        S.safe_ratio("a", "b").alias("zero"), S.null_ratio("a", "b").alias("null"), S.utilisation("a", "b").alias("used")))
    assert row == {"zero": 0.0, "null": None, "used": None}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, x double")
    assert one(quality.check_nonempty(df))["passed"] is False
    assert quality.profile(df).count() == 2
    assert quality.integrity_report(df).filter("check = 'Overall'").first()["passed"] is False


def test_column_sets_of_repeated_null_and_no_names(spark):
    from tabwright.operators import joins
    df = spark.createDataFrame([(1, 2, 3)], "a int, B int, `x.y` int")
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), ("x.y",), (None,)], "feature string")
    got = {tuple(r) for r in joins.column_sets(df, wanted).collect()}
    assert got == {("a", "both"), ("B", "extra"), ("b", "missing"), ("x.y", "both")} and joins.column_sets(df, wanted).count() == 4
    assert {r["place"] for r in joins.column_sets(df, wanted.limit(0)).collect()} == {"extra"}
    assert {tuple(r) for r in joins.column_sets(df.select(), wanted.filter("feature = 'b'")).collect()} == {("b", "missing")}


def test_explained_sample_measures_against_all_rows(spark):
    from tabwright.operators import scoring
    df = spark.range(1000).select("id", (F.col("id") * 1.0).alias("v"), F.lit(2.0).alias("w"))
    got = scoring.explain_sample(df, {"v": 2.0, "w": 5.0}, ["id"], n=7)
    rows = got.collect()
    assert len(rows) == 7 and {r["id"] for r in rows} == {r["id"] for r in scoring.explain_sample(df.repartition(5), {"v": 2.0, "w": 5.0}, ["id"], n=7).collect()}
    assert all(r["reasons"][0]["feature"] == "v" and abs(r["reasons"][0]["contribution"] - 2.0 * (r["id"] - 499.5)) < 1e-9 for r in rows)
    assert scoring.explain_sample(df, {"v": 2.0}, ["id"], n=5000).count() == 1000
