import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwright.functions import scalar as S
from tabwright.operators import aggregates as agg
from tabwright.operators import metrics
from tabwright.operators.encode import label_encode, label_encode_all
from tabwright.operators.joins import left_enrich
from tabwright.operators.prefix import bucket_of, prefix_scan, row_numbers


def frame(spark, values, parts=5):
    return spark.createDataFrame([(float(v),) for v in values], "x double").repartition(parts)


@pytest.fixture(scope="module")
def hot_values():
    rng = np.random.RandomState(7)
    # a third of the rows share one value, another block shares a second one
    return np.concatenate([np.full(4000, 5.0), rng.normal(5, 3, 5000), np.full(3000, -1.0), rng.exponential(50, 500)])


def test_narrowed_quantiles_equal_numpy(spark, hot_values):
    probs = [0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.99, 1.0]
    found = agg.quantile_values(frame(spark, hot_values), ["x"], probs, exact_rows=50, accuracy=100)["x"]
    np.testing.assert_allclose(found, np.quantile(hot_values, probs), rtol=1e-9)


def test_many_quantiles_take_no_aggregate_each(spark, hot_values, monkeypatch):
    monkeypatch.setattr(agg, "_agg_slots", None)  # per row and quantile several conditions
    probs = [(i + 0.5) / 200 for i in range(200)]
    df = frame(spark, hot_values).withColumn("y", -F.col("x")).union(spark.createDataFrame([(None, float("nan"))], "x double, y double"))
    found = agg.quantile_values(df, ["x", "y"], probs, exact_rows=200, accuracy=5000)
    for name, values in (("x", hot_values), ("y", -hot_values)):
        np.testing.assert_allclose(found[name], np.quantile(values, probs), rtol=1e-9)


def test_narrowed_quantiles_by_group(spark, hot_values):
    rows = [(i % 3 if i % 3 else None, float(v)) for i, v in enumerate(hot_values)]
    df = spark.createDataFrame(rows, "g int, x double")
    found = agg.quantiles(df, ["x"], [0.1, 0.5], by=["g"], exact_rows=40, accuracy=100).collect()
    assert len(found) == 6
    for r in found:
        group = [v for g, v in rows if g == r["g"]]
        assert r["value"] == pytest.approx(np.quantile(group, r["prob"]), rel=1e-9)


def test_quantiles_skip_nan_and_null_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (None, None)], "x double, y double")
    found = agg.quantile_values(df, ["x", "y"], [0.5])
    assert found == {"x": [2.0], "y": [None]}


@pytest.mark.parametrize("groups", [1_000, 1_001])
def test_quantiles_of_many_groups_with_large_ones_among_them(spark, groups):
    rows = [(g, float(g + i)) for g in range(groups) for i in range(3)] + [(0, float(i)) for i in range(200)] + [(None, float(i)) for i in range(150)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(7)
    got = {r["g"]: r["value"] for r in agg.quantiles(df, ["x"], [0.5], by=["g"], exact_rows=100, accuracy=50).collect()}
    assert len(got) == groups + 1 and got[5] == 6.0 and got[groups - 1] == groups
    assert got[0] == np.median([x for g, x in rows if g == 0]) and got[None] == 74.5


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=60), st.integers(1, 20), st.booleans())
def test_prefix_scan_is_independent_of_ranges(spark, values, ranges, descending):
    df = frame(spark, values)
    found = prefix_scan(df, "x", {"n": F.lit(1)}, descending=descending, ranges=ranges)
    total = 0
    for r in sorted(found.collect(), key=lambda r: r["x"], reverse=descending):
        total += values.count(int(r["x"]))
        assert (r["n"], r["cum_n"]) == (values.count(int(r["x"])), total)


def test_prefix_max_by_group_over_many_ranges(spark):
    rng = np.random.RandomState(1)
    rows = [(int(g), i, float(v)) for i, (g, v) in enumerate(zip(rng.randint(0, 3, 900), rng.rand(900)))]
    df = spark.createDataFrame(rows, "g int, t int, v double")
    found = prefix_scan(df, "t", {"v": F.col("v")}, by=["g"], how="max", ranges=18)
    best = {(r["g"], r["t"]): r["cum_v"] for r in found.collect()}
    running: dict = {}
    for g, t, v in rows:
        running[g] = max(running.get(g, -1.0), v)
        assert best[(g, t)] == running[g]


def test_bucket_keeps_equal_values_together(spark):
    df = frame(spark, [0, 1, 1, 2, 3, 4, 4, 9])
    rows = df.select("x", bucket_of("x", [1.0, 4.0]).alias("b")).distinct().collect()
    assert {r["x"]: r["b"] for r in rows} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 2, 9: 2}


def test_modes_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("a", 1.0), ("b", 1.0), (None, float("nan"))], "s string, x double")
    assert agg.modes(df, ["s", "x"]) == {"s": "a", "x": 1.0}


def test_hot_key_join_keeps_every_row_once(spark):
    rows = [(0, i) for i in range(3000)] + [(i, i) for i in range(1, 1500)]
    df = spark.createDataFrame(rows, "k int, v int")
    per = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    salted = left_enrich(df, per, "k", count_col="n", hot_share=0.1, salts=16)
    plain = left_enrich(df, per, "k")
    assert salted.count() == len(rows)
    assert salted.exceptAll(plain.select(salted.columns)).isEmpty()


@pytest.mark.parametrize("count", [1_000, 1_001])
def test_label_codes_have_one_type_at_any_size(spark, count):
    names = [f"Customer#{i:05d}" for i in range(count)]
    df = spark.createDataFrame([(n,) for n in names * 2] + [(names[0],)] * 3000 + [(None,)], "name string").repartition(6)
    coded = label_encode_all(df.withColumn("code", F.col("name")), exclude=["name"])
    assert dict(coded.dtypes) == {"name": "string", "code": "bigint"} and coded.count() == 2 * count + 3001
    assert {r["name"]: r["code"] for r in coded.distinct().collect()} == {n: i for i, n in enumerate(names)} | {None: None}


def test_running_best_with_null_trials_and_dates(spark):
    from tabwright.operators.choose import best_so_far
    rows = [(None, 9.0), (3, 1.0), (1, 5.0), (2, 4.0)]
    for ranges in (1, 2, 50):
        got = sorted(((r["trial"] or 0, r["best"]) for r in best_so_far(spark.createDataFrame(rows, "trial int, value double"), ranges=ranges).collect()))
        assert got == [(0, 9.0), (1, 9.0), (2, 9.0), (3, 9.0)]  # a missing trial comes first
    dated = spark.createDataFrame(rows[1:], "trial int, value double").selectExpr("date_add(date'2024-01-01', trial) as trial", "value")
    assert [r["best"] for r in best_so_far(dated, ranges=3).orderBy("trial").collect()] == [5.0, 5.0, 5.0]


def test_enrich_a_table_of_one_column(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(2,)], "k int").repartition(4)
    out = left_enrich(df, df.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", count_col="n", salts=4)
    assert out.groupBy("k", "n").count().orderBy("k").collect() == [(1, 500, 500), (2, 1, 1)]


def test_row_numbers_with_a_hot_value(spark):
    rows = [(i, 7 if i % 3 else i) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(9)
    got = {r["id"]: r["rank"] for r in row_numbers(df, [F.desc("v"), F.asc("id")]).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == {i: n for n, (i, _) in enumerate(order, 1)}


def pairwise_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_auc_and_average_precision_against_brute_force(spark, ranges):
    rng = np.random.RandomState(3)
    y = rng.randint(0, 2, 600)
    p = np.round(rng.rand(600) * 0.7 + 0.3 * y * rng.rand(600), 2)
    p[:200] = 0.5
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double").repartition(7)
    got = metrics.ranking_metrics(df, ranges=ranges).first()
    assert got["roc_auc"] == pytest.approx(pairwise_auc(y, p), abs=1e-12)
    ap, recall = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        called = p >= t
        r = y[called].sum() / y.sum()
        ap += (r - recall) * y[called].mean()
        recall = r
    assert got["average_precision"] == pytest.approx(ap, abs=1e-12)


def test_auc_without_both_classes_is_null(spark):
    df = spark.createDataFrame([(1, 0.4), (1, 0.6)], "y int, p double")
    assert metrics.roc_auc(df).first()["roc_auc"] is None


def test_right_closed_bins(spark):
    df = frame(spark, [-1, 0, 0.5, 6, 6.1, 60, 61]).withColumn("b", S.cut("x", S.TENURE_EDGES, S.TENURE_LABELS))
    got = {r["x"]: r["b"] for r in df.collect()}
    assert got == {-1: None, 0: None, 0.5: "0-6m", 6: "0-6m", 6.1: "6-12m", 60: "2-5yr", 61: "5yr+"}


def test_row_cv_skips_missing_values(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, None, 3.0), (5.0, None, None), (1.0, -1.0, 0.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(S.row_cv(["a", "b", "c"])).collect()]
    assert got[0] == pytest.approx(0.5) and got[1] == pytest.approx(math.sqrt(2) / 2)
    assert got[2] is None and got[3] is None


def test_portable_hash_is_the_documented_integer(spark):
    got = spark.range(5).select(S.portable_hash("id").alias("h")).collect()
    assert [r["h"] for r in got] == [((i + 42) * 2654435761) % 4294967296 for i in range(5)]
    far = spark.range(1).select(S.portable_hash(F.lit(600_000_000_000)).alias("h")).first()["h"]
    assert far == ((600_000_000_000 % 2**31 + 42) * 2654435761) % 4294967296


def test_nan_is_missing(spark):
    nan = F.lit(float("nan"))
    assert spark.range(1).select(S.clip(nan, 0.0, 1.0), S.risk_tier(nan), S.decide(nan)).first() == (None, "LOW", 0)


def test_sums_of_small_and_large_values(spark):
    from tabwright.operators.features import rfm_base
    df = spark.createDataFrame([(1, 0.001, "2024-01-01"), (1, 0.004, "2024-01-02"), (2, 1e17, "2024-01-03")], "k int, v double, d string")
    assert {r["k"]: r["total_revenue"] for r in rfm_base(df, "k", "v", "d").collect()} == {1: pytest.approx(0.005), 2: 1e17}


def test_a_missing_class_is_a_class(spark):
    from tabwright.operators import explore
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (3.0, None), (4.0, "a")], "x double, c string")
    assert explore.histogram(df, "x", bins=2, by="c").agg(F.sum("n")).first()[0] == 4
    assert {r["c"]: r["n"] for r in explore.violin_stats(df, ["x"], "c").collect()} == {"a": 2, None: 2}
    assert explore.kde(df, "x", grid=5, by="c").filter("c is null and density > 0").count() == 5
    assert explore.kde(df.limit(0), "x").count() == 0


def test_text_numbers_are_exact_and_plain(spark):
    from tabwright.operators.clean import recast, text_kinds
    df = spark.createDataFrame([("9007199254740993", "12d", "1e3", "1.5"), (" 9007199254740995", "45f", "2.0", ".5"), (None, None, None, None)], "a string, b string, c string, d string")
    assert text_kinds(df) == {"a": "bigint", "c": "bigint", "d": "double"}
    assert [tuple(r) for r in recast(df, text_kinds(df)).collect()] == [(9007199254740993, "12d", 1000, 1.5), (9007199254740995, "45f", 2, 0.5), (None,) * 4]


def test_json_path_asks_the_type(spark):
    from tabwright.sources.files import json_path_rows
    df = spark.createDataFrame([(1, '{"a": "[not a list"}'), (2, '{"a": [1, "x"]}'), (3, '{"a": {"b": 1}}'), (4, '{"b": 1}'), (5, "no json")], "id int, j string")
    got = sorted((r["id"], r["record"]) for r in json_path_rows(df, "j", "a").collect())
    assert got == [(1, "[not a list"), (2, "1"), (2, "x"), (3, '{"b":1}')]


def test_many_correlations_take_one_scan(spark):
    rng = np.random.RandomState(4)
    x = rng.normal(size=(200, 20))
    x[:, 5] = x[:, 4] + 0.1 * x[:, 6]
    names = [f"c{i}" for i in range(20)]
    rows = [[None if (i + j) % 17 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    found = agg.correlations(df, agg.pairs(names))
    got = {(r["column_a"], r["column_b"]): r["r"] for r in found.collect()}
    assert set(got) == set(agg.pairs(names))
    few = {(r["column_a"], r["column_b"]): r["r"] for r in agg.correlations(df, [("c4", "c5"), ("c0", "c19")]).collect()}
    for (a, b), r in got.items():
        both = [(u, v) for u, v in ((row[int(a[1:])], row[int(b[1:])]) for row in rows) if u is not None and v is not None]
        assert r == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-9)
        assert (a, b) not in few or few[(a, b)] == pytest.approx(r, abs=1e-12)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1


@pytest.mark.parametrize("name", ["c", "r", "all", "x", "_k0", "_x0", "_n0", "_h0", "_t0", "_q0", "_c", "_r", "_w", "_n", "n", "cum__n", "_lo", "_at", "_column", "_kept", "_record"])
def test_group_columns_of_any_name(spark, name):
    df = spark.createDataFrame([("a", float(i)) for i in range(9)] + [("b", float(i)) for i in range(3)] + [(None, 7.0)], ["g", "y"]).withColumnRenamed("g", name)
    for limit in (100, 4):  # all by the built-in, and the largest group by ranks
        got = {r[name]: r["value"] for r in agg.quantiles(df, ["y"], [0.5], by=[name], exact_rows=limit).collect()}
        assert got == {"a": 4.0, "b": 1.0, None: 7.0}
    one = df.groupBy(name).agg(F.count("*").alias("size"))
    assert {r[name]: r["rows_of_it"] for r in agg.to_rows(one, [{"rows_of_it": F.col("size")}], keep=[name]).collect()} == {"a": 9, "b": 3, None: 1}


def test_quantiles_of_many_large_groups(spark):
    df = spark.range(1_001 * 12).select((F.col("id") % 1_001).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("v"), F.lit(None).cast("double").alias("w"))
    got = {(r["g"], r["column"], r["prob"]): r["value"] for r in agg.quantiles(df, ["v", "w"], [0.0, 0.3, 0.5, 1.0], by=["g"], exact_rows=10).collect()}
    want = {(r["g"], "v", p): v for r in df.groupBy("g").agg(F.percentile("v", [0.0, 0.3, 0.5, 1.0]).alias("q")).collect() for p, v in zip([0.0, 0.3, 0.5, 1.0], r["q"])}
    assert len(got) == 1_001 * 8 and all(got[g, "w", p] is None for g, _, p in want)
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())
