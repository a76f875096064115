"""Model fits as queries. Fitted numbers have no SQL twin, so most are checked by tests instead."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..operators import accept, attribution, boosting, choose, cluster, density, hierarchy, metrics, models, nearest, outliers, selection, semi, topics
from ..operators.splits import split
from ..session import cut_lineage, scratch_path
from ..sources import sinks
from .fixtures import table, with_tables
from .registry import query

DOC_FEATURES = ["n_chars", "n_spaces", "n_lines"]
LINE_FEATURES = ["l_quantity", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SMALL = {"n_estimators": 10, "max_depth": 4}
FEW_ROUNDS = 25  # of the 300 of the defaults, whose time the README gives


def docs(spark, sf):
    """Text features and labels, written once: every fit and score reads the small result."""
    return cut_lineage(split(table(spark, sf, "doc_ft"), "doc_id", "toxic"), "docs")


def vectors(spark, sf):
    df = table(spark, sf, "embeddings")
    return df.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


def scored_docs(spark, sf, algorithm, params=None):
    df = docs(spark, sf)
    model = models.fit(df.filter("split = 'train'"), algorithm, DOC_FEATURES, "toxic", params)
    return models.predict(model, df, DOC_FEATURES).select("doc_id", "toxic", "split", *(["p"] if algorithm != "linear_svc" else []), "pred")


@query("m4_logistic")
def m4(spark, sf):
    return scored_docs(spark, sf, "logistic")


@query("m5_multinomial")
def m5(spark, sf):
    df = vectors(spark, sf)
    names = [f"e{i}" for i in range(64)]
    model = models.fit(df, "multinomial", names, "label")
    return models.predict(model, df, names).select("vec_id", "label", "pred")


@query("m6_boosted_trees")
def m6(spark, sf):
    df = docs(spark, sf)
    model = boosting.fit_boosted(df.filter("split = 'train'"), DOC_FEATURES, "toxic", rounds=FEW_ROUNDS)
    return model.transform(df).select("doc_id", "toxic", "split", "p", "pred")


@query("m7_boosted_multiclass")
def m7(spark, sf):
    df = vectors(spark, sf)
    names = [f"e{i}" for i in range(64)]
    model = boosting.fit_boosted(df, names, "label", "multiclass", rounds=5, depth=5)
    return model.transform(df).select("vec_id", "label", "pred")


@query("m8_random_forest")
def m8(spark, sf):
    return scored_docs(spark, sf, "random_forest")


def regression(spark, sf, algorithm, params=None):
    df = table(spark, sf, "lineitem").select(*LINE_KEY, "l_extendedprice", *LINE_FEATURES)
    model = models.fit(df, algorithm, LINE_FEATURES, "l_extendedprice", params)
    scored = cut_lineage(models.predict(model, df, LINE_FEATURES).select("l_extendedprice", "pred"), "predictions")
    return metrics.regression_metrics(scored, "l_extendedprice", "pred")


@query("m9_random_forest_regressor")
def m9(spark, sf):
    return regression(spark, sf, "random_forest_regressor")


@query("m10_boosted_regressor")
def m10(spark, sf):
    df = table(spark, sf, "lineitem").select(*LINE_KEY, "l_extendedprice", *LINE_FEATURES)
    model = boosting.fit_boosted(df, LINE_FEATURES, "l_extendedprice", "regression", rounds=FEW_ROUNDS)
    scored = cut_lineage(model.transform(df).select("l_extendedprice", "pred"), "predictions")
    return metrics.regression_metrics(scored, "l_extendedprice", "pred")


@query("m11_huber")
def m11(spark, sf):
    return regression(spark, sf, "huber")


@query("m12_ridge_slope", with_tables("""
    select round(sxy / (sxx + 1000), 6) as slope, round(my - sxy / (sxx + 1000) * mx, 4) as intercept from (
      select covar_pop(l_extendedprice, l_quantity) * count(*) as sxy, var_pop(l_quantity) * count(*) as sxx, avg(l_extendedprice) as my, avg(l_quantity) as mx from lineitem)"""))
def m12(spark, sf):
    model = models.fit(table(spark, sf, "lineitem"), "ridge", ["l_quantity"], "l_extendedprice", {"alpha": 1000.0}).stages[-1]
    return spark.createDataFrame([(round(float(model.coefficients[0]), 6), round(float(model.intercept), 4))], "slope double, intercept double")


@query("m13_linear_svc")
def m13(spark, sf):
    return scored_docs(spark, sf, "linear_svc")


@query("m14_random_search")
def m14(spark, sf):
    _, _, trials = models.random_search(docs(spark, sf), "logistic", DOC_FEATURES, "toxic")
    return choose.best_so_far(trials)


@query("m15_refit_best")
def m15(spark, sf):
    df = docs(spark, sf)
    best, _, _ = models.random_search(df, "random_forest", DOC_FEATURES, "toxic")
    return models.predict(best, df, DOC_FEATURES).select("doc_id", "toxic", "split", "p", "pred")


@query("m18_learning_curve")
def m18(spark, sf):
    return models.learning_curve(docs(spark, sf), "logistic", DOC_FEATURES, "toxic", "doc_id")


@query("m20_boosting_curve")
def m20(spark, sf):
    df = docs(spark, sf)
    model = boosting.fit_boosted(df.filter("split = 'train'"), DOC_FEATURES, "toxic", rounds=FEW_ROUNDS)
    return model.loss_by_round(df.filter("split = 'val'"), "toxic")


@query("fs2_rf_importance")
def fs2(spark, sf):
    return models.rf_importance(docs(spark, sf), DOC_FEATURES, "toxic")


@query("fs2_importance_selection")
def fs2_selection(spark, sf):
    df = docs(spark, sf)
    return selection.selection_report(df, DOC_FEATURES, models.rf_importance(df, DOC_FEATURES, "toxic"))


@query("me17_tree_attribution")
def me17_trees(spark, sf):
    df = docs(spark, sf)
    model = models.fit(df.filter("split = 'train'"), "boosted_trees", DOC_FEATURES, "toxic", SMALL)
    return attribution.tree_attribution_global(model, df, DOC_FEATURES)


@query("v1_cross_validation")
def v1(spark, sf):
    scores, _ = models.cross_validate(docs(spark, sf), "logistic", DOC_FEATURES, "toxic", "doc_id")
    return scores


@query("v1_cross_validation_regression")
def v1_regression(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.month("o_orderdate").alias("month"))
    return models.cross_validate(df, "ridge", ["o_custkey", "month"], "o_totalprice", "o_orderkey", k=5)[0]


@query("m14_random_search_multiclass")
def m14_multiclass(spark, sf):
    df = split(vectors(spark, sf), "vec_id", "label", exact=True)
    _, _, trials = models.random_search(df, "multinomial", [f"e{i}" for i in range(64)], "label")
    return choose.best_so_far(trials)


@query("v3_score_stability")
def v3(spark, sf):
    scores = models.score_stability(docs(spark, sf), "logistic", DOC_FEATURES, "toxic", "doc_id")
    return choose.stability_summary(scores)


@query("v4_importance_stability")
def v4(spark, sf):
    runs = models.importance_runs(docs(spark, sf), DOC_FEATURES, "toxic", runs=10)
    return choose.feature_stability(runs)


BASES = {"linear": ("logistic", {}), "forest": ("random_forest", {})}


@query("en6_out_of_fold")
def en6(spark, sf):
    out = models.oof_predictions(docs(spark, sf), BASES, DOC_FEATURES, "toxic", "doc_id")
    return out.select("doc_id", "toxic", "fold", "linear", "forest")


@query("en7_stacking")
def en7(spark, sf):
    df = docs(spark, sf)
    stacked = models.stack(df.filter("split <> 'test'"), BASES, DOC_FEATURES, "toxic", "doc_id")
    return stacked.transform(df).select("doc_id", "toxic", "split", "linear", "forest", "p")


@query("u3_edge_cases")
def u3(spark, sf):
    df = docs(spark, sf)
    model = models.fit(df.filter("split = 'train'"), "logistic", DOC_FEATURES, "toxic")
    scored = models.predict(model, accept.edge_case_rows(df, DOC_FEATURES), DOC_FEATURES)
    return scored.select("case", "p", accept.edge_verdict("p").alias("verdict"))


@query("u9_reload_parity", with_tables("""
    select count(*) as rows, cast(0 as double) as max_difference, cast(0 as bigint) as unmatched, 'PASS' as verdict from {doc_ft}"""))
def u9(spark, sf):
    df = docs(spark, sf)
    model = models.fit(df.filter("split = 'train'"), "logistic", DOC_FEATURES, "toxic")
    path = scratch_path(spark, "model")
    sinks.save_model(model, path)
    again = PipelineModel.load(path)
    return accept.max_score_difference(
        models.predict(model, df, DOC_FEATURES), models.predict(again, df, DOC_FEATURES), ["doc_id"])


@query("k6_boosted_reload", with_tables("""
    select count(*) as rows, cast(0 as double) as max_difference, cast(0 as bigint) as unmatched, 'PASS' as verdict from {doc_ft}"""))
def k6_boosted(spark, sf):
    df = docs(spark, sf)
    model = boosting.fit_boosted(df.filter("split = 'train'"), DOC_FEATURES, "toxic", rounds=10, depth=4)
    path = scratch_path(spark, "boosted")
    model.save(spark, path)
    return accept.max_score_difference(model.transform(df), boosting.load_boosted(spark, path).transform(df), ["doc_id"])


def bundled(spark, sf, fit):
    """Customers scored by a bundle that was saved and loaded again; ``fit`` makes its model from cleaned rows and feature names."""
    from ..operators.drift import fit_snapshot
    from ..operators.preprocess import Preprocessor
    raw = cut_lineage(table(spark, sf, "cust_ft"), "customers")
    recipe = sinks.Recipe(dates=["last_order"], interactions=[["trans_amt", "trans_ct", "divide"]], hours={"last_order": False}, dropped=["last_order"])
    cleaner = Preprocessor.fit(recipe.apply(raw), "churned", keys=["c_custkey"])
    ready = cut_lineage(cleaner.apply(recipe.apply(raw)), "cleaned")
    names = [c for c, t in ready.dtypes if t in ("double", "int", "bigint") and c not in ("c_custkey", "churned")]
    path = scratch_path(spark, "bundle")
    sinks.save_bundle(sinks.Bundle(fit(ready, names), names, "v1", 0.5, 0.7, 0.4, fit_snapshot(ready, names), recipe, cleaner), path, spark)
    scored = sinks.score(raw, sinks.load_bundle(spark, path))
    return scored.select("c_custkey", "probability", "prediction", "risk_tier", F.col("top_reasons")[0]["feature"].alias("first_reason"), "model_version")


@query("d1_score_bundle")
def d1_bundle(spark, sf):
    return bundled(spark, sf, lambda df, names: models.fit(df, "logistic", names, "churned"))


@query("d1_score_boosted_bundle")
def d1_boosted_bundle(spark, sf):
    return bundled(spark, sf, lambda df, names: boosting.fit_boosted(df, names, "churned", rounds=FEW_ROUNDS))


# segments and few labels ----------------------------------------------------

EMBEDDING_FEATURES = [f"e{i}" for i in range(64)]


@query("x6_cluster_profile", """
    with e as (select label, unnest(range(1, 65)) as i, unnest(embedding) as v from embeddings),
    g as (select i, avg(v) as m from e group by i)
    select label as segment, 'e' || (i - 1) as feature, count(*) as n, round(avg(v), 6) as mean, round(any_value(m), 6) as global_mean, round(avg(v) - any_value(m), 6) as difference
    from e join g using (i) group by label, i""")
def x6(spark, sf):
    found = cluster.cluster_profile(vectors(spark, sf), "label", EMBEDDING_FEATURES)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "global_mean", "difference")})


@query("x1_elbow")
def x1(spark, sf):
    return cluster.elbow(table(spark, sf, "lineitem").select(*LINE_FEATURES), LINE_FEATURES)


@query("x4_principal_components", """
    with c as (select var_samp(l_quantity) as a, var_samp(l_extendedprice) as b, covar_samp(l_quantity, l_extendedprice) as d from lineitem),
    e as (select (a + b) / 2 as middle, sqrt((a - b) * (a - b) / 4 + d * d) as half from c)
    select 1 as component, round((middle + half) / (2 * middle), 9) as explained from e union all select 2, round((middle - half) / (2 * middle), 9) from e""")
def x4(spark, sf):
    found = cluster.principal_components(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return found.select("component", F.round("explained", 9).alias("explained"))


@query("x10_self_training")
def x10(spark, sf):
    df = docs(spark, sf)
    _, known = semi.self_train(df.filter("split = 'train'"), df.filter("split <> 'train'"), "logistic", DOC_FEATURES, "toxic", confidence=0.6)
    return known.groupBy("round", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("x11_co_training")
def x11(spark, sf):
    df = docs(spark, sf)
    models_, _ = semi.co_train(df.filter("split = 'train'"), df.filter("split <> 'train'"), "logistic", (["n_chars", "n_lines"], ["n_spaces"]), "toxic", ["doc_id"],
                               confidence=0.5, rounds=3)
    return models_.transform(df).select("doc_id", "toxic", "split", "p_first", "p_second", "p", "pred")


@query("x5_topic_words")
def x5_words(spark, sf):
    return topics.fit_topics(table(spark, sf, "documents"), "text").top_words()


@query("x5_topic_shares")
def x5_shares(spark, sf):
    df = table(spark, sf, "documents")
    return topics.fit_topics(df, "text").shares(df.select("doc_id", "text")).select("doc_id", F.posexplode("shares").alias("topic", "share"))


NEIGHBOURS, VOTES = 10, 5


def near_vectors(spark, sf):
    return nearest.nearest_rows(table(spark, sf, "embeddings"), "vec_id", "embedding", 64, NEIGHBOURS)


_NEAREST = nearest.nearest_sql("embeddings", "vec_id", "embedding", 64, NEIGHBOURS)


@query("x3_local_outlier_factor", f"""
    with {_NEAREST},
    kd as (select id, sqrt(max(d2)) as k_distance from nearest group by id),
    density as (select n.id, 1 / greatest(avg(greatest(k.k_distance, sqrt(n.d2))), 1e-9) as density from nearest n join kd k on k.id = n.other group by n.id)
    select n.id as vec_id, round(any_value(k.k_distance), 4) as k_distance, round(avg(o.density) / any_value(d.density), 6) as lof
    from nearest n join density d on d.id = n.id join density o on o.id = n.other join kd k on k.id = n.id group by n.id""")
def x3_lof(spark, sf):
    found = nearest.outlier_factors(near_vectors(spark, sf))
    return found.select(F.col("id").alias("vec_id"), F.round("k_distance", 4).alias("k_distance"), F.round("lof", 6).alias("lof"))


_PLACES = "select c_acctbal::double as x0, c_nationkey * 400e0 as x1 from customer"


@query("x2_density_clusters", f"""
    with recursive {density.density_sql(_PLACES, 150.0, 5)}
    select c_custkey, c.cluster from customer left join clustered c on c.x0 = c_acctbal::double and c.x1 = c_nationkey * 400e0""")
def x2(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("balance"), (F.col("c_nationkey") * 400.0).alias("nation"))
    return density.append_density_cluster(df, ["balance", "nation"], 150.0, 5).select("c_custkey", "cluster")


@query("x3_isolation_forest")
def x3_forest(spark, sf):
    names = [*LINE_FEATURES, "l_extendedprice"]
    df = table(spark, sf, "lineitem").select(*LINE_KEY, *names)
    return outliers.fit_isolation_forest(df, names, LINE_KEY).transform(df).select(*LINE_KEY, "outlier_score")


_SEEDS = "select vec_id as id, case when vec_id % 10 = 0 then label end as label from embeddings"


@query("x8_split_tree")
def x8_tree(spark, sf):
    """Nodes of the split tree over all vectors and dimensions, with sizes, costs, heights and the order of a cut."""
    return hierarchy.fit_split_tree(vectors(spark, sf), EMBEDDING_FEATURES).nodes(spark)


@query("x8_levels")
def x8_levels(spark, sf):
    """Every vector's node at each level, and its cluster in the cut at eight."""
    df = vectors(spark, sf)
    tree = hierarchy.fit_split_tree(df, EMBEDDING_FEATURES)
    return tree.cut(tree.transform(df), 8).select("vec_id", "path", "cluster")


@query("x9_label_propagation", f"""
    with {_NEAREST},
    {nearest.propagate_sql(_SEEDS, VOTES, NEIGHBOURS)}
    select id as vec_id, label, given, round from r{VOTES}""")
def x9(spark, sf):
    seeds = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.col("label")).alias("label"))
    return nearest.propagate(near_vectors(spark, sf), seeds, "vec_id", "label", NEIGHBOURS, VOTES)


@query("x7_segments")
def x7(spark, sf):
    df = table(spark, sf, "lineitem").select(*LINE_KEY, *LINE_FEATURES)
    return cluster.append_segment(df, cluster.fit_segments(df, LINE_FEATURES, 4), LINE_FEATURES)


@query("x12_most_uncertain", with_tables("""
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, p from {scored} order by abs(p - 0.5e0), l_orderkey, l_linenumber, l_partkey, l_suppkey limit 200"""))
def x12(spark, sf):
    return semi.most_uncertain(table(spark, sf, "scored"), "p", LINE_KEY, 200).select(*LINE_KEY, "p")


@query("x13_blending")
def x13(spark, sf):
    df = docs(spark, sf)
    return semi.blend(df, BASES, DOC_FEATURES, "toxic").transform(df).select("doc_id", "toxic", "split", "linear", "forest", "p")
