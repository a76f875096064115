"""Plans that must hold their shape at any size."""

from pyspark.sql import functions as F

from tabwright.operators import aggregates as agg
from tabwright.operators import encode, metrics, quality
from tabwright.plans.fixtures import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(table(spark, sf, "doc_ft").filter("toxic = 1").select("n_chars"))
    assert "EqualTo(toxic,1)" in text
    scan = plan(agg.describe_numeric(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_tax"]))
    assert "l_tax" in scan and "l_extendedprice" not in scan


def test_fitted_steps_are_plain_projections(spark, sf):
    df = table(spark, sf, "line_num")
    text = plan(encode.Standardizer.fit(df, ["qty", "price"]).apply(df))
    assert "Exchange" not in text and "Join" not in text and "WholeStageCodegen" in text or "*(1)" in text


def test_profile_is_one_aggregate(spark, sf):
    assert plan(quality.profile(table(spark, sf, "null_orders"))).count("FileScan") == 1


def test_ranked_metrics_read_the_table_once(spark, sf):
    # the table is read to write one row per distinct score; the plan reads those rows, for the totals and for the scan
    text = plan(metrics.ranking_metrics(table(spark, sf, "scored")))
    assert "lineitem" not in text and text.count("FileScan") == 2


def test_texts_are_lowered_once(spark, sf):
    from tabwright.functions.text import classify_goal, infer_domain
    for rule in (classify_goal, infer_domain):
        text = table(spark, sf, "documents").select("doc_id", rule("text").alias("r"))._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("lower(text") == 1


def test_findings_read_the_table_for_classes_only(spark, sf):
    # correlations and column shapes are written first, in one read each
    from tabwright.operators import explore
    found = explore.key_findings(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_quantity", "l_tax", "l_discount"], "l_linenumber")
    assert plan(found).count("lineitem.parquet") <= 2


def test_grouped_counts_combine_before_the_shuffle(spark, sf):
    text = plan(agg.value_counts(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_returnflag"))
    assert "partial_count" in text


def test_scores_are_not_collected(spark, sf):
    sweep = metrics.threshold_sweep(table(spark, sf, "scored"))
    assert plan(sweep).count("FileScan") == 1 and sweep.agg(F.count(F.lit(1))).first()[0] == 17
