"""Aggregates, exploratory statistics, feature selection and splits as queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import explore, selection, splits
from ..operators.drift import fit_snapshot
from .fixtures import table, with_tables
from .quality_queries import union
from .registry import query

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NUM = ["qty", "price", "net_price", "discount", "tax"]


def rounded(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("a1_value_counts", "select c_nationkey as value, count(*) as n from customer group by 1 order by 2 desc, 1 limit 20")
def a1(spark, sf):
    return agg.value_counts(table(spark, sf, "customer"), "c_nationkey")


@query("a2_value_shares", "select c_mktsegment as value, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from customer group by 1")
def a2(spark, sf):
    return rounded(agg.value_shares(table(spark, sf, "customer"), "c_mktsegment"), 6, "share")


@query("a3_n_unique", union([f"select '{c}' as \"column\", count(distinct {c}) as n_unique from lineitem" for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_quantity")]))
def a3(spark, sf):
    return agg.n_unique(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag", "l_quantity"])


@query("a4_describe_numeric", with_tables(union([
    f"""select '{c}' as "column", count({c}) as n, round(avg({c}), 4) as mean, round(median({c}), 4) as median, round(stddev_samp({c}), 4) as std,
        min({c}) as min, max({c}) as max, round(skewness({c}), 4) as skew from {{line_num}}""" for c in ("qty", "price", "discount")])))
def a4(spark, sf):
    found = agg.describe_numeric(table(spark, sf, "line_num"), ["qty", "price", "discount"])
    return rounded(found, 4, "mean", "median", "std", "skew")


@query("a5_grouped_median", with_tables(union([
    f"""select '{c}' as "column", toxic, round(median({c}), 6) as median,
        round((select max(m) / nullif(min(m), 0) from (select median({c}) as m from {{doc_ft}} group by toxic)), 6) as ratio
        from {{doc_ft}} group by toxic""" for c in ("n_chars", "n_spaces")])))
def a5(spark, sf):
    return rounded(agg.grouped_median(table(spark, sf, "doc_ft"), ["n_chars", "n_spaces"], "toxic"), 6, "median", "ratio")


@query("a6_crosstab", with_tables("""
    with top as (select c_nationkey from {cust_ft} group by 1 order by count(*) desc, 1 limit 10)
    select c_nationkey as category, churned as target, count(*) as n,
           round(count(*) * 100.0 / sum(count(*)) over (partition by c_nationkey), 6) as pct
    from {cust_ft} where c_nationkey in (from top) group by 1, 2"""))
def a6(spark, sf):
    return rounded(agg.crosstab_pct(table(spark, sf, "cust_ft"), "c_nationkey", "churned"), 6, "pct")


@query("a8_corr_with_target", with_tables(union([
    f"select '{c}' as \"column\", round(corr({c}, y), 6) as r, round(abs(corr({c}, y)), 6) as abs_r from {{line_num}}" for c in NUM])))
def a8(spark, sf):
    return rounded(agg.corr_with_target(table(spark, sf, "line_num"), NUM, "y"), 6, "r", "abs_r")


CORR = union([f"select '{a}' as column_a, '{b}' as column_b, corr({a}, {b}) as r from {{line_num}}" for a, b in agg.pairs(NUM)])


@query("a9_corr_matrix", with_tables(f"select column_a, column_b, round(r, 6) as r from ({CORR})"))
def a9(spark, sf):
    return rounded(agg.correlations(table(spark, sf, "line_num"), agg.pairs(NUM)), 6, "r")


@query("a9_corr_pairwise_complete", with_tables("""
    select 'price_low' as column_a, 'price_high' as column_b, round(corr(price_low, price_high), 6) as r from {null_orders}
    union all select 'price_low', 'o_custkey', round(corr(price_low, o_custkey), 6) from {null_orders}"""))
def a9_nulls(spark, sf):
    found = agg.correlations(table(spark, sf, "null_orders"), [("price_low", "price_high"), ("price_low", "o_custkey")])
    return rounded(found, 6, "r")


@query("a10_conditional_shares", with_tables("""
    select l_linestatus, round(avg(cast(p > 0.7e0 as int)), 6) as high, round(avg(case when y = 1 then p end), 6) as mean_positive from {scored} group by 1"""))
def a10(spark, sf):
    return table(spark, sf, "scored").groupBy("l_linestatus").agg(
        F.round(agg.share(F.col("p") > 0.7), 6).alias("high"), F.round(F.avg(F.when(F.col("y") == 1, F.col("p"))), 6).alias("mean_positive"))


@query("a11_sparsity", with_tables("""
    select round(sum(cast(discount = 0 as int) + cast(tax = 0 as int) + cast(qty = 0 as int)) / (3.0 * count(*)), 6) as zero_share from {line_num}"""))
def a11(spark, sf):
    zero = [(F.col(c) == 0).cast("int") for c in ("discount", "tax", "qty")]
    return table(spark, sf, "line_num").agg(F.round(F.sum(zero[0] + zero[1] + zero[2]) / (3.0 * F.count(F.lit(1))), 6).alias("zero_share"))


@query("a12_percentiles", "select unnest([0.95, 0.99])::double as prob, round(unnest(quantile_cont(value, [0.95, 0.99])), 4) as value from events")
def a12(spark, sf):
    from ..operators.metrics import percentiles
    return rounded(percentiles(table(spark, sf, "events"), "value"), 4, "value")


@query("a12_percentiles_narrowed", "select unnest([0.01, 0.5, 0.95, 0.99])::double as prob, round(unnest(quantile_cont(value, [0.01, 0.5, 0.95, 0.99])), 4) as value from events")
def a12_narrowed(spark, sf):
    # the path for values too many to hold in one task, forced by a small limit
    found = agg.quantiles(table(spark, sf, "events"), ["value"], [0.01, 0.5, 0.95, 0.99], exact_rows=500, accuracy=200)
    return found.select("prob", F.round("value", 4).alias("value"))


@query("a13_variances", with_tables(union([f"select '{c}' as \"column\", round(var_samp({c}), 6) as variance from {{line_num}}" for c in ("qty", "discount", "tiny")])))
def a13(spark, sf):
    return rounded(agg.variances(table(spark, sf, "line_num"), ["qty", "discount", "tiny"]), 6, "variance")


# charts as tables -----------------------------------------------------------

HIST = """select {by} bin, round(lo + bin * w, 6) as lo, round(lo + (bin + 1) * w, 6) as hi, n,
    round(n / (sum(n) over ({part}) * w), 8) as density from (
    select {by} least(cast(floor(({x} - lo) / w) as int), {bins} - 1) as bin, lo, w, count(*) as n
    from {t}, (select min({x}) as lo, (max({x}) - min({x})) / {bins} as w from {t}) group by all)"""


@query("e1_histogram", HIST.format(by="", part="", x="value", bins=40, t="events"))
def e1(spark, sf):
    found = explore.histogram(table(spark, sf, "events"), "value")
    return rounded(rounded(found, 6, "lo", "hi"), 8, "density")


@query("e1_histogram_by_class", with_tables(HIST.format(by="toxic,", part="partition by toxic", x="n_chars", bins=40, t="{doc_ft}")))
def e1_by(spark, sf):
    found = explore.histogram(table(spark, sf, "doc_ft"), "n_chars", by="toxic")
    return rounded(rounded(found, 6, "lo", "hi"), 8, "density")


@query("e2_kde", f"""
    with s as (select min(value) as lo, max(value) as hi, count(*) as n, stddev_samp(value) * pow(count(*), -0.2) as h from events),
    b as (select least(cast(floor((value - lo) / ((hi - lo) / 1024)) as int), 1023) as b, count(*) as w from events, s group by 1)
    select round(x, 6) as x, round(sum(exp(-0.5 * pow((x - c) / h, 2)) * w) / (n * h * {math.sqrt(2 * math.pi)!r}), 8) as density
    from (select lo + i * (hi - lo) / 199 as x, lo + (b + 0.5) * (hi - lo) / 1024 as c, h, w, n from b, s, range(200) t(i)) group by x, h, n""")
def e2(spark, sf):
    found = explore.kde(table(spark, sf, "events"), "value")
    return found.select(F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query("e3_violin_stats", with_tables(union([
    f"""select '{c}' as "column", toxic, count({c}) as n, cast(min({c}) as double) as min, quantile_cont({c}, 0.25) as q1, median({c}) as median,
        quantile_cont({c}, 0.75) as q3, cast(max({c}) as double) as max from {{doc_ft}} group by toxic""" for c in ("n_chars", "n_lines")])))
def e3(spark, sf):
    return explore.violin_stats(table(spark, sf, "doc_ft"), ["n_chars", "n_lines"], "toxic")


@query("e4_missing_map", with_tables("""
    select "column", round(s, 6) as null_share, row_number() over (order by s desc, "column") as rank, s > 0.5 as over_limit from (""" + union([
    f"select '{c}' as \"column\", 1 - count({c}) / count(*) as s from {{null_orders}}"
    for c in ("o_orderkey", "o_custkey", "price_trace", "price_low", "status_mid", "price_high", "priority_drop")]) + ")"))
def e4(spark, sf):
    return rounded(explore.missing_map(table(spark, sf, "null_orders")), 6, "null_share")


@query("e4_missing_sample", with_tables("""
    select o_orderkey, """ + ", ".join(f"cast({c} is null as int) as {c}" for c in ("o_custkey", "price_trace", "price_low", "status_mid", "price_high", "priority_drop")) + """
    from {null_orders} order by ((o_orderkey % 2147483648 + 42) * 2654435761) % 4294967296, o_orderkey limit 500"""))
def e4_sample(spark, sf):
    return explore.missing_sample(table(spark, sf, "null_orders"), ["o_orderkey"], portable=True)


@query("e5_corr_pairs", with_tables(f"select column_a, column_b, round(r, 6) as r, round(abs(r), 6) as abs_r, abs(r) > 0.85 as severe from ({CORR})"))
def e5(spark, sf):
    return rounded(explore.corr_pairs(table(spark, sf, "line_num"), NUM), 6, "r", "abs_r")


@query("e6_top_correlated", with_tables("""
    select "column", round(r, 6) as r, round(abs(r), 6) as abs_r, case when r >= 0 then 'positive' else 'negative' end as direction from (""" + union([
    f"select '{c}' as \"column\", corr({c}, qty) as r from {{line_num}}" for c in ("price", "net_price", "discount", "tax", "qty4")]) + """)
    order by abs(r) desc, "column" limit 3"""))
def e6(spark, sf):
    found = explore.top_correlated(table(spark, sf, "line_num"), ["price", "net_price", "discount", "tax", "qty4"], "qty", 3)
    return rounded(found, 6, "r", "abs_r")


@query("e7_pairplot_sample")
def e7(spark, sf):
    return explore.pairplot_sample(table(spark, sf, "line_num"), NUM, "y", LINE_KEY)


@query("e8_collinear_pairs", with_tables(f"select column_a, column_b, round(r, 6) as r from ({CORR}) where abs(r) > 0.85"))
def e8(spark, sf):
    return rounded(explore.collinear_pairs(table(spark, sf, "line_num"), NUM), 6, "r")


FINDING_COLUMNS = ["n_chars", "n_spaces", "n_lines"]


@query("e9_key_findings", with_tables("""
    with r as (""" + union([f"select '{c}' as c, corr({c}, toxic) as r, skewness({c}) as s from {{doc_ft}}" for c in FINDING_COLUMNS]) + """),
    p as (""" + union([f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from {{doc_ft}}" for a, b in agg.pairs(FINDING_COLUMNS)]) + """),
    ranked as (select c, row_number() over (order by abs(r) desc, c) as k from r)
    select 'top feature' as section, c as item, round(r, 6) as value from r
    union all select 'collinear', a || ' ~ ' || b, round(r, 6) from p where abs(r) > 0.85
    union all select 'class share', cast(toxic as string), round(count(*) / sum(count(*)) over (), 6) from {doc_ft} group by toxic
    union all select 'extreme skew', c, round(s, 6) from r where abs(s) > 3
    union all select 'suggestion', 'log1p(' || c || ')', null from r where abs(s) > 3
    union all select * from (select 'suggestion', a || ' / ' || b, cast(null as double) from p where abs(r) > 0.85 order by abs(r) desc, a, b limit 1)
    union all select 'suggestion', (select c from ranked where k = 1) || ' x ' || (select c from ranked where k = 2), null"""))
def e9(spark, sf):
    return rounded(explore.key_findings(table(spark, sf, "doc_ft"), FINDING_COLUMNS, "toxic"), 6, "value")


@query("e10_score_distribution", with_tables(HIST.format(by="y,", part="partition by y", x="p", bins=40, t="{scored}")))
def e10(spark, sf):
    found = explore.histogram(table(spark, sf, "scored"), "p", by="y")
    return rounded(rounded(found, 6, "lo", "hi"), 8, "density")


# feature selection ----------------------------------------------------------

SELECT_COLS = ["price", "net_price", "discount", "tax", "tiny", "qty4"]
VARIANCE = union([f"select '{c}' as f, var_samp({c}) as v, round(abs(corr({c}, qty)), 9) as i from {{line_num}}" for c in SELECT_COLS])
SELECT_PAIRS = union([f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from {{line_num}}" for a, b in agg.pairs(SELECT_COLS)])


def target_importances(df):
    return agg.corr_with_target(df, SELECT_COLS, "qty").select(F.col("column").alias("feature"), F.round("abs_r", 9).alias("importance"))


@query("fs1_variance_filter", with_tables(f"select f as \"column\", round(v / greatest(v, 1), 6) as variance, v >= 0.01 as kept from ({VARIANCE})"))
def fs1(spark, sf):
    found = selection.variance_filter(table(spark, sf, "line_num"), SELECT_COLS)
    return found.withColumn("variance", F.round(F.col("variance") / F.greatest("variance", F.lit(1.0)), 6))


@query("fs3_importance_filter", with_tables(f"select f as feature, round(i, 6) as importance from ({VARIANCE}) where i >= 0.001"))
def fs3(spark, sf):
    return rounded(selection.importance_filter(target_importances(table(spark, sf, "line_num"))), 6, "importance")


@query("fs4_redundancy_filter", with_tables(f"""
    with i as ({VARIANCE}), p as ({SELECT_PAIRS})
    select distinct case when ib.i >= ia.i then p.a else p.b end as feature from p join i ia on ia.f = p.a join i ib on ib.f = p.b where abs(p.r) > 0.9"""))
def fs4(spark, sf):
    df = table(spark, sf, "line_num")
    return selection.redundancy_filter(explore.corr_pairs(df, SELECT_COLS), target_importances(df))


@query("fs6_median_fill", with_tables("""
    select o_orderkey, round(coalesce(price_high, (select median(price_high) from {null_orders})), 4) as price_high from {null_orders}"""))
def fs6(spark, sf):
    from ..operators.clean import impute
    return rounded(impute(table(spark, sf, "null_orders"), ["price_high"]).select("o_orderkey", "price_high"), 4, "price_high")


@query("fs7_top_importance", with_tables("""
    with t as (select feature, sum(importance) as importance from {importances} group by 1 order by 2 desc, 1 limit 20)
    select feature, round(importance, 6) as importance, importance >= (select quantile_cont(importance, 0.7) from t) as highlight from t"""))
def fs7(spark, sf):
    total = table(spark, sf, "importances").groupBy("feature").agg(F.sum("importance").alias("importance"))
    return rounded(selection.top_importance(total), 6, "importance")


@query("fs8_selection_report", with_tables(f"""
    with i as ({VARIANCE}), p as ({SELECT_PAIRS}),
    good as (select * from i where v >= 0.01 and i >= 0.001),
    lost as (select distinct case when ib.i >= ia.i then p.a else p.b end as f from p join good ia on ia.f = p.a join good ib on ib.f = p.b where abs(p.r) > 0.9),
    judged as (select f, case when v < 0.01 then 'low variance' when i < 0.001 then 'low importance'
                              when f in (select f from lost) then 'redundant' end as reason from i)
    select f as feature, reason is null as kept, reason from judged"""))
def fs8(spark, sf):
    df = table(spark, sf, "line_num")
    return selection.selection_report(df, SELECT_COLS, target_importances(df))


# splits ---------------------------------------------------------------------

HASH = "((({k} % 2147483648 + {s}) * 2654435761) % 4294967296)"
CUTS = [int(0.7 * 4294967296), int(0.85 * 4294967296)]
SPLIT = f"case when {HASH.format(k='{k}', s=42)} < {CUTS[0]} then 'train' when {HASH.format(k='{k}', s=42)} < {CUTS[1]} then 'val' else 'test' end"


@query("sp1_split", with_tables(f"select doc_id, toxic, {SPLIT.format(k='doc_id')} as split from {{doc_ft}}"))
def sp1(spark, sf):
    return splits.split(table(spark, sf, "doc_ft"), "doc_id", "toxic", portable=True).select("doc_id", "toxic", "split")


@query("sp1_split_exact", with_tables(f"""
    with h as (select doc_id, toxic, row_number() over (partition by toxic order by {HASH.format(k='doc_id', s=42)}, doc_id) - 1 as place,
                      count(*) over (partition by toxic) as n from {{doc_ft}})
    select doc_id, toxic, case when place < 0.7e0 * n then 'train' when place < (0.7e0 + 0.15e0) * n then 'val' else 'test' end as split from h"""))
def sp1_exact(spark, sf):
    return splits.split(table(spark, sf, "doc_ft"), "doc_id", "toxic", exact=True, portable=True).select("doc_id", "toxic", "split")


@query("sp2_split_regression", f"select o_orderkey, {SPLIT.format(k='o_orderkey')} as split from orders")
def sp2(spark, sf):
    return splits.split(table(spark, sf, "orders"), "o_orderkey", portable=True).select("o_orderkey", "split")


@query("sp3_folds", f"select o_orderkey, cast(floor({HASH.format(k='o_orderkey', s=42)} * 10 / 4294967296) as int) as fold from orders")
def sp3(spark, sf):
    return splits.folds(table(spark, sf, "orders"), "o_orderkey", 10, portable=True).select("o_orderkey", "fold")


@query("w5_stratified_fold_counts", with_tables(f"""
    select toxic, cast((place - 1) % 5 as int) as fold, count(*) as n from (
      select toxic, row_number() over (partition by toxic order by {HASH.format(k='doc_id', s=42)}, doc_id) as place from {{doc_ft}}) group by all"""))
def w5(spark, sf):
    found = splits.folds(table(spark, sf, "doc_ft"), "doc_id", 5, portable=True, label="toxic")
    return found.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("sp3_stratified_folds", with_tables(f"""
    select doc_id, toxic, cast((row_number() over (partition by toxic order by {HASH.format(k='doc_id', s=42)}, doc_id) - 1) % 10 as int) as fold
    from {{doc_ft}}"""))
def sp3_stratified(spark, sf):
    return splits.folds(table(spark, sf, "doc_ft"), "doc_id", 10, portable=True, label="toxic").select("doc_id", "toxic", "fold")


@query("sp4_nested_subsets", union([
    f"select {f} as fraction, count(*) as n from orders where {HASH.format(k='o_orderkey', s=42)} < {int(f * 4294967296)}" for f in (0.1, 0.25, 0.5, 1.0)]).replace("select 0.1 as", "select 0.1::double as"))
def sp4(spark, sf):
    df = table(spark, sf, "orders")
    one = df.agg(*[F.count(F.when(splits.nested_subset("o_orderkey", f, portable=True), 1)).alias(f"n{i}") for i, f in enumerate((0.1, 0.25, 0.5, 1.0))])
    return agg.to_rows(one, [{"fraction": F.lit(f), "n": F.col(f"n{i}")} for i, f in enumerate((0.1, 0.25, 0.5, 1.0))])


@query("sp5_split_report", with_tables(f"""
    select split, count(*) as n, round(avg(toxic), 6) as positive_rate from (select toxic, {SPLIT.format(k='doc_id')} as split from {{doc_ft}}) group by 1"""))
def sp5(spark, sf):
    parts = splits.split(table(spark, sf, "doc_ft"), "doc_id", "toxic", portable=True)
    return rounded(splits.split_report(parts, "toxic"), 6, "positive_rate")


@query("sp6_class_weights", with_tables("""
    select toxic as class, count(*) as n, round((select count(*) / count(distinct toxic) from {doc_ft}) / count(*), 6) as balanced_weight
    from {doc_ft} group by 1"""))
def sp6(spark, sf):
    return rounded(splits.class_weights(table(spark, sf, "doc_ft"), "toxic"), 6, "balanced_weight")


@query("sp6_positive_weight", with_tables("""
    select round(avg(toxic), 6) as positive_rate, round((1 - avg(toxic)) / avg(toxic), 6) as positive_weight,
           round(greatest(sum(toxic), sum(1 - toxic)) / least(sum(toxic), sum(1 - toxic)), 6) as count_ratio from {doc_ft}"""))
def sp6_positive(spark, sf):
    return rounded(splits.positive_weight(table(spark, sf, "doc_ft"), "toxic"), 6, "positive_rate", "positive_weight", "count_ratio")


@query("d4_snapshot", with_tables(union([
    f"""select '{c}' as feature, count({c}) as n_train, round(avg({c}), 4) as mean, round(stddev_pop({c}), 4) as std, min({c}) as min, max({c}) as max,
        round(quantile_cont({c}, 0.05), 4) as p5, round(quantile_cont({c}, 0.25), 4) as p25, round(quantile_cont({c}, 0.75), 4) as p75,
        round(quantile_cont({c}, 0.95), 4) as p95 from {{line_num}}""" for c in ("qty", "discount", "price")])))
def d4(spark, sf):
    found = fit_snapshot(table(spark, sf, "line_num"), ["qty", "discount", "price"])
    return rounded(found, 4, "mean", "std", "p5", "p25", "p75", "p95")
