"""Metrics, thresholds, leaderboards and validation rules on closed-form scores."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import choose, metrics, scoring
from ..operators.quality import check_beats_dummy
from .explore_queries import rounded
from .fixtures import table, with_tables
from .quality_queries import union
from .registry import query

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def ranking_sql(source: str, keys: str = "", y: str = "y", p: str = "p") -> str:
    """ROC-AUC and step-sum average precision per group, from counts per distinct score."""
    lead = f"{keys}, " if keys else ""
    part = f"partition by {keys} " if keys else ""
    group = f"group by {keys}" if keys else ""
    return f"""
      select {lead}sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) as roc_auc,
             sum(pos * (cpos / (cpos + cneg))) / nullif(sum(pos), 0) as average_precision
      from (select *, cast(sum(neg) over ({part}order by s) - neg as double) as below,
                   cast(sum(pos) over ({part}order by s desc) as double) as cpos, cast(sum(neg) over ({part}order by s desc) as double) as cneg
            from (select {lead}{p} as s, cast(sum({y}) as double) as pos, cast(count(*) - sum({y}) as double) as neg from {source} group by {lead}{p})) {group}"""


@query("me1_roc_auc", with_tables(f"select round(roc_auc, 8) as roc_auc from ({ranking_sql('{scored}')})"))
def me1(spark, sf):
    return rounded(metrics.roc_auc(table(spark, sf, "scored")), 8, "roc_auc")


@query("me1_roc_auc_ranges", with_tables(f"select round(roc_auc, 8) as roc_auc, round(average_precision, 8) as average_precision from ({ranking_sql('{scored}')})"))
def me1_ranges(spark, sf):
    # many scan ranges, as on a table too large for one
    return rounded(metrics.ranking_metrics(table(spark, sf, "scored"), ranges=6), 8, "roc_auc", "average_precision")


@query("w4_auc_by_group", with_tables(f"select l_linestatus, split, round(roc_auc, 8) as roc_auc from ({ranking_sql('{scored}', 'l_linestatus, split')})"))
def w4(spark, sf):
    return rounded(metrics.roc_auc(table(spark, sf, "scored"), by=["l_linestatus", "split"]), 8, "roc_auc")


@query("me2_average_precision", with_tables(f"select round(average_precision, 8) as average_precision from ({ranking_sql('{scored}')})"))
def me2(spark, sf):
    return rounded(metrics.average_precision(table(spark, sf, "scored")), 8, "average_precision")


@query("w3_cumulative_counts", with_tables("""
    select round(p, 6) as score, count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg,
           cast(sum(count(*) filter (where y = 1)) over (order by p desc) as bigint) as cum_pos,
           cast(sum(count(*) filter (where y = 0)) over (order by p desc) as bigint) as cum_neg from {scored} group by p"""))
def w3(spark, sf):
    from ..operators.prefix import prefix_scan
    df = table(spark, sf, "scored")
    found = prefix_scan(df, "p", {"pos": F.col("y"), "neg": 1 - F.col("y")}, descending=True, ranges=5)
    return found.select(F.round("p", 6).alias("score"), "pos", "neg", "cum_pos", "cum_neg")


@query("me3_confusion", with_tables("""
    select y as actual, pred as predicted, count(*) as n, round(count(*) / sum(count(*)) over (partition by y), 6) as row_share from {decided} group by 1, 2"""))
def me3(spark, sf):
    return rounded(metrics.confusion(table(spark, sf, "decided")), 6, "row_share")


@query("me3_worst_cell", with_tables("""
    select y as actual, pred as predicted, n, round(n / total, 6) as row_share from (
      select y, pred, count(*) as n, sum(count(*)) over (partition by y) as total from {emb_ft} group by 1, 2)
    where y <> pred order by n desc, 1, 2 limit 1"""))
def me3_worst(spark, sf):
    return rounded(metrics.worst_confusion(table(spark, sf, "emb_ft")), 6, "row_share")


COUNTS = """select count(*) filter (where y = 1 and pred = 1) as tp, count(*) filter (where y = 0 and pred = 1) as fp,
    count(*) filter (where y = 1 and pred = 0) as fn, count(*) filter (where y = 0 and pred = 0) as tn from {decided}"""


@query("me4_binary_metrics", with_tables(f"""
    select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(tp / (tp + fp), 6) as precision,
           round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from ({COUNTS})"""))
def me4(spark, sf):
    return rounded(metrics.binary_metrics(table(spark, sf, "decided")), 6, "accuracy", "precision", "recall", "f1")


REPORT = """
    select class, coalesce(tp / nullif(called, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall,
           coalesce(2 * tp / nullif(support + called, 0), 0) as f1, support from (
      select class, count(*) filter (where side = 0 and y = pred) as tp, count(*) filter (where side = 0) as support, count(*) filter (where side = 1) as called
      from (select y as class, y, pred, 0 as side from {emb_ft} union all select pred, y, pred, 1 from {emb_ft}) group by class)"""


@query("me5_multiclass_metrics", with_tables(f"""
    select round(sum(recall * support) / sum(support), 6) as accuracy, round(sum(precision * support) / sum(support), 6) as precision_weighted,
           round(sum(recall * support) / sum(support), 6) as recall_weighted, round(sum(f1 * support) / sum(support), 6) as f1_weighted,
           round(avg(precision), 6) as precision_macro, round(avg(recall), 6) as recall_macro, round(avg(f1), 6) as f1_macro from ({REPORT})"""))
def me5(spark, sf):
    found = metrics.multiclass_metrics(table(spark, sf, "emb_ft"))
    return rounded(found, 6, *found.columns)


@query("me9_class_report", with_tables(f"select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from ({REPORT})"))
def me9(spark, sf):
    return rounded(metrics.class_report(table(spark, sf, "emb_ft")), 6, "precision", "recall", "f1")


@query("me6_mcc", with_tables(f"""
    select round((cast(tp as double) * tn - cast(fp as double) * fn) / sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc from ({COUNTS})"""))
def me6(spark, sf):
    return rounded(metrics.mcc(table(spark, sf, "decided")), 6, "mcc")


@query("me6_mcc_multiclass", with_tables("""
    with m as (select class, sum(t) as t, sum(p) as p, sum(c) as c from (
      select y as class, 1 as t, 0 as p, cast(y = pred as int) as c from {emb_ft} union all select pred, 0, 1, 0 from {emb_ft}) group by class),
    a as (select cast(sum(t) as double) as s, cast(sum(c) as double) as c, cast(sum(t * p) as double) as tp, cast(sum(t * t) as double) as tt, cast(sum(p * p) as double) as pp from m)
    select round((c * s - tp) / sqrt((s * s - pp) * (s * s - tt)), 6) as mcc from a"""))
def me6_multi(spark, sf):
    return rounded(metrics.mcc(table(spark, sf, "emb_ft")), 6, "mcc")


@query("me7_kappa", with_tables(f"""
    select round((po - pe) / (1 - pe), 6) as kappa from (select (tp + tn) / n as po, ((tp + fp) / n) * ((tp + fn) / n) + ((tn + fn) / n) * ((tn + fp) / n) as pe
      from (select *, tp + fp + fn + tn as n from ({COUNTS})))"""))
def me7(spark, sf):
    return rounded(metrics.kappa(table(spark, sf, "decided")), 6, "kappa")


@query("me8_brier", with_tables("select round(avg((p - y) * (p - y)), 8) as brier from {scored}"))
def me8(spark, sf):
    return rounded(metrics.brier(table(spark, sf, "scored")), 8, "brier")


CURVE = """select s as threshold, cneg / n as fpr, cpos / p as tpr, cpos / (cpos + cneg) as precision from (
    select s, sum(sum(y)) over (order by s desc) as cpos, sum(sum(1 - y)) over (order by s desc) as cneg, sum(sum(y)) over () as p, sum(sum(1 - y)) over () as n
    from (select {s} as s, y from {{scored}}) group by s)"""


@query("me10_roc_curve", with_tables(f"select round(threshold, 6) as threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr from ({CURVE.format(s='p')})"))
def me10(spark, sf):
    return rounded(metrics.roc_curve(table(spark, sf, "scored")), 6, "threshold", "fpr", "tpr")


@query("me10_roc_curve_binned", with_tables(f"select round(threshold, 6) as threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr from ({CURVE.format(s='floor(p * 100) / 100')})"))
def me10_binned(spark, sf):
    return rounded(metrics.roc_curve(table(spark, sf, "scored"), bins=100), 6, "threshold", "fpr", "tpr")


@query("me10_best_point", with_tables(f"""
    select round(threshold, 6) as threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr, round(sqrt(fpr * fpr + (1 - tpr) * (1 - tpr)), 6) as distance,
           round((select roc_auc from ({ranking_sql('{scored}')})), 6) as roc_auc, round(((select roc_auc from ({ranking_sql('{scored}')})) - 0.5) / 0.5 * 100, 6) as over_chance_pct
    from ({CURVE.format(s='p')}) order by fpr * fpr + (1 - tpr) * (1 - tpr), threshold desc limit 1"""))
def me10_best(spark, sf):
    found = metrics.best_roc_point(table(spark, sf, "scored"))
    return rounded(found, 6, *found.columns)


@query("me11_pr_curve", with_tables(f"""
    select round(threshold, 6) as threshold, round(precision, 6) as precision, round(tpr, 6) as recall,
           round((select avg(y) from {{scored}}), 6) as no_skill, round(precision / (select avg(y) from {{scored}}), 6) as lift from ({CURVE.format(s='p')})"""))
def me11(spark, sf):
    found = metrics.pr_curve(table(spark, sf, "scored"))
    return rounded(found, 6, *found.columns)


@query("me11_pr_summary", with_tables(f"""
    select round(average_precision, 6) as average_precision, round((select avg(y) from {{scored}}), 6) as no_skill,
           round(average_precision / (select avg(y) from {{scored}}), 6) as lift from ({ranking_sql('{scored}')})"""))
def me11_summary(spark, sf):
    found = metrics.pr_summary(table(spark, sf, "scored"))
    return rounded(found, 6, *found.columns)


CALIBRATION = """select greatest(cast(ceil(p * 10) as int) - 1, 0) as bin, count(*) as n, avg(p) as mp, avg(y) as share from {scored} group by 1"""


@query("me12_calibration", with_tables(f"select bin, n, round(mp, 6) as mean_predicted, round(share, 6) as positive_share, round(abs(share - mp), 6) as gap from ({CALIBRATION})"))
def me12(spark, sf):
    return rounded(metrics.calibration(table(spark, sf, "scored")), 6, "mean_predicted", "positive_share", "gap")


@query("me12_calibration_verdict", with_tables(f"""
    select round(g, 6) as max_gap, case when g < 0.05 then 'trustworthy' when g < 0.1 then 'slightly overconfident' else 'not trustworthy' end as verdict
    from (select max(abs(share - mp)) as g from ({CALIBRATION}))"""))
def me12_verdict(spark, sf):
    return rounded(metrics.calibration_verdict(table(spark, sf, "scored")), 6, "max_gap")


@query("me13_regression_metrics", with_tables("""
    select round(avg(abs(y - pred)), 4) as mae, round(sqrt(avg((y - pred) * (y - pred))), 4) as rmse,
           round(1 - avg((y - pred) * (y - pred)) / var_pop(y), 6) as r2, round(100 * avg(case when y <> 0 then abs((y - pred) / y) end), 4) as mape_pct,
           round(median(abs(y - pred)), 4) as median_ae from {line_pred}"""))
def me13(spark, sf):
    found = metrics.regression_metrics(table(spark, sf, "line_pred"))
    return rounded(rounded(found, 4, "mae", "rmse", "mape_pct", "median_ae"), 6, "r2")


RESID = "select *, (y - pred) / (stddev_pop(y - pred) over () + 1e-9) as z from {line_pred}"


@query("me15_residuals", with_tables(f"""
    select {LINE}, round(pred, 4) as fitted, round(y - pred, 4) as residual, round(z, 6) as standardised, round(sqrt(abs(z)), 6) as root_abs_standardised from ({RESID})"""))
def me15(spark, sf):
    found = metrics.residuals(table(spark, sf, "line_pred"), "y", "pred", LINE_KEY)
    return rounded(rounded(found, 4, "fitted", "residual"), 6, "standardised", "root_abs_standardised")


@query("me15_residual_summary", with_tables(f"""
    select round(skewness(y - pred), 6) as skew, round(regr_slope(sqrt(abs(z)), pred) * 1000, 6) as trend_slope,
           case when abs(skewness(y - pred)) < 0.5 then 'approximately normal' else 'skewed' end as verdict from ({RESID})"""))
def me15_summary(spark, sf):
    found = metrics.residual_summary(table(spark, sf, "line_pred"), "y", "pred")
    return rounded(found.withColumn("trend_slope", F.col("trend_slope") * 1000), 6, "skew", "trend_slope")


QQ = [(i + 0.5) / 200 for i in range(200)]


@query("me16_qq_points", with_tables(f"""
    select round(unnest({QQ}), 6) as prob, round(unnest({[NormalDist().inv_cdf(p) for p in QQ]}), 6) as theoretical,
           round(unnest((select quantile_cont(y - pred, {QQ}) from {{line_pred}})), 6) as sample"""))
def me16(spark, sf):
    df = table(spark, sf, "line_pred").withColumn("residual", F.col("y") - F.col("pred"))
    return rounded(rounded(metrics.qq_points(df, "residual"), 6, "prob", "theoretical"), 6, "sample")


# attribution on a fixed linear model -----------------------------------------

WEIGHTS = {"l_quantity": 0.04, "l_discount": -9.0, "l_tax": 12.0, "l_linenumber": 0.25}
MEANS = {f: f"(select avg({f}) from lineitem)" for f in WEIGHTS}


@query("me17_attribution_global", union([
    f"select '{f}' as feature, round(avg(abs({w} * ({f} - {MEANS[f]}))), 6) as mean_abs_contribution from lineitem" for f, w in WEIGHTS.items()]).replace(" -9.0 *", " (-9.0) *"))
def me17(spark, sf):
    return rounded(scoring.attribution_global(table(spark, sf, "lineitem"), WEIGHTS), 6, "mean_abs_contribution")


def pieces(value):
    return "[" + ", ".join(f"{{'o': -abs({value(f, w)}), 'feature': '{f}', 'value': {f}, 'c': {value(f, w)}}}" for f, w in WEIGHTS.items()) + "]"


@query("me18_attribution_rows", f"""
    select {LINE}, r[1].feature as f1, round(r[1].c, 6) as c1, r[2].feature as f2, round(r[2].c, 6) as c2, r[3].feature as f3, round(r[3].c, 6) as c3
    from (select *, list_sort({pieces(lambda f, w: f"({w}) * (cast({f} as double) - {MEANS[f]})").replace("'value': l_linenumber", "'value': cast(l_linenumber as double)")}) as r from lineitem)""")
def me18(spark, sf):
    out = scoring.attribution_rows(table(spark, sf, "lineitem"), WEIGHTS, 3)
    cols = [c for i in range(3) for c in (F.col("reasons")[i]["feature"].alias(f"f{i+1}"), F.round(F.col("reasons")[i]["contribution"], 6).alias(f"c{i+1}"))]
    return out.select(*LINE_KEY, *cols)


@query("o6_explanation_sample", f"""
    select {LINE}, r[1].feature as f1, round(r[1].c, 6) as c1, r[2].feature as f2, round(r[2].c, 6) as c2
    from (select *, list_sort({pieces(lambda f, w: f"({w}) * (cast({f} as double) - {MEANS[f]})").replace("'value': l_linenumber", "'value': cast(l_linenumber as double)")}) as r
      from (select * from lineitem order by ((l_orderkey % 2147483648 + 42) * 2654435761) % 4294967296, {LINE} limit 500))""")
def o6(spark, sf):
    out = scoring.explain_sample(table(spark, sf, "lineitem"), WEIGHTS, LINE_KEY, portable=True)
    cols = [c for i in range(2) for c in (F.col("reasons")[i]["feature"].alias(f"f{i+1}"), F.round(F.col("reasons")[i]["contribution"], 6).alias(f"c{i+1}"))]
    return out.select(*LINE_KEY, *cols)


@query("me18_top_reasons", f"""
    select {LINE}, r[1].feature as f1, round(r[1].value, 4) as v1, r[2].feature as f2, r[3].feature as f3
    from (select *, list_sort([{', '.join(f"{{'o': -abs({abs(w)} * {f}), 'feature': '{f}', 'value': cast({f} as double)}}" for f, w in WEIGHTS.items())}]) as r from lineitem)""")
def me18_reasons(spark, sf):
    out = table(spark, sf, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("double"))
    out = out.withColumn("r", scoring.top_reasons({f: abs(w) for f, w in WEIGHTS.items()}))
    r = F.col("r")
    return out.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_partkey", "l_suppkey", r[0]["feature"].alias("f1"),
                      r[0]["value"].alias("v1"), r[1]["feature"].alias("f2"), r[2]["feature"].alias("f3"))


@query("me19_explain_top_row", with_tables(f"""
    with t as (select * from {{scored}} order by p desc, {LINE} limit 1),
    parts as (""" + union([f"select '{f}' as feature, cast({f} as double) as value, ({w}) * ({f} - {MEANS[f]}) as c, p, l_orderkey from t" for f, w in WEIGHTS.items()]) + """)
    select l_orderkey, round(p, 6) as score, row_number() over (order by abs(c) desc, feature) as rank, feature, value, round(c, 6) as contribution from parts"""))
def me19(spark, sf):
    df = table(spark, sf, "scored")
    found = scoring.explain_top_row(df, WEIGHTS, "p", LINE_KEY)
    return rounded(found.select("l_orderkey", "score", "rank", "feature", "value", "contribution"), 6, "score", "contribution")


# thresholds -----------------------------------------------------------------

def sweep_sql(cuts):
    return f"""
      select t as threshold, coalesce(tp / nullif(flagged, 0), 0) as precision, coalesce(tp / nullif(pos, 0), 0) as recall,
             coalesce(2 * tp / nullif(flagged + pos, 0), 0) as f1, flagged
      from (select t, count(*) filter (where p >= t) as flagged, count(*) filter (where p >= t and y = 1) as tp, count(*) filter (where y = 1) as pos
            from {{scored}}, (select unnest({cuts}::double[]) as t) group by t)"""


SWEEP = sweep_sql(metrics.thresholds(step=5))
SWEEP_COLS = "threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, flagged"


@query("v5_threshold_sweep", with_tables(f"select {SWEEP_COLS} from ({SWEEP}) where flagged > 0"))
def v5(spark, sf):
    return rounded(metrics.threshold_sweep(table(spark, sf, "scored"), step=5, skip_empty=True), 6, "precision", "recall", "f1")


@query("j5_threshold_grid", with_tables(f"select {SWEEP_COLS} from ({sweep_sql(metrics.thresholds(step=2))})"))
def j5(spark, sf):
    return rounded(metrics.threshold_sweep(table(spark, sf, "scored"), step=2), 6, "precision", "recall", "f1")


@query("v6_pick_threshold", with_tables(f"""
    with s as ({SWEEP}), b as (select * from s order by f1 desc, threshold limit 1)
    select b.threshold as best_threshold, round(b.f1, 6) as best_f1, round(b.precision, 6) as best_precision, round(b.recall, 6) as best_recall,
           case when b.precision > b.recall + 0.1e0 then 'conservative' when b.recall > b.precision + 0.1e0 then 'aggressive' else 'balanced' end as style,
           (select min(threshold) from s where recall >= 0.9) as first_recall_threshold, (select max(threshold) from s where recall >= 0.9) as highest_recall_threshold
    from b"""))
def v6(spark, sf):
    found = metrics.pick_threshold(metrics.threshold_sweep(table(spark, sf, "scored")))
    return rounded(found, 6, "best_f1", "best_precision", "best_recall")


# leaderboards and verdicts ----------------------------------------------------

BOARD = f"""
    with a as ({ranking_sql('(select * from {scored_long} where split <> %s)' % "'test'", 'model, split')}),
    c as (select model, count(*) filter (where y = 1 and p >= 0.5) as tp, count(*) filter (where y = 0 and p >= 0.5) as fp,
                 count(*) filter (where y = 1 and p < 0.5) as fn from {{scored_long}} where split = 'val' group by model)
    select model, t.roc_auc as auc_train, v.roc_auc as auc_val, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1_val,
           coalesce(tp / nullif(tp + fn, 0), 0) as recall_val, coalesce(tp / nullif(tp + fp, 0), 0) as precision_val, t.roc_auc - v.roc_auc as gap
    from c join (select * from a where split = 'train') t using (model) join (select * from a where split = 'val') v using (model)"""
BOARD_COLS = ["auc_train", "auc_val", "f1_val", "recall_val", "precision_val", "gap"]
BOARD_ROUNDED = "model, " + ", ".join(f"round({c}, 6) as {c}" for c in BOARD_COLS)


def board(spark, sf):
    return choose.evaluate_splits(table(spark, sf, "scored_long"))


@query("m16_evaluate_splits", with_tables(f"select {BOARD_ROUNDED} from ({BOARD})"))
def m16(spark, sf):
    return rounded(board(spark, sf), 6, *BOARD_COLS)


@query("m17_leaderboard", with_tables(f"""
    select {BOARD_ROUNDED}, row_number() over (order by auc_val desc, model) as rank,
           case when auc_val > auc_train + 0.01 then 'LEAKAGE' when gap > 0.08 then 'OVERFIT' else 'OK' end as flag from ({BOARD})"""))
def m17(spark, sf):
    return rounded(choose.leaderboard(board(spark, sf)), 6, *BOARD_COLS)


@query("w6_rank_models", with_tables(f"select model, row_number() over (order by f1_val desc, model) as rank from ({BOARD})"))
def w6(spark, sf):
    return choose.rank_models(board(spark, sf), "f1_val").select("model", "rank")


@query("q13_beats_dummy", with_tables(f"""
    select round(max(auc_val) filter (where lower(model) like '%dummy%'), 6) as dummy_score,
           round(max(auc_val) filter (where lower(model) not like '%dummy%'), 6) as model_score,
           max(auc_val) filter (where lower(model) not like '%dummy%') <= max(auc_val) filter (where lower(model) like '%dummy%') as blocked from ({BOARD})"""))
def q13(spark, sf):
    return rounded(check_beats_dummy(board(spark, sf)), 6, "dummy_score", "model_score")


@query("p7_exclude_baseline", with_tables(f"select model, round(auc_val, 6) as auc_val from ({BOARD}) where lower(model) not like '%dummy%'"))
def p7(spark, sf):
    return rounded(choose.exclude_baseline(board(spark, sf)).select("model", "auc_val"), 6, "auc_val")


@query("p9_round_metrics", with_tables(f"select model as \"Model\", round(auc_val, 4) as \"AUC (val)\", round(f1_val, 4) as f1_val from ({BOARD})"))
def p9(spark, sf):
    found = board(spark, sf).select("model", "auc_val", "f1_val")
    return choose.round_metrics(found, ["auc_val", "f1_val"], 4, {"model": "Model", "auc_val": "AUC (val)"})


@query("h4_best_run_record", with_tables(f"""
    select model as best_model, round(auc_val, 4) as auc_val, round(f1_val, 4) as f1_val, round(auc_train, 4) as auc_train
    from ({BOARD}) where lower(model) not like '%dummy%' order by {{scored_long}}.auc_val desc, model limit 1""").replace("scored_long.auc_val desc", "2 desc"))
def h4(spark, sf):
    from ..operators.history import best_run_record
    m = F.col("metrics")
    return best_run_record(board(spark, sf)).select("best_model", *[m[c].alias(c) for c in ("auc_val", "f1_val", "auc_train")])


GROUP_SCORES = """
    select l_suppkey, avg(case when split = 'train' then p end) as train, avg(case when split = 'val' then p end) as val, avg(case when split = 'test' then p end) as test
    from {scored} group by 1"""


@query("v2_overfit_verdict", with_tables(f"""
    select l_suppkey, case when train - test < -0.01 then 'SUSPECTED DATA LEAKAGE' when train - test < 0.03 then 'WELL-GENERALIZED'
             when train - test <= 0.08 then 'SLIGHT OVERFIT (ACCEPTABLE)' else 'OVERFIT' end as general,
           case when train - val > 0.08 then 'OVERFIT' when test > train + 0.01 then 'LEAKAGE' when train - val < 0 then 'SUSPICIOUS' else 'HEALTHY' end as simple
    from ({GROUP_SCORES})"""))
def v2(spark, sf):
    means = table(spark, sf, "scored").groupBy("l_suppkey").agg(*[
        F.avg(F.when(F.col("split") == s, F.col("p"))).alias(s) for s in ("train", "val", "test")])
    return means.select("l_suppkey", choose.overfit_verdict("train", "test").alias("general"),
                        choose.overfit_verdict("train", "test", "val", "simple").alias("simple"))


FOLD_SCORES = """select l_orderkey % 10 as fold, case when l_linenumber <= 3 then 'val' else 'train' end as part, 'mean_score' as metric, avg(p) as value from {scored} group by 1, 2"""


@query("v1_cv_summary", with_tables(f"""
    select metric, part, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(min(value), 6) as min, round(max(value), 6) as max,
           case when part = 'val' and stddev_pop(value) > 0.05 then 'UNSTABLE' else 'STABLE' end as verdict from ({FOLD_SCORES}) group by 1, 2"""))
def v1_summary(spark, sf):
    scores = table(spark, sf, "scored").groupBy(
        (F.col("l_orderkey") % 10).alias("fold"), F.when(F.col("l_linenumber") <= 3, "val").otherwise("train").alias("part"),
        F.lit("mean_score").alias("metric")).agg(F.avg("p").alias("value"))
    return rounded(choose.cv_summary(scores), 6, "mean", "std", "min", "max")


@query("v3_stability_summary", with_tables(f"""
    select round(avg(roc_auc), 6) as mean, round(stddev_pop(roc_auc), 6) as std, round(stddev_pop(roc_auc) / avg(roc_auc), 6) as cv,
           case when stddev_pop(roc_auc) / avg(roc_auc) < 0.02 then 'STABLE' else 'UNSTABLE' end as verdict
    from ({ranking_sql("(select l_orderkey % 10 as seed, y, p from {scored})", "seed")})"""))
def v3_summary(spark, sf):
    scores = metrics.roc_auc(table(spark, sf, "scored").withColumn("seed", F.col("l_orderkey") % 10), by=["seed"])
    return rounded(choose.stability_summary(scores), 6, "mean", "std", "cv")


@query("v4_feature_stability", with_tables("""
    with t as (select *, row_number() over (partition by run order by importance desc, feature) as r from {importances}),
    n as (select count(distinct run) as runs from {importances})
    select feature, count(*) as appearances, round(count(*) / any_value(runs), 6) as share,
           case when count(*) / any_value(runs) >= 0.5 then 'STABLE' else 'UNSTABLE' end as verdict from t, n where r <= 10 group by 1"""))
def v4_summary(spark, sf):
    return rounded(choose.feature_stability(table(spark, sf, "importances")), 6, "share")


@query("v7_validation_report", with_tables(f"""
    with s as ({SWEEP}), b as (select * from s order by f1 desc, threshold limit 1),
    a as ({ranking_sql('{scored}', 'split')})
    select 'overfitting' as item, case when g < -0.01 then 'SUSPECTED DATA LEAKAGE' when g < 0.03 then 'WELL-GENERALIZED' when g <= 0.08 then 'SLIGHT OVERFIT (ACCEPTABLE)' else 'OVERFIT' end as verdict,
           round(g, 6) as value from (select max(case when split = 'train' then roc_auc end) - max(case when split = 'test' then roc_auc end) as g from a)
    union all select 'threshold', case when precision > recall + 0.1e0 then 'conservative' when recall > precision + 0.1e0 then 'aggressive' else 'balanced' end, threshold from b
    union all select 'stability', case when stddev_pop(roc_auc) / avg(roc_auc) < 0.02 then 'STABLE' else 'UNSTABLE' end, round(stddev_pop(roc_auc) / avg(roc_auc), 6) from a"""))
def v7(spark, sf):
    df = table(spark, sf, "scored")
    auc = metrics.roc_auc(df, by=["split"])
    wide = auc.agg(*[F.max(F.when(F.col("split") == s, F.col("roc_auc"))).alias(s) for s in ("train", "test")])
    overfit = wide.select(F.lit("overfitting").alias("item"), choose.overfit_verdict("train", "test").alias("verdict"), (F.col("train") - F.col("test")).alias("value"))
    cut = metrics.pick_threshold(metrics.threshold_sweep(df)).select(F.lit("threshold").alias("item"), F.col("style").alias("verdict"), F.col("best_threshold").alias("value"))
    stable = choose.stability_summary(auc).select(F.lit("stability").alias("item"), "verdict", F.col("cv").alias("value"))
    return rounded(overfit.unionByName(cut).unionByName(stable), 6, "value")


@query("m1_select_algorithm", with_tables("""
    select l_suppkey, problem_type, case problem_type
        when 'binary_classification' then case when n_rows < 10000 and minority_pct >= 20 then 'Logistic Regression' when n_rows < 10000 then 'Logistic Regression (balanced)'
            when n_rows <= 100000 and minority_pct >= 20 then 'Random Forest' when minority_pct >= 20 then 'Boosted Trees' else 'Boosted Trees (imbalanced)' end
        when 'multiclass_classification' then case when n_rows < 10000 then 'Logistic Regression (multinomial)' else 'Boosted Trees (multiclass)' end
        when 'ordinal_classification' then 'Boosted Trees (ordinal)'
        else case when n_rows < 50000 and sparsity_pct < 50 then 'Random Forest Regressor' when n_rows >= 50000 then 'Boosted Trees Regressor' else 'Huber Regression' end end as label,
      case problem_type when 'binary_classification' then 'roc_auc' when 'regression' then 'r2' else 'f1_weighted' end as primary_metric
    from {profiles}"""))
def m1(spark, sf):
    return choose.select_algorithm(table(spark, sf, "profiles")).select("l_suppkey", "problem_type", "label", "primary_metric")


@query("m18_learning_diagnosis", with_tables("""
    with c as (select l_orderkey % 10 as step, avg(case when split = 'train' then p end) as t, avg(case when split = 'val' then p end) as v from {scored} group by 1),
    n as (select max(case when step = 9 then t end) as t, max(case when step = 9 then v end) as v, max(case when step = 5 then v end) as m from c)
    select round(t - v, 6) as final_gap, v - m > 0.01 as improving, case when v < 0.7 and not v - m > 0.01 then 'high bias' when t - v > 0.08 then 'high variance'
           when v - m > 0.01 then 'benefits from more data' else 'converged' end as diagnosis from n""").replace("l_orderkey % 10 as step", "l_partkey % 10 as step"))
def m18_diagnosis(spark, sf):
    curve = table(spark, sf, "scored").groupBy((F.col("l_partkey") % 10).alias("step")).agg(
        F.avg(F.when(F.col("split") == "train", F.col("p"))).alias("train_mean"), F.avg(F.when(F.col("split") == "val", F.col("p"))).alias("val_mean"))
    return rounded(choose.learning_diagnosis(curve), 6, "final_gap")


@query("w2_best_so_far", "select event_id as trial, value, max(value) over (order by event_id) as best from events")
def w2(spark, sf):
    return choose.best_so_far(table(spark, sf, "events").select(F.col("event_id").alias("trial"), "value"))


@query("m19_trial_history", "select event_id as trial, value, max(value) over (order by event_id) as best from events")
def m19(spark, sf):
    trials = table(spark, sf, "events").select(F.col("event_id").alias("trial"), "value")
    return choose.best_so_far(trials, ranges=3)


@query("m3_dummy_model", with_tables("""
    select doc_id, (select toxic from {doc_ft} group by 1 order by count(*) desc, 1 limit 1) as pred, cast(0 as double) as p from {doc_ft}"""))
def m3(spark, sf):
    from ..operators.models import DummyModel
    df = table(spark, sf, "doc_ft")
    return DummyModel.fit(df, "toxic").transform(df).select("doc_id", "pred", "p")


@query("m3_dummy_regressor", "select distinct round(avg(l_extendedprice) over (), 4) as pred from lineitem")
def m3_mean(spark, sf):
    from ..operators.models import DummyModel
    df = table(spark, sf, "lineitem")
    return rounded(DummyModel.fit(df, "l_extendedprice", regression=True).transform(df).select("pred").distinct(), 4, "pred")
