"""Ensembles, acceptance checks, batch scoring and drift on closed-form scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accept, choose, drift, ensemble, metrics, scoring
from ..operators.aggregates import quantile_values
from .explore_queries import rounded
from .fixtures import table, with_tables
from .metric_queries import LINE, LINE_KEY, ranking_sql
from .quality_queries import union
from .registry import query


# ensembles ------------------------------------------------------------------

@query("en1_diversity", with_tables("""
    select 'p' as model_a, 'p2' as model_b, round(r, 6) as r, case when r > 0.95 then 'REDUNDANT' when r > 0.85 then 'MODERATE' else 'DIVERSE' end as verdict
    from (select corr(p, p2) as r from {scored})
    union all select 'p', 'p3', round(r, 6), case when r > 0.95 then 'REDUNDANT' when r > 0.85 then 'MODERATE' else 'DIVERSE' end from (select corr(p, p * 0.9 + p2 * 0.1) as r from {scored})
    union all select 'p2', 'p3', round(r, 6), case when r > 0.95 then 'REDUNDANT' when r > 0.85 then 'MODERATE' else 'DIVERSE' end from (select corr(p2, p * 0.9 + p2 * 0.1) as r from {scored})"""))
def en1(spark, sf):
    df = table(spark, sf, "scored").withColumn("p3", F.col("p") * 0.9 + F.col("p2") * 0.1)
    return rounded(ensemble.diversity(df, ["p", "p2", "p3"]), 6, "r")


@query("j6_model_pairs", with_tables("select 'y' as model_a, 'p' as model_b, round(corr(y, p), 6) as r from {scored} union all select 'y', 'p2', round(corr(y, p2), 6) from {scored} union all select 'p', 'p2', round(corr(p, p2), 6) from {scored}"))
def j6(spark, sf):
    return rounded(ensemble.diversity(table(spark, sf, "scored"), ["y", "p", "p2"]), 6, "r").select("model_a", "model_b", "r")


VOTES = "cast(p >= 0.5 as int) as a, cast(p2 >= 0.5 as int) as b, cast(p + p2 >= 1.1e0 as int) as c, cast(l_linenumber % 3 as int) as d"


@query("en2_hard_vote", with_tables(f"""
    select {LINE}, cast(a + b + c >= 2 as int) as vote, case when n1 > n0 and n1 >= n2 then 1 when n2 > n0 and n2 > n1 then 2 else 0 end as vote4
    from (select *, cast(a = 0 as int) + cast(b = 0 as int) + cast(c = 0 as int) + cast(d = 0 as int) as n0,
          cast(a = 1 as int) + cast(b = 1 as int) + cast(c = 1 as int) + cast(d = 1 as int) as n1, cast(d = 2 as int) as n2
          from (select {LINE}, {VOTES} from {{scored}}))"""))
def en2(spark, sf):
    df = table(spark, sf, "scored").withColumns({
        "a": (F.col("p") >= 0.5).cast("int"), "b": (F.col("p2") >= 0.5).cast("int"), "c": (F.col("p") + F.col("p2") >= 1.1).cast("int"),
        "d": (F.col("l_linenumber") % 3).cast("int")})
    return df.select(*LINE_KEY, ensemble.hard_vote(["a", "b", "c"]).alias("vote"), ensemble.hard_vote(["a", "b", "c", "d"]).alias("vote4"))


@query("en3_soft_vote", with_tables(f"select {LINE}, round((p + p2) / 2, 6) as p, cast((p + p2) / 2 > 1 - (p + p2) / 2 as int) as class from {{scored}}"))
def en3(spark, sf):
    df = table(spark, sf, "scored").withColumns({"v1": F.array(1 - F.col("p"), "p"), "v2": F.array(1 - F.col("p2"), "p2")})
    return df.select(*LINE_KEY, F.round(ensemble.soft_vote(["p", "p2"]), 6).alias("p"), ensemble.soft_vote_class(["v1", "v2"]).alias("class"))


AUCS = f"a1 as ({ranking_sql('{scored}')}), a2 as ({ranking_sql('{scored}', p='p2')}), w as (select 1 / (1 - a1.roc_auc) as w1, 1 / (1 - a2.roc_auc) as w2 from a1, a2)"


@query("en4_weighted_vote", with_tables(f"with {AUCS} select {LINE}, round((p * w1 + p2 * w2) / (w1 + w2), 6) as p from {{scored}}, w"))
def en4(spark, sf):
    df = table(spark, sf, "scored")
    weights = ensemble.auc_weights(df, ["p", "p2"])
    return df.select(*LINE_KEY, F.round(ensemble.weighted_mean(weights), 6).alias("p"))


RMSES = "w as (select 1 / sqrt(avg((pred - y) * (pred - y))) as w1, 1 / sqrt(avg((pred2 - y) * (pred2 - y))) as w2 from {line_pred})"


@query("en5_weighted_regression", with_tables(f"with {RMSES} select {LINE}, round((pred * w1 + pred2 * w2) / (w1 + w2), 4) as pred from {{line_pred}}, w"))
def en5(spark, sf):
    df = table(spark, sf, "line_pred")
    weights = ensemble.rmse_weights(df, ["pred", "pred2"])
    return df.select(*LINE_KEY, F.round(ensemble.weighted_mean(weights), 4).alias("pred"))


@query("en5_weight_table", with_tables(f"with {RMSES} select 'pred' as model, round(1 / w1, 4) as rmse, round(w1 / (w1 + w2), 6) as weight from w union all select 'pred2', round(1 / w2, 4), round(w2 / (w1 + w2), 6) from w"))
def en5_weights(spark, sf):
    return rounded(rounded(ensemble.weight_table(table(spark, sf, "line_pred"), "y", ["pred", "pred2"]), 4, "rmse"), 6, "weight")


def results(spark, sf):
    df = table(spark, sf, "scored")
    weights = ensemble.auc_weights(df, ["p", "p2"])
    long = df.select("y", F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), F.lit(k).alias("kind"), s.alias("p")) for n, k, s in (
            ("A", "individual", F.col("p")), ("B", "individual", F.col("p2")), ("Soft", "ensemble", ensemble.soft_vote(["p", "p2"])),
            ("Weighted", "ensemble", ensemble.weighted_mean(weights)))])).alias("m")).select("y", "m.*")
    return metrics.roc_auc(long, by=["model", "kind"]).withColumnRenamed("roc_auc", "score")


RESULTS = f"""with {AUCS}, l as (select y, 'A' as model, 'individual' as kind, p from {{scored}} union all select y, 'B', 'individual', p2 from {{scored}}
    union all select y, 'Soft', 'ensemble', (p + p2) / 2 from {{scored}} union all select y, 'Weighted', 'ensemble', (p * w1 + p2 * w2) / (w1 + w2) from {{scored}}, w),
    r as ({ranking_sql('l', 'model, kind')})"""


@query("en10_ensemble_table", with_tables(f"""
    {RESULTS} select model, kind, round(roc_auc, 6) as score, round(roc_auc - (select max(roc_auc) from r where kind = 'individual'), 6) as gain,
    row_number() over (order by roc_auc desc, model) as rank from r"""))
def en10(spark, sf):
    return rounded(ensemble.ensemble_table(results(spark, sf)), 6, "score", "gain")


@query("en8_choose_final", with_tables(f"""
    {RESULTS}, b as (select * from r order by roc_auc desc, model),
    i as (select * from b where kind = 'individual' limit 1), e as (select * from b where kind = 'ensemble' limit 1)
    select case when e.roc_auc - i.roc_auc > 0.005 then e.model else i.model end as model, round(case when e.roc_auc - i.roc_auc > 0.005 then e.roc_auc else i.roc_auc end, 6) as score,
           case when e.roc_auc - i.roc_auc > 0.005 then 'ensemble' else 'individual' end as kind, round(e.roc_auc - i.roc_auc, 6) as gain from i, e"""))
def en8(spark, sf):
    return rounded(ensemble.choose_final(results(spark, sf)), 6, "score", "gain")


# acceptance -----------------------------------------------------------------

@query("u1_smoke_cases", with_tables("""
    select case_type, verdict, count(*) as n from (select case_type, case case_type when 'OBVIOUS_POSITIVE' then case when score >= 0.6e0 then 'PASS' else 'FAIL' end
      when 'OBVIOUS_NEGATIVE' then case when score <= 0.4e0 then 'PASS' else 'FAIL' end else 'INFO' end as verdict from {cases}) group by 1, 2"""))
def u1(spark, sf):
    return accept.smoke_test(table(spark, sf, "cases")).groupBy("case_type", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("u1_smoke_overall", with_tables("""
    select count(*) as cases, count(*) filter (where bad) as failures, case when bool_or(bad) then 'FAIL' else 'PASS' end as verdict from (
      select (case_type = 'OBVIOUS_POSITIVE' and score < 0.6e0) or (case_type = 'OBVIOUS_NEGATIVE' and score > 0.4e0) as bad from {cases})"""))
def u1_overall(spark, sf):
    return accept.smoke_overall(accept.smoke_test(table(spark, sf, "cases")))


@query("u2_extreme_rows", with_tables(f"""
    with h as (select p from {{scored}} order by l_extendedprice - l_quantity desc, {LINE} limit 5), l as (select p from {{scored}} order by l_extendedprice - l_quantity, {LINE} limit 5)
    select a as high_right, b as low_right, case when a >= 4 and b >= 4 then 'PASS' else 'FAIL' end as verdict
    from (select (select count(*) from h where p > 0.5) as a, (select count(*) from l where p < 0.5) as b)"""))
def u2(spark, sf):
    return accept.extreme_row_smoke(table(spark, sf, "scored"), F.col("l_extendedprice") - F.col("l_quantity"), LINE_KEY)


@query("u4_range_check", with_tables("""
    select round(min(p), 6) as min_p, round(max(p), 6) as max_p, round(avg(cast(p < 0.01 as int)) * 100, 6) as pct_low, round(avg(cast(p > 0.99 as int)) * 100, 6) as pct_high,
           case when min(p) >= 0 and max(p) <= 1 then 'PASS' else 'FAIL' end as verdict from {scored}"""))
def u4(spark, sf):
    return rounded(accept.range_check(table(spark, sf, "scored")), 6, "min_p", "max_p", "pct_low", "pct_high")


@query("u5_prediction_audit", with_tables("""
    select round(m, 6) as mean_p, round(s, 6) as std_p, round(e, 6) as near_extremes, round(a, 6) as actual_rate, round(c, 6) as called_rate, round(c / a, 6) as ratio,
           case when e > 0.9 or c / a > 2 or c / a < 0.5 then 'WARN' else 'PASS' end as verdict
    from (select avg(p) as m, stddev_pop(p) as s, avg(cast(p < 0.05 or p > 0.95 as int)) as e, avg(y) as a, avg(cast(p >= 0.5 as int)) as c from {scored})"""))
def u5(spark, sf):
    return rounded(accept.prediction_audit(table(spark, sf, "scored")), 6, "mean_p", "std_p", "near_extremes", "actual_rate", "called_rate", "ratio")


def direction_sql(feature, sign):
    return f"""select '{feature}' as feature, round(h, 6) as mean_high, round(l, 6) as mean_low, (h - l) * {sign} > 0 as correct from (
      select avg(case when {feature} > q3 then p end) as h, avg(case when {feature} < q1 then p end) as l
      from {{scored}}, (select quantile_cont({feature}, 0.25) as q1, quantile_cont({feature}, 0.75) as q3 from {{scored}}))"""


@query("u6_direction_check", with_tables(union([direction_sql("l_partkey", 1), direction_sql("l_quantity", -1)])))
def u6(spark, sf):
    return rounded(accept.direction_check(table(spark, sf, "scored"), {"l_partkey": 1, "l_quantity": -1}), 6, "mean_high", "mean_low")


SEGMENTS = "g as (select 'l_linestatus' as segment, l_linestatus as value, y, p, pred from {decided} union all select 'l_linenumber', cast(l_linenumber as string), y, p, pred from {decided})"
F1W = """select {k} sum(f1 * support) / sum(support) as f1 from (select {k} class, coalesce(2 * tp / nullif(support + called, 0), 0) as f1, support from (
    select {k} class, count(*) filter (where side = 0 and y = pred) as tp, count(*) filter (where side = 0) as support, count(*) filter (where side = 1) as called
    from (select {k} y as class, y, pred, 0 as side from {t} union all select {k} pred, y, pred, 1 from {t}) group by {k} class)) {g}"""


@query("u7_subgroup_fairness", with_tables(f"""
    with {SEGMENTS}, a as ({ranking_sql('g', 'segment, value')}), f as ({F1W.format(k='segment, value,', t='g', g='group by segment, value')}),
    o as ({F1W.format(k='', t='{decided}', g='')}), s as (select segment, value, count(*) as n, avg(y) as t, avg(pred) as c from g group by 1, 2)
    select segment, value, n, round(t, 6) as true_rate, round(c, 6) as called_rate, round(roc_auc, 6) as roc_auc, round(f.f1, 6) as f1,
           round((f.f1 - o.f1) / o.f1 * 100, 6) as delta_pct, case when (f.f1 - o.f1) / o.f1 * 100 < -10 then 'FLAGGED' else 'OK' end as verdict
    from s join f using (segment, value) join a using (segment, value), o where n >= 30"""))
def u7(spark, sf):
    found = accept.subgroup_fairness(table(spark, sf, "scored"), ["l_linestatus", "l_linenumber"])
    return rounded(found, 6, "true_rate", "called_rate", "roc_auc", "f1", "delta_pct")


@query("u8_top_drivers", """
    select * from (select 'l_quantity' as feature, round(avg(abs(0.04e0 * (l_quantity - m))), 6) as mean_abs_contribution from lineitem, (select avg(l_quantity) as m from lineitem)
    union all select 'l_tax', round(avg(abs(12 * (l_tax - m))), 6) from lineitem, (select avg(l_tax) as m from lineitem)
    union all select 'l_discount', round(avg(abs(9 * (l_discount - m))), 6) from lineitem, (select avg(l_discount) as m from lineitem)
    union all select 'l_linenumber', round(avg(abs(0.25 * (l_linenumber - m))), 6) from lineitem, (select avg(l_linenumber) as m from lineitem)) order by 2 desc limit 3""")
def u8(spark, sf):
    from .metric_queries import WEIGHTS
    return rounded(scoring.attribution_global(table(spark, sf, "lineitem"), WEIGHTS, 3), 6, "mean_abs_contribution")


ORDER = "case verdict when 'FAIL' then 0 when 'WARN' then 1 when 'MANUAL_REVIEW_REQUIRED' then 2 when 'PASS' then 3 else 4 end"


@query("u10_uat_report", with_tables(f"""
    select ['FAIL', 'WARN', 'MANUAL_REVIEW_REQUIRED', 'PASS'][least(min({ORDER}), 3) + 1] as overall, count(*) filter (where verdict = 'FAIL') as fail,
      count(*) filter (where verdict = 'WARN') as warn, count(*) filter (where verdict = 'MANUAL_REVIEW_REQUIRED') as manual_review_required,
      count(*) filter (where verdict = 'PASS') as pass, count(*) filter (where verdict = 'SKIP') as skip from {{checks}}"""))
def u10(spark, sf):
    return accept.uat_report(table(spark, sf, "checks"))


# scoring --------------------------------------------------------------------

SCORE_WEIGHTS = {"l_quantity": 0.03, "l_discount": -4.0, "l_tax": 6.0}
Z = "1 / (1 + exp(-(0.03e0 * l_quantity + (-4.0e0) * l_discount + 6.0e0 * l_tax + (-0.9e0))))"


@query("d1_score_table", f"""
    select {LINE}, round(s, 4) as probability, cast(s >= 0.5 as int) as prediction, case when s > 0.7 then 'HIGH' when s > 0.4 then 'MEDIUM' else 'LOW' end as risk_tier, 'v1' as model_version,
           list_sort([{{'o': -abs(0.03e0 * l_quantity), 'f': 'l_quantity'}}, {{'o': -abs(-4.0e0 * l_discount), 'f': 'l_discount'}}, {{'o': -abs(6.0e0 * l_tax), 'f': 'l_tax'}}])[1].f as first_reason
    from (select *, {Z} as s from lineitem)""")
def d1(spark, sf):
    p = scoring.linear_probability(SCORE_WEIGHTS, -0.9)
    out = scoring.score_table(table(spark, sf, "lineitem"), p, SCORE_WEIGHTS)
    return out.select(*LINE_KEY, "probability", "prediction", "risk_tier", "model_version", F.col("top_reasons")[0]["feature"].alias("first_reason"))


@query("d1_batch_probability", f"""
    select {LINE}, round({Z}, 4) as probability, cast({Z} >= 0.5 as int) as prediction from lineitem""")
def d1_batch(spark, sf):
    p = scoring.linear_probability(SCORE_WEIGHTS, -0.9)
    rows = table(spark, sf, "lineitem").select(*LINE_KEY, p.alias("p"))
    return rows.select(*LINE_KEY, F.round("p", 4).alias("probability"), (F.col("p") >= 0.5).cast("int").alias("prediction"))


# drift ----------------------------------------------------------------------

@query("d5_drift", with_tables(union([
    f"""select '{f}' as feature, round(tm, 4) as train_mean, round(lm, 4) as live_mean, round(abs(lm - tm) / sd, 4) as delta_sigma, abs(lm - tm) / sd > {s} as drifted from (
      select round(avg({f}) filter (where ts < date '2024-01-16'), 6) as tm, round(stddev_pop({f}) filter (where ts < date '2024-01-16'), 6) as sd,
             avg({f}) filter (where ts >= date '2024-01-16') as lm from {{events_drift}})""" for f, s in (("value", 2), ("shifted", 2), ("user_id", 2))])))
def d5(spark, sf):
    df = table(spark, sf, "events_drift")
    names = ["value", "shifted", "user_id"]
    snapshot = drift.fit_snapshot(df.filter("ts < date '2024-01-16'"), names)
    found = drift.detect_drift(df.filter("ts >= date '2024-01-16'"), snapshot, names)
    return rounded(found, 4, "train_mean", "live_mean", "delta_sigma")


@query("j7_drift_alert_features", with_tables("""
    select 'shifted' as feature, abs(lm - tm) / sd > 1 as drifted from (select avg(shifted) filter (where ts < date '2024-01-16') as tm,
      stddev_pop(shifted) filter (where ts < date '2024-01-16') as sd, avg(shifted) filter (where ts >= date '2024-01-16') as lm from {events_drift})"""))
def j7(spark, sf):
    df = table(spark, sf, "events_drift")
    snapshot = drift.fit_snapshot(df.filter("ts < date '2024-01-16'"), ["value", "shifted"])
    live = df.filter("ts >= date '2024-01-16'")
    return drift.detect_drift(live, snapshot, ["value", "shifted"], sigma=1.0, alert_on=["shifted"]).select("feature", "drifted")


EVENT_P = "least(value / 200e0, 1)"


@query("d6_daily_report", f"""
    select cast(day as string) as day, count(*) as predictions, round(avg(cast(p >= 0.3e0 as int)), 6) as positive_rate, round(avg(p), 6) as average_score,
           round((avg(cast(p >= 0.3e0 as int)) - 0.3e0) / 0.3e0 * 100, 6) as change_pct, abs((avg(cast(p >= 0.3e0 as int)) - 0.3e0) / 0.3e0 * 100) > 10 as flagged
    from (select cast(ts as date) as day, {EVENT_P} as p from events) group by day""")
def d6(spark, sf):
    df = table(spark, sf, "events").withColumn("p", F.least(F.col("value") / 200, F.lit(1.0)))
    found = drift.daily_scoring_report(df, "ts", "p", 0.3, 0.3).withColumn("day", F.col("day").cast("string"))
    return rounded(found, 6, "positive_rate", "average_score", "change_pct")


@query("d7_retrain_signal", with_tables("""
    select feature, period, case when 0.9e0 - metric > 0.08e0 then 'RETRAIN' when drifted and coalesce(lag(drifted) over (partition by feature order by period), false) then 'REVIEW' else 'OK' end as signal
    from {periods}"""))
def d7(spark, sf):
    return drift.retrain_signal(table(spark, sf, "periods"), 0.9, 0.08).select("feature", "period", "signal")
