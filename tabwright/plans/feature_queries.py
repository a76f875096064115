"""Feature functions, joins, sorting and set operations as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.text import (
    CLASSIFICATION_WORDS, DOMAIN_WORDS, REGRESSION_WORDS, SEMI_SUPERVISED_WORDS, UNSUPERVISED_WORDS, classify_goal, infer_domain,
)
from ..operators import choose, explore, features, joins, scoring
from .fixtures import table, with_tables
from .registry import query

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


# projections and filters ----------------------------------------------------

@query("p1_select_features", f"select {LINE}, l_quantity, l_discount from lineitem")
def p1(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount")


@query("p2_columns_by_type", "select o_orderkey, o_custkey, o_totalprice from orders")
def p2(spark, sf):
    df = table(spark, sf, "orders")
    return df.select(*features.numeric_features(df))


@query("p3_drop_columns", "select o_orderkey, o_totalprice, o_orderstatus from orders")
def p3(spark, sf):
    return table(spark, sf, "orders").drop("o_custkey", "o_orderdate", "o_orderpriority")


@query("p4_class_filter", with_tables("select doc_id, n_chars from {doc_ft} where toxic = 1"))
def p4(spark, sf):
    return table(spark, sf, "doc_ft").filter("toxic = 1").select("doc_id", "n_chars")


@query("p5_representatives", with_tables(f"""
    select band, {LINE}, round(p, 6) as p from (
      select 'HIGH' as band, *, row_number() over (order by p desc, {LINE}) as r from {{scored}} where y = 1
      union all select 'MEDIUM', *, row_number() over (order by abs(p - 0.55e0), {LINE}) from {{scored}} where p > 0.4e0 and p < 0.7e0
      union all select 'LOW', *, row_number() over (order by p, {LINE}) from {{scored}} where y = 0) where r = 1"""))
def p5(spark, sf):
    found = scoring.representatives(table(spark, sf, "scored"), LINE_KEY)
    return found.withColumn("p", F.round("p", 6))


@query("p6_top_category_rows", """
    select c_custkey, c_nationkey from customer where c_nationkey in (
      select c_nationkey from customer group by 1 order by count(*) desc, c_nationkey limit 5)""")
def p6(spark, sf):
    return joins.semi_top(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 5)


# ratios and products --------------------------------------------------------

def lines(spark, sf):
    return table(spark, sf, "lineitem")


@query("f1_safe_ratio", f"""
    select {LINE}, round(case when l_discount <> 0 then l_extendedprice / (l_discount + 1e-9) else 0 end, 2) as ratio from lineitem""")
def f1(spark, sf):
    return lines(spark, sf).select(*LINE_KEY, F.round(S.safe_ratio("l_extendedprice", "l_discount"), 2).alias("ratio"))


@query("f2_null_ratio", with_tables("""
    select c_custkey, round(cast(trans_amt as double) / nullif(trans_ct, 0), 6) as amount_per_order from {cust_ft}"""))
def f2(spark, sf):
    return table(spark, sf, "cust_ft").select(
        "c_custkey", F.round(S.null_ratio("trans_amt", "trans_ct"), 6).alias("amount_per_order"))


@query("f3_activity_features", f"""
    select {LINE}, round(case when l_quantity <> 0 then l_extendedprice / (l_quantity + 1e-9) else 0 end, 4) as avg_transaction_value,
           round(l_discount * l_tax, 6) as engagement_velocity, round(l_quantity * l_linenumber, 6) as re_engagement_signal,
           round(l_quantity / (l_linenumber + 1e-9), 4) as transaction_intensity, round(l_tax / (l_linenumber + 1e-9), 6) as complaint_rate
    from lineitem""")
def f3(spark, sf):
    out = features.activity_features(lines(spark, sf), {
        "amount": "l_extendedprice", "count": "l_quantity", "amount_change": "l_discount", "count_change": "l_tax",
        "inactive": "l_quantity", "contacts": "l_linenumber", "months": "l_linenumber", "complaints": "l_tax",
        "relationships": "l_linenumber"})
    digits = {"avg_transaction_value": 4, "engagement_velocity": 6, "re_engagement_signal": 6, "transaction_intensity": 4, "complaint_rate": 6}
    return out.select(*LINE_KEY, *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("f4_interactions", f"""
    select {LINE}, round(l_quantity * l_discount, 6) as l_quantity_x_l_discount,
           round(l_extendedprice / nullif(l_tax, 0), 2) as l_extendedprice_over_l_tax,
           round(l_discount + l_tax, 6) as l_discount_plus_l_tax, round(l_extendedprice - l_quantity, 4) as l_extendedprice_minus_l_quantity
    from lineitem""")
def f4(spark, sf):
    out = features.interactions(lines(spark, sf), [
        ("l_quantity", "l_discount", "multiply"), ("l_extendedprice", "l_tax", "ratio"), ("l_discount", "l_tax", "add"),
        ("l_extendedprice", "l_quantity", "subtract"), ("l_quantity", "l_tax", "power"), ("l_quantity", "nowhere", "add")])
    return out.select(
        *LINE_KEY, F.round("l_quantity_x_l_discount", 6).alias("l_quantity_x_l_discount"),
        F.round("l_extendedprice_over_l_tax", 2).alias("l_extendedprice_over_l_tax"),
        F.round("l_discount_plus_l_tax", 6).alias("l_discount_plus_l_tax"),
        F.round("l_extendedprice_minus_l_quantity", 4).alias("l_extendedprice_minus_l_quantity"))


@query("f5_row_cv", f"""
    select {LINE}, round(list_stddev_samp(v) / nullif(list_avg(v), 0), 6) as cv from (
      select *, [l_quantity, l_discount, l_tax, cast(l_linenumber as double)] as v from lineitem)""")
def f5(spark, sf):
    return lines(spark, sf).select(*LINE_KEY, F.round(S.row_cv(["l_quantity", "l_discount", "l_tax", "l_linenumber"]), 6).alias("cv"))


# dates and bins -------------------------------------------------------------

@query("f6_days_since", "select o_orderkey, date_diff('day', cast(o_orderdate as date), date '2001-09-01') as days from orders")
def f6(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.days_since("o_orderdate", "2001-09-01").alias("days"))


@query("f7_utilisation", with_tables("""
    select c_custkey, case when trans_amt <> 0 then round(greatest(least(c_acctbal / nullif(cast(trans_amt as double), 0), 1), 0), 6) end as used,
           case when trans_amt <> 0 and greatest(least(c_acctbal / nullif(cast(trans_amt as double), 0), 1), 0) > 0.8 then 1 else 0 end as high
    from {cust_ft}"""))
def f7(spark, sf):
    df = table(spark, sf, "cust_ft")
    used = S.utilisation("c_acctbal", "trans_amt")
    return df.select("c_custkey", F.round(used, 6).alias("used"), S.as_flag(used > 0.80).alias("high"))


MONTHS = "round(date_diff('day', cast(o_orderdate as date), date '2001-09-01') / 30.44e0, 1)"


@query("f8_months_since", f"select o_orderkey, {MONTHS} as months from orders")
def f8(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.months_since("o_orderdate", "2001-09-01").alias("months"))


@query("f9_tenure_bins", f"""
    select o_orderkey, case when m <= 0 then null when m <= 6 then '0-6m' when m <= 12 then '6-12m' when m <= 24 then '1-2yr'
                            when m <= 60 then '2-5yr' else '5yr+' end as bucket
    from (select o_orderkey, {MONTHS} as m from orders)""")
def f9(spark, sf):
    months = S.months_since("o_orderdate", "2001-09-01")
    return table(spark, sf, "orders").select("o_orderkey", S.cut(months, S.TENURE_EDGES, S.TENURE_LABELS).alias("bucket"))


@query("f10_bmi", """
    select p_partkey, round(b, 6) as bmi, case when b <= 0 then null when b <= 18.5 then 'Underweight' when b <= 25 then 'Normal'
      when b <= 30 then 'Overweight' else 'Obese' end as category
    from (select p_partkey, p_retailprice / nullif(pow(p_size, 2), 0) as b from part)""")
def f10(spark, sf):
    out = features.health_features(table(spark, sf, "part"), {"weight_kg_col": "p_retailprice", "height_m_col": "p_size"})
    return out.select("p_partkey", F.round("bmi", 6).alias("bmi"), F.col("bmi_category").alias("category"))


@query("f11_age_bands", """
    select p_partkey, case when p_size <= 0 then null when p_size <= 17 then '0-17' when p_size <= 34 then '18-34'
      when p_size <= 49 then '35-49' when p_size <= 64 then '50-64' else '65+' end as band from part""")
def f11(spark, sf):
    out = features.health_features(table(spark, sf, "part"), {"age_col": "p_size"})
    return out.select("p_partkey", F.col("age_group").alias("band"))


@query("f12_row_sum", with_tables("select c_custkey, churned + cast(c_nationkey % 2 as int) + cast(trans_ct > 5 as int) as flags from {cust_ft}"))
def f12(spark, sf):
    df = table(spark, sf, "cust_ft").withColumns({
        "a": F.col("churned"), "b": F.col("c_nationkey") % 2, "c": S.as_flag(F.col("trans_ct") > 5)})
    return df.select("c_custkey", S.row_sum(["a", "b", "c"]).alias("flags"))


@query("f13_band_ratio", """
    select p_partkey, round(greatest(least((p_retailprice - 910) / (p_size * 2), 1), 0), 6) as position from part""")
def f13(spark, sf):
    df = table(spark, sf, "part").withColumns({"lo": F.lit(910.0), "hi": 910 + F.col("p_size") * 2})
    return df.select("p_partkey", F.round(S.band_ratio("p_retailprice", "lo", "hi"), 6).alias("position"))


PARTS = """cast(year({c}) as int) as {c}_year, cast(month({c}) as int) as {c}_month, cast(day({c}) as int) as {c}_day,
    cast(isodow({c}) - 1 as int) as {c}_day_of_week, cast(isodow({c}) >= 6 as int) as {c}_is_weekend, cast(quarter({c}) as int) as {c}_quarter"""
CIRCLE = "round(sin(2 * pi() * {v} / {n}), 6) as {c}_{p}_sin, round(cos(2 * pi() * {v} / {n}), 6) as {c}_{p}_cos"


@query("f14_date_parts", f"""
    select event_id, {PARTS.format(c='ts')}, cast(hour(ts) as int) as ts_hour from events""")
def f14(spark, sf):
    df = table(spark, sf, "events")
    return df.select("event_id", *[c.alias(n) for n, c in S.date_parts("ts", with_hour=True).items()])


@query("f14_date_features_without_hour", f"""
    select o_orderkey, {PARTS.format(c='o_orderdate')}, {CIRCLE.format(v='month(o_orderdate)', n=12, c='o_orderdate', p='month')},
           {CIRCLE.format(v='(isodow(o_orderdate) - 1)', n=7, c='o_orderdate', p='dow')} from orders""")
def f14_orders(spark, sf):
    out = features.date_features(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"]).drop("o_orderdate")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith(("_sin", "_cos"))})


@query("f15_cyclic", f"""
    select event_id, {CIRCLE.format(v='month(ts)', n=12, c='ts', p='month')}, {CIRCLE.format(v='(isodow(ts) - 1)', n=7, c='ts', p='dow')},
           {CIRCLE.format(v='hour(ts)', n=24, c='ts', p='hour')} from events""")
def f15(spark, sf):
    out = features.date_features(table(spark, sf, "events").select("event_id", "ts"), ["ts"])
    names = [c for c in out.columns if c.endswith(("_sin", "_cos"))]
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in names])


# recency, frequency, value --------------------------------------------------

RFM_BASE = """
    select o_custkey, date_diff('day', cast(max(o_orderdate) as date), cast((select max(o_orderdate) from orders) as date)) as recency,
           count(*) as purchase_frequency, sum(o_totalprice) / count(*) as avg_order_value,
           sum(o_totalprice) as total_revenue
    from orders group by o_custkey"""
BELOW = "(select count(*) from (select distinct e from (select unnest(quantile_cont({c}, [0.2, 0.4, 0.6, 0.8])) as e from base)) where {c} > e)"
RFM_SCORES = f"""
    base as ({RFM_BASE}),
    edges as (select quantile_cont(recency, [0.2, 0.4, 0.6, 0.8]) as r, quantile_cont(purchase_frequency, [0.2, 0.4, 0.6, 0.8]) as f,
                     quantile_cont(avg_order_value, [0.2, 0.4, 0.6, 0.8]) as m from base),
    ranked as (select base.*, 1 + len(list_filter(list_distinct(edges.r), lambda x : recency > x)) as rr,
                 1 + len(list_filter(list_distinct(edges.f), lambda x : purchase_frequency > x)) as ff,
                 1 + len(list_filter(list_distinct(edges.m), lambda x : avg_order_value > x)) as mm from base, edges)"""


@query("a7_rfm_base", f"""
    select o_custkey, recency, purchase_frequency, round(avg_order_value, 8) as avg_order_value, round(total_revenue, 2) as total_revenue
    from ({RFM_BASE})""")
def a7(spark, sf):
    base = features.rfm_base(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderdate")
    return base.withColumns({"avg_order_value": F.round("avg_order_value", 8), "total_revenue": F.round("total_revenue", 2)})


@query("f16_rfm_scores", f"""
    with {RFM_SCORES}
    select o_custkey, recency, purchase_frequency, round(avg_order_value, 8) as avg_order_value, round(total_revenue, 2) as total_revenue,
           round(purchase_frequency * avg_order_value, 2) as customer_lifetime_value, 6 - rr as rfm_r, ff as rfm_f, mm as rfm_m,
           6 - rr + ff + mm as rfm_score from ranked""")
def f16(spark, sf):
    out = features.rfm(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderdate")
    return out.withColumns({"avg_order_value": F.round("avg_order_value", 8), "total_revenue": F.round("total_revenue", 2),
                            "customer_lifetime_value": F.round("customer_lifetime_value", 2)})


@query("f16_rfm_plain_recency", f"with {RFM_SCORES} select o_custkey, rr as rfm_r, rr + ff + mm as rfm_score from ranked")
def f16_plain(spark, sf):
    out = features.rfm(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderdate", recency_inverted=False)
    return out.select("o_custkey", "rfm_r", "rfm_score")


@query("f17_lifetime_value", f"select o_custkey, round(purchase_frequency * avg_order_value, 2) as customer_lifetime_value from ({RFM_BASE})")
def f17(spark, sf):
    base = features.rfm_base(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderdate")
    return base.select("o_custkey", F.round(F.col("purchase_frequency") * F.col("avg_order_value"), 2).alias("customer_lifetime_value"))


@query("w1_quintiles", """
    with e as (select list_distinct(quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8])) as q from orders)
    select o_orderkey, 1 + len(list_filter(q, lambda x : o_totalprice > x)) as score from orders, e""")
def w1(spark, sf):
    df = table(spark, sf, "orders")
    return df.select("o_orderkey", features.qcut(df, "o_totalprice", 5).alias("score"))


@query("j1_left_enrich", f"""
    with {RFM_SCORES}
    select o_orderkey, recency, purchase_frequency, round(avg_order_value, 8) as avg_order_value,
           round(purchase_frequency * avg_order_value, 2) as customer_lifetime_value, 6 - rr + ff + mm as rfm_score
    from orders left join ranked using (o_custkey)""")
def j1(spark, sf):
    out = features.engineer(table(spark, sf, "orders"), "retail", {
        "customer_id_col": "o_custkey", "order_value_col": "o_totalprice", "order_date_col": "o_orderdate"})
    return out.select("o_orderkey", "recency", "purchase_frequency", F.round("avg_order_value", 8).alias("avg_order_value"),
                      F.round("customer_lifetime_value", 2).alias("customer_lifetime_value"), "rfm_score")


@query("j1_left_enrich_hot_keys", f"""
    select event_id, n, round(total, 2) as total from events left join (
      select user_id, count(*) as n, sum(value) as total from events group by 1) using (user_id)""")
def j1_hot(spark, sf):
    df = table(spark, sf, "events")
    per = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    out = joins.left_enrich(df.select("event_id", "user_id", "value"), per, "user_id", count_col="n", hot_share=0.005, salts=8)
    return out.select("event_id", "n", F.round("total", 2).alias("total"))


# recommendations ------------------------------------------------------------

@query("f18_log1p", f"select {LINE}, round(ln(1 + l_extendedprice), 6) as l_extendedprice_log1p from lineitem")
def f18(spark, sf):
    out = features.log1p_features(lines(spark, sf), ["l_extendedprice"])
    return out.select(*LINE_KEY, F.round("l_extendedprice_log1p", 6).alias("l_extendedprice_log1p"))


@query("f19_recommendations", with_tables("""
    with r as (select 'qty' as c, abs(corr(qty, y)) as r from {line_num} union all select 'price', abs(corr(price, y)) from {line_num}
      union all select 'net_price', abs(corr(net_price, y)) from {line_num} union all select 'discount', abs(corr(discount, y)) from {line_num}),
    top as (select c, row_number() over (order by r desc, c) as k from r)
    select 'ratio' as kind, 'price / net_price' as suggestion from {line_num} having corr(price, net_price) > 0.85
    union all select 'date parts', 'l_shipdate'
    union all select 'product', (select c from top where k = 1) || ' x ' || (select c from top where k = 2)"""))
def f19(spark, sf):
    return features.recommend_features(table(spark, sf, "line_num"), ["qty", "price", "net_price", "discount"], "y", ["l_shipdate"])


def has(words):
    return "regexp_matches(t, '" + "|".join(words) + "')"


@query("f20_infer_domain", f"""
    select doc_id, case {' '.join(f"when {has(w)} then '{d}'" for d, w in DOMAIN_WORDS.items())} end as domain
    from (select doc_id, lower(text) as t from documents)""")
def f20(spark, sf):
    return table(spark, sf, "documents").select("doc_id", infer_domain("text").alias("domain"))


@query("f21_classify_goal", f"""
    select doc_id, case when {has(SEMI_SUPERVISED_WORDS)} then 'SEMI-SUPERVISED' when {has(CLASSIFICATION_WORDS)} then 'SUPERVISED'
        when {has(UNSUPERVISED_WORDS)} then 'UNSUPERVISED' when {has(REGRESSION_WORDS)} then 'SUPERVISED' else 'AMBIGUOUS' end as problem_type,
      case when {has(SEMI_SUPERVISED_WORDS)} then null when {has(CLASSIFICATION_WORDS)} then 'Classification'
        when {has(UNSUPERVISED_WORDS)} then 'clustering/anomaly' when {has(REGRESSION_WORDS)} then 'Regression' end as subtype
    from (select doc_id, lower(text) as t from documents)""")
def f21(spark, sf):
    goals = table(spark, sf, "documents").select("doc_id", classify_goal("text").alias("goal"))
    return goals.select("doc_id", "goal.problem_type", "goal.subtype")


@query("f22_problem_type", with_tables("""
    select 'toxic' as target, case when count(distinct toxic) = 2 then 'binary_classification' end as problem_type, count(distinct toxic) as n_classes,
           false as ordinal_hint from {doc_ft}
    union all select 'label', case when count(distinct label) <= 20 and bool_and(label = floor(label)) then 'multiclass_classification' end,
           count(distinct label), false from embeddings
    union all select 'l_extendedprice', case when count(distinct l_extendedprice) > 20 then 'regression' end, null, false from lineitem
    union all select 'risk_score', case when count(distinct l_linenumber) <= 20 then 'ordinal_classification' end, count(distinct l_linenumber), true from lineitem
    union all select 'c_mktsegment', case when count(distinct c_mktsegment) <> 2 then 'multiclass_classification' end, count(distinct c_mktsegment), false from customer"""))
def f22(spark, sf):
    ranked = lines(spark, sf).withColumnRenamed("l_linenumber", "risk_score")
    parts = [
        choose.problem_type(table(spark, sf, "doc_ft"), "toxic"), choose.problem_type(table(spark, sf, "embeddings"), "label"),
        choose.problem_type(lines(spark, sf), "l_extendedprice"), choose.problem_type(ranked, "risk_score"),
        choose.problem_type(table(spark, sf, "customer"), "c_mktsegment")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TIER = "case when p > 0.7e0 then 'HIGH' when p > 0.4e0 then 'MEDIUM' else 'LOW' end"


@query("f23_risk_tier", with_tables(f"select {LINE}, {TIER} as tier from {{scored}}"))
def f23(spark, sf):
    return table(spark, sf, "scored").select(*LINE_KEY, S.risk_tier("p").alias("tier"))


@query("f24_tier_action", with_tables(f"""
    select tier, case tier {' '.join(f"when '{t}' then '{a}'" for t, a in S.TIER_ACTIONS.items())} end as action, count(*) as n
    from (select {TIER} as tier from {{scored}}) group by 1, 2"""))
def f24(spark, sf):
    tiers = table(spark, sf, "scored").select(S.risk_tier("p").alias("tier"))
    return tiers.withColumn("action", S.action_for("tier")).groupBy("tier", "action").agg(F.count(F.lit(1)).alias("n"))


@query("f25_decide", with_tables(f"select {LINE}, cast(p >= 0.35e0 as int) as called from {{scored}}"))
def f25(spark, sf):
    return table(spark, sf, "scored").select(*LINE_KEY, S.decide("p", 0.35).alias("called"))


@query("f_hr_features", f"""
    select o_orderkey, m as tenure_months, case when m <= 0 then null when m <= 6 then '0-6m' when m <= 12 then '6-12m' when m <= 24 then '1-2yr'
        when m <= 60 then '2-5yr' else '5yr+' end as tenure_bucket, m as months_since_promotion, round(m / nullif(m, 0), 6) as promotion_rate
    from (select o_orderkey, {MONTHS} as m from orders)""")
def f_hr(spark, sf):
    out = features.hr_features(table(spark, sf, "orders"), {
        "hire_date_col": "o_orderdate", "last_promotion_col": "o_orderdate", "reference_date": "2001-09-01"})
    return out.select("o_orderkey", "tenure_months", "tenure_bucket", "months_since_promotion", F.round("promotion_rate", 6).alias("promotion_rate"))


@query("f_financial_features", with_tables("""
    select c_custkey, round(trans_ct / nullif(c_nationkey, 0), 6) as transaction_velocity,
           date_diff('day', cast(last_order as date), date '2001-09-01') as days_since_last_complaint,
           case when trans_amt <> 0 then round(greatest(least(c_acctbal / nullif(cast(trans_amt as double), 0), 1), 0), 6) end as credit_utilization
    from {cust_ft}"""))
def f_financial(spark, sf):
    out = features.financial_features(table(spark, sf, "cust_ft"), {
        "transactions_30d": "trans_ct", "tenure_months": "c_nationkey", "last_complaint_date": "last_order",
        "reference_date": "2001-09-01", "current_balance": "c_acctbal", "credit_limit": "trans_amt"})
    return out.select("c_custkey", F.round("transaction_velocity", 6).alias("transaction_velocity"), "days_since_last_complaint",
                      F.round("credit_utilization", 6).alias("credit_utilization"))


@query("fs9_engineer")
def fs9(spark, sf):
    return features.engineer(table(spark, sf, "orders"), "retail", {
        "customer_id_col": "o_custkey", "order_value_col": "o_totalprice", "order_date_col": "o_orderdate"},
        dates=["o_orderdate"], wanted=[("avg_order_value", "purchase_frequency", "multiply")])


# joins ----------------------------------------------------------------------

@query("j2_lookup", "select c_custkey, c_name, n_name from customer left join nation on c_nationkey = n_nationkey")
def j2(spark, sf):
    dim = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.lookup(table(spark, sf, "customer"), dim, "c_nationkey").select("c_custkey", "c_name", "n_name")


@query("j4_align_by_key", with_tables(f"select {LINE}, a.y, l_returnflag from {{scored}} a join lineitem using ({LINE})"))
def j4(spark, sf):
    raw = lines(spark, sf).select(*LINE_KEY, "l_returnflag")
    return joins.by_key(table(spark, sf, "scored").select(*LINE_KEY, "y"), raw, LINE_KEY)


@query("j8_missing_columns", """
    select feature from (select distinct 'c_' || lower(c_mktsegment) as feature from customer
      union select 'c_acctbal' from customer) where feature not in ('c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment')""")
def j8(spark, sf):
    df = table(spark, sf, "customer")
    named = df.select(F.explode(F.array(F.concat(F.lit("c_"), F.lower("c_mktsegment")), F.lit("c_acctbal"))).alias("feature")).distinct()
    return joins.missing_columns(df, named)


@query("x4_column_sets", """
    with wanted as (select distinct 'c_' || lower(c_mktsegment) as feature from customer union select 'c_acctbal' union select 'c_custkey'),
    own as (select unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) as feature)
    select coalesce(w.feature, o.feature) as feature, case when o.feature is null then 'missing' when w.feature is null then 'extra' else 'both' end as place
    from wanted w full join own o on w.feature = o.feature""")
def x4_sets(spark, sf):
    df = table(spark, sf, "customer")
    named = df.select(F.explode(F.array(F.concat(F.lit("c_"), F.lower("c_mktsegment")), F.lit("c_acctbal"), F.lit("c_custkey"))).alias("feature"))
    return joins.column_sets(df, named)


# sorting, limits, sets ------------------------------------------------------

@query("o1_sorted_ranked", "select s_suppkey, s_acctbal, row_number() over (order by s_acctbal desc, s_suppkey) as rank from supplier")
def o1(spark, sf):
    from ..operators.prefix import row_numbers
    df = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return row_numbers(df, [F.desc("s_acctbal"), F.asc("s_suppkey")])


@query("o2_preview", "select * exclude (o_orderdate) from orders order by o_orderkey limit 5")
def o2(spark, sf):
    return table(spark, sf, "orders").drop("o_orderdate").orderBy("o_orderkey").limit(5)


@query("o3_top_k", with_tables("""
    select * from (select c_custkey, c_acctbal - trans_ct as risk from {cust_ft} order by 2 desc, 1 limit 5)
    union all select * from (select c_custkey, c_acctbal - trans_ct from {cust_ft} order by 2, 1 limit 5)"""))
def o3(spark, sf):
    df = table(spark, sf, "cust_ft").select("c_custkey", (F.col("c_acctbal") - F.col("trans_ct")).alias("risk"))
    return df.orderBy(F.desc("risk"), "c_custkey").limit(5).unionByName(df.orderBy("risk", "c_custkey").limit(5))


@query("o4_best_row", with_tables(f"select {LINE}, round(p, 6) as p from {{scored}} order by {{scored}}.p desc, {LINE} limit 1"))
def o4(spark, sf):
    df = table(spark, sf, "scored").select(*LINE_KEY, "p")
    return scoring.best_row(df, "p", LINE_KEY).withColumn("p", F.round("p", 6))


@query("o5_hash_sample")
def o5(spark, sf):
    return explore.hash_sample(lines(spark, sf), LINE_KEY, 5000)


@query("o5_portable_sample", """
    select o_orderkey, o_totalprice from orders order by ((o_orderkey % 2147483648 + 42) * 2654435761) % 4294967296, o_orderkey limit 500""")
def o5_portable(spark, sf):
    return table(spark, sf, "orders").orderBy(S.portable_hash("o_orderkey"), "o_orderkey").limit(500).select("o_orderkey", "o_totalprice")


@query("x1_union_splits", with_tables(f"select {LINE}, split from {{scored}} where split in ('train', 'val')"))
def x1(spark, sf):
    return table(spark, sf, "scored").filter(F.col("split").isin("train", "val")).select(*LINE_KEY, "split")


@query("x3_add_columns", with_tables(f"select {LINE}, round(p, 6) as m1, round(p2, 6) as m2, round((p + p2) / 2, 6) as m3 from {{scored}}"))
def x3(spark, sf):
    made = {"m1": F.round("p", 6), "m2": F.round("p2", 6), "m3": F.round((F.col("p") + F.col("p2")) / 2, 6)}
    return table(spark, sf, "scored").withColumns(made).select(*LINE_KEY, *made)
