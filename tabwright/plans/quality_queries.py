"""Profiling, integrity checks, cleaning, encoding and scaling as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, encode, quality
from ..operators.preprocess import preprocess
from .fixtures import table, with_tables
from .registry import query

NULL_COLUMNS = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("price_trace", "double"), ("price_low", "double"),
    ("status_mid", "string"), ("price_high", "double"), ("priority_drop", "string"),
]


def union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


@query("q1_profile", with_tables(union([
    f"select '{c}' as \"column\", '{t}' as dtype, count(*) as rows, count(*) - count({c}) as nulls, "
    f"round(100.0 * (count(*) - count({c})) / count(*), 6) as null_pct from {{null_orders}}" for c, t in NULL_COLUMNS])))
def q1(spark, sf):
    return quality.profile(table(spark, sf, "null_orders")).withColumn("null_pct", F.round("null_pct", 6))


@query("q2_nonempty", """
    select 'Zero Rows' as "check", count(*) > 0 as passed, count(*) || ' rows found' as detail from orders""")
def q2(spark, sf):
    return quality.check_nonempty(table(spark, sf, "orders"))


@query("q3_sparse_columns", with_tables("""
    select * from (select 'priority_drop' as "column", round(100.0 * (count(*) - count(priority_drop)) / count(*), 6) as null_pct
                   from {null_orders}) where null_pct > 50"""))
def q3(spark, sf):
    return quality.check_sparse_columns(table(spark, sf, "null_orders")).withColumn("null_pct", F.round("null_pct", 6))


@query("q4_unparsed_dates", with_tables("""
    select 'event_time_s' as "column", typeof(any_value(event_time_s)) = 'VARCHAR' as unparsed, count(event_time_s) as values,
           count(try_cast(event_time_s as timestamp)) as parseable from {str_events}
    union all select 'o_orderdate', typeof(any_value(o_orderdate)) = 'VARCHAR', count(o_orderdate), count(o_orderdate) from orders
    union all select 'l_shipdate', typeof(any_value(l_shipdate)) = 'VARCHAR', count(l_shipdate), count(l_shipdate) from lineitem"""))
def q4(spark, sf):
    parts = [quality.check_unparsed_dates(table(spark, sf, t)) for t in ("str_events", "orders", "lineitem")]
    return reduce(DataFrame.unionByName, parts)


@query("q5_duplicate_keys", with_tables(union([
    f"select '{c}' as \"column\", count(*) - count(distinct {c}) - cast(count(*) > count({c}) as int) as duplicates from {{{t}}}"
    for t, c in (("dup_orders", "o_orderkey"), ("dup_orders", "o_custkey"), ("null_orders", "status_mid"))])))
def q5(spark, sf):
    first = quality.check_duplicate_keys(table(spark, sf, "dup_orders"), ["o_orderkey", "o_custkey"])
    return first.unionByName(quality.check_duplicate_keys(table(spark, sf, "null_orders"), ["status_mid"]))


@query("q5_duplicate_id_columns", """
    select 'event_id' as "column", count(*) - count(distinct event_id) as duplicates from events
    union all select 'user_id', count(*) - count(distinct user_id) from events""")
def q5_ids(spark, sf):
    return quality.check_duplicate_keys(table(spark, sf, "events"))


SUSPECT = "regexp_matches({c}, '[^\\x00-\\x7F\\x{{00C0}}-\\x{{024F}}]')"


@query("q6_encoding", union([
    f"select '{c}' as \"column\", count(*) filter (where {SUSPECT.format(c=c)}) as suspect from documents"
    for c in ("text", "lang", "source")]))
def q6(spark, sf):
    return quality.check_encoding(table(spark, sf, "documents"))


NULL_ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "price_trace", "price_low", "status_mid", "price_high", "priority_drop"]
EVENTS_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def integrity_sql(source: str, columns: list[str], texts: list[str], keys: list[str]) -> str:
    """Every check computed from the table: one row of counts, notes where a count is too high, and the overall row."""
    listed = lambda parts: "list_filter([" + ", ".join(parts or ["null::varchar"]) + "], lambda x : x is not null)"
    sparse = listed([f"case when n_{c} > 0.5e0 * n then '{c}' end" for c in columns])
    dates = listed([f"'{c}'" for c in texts if "date" in c or "time" in c])
    twice = listed([f"case when n - d_{k} > 0 then '{k}: ' || (n - d_{k}) || ' duplicates' end" for k in keys])
    broken = listed([f"case when s_{c} > 0 then '{c}: ' || s_{c} || ' suspect values' end" for c in texts])
    counts = ", ".join([f"count(*) filter (where {c} is null) as n_{c}" for c in columns] + [f"count(distinct {k}) + max(case when {k} is null then 1 else 0 end) as d_{k}" for k in keys]
                       + [f"count(*) filter (where {SUSPECT.format(c=c)}) as s_{c}" for c in texts])
    check = lambda name, notes, ok: f"""
        select '{name}' as "check", len({notes}) = 0 as passed,
               case when len({notes}) = 0 then '{ok}' else 'WARNING: ' || array_to_string({notes}, ', ') end as detail from c"""
    return f"""
        with c as (select count(*) as n, {counts} from {source}),
        checks as (select 'Zero Rows' as "check", n > 0 as passed, case when n > 0 then n || ' rows found' else 'FATAL: DataFrame is empty' end as detail from c
        union all {check('>50% Empty Columns', sparse, 'No columns >50% null')} union all {check('Unparsed Date Columns', dates, 'No unparsed date columns')}
        union all {check('Duplicate Key Candidates', twice, 'No duplicate keys found')} union all {check('Encoding Issues', broken, 'No encoding artifacts detected')})
        select * from checks union all
        select 'Overall', bool_and(passed), case when bool_and(passed) then 'ALL CHECKS PASSED' else 'ISSUES DETECTED' end from checks"""


@query("q7_integrity_report", with_tables(
    integrity_sql("{null_orders}", NULL_ORDERS_COLUMNS, ["status_mid", "priority_drop"], []).replace("{00C0}", "{{00C0}}").replace("{024F}", "{{024F}}")))
def q7(spark, sf):
    return quality.integrity_report(table(spark, sf, "null_orders"))


@query("q7_integrity_events", integrity_sql("events", EVENTS_COLUMNS, ["event_type", "props"], ["event_id", "user_id"]))
def q7_events(spark, sf):
    return quality.integrity_report(table(spark, sf, "events"))


@query("q8_class_balance", with_tables("""
    select toxic as class, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share,
           count(*) / sum(count(*)) over () < 0.2 as imbalanced
    from {doc_ft} group by toxic"""))
def q8(spark, sf):
    return quality.class_balance(table(spark, sf, "doc_ft"), "toxic").withColumn("share", F.round("share", 6))


@query("q9_constant_columns", """select 'fixed' as "column" from customer group by 1""")
def q9(spark, sf):
    return quality.constant_columns(table(spark, sf, "customer").withColumn("fixed", F.lit("x")))


@query("q10_skew_report", with_tables(union([
    f"select '{c}' as \"column\", round(skewness({c}), 6) as skew, abs(skewness({c})) > 3 as extreme, "
    f"abs(skewness({c})) > 1 as log_hint from {{line_num}}" for c in ("qty", "price", "discount", "qty4")])
    + """ union all select 'value', round(skewness(value), 6), abs(skewness(value)) > 3, abs(skewness(value)) > 1 from events"""))
def q10(spark, sf):
    lines = quality.skew_report(table(spark, sf, "line_num"), ["qty", "price", "discount", "qty4"])
    events = quality.skew_report(table(spark, sf, "events"), ["value"])
    return lines.unionByName(events).withColumn("skew", F.round("skew", 6))


@query("q11_data_profile", with_tables("""
    with c as (select toxic, count(*) as n from {doc_ft} group by toxic)
    select (select count(*) from {doc_ft}) as n_rows, 7 as n_features, 5 as numeric_features, 2 as cat_features,
           round((select max(n) / min(n) from c), 6) as imbalance_ratio,
           round((select 100.0 * min(n) / sum(n) from c), 6) as minority_pct,
           round(100.0 * sum(cast(doc_id = 0 as int) + cast(n_chars = 0 as int) + cast(n_spaces = 0 as int)
                 + cast(n_lines = 0 as int) + cast(quality = 0 as int)) / (count(*) * 5), 1) as sparsity_pct,
           0.0 as missing_pct
    from {doc_ft}"""))
def q11(spark, sf):
    found = quality.data_profile(table(spark, sf, "doc_ft"), "toxic")
    return found.withColumns({c: F.round(c, 6) for c in ("imbalance_ratio", "minority_pct")})


@query("q12_row_loss", with_tables("""
    select a.n as rows_before, b.n as rows_after, round((a.n - b.n) / a.n, 6) as lost, (a.n - b.n) / a.n > 0.7 as blocked
    from (select count(*) as n from {dup_orders}) a, (select count(*) as n from (select distinct * from {dup_orders})) b"""))
def q12(spark, sf):
    raw = table(spark, sf, "dup_orders")
    return quality.check_row_loss(raw, clean.deduplicate(raw)).withColumn("lost", F.round("lost", 6))


# cleaning -------------------------------------------------------------------

@query("t1_deduplicate", with_tables("select distinct * from {dup_orders}"))
def t1(spark, sf):
    return clean.deduplicate(table(spark, sf, "dup_orders"))


@query("t1_dedup_counts", with_tables("""
    select a.n as rows_before, b.n as rows_after, a.n - b.n as removed
    from (select count(*) as n from {dup_orders}) a, (select count(*) as n from (select distinct * from {dup_orders})) b"""))
def t1_counts(spark, sf):
    return clean.dedup_counts(table(spark, sf, "dup_orders"))


TIER = """case when share > 0.5 then 'DROPPED' when share > 0.2 then 'FLAGGED + IMPUTED + INDICATOR'
               when share > 0.05 then 'IMPUTED + INDICATOR' when share > 0.01 then 'IMPUTED' else 'IMPUTED (trace)' end"""
SHARES = union([f"select '{c}' as \"column\", 1 - count({c}) / count(*) as share from {{null_orders}}" for c, _ in NULL_COLUMNS])


@query("t2_null_tiers", with_tables(f"""
    select "column", round(share, 6) as null_share, {TIER} as action from ({SHARES}) where share > 0"""))
def t2(spark, sf):
    plan = clean.NullPolicy.fit(table(spark, sf, "null_orders")).plan(spark)
    return plan.withColumn("null_share", F.round("null_share", 6))


MODE = "(select {c} from {{{t}}} where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


@query("t2_null_policy_applied", with_tables(f"""
    with m as (select median(price_trace) as a, median(price_low) as b, median(price_high) as c from {{null_orders}})
    select o_orderkey, o_custkey, round(coalesce(price_trace, m.a), 4) as price_trace, round(coalesce(price_low, m.b), 4) as price_low,
           coalesce(status_mid, {MODE.format(c='status_mid', t='null_orders')}) as status_mid,
           round(coalesce(price_high, m.c), 4) as price_high,
           cast(status_mid is null as int) as status_mid_was_missing, cast(price_high is null as int) as price_high_was_missing
    from {{null_orders}}, m"""))
def t2_applied(spark, sf):
    df = table(spark, sf, "null_orders")
    out = clean.NullPolicy.fit(df).apply(df)
    return out.withColumns({c: F.round(c, 4) for c in ("price_trace", "price_low", "price_high")})


@query("t3_median_impute", with_tables("""
    select o_orderkey, round(coalesce(price_low, (select median(price_low) from {null_orders})), 4) as price_low from {null_orders}"""))
def t3(spark, sf):
    out = clean.impute(table(spark, sf, "null_orders"), ["price_low"])
    return out.select("o_orderkey", F.round("price_low", 4).alias("price_low"))


@query("t4_mode_impute", with_tables(f"""
    select o_orderkey, coalesce(status_mid, {MODE.format(c='status_mid', t='null_orders')}) as status_mid,
           coalesce(priority_drop, {MODE.format(c='priority_drop', t='null_orders')}) as priority_drop from {{null_orders}}"""))
def t4(spark, sf):
    return clean.impute(table(spark, sf, "null_orders"), ["status_mid", "priority_drop"]).select(
        "o_orderkey", "status_mid", "priority_drop")


@query("t5_missing_indicators", with_tables("""
    select o_orderkey, cast(price_high is null as int) as price_high_was_missing,
           cast(status_mid is null as int) as status_mid_was_missing from {null_orders}"""))
def t5(spark, sf):
    out = clean.missing_indicators(table(spark, sf, "null_orders"), ["price_high", "status_mid"])
    return out.select("o_orderkey", "price_high_was_missing", "status_mid_was_missing")


@query("t6_drop_sparse_columns", with_tables("""
    select "column", action, reason from (
      select 'priority_drop' as "column", 'DROPPED' as action, 'more than half missing' as reason,
             count(priority_drop) / count(*) as present from {null_orders}) where present < 0.5"""))
def t6(spark, sf):
    df = table(spark, sf, "null_orders")
    policy = clean.NullPolicy.fit(df)
    return policy.audit(df).filter("action = 'DROPPED'").select("column", "action", "reason")


@query("t7_winsorise", with_tables("""
    with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events)
    select event_id, round(greatest(least(value, b + 3 * (b - a)), a - 3 * (b - a)), 4) as value from events, q"""))
def t7(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return clean.Winsorizer.fit(df, ["value"]).apply(df).withColumn("value", F.round("value", 4))


@query("t7_winsorise_counts", """
    with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events)
    select 'value' as "column", cast(count(*) filter (where value < a - 3 * (b - a)) as string) || ' low, ' ||
           cast(count(*) filter (where value > b + 3 * (b - a)) as string) || ' high' as reason from events, q""")
def t7_counts(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return clean.Winsorizer.fit(df, ["value"]).audit(df).select("column", "reason")


@query("t8_text_to_bool", with_tables("""
    select event_id, lower(trim(flag_s)) = 'yes' as flag_s from {str_events}"""))
def t8(spark, sf):
    return table(spark, sf, "str_events").select("event_id", clean.bool_value("flag_s").alias("flag_s"))


@query("t9_text_to_timestamp", with_tables("""
    select event_id, cast(cast(event_time_s as timestamp) as string) = event_time_s as same,
           epoch_us(cast(event_time_s as timestamp)) as us from {str_events}"""))
def t9(spark, sf):
    ts = clean.timestamp_value("event_time_s")
    rows = table(spark, sf, "str_events").select("event_id", "event_time_s", ts.alias("t"))
    return rows.select("event_id", (F.col("t").cast("string") == F.col("event_time_s")).alias("same"), F.unix_micros("t").alias("us"))


@query("t10_text_to_number", with_tables("""
    select event_id, try_cast(num_s as bigint) as num_s, try_cast(value_s as double) as value_s from {str_events}"""))
def t10(spark, sf):
    df = table(spark, sf, "str_events")
    return clean.recast(df, clean.text_kinds(df, ["num_s", "value_s"])).select("event_id", "num_s", "value_s")


@query("t11_correct_types", with_tables("""
    select event_id, cast(num_s as bigint) as num_s, cast(value_s as double) as value_s,
           epoch_us(cast(event_time_s as timestamp)) as us, lower(trim(flag_s)) = 'yes' as flag_s, mixed_s, event_type from {str_events}"""))
def t11(spark, sf):
    out, _ = clean.correct_types(table(spark, sf, "str_events"))
    return out.withColumn("us", F.unix_micros("event_time_s")).drop("event_time_s")


NUMBER = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
KIND = f"""case when count({{c}}) = 0 then null
    when bool_and(lower(trim({{c}})) in ('yes', 'true', '1', 'y', 't', 'no', 'false', '0', 'n', 'f')) then 'boolean'
    when {{dated}} and bool_and(try_cast(trim({{c}}) as timestamp) is not null) then 'timestamp'
    when bool_and(regexp_matches(trim({{c}}), {NUMBER})) then case when bool_and(cast(trim({{c}}) as double) = floor(cast(trim({{c}}) as double))) then 'bigint' else 'double' end end"""


def kind_sql(c: str) -> str:
    # numbers are looked at where all are numbers, as text must not be cast
    safe = KIND.replace("cast(trim({c}) as double)", "try_cast(trim({c}) as double)")
    return safe.format(c=c, dated="true" if "time" in c else "false")


@query("t11_type_audit", with_tables(
    "with kinds as (" + " union all ".join(f"select '{c}' as \"column\", {kind_sql(c)} as kind from {{str_events}}"
                                          for c in ("num_s", "value_s", "event_time_s", "flag_s", "mixed_s", "event_type"))
    + ") select \"column\", 'string to ' || kind as reason from kinds where kind is not null"))
def t11_audit(spark, sf):
    return clean.correct_types(table(spark, sf, "str_events"))[1].select("column", "reason")


# encoding and scaling -------------------------------------------------------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


@query("t12_ordinal_encode", f"""
    select o_orderkey, coalesce(list_position({PRIORITIES}, o_orderpriority), 0) - 1 as code from orders""")
def t12(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", encode.ordinal_code("o_orderpriority", PRIORITIES).alias("code"))


@query("t13_binary_label", """
    select l_linestatus, l_code, count(*) as n from (
      select l_linestatus, dense_rank() over (order by l_linestatus) - 1 as l_code from lineitem) group by 1, 2""")
def t13(spark, sf):
    df = table(spark, sf, "lineitem").select("l_linestatus", F.col("l_linestatus").alias("l_code"))
    return encode.label_encode(df, "l_code").groupBy("l_linestatus", "l_code").agg(F.count(F.lit(1)).alias("n"))


@query("t14_one_hot", "select c_custkey, " + ", ".join(
    f"cast(c_mktsegment = '{v}' as int) as \"c_mktsegment_{v}\"" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
) + " from customer")
def t14(spark, sf):
    return encode.one_hot(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("t15_frequency_encode", """
    select c_custkey, round(count(*) over (partition by c_nationkey) / count(*) over (), 6) as nation from customer""")
def t15(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return encode.frequency_encode(df, "nation").withColumn("nation", F.round("nation", 6))


@query("t16_label_encode_all", """
    select c_custkey, dense_rank() over (order by c_name) - 1 as c_name, dense_rank() over (order by c_mktsegment) - 1 as c_mktsegment
    from customer""")
def t16(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return encode.label_encode(encode.label_encode(df, "c_name"), "c_mktsegment")


@query("t17_encode_by_cardinality", """
    select c_custkey, round(count(*) over (partition by c_nationkey) / count(*) over (), 6) as nation,
           coalesce(list_position(['FURNITURE', 'MACHINERY'], c_mktsegment), 0) - 1 as ranked,
           cast(c_acctbal > 0 as int) as sign, """ + ", ".join(
    f"cast(c_mktsegment = '{v}' as int) as \"c_mktsegment_{v}\"" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
) + " from customer")
def t17(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment", F.col("c_mktsegment").alias("ranked"), F.col("c_nationkey").cast("string").alias("nation"),
        F.when(F.col("c_acctbal") > 0, "up").otherwise("down").alias("sign"))
    coded = encode.CategoryEncoder.fit(df, orders={"ranked": ["FURNITURE", "MACHINERY"]}).apply(df)
    return coded.withColumn("nation", F.round("nation", 6))


@query("t18_standardise", with_tables("""
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, y,
           round((qty - avg(qty) over ()) / stddev_pop(qty) over (), 6) as qty,
           round((price - avg(price) over ()) / stddev_pop(price) over (), 6) as price from {line_num}"""))
def t18(spark, sf):
    df = table(spark, sf, "line_num").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y", "qty", "price")
    scale = encode.Standardizer.fit(df, ["qty", "price", "y"])
    return scale.apply(df).withColumns({c: F.round(c, 6) for c in ("qty", "price")})


@query("t19_inverse_scale", with_tables("""
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(qty, 6) as qty, round(price, 4) as price from {line_num}"""))
def t19(spark, sf):
    df = table(spark, sf, "line_num").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty", "price")
    scale = encode.Standardizer.fit(df, ["qty", "price"])
    return scale.inverse(scale.apply(df)).withColumns({"qty": F.round("qty", 6), "price": F.round("price", 4)})


@query("t20_binary_columns", with_tables("""
    select "column" from (select 'churned' as "column", bool_and(churned in (0, 1)) as b from {cust_ft}
      union all select 'c_nationkey', bool_and(c_nationkey in (0, 1)) from {cust_ft}
      union all select 'trans_ct', bool_and(trans_ct in (0, 1)) from {cust_ft}) where b"""))
def t20(spark, sf):
    found = clean.binary_columns(table(spark, sf, "cust_ft"), ["churned", "c_nationkey", "trans_ct"])
    return spark.createDataFrame([(c,) for c in found], "column string")


@query("t21_audit", with_tables(f"""
    select 'missing values' as step, "column", {TIER} as action from ({SHARES}) where share > 0
    union all select 'types' as step, "column", 'RECAST' as action from (select count(*) as n from {{str_events}}),
      (values ('num_s'), ('value_s'), ('event_time_s'), ('flag_s')) v("column") where n > 0"""))
def t21(spark, sf):
    nulls = table(spark, sf, "null_orders")
    audit = clean.NullPolicy.fit(nulls).audit(nulls)
    types = clean.correct_types(table(spark, sf, "str_events"))[1]
    return audit.unionByName(types).select("step", "column", "action")


@query("t22_preprocess")
def t22(spark, sf):
    df = table(spark, sf, "cust_ft").withColumn("trans_amt", F.col("trans_amt").cast("double"))
    out, _ = preprocess(df, target="churned", keys=["c_custkey"])
    return out


@query("t22_preprocess_audit")
def t22_audit(spark, sf):
    df = table(spark, sf, "null_orders")
    return preprocess(df, keys=["o_orderkey", "o_custkey"])[1]


# defaults -------------------------------------------------------------------

@query("p8_fill_missing_features", with_tables("""
    select o_orderkey, coalesce(price_low, 0) as price_low, coalesce(price_high, 0) as price_high, cast(0 as double) as absent from {null_orders}"""))
def p8(spark, sf):
    from ..operators.scoring import fill_missing_features
    out = fill_missing_features(table(spark, sf, "null_orders"), ["price_low", "price_high", "absent"])
    return out.select("o_orderkey", "price_low", "price_high", "absent")


@query("o7_dropna", with_tables("""
    select * from {null_orders} where price_trace is not null and price_low is not null and status_mid is not null
      and price_high is not null and priority_drop is not null"""))
def o7(spark, sf):
    return table(spark, sf, "null_orders").dropna()
