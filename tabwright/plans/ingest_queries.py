"""Sources, sinks and row validation as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import classify_source
from ..operators import history, scoring
from ..operators.drift import fit_snapshot
from ..session import scratch_path
from ..sources import sinks
from ..sources.connectors import read_source
from ..sources.files import FileSpec, json_path_rows
from ..sources.rest import RestSpec
from .fixtures import table, with_tables
from .registry import query

ORDERS_SQL = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders"
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("s1_csv_scan", ORDERS_SQL)
def s1(spark, sf):
    path = scratch_path(spark, "orders-csv")
    table(spark, sf, "orders").select(ORDER_COLUMNS).write.option("header", True).csv(path)
    return read_source(spark, FileSpec(path, "csv"))


@query("s1_csv_quoted_text", "select doc_id, lang, text from documents")
def s1_quoted(spark, sf):
    # texts hold quotes, commas and line breaks; large files or small, the records are cut in parallel
    path = scratch_path(spark, "documents-csv")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return read_source(spark, FileSpec(path, "csv", "doc_id bigint, lang string, text string", split_above=0))


@query("s2_tsv_scan", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def s2(spark, sf):
    path = scratch_path(spark, "customer-tsv")
    table(spark, sf, "customer").write.option("header", True).option("sep", "\t").csv(path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return read_source(spark, FileSpec(path, "tsv", schema))


@query("s3_parquet_scan", "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part")
def s3(spark, sf):
    return read_source(spark, f"{sf}/part.parquet")


@query("s4_json_scan", "select c_custkey, c_name, c_acctbal from customer")
def s4(spark, sf):
    # array documents of at most a thousand records each
    path = scratch_path(spark, "customer-json")
    record = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal"))
    chunk = F.floor(F.col("c_custkey") / 1000).alias("chunk")
    docs = table(spark, sf, "customer").select(chunk, record.alias("r")).groupBy("chunk").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value"))
    docs.write.partitionBy("chunk").text(path)
    return read_source(spark, FileSpec(f"{path}/*", "json", "c_custkey bigint, c_name string, c_acctbal double"))


@query("s4_json_lines_scan", "select c_custkey, c_name, c_acctbal from customer")
def s4_lines(spark, sf):
    path = scratch_path(spark, "customer-jsonl")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.json(path)
    return read_source(spark, FileSpec(path, "jsonl"))


@query("s5_xml_scan", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def s5(spark, sf):
    path = scratch_path(spark, "supplier-xml")
    table(spark, sf, "supplier").write.format("xml").option("rowTag", "supplier").save(path)
    schema = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
    return read_source(spark, FileSpec(path, "xml", schema, {"rowTag": "supplier"}))


@query("s16_rest_source", "select c_custkey, c_name, c_acctbal from customer")
def s16(spark, sf):
    # pages are files below the shared folder, fetched by address like any other page;
    # this needs a shared folder that is mounted as a file path
    path = scratch_path(spark, "customer-pages")
    page = F.floor(F.col("c_custkey") / 1000).alias("page")  # pages of a fixed size; their number follows the table
    record = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal"))
    rows = table(spark, sf, "customer").select(page, F.col("c_custkey"), record.alias("r"))
    lines = rows.repartition("page").sortWithinPartitions("page", "c_custkey").select("page", F.col("r").alias("value"))
    lines.write.partitionBy("page").text(path, lineSep="\n")
    spec = RestSpec(
        url=f"file://{path}/page={{page}}", schema="c_custkey bigint, c_name string, c_acctbal double", pages=None,
        first_page=0, record_path="data.items", fetcher="tabwright.plans.pages:fetch_lines")
    return read_source(spark, spec)


@query("s17_json_path_rows", """
    select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events""")
def s17(spark, sf):
    rows = json_path_rows(table(spark, sf, "events"), "props", "k")
    return rows.select("event_id", F.col("record").cast("bigint").alias("k"))


@query("s17_json_nested_rows", """
    select event_id, unnest([event_id, cast(json_extract_string(props, '$.k') as bigint)]) as n from events""")
def s17_nested(spark, sf):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"data": {"items": [{"n": '), F.col("event_id"), F.lit('}, {"n": '), k, F.lit("}]}}"))
    events = table(spark, sf, "events").select("event_id", text.alias("body"))
    rows = json_path_rows(events, "body", "data.items", "n bigint")
    return rows.select("event_id", "record.n")


@query("s18_classify_source", with_tables("""
    select id, uri, case
        when regexp_matches(lower(trim(uri)), '^(postgresql|postgres|mysql|sqlite|mssql)://') then 'DATABASE'
        when regexp_matches(lower(uri), 'bigquery://|snowflake://|s3://|az://|gs://|docs\\.google\\.com/spreadsheets') then 'CLOUD'
        when regexp_matches(lower(trim(uri)), '^https?://') then 'API' else 'FILE' end as kind
    from {addresses}"""))
def s18(spark, sf):
    return table(spark, sf, "addresses").select("id", "uri", classify_source("uri").alias("kind"))


# sinks ----------------------------------------------------------------------

@query("k1_raw_snapshot", ORDERS_SQL)
def k1(spark, sf):
    raw = table(spark, sf, "orders").select(ORDER_COLUMNS)
    return sinks.save_stage(raw, scratch_path(spark, "raw"))


@query("k2_preprocessed_snapshot", with_tables("""
    select o_orderkey, o_custkey, coalesce(price_low, (select median(price_low) from {null_orders})) as price_low
    from {null_orders}"""))
def k2(spark, sf):
    from ..operators.clean import impute
    df = table(spark, sf, "null_orders").select("o_orderkey", "o_custkey", "price_low")
    return sinks.save_stage(impute(df, ["price_low"]), scratch_path(spark, "preprocessed"))


@query("k3_engineered_snapshot", """
    select o_orderkey, cast(year(o_orderdate) as int) as o_orderdate_year, cast(month(o_orderdate) as int) as o_orderdate_month from orders""")
def k3(spark, sf):
    from ..functions.scalar import date_parts
    parts = date_parts("o_orderdate")
    df = table(spark, sf, "orders").withColumns(parts).select("o_orderkey", "o_orderdate_year", "o_orderdate_month")
    return sinks.save_stage(df, scratch_path(spark, "engineered"))


@query("k5_drift_snapshot_json", """
    select 'l_quantity' as feature, round(avg(l_quantity), 4) as mean, min(l_quantity) as min, max(l_quantity) as max from lineitem
    union all
    select 'l_discount', round(avg(l_discount), 4), min(l_discount), max(l_discount) from lineitem""")
def k5(spark, sf):
    path = scratch_path(spark, "snapshot")
    sinks.save_drift_snapshot(fit_snapshot(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]), path)
    back = spark.read.json(path)
    return back.select("feature", F.round("mean", 4).alias("mean"), "min", "max")


@query("k7_split_partitioned", with_tables("""
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, y, split from {scored}"""))
def k7(spark, sf):
    df = table(spark, sf, "scored").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y", "split")
    return sinks.save_stage(df, scratch_path(spark, "splits"), ["split"])


# validation -----------------------------------------------------------------

@query("d2_validate_rows", with_tables("""
    select event_id, 'missing feature: absent' as first_error,
           1 + cast(try_cast(mixed_s as double) is null as int) as n_errors, 0 as n_warnings, false as valid
    from {str_events}"""))
def d2(spark, sf):
    checked = scoring.validate_rows(table(spark, sf, "str_events"), ["event_id", "num_s", "mixed_s", "absent"])
    return checked.select("event_id", F.col("errors")[0].alias("first_error"), F.size("errors").alias("n_errors"),
                          F.size("warnings").alias("n_warnings"), "valid")


@query("d2_validate_nulls", with_tables("""
    select o_orderkey, cast(price_low is null as int) + cast(price_high is null as int) as n_warnings, true as valid
    from {null_orders}"""))
def d2_nulls(spark, sf):
    checked = scoring.validate_rows(table(spark, sf, "null_orders"), ["price_low", "price_high"])
    return checked.select("o_orderkey", F.size("warnings").alias("n_warnings"), "valid")


@query("d3_route_invalid", with_tables("""
    select case when try_cast(mixed_s as double) is null then 'quarantine' else 'good' end as route,
           count(*) as n, cast(sum(event_id) as bigint) as id_sum
    from {str_events} group by 1"""))
def d3(spark, sf):
    good, bad = scoring.route_invalid(table(spark, sf, "str_events"), ["num_s", "mixed_s"])
    both = good.select("event_id", F.lit("good").alias("route")).unionByName(bad.select("event_id", F.lit("quarantine").alias("route")))
    return both.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


# history --------------------------------------------------------------------

GOAL = "Est elle dans the and auto"
HIT = "(contains(lower(goal), 'elle') or contains(lower(goal), 'dans') or contains(lower(goal), 'auto'))"


@query("h2_recent_runs", with_tables("""
    select id, goal, source_type, best_model from {runs} order by timestamp desc, id limit 10"""))
def h2(spark, sf):
    return history.recent_runs(table(spark, sf, "runs")).select("id", "goal", "source_type", "best_model")


@query("h3_similar_runs", with_tables(f"""
    select id, goal, best_model from {{runs}} where {HIT} order by timestamp desc, id limit 5"""))
def h3(spark, sf):
    return history.similar_runs(table(spark, sf, "runs"), GOAL).select("id", "goal", "best_model")


@query("h5_history_digest", with_tables(f"""
    with alike as (select *, row_number() over (order by timestamp desc, id) as pos from {{runs}} where {HIT}),
    recent as (select *, row_number() over (order by timestamp desc, id) as pos from {{runs}}),
    both_lists as (select 0 as part, * from alike where pos <= 5 union all select 1 as part, * from recent where pos <= 3),
    kept as (select *, row_number() over (partition by id order by part, pos) as keep from both_lists)
    select cast(row_number() over (order by part, pos) as int) as position, id,
           '[' || strftime(timestamp, '%Y-%m-%d') || '] "' || goal || '" | source=' || source_type || ' | best_model=' || best_model || ' | ' ||
           coalesce('auc_val=' || cast(cast(json_extract(metrics, '$.auc_val') as double) as string), 'metrics not captured') as line
    from kept where keep = 1"""))
def h5(spark, sf):
    return history.history_digest(table(spark, sf, "runs"), GOAL)


@query("x2_union_distinct_by_id", with_tables(f"""
    with alike as (select id from {{runs}} where {HIT} order by timestamp desc, id limit 40),
    recent as (select id from {{runs}} order by timestamp desc, id limit 40)
    select id from alike union select id from recent"""))
def x2(spark, sf):
    runs = table(spark, sf, "runs")
    both = history.union_distinct_by(history.similar_runs(runs, GOAL, 40), history.recent_runs(runs, 40))
    return both.select("id")


@query("h6_parse_metrics", with_tables("""
    select id, cast(json_extract(metrics, '$.auc_val') as double) as auc_val from {runs}"""))
def h6(spark, sf):
    return history.parse_metrics(table(spark, sf, "runs")).select("id", F.col("metrics")["auc_val"].alias("auc_val"))
