"""Derived input tables, written once as SQL text for both engines.

``{name}`` stands for a base table or another derived table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

DERIVED = {
    # one column per missing-value tier
    "null_orders": """
        select o_orderkey, o_custkey,
               case when o_orderkey % 200 = 0 then null else o_totalprice end as price_trace,
               case when o_orderkey % 33 = 0 then null else o_totalprice end as price_low,
               case when o_orderkey % 10 = 3 then null else o_orderstatus end as status_mid,
               case when o_orderkey % 10 < 3 then null else o_totalprice end as price_high,
               case when o_orderkey % 10 < 6 then null else o_orderpriority end as priority_drop
        from {orders}""",
    "dup_orders": "select * from {orders} union all select * from {orders} where o_orderkey % 10 = 0",
    # text columns that hold numbers, times and flags
    "str_events": """
        select event_id, cast(event_id as string) as num_s, cast(value as string) as value_s,
               cast(ts as string) as event_time_s,
               case when event_id % 2 = 0 then 'Yes' else ' no' end as flag_s,
               case when event_id % 50 = 0 then 'n/a' else cast(event_id as string) end as mixed_s, event_type
        from {events}""",
    # features before a cut-off date, label after it
    "cust_ft": """
        select c.c_custkey, c.c_nationkey, c.c_mktsegment, c.c_acctbal,
               count(case when o.o_orderdate < date '2001-02-01' then 1 end) as trans_ct,
               coalesce(sum(case when o.o_orderdate < date '2001-02-01' then cast(o.o_totalprice as decimal(18,2)) end), 0) as trans_amt,
               max(case when o.o_orderdate < date '2001-02-01' then o.o_orderdate end) as last_order,
               case when max(o.o_orderdate) >= date '2001-02-01' then 0 else 1 end as churned
        from {customer} c left join {orders} o on c.c_custkey = o.o_custkey
        group by c.c_custkey, c.c_nationkey, c.c_mktsegment, c.c_acctbal""",
    "doc_ft": """
        select d.doc_id, d.n_chars, length(d.text) - length(replace(d.text, ' ', '')) as n_spaces,
               length(d.text) - length(replace(d.text, chr(10), '')) as n_lines, d.lang, d.source, l.quality, l.toxic
        from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    # closed-form scores p and p2 with label y, decision and split
    "scored": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate,
               case when l_returnflag = 'R' then 1 else 0 end as y,
               ((l_partkey * 7 + l_suppkey * 13 + l_linenumber * 31) % 1000 + case when l_returnflag = 'R' then 400 else 0 end) / cast(1400 as double) as p,
               ((l_partkey * 11 + l_suppkey * 3 + l_linenumber * 17) % 1000 + case when l_returnflag = 'R' then 300 else 0 end) / cast(1300 as double) as p2,
               case when l_orderkey % 20 < 14 then 'train' when l_orderkey % 20 < 17 then 'val' else 'test' end as split
        from {lineitem}""",
    "decided": "select *, case when p >= 0.5 then 1 else 0 end as pred, case when p2 >= 0.5 then 1 else 0 end as pred2 from {scored}",
    "scored_long": """
        select 'Linear A' as model, split, y, p from {scored}
        union all select 'Linear B' as model, split, y, p2 as p from {scored}
        union all select 'Dummy Majority' as model, split, y, cast(0 as double) as p from {scored}""",
    # numeric columns with a collinear pair and a nearly constant column
    "line_num": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as qty, l_extendedprice as price,
               l_extendedprice * (1 - l_discount) as net_price, l_discount as discount, l_tax as tax,
               l_discount * 0.001e0 as tiny, l_quantity * l_quantity * l_quantity * l_quantity as qty4,
               case when l_returnflag = 'R' then 1 else 0 end as y
        from {lineitem}""",
    # two fixed predictions of a price
    "line_pred": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice as y,
               l_quantity * 1000 + (l_partkey % 100) * 10 as pred, l_quantity * 900 + (l_suppkey % 50) * 40 as pred2
        from {lineitem}""",
    "emb_ft": """
        select vec_id, label as y, case when vec_id % 10 < 7 then label else (label + 1) % 10 end as pred
        from {embeddings}""",
    # run history with one run per document
    "runs": """
        select cast(doc_id as string) as id,
               cast(date '2024-01-01' + cast(doc_id % 1000 as int) as timestamp) as timestamp, text as goal, source as source_type, lang as problem_type,
               case when doc_id % 3 = 0 then 'Linear' else 'Boosted' end as best_model,
               case when doc_id % 5 = 0 then null else '{{"auc_val": 0.' || cast(n_chars % 90 + 10 as string) || '}}' end as metrics,
               cast(null as string) as notes
        from {documents}""",
    # an address of every source kind, next to the real page addresses
    "addresses": """
        select page_id as id, url as uri from {pages}
        union all
        select doc_id as id, case cast(doc_id % 9 as int)
            when 0 then 's3://bucket/' || cast(doc_id as string) || '.parquet'
            when 1 then 'postgresql://host/db' when 2 then ' MySQL://host/db' when 3 then '/data/in/' || lang || '.csv'
            when 4 then 'https://docs.google.com/spreadsheets/d/' || cast(doc_id as string)
            when 5 then 'http://api.example.org/v1' when 6 then 'gs://bucket/x.json' when 7 then 'sqlite:///x.db'
            else source end as uri
        from {documents}""",
    # one dataset profile per supplier, covering every choice rule
    "profiles": """
        select l_suppkey,
               case cast(l_suppkey % 4 as int) when 0 then 'binary_classification' when 1 then 'multiclass_classification'
                    when 2 then 'regression' else 'ordinal_classification' end as problem_type,
               case when l_suppkey % 16 = 0 then 10000 else count(*) * (l_suppkey % 97 + 1) end as n_rows,
               case when l_suppkey % 3 = 0 then 12.5e0 else
                    100 * cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as double) / count(*) end as minority_pct,
               case when l_suppkey % 5 = 0 then 60e0 else
                    100 * cast(sum(case when l_discount = 0 then 1 else 0 end) as double) / count(*) end as sparsity_pct
        from {lineitem} group by l_suppkey""",
    "importances": """
        select l_linenumber as run, 'f' || cast(l_suppkey % 40 as string) as feature,
               sum(cast(l_quantity as bigint) * (l_partkey % 7 + 1)) / cast(1000000 as double) as importance
        from {lineitem} group by l_linenumber, 'f' || cast(l_suppkey % 40 as string)""",
    "cases": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, p as score,
               case when l_partkey % 10 = 0 then 'BORDERLINE' when y = 1 then 'OBVIOUS_POSITIVE' else 'OBVIOUS_NEGATIVE' end as case_type
        from {scored}""",
    "checks": """
        select l_suppkey, case when avg(p) > 0.55 then 'WARN' when avg(p) > 0.5 then 'MANUAL_REVIEW_REQUIRED'
                               when max(y) = 0 then 'SKIP' else 'PASS' end as verdict
        from {scored} group by l_suppkey""",
    "events_drift": """
        select event_id, user_id, event_type, value, cast(ts as timestamp) as ts,
               case when ts < date '2024-01-16' then value else value * 3 + 20 end as shifted
        from {events}""",
    "periods": """
        select event_type as feature, cast(cast(ts as date) as string) as period,
               0.9e0 - cast(sum(case when event_id % 7 = 0 then 1 else 0 end) as double) / count(*) / 2 as metric,
               sum(event_id) % 3 > 0 as drifted
        from {events} group by event_type, cast(cast(ts as date) as string)""",
}

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def needs(text: str) -> list[str]:
    return sorted(set(_NAME.findall(text)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base or derived table at one scale."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = DERIVED[name]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in needs(text)})


def with_tables(body: str) -> str:
    """SQL with every derived table it names put in front as a common table expression."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for n in needs(DERIVED[name]):
            visit(n)
        order.append(name)

    for n in needs(body):
        visit(n)
    plain = lambda text: _NAME.sub(r"\1", text).replace("{{", "{").replace("}}", "}")
    ctes = ",\n".join(f"{n} as ({plain(DERIVED[n])})" for n in order)
    body = plain(body).strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
