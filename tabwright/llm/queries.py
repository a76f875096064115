"""The text queries by name, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabwright.llm import bpe, exact_dedup, fingerprints, lang_id, license_scan, merkle, neighbours, ngram_join, packing, quality_trees, training_order, url_reputation, whitening
from tabwright.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return add


@register("op2_exact_dedup", r"""
    with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
    select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
           doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
    from d""")
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


_RULES_SQL = " union all ".join(f"select '{v}' as verdict, '{h}' as host, '{p}' as path" for v, h, p in url_reputation.RULES)


def _weight_sql(source: str, parent: str, prior: str) -> str:
    return f"""select {parent}, least(greatest(case when over <= 0 then 1000.0e0 else 1 / over - 1 end, 1.0e0), 1000.0e0) as weight from (
        select {parent}, (sum(n * (bad / n - {prior}) * (bad / n - {prior})) / sum(n) / greatest(max({prior}) * (1 - max({prior})), 1e-9)
                          - count(*) / sum(n)) / greatest(1 - count(*) / sum(n), 1e-9) as over
        from {source} where n > 0 group by {parent})"""


@register("op6_url_reputation", rf"""
    with rules as ({_RULES_SQL}),
    cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_reputation.UPPER}', '{url_reputation.LOWER}') as host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
    ruled as (select p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) as rule,
                     arg_max(r.verdict, length(r.host || r.path)) as ruled
              from p left join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
              group by p.page_id, p.host, p.path),
    h as (select host, array_to_string(string_split(host, '.')[-2:], '.') as domain, string_split(host, '.')[-1] as suffix,
                 cast(count(ruled) as double) as n, cast(count(case when ruled = 'block' then 1 end) as double) as bad
          from ruled group by host),
    d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by domain, suffix),
    s0 as (select suffix, sum(n) as n, sum(bad) as bad from d group by suffix),
    s1 as (select suffix, n, bad, 1 as one, (sum(bad) over () + 1.0e0) / (sum(n) over () + 2.0e0) as base from s0),
    sw as ({_weight_sql('s1', 'one', 'base')}),
    s as (select suffix, (bad + coalesce(weight, 2.0e0) * base) / (n + coalesce(weight, 2.0e0)) as s_rate from s1 left join sw using (one)),
    d1 as (select d.*, s.s_rate from d join s using (suffix)),
    dw as ({_weight_sql('d1', 'suffix', 's_rate')}),
    d2 as (select domain, (bad + coalesce(weight, 2.0e0) * s_rate) / (n + coalesce(weight, 2.0e0)) as d_rate from d1 left join dw using (suffix)),
    h1 as (select h.*, d2.d_rate from h join d2 using (domain)),
    hw as ({_weight_sql('h1', 'domain', 'd_rate')}),
    h2 as (select host, n + coalesce(weight, 2.0e0) as total, (bad + coalesce(weight, 2.0e0) * d_rate) / (n + coalesce(weight, 2.0e0)) as rate
           from h1 left join hw using (domain))
    select page_id, host, path, rule,
           coalesce(ruled, case when rate - 1.0e0 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5e0 then 'block' else 'allow' end) as verdict
    from ruled join h2 using (host)""")
def op6_url_reputation(spark, sf_dir):
    return url_reputation.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@register("op9_bpe")
def op9_bpe(spark, sf_dir):
    return bpe.encode_decode(table(spark, sf_dir, "documents"), TOKENIZER)


@register("op3_packing")
def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


@register("op10_training_order")
def op10_training_order(spark, sf_dir):
    return training_order.in_order(table(spark, sf_dir, "documents"), TOKENIZER).drop("ids")


@register("op7_language")
def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lang_id.predict_language(docs, lang_id.learn_languages(docs))


@register("op8_quality")
def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_trees.score_quality(docs, quality_trees.learn_quality(docs, table(spark, sf_dir, "labels")))


@register("op4_neighbours")
def op4_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@register("op5_license_scan", license_scan.scan_sql())
def op5_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@register("op1_ngram_join")
def op1_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@register("op13_fingerprints", fingerprints.edited_sql())
def op13_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@register("op11_merkle", merkle.manifest_sql())
def op11_merkle(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


@register("op12_whitening")
def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
