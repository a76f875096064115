"""URL filter: fixed rules first, then an empirical-Bayes reputation of the host.

Pages that a rule decides are the labelled outcomes (1: blocked). Their rate is shrunk level by level: a suffix towards
all pages, a registered domain towards its suffix, a host towards its domain. Each level is a beta-binomial model whose
prior strength comes from the spread of its children's rates. A page without a rule is blocked if the lower posterior
bound of its host's rate is above the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import written

#: (verdict, host, path); of those that fit, the longest wins
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: standard deviations below the posterior mean, and the rate from which a host is blocked
Z, LIMIT = 1.0, 0.5
#: weight of the prior over all pages, and bounds of the estimated prior weights
BASE_WEIGHT, LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1.0, 1000.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there up to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written ``host`` + ``path``, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones override
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _weight(children: DataFrame, n: str, bad: str, prior: Column, by: list[str]) -> DataFrame:
    """Prior weight per value of ``by``, or one for all, by the method of moments.

    With child rates r around the prior mean m, the spread is V = sum n (r - m)^2 / sum n. The beta-binomial expects
    V = m (1 - m) (1/nbar + (1 - 1/nbar) / (w + 1)), which is solved for w. Where no child is labelled it is null.
    """
    r = F.col(bad) / F.col(n)
    moments = children.where(F.col(n) > 0).groupBy(*by).agg(
        F.sum(F.col(n) * (r - prior) * (r - prior)).alias("ss"), F.sum(n).alias("nn"), F.count("*").alias("kk"), F.max(prior).alias("mm"))
    unit = F.greatest(F.col("mm") * (1 - F.col("mm")), F.lit(1e-9))
    spread, inv = F.col("ss") / F.col("nn") / unit, F.col("kk") / F.col("nn")
    over = (spread - inv) / F.greatest(1 - inv, F.lit(1e-9))
    w = F.when(over <= 0, F.lit(MOST_WEIGHT)).otherwise(1 / over - 1)
    return moments.select(*by, F.least(F.greatest(w, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT)).alias("weight"))


def _shrunk(level: DataFrame, prior: Column, weight: Column, name: str) -> DataFrame:
    """Add the posterior mean of the rate as ``name``; parents without labelled children take the weight of all pages."""
    w = F.coalesce(weight, F.lit(BASE_WEIGHT))
    return level.withColumn(name, (F.col("bad") + w * prior) / (F.col("n") + w)).withColumn("total", F.col("n") + w)


def host_reputation(outcomes: DataFrame, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """From (host, n, bad), a written table: host, rate (posterior mean), bound (lower posterior bound) and blocked, one row per host.

    Domains and suffixes are sums of the level below, written as they are made; the rate of all pages and the weight of
    its prior are two numbers.
    """
    hosts = outcomes.select("host", "n", "bad", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    base = F.lit(((bad or 0) + BASE_WEIGHT / 2) / ((n or 0) + BASE_WEIGHT))
    top = F.lit(_weight(suffixes, "n", "bad", base, []).first().weight).cast("double")
    suffixes = _shrunk(suffixes, base, top, "s_rate").select("suffix", "s_rate")
    domains = written(domains.join(suffixes, "suffix"), "domain-priors")
    domains = _shrunk(domains.join(_weight(domains, "n", "bad", F.col("s_rate"), ["suffix"]), "suffix", "left"), F.col("s_rate"), F.col("weight"), "d_rate")
    hosts = written(hosts.join(domains.select("domain", "d_rate"), "domain"), "host-priors")
    hosts = _shrunk(hosts.join(_weight(hosts, "n", "bad", F.col("d_rate"), ["domain"]), "domain", "left"), F.col("d_rate"), F.col("weight"), "rate")
    bound = F.col("rate") - F.lit(z) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("total") + 1))
    return hosts.select("host", "rate", bound.alias("bound"), (bound > limit).alias("blocked"))


def judge_urls(df: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """One row per row of ``df``: page_id, host, path, rule, verdict, rate and bound of the host.

    A null url or one without ``://`` has an empty host and path, takes no rule and is judged like an unknown host.
    Repeated rows are judged alike; an empty table gives an empty result. Other columns are not read.
    """
    host, path = host_and_path(F.col(url))
    pages = df.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    outcomes = pages.groupBy("host").agg(F.count("ruled").alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"))
    known = host_reputation(written(outcomes, "outcomes"), z, limit)
    judged = pages.join(known, "host")
    own = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "rate", "bound")
