import re

from tabwright.llm.url_reputation import RULES, host_reputation, judge_urls

CASES = [
    ("http://www.A.example.org/es/1?q", "www.a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12#x", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://notexample.org/es/2", "notexample.org", "/es/2", "org/", "allow"),
    ("ftp://x.com/fr/a://b/de/", "x.com", "/fr/a://b/de/", "com/fr/", "allow"),
    ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://x.org?u=/es/", "x.org", "", None, None),
    ("no scheme.org/x", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("http://", "", "", None, None),
    ("http://" + "é" * 70_000 + ".org/", "é" * 70_000 + ".org", "/", "org/", "allow"),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)], "page_id long, url string, host string")
    got = {r.page_id: r for r in judge_urls(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_longest_rule_wins_by_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in judge_urls(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for page, url in rows:
        host, path = re.match(r"[^/?#]*", url.split("://", 1)[1]).group().lower(), re.sub(r"[?#].*", "", "/" + url.split("://", 1)[1].partition("/")[2])
        fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[page].rule == (max(fit)[1] if fit else None)
        assert not fit or got[page].verdict == max(fit)[2]


def test_shrinkage(spark):
    rows = [("a.x.com", 50.0, 50.0), ("b.x.com", 40.0, 39.0), ("new.x.com", 0.0, 0.0), ("c.y.org", 60.0, 0.0), ("new.y.org", 0.0, 0.0), ("one.y.org", 1.0, 1.0)]
    got = {r.host: r for r in host_reputation(spark.createDataFrame(rows, "host string, n double, bad double")).collect()}
    assert got["a.x.com"].blocked and got["new.x.com"].blocked
    assert not got["c.y.org"].blocked and not got["new.y.org"].blocked and not got["one.y.org"].blocked
    assert got["a.x.com"].rate > got["new.x.com"].rate > got["new.y.org"].rate
    assert all(r.bound <= r.rate for r in got.values())


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x")], "page_id long, url string")
    assert judge_urls(df).count() == 2 and judge_urls(df.limit(0)).count() == 0
