"""URL rules against a plain loop."""
from apiatlas.llm import queries, url_rules

URLS = [None, "", "no scheme", "http://", "https:///x", "http://a.example.net/en/1", "HTTP://A.Example.NET/en/1", "http://example.net",
        "http://example.net/", "http://net/", "http://notexample.net/en/", "http://x.org/fr/a?q=/", "http://x.org/frx", "http://x.org/fr",
        "http://a.b.c.d.example.com/de/x#y", "http://example.com/DE/x", "http://example.com/de/?x", "ftp://u@h.example.com:80/de/a",
        "http://a..net/x", "http://.net/x", "x://y://example.net/en/", "http://example.net/en/" + "a/" * 3000, "http://" + "a." * 2000 + "net/"]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        p = rule[len(h):]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), len(h), verdict == "block", rule, verdict))
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def judged(spark, urls, rules):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    return url_rules.judge_urls(df, url_rules.rule_table(spark, rules))


def test_contract_rules(spark):
    for r in judged(spark, URLS, queries.URL_RULES).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(URLS[r["page_id"]], queries.URL_RULES)


def test_rules_without_final_slash(spark):
    rules = [("block", "example.net/en/1"), ("allow", "example.net"), ("block", "org/fr"), ("allow", "x.org/fr/a"), ("block", "x.org/fr/a")]
    for r in judged(spark, URLS, rules).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(URLS[r["page_id"]], rules)


def test_repeats_clashes_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "mine", 5)] * 3 + [(None, None, None, None)],
                               "page_id long, url string, host string, digest int")
    out = url_rules.judge_urls(df, url_rules.rule_table(spark, queries.URL_RULES))
    assert sorted(out.columns) == sorted(["page_id", "url", "digest", "host", "path", "rule", "verdict"])
    assert sorted((r["page_id"] or 0, r["host"], r["verdict"]) for r in out.collect()) == [(0, "", "allow")] + [(1, "a.net", "block")] * 3
    assert url_rules.judge_urls(df.limit(0), url_rules.rule_table(spark, queries.URL_RULES)).count() == 0
    none = spark.createDataFrame([], "verdict string, rule string")
    assert {r["verdict"] for r in url_rules.judge_urls(df, none).collect()} == {"allow"}
