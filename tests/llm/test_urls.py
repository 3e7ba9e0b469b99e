"""URL rules against a loop over the rules."""
import random
import re

from adlattice.llm import urls

RULES = urls.RULES + [("a.b.example.org", "/x/y", "block"), ("b.example.org", "/x/y/z", "allow"), ("com", "/", "block"), ("Deep.example.com", "/", "allow")]


def brute(url, rules):
    m = re.match(r"(?s).*?://(.*)", url or "")
    host, path = "", ""
    if m:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", m[1]).groups()
        host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    best = None
    for h, p, v in rules:
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(h + p), len(h)) > best[0]):
            best = ((len(h + p), len(h)), h + p, v)
    return host, path, best[1] if best else None, best[2] if best else "allow"


def test_against_all_rules(spark):
    rng = random.Random(4)
    hosts = ["net", "xnet", "x.net", "example.net", "EXAMPLE.net", "a.example.net", "badexample.net", "example.com", "q.deep.example.com", "w.org", "a.b.example.org", "c.a.b.example.org", "", ".", "..net", "net:80"]
    paths = ["", "/", "/en", "/en/", "/en/1", "//en/", "/de/x", "/fr/", "/x/y", "/x/yy/z", "/x/y/z/w", "/EN/", "/" + "a/" * 3000]
    given = [None, "", "no scheme/en/", "a://b://c.net/", "http://example.net", "\n://x.net/\n/a"]
    given += [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#/en/', '?a://b'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "h", "s", "r") for i, u in enumerate(given)], "page_id bigint, url string, host string, slice string, rules string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, urls.rule_table(spark, RULES)).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(given)}


def test_empty_null_and_repeated(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.judge(none, urls.rule_table(spark)).count() == 0
    twice = spark.createDataFrame([(1, "x://a.net/"), (1, "x://a.net/"), (None, "x://a.net/")], "page_id bigint, url string")
    assert [r["verdict"] for r in urls.judge(twice, urls.rule_table(spark)).collect()] == ["block"] * 3
    assert {r["verdict"] for r in urls.judge(twice, urls.rule_table(spark, [(None, "/", "block"), ("net", None, "block")])).collect()} == {"allow"}
