import random

import pytest

from cases import frame, same_as_sql
from waymark.llm import url_rules
from waymark.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, stack string"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = rest[:k], rest[k:]
    path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judge(url, rules):
    host, path = parse(url)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "allow"), default=None)
    return (host, path, best and best[0] + best[1], best[2] if best else "allow")


def run(spark, urls, rules, partitions=None):
    pages = frame(spark, [(i, u, None) for i, u in enumerate(urls)], SCHEMA)
    out = url_rules.judge_urls(pages, spark.createDataFrame(rules, url_rules.RULES), partitions=partitions)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}


@pytest.mark.parametrize("seed,partitions", [(0, 1), (1, 3), (2, 7)])
def test_random_nested_rules(spark, seed, partitions):
    rng = random.Random(seed)
    label = lambda: rng.choice(["a", "b", "a-b", "a1", "c", "com", "a.b"])
    host = lambda n: ".".join(label() for _ in range(n))
    path = lambda: "/" + "/".join(rng.choice(["x", "y", "xy", ""]) for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(rng.randint(1, 3)), path()) for _ in range(40))}.values())
    urls = [f"http://{host(rng.randint(1, 5))}{rng.choice([path(), '', '?q=/x', '#/x', path() + '?a', path() + '#b'])}" for _ in range(500)]
    got = run(spark, urls, rules, partitions)
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "://com/", "HTTP://WWW.Example.COM/en/x", "http://example.com", "http://com/", "http://xcom/", "http://a..com/", "http://com./x", "http://.com/x", "http://example.com/en", "http://exa\nmple.com/en/", "http://É.com/É?q", "http://a.net/es/x#y", "http://a://com/", "x" * 100_000 + "://com/" + "y" * 100_000, "http://com/", "http://com/"]
    got = run(spark, urls, URL_RULES)
    assert got == {i: judge(u, URL_RULES) for i, u in enumerate(urls)}


def test_empty(spark):
    assert run(spark, [], URL_RULES) == {}
    assert run(spark, ["http://a.com/"], []) == {0: ("a.com", "/", None, "allow")}
    odd = [(None, "/", "block"), ("a.com", None, "block")]
    assert run(spark, ["http://a.com/"], odd)[0][2:] == (None, "allow")


def test_query_matches_sql(spark):
    got, want = same_as_sql(spark, "op9_url_rules")
    assert got == want


def test_many_rules_of_one_host(spark):
    rng = random.Random(8)
    part = lambda: rng.choice("abcdefgh") * rng.randint(1, 2)
    rules = list({("x.com", p): ("x.com", p, rng.choice(["allow", "block"])) for p in ("/" + "/".join(part() for _ in range(rng.randint(0, 5))) for _ in range(3000))}.values())
    urls = [f"http://{rng.choice(['x.com', 'a.x.com', 'y.com', 'com'])}/{'/'.join(part() for _ in range(rng.randint(0, 6)))}" for _ in range(300)]
    assert run(spark, urls, rules) == {i: judge(u, rules) for i, u in enumerate(urls)}


def test_names_that_clash(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/", "h", "p", "r", "v", "k", 5, "s")], "page_id int, url string, host string, path string, rule string, verdict string, key string, rank int, value string")
    got = url_rules.judge_urls(pages, spark.createDataFrame(URL_RULES, url_rules.RULES)).first().asDict()
    assert got == {"page_id": 1, "url": "http://a.net/es/", "key": "k", "rank": 5, "value": "s", "host": "a.net", "path": "/es/", "rule": "net/es/", "verdict": "block"}


def test_rules_that_repeat(spark):
    rules = [("a.com", "/x", "block"), ("A.com", "/x", "allow"), ("a.com", "/x", "block"), ("a.com", "/", "block")]
    assert run(spark, ["http://a.com/xy", "http://a.com/z"], rules) == {0: ("a.com", "/xy", "a.com/x", "allow"), 1: ("a.com", "/z", "a.com/", "block")}
