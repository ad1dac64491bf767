"""URL filters against a plain walk over the rules."""

import numpy as np
import pytest

from moltable.llm import cascade

URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "https://example.com/en",
    "http://notexample.com/en/1", "http://a.b.example.com/en/1", "ftp://x.net/es/1", "ftp://net/fr/", "ftp://x.NET/FR/", "http://x.net?/es/", "http://x.net#/es/",
    "http://.com/", "http://x.com./", "a://b://c.com/", "http://exämple.net/es/", "http://x.net/es/" + "a" * 50_000, "http://" + "a." * 300 + "net/es/\n1", "http://x.com:80/en/",
]
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
    ("block", "b.example.com", ""), ("allow", "both.com", "/"), ("block", "both.com", "/"), (None, "net", "/"), ("block", None, "/"),
]


def _judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if None not in (v, h, p) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if host and fits else None
    return host, path, best and best[2], best[3] if best else default


@pytest.mark.parametrize("max_bits", [cascade.MAX_BITS, 64])
def test_judged_as_by_a_walk_over_all_rules(spark, max_bits):
    rules = [*RULES, *[(("block", "allow")[i % 2], f"h{i}.org", "/p"[: i % 3]) for i in range(40)]]
    urls = [*URLS, *[f"https://{'www.' * (i % 2)}h{i}.org/{'q' * (i % 2)}{'p' * (i % 5 > 0)}/{i}" for i in range(60)], "http://h7.org/", "http://h7.org/"]
    schema = "page_id bigint, url string, host int, path int, rule int, verdict int, keys int, best int"
    pages = spark.createDataFrame([(i if i else None, u, 1, 2, 3, 4, 5, 6) for i, u in enumerate(urls)], schema).repartition(3)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = cascade.judge_urls(pages, table, max_bits=max_bits).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i if i else None, *_judge(u, rules)) for i, u in enumerate(urls)), key=repr)


def test_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    assert [tuple(r) for r in cascade.judge_urls(pages, rules.where("false"), "block").collect()] == [(1, "a.com", "/", None, "block")]
    assert cascade.judge_urls(pages.where("false"), rules).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    """Some thousand listed keys among many: false positives appear and every level settles some of them."""
    keys = [f"k{i}" for i in range(20_000)]
    listed = set(np.random.default_rng(3).choice(keys, 3000, replace=False).tolist())
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    levels = cascade.build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), universe)
    assert len(levels) >= 3
    rows = universe.selectExpr("key", "array(key) as keys")
    got = cascade._first_member(rows, "keys", levels, "at").where("at is not null").select("key").collect()
    assert {r["key"] for r in got} == listed
    bits = sum(level.size for level in levels)
    assert bits < 16 * len(listed)
