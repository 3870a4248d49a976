import random

import duckdb
from quillstream.llm import urls


def plain(url, rules, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c, 1)[0]
        path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, default
    best = max(fit, key=lambda x: (x[0], x[1], x[3] == "block"))
    return host, path, best[2], best[3]


URLS = [None, "", "example.net/en/", "http://", "http://a.net", "http://A.NET/", "x://example.net/en/1?q#f", "x://notexample.net/en/", "x://a.example.com/de/x", "x://b.org/fr/", "x://b.org/fr", "x://net/?a", "x://net?/", "x://..net//", "x://é.org/fr/é", "a://b.com/://c.net/", "x://h\n.net/p\nq"]


def test_defined_cases(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS)], "page_id long, url string, keys string")
    got = urls.judge(pages, urls.RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain((URLS + URLS)[r.page_id], urls.RULES)
    none = spark.createDataFrame([], pages.schema)
    assert urls.judge(none, urls.RULES).count() == 0
    assert {r.verdict for r in urls.judge(pages, spark.createDataFrame([], "verdict string, host string, path string")).collect()} == {"allow"}


def test_many_rules_and_shards(spark, monkeypatch):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 4)))
    rules = {(host(), rng.choice(["/", "/a", "/a/", "/b/c"])): rng.choice(["allow", "block"]) for _ in range(300)}
    rules = [(v, h, p) for (h, p), v in rules.items()]
    pages = [(i, f"http://{host()}.{host()}{rng.choice(['', '/', '/a', '/a/b', '/b/c/d?x'])}") for i in range(1500)]
    build = urls.build
    monkeypatch.setattr(urls, "build", lambda u, k: build(u, k, shard_keys=40))
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules, most_bytes=64).collect()
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(pages[r.page_id][1], rules)


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.execute(urls.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, urls.op1_url_filter(spark, sf).collect())) == sorted(want)


def test_long_hosts_and_many_lengths(spark):
    rng = random.Random(1)
    rules = [("block" if n % 2 else "allow", f"r{n % 5}.net", "/" + "a" * n) for n in range(150)] + [("allow", "a.a.a", "/")]
    pages = [(i, f"http://x.r{i % 5}.net/{'a' * rng.randrange(200)}b") for i in range(300)]
    pages += [(1000, "http://" + "a." * 4000 + "a/x"), (1001, "http://a.a/" + "y" * 100_000), (1002, "http://" + "." * 3000 + "/")]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()
    by = dict(pages)
    assert len(got) == len(pages)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(by[r.page_id], rules)
