import duckdb
import pandas as pd

from covey.llm import urlfilter as u


def test_against_sql(spark, small):
    extra = ["https://EXAMPLE.org/es/1", "http://a.example.org/en/12?x", "http://example.org", "nothing", None, "://", "http://notexample.org/es/", "x://com/fr/é", "http://a.com/de/fr/#q", "http://org#frag", "ftp://u@h.org:80/es/", "http://example.org/es", "a://b://c.org/"]
    pages = pd.DataFrame({"page_id": [*range(len(extra)), 3, 3], "url": [*extra, extra[3], extra[0]]}).astype({"url": object})
    df = spark.createDataFrame([(int(p), v if isinstance(v, str) else None, 9) for p, v in pages.itertuples(index=False)], "page_id long, url string, rule int")
    for salts in (1, 7):
        got = sorted(map(tuple, u.filter_urls(df, u.rules_frame(spark, u.RULES), salts=salts).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
        assert got == sorted(duckdb.query(u.ORACLE_SQL).fetchall(), key=str)


def brute(url, rules, default):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def test_nested_rules(spark):
    rules = [("b.c", "/", "block"), ("a.b.c", "/", "allow"), ("b.c", "/x/", "allow"), ("b.c", "/x/y", "block"), ("b.c", "/x/yz", "allow"), ("c", "", "block"), ("b.c", "/x/", "block"), ("c", "/x/yy/very/long", "allow")]
    hosts, paths = ["c", "b.c", "a.b.c", "d.a.b.c", "bb.c", "x.org"], ["", "/", "/x", "/x/", "/x/y", "/x/yz", "/x/yzz", "/x/yy/very/long", "/xz", "/z"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in u.filter_urls(df, u.rules_frame(spark, rules), default="block").collect():
        want = brute(r["url"], [x for x in rules if x[:2] != ("b.c", "/x/")] + [("b.c", "/x/", "block")], "block")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert u.filter_urls(none, u.rules_frame(spark, u.RULES)).count() == 0
    assert [r["verdict"] for r in u.filter_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), u.rules_frame(spark, u.RULES).limit(0)).collect()] == ["allow"]
    plan = u.op5_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hosts_of_a_megabyte_and_of_many_labels(spark):
    """Suffixes are as many as a rule's labels: the keys of a long host don't grow with its square."""
    hosts = ["a" * (1 << 20) + ".example.org", "x." * (1 << 19) + "example.org", "x." * (1 << 19) + "net", ".org", "org.", ".."]
    df = spark.createDataFrame([(k, f"http://{h}/es/") for k, h in enumerate(hosts)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in u.filter_urls(df, u.rules_frame(spark, u.RULES)).select("page_id", "rule", "verdict").collect()}
    assert got == {0: ("example.org/es/", "block"), 1: ("example.org/es/", "block"), 2: (None, "allow"), 3: ("org/", "allow"), 4: (None, "allow"), 5: (None, "allow")}
