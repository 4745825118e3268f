import re

from foliant.llm import url_reputation as ur


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in ur.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


URLS = [None, "", "example.com/en/", "http://com/en/", "HTTP://A.Example.COM/en/7?x", "https://a.example.com/en/81#y", "http://badexample.com/en/1", "http://x.example.net/de/8", "http://x.example.net/de/9", "http://y.org/es/1", "http://y.org", "http://y.org?x=/es/", "a://b://c/d", "http://É.com/EN/", "http://q.com/\nen/", "http://x.y.co.uk/a"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string")
    got = ur.judge(df).collect()
    assert len(got) == len(URLS) * 2
    for r in got:
        host, path, rule = plain(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        if rule:
            assert r.verdict == rule.verdict
    assert ur.judge(df.limit(0)).count() == 0


def test_reputation_shrinks_and_falls_back(spark):
    outcomes = [("a.bad.com", 1)] * 40 + [("b.bad.com", 1)] * 40 + [("x.good.com", 0)] * 80 + [("once.com", 1)]
    o = spark.createDataFrame(outcomes, "host string, bad int")
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(["a.bad.com", "new.bad.com", "x.good.com", "new.com", "once.com", "z.net"])], "page_id long, url string")
    got = {r.host: r for r in ur.judge(pages, rules=(), outcomes=o).collect()}
    assert got["a.bad.com"].verdict == got["new.bad.com"].verdict == "block"
    assert got["x.good.com"].verdict == got["once.com"].verdict == got["z.net"].verdict == "allow"
    assert [got[h].level for h in ("a.bad.com", "new.bad.com", "new.com", "z.net")] == ["host", "domain", "suffix", "none"]
    assert got["once.com"].reputation < got["a.bad.com"].reputation


def test_suffixes(spark):
    r = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("localhost",), ("",)], "h string").select(ur.domain(ur.F.col("h")).alias("d"), ur.suffix(ur.F.col("h")).alias("s")).collect()
    assert [tuple(x) for x in r] == [("b.co.uk", "co.uk"), ("b.com", "com"), ("localhost", "localhost"), ("", "")]
