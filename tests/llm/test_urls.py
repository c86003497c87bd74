"""Operator 3: every rule tried on every address."""

import random
import re

from glosa.llm import urls


def parts(url):
    if url is None or "://" not in url:
        return "", "", ""
    t = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", t).group()
    path = re.match(r"[^?#]*", t[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path, t[len(host) + len(path):]


def brute(url):
    host, path, rest = parts(url)
    best = None
    for spec, action in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        h, _, p = spec.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(spec) > len(best[0])):
            best = spec, action
    if best:
        return host, path, best[0], best[1]
    own = [(r.rank, r.action) for r in urls.OWN if re.search(r.pattern, host + path + rest)]
    return host, path, None, max(own)[1] if own else "allow"


def test_against_all_rules(spark):
    rng = random.Random(2)
    seen = ["http://a.b/login", "https://x.com/ads/1?print=1", "http://x.com/docs/a?b=1&utm_source=feed", "http://x.com/a?utm_source=feed",
            "HTTP://EXAMPLE.NET/en/1", "http://NET", "http://net/", "http://anet/x", "http://example.net/en", "ftp://q.example.com/de/#x",
            "http://É.org/fr/", "http://x.org?/fr/", "http://org/fr/a://net/", None, "", "no scheme/net/", "://net/", "a://", "x" * 50_000 + "://net/a",
            "http://stats.doubleclick.net:80/x", "http://x.com/?sid=1", "http://x.com/p?PHPSESSID=2", "http://example.net:8080/en/", "http://a.net/\n/ads/"]
    bits = ["http://", "net", "example", ".", "/", "com", "de", "en", "fr", "org", "?", "#", "ads", "login", "utm_source=feed", "&", "docs", "A"]
    seen += ["".join(rng.choice(bits) for _ in range(rng.randint(2, 12))) for _ in range(400)] + seen[:5]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(seen)], "page_id long, url string, address string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge_urls(pages).collect()}
    assert got == {i: brute(u) for i, u in enumerate(seen)}


def test_index_uses_the_rarest_token(spark):
    assert all(r.tokens for r in urls.LISTED + urls.OWN)  # no expression runs on addresses that don't hold its token
    table = urls.rule_table(spark, (urls.host_rule("block", "example.net/en/"),))
    frequency = spark.createDataFrame([("example", 9), ("net", 2), ("en", 5)], "token string, n long")
    assert urls.indexed(table, frequency).first()["token"] == "net"
    assert urls.host_rule("block", "a.b/c/d").tokens == ("a", "b", "c")  # d may go on in an address


def test_empty_table(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
